"""Curating, selecting and evaluating labelled records and vectors on Spark."""
