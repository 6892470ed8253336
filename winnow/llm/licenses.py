"""Licence scans with a generalised suffix automaton of licence texts.

The automaton holds every run of words of every template. A text is streamed
through it word by word, which gives its matching statistics: at each word, the
longest run ending there that some template contains. A template's runs of ``ANCHOR``
words or more (or of all its words, if it has fewer) that can't be longer are chained, in
the order of text and template with gaps of ``GAP`` words at most; a chain that covers
``COVER`` of a template is a found span. The base phrases are templates too, so each
place of theirs is a span of coverage 1.

Templates are a parameter of bounded size, so the automaton travels with the code.
Texts are neither shuffled nor cut, and each is handled alone.

Nulls: a null text counts as empty. Texts without words have no places, empty label
lists and score 0. Repeated rows come out as often as they went in; an empty input
gives no rows. Other columns are not looked at; one named like the output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm._common import table
from winnow.llm._text import ALNUM, encoded, slices, translated, words_of

ANCHOR = 3
GAP = 12
COVER = 0.8

#: Phrases and the label of each.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Notices and passages of well-known licences, by label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("agpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("artistic-2.0", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("gpl-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl-2.0", "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0."),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)


def words(text: str) -> list[str]:
    return text.encode().translate(ALNUM).decode().split()


@dataclass
class Automaton:
    """Every run of words of every template; ``ends`` has the (template, end) places of each state's runs."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def add(self, template: int, tokens: list[int]) -> None:
        last = 0
        for i, t in enumerate(tokens):
            last = self._extend(last, t)
            self.ends[last].append((template, i + 1))

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step), self.length.append(length), self.link.append(link), self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, t: int, q: int) -> int:
        """A state for the runs of ``q`` that also end where ``p`` goes on with ``t``."""
        twin = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.step[p].get(t) == q:
            self.step[p][t] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, t: int) -> int:
        q = self.step[last].get(t)
        if q is not None:  # another template has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, t, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and t not in self.step[p]:
            self.step[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, t, q)
        return new

    def finish(self) -> None:
        """Hand each state's places down to the states of its suffixes."""
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] = self.ends[self.link[s]] + self.ends[s] if self.link[s] > 0 else []


@dataclass
class Scanner:
    vocabulary: dict[str, int]
    automaton: Automaton
    sizes: list[int]  #: how many words each template has
    labels: list[str]
    phrases: list[dict[int, str]]  #: by state: length of a base phrase that its runs end in, and the label
    tokens: list[list[int]]  #: words of each template as numbers
    pairs: np.ndarray  #: sorted numbers of the pairs of words that a template has side by side

    @staticmethod
    def of(templates: tuple[tuple[str, str], ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE) -> Scanner:
        texts = [(label, words(text)) for label, text in templates] + [(label, words(phrase)) for phrase, label in base]
        vocabulary: dict[str, int] = {}
        tokens = [[vocabulary.setdefault(w, len(vocabulary)) for w in t] for _, t in texts]
        auto, pairs = Automaton(), set()
        for i, t in enumerate(tokens):
            auto.add(i, t)
            pairs.update(a * len(vocabulary) + b for a, b in zip(t, t[1:]))
        auto.finish()
        phrases: list[dict[int, str]] = [{} for _ in auto.length]
        for k in range(len(templates), len(texts)):
            s = 0
            for t in tokens[k]:
                s = auto.step[s][t]
            phrases[s][len(tokens[k])] = texts[k][0]
        for s in sorted(range(1, len(auto.length)), key=lambda s: auto.length[s]):
            phrases[s] = {**phrases[auto.link[s]], **phrases[s]}
        return Scanner(vocabulary, auto, [len(t) for t in tokens], [label for label, _ in texts], phrases, tokens, np.array(sorted(pairs), np.int64))

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(state, length) of the longest run that ends at each word."""
        step, link, length = self.automaton.step, self.automaton.link, self.automaton.length
        s, n, out = 0, 0, []
        for t in tokens:
            while s and t not in step[s]:
                s = link[s]
                n = length[s]
            if t in step[s]:
                s, n = step[s][t], n + 1
            out.append((s, n))
        return out

    def scan(self, runs: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """Base places (start, label), and spans (label, start, end, coverage); ``runs``: (start, words) between words that no template goes on with."""
        places, anchors = [], []
        for at, tokens in runs:
            stats = self.statistics(tokens)
            for i, (s, n) in enumerate(stats):
                for size, label in self.phrases[s].items():
                    if size <= n:
                        places.append((at + i + 1 - size, label))
                anchors += [(at + i + 1 - k, k, template, end - k) for k, template, end in self.ending(s, n, tokens[i + 1] if i + 1 < len(tokens) else -1)]
        return places, self.chain(anchors)

    def ending(self, s: int, n: int, after: int) -> list[tuple[int, int, int]]:
        """(words, template, end in it) of each template's run that ends with the longest run (``s``, ``n``) and doesn't go on with ``after``."""
        out, seen = [], set()
        while s > 0:
            for template, end in self.automaton.ends[s]:
                if (template, end) not in seen:  # else a longer run of it ends here
                    seen.add((template, end))
                    size = self.sizes[template]
                    if n >= min(ANCHOR, size) and (end == size or self.tokens[template][end] != after):
                        out.append((n, template, end))
            s = self.automaton.link[s]
            n = self.automaton.length[s]
        return out

    def chain(self, anchors: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """The spans of chains that cover enough of a template. An anchor: (start, words, template, start in the template)."""
        spans = []
        by: dict[int, list[tuple[int, int, int]]] = {}
        for at, n, template, begin in sorted(anchors):
            by.setdefault(template, []).append((at, n, begin))
        for template, found in by.items():
            best: list[tuple[int, int, int]] = []  # covered words, start, anchor before
            for i, (at, n, begin) in enumerate(found):
                mine = (n, at, -1)
                for j in range(i - 1, -1, -1):
                    a, m, b = found[j]
                    if at - a > GAP + self.sizes[template]:
                        break
                    over = max(0, a + m - at, b + m - begin)  # words that both anchors hold
                    if at - a - m <= GAP and 0 < begin - b and begin - b - m <= GAP and over < n and best[j][0] + n - over > mine[0]:
                        mine = (best[j][0] + n - over, best[j][1], j)
                best.append(mine)
                if mine[0] >= COVER * self.sizes[template]:
                    spans.append((self.labels[template], mine[1], at + n, mine[0] / self.sizes[template]))
        return spans


def scan_batch(scanner: Scanner, texts: pa.StringArray) -> list[dict]:
    """Words, base places and spans of each text."""
    flat, off = words_of(translated(texts, ALNUM))
    distinct, ids = encoded(flat)
    known = np.array([scanner.vocabulary.get(w, -1) for w in distinct.to_pylist()], np.int64)
    t = known[ids] if len(ids) else ids
    go = np.zeros(len(t), bool)  # whether a template goes on from this word to the next
    if len(t) > 1:
        code = t[:-1] * len(scanner.vocabulary) + t[1:]
        at = np.minimum(np.searchsorted(scanner.pairs, code), len(scanner.pairs) - 1)
        go[:-1] = (t[:-1] >= 0) & (t[1:] >= 0) & (len(scanner.pairs) > 0) & (scanner.pairs[at] == code)
        ends = off[1:] - 1
        go[ends[ends >= 0]] = False
    edge = np.diff(go.astype(np.int8), prepend=0)
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(off, begin, "right") - 1
    runs: dict[int, list] = {}
    for d, a, b in zip(doc.tolist(), begin.tolist(), stop.tolist()):
        runs.setdefault(d, []).append((a - int(off[d]), t[a : b + 1].tolist()))
    out = []
    for d, n in enumerate(np.diff(off).tolist()):
        places, spans = scanner.scan(runs[d]) if d in runs else ([], [])
        out.append({"n_words": n, "places": [{"word": a, "label": b} for a, b in sorted(places)], "spans": [{"label": s[0], "start": s[1], "end": s[2], "coverage": s[3]} for s in sorted(spans)]})
    return out


_PLACE = T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())])
_SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("coverage", T.DoubleType())])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(_PLACE)), T.StructField("spans", T.ArrayType(_SPAN))])
_ARROW = pa.struct([("n_words", pa.int64()), ("places", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])))])


def scan_udf(scanner):
    """A UDF from texts to their words, base places and template spans (in words from 0); ``scanner``: a broadcast."""

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([r for part in slices(texts) for r in scan_batch(scanner.value, part)], _ARROW)

    return scan


def scan_licenses(docs: DataFrame, text: str = "text", out: str = "found", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``docs`` with ``out``: struct of n_words, places (word, label) and spans (label, start, end, coverage)."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner.of(templates))
    return docs.drop(out).withColumn(out, scan_udf(scanner)(text))


def op9_license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and licence labels of all documents."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, more = F.col("found.places.label"), F.col("found.spans.label")
    word = F.col("found.places.word")
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), F.size(word).cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.least(F.coalesce(F.array_max("found.spans.coverage"), F.lit(0.0)), F.lit(1.0)).alias("score"),
    )


def license_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of :func:`op9_license_spans` that the base phrases alone decide."""
    return op9_license_spans(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


LICENSE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT string_split(phrase, ' ') AS ph, label FROM (VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')) v(phrase, label)),
f AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d), p WHERE w[i + 1:i + len(ph)] = ph),
g AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
"""
