"""Token counts as rollups kept up to date by signed deltas.

A batch of changes (insert, revise, delete) becomes signed rows: a new text counts
+1 document and +n tokens, the text it replaces or deletes counts -1 and -n, by
source, language and tokenizer version. Totals are sums of signed rows, so any
number of batches adds up in any order.

A batch is written to a folder of its own under its number and counts once the
commit marker beside it exists. A batch that is sent again after its commit is
left out; one that broke off before is written anew. Lost executors repeat tasks
of one write and change nothing else.

The ledger has a row for each document, version and batch that touched it; what a
batch replaces is found by a join of its ids with the ledger, of which only the buckets
of these ids are read; texts are not kept.
:meth:`Rollup.totals` reads the deltas only, a few rows a batch.

Every ``GENERATION`` batches, :meth:`Rollup.compact` adds up what is committed into one ledger and
one table of deltas, a generation, so that a batch or a total reads one generation and at most so many
batches, however many there were. A generation counts once its own marker exists and names the batches in it, so
one that broke off changes nothing. One writer at a time is assumed.

Nulls: a null text has no tokens; null source and language are groups of their own.
A null doc_id can be inserted only, and never replaced. In one batch the last change
of an id (by ``order``, then the larger text) counts; repeated rows are one change.
Deleting or revising an unknown id is an insert of nothing or of the text. An empty
batch commits and adds nothing.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm._common import materialise, scratch_dir, small, table

#: Tokenizer versions: a rank file of byte-level BPE each.
TOKENIZERS = {"byte_bpe_50k": "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}
#: Fixed value: how these vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "tokenizer")
BUCKETS = 64  # of the ledger, by a hash of the id; a batch reads those of its ids only
GENERATION = 16  # batches that are read one by one
SPREAD = 4  # files of a bucket in a batch

DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"
LEDGER = "doc_id {}, " + DELTAS + ", bucket int"

_ENCODERS: dict[str, tiktoken.Encoding] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def encoder(name: str, ranks: dict[bytes, int]) -> tiktoken.Encoding:
    """One for each worker process and vocabulary."""
    if name not in _ENCODERS:
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def token_counts_udf(vocabularies):
    """A UDF from texts to their tokens by version; ``vocabularies``: a broadcast of version to ranks."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("n", T.LongType())])))
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("tokenizer", pa.string()), ("n", pa.int64())]))
        encoders = [(v, encoder(v, r)) for v, r in vocabularies.value.items()]
        for texts in batches:
            out = []
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                out.append([{"tokenizer": v, "n": len(e.encode_ordinary(text))} for v, e in encoders])
            yield pa.array(out, kind)

    return counts


class Rollup:
    """Totals of documents and tokens by source, language and tokenizer version, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, tokenizers: dict[str, str] = TOKENIZERS):
        self.spark, self.root = spark, root.rstrip("/")
        self.count = token_counts_udf(spark.sparkContext.broadcast({v: read_ranks(p) for v, p in tokenizers.items()}))

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        path, fs = self._path(f"{self.root}/commits")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def _generation(self) -> tuple[str | None, set[int]]:
        """The folder of the last whole generation and the batches in it."""
        path, fs = self._path(f"{self.root}/generations")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        whole = [int(n) for n in names if fs.exists(self._path(f"{self.root}/generations/{n}/done")[0])]
        if not whole:
            return None, set()
        folder = f"{self.root}/generations/{max(whole)}"
        return folder, {r["batch"] for r in self.spark.read.schema("batch long").parquet(f"{folder}/batches").collect()}

    def _read(self, kind: str, schema: str) -> DataFrame:
        folder, inside = self._generation()
        paths = [f"{folder}/{kind}"] * bool(folder) + [f"{self.root}/{kind}/{b}" for b in self.committed() if b not in inside]
        found = [self.spark.read.schema(schema).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], schema)

    def compact(self, id_type: str = "bigint") -> bool:
        """Add up all committed batches in a new generation and remove what it replaces. False if there is nothing to add.

        ``id_type``: the type of doc_id. Frames of :meth:`totals` that were made before must have been written.
        """
        batches, (folder, inside) = self.committed(), self._generation()
        if inside.issuperset(batches):
            return False
        target = f"{self.root}/generations/{int(folder.rsplit('/', 1)[1]) + 1 if folder else 1}"
        summed = (F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        ledger = self._read("ledger", LEDGER.format(id_type)).groupBy("doc_id", *KEYS, "bucket").agg(*summed).where("docs != 0 or tokens != 0")
        self._write_ledger(ledger, f"{target}/ledger")
        materialise(self._read("deltas", DELTAS).groupBy(*KEYS).agg(*summed).where("docs != 0 or tokens != 0"), f"{target}/deltas")
        materialise(self.spark.createDataFrame([(b,) for b in batches], "batch long"), f"{target}/batches")
        marker, fs = self._path(f"{target}/done")
        fs.create(marker, True).close()
        for gone in [folder] * bool(folder) + [f"{self.root}/{kind}/{b}" for kind in ("counted", "ledger", "deltas") for b in batches if b not in inside]:
            fs.delete(self._path(gone)[0], True)
        return True

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Add a batch: (doc_id, op, source, lang, text) and, if there is one, ``order``. False if it was committed before."""
        if batch in self.committed():
            return False
        order = F.col("order") if "order" in changes.columns else F.lit(0)
        kinds = {f.name: f.dataType.simpleString() for f in changes.schema}
        # texts become counts where they are read; only counts are shuffled
        gone = F.col("op") == "delete"
        new = changes.where(F.col("op").isin("insert", "revise", "delete")).select("doc_id", "op", F.struct(order.alias("order"), (~gone).alias("there"), F.when(~gone, self.count(F.when(~gone, F.col("text")))).alias("counts"), "source", "lang").alias("c"))
        known = new.where("doc_id is not null").groupBy("doc_id").agg(F.max("c").alias("c"))
        new = materialise(known.unionByName(new.where("doc_id is null and op = 'insert'").select("doc_id", "c")), f"{self.root}/counted/{batch}")
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
        ids = new.select("doc_id").where("doc_id is not null")
        touched = [r["b"] for r in ids.select(bucket.alias("b")).distinct().collect()]
        ledger = self._read("ledger", LEDGER.format(kinds["doc_id"])).where(F.col("bucket").isin(touched))
        before = ledger.join(small(ids), "doc_id", "left_semi").groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")
        minus = before.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        plus = new.where("c.there").select("doc_id", "c.source", "c.lang", F.explode("c.counts").alias("t")).select("doc_id", "source", "lang", "t.tokenizer", F.lit(1).cast("long").alias("docs"), F.col("t.n").alias("tokens"))
        # rows without an id can't be replaced, so the ledger doesn't hold them
        signed = self._write_ledger(minus.unionByName(plus.where("doc_id is not null")).withColumn("bucket", bucket), f"{self.root}/ledger/{batch}")
        signed = signed.drop("bucket").unionByName(plus.where("doc_id is null"))
        deltas = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")
        materialise(deltas, f"{self.root}/deltas/{batch}")
        marker, fs = self._path(f"{self.root}/commits/{batch}")
        fs.create(marker, True).close()
        if len(set(self.committed()) - self._generation()[1]) > GENERATION:
            self.compact(kinds["doc_id"])
        return True

    def _write_ledger(self, signed: DataFrame, path: str) -> DataFrame:
        signed.repartition("bucket", F.pmod(F.xxhash64("doc_id", "tokenizer"), F.lit(SPREAD))).write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(signed.schema).parquet(path)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches; groups that have come to nothing are left out."""
        deltas = self._read("deltas", DELTAS)
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")


def later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id) of documents with a text of which none of their rows is the first: the smallest id of each text is first."""
    keyed = materialise(docs.where("text is not null and doc_id is not null").select("doc_id", F.sha2("text", 256).alias("sha")))
    firsts = keyed.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    return keyed.select("doc_id").distinct().join(firsts.select("doc_id").distinct(), "doc_id", "left_anti")


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents, the last of them sent twice.

    Batch 1 inserts every document, batch 2 revises those with repeated lines (each
    line stays once), batch 3 deletes the later copies of a text.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = Rollup(spark, f"{scratch_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.apply(1, docs.withColumn("op", F.lit("insert")))
    lines = F.split("text", "\n")
    rollup.apply(2, docs.where(F.size(F.array_distinct(lines)) < F.size(lines)).withColumn("text", F.array_join(F.array_distinct(lines), "\n")).withColumn("op", F.lit("revise")))
    copies = materialise(later_copies(docs)).select("doc_id", F.lit("delete").alias("op"), *(F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text")))
    rollup.apply(3, copies)
    rollup.apply(3, copies)
    return rollup.totals()
