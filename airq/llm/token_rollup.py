"""Token counts as delta-maintained rollups.

A change carries what was counted before and what is counted after: an insert has no before, a delete no after, a
revised count both. Changes become signed rows that are summed by source, language and tokenizer version before
they are written; totals are sums over all committed batches, so nothing counted earlier is read again.

A batch is written to a folder of its own, and then a row of the log names that folder as the batch's: only then is it
committed. Committing it again writes another folder and another row, of which the last holds, so that nothing is deleted first, a
repeated commit changes nothing, and one that was interrupted half way leaves the totals as they were. The log is on disk:
a rollup opened on the same path later knows all batches.

Null sources and languages are groups of their own; a null count is 0; a null text has no tokens; a change with neither side
counts nothing; repeated rows count as often as they come. Texts of any length are counted whole. Without committed batches,
totals have no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import store
from .common import join_small, materialise, shared_dir
from .packing import tokenizer

BY = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, documents long, tokens long"
LOG = "batch string, folder string, number long"


def image(tokenizer: str, tokens: Column) -> Column:
    """One side of a change: the row's source and language, a tokenizer version and its count."""
    return F.struct(F.col("source"), F.col("lang"), F.lit(tokenizer).alias("tokenizer"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def signed(changes: DataFrame) -> DataFrame:
    """``changes(before, after)``, structs that may be null, to their summed signed rows."""
    sides = F.array(F.struct(F.lit(-1).cast("long").alias("sign"), F.col("before").alias("row")), F.struct(F.lit(1).cast("long").alias("sign"), F.col("after").alias("row")))
    rows = changes.select(F.inline(sides)).where("row is not null").select("sign", "row.*")
    return rows.groupBy(*BY).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))


class Rollup:
    """Totals under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/airq-{uuid.uuid4().hex}/rollup"

    def folders(self) -> dict[str, str]:
        """The committed batches and their folders; a row for each commit is read, as small as a log is."""
        if not store.exists(self.spark, f"{self.path}/log"):  # nothing was committed yet
            return {}
        rows = self._log().groupBy("batch").agg(F.max(F.struct("number", "folder")).alias("last")).select("batch", "last.folder").collect()
        return {r["batch"]: r["folder"] for r in rows}

    def _log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def write(self, changes: DataFrame) -> str:
        """The summed changes in a folder that no batch has yet."""
        folder = uuid.uuid4().hex
        signed(changes).write.parquet(f"{self.path}/sums/{folder}")
        return folder

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Add a batch of changes, or replace it; of commits at once each gets a number of its own."""
        folder = self.write(changes)
        with store.locked(self.spark, self.path):
            number = self._log().count() if store.exists(self.spark, f"{self.path}/log") else 0
            self.spark.createDataFrame([(batch, folder, number)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens`` of the groups that still hold documents."""
        folders = self.folders()
        if not folders:
            return self.spark.createDataFrame([], SUMS)
        parts = self.spark.read.schema(SUMS).parquet(*[f"{self.path}/sums/{f}" for f in sorted(folders.values())])
        return parts.groupBy(*BY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")


_loaded: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level tokenizer of a file of ranks, loaded once in a Python worker."""
    if path not in _loaded:
        with open(path) as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
        _loaded[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


#: White space of the pattern (fixed values), in runs longer than a pattern matcher's stack should bear.
LONG_SPACE = re.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def token_count(bytes_: tiktoken.Encoding, text: str) -> int:
    """How many ids ``encode_ordinary`` gives, which overflows its stack on very long runs of white space.

    The pattern makes one piece of a run that ends a text; of any other run all but the last character are one piece, and the
    last belongs to what follows. So a long run can be cut there and encoded by itself.
    """
    total, at = 0, 0
    for run in LONG_SPACE.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        total += len(bytes_.encode_ordinary(text[at : run.start()])) + len(bytes_._encode_single_piece(text[run.start() : stop]))
        at = stop
    return total + len(bytes_.encode_ordinary(text[at:]))


def _counter(first: str, second: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bytes_ = tokenizer(first), encoding(second)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(0).to_pylist()]
                old, new = [len(ids) for ids in words.encode(texts)], [token_count(bytes_, t) for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(old, pa.int64()), pa.array(new, pa.int64())], names=[*batch.schema.names[1:], "old", "new"])

    return count


def maintained(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Totals of ``docs(doc_id, text, source, lang)`` after three batches, counted by two tokenizers' files, a word vocabulary and ranks of bytes.

    All documents are inserted under version ``words-1``; those whose text a smaller id has are deleted, a batch that is
    committed twice; the rest are counted anew under version ``bytes-2``.
    """
    rows = docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    counted = materialise(rows.mapInArrow(_counter(first, second), "doc_id long, source string, lang string, key string, old long, new long"), "counted")
    several = materialise(counted.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")).where("many > 1").select("key", "first"), "several")
    counted = join_small(counted, several, ["key"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    counted = materialise(counted.drop("key", "first"), "marked")

    none = F.lit(None).cast("struct<source: string, lang: string, tokenizer: string, tokens: bigint>")
    before, after = image("words-1", F.col("old")), image("bytes-2", F.col("new"))
    rollup = Rollup(docs.sparkSession)
    rollup.commit("1", counted.select(none.alias("before"), before.alias("after")))
    for _ in range(2):
        rollup.commit("2", counted.where("copy").select(before.alias("before"), none.alias("after")))
    rollup.commit("3", counted.where("not copy").select(before.alias("before"), after.alias("after")))
    return rollup.totals()
