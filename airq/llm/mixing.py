"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Each source's words are summed by hash bucket. Where its budget ends inside a bucket, that bucket alone
is divided again, twelve bits of the hash at a time, until the budget ends at one document; a document is
then taken once more if its hash lies under its source's threshold. Nothing is sorted, and reruns agree.

Nulls: a null text has no words, a null source is a source of its own (the last), a null id is an id.
Rows that repeat in id and text share a hash and are taken or left together, as do rows whose hashes are equal by chance.
Texts of any length are counted whole. An empty table gives no rows. ``copies`` ignores other columns, ``mix`` keeps them
all, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import as_row, join_small, materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
HASH_BITS, STEP_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, with the source as a key that is never null, its words and its hash of 60 bits."""
    said = F.concat(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("row.text", F.lit("")))
    return as_row(docs).select(
        "row", F.coalesce(F.concat(F.lit("="), F.col("row.source").cast("string")), F.lit("")).alias("_source"), word_count(F.col("row.text")).alias("_size"),
        F.conv(F.substring(F.md5(said), 1, HASH_BITS // 4), 16, 10).cast("long").alias("_hash"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes(_source, source_size)``, a row a source, with ``target``.

    Sources stand by code point, null last, and weigh ``weights`` in turn. Filling starts with those whose
    cap is lowest for their weight: the first whose share of what the capped ones leave is within its cap
    sets the level for itself and all after it.
    """
    everything = Window.partitionBy()
    by_name = everything.orderBy(F.col("_source") == "", "_source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs).withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    by_cap = everything.orderBy(F.col("cap") / F.col("weight"), "_source")
    w = w.withColumns({
        "place": F.row_number().over(by_cap),
        "over": F.col("budget") - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
    })
    fits = F.col("over") * F.col("weight") / F.col("rest") <= F.col("cap")
    w = w.withColumn("level", F.min(F.when(fits, F.struct("place", "over", "rest"))).over(everything))
    target = F.when(F.col("place") < F.col("level.place"), F.col("cap").cast("double")).otherwise(F.col("level.over") * F.col("weight") / F.col("level.rest"))
    return w.select("_source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def thresholds(words: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """For a materialised ``words(_source, _size, _hash)``: each source's size, target, whole copies and hash threshold."""
    goal = targets(words.groupBy("_source").agg(F.sum("_size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    bounds = goal.withColumn("whole", whole).withColumns({
        "budget": F.col("target") - F.col("whole") * F.col("source_size"), "bucket": F.lit(0).cast("long"), "below": F.lit(0).cast("long"),
        "documents": F.lit(2).cast("long"), "at": F.lit(0).cast("long"), "size": F.lit(0).cast("long"),
    })
    bounds = materialise(bounds, "targets")
    known = ["_source", "source_size", "target", "whole", "budget"]
    running = Window.partitionBy("_source").orderBy("bucket")
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        inside = join_small(words, bounds.select("_source", F.col("bucket").alias("within")), ["_source"]).where(F.shiftright("_hash", shift + STEP_BITS) == F.col("within"))
        sums = inside.groupBy("_source", F.shiftright("_hash", shift).alias("bucket")).agg(F.sum("_size").alias("size"), F.count("*").alias("documents"), F.max("_hash").alias("at"))
        sums = sums.withColumn("through", F.sum("size").over(running))
        found = bounds.select(*known, F.col("below").alias("before")).join(sums, "_source").where(F.col("before") + F.col("through") > F.col("budget"))
        first = found.groupBy(*known).agg(F.min_by(F.struct("bucket", (F.col("before") + F.col("through") - F.col("size")).alias("below"), "documents", "at", "size"), "bucket").alias("b"))
        bounds = materialise(first.select(*known, "b.bucket", "b.below", "b.documents", "b.at", "b.size"), "bounds")
        if bounds.where("documents > 1").isEmpty():
            break
    nearer = F.col("below") + F.col("size") - F.col("budget") < F.col("budget") - F.col("below")
    ends = bounds.select("_source", (F.col("at") + nearer.cast("long")).alias("threshold"))
    return materialise(goal.withColumn("whole", whole).join(ends, "_source", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0).cast("long"))), "thresholds")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs(doc_id, text, source)`` to ``doc_id, size, source_size, target, taken``: the words that the mix takes."""
    words = materialise(_keyed(docs.select("doc_id", "text", "source")).select("row.doc_id", "_source", "_size", "_hash"), "words")
    mixed = join_small(words, thresholds(words, weights, share, max_epochs), ["_source"])
    times = F.col("whole") + (F.col("_hash") < F.col("threshold")).cast("long")
    return mixed.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * times).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it, with the same columns."""
    keyed = _keyed(docs)
    found = thresholds(materialise(keyed.select("_source", "_size", "_hash"), "words"), weights, share, max_epochs)
    mixed = join_small(keyed, found.select("_source", F.col("whole").alias("_whole"), F.col("threshold").alias("_threshold")), ["_source"])
    times = F.col("_whole") + (F.col("_hash") < F.col("_threshold")).cast("long")
    taken = mixed.select("row", times.cast("int").alias("times")).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM words GROUP BY source
), filled AS (
  SELECT *, row_number() OVER o AS place,
    (sum(source_size) OVER ()) * CAST(1.5 AS DOUBLE) - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM sources WINDOW o AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source)
), level AS (
  SELECT place, over_, rest FROM filled WHERE over_ * weight / rest <= 2 * source_size ORDER BY place LIMIT 1
), goal AS (
  SELECT f.source, f.source_size, CASE WHEN f.place < l.place THEN CAST(2 * f.source_size AS DOUBLE) ELSE l.over_ * f.weight / l.rest END AS target
  FROM filled f CROSS JOIN level l
), ranked AS (
  SELECT w.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS whole,
    sum(w.size) OVER (PARTITION BY w.source ORDER BY w.hash RANGE UNBOUNDED PRECEDING) AS through,
    sum(w.size) OVER (PARTITION BY w.source, w.hash) AS unit
  FROM words w JOIN goal g ON w.source IS NOT DISTINCT FROM g.source
), taking AS (
  SELECT *, target - whole * source_size AS budget FROM ranked
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN through <= budget THEN 1 WHEN through - unit <= budget AND through - budget < budget - (through - unit) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM taking
"""
