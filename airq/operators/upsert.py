"""Idempotent loads: what is new, what is updated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geo import free_name

KEY = ["monitor_id", "source", "recorded_at"]


def new_readings_only(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming readings without their key among the existing; readings without a monitor never conflict.

    Of incoming rows of one key the one of the smallest id stays. A third of all rows without a monitor are not
    grouped by that: they pass beside the deduplication.
    """
    keyed = incoming.where("monitor_id is not null and source is not null and recorded_at is not null")
    place = free_name("place", incoming)
    first = keyed.withColumn(place, F.row_number().over(Window.partitionBy(*KEY).orderBy("id"))).where(F.col(place) == 1).drop(place)
    new = first.join(existing.select(*KEY).where("monitor_id is not null"), KEY, "left_anti")
    return new.select(*incoming.columns).unionByName(incoming.where("monitor_id is null or source is null or recorded_at is null"))


def new_measurements_only(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming measurements without their reading and pollutant among the existing; of incoming ones of one key the largest."""
    keys = ["reading_id", "pollutant"]
    others = ["value", "unit", *[c for c in incoming.columns if c not in (*keys, "value", "unit")]]
    one = incoming.groupBy(*keys).agg(F.max(F.struct(*others)).alias("m")).select(*keys, *[f"m.{c}" for c in others])
    return one.join(existing.select(*keys), keys, "left_anti")


def upsert_monitors(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """All monitors after the load: matched ones take the payload and keep what only the table knows."""
    kept = [c for c in existing.columns if c not in incoming.columns]
    mark = free_name("new", incoming, existing)
    new = incoming.withColumn(mark, F.lit(True))
    both = existing.alias("e").join(new.alias("n"), F.col("e.id") == F.col("n.id"), "full_outer")
    out = [F.coalesce("n.id", "e.id").alias("id")]
    out += [F.when(F.col(f"n.{mark}"), F.col(f"n.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in incoming.columns if c != "id"]
    return both.select(*out, *[F.col(f"e.{c}") for c in kept])


def backfill_source(readings: DataFrame, import_user) -> DataFrame:
    return readings.withColumn("source", F.when(F.col("user_id") == F.lit(import_user), "openaq").otherwise(F.col("source")))
