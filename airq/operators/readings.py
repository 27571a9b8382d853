"""Serving queries over stored readings and measurements."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F


def filter_sources(df: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """None keeps all rows, an empty list none."""
    if sources is None:
        return df
    return df.where(F.col("source").isin(*sources) if sources else F.lit(False))


def newest(df: DataFrame, limit: int = 1000) -> DataFrame:
    """The newest rows; the limit is the feature. Ties go to the smaller id."""
    return df.orderBy(F.desc("recorded_at"), "id").limit(limit)


def oldest_first(df: DataFrame) -> DataFrame:
    return df.orderBy("recorded_at", "id")


def filter_time_range(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Both ends included, oldest first."""
    return oldest_first(df.where(F.col("recorded_at").between(F.lit(start), F.lit(end))))


def filter_day(df: DataFrame, day: datetime, monitors: Sequence | None = None) -> DataFrame:
    """Imported readings of one UTC day, its end excluded."""
    found = df.where((F.col("source") == "openaq") & (F.col("recorded_at") >= F.lit(day)) & (F.col("recorded_at") < F.lit(day + timedelta(days=1))))
    return found if monitors is None else found.where(F.col("monitor_id").isin(*monitors))


def filter_since(df: DataFrame, as_of: datetime, hours: int) -> DataFrame:
    return df.where(F.col("recorded_at") >= F.lit(as_of - timedelta(hours=hours)))


def get_readings(readings: DataFrame, limit: int = 1000, sources: Sequence[str] | None = None, measurements: DataFrame | None = None) -> DataFrame:
    """The newest readings of the sources; with ``measurements`` each has an array of its own, maybe empty."""
    top = newest(filter_sources(readings, sources), limit)
    if measurements is None:
        return top
    children = measurements.join(top.select(F.col("id").alias("reading_id")), "reading_id", "left_semi")
    nested = children.groupBy(F.col("reading_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("pollutant", "value", "unit"))).alias("measurements"))
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<pollutant: STRING, value: DOUBLE, unit: STRING>>)")
    return top.join(nested, "id", "left").withColumn("measurements", F.coalesce("measurements", empty))


def active_monitors(monitors: DataFrame) -> DataFrame:
    return monitors.where("disabled_at is null")


def matching(df: DataFrame, **values) -> DataFrame:
    """Rows by equality: readings by ``monitor_id`` or ``user_id``, measurements by ``pollutant`` or ``reading_id``."""
    for name, value in values.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def owned_by(df: DataFrame, user_id) -> DataFrame:
    return matching(df, user_id=user_id)


def lookup_admin_profile(profiles: DataFrame, display_name: str) -> str:
    found = profiles.where(F.col("display_name") == display_name).select("id").limit(1).collect()
    if not found:
        raise LookupError(f"no profile is named {display_name!r}")
    return found[0][0]


def user_monitors(readings: DataFrame) -> DataFrame:
    return readings.where("monitor_id is not null").select("user_id", "monitor_id").distinct()


def map_bounds(readings: DataFrame) -> DataFrame:
    return readings.agg(F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"))


def reading_count(readings: DataFrame) -> DataFrame:
    return readings.agg(F.count("*").alias("n"))
