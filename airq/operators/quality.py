"""Validation: rows with the reasons against them, broken references, repeated keys, deletions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..config import POLLUTANTS, SOURCES
from ..functions.geo import free_name


#: Every reason that a rule of this module gives.
REASONS = (
    "user_id_missing", "aqi_value_missing", "latitude_missing", "longitude_missing", "source_missing", "recorded_at_missing", "reading_id_missing", "pollutant_missing", "value_missing", "unit_missing",
    "aqi_range", "latitude_range", "longitude_range", "source_unknown", "recorded_in_future", "pollutant_unknown", "value_negative", "not_own", "source_not_user",
)


def _reasons(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()]))


def _missing(*names: str) -> dict[str, Column]:
    return {f"{n}_missing": F.col(n).isNull() for n in names}


def validate_readings(readings: DataFrame, as_of: datetime) -> DataFrame:
    """All rows with ``reasons``, an array that is empty for accepted ones."""
    rules = _missing("user_id", "aqi_value", "latitude", "longitude", "source", "recorded_at") | {
        "aqi_range": ~F.col("aqi_value").between(0, 1000),
        "latitude_range": ~F.col("latitude").between(-90, 90),
        "longitude_range": ~F.col("longitude").between(-180, 180),
        "source_unknown": ~F.col("source").isin(*SOURCES),
        "recorded_in_future": F.col("recorded_at") > F.lit(as_of) + F.expr("interval 1 hour"),
    }
    return readings.withColumn("reasons", _reasons(rules))


def validate_measurements(measurements: DataFrame) -> DataFrame:
    rules = _missing("reading_id", "pollutant", "value", "unit") | {"pollutant_unknown": ~F.col("pollutant").isin(*POLLUTANTS), "value_negative": F.col("value") < 0}
    return measurements.withColumn("reasons", _reasons(rules))


def validate_entries(entries: DataFrame, submitter) -> DataFrame:
    """What users submit: a place, an index of 0 to 500, their own id and the source 'user'."""
    rules = _missing("aqi_value", "latitude", "longitude") | {
        "aqi_range": ~F.col("aqi_value").between(0, 500),
        "not_own": F.col("user_id").isNull() | (F.col("user_id") != F.lit(submitter)),
        "source_not_user": F.col("source") != "user",
    }
    return entries.withColumn("reasons", _reasons(rules))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows without reasons, and rejected ones with them."""
    return validated.where("size(reasons) = 0").drop("reasons"), validated.where("size(reasons) > 0")


def split_once(rows: DataFrame, good: Column, path: str, **metrics: Column) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Rows that are ``good`` and those that are not, parted by one write to ``path`` that evaluates them once, and counts.

    The counts are observed while the rows are written: ``rows``, ``accepted``, ``rejected`` and whatever ``metrics`` (aggregates) are asked for.
    """
    side, ok = free_name("accepted", rows), F.coalesce(good, F.lit(False))
    seen = Observation()
    counts = {"rows": F.count("*"), "accepted": F.count_if(F.col(side)), "rejected": F.count_if(~F.col(side))} | metrics
    rows.withColumn(side, ok).observe(seen, *[c.alias(n) for n, c in counts.items()]).write.partitionBy(side).parquet(path)
    schema = StructType([*[StructField(f.name, f.dataType) for f in rows.schema.fields], StructField(side, BooleanType())])
    stored = rows.sparkSession.read.schema(schema).parquet(path)
    return stored.where(F.col(side)).drop(side), stored.where(~F.col(side)).drop(side), dict(seen.get)


def split_validated(validated: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """As ``split``, by one write; the counts also say how many rows each reason rejects."""
    names = [n for n, t in validated.dtypes if n == "reasons" and t == "array<string>"]
    if not names:
        raise ValueError("validate the rows first")
    counts = {f"reason_{n}": F.count_if(F.array_contains("reasons", n)) for n in REASONS}
    accepted, rejected, seen = split_once(validated, F.size("reasons") == 0, path, **counts)
    told = {k: v for k, v in seen.items() if not k.startswith("reason_") or v}
    return accepted.drop("reasons"), rejected, told


def orphans(children: DataFrame, key: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """Children whose key is set and names no parent."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys without nulls that several rows have, with how many."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def cascade_delete(readings: DataFrame, measurements: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of both tables when the readings with an id in ``gone(id)`` are deleted."""
    return readings.join(gone, "id", "left_anti"), measurements.join(gone.withColumnRenamed("id", "reading_id"), "reading_id", "left_anti")


def delete_profiles(readings: DataFrame, measurements: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As above for deleted profiles ``gone(user_id)``: their readings go, and those readings' measurements."""
    return cascade_delete(readings, measurements, readings.join(gone, "user_id", "left_semi").select("id"))


def restrict_delete(monitors: DataFrame, readings: DataFrame) -> DataFrame:
    """Monitors that cannot be deleted, as readings name them."""
    return monitors.join(readings.select(F.col("monitor_id").alias("id")), "id", "left_semi")


def retire_monitors(monitors: DataFrame, ids: DataFrame, as_of: datetime) -> DataFrame:
    """Monitors with those of ``ids(id)`` disabled, unless they were before."""
    mark = free_name("gone", monitors)
    marked = monitors.join(ids.select("id").distinct().withColumn(mark, F.lit(True)), "id", "left")
    return marked.withColumn("disabled_at", F.when(F.col(mark), F.coalesce("disabled_at", F.lit(as_of))).otherwise(F.col("disabled_at"))).drop(mark)
