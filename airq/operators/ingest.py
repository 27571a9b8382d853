"""From raw observations to readings and measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT_SCALE, POLLUTANTS, TARGET_POLLUTANTS
from ..functions import aqi, units

INSTANT = ["monitor_id", "recorded_at"]


def filter_target_pollutants(df: DataFrame) -> DataFrame:
    return df.where(F.col("pollutant").isin(*TARGET_POLLUTANTS))


def canonical(observations: DataFrame) -> DataFrame:
    """``observations(parameter, value, units, ...)`` with ``pollutant``, ``unit`` and ``canonical_value`` (null if it does not convert)."""
    named = observations.withColumn("pollutant", units.normalize_pollutant(F.col("parameter")))
    return named.withColumn("unit", units.canonical_unit(F.col("pollutant"))).withColumn("canonical_value", units.convert_to_canonical(F.col("pollutant"), F.col("value"), F.col("units")))


def convertible() -> Column:
    """Whether a row has a canonical value that is not negative."""
    return F.coalesce(F.col("canonical_value") >= 0, F.lit(False))


def drop_unconvertible(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What can be used, and what cannot (no canonical value, or a negative one), for quarantine."""
    return df.where(convertible()), df.where(~convertible())


def drop_bad_rows(df: DataFrame) -> DataFrame:
    return df.where("recorded_at is not null and value is not null")


def attach_station(observations: DataFrame, stations: DataFrame, by: str) -> DataFrame:
    """Observations of known stations only, with what ``stations`` says of them; a plain equi-join that adapts to sizes."""
    return observations.join(stations, by, "inner")


def sensors_of(stations: DataFrame) -> DataFrame:
    """A row per sensor of the manifest's stations."""
    return stations.select("*", F.explode("sensors").alias("sensor")).select("*", "sensor.sensor_id").drop("sensors", "sensor")


def collapse_sensors(df: DataFrame) -> DataFrame:
    """The largest value per monitor, instant and pollutant."""
    return df.groupBy(*INSTANT, "pollutant").agg(F.max("canonical_value").alias("value"))


def composite_aqi(values: DataFrame, scale: str = DEFAULT_SCALE, gaps: str = "reference") -> DataFrame:
    """The largest sub-index per monitor and instant of ``values(monitor_id, recorded_at, pollutant, value)``."""
    return values.groupBy(*INSTANT).agg(F.max(aqi.sub_index(F.col("pollutant"), F.col("value"), scale, gaps)).alias("aqi_value"))


def instants(df: DataFrame, scale: str = DEFAULT_SCALE, gaps: str = "reference") -> DataFrame:
    """Both of the above in one shuffle: per monitor and instant a column per pollutant, and the composite; instants without an index are left out."""
    wide = df.groupBy(*INSTANT).agg(*[F.max(F.when(F.col("pollutant") == p, F.col("canonical_value"))).alias(p) for p in POLLUTANTS])
    wide = wide.where(F.greatest(*POLLUTANTS) >= 0)  # plain columns: a condition on the index would work it out twice
    return wide.withColumn("aqi_value", F.greatest(*[aqi.index_of(p, F.col(p), scale, gaps) for p in POLLUTANTS]))


def file_position(df: DataFrame) -> DataFrame:
    """A station's position: that of its earliest usable row."""
    return df.groupBy("monitor_id").agg(F.min_by(F.struct(F.col("lat"), F.col("lon")), F.struct("recorded_at", "lat", "lon")).alias("at")).select("monitor_id", F.col("at.lat").alias("latitude"), F.col("at.lon").alias("longitude"))


def reading_id():
    return F.sha2(F.concat_ws("|", F.col("monitor_id").cast("string"), F.col("source"), F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), 256)


def build_readings(df: DataFrame, user_id: str = "import", scale: str = DEFAULT_SCALE) -> DataFrame:
    rows = instants(df, scale).join(file_position(df), "monitor_id")
    rows = rows.withColumn("source", F.lit("openaq")).withColumn("user_id", F.lit(user_id))
    return rows.select(reading_id().alias("id"), "user_id", "monitor_id", "aqi_value", "latitude", "longitude", "source", "recorded_at")


def build_measurements(df: DataFrame) -> DataFrame:
    """A row per monitor, instant and pollutant, with the canonical unit; its reading is linked later."""
    wide = instants(df)
    pairs = F.array(*[F.struct(F.lit(p).alias("pollutant"), F.col(p).alias("value")) for p in POLLUTANTS])
    tall = wide.select(*INSTANT, F.inline(F.filter(pairs, lambda m: m["value"].isNotNull())))
    return tall.withColumn("unit", units.canonical_unit(F.col("pollutant")))


def union_readings(inserted: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids by monitor and instant of both; an existing one wins."""
    keys = [*INSTANT, "id"]
    both = inserted.select(*keys, F.lit(1).alias("rank")).unionByName(existing.select(*keys, F.lit(0).alias("rank")))
    return both.where("monitor_id is not null").groupBy(*INSTANT).agg(F.min_by("id", F.struct("rank", "id")).alias("id"))


def link_measurements(placeholders: DataFrame, readings: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Measurements with the ``reading_id`` of their monitor and instant, and what to ``keep`` of their columns; those without a reading are dropped."""
    return placeholders.join(readings.select(*INSTANT, F.col("id").alias("reading_id")), INSTANT, "inner").select("reading_id", "pollutant", "value", "unit", *keep)


def recompute_composite(measurements: DataFrame, scale: str = DEFAULT_SCALE, touched: DataFrame | None = None) -> DataFrame:
    """Each reading's composite over its stored measurements; with ``touched(reading_id)`` only of the readings that it names."""
    if touched is not None:
        measurements = measurements.join(touched.select("reading_id").distinct(), "reading_id", "left_semi")
    return measurements.groupBy("reading_id").agg(F.max(aqi.sub_index(F.col("pollutant"), F.col("value"), scale)).alias("aqi_value"))


def dominant_pollutant(values: DataFrame, scale: str = DEFAULT_SCALE) -> DataFrame:
    """The pollutant of the largest sub-index per monitor and instant; of equal ones the first in the usual order."""
    order = F.create_map(*[F.lit(x) for k, p in enumerate(POLLUTANTS) for x in (p, -k)])
    index = aqi.sub_index(F.col("pollutant"), F.col("value"), scale)
    return values.withColumn("index", index).where("index is not null").groupBy(*INSTANT).agg(F.max_by("pollutant", F.struct("index", order[F.col("pollutant")])).alias("dominant"))


def ingest_summary(readings: DataFrame, measurements: DataFrame) -> DataFrame:
    """One row: stations with data, readings, measurements."""
    of = readings.agg(F.count_distinct("monitor_id").alias("stations"), F.count("*").alias("readings"))
    return of.crossJoin(measurements.agg(F.count("*").alias("measurements")))


def flatten_pages(pages: DataFrame) -> DataFrame:
    """API pages ``(sensor_id, results[])`` to observations ``(sensor_id, value, units, recorded_at)``."""
    rows = pages.select("sensor_id", F.explode("results").alias("m"))
    return rows.select("sensor_id", F.col("m.value").alias("value"), units.extract_unit("m").alias("units"), units.parse_ts_lenient(units.extract_timestamp("m")).alias("recorded_at"))
