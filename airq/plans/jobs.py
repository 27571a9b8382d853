"""The jobs that users start: station dimension, daily backfill, recent ingest, dashboard, timeline, submissions, comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import TARGET_POLLUTANTS
from ..functions import aqi, geo, present, units
from ..operators import ingest, quality, readings as serve, stations as dims
from ..sources import files, store, tables


def build_station_dimension(spark: SparkSession, pages_path: str, monitors: DataFrame, monitors_out: str, manifest_out: str, as_of: datetime) -> DataFrame:
    """Locations of the target cities to monitors and the manifest; returns the stations per city."""
    stations = dims.filter_to_target(dims.flatten_locations(files.scan_locations(spark, pages_path)))
    synced = dims.sync_monitors(stations, monitors)
    files.write_monitors(synced.drop("location_id"), monitors, monitors_out)
    with_ids = stations.join(synced.select("location_id", F.col("id").alias("monitor_id")), "location_id")
    files.write_manifest(with_ids.select("location_id", "name", "latitude", "longitude", "city", "sensors", "monitor_id"), manifest_out, as_of, list(TARGET_POLLUTANTS))
    return dims.stations_per_city(stations)


def candidates(observations: DataFrame) -> DataFrame:
    """Target pollutants with a time and a value, in canonical units where they convert."""
    return ingest.filter_target_pollutants(ingest.canonical(ingest.drop_bad_rows(observations)))


def usable(observations: DataFrame) -> DataFrame:
    """Those of them that convert to a value that is not negative."""
    return ingest.drop_unconvertible(candidates(observations))[0]


def load(observations: DataFrame, root: str, user_id: str, dry_run: bool = False) -> DataFrame:
    """Target observations in canonical units ``(monitor_id, recorded_at, pollutant, canonical_value, lat, lon)`` into the tables under ``root``; one row of counts.

    One write evaluates the observations, parts what cannot be used from the rest and counts both; readings and measurements
    are then one change of both tables. What was written aside is deleted at the end.
    """
    spark = observations.sparkSession
    columns = observations.select("monitor_id", "recorded_at", "pollutant", "canonical_value", "lat", "lon")
    with store.cleaned(spark):
        good, _, seen = quality.split_once(columns, ingest.convertible(), store.scratch(spark))
        new_readings, new_measurements = ingest.build_readings(good, user_id), ingest.build_measurements(good)
        if not dry_run:
            days = tables.days_of(good.select(F.to_date("recorded_at").alias("day")))
            new_readings, new_measurements = files.upsert(new_readings, new_measurements, root, days)
        counts = ingest.ingest_summary(new_readings, new_measurements).first()
    return spark.createDataFrame([(*counts, seen["rows"], seen["rejected"])], "stations long, readings long, measurements long, observations long, rejected long")


def daily_backfill(spark: SparkSession, archive: str, manifest: str, root: str, day: date, user_id: str = "import", dry_run: bool = False) -> DataFrame:
    stations = files.read_manifest(spark, manifest).select(F.col("location_id").alias("locationid"), "monitor_id")
    known = [r[0] for r in stations.select("locationid").distinct().collect()]  # a row a station of the manifest
    rows = files.scan_archive(spark, archive, day, known).withColumn("recorded_at", units.parse_ts_lenient(F.col("datetime")))
    return load(candidates(ingest.attach_station(rows, stations, "locationid")), root, user_id, dry_run)


def recent_observations(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Landed API pages with their stations' monitor, place and pollutant."""
    sensors = manifest.select("monitor_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.explode("sensors").alias("s"))
    sensors = sensors.select("monitor_id", "lat", "lon", "s.sensor_id", "s.parameter")
    return ingest.attach_station(ingest.flatten_pages(pages), sensors, "sensor_id")


def ingest_recent(spark: SparkSession, landing: str, manifest: str, root: str, as_of: datetime, hours: int = 8, user_id: str = "import") -> DataFrame:
    rows = recent_observations(files.scan_api_measurements(spark, landing), files.read_manifest(spark, manifest))
    return load(candidates(serve.filter_since(rows, as_of, hours)), root, user_id)


def dashboard(readings: DataFrame, sources: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The newest thousand readings as markers, the ten newest as badges, the bounds and the count of what is shown."""
    return _shown(serve.get_readings(readings, 1000, sources))


def stored_dashboard(spark: SparkSession, root: str, sources: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """As above over the stored tables: only the newest days are read, and once for all parts."""
    return _shown(store.settled(tables.newest(spark, root, 1000, sources)))


def _shown(shown: DataFrame) -> dict[str, DataFrame]:
    return {"markers": present.markers(shown), "recent": present.badges(serve.newest(shown, 10)), "bounds": serve.map_bounds(shown), "count": serve.reading_count(shown)}


def timeline(readings: DataFrame, lat: float, lng: float, is_station: bool, sources: Sequence[str] | None = None) -> DataFrame:
    """The series around a point: 5 km for a station, 10 km for an area. Laid-out readings are read by the ranges of their places."""
    within = tables.within_radius if "place" in readings.columns else geo.readings_within_radius
    near = within(readings, lat, lng, 5000.0 if is_station else 10000.0)
    return present.series(serve.filter_sources(near, sources))


def submit_readings(entries: DataFrame, submitter: str, as_of: datetime, root: str) -> tuple[DataFrame, DataFrame]:
    """What a user typed ``(id, user_id, text, latitude, longitude, source, recorded_at)``: inserted rows, and rejected ones with all reasons against them.

    Both kinds of rules are applied in one pass over the entries.
    """
    spark = entries.sparkSession
    typed = entries.withColumn("aqi_value", present.parse_user_aqi(F.col("text"))).withColumn("source", F.coalesce("source", F.lit("user"))).drop("text")
    own = quality.validate_entries(typed, submitter).withColumnRenamed("reasons", "entry_reasons")
    both = quality.validate_readings(own, as_of).withColumn("reasons", F.array_distinct(F.concat("entry_reasons", "reasons"))).drop("entry_reasons")
    accepted, rejected, _ = quality.split_validated(both, store.scratch(spark))
    return files.append_user_readings(accepted, root), rejected


def scale_comparison(spark: SparkSession, low: float = 0.0, high: float = 400.0, points: int = 500) -> DataFrame:
    """Fine-particle concentrations from ``low`` to ``high``, ends included, on both older scales."""
    at = F.lit(float(low)) + F.col("id") * F.lit(float(high - low)) / F.lit(float(points - 1))
    grid = spark.range(points).select("id", at.alias("concentration"))
    return grid.select("id", "concentration", aqi.strict_sub_index(F.col("concentration"), "epa").alias("epa"), aqi.strict_sub_index(F.col("concentration"), "naqi").alias("naqi"))


def rescore(values: DataFrame) -> DataFrame:
    """Composites per monitor and instant on both scales, side by side."""
    indices = [F.max(aqi.sub_index(F.col("pollutant"), F.col("value"), s)).alias(s) for s in ("naqi", "epa")]
    return values.groupBy(*ingest.INSTANT).agg(*indices)
