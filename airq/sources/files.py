"""Scans of landed files, each with an explicit schema, and the tables' sinks."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ingest
from ..operators.upsert import new_measurements_only, new_readings_only, upsert_monitors
from . import store, tables

ARCHIVE = "location_id bigint, sensors_id bigint, location string, datetime string, lat double, lon double, parameter string, units string, value double"
MEASUREMENTS = (
    "sensor_id bigint, results array<struct<value: double, unit: string, parameter: struct<units: string>, period: struct<datetimeFrom: struct<utc: string>>, "
    "datetime: struct<utc: string>, date: struct<utc: string>>>"
)
LOCATIONS = "results array<struct<id: bigint, name: string, coordinates: struct<latitude: double, longitude: double>, sensors: array<struct<id: bigint, parameter: struct<name: string>>>>>"
MANIFEST = (
    "generated_at timestamp, source string, pollutants array<string>, location_id bigint, name string, latitude double, longitude double, city string, "
    "sensors array<struct<sensor_id: bigint, parameter: string>>, monitor_id string"
)


def scan_archive(spark: SparkSession, base: str, day: date, location_ids: list[int] | None = None) -> DataFrame:
    """Station-day files under ``locationid=/year=/month=``; file names are pruned to the day, and with ``location_ids`` only those stations' folders of the month are listed.

    A station without a folder of the month has no rows; a failure to read is an error.
    """
    schema = f"{ARCHIVE}, locationid bigint, year int, month int"
    reader = spark.read.schema(schema).option("header", True).option("pathGlobFilter", f"*-{day:%Y%m%d}.csv.gz").option("basePath", base)
    month = f"year={day.year}/month={day.month:02d}"
    if location_ids is None:
        return reader.csv(base).where((F.col("year") == day.year) & (F.col("month") == day.month))
    wanted = {str(k) for k in location_ids}
    there = [p for p in store.folders(spark, f"{base}/locationid=*/{month}") if p.rsplit("locationid=", 1)[1].split("/")[0] in wanted]
    return reader.csv(there) if there else spark.createDataFrame([], schema)


def scan_api_measurements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEASUREMENTS).option("multiLine", False).json(path)


def scan_locations(spark: SparkSession, path: str) -> DataFrame:
    """All pages of a folder."""
    return spark.read.schema(LOCATIONS).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The current station manifest; ``FileNotFoundError`` if none was published yet."""
    try:
        return store.current(spark, path, MANIFEST)
    except FileNotFoundError as e:
        raise FileNotFoundError(f"no station manifest at {path}; build the station dimension first") from e


def write_manifest(stations: DataFrame, path: str, as_of: datetime, pollutants: list[str]) -> None:
    head = {"generated_at": F.lit(as_of).cast("timestamp"), "source": F.lit("openaq"), "pollutants": F.lit(sorted(pollutants))}
    store.publish(stations.withColumns(head), path)


def scan_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of ``readings`` and ``measurements``, by day; ``monitors`` and other published tables in their current version."""
    return tables.scan(spark, root, name) if name in tables.SCHEMAS else store.current(spark, f"{root}/{name}")


def upsert_readings(new: DataFrame, root: str) -> DataFrame:
    """Store readings whose key is new; returns the inserted ones only. Only the days that they touch are read and written."""
    return upsert(new, None, root)[0]


def upsert_measurements(new: DataFrame, root: str) -> DataFrame:
    """Store measurements ``(reading_id, pollutant, value, unit, day)`` whose reading has none of their pollutant; returns the inserted ones only."""
    return upsert(None, new, root)[1]


def upsert(readings: DataFrame | None, measurements: DataFrame | None, root: str, days: list[date | None] | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Both of the above as one change under one lock: a crash leaves both or neither.

    Measurements without a ``reading_id`` but with ``monitor_id`` and ``recorded_at`` belong to the stored or inserted reading of
    that monitor and instant; those without a reading are dropped. ``days`` may name all days of the rows, where they are
    known for less than it takes to work out the rows.
    """
    spark = (readings if readings is not None else measurements).sparkSession
    inserted = added = None
    with store.locked(spark, root):
        tables.create(spark, root)
        tables.recover(spark, root)
        if readings is not None:
            readings = tables.laid_out(readings, "readings")
            stored = tables.on_days(tables.scan(spark, root, "readings"), days or tables.days_of(readings))
            inserted = store.settled(new_readings_only(readings, stored))
        if measurements is not None and "reading_id" not in measurements.columns:
            measurements = measurements.withColumn("day", F.to_date("recorded_at"))
            stored = tables.on_days(tables.scan(spark, root, "readings"), days or tables.days_of(measurements)).where("source = 'openaq'")
            known = stored.select(*ingest.INSTANT, "id")
            known = known if inserted is None else ingest.union_readings(inserted, known)
            measurements = ingest.link_measurements(measurements, known, ["day"])
        if measurements is not None:
            measurements = store.settled(tables.laid_out(measurements, "measurements"))  # joined once; asked for its days, then for its keys
            old = tables.on_days(tables.scan(spark, root, "measurements"), days or tables.days_of(measurements))
            added = store.settled(new_measurements_only(measurements, old))
        tables.put(spark, root, inserted, added)
    return inserted, added


def write_monitors(new: DataFrame, existing: DataFrame, path: str) -> DataFrame:
    """Insert or update, and publish the result as the table's next version; ``existing`` may be its current one."""
    return store.publish(upsert_monitors(new, existing), path)


def append_user_readings(rows: DataFrame, root: str) -> DataFrame:
    """Store what users submit, which has no key; gives back those rows, however often the caller reads them."""
    held = store.settled(rows.withColumn("source", F.coalesce("source", F.lit("user"))))
    tables.append_readings(held, root)
    return held
