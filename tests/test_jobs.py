"""Landed files to tables: archive and pages, batch and stream, once and again."""

import gzip
import itertools
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from airq.functions import geo
from airq.operators import quality, upsert
from airq.plans import jobs
from airq.queries import QUERIES
from airq.sources import files, store, tables

AS_OF = datetime(2024, 3, 2)
READING = "id string, user_id string, monitor_id string, aqi_value int, latitude double, longitude double, source string, recorded_at timestamp"


@pytest.fixture
def place(spark, tmp_path):
    root = str(tmp_path)
    tables.create(spark, root)
    page = {"results": [{"id": 7, "name": "A", "coordinates": {"latitude": 28.6, "longitude": 77.2}, "sensors": [{"id": 70, "parameter": {"name": "PM2.5"}}, {"id": 71, "parameter": {"name": "o3"}}, {"id": 72, "parameter": {"name": "no2"}}]},
                        {"id": 8, "name": "Far", "coordinates": {"latitude": 0.0, "longitude": 0.0}, "sensors": [{"id": 80, "parameter": {"name": "pm25"}}]}]}
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/1.json").write_text(json.dumps(page))
    monitors = spark.createDataFrame([], "id string, serial_number string, manufacturer string, model string, notes string, created_at timestamp, disabled_at timestamp")
    per_city = jobs.build_station_dimension(spark, f"{root}/pages", monitors, f"{root}/monitors", f"{root}/manifest", AS_OF)
    assert per_city.collect() == [("Delhi NCR", 1)]
    return tmp_path


def test_daily_backfill_twice(spark, place):
    folder = place / "records/locationid=7/year=2024/month=03"
    folder.mkdir(parents=True)
    rows = ["location_id,sensors_id,location,datetime,lat,lon,parameter,units,value", "7,1,A,2024-03-01T05:30:00+05:30,28.6,77.2,pm25,µg/m³,45", "7,2,A,2024-03-01T00:00:00Z,28.6,77.2,pm2.5,µg/m³,75",
            "7,3,A,2024-03-01T00:00:00Z,28.6,77.2,no2,ppb,10", "7,3,A,bad,28.6,77.2,no2,ppb,10", "7,3,A,2024-03-01T01:00:00Z,28.6,77.2,pm10,stones,10", "7,3,A,2024-03-01T01:00:00Z,28.6,77.2,pm10,µg/m³,-10"]
    for day in ("20240301", "20240302"):
        with gzip.open(folder / f"location-7-{day}.csv.gz", "wt") as f:
            f.write("\n".join(rows))
    run = lambda **k: jobs.daily_backfill(spark, str(place / "records"), str(place / "manifest"), str(place), date(2024, 3, 1), **k).collect()
    assert run(dry_run=True) == [(1, 1, 2, 5, 2)]
    assert run() == [(1, 1, 2, 5, 2)]
    assert run() == [(0, 0, 0, 5, 2)]
    with store.cleaned(spark):
        left = store.scratch(spark)
        store.write_text(spark, f"{left}/x", "")
        assert store.exists(spark, left)
    assert not store.exists(spark, left)
    assert spark.read.parquet(f"{place}/readings").select("aqi_value").collect() == [(151,)]


def test_rows_without_monitor_never_conflict(spark):
    rows = [("a", "u", None, 1, 0.0, 0.0, "user", AS_OF), ("b", "u", None, 1, 0.0, 0.0, "user", AS_OF), ("c", "u", "m", 1, 0.0, 0.0, "user", AS_OF), ("d", "u", "m", 1, 0.0, 0.0, "user", AS_OF)]
    df = spark.createDataFrame(rows, READING)
    assert sorted(r.id for r in upsert.new_readings_only(df, df.where("id = 'a'")).collect()) == ["a", "b", "c"]
    assert sorted(r.id for r in upsert.new_readings_only(df, df).collect()) == ["a", "b"]


def test_missing_manifest(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_manifest(spark, str(tmp_path / "none")).collect()


def test_deletions(spark):
    monitors = spark.createDataFrame([("m", None), ("n", AS_OF)], "id string, disabled_at timestamp")
    ids = spark.createDataFrame([("m",), ("m",), ("n",)], "id string")
    assert quality.retire_monitors(monitors, ids, datetime(2025, 1, 1)).where("id = 'n'").first().disabled_at == AS_OF


def test_radius_join_equals_radius(spark):
    rows = [(k, 28.6 + (k % 20 - 10) * 0.01, 77.2 + (k // 20 - 10) * 0.01) for k in range(400)] + [(900, 0.0, 179.99), (901, 0.0, -179.99)]
    readings = spark.createDataFrame(rows, "id int, latitude double, longitude double").withColumn("recorded_at", F.lit(AS_OF))
    points = spark.createDataFrame([(0, 28.6, 77.2), (1, 0.0, 179.99)], "point_id int, lat double, lng double")
    joined = geo.radius_join(points, readings, 5000.0)
    for point, lat, lng in ((0, 28.6, 77.2), (1, 0.0, 179.99)):
        assert sorted(r.id for r in joined.where(F.col("point_id") == point).collect()) == sorted(r.id for r in geo.readings_within_radius(readings, lat, lng).collect())


def test_radius_join_deals_readings_the_same_way_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(geo, "POINTS_AT_ONCE", 2)  # a place's points in several arrays
    readings = spark.range(300).select("id", (F.lit(28.6) + F.col("id") % 3 * 0.02).alias("latitude"), F.lit(77.2).alias("longitude"))
    points = spark.range(200).select(F.col("id").alias("point_id"), (F.lit(28.6) + F.col("id") % 5 * 0.03).alias("lat"), F.lit(77.2).alias("lng"))
    joined = geo.radius_join(points, readings, 5000.0)
    plain = points.crossJoin(readings).withColumn("distance", geo.distance(F.col("lat"), F.col("lng"), F.col("latitude"), F.col("longitude"))).where("distance <= 5000")
    assert sorted(map(tuple, joined.select("point_id", "id", "distance").collect())) == sorted(map(tuple, plain.select("point_id", "id", "distance").collect()))
    steps = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [knownfloatingpointnormalized(normalizenanandzero(latitude" in steps and "inline(held" in steps  # few points aren't broadcast, and stay together until then


def test_readings_of_a_place_are_held_in_arrays(spark):
    readings = spark.range(4000).select("id", F.when(F.col("id") < 3990, F.lit(28.6) + F.col("id") % 2 * 0.02).alias("latitude"), F.lit(77.2).alias("longitude"))
    held = geo.held_by_place(readings, 1, "held")
    rows = held.collect()
    assert sorted((x.id, r.latitude) for r in rows for x in r.held) == sorted((r.id, r.latitude) for r in readings.collect())
    assert max(len(r.held) for r in rows) == geo.READINGS_AT_ONCE  # of one place each
    assert held._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_a_station_stands_for_a_run_of_readings(spark):
    """Pairs that a file holds in little: their number is the readings' by the stations', their order is by station within an array of readings."""
    pairs = []
    for name in ("radius_function", "radius_join"):
        found = QUERIES[name](spark, "/root/testdata/sf0.01").select("point_id", "id", F.spark_partition_id().alias("part")).collect()
        assert sum((a.point_id, a.part) != (b.point_id, b.part) for a, b in itertools.pairwise(found)) < len(found) / 20
        pairs.append(sorted((r.point_id, r.id) for r in found))
    assert pairs[0] == pairs[1]


def test_radius_join_keeps_columns_of_one_name(spark):
    readings = spark.createDataFrame([(1, 28.6, 77.2, "r")], "id int, latitude double, longitude double, name string")
    points = spark.createDataFrame([(7, 28.6, 77.2, "p")], "point_id int, lat double, lng double, name string")
    joined = geo.radius_join(points, readings, 5000.0)
    assert joined.columns == ["id", "latitude", "longitude", "name", "point_id", "name", "distance"]
    assert [tuple(r) for r in joined.collect()] == [(1, 28.6, 77.2, "r", 7, "p", 0.0)]
