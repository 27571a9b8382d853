"""Entry points and operators that no registered query shows: order, lookups, own rows, deletions, jobs of users."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from airq.functions import aqi, present, units
from airq.operators import ingest, quality, readings as serve, upsert
from airq.plans import jobs
from airq.sources import files

AT = datetime(2024, 1, 1, 12)
READINGS = "id string, user_id string, monitor_id string, aqi_value int, latitude double, longitude double, source string, recorded_at timestamp"


@pytest.fixture(scope="module")
def readings(spark):
    rows = [("a", "u1", "m1", 40, 28.6, 77.2, "user", AT), ("b", "u1", None, 160, 28.61, 77.2, "openaq", AT.replace(hour=13)), ("c", "u2", "m1", 320, 10.0, 10.0, "openaq", AT.replace(hour=11)), ("d", "u2", "m2", 55, None, None, None, AT)]
    return spark.createDataFrame(rows, READINGS)


def ids(df):
    return [r.id for r in df.collect()]


def test_order(readings):
    assert ids(serve.oldest_first(readings)) == ["c", "a", "d", "b"]
    from airq.functions import geo

    assert ids(geo.readings_within_radius(readings, 28.6, 77.2)) == ["b", "a"]


def test_lookups(spark, readings):
    assert sorted(ids(serve.matching(readings, monitor_id="m1"))) == ["a", "c"] and ids(serve.matching(readings, monitor_id="m1", user_id="u2")) == ["c"]
    assert sorted(ids(serve.owned_by(readings, "u1"))) == ["a", "b"]
    profiles = spark.createDataFrame([("p1", "Import")], "id string, display_name string")
    assert serve.lookup_admin_profile(profiles, "Import") == "p1"
    with pytest.raises(LookupError):
        serve.lookup_admin_profile(profiles, "nobody")
    assert serve.reading_count(readings).first().n == 4


def test_own_rows(spark):
    rows = [(1, "me", 500, 1.0, 1.0, "user"), (2, "you", 500, 1.0, 1.0, "user"), (3, None, 501, 1.0, 1.0, "user"), (4, "me", 0, 1.0, None, "openaq")]
    df = quality.validate_entries(spark.createDataFrame(rows, "id int, user_id string, aqi_value int, latitude double, longitude double, source string"), "me")
    assert {r.id: sorted(r.reasons) for r in df.collect()} == {1: [], 2: ["not_own"], 3: ["aqi_range", "not_own"], 4: ["longitude_missing", "source_not_user"]}


def test_deletions(spark, readings):
    measured = spark.createDataFrame([("a", "pm25", 3.0), ("a", "no2", 1.0), ("b", "pm25", 80.0), ("c", "pm10", 9.0)], "reading_id string, pollutant string, value double")
    left, children = quality.cascade_delete(readings, measured, spark.createDataFrame([("a",)], "id string"))
    assert sorted(ids(left)) == ["b", "c", "d"] and sorted(r.reading_id for r in children.collect()) == ["b", "c"]
    left, children = quality.delete_profiles(readings, measured, spark.createDataFrame([("u1",)], "user_id string"))
    assert sorted(ids(left)) == ["c", "d"] and [r.reading_id for r in children.collect()] == ["c"]
    indices = {r.reading_id: r.aqi_value for r in ingest.recompute_composite(measured).collect()}
    one = measured.select("reading_id", aqi.sub_index(F.col("pollutant"), F.col("value")).alias("v")).groupBy("reading_id").agg(F.max("v").alias("v"))
    assert indices == {r.reading_id: r.v for r in one.collect()}


def test_one_pollutant_s_index_is_the_general_one(spark):
    values = spark.range(0, 40_000).select((F.col("id") / 13.0 - 5).alias("v")).union(spark.createDataFrame([(None,), (float("nan"),)], "v double"))
    for scale in ("naqi", "epa"):
        for gaps in ("reference", "bridge"):
            same = [aqi.index_of(p, F.col("v"), scale, gaps).eqNullSafe(aqi.sub_index(F.lit(p), F.col("v"), scale, gaps)) for p in ("pm25", "co")]
            assert values.where(~(same[0] & same[1])).isEmpty()


def test_texts(spark):
    row = spark.createDataFrame([(28.61394, 77.2, AT)], "lat double, lng double, at timestamp")
    got = row.select(
        present.coord_label(F.col("lat"), F.col("lng"), True).alias("station"), present.coord_label(F.col("lat"), F.col("lng"), False).alias("area"), units.reading_key(F.lit("m"), F.col("at")).alias("key"),
        F.date_format(units.canonical_ts(F.lit("2024-01-01T12:00:00+05:30")), "HH:mm").alias("ts"),
    ).first()
    assert tuple(got) == ("Station readings near (28.61, 77.20)", "Area readings around (28.61, 77.20)", "m:2024-01-01T12:00:00Z", "06:30")
    assert [r.aqi for r in present.reference_lines(spark).collect()] == [50, 100, 150, 200]


def test_sql_conversion(spark):
    aqi.register_functions(spark)
    rows = [(p, 3.7, u) for p in ("pm25", "no2", "o3", "co", "x") for u in ("µg/m³", "mg/m³", "ppb", "ppm", "?")] + [("no2", None, "ppb"), ("no2", float("nan"), "ppb")]
    df = spark.createDataFrame(rows, "pollutant string, value double, unit string")
    both = df.select(F.expr("aqi_to_canonical(pollutant, value, unit)").alias("a"), units.convert_to_canonical(F.col("pollutant"), F.col("value"), F.col("unit")).alias("b"))
    assert both.where("not (a <=> b)").isEmpty()


def test_jobs_of_users(spark, readings, tmp_path):
    shown = jobs.dashboard(readings.where("latitude is not null"), ["openaq"])
    assert sorted(ids(shown["markers"])) == ["b", "c"] and ids(shown["recent"]) == ["b", "c"] and shown["count"].first().n == 2 and shown["bounds"].first().south == 10.0
    entries = [("e1", "me", "42", 1.0, 1.0, None, AT), ("e2", "me", "x", 1.0, 1.0, None, AT), ("e3", "you", "7", 1.0, 1.0, None, AT), ("e4", "me", "7", 1.0, 1.0, None, AT.replace(day=9))]
    df = spark.createDataFrame(entries, "id string, user_id string, text string, latitude double, longitude double, source string, recorded_at timestamp")
    root = str(tmp_path)
    inserted, rejected = jobs.submit_readings(df, "me", AT, root)
    assert ids(inserted) == ["e1"] and sorted(ids(rejected)) == ["e2", "e3", "e4"] and ids(files.scan_table(spark, root, "readings")) == ["e1"]
    files.append_user_readings(readings.where("id = 'd'"), root)
    assert {r.id: r.source for r in files.scan_table(spark, root, "readings").collect()} == {"e1": "user", "d": "user"}
    assert {r.id: r.source for r in upsert.backfill_source(readings, "u2").collect()} == {"a": "user", "b": "openaq", "c": "openaq", "d": "openaq"}
    grid = jobs.scale_comparison(spark).collect()
    assert len(grid) == 500 and grid[0].concentration == 0 and grid[-1].concentration == 400 and grid[0].epa == 0


def test_archive_without_the_day(spark, tmp_path):
    assert files.scan_archive(spark, str(tmp_path), AT.date(), [1, 2]).count() == 0


def test_every_path_of_a_measurement(spark):
    """Times and units stand in different places of different pages; the first that is filled holds."""
    from airq.sources.files import MEASUREMENTS

    said = [
        {"value": 1.0, "period": {"datetimeFrom": {"utc": "2024-01-01T01:00:00Z"}}, "datetime": {"utc": "2024-01-01T02:00:00Z"}, "parameter": {"units": "ppb"}, "unit": "ppm"},
        {"value": 2.0, "period": {"datetimeFrom": {"utc": ""}}, "datetime": {"utc": "2024-01-01T02:00:00Z"}, "date": {"utc": "2024-01-01T03:00:00Z"}, "parameter": {"units": ""}, "unit": "ppm"},
        {"value": 3.0, "date": {"utc": "2024-01-01T03:00:00Z"}, "unit": "µg/m³"},
        {"value": 4.0, "datetime": {"utc": "no time"}},
    ]
    pages = spark.read.schema(MEASUREMENTS).json(spark.sparkContext.parallelize([json.dumps({"sensor_id": 1, "results": said})]))
    got = {r.value: (r.units, r.recorded_at.hour if r.recorded_at else None) for r in ingest.flatten_pages(pages).collect()}
    assert got == {1.0: ("ppb", 1), 2.0: ("ppm", 2), 3.0: ("µg/m³", 3), 4.0: ("", None)}


def test_labels_and_dimensions(spark):
    from airq.config import CATEGORIES, DARK, POLLUTANT_LABELS, POLLUTANTS, SCALE_LABELS, SOURCE_LABELS

    codes = spark.createDataFrame([("naqi", "co", "user"), ("none", "none", "none"), (None, None, None)], "scale string, pollutant string, source string")
    got = codes.select(present.display_label(F.col("scale"), SCALE_LABELS), present.display_label(F.col("pollutant"), POLLUTANT_LABELS), present.display_label(F.col("source"), SOURCE_LABELS)).collect()
    assert [tuple(r) for r in got] == [("India NAQI", "Carbon Monoxide (CO)", "User Entries"), (None,) * 3, (None,) * 3]
    assert {r.pollutant: r.unit for r in aqi.dim_units(spark).collect()} == {p: "mg/m³" if p == "co" else "µg/m³" for p in POLLUTANTS}
    rows = aqi.dim_categories(spark).collect()
    assert [(r.label, r.color, r.min, r.max) for r in rows if r.scale == "epa"] == list(CATEGORIES["epa"]) and all(r.dark == (r.label in DARK[r.scale]) for r in rows)
    assert aqi.dim_breakpoints(spark).count() == 72
    # a value's category by joining the dimension is the one by expression
    values = spark.range(0, 1001).select(F.col("id").cast("int").alias("v"))
    joined = values.join(aqi.dim_categories(spark).where("scale = 'naqi'"), F.col("v").between(F.col("min"), F.col("max")))
    assert joined.count() == 1001 and joined.where(F.col("label") != aqi.label(F.col("v"))).isEmpty() and joined.where(F.when(F.col("dark"), "#ffffff").otherwise("#000000") != aqi.text_color(F.col("v"))).isEmpty()


def test_an_archive_s_failure_is_an_error(spark, tmp_path):
    """A station without a folder has no rows; a file that can't be read is no reason to report none."""
    folder = tmp_path / "locationid=1/year=2024/month=01"
    folder.mkdir(parents=True)
    (folder / "location-1-20240101.csv.gz").write_bytes(b"no gzip")
    assert files.scan_archive(spark, str(tmp_path), AT.date(), [2]).count() == 0
    with pytest.raises(Exception, match="(?i)gzip|header"):
        files.scan_archive(spark, str(tmp_path), AT.date(), [1, 2]).collect()
