"""Stored tables: loads that crash, repeat and meet, what reads and deletions touch, versions, buckets, SQL."""

import math
import random
import shutil
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airq.functions import geo, places
from airq.operators import ingest, quality, readings as serve, upsert
from airq.plans import jobs
from airq.sources import files, store, tables

AT = datetime(2024, 5, 1)
READING = "id string, user_id string, monitor_id string, aqi_value int, latitude double, longitude double, source string, recorded_at timestamp"
OBSERVED = "monitor_id string, recorded_at timestamp, pollutant string, value double, unit string"


def scanned(df):
    """What the only scan of a plan read: files and rows that its filters could not skip."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    while plan.children().size():
        plan = plan.children().head()
    metrics = plan.metrics()
    return metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()


def rows_of(df):
    return sorted(map(str, df.collect()))


def reading(k, monitor, day, hour=0, source="openaq", aqi=50):
    return (f"r{k}", f"u{k % 5}", monitor, aqi, 28.0 + k % 7 * 0.1, 77.0 + k % 11 * 0.1, source, AT + timedelta(days=day, hours=hour))


@pytest.fixture
def stored(spark, tmp_path):
    """Ten days of twenty readings, three measurements each."""
    root = str(tmp_path)
    rows = [reading(20 * d + k, f"m{k}", d, k % 24) for d in range(10) for k in range(20)]
    measured = [(r[0], p, float(v), "µg/m³", r[7].date()) for r in rows for v, p in enumerate(("pm25", "pm10", "no2"))]
    files.upsert(spark.createDataFrame(rows, READING), spark.createDataFrame(measured, tables.MEASUREMENTS), root)
    return root


def test_upserts_read_and_write_only_touched_days(spark, stored):
    files_before = {p for p in store.folders(spark, f"{stored}/*/day=*/part-*")}
    new = [reading(900, "m1", 3, 1), reading(901, "m77", 3, 1), reading(902, None, 4, 1, "user")]
    inserted, _ = files.upsert(spark.createDataFrame(new, READING), None, stored)
    assert sorted(r.id for r in inserted.collect()) == ["r901", "r902"]  # m1 has that instant already
    after = {p for p in store.folders(spark, f"{stored}/*/day=*/part-*")}
    gone = {p.split("day=")[1][:10] for p in files_before - after if "/readings/" in p}
    assert gone == {"2024-05-04", "2024-05-05"} and all("/readings/" in p for p in files_before ^ after)
    plan = tables.on_days(files.scan_table(spark, stored, "readings"), [AT.date()])
    assert "PartitionFilters: [isnotnull(day" in plan._jdf.queryExecution().toString() and scanned(plan)[1] == 20
    assert files.scan_table(spark, stored, "readings").count() == 202


def test_measurements_are_unique_and_find_their_readings(spark, stored):
    again = spark.createDataFrame([("r0", "pm25", 99.0, "µg/m³", AT.date()), ("r0", "co", 1.0, "mg/m³", AT.date()), ("r0", "co", 2.0, "mg/m³", AT.date())], tables.MEASUREMENTS)
    assert [tuple(r)[:3] for r in files.upsert_measurements(again, stored).collect()] == [("r0", "co", 2.0)]
    placed = spark.createDataFrame([("m3", AT + timedelta(hours=3), "co", 7.0, "mg/m³"), ("m3", AT + timedelta(hours=4), "co", 7.0, "mg/m³")], OBSERVED)
    assert [tuple(r)[:3] for r in files.upsert(None, placed, stored)[1].collect()] == [("r3", "co", 7.0)]
    assert quality.duplicate_keys(files.scan_table(spark, stored, "measurements"), ["reading_id", "pollutant"]).isEmpty()


def load(spark, root, seed, days=3):
    rng = random.Random(seed)
    rows = [reading(1000 * seed + k, f"m{rng.randrange(30)}", rng.randrange(days), rng.randrange(4), aqi=rng.randrange(400)) for k in range(40)]
    placed = [(r[2], r[7], p, float(rng.randrange(300)), "µg/m³") for r in rows for p in ("pm25", "no2") if rng.random() < 0.7]
    return files.upsert(spark.createDataFrame(rows, READING), spark.createDataFrame(placed, OBSERVED), root)


@pytest.fixture(scope="module")
def two_loads(spark, tmp_path_factory):
    """The tables after a first load, and after a second one that nothing disturbed."""
    path = tmp_path_factory.mktemp("loads")
    first, whole = str(path / "first"), str(path / "whole")
    load(spark, first, 1)
    shutil.copytree(first, whole)
    load(spark, whole, 2)
    return first, {name: rows_of(files.scan_table(spark, whole, name)) for name in tables.SCHEMAS}


@pytest.mark.parametrize("at", ["before the marker", "after the marker", "between the tables"])
def test_a_crash_and_a_rerun(spark, tmp_path, monkeypatch, two_loads, at):
    first, whole = two_loads
    broken = str(tmp_path / "broken")
    shutil.copytree(first, broken)
    before = rows_of(files.scan_table(spark, broken, "readings"))

    def die(*_, **__):
        raise RuntimeError("lost")

    real = tables.write
    if at == "before the marker":
        monkeypatch.setattr(store, "write_text", die)
    elif at == "after the marker":
        monkeypatch.setattr(tables, "_carry_out", die)
    else:  # the first table is written, the second is not
        monkeypatch.setattr(tables, "write", lambda rows, name, path, *a, **o: die() if path == f"{broken}/measurements" else real(rows, name, path, *a, **o))
    with pytest.raises(RuntimeError, match="lost"):
        load(spark, broken, 2)
    monkeypatch.undo()
    if at != "between the tables":
        assert rows_of(files.scan_table(spark, broken, "readings")) == before
    with store.locked(spark, broken):  # the lock was given back
        assert tables.recover(spark, broken) == int(at != "before the marker")
    inserted, added = load(spark, broken, 2)
    assert (inserted.isEmpty() and added.isEmpty()) == (at != "before the marker")
    assert {name: rows_of(files.scan_table(spark, broken, name)) for name in tables.SCHEMAS} == whole
    assert store.folders(spark, f"{broken}/_changes/*") == []


def test_loads_at_once_keep_keys_unique(spark, tmp_path):
    root, failed = str(tmp_path), []

    def run(seed):
        try:
            load(spark, root, seed)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(seed,)) for seed in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    readings, measurements = (files.scan_table(spark, root, n) for n in ("readings", "measurements"))
    assert quality.duplicate_keys(readings, upsert.KEY).isEmpty() and quality.duplicate_keys(measurements, ["reading_id", "pollutant"]).isEmpty()
    assert quality.orphans(measurements, "reading_id", readings).isEmpty()
    expected = {(r.monitor_id, r.recorded_at) for seed in (1, 2, 3) for r in _made(spark, seed).collect()}
    assert {(r.monitor_id, r.recorded_at) for r in readings.collect()} == expected


def _made(spark, seed):
    rng = random.Random(seed)
    return spark.createDataFrame([reading(1000 * seed + k, f"m{rng.randrange(30)}", rng.randrange(3), rng.randrange(4), aqi=rng.randrange(400)) for k in range(40)], READING)


def test_locks(spark, tmp_path):
    root, held = str(tmp_path), []

    def use():
        for _ in range(10):
            with store.locked(spark, root, wait=60):
                held.append(1)
                assert len(held) == 1
                time.sleep(0.002)
                held.pop()

    with ThreadPoolExecutor(6) as pool:
        for done in [pool.submit(use) for _ in range(6)]:
            done.result()
    with store.locked(spark, root):
        with pytest.raises(TimeoutError), store.locked(spark, root, wait=0.3):
            pass
        with store.locked(spark, root, wait=5, stale=-10):  # too old: its owner is taken for dead
            pass


# Places


def test_codes_keep_every_point_of_a_circle(spark):
    rng = random.Random(4)
    centres = [(28.6, 77.2, 5000.0), (0.0, 179.99, 8000.0), (-33.0, -180.0, 3000.0), (88.99, 10.0, 50_000.0), (-90.0, 0.0, 9000.0), (10.0, 190.0, 2000.0), (0.0, 0.0, 100.0), (45.0, 7.0, 25_000_000.0)]
    rows = []
    for n, (lat, lng, radius) in enumerate(centres):
        reach = min(radius / 111_000 * 1.1, 89)
        rows += [(n, min(90.0, max(-90.0, lat + rng.uniform(-reach, reach))), lng + rng.uniform(-1, 1) * min(180, reach / max(0.02, abs(math.cos(math.radians(lat)))))) for _ in range(600)]
    df = places.with_place(spark.createDataFrame(rows, "n int, latitude double, longitude double"), "latitude", "longitude").cache()
    for n, (lat, lng, radius) in enumerate(centres):
        ranges = places.circle_ranges(lat, lng, radius)
        assert 1 <= len(ranges) <= places.RANGES and all(a <= b for a, b in ranges)
        here = df.where(F.col("n") == n).withColumn("far", geo.distance(F.lit(lat), F.lit(lng), F.col("latitude"), F.col("longitude")))
        assert here.where((F.col("far") <= radius) & ~places.within(F.col("place"), ranges)).isEmpty()
    assert places.with_place(spark.createDataFrame([(None, 1.0), (1.0, None)], "y double, x double"), "y", "x", "code").where("code is not null").isEmpty()
    box = places.box_ranges(28.0, 77.0, 28.2, 77.3)
    cells = sum(b - a + 1 for a, b in box)
    assert cells < 3 * (0.2 / 180 * 2**20) * (0.3 / 360 * 2**20)  # not much more than the box itself


def test_circles_skip_row_groups(spark, tmp_path):
    path = f"{tmp_path}/readings"
    grid = spark.range(160_000).select(
        F.col("id").cast("string").alias("id"), F.lit("u").alias("user_id"), F.concat(F.lit("m"), (F.col("id") % 1000).cast("string")).alias("monitor_id"), F.lit(1).alias("aqi_value"),
        (F.lit(20.0) + (F.col("id") * 7919 % 400) * 0.025).alias("latitude"), (F.lit(70.0) + (F.col("id") * 104_729 / 400 % 400).cast("int") * 0.025).alias("longitude"),
        F.lit("openaq").alias("source"), F.lit(AT).alias("recorded_at"),
    )
    tables.write(tables.laid_out(grid, "readings"), "readings", path, **{"parquet.block.size": str(64 << 10), "parquet.page.size": str(16 << 10)})
    table = tables.scan(spark, str(tmp_path), "readings")
    assert "PushedFilters: [IsNotNull(place), Or(" in tables.in_circle(table, 25.0, 75.0, 5000.0)._jdf.queryExecution().toString().replace("PushedFilters: [Or(", "PushedFilters: [IsNotNull(place), Or(")
    read = scanned(tables.in_circle(table, 25.0, 75.0, 5000.0))[1]
    plain = scanned(table.where(geo.within_box(F.col("latitude"), F.col("longitude"), (25.0, 75.0), 5000.0)))[1]
    assert read < 160_000 / 10 and read < plain / 3  # latitude alone prunes little
    for at in ((25.0, 75.0), (20.0, 70.0)):
        assert rows_of(tables.within_radius(table, *at)) == rows_of(geo.readings_within_radius(table, *at))
    points = spark.createDataFrame([(1, 25.0, 75.0), (2, 22.0, 71.0), (3, None, 1.0)], "point_id int, lat double, lng double")
    assert rows_of(tables.radius_join(points, table, 4000.0)) == rows_of(geo.radius_join(points, table, 4000.0))


# Lookups


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("id"), F.concat(F.lit("u"), (F.col("id") / 100).cast("int").cast("string")).alias("user_id"), F.lit("m").alias("monitor_id"), F.lit(1).alias("aqi_value"),
        (F.col("id") % 180 - 90.0).alias("latitude"), F.lit(5.0).alias("longitude"), F.lit("openaq").alias("source"), F.lit(AT).alias("recorded_at"),
    )
    small = {"parquet.block.size": str(256 << 10)}
    tables.write(tables.laid_out(rows, "readings"), "readings", f"{tmp_path}/readings", **small)
    table = tables.scan(spark, str(tmp_path), "readings")
    wanted = rows.where("latitude = 17").first()
    found = serve.matching(table, id=wanted.id)
    assert scanned(found)[1] < 60_000 / 3 and [r.id for r in found.collect()] == [wanted.id]
    assert scanned(serve.matching(table, id="no such id"))[1] < 60_000 / 3


def test_buckets_join_without_a_shuffle(spark):
    rng = random.Random(8)
    rows = [reading(k, f"m{k % 9}", k // 9 % 4, k % 5) for k in range(200)]
    readings = upsert.new_readings_only(spark.createDataFrame(rows, READING), spark.createDataFrame([], READING))
    placed = spark.createDataFrame([(r[2], r[7], p, float(rng.randrange(99)), "µg/m³") for r in rows for p in ("pm25", "no2")], OBSERVED)
    plain = ingest.link_measurements(placed, readings)
    a, b = tables.bucketed(readings, "bucketed_readings", ingest.INSTANT, 4), tables.bucketed(placed, "bucketed_placed", ingest.INSTANT, 4)
    linked = ingest.link_measurements(b, a.hint("merge"))
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and rows_of(linked) == rows_of(plain)
    children = tables.bucketed(plain, "bucketed_children", ["reading_id"], 4)
    scored = ingest.recompute_composite(children)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString() and rows_of(scored) == rows_of(ingest.recompute_composite(plain))
    nested = serve.get_readings(readings, 50, None, plain)
    assert rows_of(serve.get_readings(a, 50, None, children)) == rows_of(nested)


# Newest


def test_newest_reads_only_the_days_that_it_needs(spark, stored):
    table = files.scan_table(spark, stored, "readings")
    for limit, sources, days in ((15, None, 1), (20, None, 1), (25, None, 3), (500, None, 10), (5, [], 0), (3, ["user"], 10)):
        found = tables.newest(spark, stored, limit, sources)
        plain = serve.newest(serve.filter_sources(table, sources), limit).drop("place", "day")
        assert [r.id for r in found.collect()] == [r.id for r in plain.collect()]
        read = {p.split("day=")[1][:10] for p in _files(found)}
        assert len(read) == days, (limit, read)
    untimed = spark.createDataFrame([("x", "u", None, 1, 1.0, 1.0, "user", None)], READING)
    tables.append_readings(untimed, stored)
    assert tables.stored_days(spark, stored, "readings")[-1] is None
    assert [r.id for r in tables.newest(spark, stored, 1000).collect()][-1] == "x"
    nested = tables.newest(spark, stored, 30, None, nested=True)
    assert rows_of(nested) == rows_of(serve.get_readings(table.drop("place", "day"), 30, None, files.scan_table(spark, stored, "measurements")))


def test_the_dashboard_of_stored_tables(spark, stored):
    table = files.scan_table(spark, stored, "readings").drop("place", "day")
    for sources in (None, ["openaq"], []):
        a, b = jobs.stored_dashboard(spark, stored, sources), jobs.dashboard(table, sources)
        assert a.keys() == b.keys() and all(rows_of(a[k]) == rows_of(b[k]) for k in a)
    assert rows_of(jobs.timeline(files.scan_table(spark, stored, "readings"), 28.3, 77.3, False)) == rows_of(jobs.timeline(table, 28.3, 77.3, False))


def test_times_between_read_their_days_alone(spark, stored):
    table = files.scan_table(spark, stored, "readings")
    start, end = AT + timedelta(days=2, hours=5), AT + timedelta(days=3, hours=4)
    found = tables.between(table, start, end)
    assert rows_of(found) == rows_of(serve.filter_time_range(table, start, end)) and scanned(found)[0] == 2


def _files(df):
    """The files of the partitions that a plan's scans select."""
    out = []

    def walk(plan):
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(plan.inputPlan())
        if plan.getClass().getSimpleName() == "FileSourceScanExec":
            for part in [plan.selectedPartitions().toPartitionArray()] if hasattr(plan.selectedPartitions(), "toPartitionArray") else []:
                out.extend(f.toPath().toString() if hasattr(f, "toPath") else str(f) for f in part)
        for k in range(plan.children().size()):
            walk(plan.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return out


# Deletions


def test_deletions_leave_other_files_alone(spark, stored):
    before = set(store.folders(spark, f"{stored}/*/day=*/part-*"))
    gone = spark.createDataFrame([("r20",), ("r21",), ("r60",), ("r60",), ("nobody",), (None,)], "id string")
    assert tables.delete_readings(spark, stored, gone) == (2, 2)
    after = set(store.folders(spark, f"{stored}/*/day=*/part-*"))
    assert {p.split("day=")[1][:10] for p in before ^ after} == {"2024-05-02", "2024-05-04"} and len(before & after) == len(before) - 4
    readings, measurements = (files.scan_table(spark, stored, n) for n in ("readings", "measurements"))
    assert readings.count() == 197 and measurements.count() == 591 and quality.orphans(measurements, "reading_id", readings).isEmpty()
    assert tables.delete_readings(spark, stored, gone) == (0, 0)
    plain = [df.count() for df in quality.delete_profiles(readings, measurements, spark.createDataFrame([("u3",)], "user_id string"))]
    tables.delete_profiles(spark, stored, spark.createDataFrame([("u3",)], "user_id string"))
    left = files.scan_table(spark, stored, "readings")
    assert left.where("user_id = 'u3'").isEmpty() and quality.orphans(files.scan_table(spark, stored, "measurements"), "reading_id", left).isEmpty()
    assert [left.count(), files.scan_table(spark, stored, "measurements").count()] == plain


def test_a_deletion_that_dies_is_finished(spark, stored, monkeypatch):
    monkeypatch.setattr(store, "move", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        tables.delete_readings(spark, stored, spark.createDataFrame([("r7",)], "id string"))
    monkeypatch.undo()
    assert files.scan_table(spark, stored, "readings").where("id = 'r7'").count() == 1
    files.upsert(spark.createDataFrame([reading(950, "m90", 0, 1)], READING), None, stored)  # any next writer
    left = files.scan_table(spark, stored, "readings")
    assert left.where("id = 'r7'").isEmpty() and left.count() == 200 and files.scan_table(spark, stored, "measurements").count() == 597


def test_monitors_that_readings_name_stay(spark, stored):
    monitors = spark.createDataFrame([("m1", None), ("free", None)], "id string, disabled_at timestamp")
    store.publish(monitors, f"{stored}/monitors")
    with pytest.raises(ValueError, match="m1"):
        tables.delete_monitors(spark, stored, ["m1", "free"])
    assert files.scan_table(spark, stored, "monitors").count() == 2
    tables.delete_monitors(spark, stored, ["free"])
    assert [r.id for r in files.scan_table(spark, stored, "monitors").collect()] == ["m1"]


# Composites


def test_rescoring_a_batch_equals_rescoring_all(spark, tmp_path):
    root = str(tmp_path)
    for seed in (1, 2):
        _, added = load(spark, root, seed)
        before = {r.id: r.aqi_value for r in files.scan_table(spark, root, "readings").collect()}
        whole = {r.reading_id: r.aqi_value for r in ingest.recompute_composite(files.scan_table(spark, root, "measurements")).collect()}
        named = {r.reading_id for r in added.collect()}
        moved = tables.rescore(spark, root, added)
        after = {r.id: r.aqi_value for r in files.scan_table(spark, root, "readings").collect()}
        assert after == {k: whole.get(k, v) for k, v in before.items()} and moved == sum(before[k] != after[k] for k in before)
        assert {k for k in before if before[k] != after[k]} <= named
    assert tables.rescore(spark, root, added) == 0 and tables.rescore(spark, root, added.where("false")) == 0


# One pass


def test_rows_are_parted_and_counted_by_one_scan(spark, tmp_path):
    source = f"{tmp_path}/source"
    spark.createDataFrame([reading(k, "m", 0, 0, "openaq" if k % 3 else "OpenAQ", 50 if k % 4 else 5000) for k in range(60)], READING).write.parquet(source)
    rows = quality.validate_readings(spark.read.parquet(source), AT)
    good, bad, seen = quality.split_validated(rows, f"{tmp_path}/split")
    plain = quality.split(rows)
    assert rows_of(good) == rows_of(plain[0]) and rows_of(bad) == rows_of(plain[1])
    assert seen == {"rows": 60, "accepted": 30, "rejected": 30, "reason_aqi_range": 15, "reason_source_unknown": 20}
    listener, given = spark.sparkContext.statusTracker(), spark.read.schema(READING).parquet(source)
    spark.sparkContext.setJobGroup("split", "one write")
    quality.split_once(given, F.col("aqi_value") < 100, f"{tmp_path}/again")
    assert len(listener.getJobIdsForGroup("split")) == 1  # the rows are evaluated by one job, which also counts them
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    empty = quality.split_once(spark.read.parquet(source).where("false"), F.col("aqi_value") < 100, f"{tmp_path}/empty")
    assert empty[0].isEmpty() and empty[1].isEmpty() and empty[2] == {"rows": 0, "accepted": 0, "rejected": 0}
    with pytest.raises(ValueError):
        quality.split_validated(spark.read.parquet(source), f"{tmp_path}/none")


def test_every_reason_is_known(spark):
    seen = set()
    for f in (lambda d: quality.validate_readings(d, AT), quality.validate_measurements, lambda d: quality.validate_entries(d, "me")):
        df = spark.createDataFrame([(None,) * 11], "user_id string, aqi_value int, latitude double, longitude double, source string, recorded_at timestamp, reading_id string, pollutant string, value double, unit string, id string")
        seen |= set(f(df).first().reasons)
    assert seen <= set(quality.REASONS) and {"user_id_missing", "source_missing", "recorded_at_missing", "unit_missing", "pollutant_missing", "reading_id_missing", "latitude_missing", "longitude_missing"} <= seen


# Versions


def test_readers_see_a_whole_version_while_a_load_runs(spark, tmp_path):
    path, wrong, reads, stop = f"{tmp_path}/monitors", [], [], threading.Event()
    store.publish(spark.range(100).select("id", F.lit(0).alias("version")), path)

    def read():
        while not stop.is_set():
            try:
                found = store.current(spark, path).groupBy("version").count().collect()
            except Exception as e:  # noqa: BLE001
                return wrong.append(e)
            reads.append(len(found))
            if len(found) != 1 or found[0]["count"] != 100 + found[0]["version"]:
                wrong.append(found)

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(1, 6):
        store.publish(store.current(spark, path).select("id").unionByName(spark.range(1000 + v, 1001 + v)).withColumn("version", F.lit(v)), path, keep=3)
    stop.set()
    reader.join()
    assert reads and not wrong and store.current(spark, path).count() == 105 and len(store.folders(spark, f"{path}/versions/*")) == 3
    with pytest.raises(FileNotFoundError):
        store.current(spark, f"{tmp_path}/nothing")


def test_monitors_are_updated_over_what_they_are_read_from(spark, tmp_path):
    path = f"{tmp_path}/monitors"
    store.publish(spark.createDataFrame([("a", "old", AT), ("b", "old", None)], "id string, model string, disabled_at timestamp"), path)
    got = files.write_monitors(spark.createDataFrame([("a", "new"), ("c", "new")], "id string, model string"), store.current(spark, path), path)
    assert {(r.id, r.model, r.disabled_at) for r in got.collect()} == {("a", "new", AT), ("b", "old", None), ("c", "new", None)}


# SQL


def test_the_radius_function_in_sql(spark, stored):
    tables.register(spark, stored)
    table = files.scan_table(spark, stored, "readings")
    found = spark.sql("SELECT id, distance FROM readings_within_radius(28.3D, 77.3D, 20000D)")
    plain = geo.readings_within_radius(table, 28.3, 77.3, 20_000.0)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in plain.collect()) and found.count() > 0
    centres = "VALUES (1, 28.3D, 77.3D), (2, 28.0D, 77.0D), (3, 0D, 0D)"
    joined = spark.sql(f"SELECT c.n, r.id FROM ({centres}) c(n, lat, lng), LATERAL readings_within_radius(c.lat, c.lng, 20000D) r")
    points = spark.createDataFrame([(1, 28.3, 77.3), (2, 28.0, 77.0), (3, 0.0, 0.0)], "point_id int, lat double, lng double")
    assert sorted(map(tuple, joined.collect())) == sorted((r.point_id, r.id) for r in geo.radius_join(points, table, 20_000.0).collect())
    counts = spark.sql(f"SELECT c.n, (SELECT count(*) FROM readings_within_radius(28.3D, 77.3D, 20000D)) AS k FROM ({centres}) c(n, lat, lng)").collect()
    assert {r.k for r in counts} == {plain.count()}


def test_the_radius_function_takes_few_distances(spark, stored):
    """Called for many centres, it tests its box first, and no part of a distance is worked out twice."""
    tables.register(spark, stored)
    centres = spark.range(40).select(F.col("id").alias("n"), (F.lit(27.0) + F.col("id") * 0.1).alias("lat"), F.lit(77.2).alias("lng"))
    centres.createOrReplaceTempView("centres")
    found = spark.sql("SELECT c.n, r.id, r.distance FROM centres c, LATERAL readings_within_radius(c.lat, c.lng, 20000D) r")
    plain = geo.radius_join(centres.withColumnRenamed("n", "point_id"), files.scan_table(spark, stored, "readings"), 20_000.0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.select("point_id", "id", "distance").collect())) != []
    met = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "ATAN" in line]
    assert met and all(line.count("ATAN") <= 2 and line.index(">= (") < line.index("ATAN") for line in met)


def test_fresh_days_are_written_once(spark, stored, monkeypatch):
    """Rows of days that the table has none of are worked out and written once, then moved; other days are written again."""
    wrote, real = [], tables.write
    monkeypatch.setattr(tables, "write", lambda rows, name, path, *a, **o: wrote.append(path) or real(rows, name, path, *a, **o))
    monkeypatch.setattr(tables, "days_of", lambda *_: pytest.fail("the rows' days are asked for"))
    root = f"{stored}/other"
    tables.create(spark, root)
    tables.put(spark, root, readings=tables.laid_out(spark.createDataFrame([reading(1, "m1", 0), reading(2, "m2", 1)], READING), "readings"))
    assert len(wrote) == 1 and "/_changes/" in wrote[0]
    tables.put(spark, root, readings=tables.laid_out(spark.createDataFrame([reading(3, "m3", 1), reading(4, "m4", 2), ("r5", "u", "m", 1, 1.0, 1.0, "user", None)], READING), "readings"))
    assert sorted((r.id, str(r.day)) for r in tables.scan(spark, root, "readings").collect()) == [("r1", "2024-05-01"), ("r2", "2024-05-02"), ("r3", "2024-05-02"), ("r4", "2024-05-03"), ("r5", "None")]
    assert store.folders(spark, f"{root}/_changes/*") == []
