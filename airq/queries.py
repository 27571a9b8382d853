"""The registered queries of the air-quality engine over the derived views, each with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import CATEGORIES, CITIES, COMPARED, DARK, POLLUTANTS, bands
from .fixtures import derived, duck, view
from .functions import aqi, geo, present, units
from .operators import ingest, quality, readings as serve, stations as dims, upsert
from .plans import jobs
from .sources import files, store, tables
from .streaming.recent import whole_instants

AS_OF = datetime(2024, 1, 30, 12)
DAY = datetime(2024, 1, 15)
DELHI = (28.6139, 77.2090)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _zoneless(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n, t in df.dtypes if t == "timestamp"})


def query(sql: str):
    """Register a query under its function's name, with the SQL that it must agree with."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: _zoneless(f(spark, sf_dir))
        ORACLES[f.__name__] = _WITH + sql
        return f

    return keep


def _values(rows: list[tuple]) -> str:
    def one(v: object) -> str:
        return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + str(v) + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_BANDS = _values([(s, p, k, float(a), float(b), i, j) for s in CATEGORIES for p in POLLUTANTS for k, (a, b, i, j) in enumerate(bands(s, p))])
_CATS = _values([(s, k, *c, int(c[0] in DARK[s])) for s, cs in CATEGORIES.items() for k, c in enumerate(cs)])
_CITY = _values([(k, *c) for k, c in enumerate(CITIES)])
_OLD = _values([(s, float(a), float(b), i, j) for s, rows in COMPARED.items() for a, b, i, j in rows])
_WITH = f"""
WITH obs AS ({duck("obs")}), readings AS ({duck("readings")}), dirty AS ({duck("dirty")}), sensors AS ({duck("sensors")}), entries AS ({duck("entries")}),
bands(scale, pollutant, ord, c_lo, c_hi, i_lo, i_hi) AS (VALUES {_BANDS}), cats(scale, ord, label, color, lo, hi, dark) AS (VALUES {_CATS}),
cities(ord, city, la, lo, lb, lp) AS (VALUES {_CITY}), older(scale, c_lo, c_hi, i_lo, i_hi) AS (VALUES {_OLD}),
factors(pollutant, unit, f) AS (VALUES ('no2', 'ppb', CAST(1.88 AS DOUBLE)), ('so2', 'ppb', CAST(2.62 AS DOUBLE)), ('o3', 'ppb', CAST(1.96 AS DOUBLE)), ('co', 'ppm', CAST(1.145 AS DOUBLE))),
coded AS (SELECT *, CASE WHEN lower(parameter) = 'pm2.5' THEN 'pm25' ELSE lower(parameter) END AS pollutant FROM obs),
converted AS (
  SELECT c.*, CASE WHEN c.pollutant = 'co' THEN 'mg/m³' ELSE 'µg/m³' END AS unit,
    CASE WHEN c.pollutant = 'co' THEN CASE c.units WHEN 'mg/m³' THEN value WHEN 'µg/m³' THEN value / 1000 WHEN 'ppm' THEN value * f.f WHEN 'ppb' THEN value * f.f / 1000 END
      ELSE CASE c.units WHEN 'µg/m³' THEN value WHEN 'mg/m³' THEN value * 1000 WHEN 'ppb' THEN value * f.f WHEN 'ppm' THEN value * f.f * 1000 END END AS canonical_value
  FROM coded c LEFT JOIN factors f ON f.pollutant = c.pollutant),
usable AS (SELECT location_id AS monitor_id, * FROM converted WHERE canonical_value >= 0),
collapsed AS (SELECT monitor_id, recorded_at, pollutant, max(canonical_value) AS value FROM usable GROUP BY ALL),
banded AS (
  SELECT c.monitor_id, c.recorded_at, c.pollutant, c.value, b.scale,
    coalesce(min_by(b, b.ord) FILTER (WHERE b.c_lo <= c.value AND c.value <= b.c_hi), max_by(b, b.ord)) AS b
  FROM collapsed c JOIN bands b ON b.pollutant = c.pollutant GROUP BY c.monitor_id, c.recorded_at, c.pollutant, c.value, b.scale),
indexed AS (
  SELECT monitor_id, recorded_at, pollutant, value, scale,
    CAST(least(1000, floor((CAST(b.i_hi - b.i_lo AS DOUBLE) / (b.c_hi - b.c_lo)) * (value - b.c_lo) + b.i_lo + CAST(0.5 AS DOUBLE))) AS INT) AS sub_index
  FROM banded),
composites AS (SELECT scale, monitor_id, recorded_at, max(sub_index) AS aqi_value FROM indexed GROUP BY ALL),
built AS (
  SELECT c.monitor_id, c.recorded_at, c.aqi_value, p.latitude, p.longitude FROM composites c
  JOIN (SELECT monitor_id, min_by(lat, recorded_at) AS latitude, min_by(lon, recorded_at) AS longitude FROM usable WHERE pollutant IN ('pm25','pm10','no2','so2') GROUP BY monitor_id) p USING (monitor_id) WHERE c.scale = 'naqi'),
stations AS (
  SELECT s.*, c.city FROM (SELECT location_id, any_value(lat) AS latitude, any_value(lon) AS longitude,
    count(*) FILTER (WHERE lower(parameter) IN ('pm2.5', 'pm10', 'no2', 'so2')) AS sensors FROM sensors GROUP BY location_id) s
  LEFT JOIN (SELECT l.location_id, min_by(c.city, c.ord) AS city FROM (SELECT DISTINCT location_id, lat, lon FROM sensors) l JOIN cities c ON l.lat BETWEEN c.la AND c.lb AND l.lon BETWEEN c.lo AND c.lp GROUP BY l.location_id) c USING (location_id))
"""


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.canonical(view(spark, sf_dir, "obs")).withColumn("monitor_id", F.col("location_id"))


def _values_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.collapse_sensors(ingest.drop_unconvertible(_obs(spark, sf_dir))[0])


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "readings")


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of the readings: what their monitor's sensors say of their hour."""
    keyed = _readings(spark, sf_dir).select(F.col("id").alias("reading_id"), "monitor_id", F.date_trunc("hour", "recorded_at").alias("recorded_at"), F.to_date("recorded_at").alias("day"))
    found = _values_of(spark, sf_dir).join(keyed, ["monitor_id", "recorded_at"])
    return found.select("reading_id", "pollutant", "value", units.canonical_unit(F.col("pollutant")).alias("unit"), "day")


_CHILDREN = """, children AS (SELECT r.id AS reading_id, c.pollutant, c.value, CASE WHEN c.pollutant = 'co' THEN 'mg/m³' ELSE 'µg/m³' END AS unit
  FROM readings r JOIN collapsed c ON c.monitor_id = r.monitor_id AND c.recorded_at = date_trunc('hour', r.recorded_at)) """


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """The readings and their measurements as stored tables in a folder of their own."""
    root = store.scratch(spark)
    tables.create(spark, root)
    with store.locked(spark, root):
        tables.put(spark, root, tables.laid_out(_readings(spark, sf_dir), "readings"), tables.laid_out(_children(spark, sf_dir), "measurements"))
    return root


@query("SELECT obs_id, pollutant FROM coded")
def normalize_pollutant(spark, sf_dir):
    return view(spark, sf_dir, "obs").select("obs_id", units.normalize_pollutant(F.col("parameter")).alias("pollutant"))


@query("SELECT obs_id, pollutant, unit, canonical_value FROM converted WHERE pollutant IN ('pm25', 'pm10', 'no2', 'so2')")
def convert_units(spark, sf_dir):
    return ingest.filter_target_pollutants(_obs(spark, sf_dir)).select("obs_id", "pollutant", "unit", "canonical_value")


@query("SELECT pollutant, units, count(*) AS n FROM converted WHERE NOT coalesce(canonical_value >= 0, false) GROUP BY ALL")
def unconvertible(spark, sf_dir):
    return ingest.drop_unconvertible(_obs(spark, sf_dir))[1].groupBy("pollutant", "units").agg(F.count("*").alias("n"))


@query("SELECT * FROM collapsed")
def collapse_sensors(spark, sf_dir):
    return _values_of(spark, sf_dir)


def _indexed(scale):
    def run(spark, sf_dir):
        return _values_of(spark, sf_dir).withColumn("sub_index", aqi.sub_index(F.col("pollutant"), F.col("value"), scale))

    run.__name__ = f"sub_index_{scale}"
    return run


for _scale in CATEGORIES:
    query(f"SELECT monitor_id, recorded_at, pollutant, value, sub_index FROM indexed WHERE scale = '{_scale}'")(_indexed(_scale))


@query("SELECT monitor_id, recorded_at, pollutant, value, sub_index FROM indexed WHERE scale = 'epa'")
def sub_index_join(spark, sf_dir):
    return aqi.sub_index_by_join(_values_of(spark, sf_dir), "epa").select("monitor_id", "recorded_at", "pollutant", "value", "sub_index")


@query("""SELECT c.monitor_id, c.recorded_at, round(max(CASE WHEN o.scale = 'epa' THEN CAST(o.i_hi - o.i_lo AS DOUBLE) / (o.c_hi - o.c_lo) * (value - o.c_lo) + o.i_lo END), 6) AS epa,
  round(max(CASE WHEN o.scale = 'naqi' THEN CAST(o.i_hi - o.i_lo AS DOUBLE) / (o.c_hi - o.c_lo) * (value - o.c_lo) + o.i_lo END), 6) AS naqi
  FROM collapsed c LEFT JOIN older o ON c.value BETWEEN o.c_lo AND o.c_hi WHERE c.pollutant = 'pm25' GROUP BY ALL""")
def strict_sub_index(spark, sf_dir):
    rows = _values_of(spark, sf_dir).where("pollutant = 'pm25'")
    return rows.select("monitor_id", "recorded_at", *[F.round(aqi.strict_sub_index(F.col("value"), s), 6).alias(s) for s in ("epa", "naqi")])


def _categories(scale):
    def run(spark, sf_dir):
        v = F.col("aqi_value")
        return _readings(spark, sf_dir).select("id", aqi.label(v, scale).alias("label"), aqi.color(v, scale).alias("color"), aqi.text_color(v, scale).alias("text_color"))

    run.__name__ = f"categories_{scale}"
    return run


_LABELLED = """SELECT r.id, coalesce(min_by(c.label, c.ord) FILTER (WHERE r.aqi_value BETWEEN c.lo AND c.hi), max_by(c.label, c.ord)) AS label,
  coalesce(min_by(c.color, c.ord) FILTER (WHERE r.aqi_value BETWEEN c.lo AND c.hi), max_by(c.color, c.ord)) AS color,
  CASE WHEN coalesce(min_by(c.dark, c.ord) FILTER (WHERE r.aqi_value BETWEEN c.lo AND c.hi), max_by(c.dark, c.ord)) = 1 THEN '#ffffff' ELSE '#000000' END AS text_color
  FROM readings r CROSS JOIN cats c WHERE c.scale = '{scale}' GROUP BY r.id"""
for _scale in CATEGORIES:
    query(_LABELLED.replace("{scale}", _scale))(_categories(_scale))


@query("SELECT monitor_id, recorded_at, aqi_value FROM composites WHERE scale = 'naqi'")
def composite_aqi(spark, sf_dir):
    return ingest.instants(ingest.drop_unconvertible(_obs(spark, sf_dir))[0]).select("monitor_id", "recorded_at", "aqi_value")


@query("SELECT monitor_id, recorded_at, aqi_value FROM composites WHERE scale = 'epa'")
def composite_epa(spark, sf_dir):
    return ingest.composite_aqi(_values_of(spark, sf_dir), "epa")


@query("SELECT monitor_id, recorded_at, aqi_value FROM composites WHERE scale = 'naqi'")
def composite_array(spark, sf_dir):
    nested = _values_of(spark, sf_dir).groupBy("monitor_id", "recorded_at").agg(F.collect_list(F.struct("pollutant", "value")).alias("m"))
    return nested.select("monitor_id", "recorded_at", aqi.composite_array(F.col("m")).alias("aqi_value"))


@query("""SELECT city, dominant, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY city), 6) AS share FROM (
  SELECT coalesce(CASE monitor_id % 4 WHEN 0 THEN 'Delhi NCR' WHEN 1 THEN 'Mumbai' WHEN 2 THEN 'Bangalore' END, 'none') AS city, dominant, count(*) AS n FROM (
    SELECT monitor_id, recorded_at, arg_max(pollutant, sub_index * 10 - list_position(['pm25', 'pm10', 'o3', 'no2', 'so2', 'co'], pollutant)) AS dominant FROM indexed WHERE scale = 'naqi' GROUP BY ALL) d GROUP BY ALL) g""")
def dominant_pollutant(spark, sf_dir):
    from pyspark.sql import Window

    found = ingest.dominant_pollutant(_values_of(spark, sf_dir))
    place = ingest.file_position(ingest.drop_unconvertible(_obs(spark, sf_dir))[0])
    rows = found.join(place, "monitor_id").withColumn("city", F.coalesce(geo.which_city(F.col("latitude"), F.col("longitude")), F.lit("none")))
    counts = rows.groupBy("city", "dominant").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("city")), 6))


@query("""SELECT monitor_id, recorded_at, aqi_value, latitude, longitude, 'openaq' AS source FROM (
  SELECT i.monitor_id, i.recorded_at, max(sub_index) AS aqi_value FROM indexed i WHERE scale = 'naqi' AND pollutant IN ('pm25','pm10','no2','so2') GROUP BY ALL) c
  JOIN (SELECT DISTINCT monitor_id, latitude, longitude FROM built) p USING (monitor_id)""")
def build_readings(spark, sf_dir):
    rows = ingest.build_readings(jobs.usable(view(spark, sf_dir, "obs").withColumn("monitor_id", F.col("location_id"))))
    return rows.select("monitor_id", "recorded_at", "aqi_value", "latitude", "longitude", "source")


@query("SELECT monitor_id, recorded_at, pollutant, value, CASE WHEN pollutant = 'co' THEN 'mg/m³' ELSE 'µg/m³' END AS unit FROM collapsed")
def build_measurements(spark, sf_dir):
    return ingest.build_measurements(ingest.drop_unconvertible(_obs(spark, sf_dir))[0])


@query("SELECT id, source, aqi_value, recorded_at FROM readings WHERE source IN ('openaq', 'government') ORDER BY recorded_at DESC, id LIMIT 1000")
def get_readings(spark, sf_dir):
    return serve.get_readings(_readings(spark, sf_dir), 1000, ["openaq", "government"]).select("id", "source", "aqi_value", "recorded_at")


@query("SELECT id, source FROM readings WHERE false")
def get_readings_empty(spark, sf_dir):
    return serve.get_readings(_readings(spark, sf_dir), 1000, []).select("id", "source")


@query("""SELECT r.id, count(m.pollutant) AS measurements, round(max(m.value), 6) AS largest FROM (SELECT * FROM readings ORDER BY recorded_at DESC, id LIMIT 1000) r
  LEFT JOIN collapsed m ON m.monitor_id = r.monitor_id AND m.recorded_at = date_trunc('hour', r.recorded_at) GROUP BY r.id""")
def get_readings_nested(spark, sf_dir):
    readings = _readings(spark, sf_dir)
    keyed = readings.select(F.col("id").alias("reading_id"), "monitor_id", F.date_trunc("hour", "recorded_at").alias("recorded_at"))
    measurements = _values_of(spark, sf_dir).join(keyed, ["monitor_id", "recorded_at"]).select("reading_id", "pollutant", "value", units.canonical_unit(F.col("pollutant")).alias("unit"))
    nested = serve.get_readings(readings, 1000, None, measurements)
    return nested.select("id", F.size("measurements").cast("long").alias("measurements"), F.round(F.array_max("measurements.value"), 6).alias("largest"))


@query("SELECT id, recorded_at FROM readings WHERE recorded_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'")
def time_range(spark, sf_dir):
    return serve.filter_time_range(_readings(spark, sf_dir), datetime(2024, 1, 10), datetime(2024, 1, 20)).select("id", "recorded_at")


@query("SELECT id, monitor_id, recorded_at FROM readings WHERE source = 'openaq' AND recorded_at >= TIMESTAMP '2024-01-15 00:00:00' AND recorded_at < TIMESTAMP '2024-01-16 00:00:00' AND monitor_id IN (0, 1, 2, 3, 4, 5)")
def day_window(spark, sf_dir):
    return serve.filter_day(_readings(spark, sf_dir), DAY, list(range(6))).select("id", "monitor_id", "recorded_at")


@query("SELECT id, recorded_at FROM readings WHERE recorded_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 48 HOUR")
def since_window(spark, sf_dir):
    return serve.filter_since(_readings(spark, sf_dir), AS_OF, 48).select("id", "recorded_at")


_DISTANCE = """CASE WHEN s = 0 THEN 0 ELSE 6378137 * (s - (1 / CAST(298.257223563 AS DOUBLE)) / 2 * ((s - sin(s)) * pow(sin((b1 + b2) / 2) * cos((b2 - b1) / 2) / cos(s / 2), 2)
  + (s + sin(s)) * pow(cos((b1 + b2) / 2) * sin((b2 - b1) / 2) / sin(s / 2), 2))) END"""
_FAR = f"""SELECT *, {_DISTANCE} AS metres FROM (SELECT *, 2 * asin(least(1, sqrt(pow(sin((b2 - b1) / 2), 2) + cos(b1) * cos(b2) * pow(sin(radians(l2 - l1) / 2), 2)))) AS s FROM (
  SELECT r.*, p.point_id, p.lng AS l1, r.longitude AS l2, atan((1 - 1 / CAST(298.257223563 AS DOUBLE)) * tan(radians(p.lat))) AS b1, atan((1 - 1 / CAST(298.257223563 AS DOUBLE)) * tan(radians(r.latitude))) AS b2
  FROM readings r CROSS JOIN points p) x) y"""


@query(f", points(point_id, lat, lng) AS (VALUES (0, CAST(28.6139 AS DOUBLE), CAST(77.2090 AS DOUBLE))) SELECT id, round(metres, 2) AS distance FROM ({_FAR}) z WHERE metres <= 5000")
def within_radius(spark, sf_dir):
    return geo.readings_within_radius(_readings(spark, sf_dir), *DELHI).select("id", F.round("distance", 2).alias("distance"))


@query(f", points(point_id, lat, lng) AS (SELECT DISTINCT location_id, lat, lon FROM sensors WHERE lat IS NOT NULL) SELECT point_id, id FROM ({_FAR}) z WHERE metres <= 10000")
def radius_join(spark, sf_dir):
    points = view(spark, sf_dir, "sensors").where("lat is not null").select(F.col("location_id").alias("point_id"), "lat", F.col("lon").alias("lng")).distinct()
    return geo.radius_join(points, _readings(spark, sf_dir).select("id", "latitude", "longitude"), 10000.0).select("point_id", "id")


def _locations(spark, sf_dir):
    rows = view(spark, sf_dir, "sensors")
    nested = rows.groupBy("location_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).agg(F.collect_list(F.struct("sensor_id", "parameter")).alias("sensors"))
    return nested.withColumn("name", F.concat(F.lit("Station "), F.col("location_id").cast("string")))


@query("SELECT location_id, city FROM stations")
def which_city(spark, sf_dir):
    return _locations(spark, sf_dir).select("location_id", geo.which_city(F.col("latitude"), F.col("longitude")).alias("city"))


@query("SELECT location_id, city FROM stations")
def assign_city_join(spark, sf_dir):
    return geo.assign_city(_locations(spark, sf_dir), "latitude", "longitude").select("location_id", "city")


@query("SELECT city, count(*) AS stations FROM stations WHERE city IS NOT NULL AND sensors > 0 GROUP BY city")
def stations_per_city(spark, sf_dir):
    return dims.stations_per_city(dims.filter_to_target(_locations(spark, sf_dir)))


@query("SELECT CAST(sum(sensors) AS BIGINT) AS sensors FROM stations WHERE city IS NOT NULL AND sensors > 0")
def sensor_total(spark, sf_dir):
    return dims.sensor_total(dims.filter_to_target(_locations(spark, sf_dir)))


@query("SELECT location_id, city, sensors FROM stations WHERE city IS NOT NULL AND sensors > 0")
def filter_to_target(spark, sf_dir):
    return dims.filter_to_target(_locations(spark, sf_dir)).select("location_id", "city", F.size("sensors").cast("long").alias("sensors"))


def _pair(spark, sf_dir):
    """Readings of the even stations as existing ones; all of them and the readings without a monitor as incoming."""
    built = jobs.usable(view(spark, sf_dir, "obs").withColumn("monitor_id", F.col("location_id")))
    made = ingest.build_readings(built).select(F.concat_ws(":", "monitor_id", F.unix_timestamp("recorded_at")).alias("id"), "monitor_id", "source", "recorded_at")
    loose = _readings(spark, sf_dir).where("monitor_id is null").select(F.concat(F.lit("u:"), F.col("id").cast("string")).alias("id"), "monitor_id", "source", "recorded_at")
    return made.where("monitor_id % 2 = 0"), made.unionByName(loose)


_MADE = """, made AS (SELECT DISTINCT concat(monitor_id, ':', CAST(epoch(recorded_at) AS BIGINT)) AS id, monitor_id, 'openaq' AS source, recorded_at FROM usable WHERE pollutant IN ('pm25','pm10','no2','so2')),
incoming AS (SELECT * FROM made UNION ALL SELECT concat('u:', id), monitor_id, source, recorded_at FROM readings WHERE monitor_id IS NULL) """


@query(_MADE + "SELECT id, monitor_id, source FROM incoming WHERE monitor_id IS NULL OR monitor_id % 2 = 1")
def new_readings_only(spark, sf_dir):
    existing, incoming = _pair(spark, sf_dir)
    return upsert.new_readings_only(incoming, existing).select("id", "monitor_id", "source")


@query(_MADE + "SELECT m.id AS reading_id, c.pollutant, c.value FROM made m JOIN collapsed c USING (monitor_id, recorded_at) WHERE c.pollutant IN ('pm25','pm10','no2','so2')")
def link_measurements(spark, sf_dir):
    existing, incoming = _pair(spark, sf_dir)
    built = ingest.build_measurements(jobs.usable(view(spark, sf_dir, "obs").withColumn("monitor_id", F.col("location_id"))))
    return ingest.link_measurements(built, ingest.union_readings(incoming, existing)).drop("unit")


@query(_MADE + "SELECT m.id AS reading_id, c.pollutant, c.value FROM made m JOIN collapsed c USING (monitor_id, recorded_at) WHERE c.pollutant IN ('pm25','pm10','no2','so2') AND monitor_id % 2 = 1")
def new_measurements_only(spark, sf_dir):
    existing, incoming = _pair(spark, sf_dir)
    built = ingest.build_measurements(jobs.usable(view(spark, sf_dir, "obs").withColumn("monitor_id", F.col("location_id"))))
    linked = ingest.link_measurements(built, ingest.union_readings(incoming, existing))
    return upsert.new_measurements_only(linked, ingest.link_measurements(built, existing)).drop("unit")


def _monitors(spark, sf_dir):
    ids = view(spark, sf_dir, "obs").select("location_id").distinct().where("location_id < 6")
    gone = F.when(F.col("location_id") == 3, F.lit("2024-01-05 00:00:00").cast("timestamp"))
    return ids.select(F.concat(F.lit("m"), F.col("location_id").cast("string")).alias("id"), F.concat(F.lit("openaq:"), F.col("location_id").cast("string")).alias("serial_number"), F.lit("old").alias("model"), gone.alias("disabled_at"))


def _stations(spark, sf_dir):
    ids = view(spark, sf_dir, "obs").select("location_id").distinct()
    return ids.select("location_id", F.concat(F.lit("Station "), F.col("location_id").cast("string")).alias("name"), F.lit("Delhi NCR").alias("city"))


_MON = ", m AS (SELECT DISTINCT location_id FROM obs) "


@query(_MON + "SELECT CASE WHEN location_id < 6 THEN concat('m', location_id) ELSE sha256(concat('openaq:', location_id)) END AS id, location_id, concat('Station ', location_id) AS model, concat('OpenAQ location ', location_id, ' in Delhi NCR') AS notes FROM m")
def sync_monitors(spark, sf_dir):
    return dims.sync_monitors(_stations(spark, sf_dir), _monitors(spark, sf_dir)).select("id", "location_id", "model", "notes")


@query(_MON + """SELECT CASE WHEN location_id < 6 THEN concat('m', location_id) ELSE sha256(concat('openaq:', location_id)) END AS id, concat('openaq:', location_id) AS serial_number,
  concat('Station ', location_id) AS model, CASE WHEN location_id = 3 THEN TIMESTAMP '2024-01-05 00:00:00' END AS disabled_at FROM m""")
def upsert_monitors(spark, sf_dir):
    incoming = dims.sync_monitors(_stations(spark, sf_dir), _monitors(spark, sf_dir)).select("id", "serial_number", "model")
    return upsert.upsert_monitors(incoming, _monitors(spark, sf_dir))


@query("SELECT id, monitor_id FROM readings WHERE monitor_id IS NOT NULL AND monitor_id >= 6")
def orphan_checks(spark, sf_dir):
    parents = view(spark, sf_dir, "obs").select(F.col("location_id").alias("id")).distinct().where("id < 6")
    return quality.orphans(_readings(spark, sf_dir), "monitor_id", parents).select("id", "monitor_id")


@query("SELECT monitor_id, source, date_trunc('hour', recorded_at) AS recorded_at, count(*) AS n FROM readings WHERE monitor_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    hourly = _readings(spark, sf_dir).withColumn("recorded_at", F.date_trunc("hour", "recorded_at"))
    return quality.duplicate_keys(hourly, ["monitor_id", "source", "recorded_at"])


@query("""SELECT id, concat_ws(',', CASE WHEN aqi_value IS NULL THEN 'aqi_value_missing' END, CASE WHEN aqi_value NOT BETWEEN 0 AND 1000 THEN 'aqi_range' END, CASE WHEN latitude NOT BETWEEN -90 AND 90 THEN 'latitude_range' END,
  CASE WHEN longitude NOT BETWEEN -180 AND 180 THEN 'longitude_range' END, CASE WHEN source NOT IN ('user', 'openaq', 'simulated', 'government') THEN 'source_unknown' END,
  CASE WHEN recorded_at > TIMESTAMP '2024-01-30 13:00:00' THEN 'recorded_in_future' END) AS reasons FROM dirty""")
def validate_readings(spark, sf_dir):
    return quality.validate_readings(view(spark, sf_dir, "dirty"), AS_OF).select("id", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT obs_id, concat_ws(',', CASE WHEN value IS NULL THEN 'value_missing' END, CASE WHEN lower(parameter) NOT IN ('pm25', 'pm10', 'o3', 'no2', 'so2', 'co') THEN 'pollutant_unknown' END,
  CASE WHEN value < 0 THEN 'value_negative' END) AS reasons FROM obs""")
def validate_measurements(spark, sf_dir):
    rows = view(spark, sf_dir, "obs").select("obs_id", F.col("obs_id").alias("reading_id"), F.lower("parameter").alias("pollutant"), "value", F.col("units").alias("unit"))
    return quality.validate_measurements(rows).select("obs_id", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT event_id, CASE WHEN v IS NULL THEN 'aqi_value_missing' ELSE '' END AS reasons FROM (
  SELECT event_id, CASE WHEN n BETWEEN 0 AND 500 THEN n END AS v FROM (SELECT event_id, TRY_CAST(nullif(regexp_extract(txt, '^\\s*([+-]?\\d+)', 1), '') AS INT) AS n FROM entries) a) b""")
def validate_entries(spark, sf_dir):
    rows = view(spark, sf_dir, "entries").select("event_id", present.parse_user_aqi(F.col("txt")).alias("aqi_value"), F.lit("me").alias("user_id"), F.lit("user").alias("source"), F.lit(1.0).alias("latitude"), F.lit(1.0).alias("longitude"))
    return quality.validate_entries(rows, "me").select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""{_CHILDREN} SELECT r.source, m.pollutant, count(*) AS n, round(sum(m.value), 4) AS total FROM readings r LEFT JOIN children m ON m.reading_id = r.id WHERE r.aqi_value <= 150 GROUP BY ALL""")
def cascade_delete(spark, sf_dir):
    readings = _readings(spark, sf_dir)
    left, children = quality.cascade_delete(readings, _children(spark, sf_dir), readings.where("aqi_value > 150").select("id"))
    both = left.join(children.withColumnRenamed("reading_id", "id"), "id", "full_outer")  # full, so that a child that lost its parent would show
    return both.groupBy("source", "pollutant").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT DISTINCT monitor_id AS id FROM readings WHERE monitor_id < 6")
def restrict_delete(spark, sf_dir):
    monitors = view(spark, sf_dir, "obs").select(F.col("location_id").alias("id")).distinct().where("id < 6")
    return quality.restrict_delete(monitors, _readings(spark, sf_dir))


@query(_MON + "SELECT concat('m', location_id) AS id FROM m WHERE location_id < 6 AND location_id <> 3")
def active_monitors(spark, sf_dir):
    return serve.active_monitors(_monitors(spark, sf_dir)).select("id")


@query("SELECT DISTINCT user_id, monitor_id FROM readings WHERE monitor_id IS NOT NULL")
def user_monitors(spark, sf_dir):
    return serve.user_monitors(_readings(spark, sf_dir))


@query("SELECT id, monitor_id, user_id FROM readings WHERE user_id = 7 AND monitor_id = 7")
def owned_by_monitor(spark, sf_dir):
    return serve.matching(serve.owned_by(_readings(spark, sf_dir), 7), monitor_id=7).select("id", "monitor_id", "user_id")


@query(r"SELECT event_id, CASE WHEN n BETWEEN 0 AND 500 THEN n END AS aqi_value FROM (SELECT event_id, TRY_CAST(nullif(regexp_extract(txt, '^\s*([+-]?\d+)', 1), '') AS INT) AS n FROM entries) a")
def parse_user_aqi(spark, sf_dir):
    return view(spark, sf_dir, "entries").select("event_id", present.parse_user_aqi(F.col("txt")).alias("aqi_value"))


@query(f"SELECT l.id, l.label, l.color, r.latitude AS lat, r.longitude AS lng, r.aqi_value AS value, r.recorded_at AS time FROM ({_LABELLED.replace('{scale}', 'naqi')}) l JOIN readings r USING (id)")
def markers(spark, sf_dir):
    return present.markers(_readings(spark, sf_dir))


@query(f"SELECT l.id, l.label, l.color AS background, l.text_color, r.aqi_value AS value FROM ({_LABELLED.replace('{scale}', 'epa')}) l JOIN readings r USING (id)")
def badges(spark, sf_dir):
    return present.badges(_readings(spark, sf_dir), "epa")


@query(f", points(point_id, lat, lng) AS (VALUES (0, CAST(28.6139 AS DOUBLE), CAST(77.2090 AS DOUBLE))) SELECT strftime(recorded_at, '%b %-d, %I:%M %p') AS time, aqi_value AS aqi FROM ({_FAR}) z WHERE metres <= 10000 AND source IN ('openaq', 'user')")
def timeline(spark, sf_dir):
    return jobs.timeline(_readings(spark, sf_dir), *DELHI, False, ["openaq", "user"])


@query("SELECT id, aqi_value FROM readings ORDER BY recorded_at DESC, id LIMIT 10")
def recent_list(spark, sf_dir):
    return serve.newest(_readings(spark, sf_dir), 10).select("id", "aqi_value")


@query("SELECT min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east FROM readings")
def map_bounds(spark, sf_dir):
    return serve.map_bounds(_readings(spark, sf_dir))


@query("""SELECT count(DISTINCT monitor_id) AS stations, count(DISTINCT (monitor_id, recorded_at)) AS readings, count(*) AS measurements FROM collapsed WHERE pollutant IN ('pm25','pm10','no2','so2')""")
def ingest_summary(spark, sf_dir):
    rows = jobs.usable(view(spark, sf_dir, "obs").withColumn("monitor_id", F.col("location_id")))
    return ingest.ingest_summary(ingest.build_readings(rows), ingest.build_measurements(rows))


@query("""SELECT monitor_id, recorded_at, max(CASE WHEN scale = 'naqi' THEN aqi_value END) AS naqi, max(CASE WHEN scale = 'epa' THEN aqi_value END) AS epa FROM composites GROUP BY ALL""")
def rescore(spark, sf_dir):
    return jobs.rescore(_values_of(spark, sf_dir))


@query("SELECT source, CASE source WHEN 'user' THEN 'User Entries' WHEN 'openaq' THEN 'OpenAQ' WHEN 'government' THEN 'Government' WHEN 'simulated' THEN 'Simulated' END AS label, count(*) AS n FROM readings GROUP BY ALL")
def source_labels(spark, sf_dir):
    from .config import SOURCE_LABELS

    return _readings(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")).withColumn("label", present.display_label(F.col("source"), SOURCE_LABELS))


# The stored tables


@query(f", points(point_id, lat, lng) AS (VALUES (0, CAST(28.6139 AS DOUBLE), CAST(77.2090 AS DOUBLE))) SELECT id, round(metres, 2) AS distance FROM ({_FAR}) z WHERE metres <= 3000")
def stored_within_radius(spark, sf_dir):
    found = tables.within_radius(files.scan_table(spark, _stored(spark, sf_dir), "readings"), *DELHI, 3000.0)
    return found.select(F.col("id").cast("long"), F.round("distance", 2).alias("distance"))


@query(f"""{_CHILDREN} SELECT r.id, r.recorded_at, m.pollutant, m.unit, round(m.value, 6) AS value FROM (SELECT * FROM readings WHERE source IN ('openaq', 'government') ORDER BY recorded_at DESC, id LIMIT 1000) r
  LEFT JOIN children m ON m.reading_id = r.id""")
def stored_newest(spark, sf_dir):
    """Ids are texts in the stored table; no two of its readings have one time, so their order does not show."""
    found = tables.newest(spark, _stored(spark, sf_dir), 1000, ["openaq", "government"], nested=True)
    return found.select(F.col("id").cast("long"), "recorded_at", F.inline_outer("measurements")).withColumn("value", F.round("value", 6))


@query(f"""{_CHILDREN}, kept AS (SELECT * FROM readings WHERE NOT (aqi_value > 195 AND user_id % 3 = 0)) SELECT 'readings' AS name, source AS what, count(*) AS n FROM kept GROUP BY ALL
  UNION ALL SELECT 'measurements', pollutant, count(*) FROM children WHERE reading_id IN (SELECT id FROM kept) GROUP BY ALL""")
def stored_deletion(spark, sf_dir):
    root = _stored(spark, sf_dir)
    tables.delete_readings(spark, root, _readings(spark, sf_dir).where("aqi_value > 195 and user_id % 3 = 0").select("id"))
    readings, measurements = (files.scan_table(spark, root, n) for n in ("readings", "measurements"))
    of = [df.groupBy(F.lit(name).alias("name"), F.col(by).alias("what")).agg(F.count("*").alias("n")) for name, df, by in (("readings", readings, "source"), ("measurements", measurements, "pollutant"))]
    return of[0].unionByName(of[1])


@query(_MADE + """SELECT m.monitor_id, m.recorded_at, c.pollutant, round(c.value, 6) AS value, x.aqi_value FROM made m JOIN collapsed c USING (monitor_id, recorded_at)
  JOIN (SELECT monitor_id, recorded_at, max(sub_index) AS aqi_value FROM indexed WHERE scale = 'naqi' AND pollutant IN ('pm25','pm10','no2','so2') GROUP BY ALL) x USING (monitor_id, recorded_at) WHERE c.pollutant IN ('pm25','pm10','no2','so2')""")
def stored_loads(spark, sf_dir):
    """Half of the stations first, then all of them: every reading and measurement is stored once."""
    root = store.scratch(spark)
    observed = jobs.candidates(view(spark, sf_dir, "obs").withColumn("monitor_id", F.col("location_id")))
    for part in (observed.where("monitor_id % 2 = 0"), observed):
        jobs.load(part, root, "import")
    readings, measurements = (files.scan_table(spark, root, n) for n in ("readings", "measurements"))
    both = readings.join(measurements.withColumnRenamed("reading_id", "id"), "id")
    return both.select(F.col("monitor_id").cast("long"), "recorded_at", "pollutant", F.round("value", 6).alias("value"), "aqi_value")


@query(f"""{_CHILDREN}, whole AS (SELECT m.reading_id, max(i.sub_index) AS fresh, bool_or(m.pollutant = 'pm25') AS named FROM children m JOIN readings r ON r.id = m.reading_id
  JOIN indexed i ON i.scale = 'naqi' AND i.monitor_id = r.monitor_id AND i.recorded_at = date_trunc('hour', r.recorded_at) AND i.pollutant = m.pollutant GROUP BY m.reading_id)
  SELECT r.id, CASE WHEN w.named THEN w.fresh ELSE r.aqi_value END AS aqi_value FROM readings r LEFT JOIN whole w ON w.reading_id = r.id""")
def stored_rescore(spark, sf_dir):
    """The readings that a batch of fine-particle measurements names get their composite over all their measurements."""
    root = _stored(spark, sf_dir)
    tables.rescore(spark, root, files.scan_table(spark, root, "measurements").where("pollutant = 'pm25'"))
    return files.scan_table(spark, root, "readings").select(F.col("id").cast("long"), "aqi_value")


@query(_MADE + "SELECT m.id AS reading_id, c.pollutant, c.value FROM made m JOIN collapsed c USING (monitor_id, recorded_at) WHERE c.pollutant IN ('pm25','pm10','no2','so2')")
def bucketed_link(spark, sf_dir):
    """The same link of two tables in buckets by monitor and instant, joined without a shuffle."""
    built = jobs.usable(view(spark, sf_dir, "obs").withColumn("monitor_id", F.col("location_id")))
    made = ingest.build_readings(built).select(F.concat_ws(":", "monitor_id", F.unix_timestamp("recorded_at")).alias("id"), *ingest.INSTANT)
    name = f"bucketed_{uuid.uuid4().hex}"
    readings, placed = (tables.bucketed(df, f"{name}_{part}", ingest.INSTANT, 16) for part, df in (("readings", made), ("measurements", ingest.build_measurements(built))))
    return ingest.link_measurements(placed, readings).drop("unit")


@query(f", points(point_id, lat, lng) AS (SELECT DISTINCT location_id, lat, lon FROM sensors WHERE lat IS NOT NULL) SELECT point_id, id FROM ({_FAR}) z WHERE metres <= 10000")
def radius_function(spark, sf_dir):
    """The radius join in SQL, by a table function that is called once for every place of a table; a place's stations are held in arrays of at most 1,000, its readings in arrays too."""
    readings, points = f"readings_{uuid.uuid4().hex}", f"points_{uuid.uuid4().hex}"
    held = geo.held_by_place(_readings(spark, sf_dir).select("id", "latitude", "longitude"), int(spark.conf.get("spark.sql.shuffle.partitions")), "held")
    held.select("latitude", "longitude", F.col("held.id").alias("ids")).createOrReplaceTempView(readings)
    view(spark, sf_dir, "sensors").where("lat is not null").select("location_id", "lat", "lon").distinct().createOrReplaceTempView(points)
    geo.register_radius_function(spark, readings)
    return spark.sql(f"""SELECT point_id, explode(ids) AS id FROM (SELECT explode(p.stations) AS point_id, r.ids FROM (
        SELECT lat, lon, collect_list(location_id) AS stations FROM (SELECT *, (row_number() OVER (PARTITION BY lat, lon ORDER BY location_id) - 1) div 1000 AS part FROM {points})
        GROUP BY lat, lon, part) p, LATERAL readings_within_radius(p.lat, p.lon, 10000D) r)""")


@query("""SELECT id, concat_ws(',', CASE WHEN aqi_value IS NULL THEN 'aqi_value_missing' END, CASE WHEN aqi_value NOT BETWEEN 0 AND 1000 THEN 'aqi_range' END, CASE WHEN latitude NOT BETWEEN -90 AND 90 THEN 'latitude_range' END,
  CASE WHEN longitude NOT BETWEEN -180 AND 180 THEN 'longitude_range' END, CASE WHEN source NOT IN ('user', 'openaq', 'simulated', 'government') THEN 'source_unknown' END,
  CASE WHEN recorded_at > TIMESTAMP '2024-01-30 13:00:00' THEN 'recorded_in_future' END) AS reasons FROM dirty""")
def quarantine(spark, sf_dir):
    """Accepted and rejected rows, parted by one write."""
    accepted, rejected, _ = quality.split_validated(quality.validate_readings(view(spark, sf_dir, "dirty"), AS_OF), store.scratch(spark))
    return accepted.select("id", F.lit("").alias("reasons")).unionByName(rejected.select("id", F.array_join("reasons", ",").alias("reasons")))


@query("""SELECT i.monitor_id, i.recorded_at, max(i.sub_index) AS aqi_value FROM indexed i, (SELECT max(recorded_at) AS last FROM usable WHERE pollutant IN ('pm25','pm10','no2','so2')) t
  WHERE scale = 'naqi' AND pollutant IN ('pm25','pm10','no2','so2') AND i.recorded_at <= t.last - INTERVAL 2 HOUR GROUP BY ALL""")
def stream_composites(spark, sf_dir):
    """Composites of a stream of events: the instants that the watermark has closed, two hours behind the newest."""
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/event[s].parquet")  # a glob, as the table may be a file or a folder
    observed = jobs.candidates(derived(stream, "obs").withColumn("monitor_id", F.col("location_id")))
    path = store.scratch(spark)
    query = whole_instants(observed).writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return ingest.instants(spark.read.schema("monitor_id bigint, recorded_at timestamp, pollutant string, canonical_value double").parquet(f"{path}/rows")).select("monitor_id", "recorded_at", "aqi_value")


@query("""SELECT r.id, c.label, c.color, c.dark = 1 AS dark FROM readings r JOIN cats c ON c.scale = 'epa' AND r.aqi_value BETWEEN c.lo AND c.hi""")
def categories_join(spark, sf_dir):
    """The bands as a dimension table."""
    rows = F.broadcast(aqi.dim_categories(spark).where("scale = 'epa'"))  # six rows
    return _readings(spark, sf_dir).join(rows, F.col("aqi_value").between(F.col("min"), F.col("max"))).select("id", "label", "color", "dark")


@query("SELECT pollutant, CASE WHEN pollutant = 'co' THEN 'mg/m³' ELSE 'µg/m³' END AS unit, CASE pollutant WHEN 'pm25' THEN 'PM2.5' WHEN 'pm10' THEN 'PM10' WHEN 'o3' THEN 'Ozone (O₃)' WHEN 'no2' THEN 'Nitrogen Dioxide (NO₂)' WHEN 'so2' THEN 'Sulphur Dioxide (SO₂)' ELSE 'Carbon Monoxide (CO)' END AS label, count(*) AS n FROM collapsed GROUP BY ALL")
def units_join(spark, sf_dir):
    """Units as a dimension table, and the pollutants' labels."""
    from .config import POLLUTANT_LABELS

    counts = _values_of(spark, sf_dir).groupBy("pollutant").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(aqi.dim_units(spark)), "pollutant").withColumn("label", present.display_label(F.col("pollutant"), POLLUTANT_LABELS))
