"""Views over the given tables that look like the engine's inputs; the same text runs on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_LAT = """CASE user_id % 4 WHEN 0 THEN CAST(28.6139 AS DOUBLE) WHEN 1 THEN CAST(19.0760 AS DOUBLE) WHEN 2 THEN CAST(12.9716 AS DOUBLE) ELSE CAST(22.5726 AS DOUBLE) END
    + CAST(floor((user_id % 12) / 4) AS INT) * CAST(0.02 AS DOUBLE)"""
_LNG = """CASE user_id % 4 WHEN 0 THEN CAST(77.2090 AS DOUBLE) WHEN 1 THEN CAST(72.8777 AS DOUBLE) WHEN 2 THEN CAST(77.5946 AS DOUBLE) ELSE CAST(88.3639 AS DOUBLE) END
    + CAST(floor((user_id % 12) / 4) AS INT) * CAST(0.02 AS DOUBLE)"""

OBS = f"""
SELECT event_id AS obs_id, user_id % 12 AS location_id, user_id AS sensor_id, parameter, units,
  CASE WHEN k = 13 THEN NULL WHEN k = 7 THEN -value WHEN units IN ('mg/m³','ppm') THEN value / 100 ELSE value END AS value,
  date_trunc('hour', ts) AS recorded_at, lat, lon
FROM (SELECT event_id, ts, user_id, value, k,
  CASE event_type WHEN 'click' THEN 'PM2.5' WHEN 'view' THEN 'pm10' WHEN 'purchase' THEN 'no2' WHEN 'signup' THEN 'so2' ELSE CASE WHEN k % 2 = 0 THEN 'o3' ELSE 'CO' END END AS parameter,
  CASE WHEN k % 10 = 9 THEN 'grains/liter' WHEN event_type IN ('click','view') THEN CASE WHEN k % 10 = 0 THEN 'mg/m³' ELSE 'µg/m³' END
       ELSE CASE k % 4 WHEN 0 THEN 'ppb' WHEN 1 THEN 'ppm' WHEN 2 THEN 'µg/m³' ELSE 'mg/m³' END END AS units,
  {_LAT} AS lat, {_LNG} AS lon
 FROM (SELECT *, CAST({{K}} AS INT) AS k FROM {{events}}) e0) e
"""
READINGS = f"""
SELECT event_id AS id, user_id % 50 AS user_id, CASE WHEN event_type = 'signup' THEN NULL ELSE user_id % 12 END AS monitor_id, CAST(floor(value * 2) AS INT) AS aqi_value,
  {_LAT} AS latitude, {_LNG} AS longitude,
  CASE event_type WHEN 'signup' THEN 'user' WHEN 'purchase' THEN 'government' WHEN 'error' THEN 'simulated' ELSE 'openaq' END AS source, ts AS recorded_at
FROM {{events}}
"""
DIRTY = f"""
SELECT r.id, r.user_id, r.monitor_id, CASE WHEN k = 1 THEN r.aqi_value + 2000 WHEN k = 2 THEN NULL ELSE r.aqi_value END AS aqi_value,
  CASE WHEN k = 3 THEN CAST(95 AS DOUBLE) ELSE r.latitude END AS latitude, CASE WHEN k = 4 THEN CAST(-200 AS DOUBLE) ELSE r.longitude END AS longitude,
  CASE WHEN k = 5 THEN 'OpenAQ' ELSE r.source END AS source, r.recorded_at
FROM ({READINGS}) r JOIN (SELECT event_id, CAST({{K}} AS INT) AS k FROM {{events}}) e ON e.event_id = r.id
"""
SENSORS = """
SELECT s_suppkey AS location_id, s_suppkey * 10 + p.ord AS sensor_id, p.parameter,
  CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE CASE s_suppkey % 4 WHEN 0 THEN CAST(28.6139 AS DOUBLE) WHEN 1 THEN CAST(19.0760 AS DOUBLE)
    WHEN 2 THEN CAST(12.9716 AS DOUBLE) ELSE CAST(22.5726 AS DOUBLE) END + (s_suppkey % 25 - 12) * CAST(0.03 AS DOUBLE) END AS lat,
  CASE s_suppkey % 4 WHEN 0 THEN CAST(77.2090 AS DOUBLE) WHEN 1 THEN CAST(72.8777 AS DOUBLE) WHEN 2 THEN CAST(77.5946 AS DOUBLE) ELSE CAST(88.3639 AS DOUBLE) END AS lon
FROM {supplier} CROSS JOIN (VALUES (0,'pm2.5'),(1,'PM10'),(2,'o3'),(3,'no2'),(4,'so2'),(5,'co')) AS p(ord, parameter)
WHERE (s_suppkey + p.ord) % 3 <> 0
"""
ENTRIES = """
SELECT event_id, CASE k % 6 WHEN 0 THEN concat('  ', CAST(k AS VARCHAR(10))) WHEN 1 THEN concat(CAST(k AS VARCHAR(10)), 'abc') WHEN 2 THEN concat('-', CAST(k AS VARCHAR(10)))
  WHEN 3 THEN 'abc' WHEN 4 THEN concat(CAST(k * 10 AS VARCHAR(10)), '.7') ELSE CAST(k AS VARCHAR(10)) END AS txt
FROM (SELECT event_id, CAST({K} AS INT) AS k FROM {events}) e
"""
VIEWS = {"obs": OBS, "readings": READINGS, "dirty": DIRTY, "sensors": SENSORS, "entries": ENTRIES}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view on Spark; times without a zone are instants in the session's zone, UTC."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "supplier") if "{" + t + "}" in VIEWS[name]}
    return derived(tables.get("events"), name, tables.get("supplier"))


def derived(events: DataFrame | None, name: str, supplier: DataFrame | None = None) -> DataFrame:
    """A derived view of given tables, which may be streams."""
    text = VIEWS[name].replace("{K}", "props_k")
    tables = {n: t for n, t in (("events", events), ("supplier", supplier)) if t is not None}
    if "{K}" in VIEWS[name]:  # filters aren't pushed below an exploded column, so the JSON is parsed once a row, not once for each mention
        tables["events"] = tables["events"].select("*", F.explode(F.array(F.get_json_object("props", "$.k").cast("int"))).alias("props_k"))
    df = next(iter(tables.values())).sparkSession.sql(text, **tables)
    return df.withColumn("recorded_at", df["recorded_at"].cast("timestamp")) if "recorded_at" in df.columns else df


def duck(name: str) -> str:
    """A derived view as DuckDB SQL."""
    return VIEWS[name].format(K="json_extract(props,'$.k')", events="events", supplier="supplier")
