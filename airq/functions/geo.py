"""City boxes and geodesic distances, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import CITIES

#: Parts that the readings of one place are dealt to, and its points before they are put into arrays of at most so many.
SALTS, POINTS_AT_ONCE = 16, 1000
#: Readings of a place that pairs are made of at once; Parquet's writer packs runs of at most 504 values.
READINGS_AT_ONCE = 504
#: The ellipsoid of GPS coordinates.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563


def free_name(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name in taken:
        name += "_"
    return name


def which_city(lat: Column, lng: Column) -> Column:
    """The first city whose box holds the point, edges included; else null."""
    out = None
    for name, lat_low, lng_low, lat_high, lng_high in CITIES:
        inside = lat.between(lat_low, lat_high) & lng.between(lng_low, lng_high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def assign_city(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """The set form of ``which_city``: joins the three boxes and keeps the first."""
    rows = [(k, *c) for k, c in enumerate(CITIES)]
    boxes = df.sparkSession.createDataFrame(rows, "ord int, city string, la double, lo double, lb double, lp double")
    every = boxes.agg(F.sort_array(F.collect_list(F.struct("ord", "city", "la", "lo", "lb", "lp"))).alias("boxes"))  # one row
    holding = F.filter("boxes", lambda b: F.col(lat).between(b["la"], b["lb"]) & F.col(lng).between(b["lo"], b["lp"]))
    return df.crossJoin(F.broadcast(every)).withColumn("city", F.try_element_at(holding, F.lit(1))["city"]).drop("boxes")


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres along the ellipsoid by Lambert's formula."""
    b1, b2 = (F.atan((1 - FLATTENING) * F.tan(F.radians(x))) for x in (lat1, lat2))
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    s = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - F.sin(s)) * F.pow(F.sin(p) * F.cos(q) / F.cos(s / 2), 2)
    y = (s + F.sin(s)) * F.pow(F.cos(p) * F.sin(q) / F.sin(s / 2), 2)
    return F.when(s == 0, 0.0).otherwise(AXIS * (s - FLATTENING / 2 * (x + y)))


def within_box(lat: Column, lng: Column, at: tuple[float, float], radius: float) -> Column:
    """A cheap superset of the points within ``radius``, of plain comparisons on latitude that reach the scan."""
    import math

    high = radius / 110_000
    near = lat.between(at[0] - high, at[0] + high)
    if abs(at[0]) + high < 89:
        wide = high / math.cos(math.radians(abs(at[0]) + high))
        turn = F.pmod(lng - F.lit(at[1]) + 180, F.lit(360.0)) - 180
        near = near & (F.abs(turn) <= wide)
    return near


def readings_within_radius(readings: DataFrame, lat: float, lng: float, radius: float = 5000.0) -> DataFrame:
    """Readings at most ``radius`` metres away, newest first, with their ``distance``."""
    found = readings.where(within_box(F.col("latitude"), F.col("longitude"), (lat, lng), radius))
    found = found.withColumn("distance", distance(F.lit(lat), F.lit(lng), F.col("latitude"), F.col("longitude"))).where(F.col("distance") <= radius)
    return found.orderBy(F.desc("recorded_at"), "id")


def radius_join(points: DataFrame, readings: DataFrame, radius: float) -> DataFrame:
    """Pairs of ``points(point_id, lat, lng)`` and readings at most ``radius`` metres apart, with their ``distance``.

    Distances are taken once for each distinct place of the readings: places and points are joined on grid cells of a
    latitude step no smaller than the radius, where each point stands in its own row of cells and the two beside it, over as
    many columns as the radius spans at its latitude. A place's points are then held in arrays of at most ``POINTS_AT_ONCE``,
    its readings in arrays too, which meet whole; these are dealt by place and a salt and merged with them at every size, so a
    place that holds many readings is not one task, and what is shuffled follows the readings.
    """
    step = radius / 110_000
    row = lambda lat: F.floor(lat / step).cast("int")
    wide = lambda r: F.lit(step) / F.greatest(F.cos(F.radians(F.least(F.lit(89.0), F.abs(r * step) + 2 * step))), F.lit(0.01))
    rows = points.withColumn("row", F.explode(F.sequence(row(F.col("lat")) - 1, row(F.col("lat")) + 1)))
    turns = F.array(*[F.col("lng") + F.lit(t) for t in (-360.0, 0.0, 360.0)])
    rows = rows.withColumn("turned", F.explode(turns)).where(F.abs("turned") <= 180 + 2 * wide(F.col("row")))  # only what crosses the line is turned
    column = F.floor(F.col("turned") / wide(F.col("row"))).cast("int")
    cells = rows.withColumn("column", F.explode(F.sequence(column - 1, column + 1))).drop("turned")
    places = readings.where("latitude is not null and longitude is not null").select("latitude", "longitude").distinct()
    placed = places.withColumn("row", row(F.col("latitude"))).withColumn("column", F.floor(F.col("longitude") / wide(F.col("row"))).cast("int"))
    near = placed.join(cells, ["row", "column"]).withColumn("distance", distance(F.col("lat"), F.col("lng"), F.col("latitude"), F.col("longitude")))
    salt, slot, part, held, rows = (free_name(n, readings, points) for n in ("salt", "slot", "part", "held", "rows"))
    near = near.where(F.col("distance") <= radius).withColumn(slot, F.pmod(F.xxhash64(*points.columns), F.lit(SALTS)))
    standing = F.row_number().over(Window.partitionBy("latitude", "longitude", slot).orderBy("distance"))
    beside = {c: free_name(f"{held}_{c}", readings, points) for c in [*(c for c in points.columns if c not in ("lat", "lng")), "distance"]}  # a reading may have columns of their names
    near = near.withColumn(part, F.floor((standing - 1) / POINTS_AT_ONCE)).groupBy("latitude", "longitude", slot, part).agg(F.collect_list(F.struct(*[F.col(c).alias(n) for c, n in beside.items()])).alias(held))
    near = near.select("latitude", "longitude", held, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    blocks = held_by_place(readings, int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows)
    salted = blocks.withColumn(salt, F.pmod(F.xxhash64(rows), F.lit(SALTS)).cast("int"))
    pairs = salted.join(near.hint("merge"), ["latitude", "longitude", salt]).select("latitude", "longitude", rows, F.inline(held))
    row = free_name("row", readings, points)
    pairs = pairs.select("latitude", "longitude", *beside.values(), F.explode(rows).alias(row))
    return pairs.select(*[c if c in ("latitude", "longitude") else F.col(row)[c].alias(c) for c in readings.columns], *[F.col(n).alias(c) for c, n in beside.items()])


def held_by_place(readings: DataFrame, partitions: int, into: str) -> DataFrame:
    """``latitude, longitude`` and an array ``into`` of the other columns of at most ``READINGS_AT_ONCE`` readings of that place, which are dealt to all partitions by one shuffle.

    Pairs are written by array and point, so that a point stands for a run of readings and the same readings follow for each point: files
    hold both in a fraction of what pairs in the order of readings take.
    """
    key, part = (free_name(n, readings) for n in ("key", "part"))
    rows = F.xxhash64(*readings.columns)
    dealt = readings.withColumn(key, F.xxhash64("latitude", "longitude", F.pmod(rows, F.lit(4 * partitions)))).repartition(partitions, key)
    standing = F.row_number().over(Window.partitionBy(key).orderBy("latitude", "longitude", rows))
    beside = F.struct(*[c for c in readings.columns if c not in ("latitude", "longitude")])
    blocks = dealt.withColumn(part, F.floor((standing - 1) / READINGS_AT_ONCE)).groupBy(key, part, "latitude", "longitude")
    return blocks.agg(F.collect_list(beside).alias(into)).select("latitude", "longitude", into)


def register_radius_function(spark: SparkSession, view: str) -> None:
    """The session's table function ``readings_within_radius(lat, lng, metres)`` over a view of readings: their columns and ``distance``.

    The box stands twice: as a filter, which reaches the scan where the call has constants, and in the distance's own expression,
    as filters on the centre are tested only after the join with the function's callers where the call is ``LATERAL``.
    """
    columns = [(f.name, f.dataType.simpleString()) for f in spark.table(view).schema.fields]
    metres = _distance_sql("center_lat", "center_lng", "r.latitude", "r.longitude")
    box = "r.latitude BETWEEN center_lat - metres / 110000D AND center_lat + metres / 110000D"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION readings_within_radius(center_lat DOUBLE, center_lng DOUBLE, metres DOUBLE)
      RETURNS TABLE({", ".join(f"`{n}` {t}" for n, t in columns)}, distance DOUBLE)
      RETURN SELECT * FROM (SELECT {", ".join(f"r.`{n}`" for n, _ in columns)}, CASE WHEN {box} THEN {metres} END AS distance FROM {view} r WHERE {box}) WHERE distance <= metres""")


def _distance_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """``distance`` as SQL text; lambdas name its parts, so that none is worked out for each of its mentions."""
    b1, b2 = (f"atan({1 - FLATTENING!r}D * tan(radians({x})))" for x in (lat1, lat2))
    h = "pow(sin((v.b - v.a) / 2), 2) + cos(v.a) * cos(v.b) * pow(sin(radians(v.turn) / 2), 2)"
    p, q = "((v.a + v.b) / 2)", "((v.b - v.a) / 2)"
    x = f"((s - sin(s)) * pow(sin({p}) * cos({q}) / cos(s / 2), 2))"
    y = f"((s + sin(s)) * pow(cos({p}) * sin({q}) / sin(s / 2), 2))"
    metres = f"transform(array(2 * asin(least(1D, sqrt({h})))), s -> CASE WHEN s = 0 THEN 0D ELSE {AXIS!r}D * (s - {FLATTENING / 2!r}D * ({x} + {y})) END)[0]"
    return f"transform(array(named_struct('a', {b1}, 'b', {b2}, 'turn', {lng2} - {lng1})), v -> {metres})[0]"
