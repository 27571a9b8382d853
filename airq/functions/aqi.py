"""Sub-index, composite and category of air quality on either scale, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import CATEGORIES, COMPARED, DARK, DEFAULT_SCALE, MAX_INDEX, MG, POLLUTANTS, PPB_TO_UG, PPM_TO_MG, UG, bands


def _double(value: float) -> Column:
    return F.lit(float(value))


def _line(value: Column, band: tuple[float, float, int, int]) -> Column:
    low, high, i_low, i_high = band
    return _double((i_high - i_low) / (high - low)) * (value - _double(low)) + _double(i_low)


def _place(value: Column, rows: list[tuple[float, float, int, int]], gaps: str) -> Column:
    """The number of the first band that holds the value, else that of the top band; -k for the gap below band k."""
    out = None
    for place, band in enumerate(rows):
        if gaps == "bridge" and place:
            out = out.when((value > _double(rows[place - 1][1])) & (value < _double(band[0])), -place)
        inside = value.between(_double(band[0]), _double(band[1]))
        out = F.when(inside, place) if out is None else out.when(inside, place)
    return out.otherwise(len(rows) - 1)


def sub_index(pollutant: Column, value: Column, scale: str = DEFAULT_SCALE, gaps: str = "reference", strict: bool = False) -> Column:
    """A concentration's index: the first band that holds it, else the top band extended; rounded half up, at most 1000.

    Null for a null or negative value or an unknown pollutant; with ``strict`` the last two fail. With ``gaps`` 'bridge' a
    value between two bands takes the upper one's lowest index instead of the top band's line.
    """
    place, first, table = None, None, []
    for one in POLLUTANTS:
        rows = bands(scale, one)
        here, start = _place(value, rows, gaps), F.lit(len(table))
        place = F.when(pollutant == one, here) if place is None else place.when(pollutant == one, here)
        start_here = (pollutant == one) & (value >= 0)
        first = F.when(start_here, start) if first is None else first.when(start_here, start)
        table += [F.struct(_double((j - i) / (b - a)).alias("slope"), _double(a).alias("low"), _double(i).alias("index")) for a, b, i, j in rows]
    # a line is looked up in a constant array; nothing here is conditional, so the place is found once
    band = F.get(F.array(*table), first + F.abs(place))
    rise = band["slope"] * (value - band["low"])
    raw = (F.when(place < 0, 0.0).otherwise(rise) if gaps == "bridge" else rise) + band["index"]
    known = F.least(F.lit(MAX_INDEX) + first * 0, F.floor(raw + F.lit(0.5))).cast("int")
    if not strict:
        return known
    failing = value.isNotNull() & ((value < 0) | ~pollutant.isin(*POLLUTANTS))
    return F.when(failing, F.raise_error(F.lit("negative concentration or unknown pollutant")).cast("int")).otherwise(known)


def index_of(pollutant: str, value: Column, scale: str = DEFAULT_SCALE, gaps: str = "reference") -> Column:
    """``sub_index`` for one known pollutant: its own six bands alone, so that many of these fit one generated method."""
    rows = bands(scale, pollutant)
    out = F.when(value.between(_double(rows[0][0]), _double(rows[0][1])), _line(value, rows[0]))
    for below, band in zip(rows, rows[1:], strict=False):
        if gaps == "bridge":
            out = out.when((value > _double(below[1])) & (value < _double(band[0])), _double(band[2]))
        out = out.when(value.between(_double(band[0]), _double(band[1])), _line(value, band))
    raw = out.otherwise(_line(value, rows[-1]))
    return F.when(value >= 0, F.least(F.lit(MAX_INDEX), F.floor(raw + F.lit(0.5))).cast("int"))


def strict_sub_index(value: Column, scale: str) -> Column:
    """The older fine-particle bands without rounding or extension; null outside every band."""
    out = None
    for band in COMPARED[scale]:
        inside, index = value.between(_double(band[0]), _double(band[1])), _line(value, band)
        out = F.when(inside, index) if out is None else out.when(inside, index)
    return out


def category(value: Column, scale: str = DEFAULT_SCALE) -> Column:
    """The first category that holds the value, else the last, as a struct(label, color, min, max); null for null."""

    def struct(row: tuple[str, str, int, int]) -> Column:
        return F.struct(*[F.lit(v).alias(n) for v, n in zip(row, ("label", "color", "min", "max"), strict=True)])

    rows = CATEGORIES[scale]
    out = F.when(value.between(rows[0][2], rows[0][3]), struct(rows[0]))
    for row in rows[1:]:
        out = out.when(value.between(row[2], row[3]), struct(row))
    return out.when(value.isNotNull(), struct(rows[-1]))


def color(value: Column, scale: str = DEFAULT_SCALE) -> Column:
    return category(value, scale)["color"]


def label(value: Column, scale: str = DEFAULT_SCALE) -> Column:
    return category(value, scale)["label"]


def text_color(value: Column, scale: str = DEFAULT_SCALE) -> Column:
    """White on the dark categories, else black."""
    return F.when(label(value, scale).isin(*DARK[scale]), "#ffffff").otherwise("#000000")


def composite_array(measurements: Column, scale: str = DEFAULT_SCALE, strict: bool = False) -> Column:
    """The largest sub-index of an array of structs (pollutant, value); null, or with ``strict`` a failure, if it is empty."""
    largest = F.array_max(F.transform(measurements, lambda m: sub_index(m["pollutant"], m["value"], scale)))
    if not strict:
        return largest
    return F.when(F.size(measurements) == 0, F.raise_error(F.lit("no measurements")).cast("int")).otherwise(largest)


def dim_breakpoints(spark: SparkSession) -> DataFrame:
    rows = [(s, p, k, *b) for s in CATEGORIES for p in POLLUTANTS for k, b in enumerate(bands(s, p))]
    return spark.createDataFrame(rows, "scale string, pollutant string, ord int, c_lo double, c_hi double, i_lo int, i_hi int")


def dim_categories(spark: SparkSession) -> DataFrame:
    rows = [(s, k, *c, c[0] in DARK[s]) for s, cs in CATEGORIES.items() for k, c in enumerate(cs)]
    return spark.createDataFrame(rows, "scale string, ord int, label string, color string, min int, max int, dark boolean")


def dim_units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, MG if p == "co" else UG) for p in POLLUTANTS], "pollutant string, unit string")


def sub_index_by_join(df: DataFrame, scale: str = DEFAULT_SCALE) -> DataFrame:
    """``df(pollutant, value, ...)`` with ``sub_index``, by joining the table of bands: the set form of ``sub_index``."""
    rows = dim_breakpoints(df.sparkSession).where(F.col("scale") == scale).drop("scale")  # 36 rows
    top = F.max(F.struct("ord", "c_lo", "c_hi", "i_lo", "i_hi"))
    wide = rows.groupBy("pollutant").agg(F.sort_array(F.collect_list(F.struct("ord", "c_lo", "c_hi", "i_lo", "i_hi"))).alias("bands"), top.alias("top"))
    held = df.join(F.broadcast(wide), "pollutant", "left")
    first = F.try_element_at(F.filter("bands", lambda b: (b["c_lo"] <= F.col("value")) & (F.col("value") <= b["c_hi"])), F.lit(1))
    held = held.withColumn("band", F.coalesce(first, "top"))
    raw = (F.col("band.i_hi") - F.col("band.i_lo")) / (F.col("band.c_hi") - F.col("band.c_lo")) * (F.col("value") - F.col("band.c_lo")) + F.col("band.i_lo")
    index = F.when((F.col("value") >= 0) & F.col("band").isNotNull(), F.least(F.lit(MAX_INDEX), F.floor(raw + F.lit(0.5))).cast("int"))
    return held.withColumn("sub_index", index).drop("bands", "top", "band")


def register_functions(spark: SparkSession) -> None:
    """SQL functions for the session: ``aqi_sub_index_<scale>(pollutant, value)``, ``aqi_label_<scale>(value)`` and ``aqi_to_canonical(pollutant, value, unit)``."""
    gases = " ".join(f"WHEN pollutant = '{p}' AND unit = 'ppb' THEN value * {f}D WHEN pollutant = '{p}' AND unit = 'ppm' THEN value * {f}D * 1000D" for p, f in PPB_TO_UG.items())
    gases += " ".join(f" WHEN pollutant = '{p}' AND unit = 'ppm' THEN value * {f}D WHEN pollutant = '{p}' AND unit = 'ppb' THEN value * {f}D / 1000D" for p, f in PPM_TO_MG.items())
    micro = ", ".join(f"'{p}'" for p in POLLUTANTS if p != "co")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION aqi_to_canonical(pollutant STRING, value DOUBLE, unit STRING) RETURNS DOUBLE RETURN CASE WHEN isnan(value) THEN NULL
      WHEN pollutant IN ({micro}) AND unit = '{UG}' THEN value WHEN pollutant IN ({micro}) AND unit = '{MG}' THEN value * 1000D
      WHEN pollutant = 'co' AND unit = '{MG}' THEN value WHEN pollutant = 'co' AND unit = '{UG}' THEN value / 1000D {gases} END""")
    for scale in CATEGORIES:
        cases = " ".join(
            f"WHEN pollutant = '{p}' THEN CASE {' '.join(f'WHEN value BETWEEN {a}D AND {b}D THEN {(j - i) / (b - a)!r}D * (value - {a}D) + {i}' for a, b, i, j in bands(scale, p))} "
            f"ELSE {(bands(scale, p)[-1][3] - bands(scale, p)[-1][2]) / (bands(scale, p)[-1][1] - bands(scale, p)[-1][0])!r}D * (value - {bands(scale, p)[-1][0]}D) + {bands(scale, p)[-1][2]} END"
            for p in POLLUTANTS
        )
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION aqi_sub_index_{scale}(pollutant STRING, value DOUBLE) RETURNS INT RETURN CASE WHEN value >= 0 THEN CAST(least({MAX_INDEX}, floor(CASE {cases} END + 0.5D)) AS INT) END")
        labels = " ".join(f"WHEN value BETWEEN {low} AND {high} THEN '{name}'" for name, _, low, high in CATEGORIES[scale])
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION aqi_label_{scale}(value DOUBLE) RETURNS STRING RETURN CASE {labels} WHEN value IS NOT NULL THEN '{CATEGORIES[scale][-1][0]}' END")
