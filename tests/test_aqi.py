"""Published values of the two scales."""

import pytest
from pyspark.sql import functions as F

from airq.functions import aqi, geo, present, units

INDEX = [
    ("naqi", "pm25", 30.0, 50), ("naqi", "pm25", 60.0, 100), ("naqi", "pm25", 90.0, 200), ("naqi", "pm25", 120.0, 300), ("naqi", "pm25", 250.0, 400), ("naqi", "pm25", 45.0, 76), ("naqi", "pm25", 75.0, 151),
    ("naqi", "pm25", 500.0, 500), ("naqi", "pm25", 1500.0, 896), ("naqi", "pm25", 3000.0, 1000), ("naqi", "pm10", 350.0, 300), ("naqi", "co", 10.0, 200), ("epa", "pm25", 9.0, 50), ("epa", "pm25", 55.4, 150),
    ("epa", "pm25", 60.0, 154), ("epa", "pm25", 9.05, 144), ("epa", "pm10", 54.5, -111), ("naqi", "pm25", -1.0, None), ("naqi", "lead", 1.0, None), ("naqi", "pm25", None, None),
]


def test_sub_index(spark):
    for scale in ("naqi", "epa"):
        rows = [r for r in INDEX if r[0] == scale]
        df = spark.createDataFrame(rows, "scale string, pollutant string, value double, expected int")
        for found in (df.withColumn("got", aqi.sub_index(F.col("pollutant"), F.col("value"), scale)), aqi.sub_index_by_join(df, scale).withColumnRenamed("sub_index", "got")):
            assert found.where("not got <=> expected").collect() == []


def test_gaps_can_be_bridged(spark):
    df = spark.createDataFrame([("pm25", 9.05), ("pm10", 54.5), ("pm10", 54.0)], "p string, v double")
    assert [r[0] for r in df.select(aqi.sub_index(F.col("p"), F.col("v"), "epa", "bridge")).collect()] == [51, 51, 50]


def test_strict_fails(spark):
    df = spark.createDataFrame([("pm25", -1.0)], "p string, v double")
    with pytest.raises(Exception, match="negative"):
        df.select(aqi.sub_index(F.col("p"), F.col("v"), strict=True)).collect()


@pytest.mark.parametrize("scale,value,label", [("naqi", 0, "Good"), ("naqi", 50, "Good"), ("naqi", 51, "Satisfactory"), ("naqi", 200, "Moderate"), ("naqi", 9999, "Severe"), ("naqi", -1, "Severe"), ("epa", 125, "Unhealthy for Sensitive Groups"), ("epa", 400, "Hazardous")])
def test_category(spark, scale, value, label):
    assert spark.range(1).select(aqi.label(F.lit(value), scale)).first()[0] == label


def test_conversion(spark):
    rows = [("co", 500.0, "ppb", 0.5725), ("no2", 10.0, "ppb", 18.8), ("so2", 0.01, "ppm", 26.2), ("pm25", 0.05, "mg/m³", 50.0), ("pm25", 1.0, "ppb", None), ("co", 1000.0, "µg/m³", 1.0), ("x", 1.0, "ppb", None), ("o3", float("nan"), "ppb", None)]
    df = spark.createDataFrame(rows, "p string, v double, u string, expected double")
    for r in df.withColumn("got", units.convert_to_canonical(F.col("p"), F.col("v"), F.col("u"))).collect():
        assert (r.got is None and r.expected is None) or abs(r.got - r.expected) < 1e-9, r


def test_composite_of_nothing_is_null(spark):
    df = spark.sql("SELECT CAST(array() AS ARRAY<STRUCT<pollutant: STRING, value: DOUBLE>>) AS m")
    assert df.select(aqi.composite_array(F.col("m"))).first()[0] is None


def test_typed_numbers(spark):
    typed = [("  42", 42), ("12abc", 12), ("12.7", 12), ("-5", None), ("abc", None), ("501", None), ("500", 500), (None, None)]
    df = spark.createDataFrame(typed, "t string, expected int")
    assert df.where(~present.parse_user_aqi(F.col("t")).eqNullSafe(F.col("expected"))).collect() == []


def test_distance(spark):
    d = spark.range(1).select(geo.distance(*[F.lit(x) for x in (28.6139, 77.2090, 28.4595, 77.0266)])).first()[0]
    assert abs(d - 24728.4) < 1
    assert spark.range(1).select(geo.distance(*[F.lit(x) for x in (1.0, 2.0, 1.0, 2.0)])).first()[0] == 0


def test_sql_functions(spark):
    aqi.register_functions(spark)
    assert spark.sql("SELECT aqi_sub_index_naqi('pm25', 45D), aqi_label_epa(160D)").first()[:] == (76, "Unhealthy")
