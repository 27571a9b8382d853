"""What a front end shows: markers, badges, series, labels, and what users type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import CATEGORIES, DEFAULT_SCALE
from . import aqi


def parse_user_aqi(text: Column) -> Column:
    """The whole number that a text starts with, if it is between 0 and 500; else null."""
    number = F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int")
    return F.when(number.between(0, 500), number)


def markers(readings: DataFrame, scale: str = DEFAULT_SCALE) -> DataFrame:
    value = F.col("aqi_value")
    return readings.select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lng"), aqi.color(value, scale).alias("color"), aqi.label(value, scale).alias("label"), value.alias("value"), F.col("recorded_at").alias("time"))


def badges(readings: DataFrame, scale: str = DEFAULT_SCALE) -> DataFrame:
    value = F.col("aqi_value")
    return readings.select("id", value.alias("value"), aqi.label(value, scale).alias("label"), aqi.color(value, scale).alias("background"), aqi.text_color(value, scale).alias("text_color"))


def series(readings: DataFrame) -> DataFrame:
    """Points of a chart, oldest first; times are in UTC."""
    return readings.orderBy("recorded_at", "id").select(F.date_format("recorded_at", "MMM d, hh:mm a").alias("time"), F.col("aqi_value").alias("aqi"))


def coord_label(lat: Column, lng: Column, is_station: bool) -> Column:
    place = F.concat(F.lit("("), F.format_number(lat, 2), F.lit(", "), F.format_number(lng, 2), F.lit(")"))
    return F.concat(F.lit("Station readings near " if is_station else "Area readings around "), place)


def display_label(code: Column, labels: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[code]


def monitor_attributes(location_id: Column, name: Column, city: Column) -> list[Column]:
    serial = F.concat(F.lit("openaq:"), location_id.cast("string"))
    notes = F.concat(F.lit("OpenAQ location "), location_id.cast("string"), F.lit(" in "), city)
    return [serial.alias("serial_number"), F.lit("OpenAQ").alias("manufacturer"), F.nullif(F.substring(name, 1, 100), F.lit("")).alias("model"), notes.alias("notes")]


def reference_lines(spark: SparkSession, scale: str = "epa") -> DataFrame:
    """The upper ends of a scale's first four categories."""
    return spark.createDataFrame([(high, name, color) for name, color, _, high in CATEGORIES[scale][:4]], "aqi int, label string, color string")
