"""The station dimension: cities, sensors, monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import TARGET_POLLUTANTS
from ..functions import geo, present, units


def flatten_locations(pages: DataFrame) -> DataFrame:
    """Location pages to ``location_id, name, latitude, longitude, sensors``."""
    return pages.select(F.explode("results").alias("l")).select(
        F.col("l.id").alias("location_id"), "l.name", F.col("l.coordinates.latitude").alias("latitude"), F.col("l.coordinates.longitude").alias("longitude"),
        F.transform("l.sensors", lambda s: F.struct(s["id"].alias("sensor_id"), s["parameter"]["name"].alias("parameter"))).alias("sensors"),
    )


def filter_to_target(locations: DataFrame) -> DataFrame:
    """Locations of a target city with at least one target sensor, and those sensors, their codes normalised."""
    named = F.transform("sensors", lambda s: F.struct(s["sensor_id"].alias("sensor_id"), units.normalize_pollutant(s["parameter"]).alias("parameter")))
    held = locations.withColumn("sensors", F.filter(named, lambda s: s["parameter"].isin(*TARGET_POLLUTANTS)))
    held = held.withColumn("city", geo.which_city(F.col("latitude"), F.col("longitude")))
    return held.where("city is not null and size(sensors) > 0")


def sync_monitors(stations: DataFrame, monitors: DataFrame) -> DataFrame:
    """A monitor row per station, with the id of the monitor of the same serial number or a new one made from it."""
    rows = stations.select("location_id", *present.monitor_attributes(F.col("location_id"), F.col("name"), F.col("city")))
    known = monitors.where("serial_number is not null").groupBy("serial_number").agg(F.min("id").alias("known"))
    return rows.join(known, "serial_number", "left").select(F.coalesce("known", F.sha2("serial_number", 256)).alias("id"), "location_id", "serial_number", "manufacturer", "model", "notes")


def stations_per_city(stations: DataFrame) -> DataFrame:
    return stations.groupBy("city").agg(F.count("*").alias("stations"))


def sensor_total(stations: DataFrame) -> DataFrame:
    return stations.agg(F.sum(F.size("sensors")).alias("sensors"))
