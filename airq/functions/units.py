"""Pollutant codes, units and times of raw observations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import MG, POLLUTANTS, PPB_TO_UG, PPM_TO_MG, UG


def normalize_pollutant(parameter: Column) -> Column:
    low = F.lower(parameter)
    return F.when(low == "pm2.5", "pm25").otherwise(low)


def canonical_unit(pollutant: Column) -> Column:
    return F.when(pollutant == "co", MG).otherwise(UG)


def _rates() -> dict[str, tuple[float, float, float]]:
    """For each pollutant and unit that converts: what a value is multiplied by, multiplied by again, and divided by, in this order."""
    out = {}
    for p in POLLUTANTS:
        out |= {f"{p}|{MG}": (1.0, 1.0, 1.0), f"{p}|{UG}": (1.0, 1.0, 1000.0)} if p == "co" else {f"{p}|{UG}": (1.0, 1.0, 1.0), f"{p}|{MG}": (1.0, 1000.0, 1.0)}
    out |= {k: v for p, f in PPB_TO_UG.items() for k, v in ((f"{p}|ppb", (f, 1.0, 1.0)), (f"{p}|ppm", (f, 1000.0, 1.0)))}
    return out | {k: v for p, f in PPM_TO_MG.items() for k, v in ((f"{p}|ppm", (f, 1.0, 1.0)), (f"{p}|ppb", (f, 1.0, 1000.0)))}


def convert_to_canonical(pollutant: Column, value: Column, unit: Column) -> Column:
    """The value in its pollutant's canonical unit; null for an unknown pollutant or a unit that does not convert. NaN is null.

    One lookup in a constant map instead of a case for each unit: filters on the result are pushed below the
    projections that derive its inputs, and every mention of an input there repeats how it is derived.
    """
    table = F.create_map(*[x for k, v in _rates().items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rate = table[F.concat(pollutant, F.lit("|"), unit)]
    return F.nanvl(value, F.lit(None).cast("double")) * rate[0] * rate[1] / rate[2]


def canonical_ts(text: Column) -> Column:
    """An ISO time as an instant; the session's zone must be UTC."""
    return F.to_timestamp(text)


def parse_ts_lenient(text: Column) -> Column:
    """As ``canonical_ts``, but null for what is no time."""
    return F.try_to_timestamp(text)


def first_filled(*columns: Column) -> Column:
    """The first of some texts that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def extract_timestamp(measurement: str) -> Column:
    return first_filled(*[F.col(f"{measurement}.{path}.utc") for path in ("period.datetimeFrom", "datetime", "date")])


def extract_unit(measurement: str) -> Column:
    return F.coalesce(first_filled(F.col(f"{measurement}.parameter.units"), F.col(f"{measurement}.unit")), F.lit(""))


def reading_key(monitor_id: Column, ts: Column) -> Column:
    return F.concat_ws(":", monitor_id.cast("string"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX"))
