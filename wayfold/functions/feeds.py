"""Column functions for feed files, where every field is a string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Route types and their mode.
MODE_OF_TYPE = {0: "metro", 1: "bart", 2: "bart", 5: "cable", 3: "bus"}
MODE_CODE = {"metro": 0, "bart": 1, "cable": 2, "bus": 3}


def blank_as_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def seconds(c: Column) -> Column:
    """HH:MM:SS as seconds, hours beyond 24 included; null where a part is missing or no number."""
    part = F.split(F.trim(c), ":")
    h, m, s = (F.try_element_at(part, F.lit(k)).try_cast("long") for k in (1, 2, 3))
    return h * 3600 + m * 60 + s


def strict_seconds(c: Column) -> Column:
    """seconds() of well-formed times only: three whole numbers of any length, minutes and seconds below 60."""
    part = F.split(F.trim(c), ":")
    below = [F.try_element_at(part, F.lit(k)).try_cast("long") < 60 for k in (2, 3)]
    return F.when(F.trim(c).rlike(r"^\d+:\d+:\d+$") & below[0] & below[1], seconds(c))


def patched(arrival: Column, departure: Column) -> tuple[Column, Column]:
    """Each of the two times stands in for the other where one is missing."""
    return F.coalesce(arrival, departure), F.coalesce(departure, arrival)


def display_name(short: Column, long: Column, ident: Column) -> Column:
    return F.coalesce(blank_as_null(short), blank_as_null(long), ident)


def plain_ref(c: Column) -> Column:
    """An id that a float column has spoilt ('8.0') as the integer it was."""
    number = F.trim(c).try_cast("double")
    return F.when(number.isNotNull() & (number == F.floor(number)), number.cast("bigint").cast("string")).otherwise(F.trim(c))


def mode_of(route_type: Column) -> Column:
    out = F.lit("bus")
    for k, v in MODE_OF_TYPE.items():
        out = F.when(route_type.try_cast("int") == k, v).otherwise(out)
    return out


def mode_code(mode: Column) -> Column:
    out = F.lit(MODE_CODE["bus"])
    for k, v in MODE_CODE.items():
        out = F.when(mode == k, v).otherwise(out)
    return out


def weekday_name(day: Column) -> Column:
    return F.lower(F.date_format(day, "EEEE"))


def tolerant_count(c: Column) -> Column:
    """A whole number of at least zero, or null."""
    n = F.trim(c).try_cast("long")
    return F.when(n >= 0, n)


def plain_query(c: Column) -> Column:
    """Search text: trimmed, single spaces, lower case."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
