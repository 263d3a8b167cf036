"""Reshaping of source columns before they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_values(c: Column) -> Column:
    """Values of a JSON object of strings, as a list in the object's order; null if it is none."""
    return F.map_values(F.from_json(c, "map<string,string>"))


def split_list(c: Column, separator: str = ",") -> Column:
    """Trimmed, non-empty parts of a cell."""
    return F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")


def duration_seconds(c: Column) -> Column:
    """mm:ss or hh:mm:ss as seconds; null if it is neither."""
    parts = F.split(c, ":")
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x.try_cast("long"))
    return F.when(c.rlike(r"^\d+(:\d{1,2}){1,2}$"), total)


def date_and_time(day: Column, clock: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), clock))
