"""Pruning by age: what a date field says, what is older than a cutoff, and the table without it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylark.schema import DATE, Schema


def date_fields(schema: Schema) -> list[str]:
    return [f.name for f in schema.fields if f.type == DATE and not f.ghost]


def profile(df: DataFrame, field: str, cutoff: str) -> DataFrame:
    """One row: rows, populated, oldest, newest, before (the cutoff)."""
    c = F.col(f"`{field}`")
    return df.agg(F.count("*").alias("rows"), F.count(c).alias("populated"), F.min(c).alias("oldest"), F.max(c).alias("newest"), F.count_if(c < F.lit(cutoff).cast("timestamp")).alias("before"))


def expired(df: DataFrame, field: str, cutoff: str) -> DataFrame:
    return df.filter(F.col(f"`{field}`") < F.lit(cutoff).cast("timestamp"))


def prune(df: DataFrame, field: str, cutoff: str) -> DataFrame:
    """What stays: rows from the cutoff on and rows without a date."""
    c = F.col(f"`{field}`")
    return df.filter(c.isNull() | (c >= F.lit(cutoff).cast("timestamp")))
