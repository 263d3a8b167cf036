"""Writes without a MERGE target: every write is appended with a sequence, and readers see the latest row of each id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylark.functions import values
from querylark.schema import BOOLEAN, BYTES, DATE, FACET, IP, JSON, SPARK, STRING, TEXT, Schema

SHOWN_ERRORS = 100


def latest(log: DataFrame, key: str = "id", seq: str = "seq", deleted: str | None = None) -> DataFrame:
    """The last row of each key, less those whose last row is a tombstone. max_by over a struct is combined before the shuffle, so a key
    that is written all the time costs one row a task, not a window's partition."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last")).select(key, "_last.*")
    return last.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else last


def put(table: DataFrame, batch: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """Upsert: rows of the batch replace those of equal key; within the batch the last in order wins. Columns that only one side
    has are null on the other."""
    new = batch.withColumn("_order", order if order is not None else F.monotonically_increasing_id()).withColumn("_new", F.lit(1))
    both = table.withColumn("_order", F.lit(0).cast("long")).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_order", F.col("_order").cast("long")), allowMissingColumns=True)
    return latest(both.withColumn("_seq", F.struct("_new", "_order")), key, "_seq").drop("_seq", "_new", "_order")


def problem(schema: Schema) -> Column:
    """Why a row of strings can't be written, as 'field: reason'; null if it can. Missing values are no problem."""
    tests = [F.when(F.col("id").isNull() | (F.col("id") == ""), F.lit("id: missing"))] if schema.get("id") else []
    for f in schema.fields:
        if f.ghost or f.shadow or f.many or f.type in (TEXT, STRING, JSON):
            continue
        c = F.col(f"`{f.name}`")
        said = F.concat(F.lit(f"{f.name}: '"), c.cast("string"), F.lit(f"' is no {f.type}"))
        bad = ~F.coalesce(values.is_facet(c), F.lit(False)) if f.type == FACET else values.typed(c, f.type).isNull()
        tests.append(F.when(c.isNotNull() & (F.trim(c) != "") & ~values.is_missing(c) & bad, said))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def typed(df: DataFrame, schema: Schema, strict_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of strings by declared types: (good, rejected with _problem). A bad value rejects its row and no other."""
    marked = df.withColumn("_problem", problem(schema)) if strict_ids else df.withColumn("_problem", F.lit(None).cast("string"))
    kept = [f for f in schema.fields if not f.ghost and f.name in df.columns]
    out = []
    for f in kept:
        c = F.col(f"`{f.name}`")
        if f.many:
            one = lambda e, t=f.type: values.typed(e, t)
            v = F.transform(values.parse_list(c), lambda e, t=f.type: values.typed(e, t)) if dict(df.dtypes)[f.name] == "string" else F.transform(c, lambda e: one(e))
        else:
            v = values.typed(c, f.type)
        out.append(v.cast(SPARK[f.type]).alias(f.name) if not f.many else v.alias(f.name))
    rest = [F.col(f"`{c}`") for c in df.columns if schema.get(c) is None]
    return marked.filter("_problem is null").select(*rest, *out), marked.filter("_problem is not null")


def bulk(table: DataFrame, batch: DataFrame, schema: Schema, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(table after the write, rejected rows): bad documents are named, the rest is written."""
    good, bad = typed(batch, schema)
    return put(table, good, "id", order), bad


def errors(rejected: DataFrame) -> dict:
    """The first reasons and how many there are; one bounded collect."""
    shown = [r["_problem"] for r in rejected.select("_problem").limit(SHOWN_ERRORS).collect()]
    n = rejected.count() if len(shown) == SHOWN_ERRORS else len(shown)
    return {"errors": shown, "more": n - len(shown)}


def compose_id(df: DataFrame, columns: list[str]) -> DataFrame:
    """id: the columns' values joined by a bar; null if one is missing."""
    parts = [F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.col(f"`{c}`").cast("string")) for c in columns]
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    return df.withColumn("id", F.when(whole, F.concat_ws("|", *parts)))


def ledger(df: DataFrame, key: str = "id") -> DataFrame:
    """key, n of each id that comes more than once, or is missing."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())


def route(df: DataFrame, shards: int, *keys: str) -> DataFrame:
    """Rows by the first of the keys that has a value, so that equal keys meet in one partition."""
    return df.repartition(shards, F.coalesce(*[F.col(k).cast("string") for k in keys]))


def compact(df: DataFrame, path: str, files: int, codec: str = "zstd") -> None:
    """The table in fewer files, compressed."""
    df.coalesce(files).write.mode("overwrite").option("compression", codec).parquet(path)


def history(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Every version with its rank, the last first."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq))))


__all__ = ["BOOLEAN", "BYTES", "DATE", "IP", "bulk", "compact", "compose_id", "errors", "history", "latest", "ledger", "problem", "put", "route", "typed"]
