"""Hits: arrays cut at any depth, matched elements first, and a cap on a response's bytes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITIONS_SHOWN = 100
_ACCOUNT = "array<struct<path:string,size:int>>"


def _nothing() -> Column:
    return F.array().cast(_ACCOUNT)


def cut(c: Column, kind: T.DataType, most: int, path: Column) -> tuple[Column, Column]:
    """The value with each array cut to `most` elements, and what was cut: paths with their full sizes."""
    if isinstance(kind, T.StructType):
        parts = [(f.name, *cut(c[f.name], f.dataType, most, F.concat(path, F.lit("." + f.name)))) for f in kind.fields]
        if not parts:
            return c, _nothing()
        return F.when(c.isNotNull(), F.struct(*[v.alias(n) for n, v, _ in parts])), F.when(c.isNotNull(), F.concat(*[a for _, _, a in parts])).otherwise(_nothing())
    if not isinstance(kind, T.ArrayType):
        return c, _nothing()
    kept = F.slice(c, 1, most) if most else F.slice(c, 1, 0)
    own = F.when(F.size(c) > most, F.array(F.struct(path.alias("path"), F.size(c).alias("size")))).otherwise(_nothing())
    if not isinstance(kind.elementType, (T.ArrayType, T.StructType)):
        return kept, own
    at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
    inner = F.transform(kept, lambda e, i: cut(e, kind.elementType, most, at(i))[0])
    more = F.flatten(F.transform(kept, lambda e, i: cut(e, kind.elementType, most, at(i))[1]))
    return inner, F.when(c.isNotNull(), F.concat(own, more)).otherwise(_nothing())


def matched(c: Column, tests: list[Callable[[Column], Column]]) -> Column:
    """0-based positions of a list's elements that any test takes."""
    test = lambda e: F.coalesce(reduce(lambda a, b: a | b, [t(e) for t in tests]), F.lit(False))
    marked = F.transform(c, lambda e, i: F.when(test(e), i))
    return F.coalesce(F.filter(marked, lambda i: i.isNotNull()), F.array().cast("array<int>"))


def lead(c: Column, positions: Column, most: int) -> Column:
    """A cut list that leads with the matched elements in stored order, then fills up with the rest."""
    every = F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
    order = F.slice(F.concat(positions, F.array_except(every, positions)), 1, most)
    return F.transform(order, lambda i: F.get(c, i))


def shape(df: DataFrame, columns: list[str], most: int, tests: list[tuple[str, Callable[[Column], Column]]], first: bool) -> DataFrame:
    """The columns with arrays cut; _truncated_arrays and _matched_elements (maps, null if empty) where there are arrays."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out, accounts, places = [], [], []
    for n in columns:
        c = F.col(f"`{n}`")
        value, account = cut(c, kinds[n], most, F.lit(n))
        own = [t for name, t in tests if name == n]
        if first and own and isinstance(kinds[n], T.ArrayType):
            at = matched(c, own)
            long = F.size(c) > most
            if most and not isinstance(kinds[n].elementType, (T.ArrayType, T.StructType)):
                value = F.when(long, lead(c, at, most)).otherwise(value)
            shown = F.slice(at, 1, most if most else POSITIONS_SHOWN)
            places.append(F.when(long & (F.size(at) > 0), F.struct(F.lit(n).alias("k"), shown.alias("v"))))
        if isinstance(kinds[n], (T.ArrayType, T.StructType)):
            accounts.append(account)
        out.append(value.alias(n))
    if accounts:
        cut_ = F.concat(*accounts)
        out.append(F.when(F.size(cut_) > 0, F.map_from_entries(cut_)).alias("_truncated_arrays"))
    if places:
        found = F.array_compact(F.array(*places))
        out.append(F.when(F.size(found) > 0, F.map_from_entries(found)).alias("_matched_elements"))
    return df.select(*out)


def cap_bytes(page: DataFrame, order: list[Column], most: int) -> DataFrame:
    """Hits of a page up to `most` bytes of JSON, at least one, with _omitted_hits (the same for each row). A page is bounded by the
    largest window, so its window function sees few rows."""
    w = Window.orderBy(*order)
    sized = page.withColumn("_bytes", F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in page.columns])))).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_at", F.row_number().over(w))
    keep = (F.col("_bytes") <= most) | (F.col("_at") == 1)
    return sized.withColumn("_omitted_hits", F.count_if(~keep).over(Window.partitionBy())).filter(keep).drop("_bytes", "_at")
