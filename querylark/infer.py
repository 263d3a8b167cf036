"""What a file's columns are: one aggregate over all columns, then a decision for each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylark.functions import names, values
from querylark.schema import BOOLEAN, DATE, F64, I64, IP, JSON, STRING, TEXT, U64, Field

CATEGORY_DISTINCT, CATEGORY_LENGTH, CATEGORY_REPEATS, KEY_LENGTH = 64, 64, 20, 256
NUMBERS = {"integer", "leading-zero number", "long number", "decimal", "exponent number"}
KEYABLE = {"integer", "leading-zero number", "long number", "exponent number", "text", "date", "ip"}


@dataclass
class Profile:
    name: str
    rows: int
    shapes: dict[str, int]
    distinct: int
    longest: int
    spaced: bool
    least: float | None = None
    most: float | None = None
    orders: tuple[str, str] | None = (values.MONTH_FIRST, values.DAY_FIRST)
    elements: Profile | None = None
    notes: list[str] = field(default_factory=list)

    @property
    def filled(self) -> int:
        return sum(n for s, n in self.shapes.items() if s not in ("empty", "missing"))

    @property
    def seen(self) -> set[str]:
        return {s for s, n in self.shapes.items() if n and s not in ("empty", "missing")}

    @property
    def unique(self) -> bool:
        return 0 < self.rows == self.filled == self.distinct


def profile(df: DataFrame, exact: bool = True) -> list[Profile]:
    """Profiles of string columns. Cells become rows (column, cell); equal ones are counted before and after the shuffle, so that each
    different cell gets its shape once and the distinct values are known from the same rows. exact=False doesn't bring equal cells
    together: shapes are computed for each cell, distinct values estimated, and only (column, shape) is shuffled."""
    columns = df.columns
    cells = [F.col(f"`{c}`").cast("string") for c in columns]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.trim(c).alias("t")) for i, c in enumerate(cells)])).alias("x")).select("x.i", "x.t")
    long = long.groupBy("i", "t").agg(F.count("*").alias("times")) if exact else long.withColumn("times", F.lit(1).cast("long"))
    shaped = long.withColumn("shape", values.shape(F.col("t")))
    t, filled = F.col("t"), ~F.col("shape").isin("empty", "missing")
    number = F.when(F.col("shape").isin("integer", "long number"), t.try_cast("decimal(38,0)"))
    evidence = values.order_evidence(t)
    distinct = F.count_if(filled) if exact else F.approx_count_distinct(F.when(filled, t), 0.01)
    rows = shaped.groupBy("i", "shape").agg(
        F.sum("times").alias("n"), F.max(F.when(filled, F.length(t))).alias("longest"), F.bool_or(filled & t.rlike(r"\s")).alias("spaced"), F.min(number).alias("least"), F.max(number).alias("most"), *[e.alias(k) for k, e in evidence.items()], distinct.alias("distinct")
    ).collect()
    out = []
    for i, name in enumerate(columns):
        own = [r for r in rows if r["i"] == i]
        shapes = dict.fromkeys(values.SHAPES, 0) | {r["shape"]: r["n"] for r in own}
        pick = lambda f, k: f((r[k] for r in own if r[k] is not None), default=None)  # noqa: E731, B023
        p = Profile(name, sum(shapes.values()), shapes, sum(r["distinct"] for r in own), pick(max, "longest") or 0, bool(pick(max, "spaced")), pick(min, "least"), pick(max, "most"), values.date_orders({k: sum(r[k] for r in own) for k in evidence}))
        if p.seen == {"list"}:
            p.elements = profile(df.select(F.explode(values.parse_list(cells[i])).alias(name)), exact)[0]
        out.append(p)
    return out


def decide(p: Profile) -> Field:
    """The first rule that fits gives the type; a type only if every value is of it."""

    def text(why: str) -> Field:
        if 0 < p.distinct <= CATEGORY_DISTINCT and p.longest <= CATEGORY_LENGTH and p.filled >= CATEGORY_REPEATS * p.distinct:
            return Field(p.name, STRING, description=f"category of {p.distinct} values")
        code = p.filled and 2 * p.distinct >= p.filled and not p.spaced and p.longest <= KEY_LENGTH and not p.shapes["date"] and not p.shapes["ip"]
        return Field(p.name, TEXT, tokenizer="raw" if code else "default", description=why)

    s = p.seen
    if not s:
        return text("no values")
    if s == {"list"}:
        f = decide(p.elements)
        return Field(p.name, f.type, many=True, tokenizer=f.tokenizer, description=f.description)
    if s == {"object"}:
        return Field(p.name, JSON)
    if "boolean" in s and s <= {"boolean", "yes/no", "integer"} and ("integer" not in s or p.least >= 0 and p.most <= 1):
        return Field(p.name, BOOLEAN)
    if s <= NUMBERS:
        if "leading-zero number" in s:
            return text("codes with leading zeros")
        if names.id_rank(p.name) < names.UNNAMED and s & {"long number", "exponent number"}:
            return text("an identifier of digits")
        if s & {"decimal", "exponent number"}:
            return Field(p.name, F64)
        if p.most > (1 << 63) - 1 or p.least < -(1 << 63):
            return Field(p.name, U64 if p.least >= 0 and p.most < 1 << 64 else F64)
        return Field(p.name, I64)
    if s == {"date"}:
        return text("dates of both orders") if p.orders is None else Field(p.name, DATE)
    if s == {"ip"}:
        return Field(p.name, IP)
    return text("mixed" if len(s) > 1 else "")


def choose_id(profiles: list[Profile], df: DataFrame | None = None, wanted: list[str] | None = None) -> list[str]:
    """The columns that identify a row: those wanted, `id`, the unique column that is named best, a unique one that looks like a key, a
    unique pair (counted if df is given), or the most distinct key-like column."""
    if wanted:
        return wanted
    keyable = [p for p in profiles if p.seen and p.seen <= KEYABLE]
    for p in keyable:
        if p.name.lower() == "id" and p.unique:
            return [p.name]
    unique = [p for p in keyable if p.unique]
    named = sorted((names.id_rank(p.name), i) for i, p in enumerate(unique) if names.id_rank(p.name) < names.UNNAMED)
    if named:
        return [unique[named[0][1]].name]
    for p in unique:
        if not p.spaced and p.longest <= KEY_LENGTH and not p.shapes["date"] and not p.shapes["ip"]:
            return [p.name]
    if df is not None:
        some = sorted((p for p in keyable if p.filled == p.rows and p.distinct > 1), key=lambda p: (names.id_rank(p.name), -p.distinct))[:6]
        pairs = [(a.name, b.name) for i, a in enumerate(some) for b in some[i + 1 :] if a.distinct * b.distinct >= a.rows]
        for a, b in pairs[:10]:
            if df.groupBy(a, b).count().filter("count > 1").isEmpty():
                return [a, b]
    best = max(keyable, key=lambda p: (p.distinct, -names.id_rank(p.name)), default=None)
    return [best.name] if best else []


def report(profiles: list[Profile]) -> str:
    """For a reader: each column's kinds of values and its type."""
    lines = []
    for p in profiles:
        f = decide(p)
        kinds = " · ".join(f"{s} {n:,}" for s, n in sorted(p.shapes.items(), key=lambda x: -x[1]) if n)
        lines.append(f"{p.name}: {'list of ' * f.many}{f.type}" + (f" ({f.description})" if f.description else "") + f" [{kinds}; {p.distinct:,} distinct]")
    return "\n".join(lines)
