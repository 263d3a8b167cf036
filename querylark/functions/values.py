"""Dates, addresses, booleans, lists and shapes of cells, as columns that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylark.query import dates
from querylark.query.ip import V4


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


# ---- dates

_CLOCK = r"( \d{1,2}:\d{2}(:\d{2})?)?"
_YEAR_FIRST = r"^\d{4}([-/.])\d{1,2}\1\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
MONTH_FIRST, DAY_FIRST = "month", "day"


def parse_date(c: Column, slash: str = MONTH_FIRST, dot: str = DAY_FIRST) -> Column:
    """Timestamp of a date cell in any accepted form, whole seconds, clamped; null if it is none. The order of slash and dot dates
    is the column's (see date_orders)."""
    t = F.trim(c)
    at = lambda text, *forms: F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])
    year_first = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "$1-$2-$3"), "T", " "), r"\.\d+$", "")
    full = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(t), r"(:\d{2})\.\d+", "$1"), r"^(.{10})[T ]", "$1 "), "Z$", "+00:00")
    mail = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3}, ", ""), r"(GMT|UT|Z)$", "+0000")
    slashes = ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss") if slash == MONTH_FIRST else ("d/M/yyyy", "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss")
    dots = ("d.M.yyyy", "d.M.yyyy H:mm", "d.M.yyyy H:mm:ss") if dot == DAY_FIRST else ("M.d.yyyy", "M.d.yyyy H:mm", "M.d.yyyy H:mm:ss")
    digits = F.length(t)
    found = (
        F.when(full.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[+-]\d{2}:\d{2}$"), F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm:ssXXX")))
        .when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))
        .when(t.rlike(_YEAR_FIRST), at(year_first, "yyyy-M-d", "yyyy-M-d H:mm", "yyyy-M-d H:mm:ss"))
        .when(t.rlike(rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}{_CLOCK}$"), at(t, *slashes))
        .when(t.rlike(rf"^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}{_CLOCK}$"), at(t, *dots))
        .when(t.rlike(r"^[A-Za-z]{3,9} \d{1,2},? \d{4}$"), at(F.initcap(F.replace(t, F.lit(","), F.lit(""))), "MMM d yyyy", "MMMM d yyyy"))
        .when(t.rlike(r"^\d{1,2} [A-Za-z]{3,9} \d{4}$"), at(F.initcap(t), "d MMM yyyy", "d MMMM yyyy"))
        .when(t.rlike(r"^\d+$"), F.when(digits == 8, F.try_to_timestamp(t, F.lit("yyyyMMdd"))).when(digits == 14, F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss"))).when(digits == 12, F.try_to_timestamp(t, F.lit("yyyyMMddHHmm")))
              .when(digits.isin(10, 11) & F.expr("1=1") & t.try_cast("bigint").between(946_684_800, 10_000_000_000), F.timestamp_seconds(t.try_cast("bigint"))).when(digits == 4, F.try_to_timestamp(t, F.lit("yyyy"))))
        .when(t.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM")))
    )
    return let(found, clamp_date)


def clamp_date(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(F.date_trunc("second", c), F.timestamp_seconds(F.lit(dates.LEAST))), F.timestamp_seconds(F.lit(dates.MOST))))


def out_of_range(c: Column) -> Column:
    """Whether a timestamp lies where dates are clamped."""
    return F.coalesce(~F.unix_timestamp(c).between(dates.LEAST, dates.MOST), F.lit(False))


def epoch_date(c: Column) -> Column:
    """A number is seconds, never milliseconds."""
    return clamp_date(F.timestamp_seconds(c))


def order_evidence(c: Column) -> dict[str, Column]:
    """Aggregates: how many cells only one order of day and month can read, by separator."""
    out = {}
    for name, sep in (("slash", "/"), ("dot", r"\.")):
        form = rf"^(\d{{1,2}}){sep}(\d{{1,2}}){sep}\d{{4}}"
        of = lambda i, form=form: F.when(c.rlike(form), F.regexp_extract(c, form, i).cast("int"))  # noqa: E731  a failed cast costs an exception
        first, second = of(1), of(2)
        out[f"{name}_day"] = F.count_if((first > 12) & (first <= 31) & (second <= 12))
        out[f"{name}_month"] = F.count_if((second > 12) & (second <= 31) & (first <= 12))
    return out


def date_orders(evidence: dict[str, int]) -> tuple[str, str] | None:
    """Orders of slash and dot dates; None if one separator has cells of both orders."""
    if evidence["slash_day"] and evidence["slash_month"] or evidence["dot_day"] and evidence["dot_month"]:
        return None
    return DAY_FIRST if evidence["slash_day"] else MONTH_FIRST, MONTH_FIRST if evidence["dot_month"] else DAY_FIRST


# ---- addresses

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _v4_hex(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, r"\."), lambda x: F.lpad(F.lower(F.hex(x.try_cast("int"))), 2, "0")), "")


def ip_key(c: Column) -> Column:
    """32 hexadecimal digits of an address, IPv4 mapped into IPv6; null if it is none. No Python: `::` is filled with zero groups."""

    def six(t: Column) -> Column:
        tail = F.regexp_extract(t, rf"({_V4})$", 1)
        hexed = _v4_hex(tail)
        plain = F.when(tail != "", F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(tail)), F.substring(hexed, 1, 4), F.lit(":"), F.substring(hexed, 5, 4))).otherwise(t)

        def filled(p: Column) -> Column:
            halves = F.split(p, "::", -1)
            part = lambda h: F.filter(F.split(h, ":", -1), lambda g: g != "")

            def joined(x: Column) -> Column:
                gap = F.when(x["n"] == 2, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(x["a"]) - F.size(x["b"]), F.lit(0)))).otherwise(F.array().cast("array<string>"))
                groups = F.concat(x["a"], gap, x["b"])
                good = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & (x["n"] <= 2) & ~p.rlike("^:[^:]|[^:]:$|:::") & ((x["n"] == 1) | (F.size(x["a"]) + F.size(x["b"]) < 8))
                return F.when(good, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))

            empty = F.array().cast("array<string>")
            return let(F.struct(F.size(halves).alias("n"), part(F.get(halves, F.lit(0))).alias("a"), F.coalesce(part(F.get(halves, F.lit(1))), empty).alias("b")), joined)

        return let(plain, filled)

    low = F.lower(F.trim(c))
    return F.when(low.rlike(f"^{_V4}$"), F.concat(F.lit(V4), _v4_hex(low))).when(F.contains(low, F.lit(":")) & low.rlike("^[0-9a-f:.]+$"), let(low, six))


# ---- cells

MISSING = ("na", "n/a", "#n/a", "nan", "null", "none", "nil", "-")
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "1"), ("false", "no", "n", "0")
SHAPES = ("empty", "missing", "boolean", "yes/no", "integer", "leading-zero number", "long number", "decimal", "exponent number", "date", "ip", "list", "object", "text")
_LIST = r"""^\[\s*(?:(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[-+0-9.eE]+|None|null|[Tt]rue|[Ff]alse)\s*(?:,\s*|(?=\])))*\]$"""


def is_missing(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*MISSING)


def without_missing(c: Column) -> Column:
    """Null for blank cells and markers of a missing value; not for text columns, where a marker may be a word."""
    return F.when(~is_missing(c) & (F.trim(c) != ""), F.trim(c))


def boolean_word(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin(*TRUE_WORDS), F.lit(True)).when(t.isin(*FALSE_WORDS), F.lit(False))


def shape(c: Column) -> Column:
    """Which of the 14 SHAPES a cell has."""
    t = F.trim(F.coalesce(c, F.lit("")))
    low, bare = F.lower(t), F.regexp_replace(t, "^[+-]", "")
    return (
        F.when(t == "", "empty").when(low.isin(*MISSING), "missing").when(low.isin("true", "false"), "boolean").when(low.isin("yes", "no", "y", "n"), "yes/no")
        .when(t.rlike(_LIST), "list")
        .when(bare.rlike(r"^\d+$"), F.when(bare.rlike(r"^0\d"), "leading-zero number").when(F.length(bare) > 15, "long number").otherwise("integer"))
        .when(bare.rlike(r"^(\d+\.?\d*|\.\d+)$"), "decimal").when(bare.rlike(r"^(\d+\.?\d*|\.\d+)[eE][+-]?\d+$") & (F.abs(t.try_cast("double")) < float("inf")), "exponent number")
        .when(t.rlike(r"^\{.*\}$") & F.try_parse_json(t).isNotNull(), "object")
        .when(t.rlike(r"\d") & F.coalesce(parse_date(t), parse_date(t, DAY_FIRST, MONTH_FIRST)).isNotNull(), "date")
        .when(t.rlike(r"\d|::") & ip_key(t).isNotNull(), "ip").otherwise("text")
    )


def parse_list(c: Column) -> Column:
    """array<string> of a list written in a cell, as JSON or as Python prints it; null if it is none or nested."""
    t = F.trim(c)
    single = F.regexp_replace(F.regexp_replace(t, r'(?<!\\)"', '\\\\"'), r"(?<=[\[,\s])'((?:[^'\\]|\\.)*)'(?=\s*[,\]])", '"$1"')
    repaired = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(single, r"\\'", "'"), r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.when(t.rlike(_LIST), F.coalesce(F.from_json(t, "array<string>"), F.from_json(repaired, "array<string>")))


def typed(c: Column, kind: str) -> Column:
    """A cell by a declared type: trimmed, blank and missing are null except in text, what doesn't fit is null."""
    t = without_missing(c)
    if kind in ("text", "json", "facet"):
        return F.when(F.trim(c) != "", F.trim(c))
    if kind == "string":
        return F.when(F.trim(c) != "", F.trim(c))
    if kind == "i64":
        return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))
    if kind == "u64":
        return F.when(t.rlike(r"^\+?\d+$"), t.try_cast("decimal(20,0)"))
    if kind == "f64":
        return t.try_cast("double")
    if kind == "boolean":
        return boolean_word(t)
    if kind == "date":
        return parse_date(t)
    if kind == "ip":
        return F.when(ip_key(t).isNotNull(), t)
    if kind == "bytes":
        return F.try_to_binary(t, F.lit("base64"))
    raise ValueError(kind)


def json_value(c: Column, kind: str) -> Column:
    """A JSON value (variant) by a declared type: "12" and 12.0 are 12 for i64, "TRUE" is true, a number is text in a text field, an object
    or list its JSON; null if it doesn't fit."""
    text = F.when(F.schema_of_variant(c).rlike("^(OBJECT|ARRAY)"), F.to_json(c)).otherwise(F.try_variant_get(c, "$", "string"))
    if kind in ("text", "string", "json", "facet"):
        return text
    if kind in ("i64", "u64"):
        return typed(F.regexp_replace(text, r"^([+-]?\d+)\.0+$", "$1"), kind)
    return typed(text, kind)


def bytes_of(c: Column) -> Column:
    """Binary of an array of numbers, all from 0 to 255 or null."""
    good = F.forall(c, lambda x: x.between(0, 255) & x.isNotNull())
    return F.when(good, F.unhex(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")), "")))


def is_facet(c: Column) -> Column:
    return c.rlike(r"^/(?:[^/\s]+(?:/[^/\s]+)*)?$")


def condition(c: Column, within: tuple | None, outside: tuple | None, many: bool) -> Column:
    """A ghost's condition: among the values, or the exact complement, where a missing value is not among them."""
    values = within if within is not None else outside
    found = F.arrays_overlap(c, F.array(*map(F.lit, values))) if many else c.isin(*values)
    found = F.coalesce(found, F.lit(False))
    return found if within is not None else ~found
