"""A parsed query and a schema to one boolean column, score terms and notes.

What is negated is wrapped so that no value is false rather than null; elsewhere null does as false in a filter, and plain
comparisons are pushed down to the scan. A clause that can't run is dropped with a note and the rest runs; if nothing is left the query
is refused, never taken as "everything"."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylark.analysis.analyzers import GAP, TOKENIZERS, analysed, count_of, terms_array
from querylark.functions import names
from querylark.functions.values import condition, ip_key
from querylark.operators.postings import Ask
from querylark.query import dates, ip
from querylark.query.parser import MUST, MUST_NOT, SHOULD, Among, Between, Clause, Everything, Facet, Group, Parsed, QueryRefused, Word
from querylark.schema import BARE, BOOLEAN, BYTES, DATE, F64, FACET, I64, IP, JSON, NUMERIC, RANGED, STRING, TEXT, U64, Field, Schema

MIN_PREFIX = 2


@dataclass
class Leaf:
    """A positive leaf for scoring: text leaves with their terms, others constant."""

    match: Column
    boost: float
    field: str | None = None
    needle: str | None = None
    terms: tuple[str, ...] = ()
    ask: int | None = None  # its number among the asks of an inverted index


@dataclass
class Compiled:
    match: Column
    leaves: list[Leaf]
    notes: list[str]
    elements: list[tuple[str, Callable[[Column], Column]]]  # tests of one element of a list field
    narrowed: list[str] | None = None
    exact: list[tuple[str, str]] = field(default_factory=list)  # text fields and the values that must be stored as such
    asks: list[Ask] = field(default_factory=list)


class Source:
    """Where a schema's columns are: analysed text may be stored, under ANALYSED + name, or is computed."""

    ANALYSED = "_terms_"

    def __init__(self, schema: Schema, kinds: dict[str, str]):
        self.schema, self.columns, self.kinds = schema, set(kinds), kinds

    def instant(self, f: Field, seconds: int) -> Column:
        """A date literal of the column's kind, so that neither side is cast and no session time zone matters."""
        if any(k in self.kinds.get(f.name, "") for k in ("ntz", "date")):
            return F.expr(f"TIMESTAMP_NTZ '{dates.rfc3339(seconds)[:-1].replace('T', ' ')}'")
        return F.timestamp_seconds(F.lit(seconds))

    def value(self, f: Field) -> Column:
        return F.col(f"`{f.name}`")

    def text(self, f: Field) -> Column:
        stored = self.ANALYSED + f.name
        return F.col(f"`{stored}`") if stored in self.columns else self.analysed(f)

    def analysed(self, f: Field) -> Column:
        if f.ghost:
            source = self.schema.get(f.ghost.source)
            text = analysed(self.value(source), f.tokenizer, source.many)
            if f.ghost.when is None:
                return text
            by = self.schema.get(f.ghost.when)
            return F.when(condition(self.value(by), f.ghost.within, f.ghost.outside, by.many), text).otherwise(F.lit(""))
        c = self.value(f)
        if f.type == JSON:
            c = F.translate(c.cast("string"), "\u0001", " ")
        return analysed(c, f.tokenizer, f.many)

    def element(self, f: Field, e: Column) -> Column:
        return F.coalesce(TOKENIZERS[f.tokenizer].column(e), F.lit(""))

    def key(self, f: Field) -> Column:
        """Address keys; of a list an array."""
        return F.transform(self.value(f), ip_key) if f.many else ip_key(self.value(f))


class Compiler:
    def __init__(self, source: Source, exact: bool = False, min_prefix: int = MIN_PREFIX, bare_prefix: bool = True, most_default: int = 64, inverted: bool = False):
        """inverted: text clauses become asks and columns that Postings.flagged() adds; else they read the analysed text."""
        self.asks: list[Ask] | None = [] if inverted else None
        self.source, self.schema, self.exact = source, source.schema, exact
        self.min_prefix, self.bare_prefix = min_prefix, bare_prefix
        self.notes: list[str] = []
        self.elements: list = []
        self.exact_values: list[tuple[str, str]] = []
        self.default, cut = self.schema.searched_by_default(most_default)
        self.narrowed = self.default if cut else None
        self.used_default = False

    def note(self, text: str) -> None:
        if text not in self.notes:
            self.notes.append(text)

    def compile(self, parsed: Parsed) -> Compiled:
        for n in parsed.notes:
            self.note(n)
        if parsed.clause is None:
            raise QueryRefused("the query is empty" + (": " + "; ".join(self.notes) if self.notes else ""))
        got = self.clause(parsed.clause, 1.0, True)
        if got is None:
            raise QueryRefused("no clause of the query can be run: " + "; ".join(self.notes))
        return Compiled(got[0], got[1], self.notes, self.elements, self.narrowed if self.used_default else None, self.exact_values, self.asks or [])

    # ---- structure

    def clause(self, c: Clause, boost: float, positive: bool, required: bool = True) -> tuple[Column, list[Leaf]] | None:
        boost *= c.boost
        if isinstance(c, Group):
            return self.group(c, boost, positive, required)
        if isinstance(c, Everything):
            if self.exact and positive and required:
                self.refuse("`*` names no value")
            return F.lit(True), [Leaf(F.lit(True), boost)]
        if self.exact:
            self.screen(c, positive, required)
        if c.field is None:
            return self.bare(c, boost, positive)
        f = self.resolve(c.field)
        if f is None:
            return None
        got = self.leaf(f, c, boost, positive)
        if got is None:
            return None
        return got.match, [got]

    def group(self, g: Group, boost: float, positive: bool, required: bool) -> tuple[Column, list[Leaf]] | None:
        by: dict[str, list[Column]] = {MUST: [], SHOULD: [], MUST_NOT: []}
        leaves: list[Leaf] = []
        wanted = any(o != MUST_NOT for o, _ in g.parts)
        several = sum(o == SHOULD for o, _ in g.parts) > 1
        for occur, c in g.parts:
            got = self.clause(c, boost, positive and occur != MUST_NOT, required and occur != MUST_NOT and not (occur == SHOULD and several))
            if got is None:
                continue
            by[occur].append(got[0])
            if occur != MUST_NOT:
                leaves += got[1]
        either = lambda cs: reduce(lambda a, b: a | b, cs)
        if by[MUST]:
            match = reduce(lambda a, b: a & b, by[MUST])
        elif by[SHOULD]:
            match = either(by[SHOULD])
        elif by[MUST_NOT] and not wanted:
            match, leaves = F.lit(True), [Leaf(F.lit(True), boost)]
        else:
            return None
        if by[MUST_NOT]:
            match = match & ~F.coalesce(either(by[MUST_NOT]), F.lit(False))
        return match, leaves

    def resolve(self, name: str) -> Field | None:
        f = self.schema.get(name)
        if f is not None and f.shadow:
            f = self.schema.get("id") or replace(f, name="id", type=STRING)
        if f is None and name == "id":
            return Field("id", STRING)
        if f is None:
            head = self.schema.get(name.split(".")[0])
            if head is not None and head.type == JSON:
                self.note(f"'{name}': paths into json field '{head.name}' can't be searched; search the field for a word of its value")
            else:
                near = names.suggestions(name, [x.name for x in self.schema.fields if x.indexed])
                self.note(f"no field '{name}'" + (f"; similar: {', '.join(near)}" if near else ""))
            return None
        if not f.indexed and not f.shadow:
            ghosts = [g.name for g in self.schema.fields if g.ghost and g.ghost.source == name]
            self.note(f"field '{name}' isn't searchable" + (f"; its text is searched by {', '.join(ghosts)}" if ghosts else ""))
            return None
        return f

    def bare(self, c: Clause, boost: float, positive: bool) -> tuple[Column, list[Leaf]] | None:
        if not isinstance(c, Word):
            self.note("a range or set needs a field")
            return None
        self.used_default = True
        if c.prefix and not c.quoted and not self.bare_prefix:
            self.note(f"'{c.text}*': a prefix without a field isn't expanded here; '{c.text}' is matched as a word")
            c = replace(c, prefix=False)
        if c.starred:
            self.note(f"'{c.text}': only a star at the end is a prefix; the rest is matched as written")
        found: list[Leaf] = []
        held, self.notes = self.notes, []
        for name in self.default:
            got = self.leaf(self.schema.get(name), c, boost, positive)
            if got is not None:
                found.append(got)
        own, self.notes = self.notes, held
        if ip.key(c.text) or ip.block(c.text):
            for f in self.schema.fields:
                if f.type == IP and f.indexed:
                    got = self.leaf(f, c, boost, positive)
                    found.append(got)
        if not found:
            for n in own or [f"'{c.text}' reaches no field that is searched by default"]:
                self.note(n)
            return None
        for n in own:
            if "star" in n or "shorter" in n:
                self.note(n)
        return reduce(lambda a, b: a | b, [x.match for x in found]), found

    # ---- leaves

    def leaf(self, f: Field, c: Clause, boost: float, positive: bool) -> Leaf | None:
        if isinstance(c, Word) and c.prefix and not c.text:
            self.note(f"'{f.name}:*': whether a field has a value can't be asked; name a value or a bounded range")
            return None
        if isinstance(c, Between) and c.low is None and c.high is None:
            self.note(f"'{f.name}:[* TO *]' only asks whether there is a value; bound one side")
            return None
        if isinstance(c, Facet):
            return self.facet(f, c, boost)
        if isinstance(c, Word):
            if c.starred and c.field is not None:
                self.note(f"'{f.name}:{c.text}': only a star at the end is a prefix; the rest is matched as written")
            return self.text_word(f, c, boost, positive) if f.type in (TEXT, JSON) else self.value_word(f, c, boost, positive)
        if isinstance(c, Among):
            return self.among(f, c, boost, positive)
        return self.between(f, c, boost, positive)

    def tested(self, f: Field, positive: bool, test: Callable[[Column], Column]) -> None:
        if positive and f.type not in (JSON, BYTES, FACET):
            source = self.schema.get(f.ghost.source) if f.ghost else f
            if source.many:
                self.elements.append((source.name, test))

    def asked(self, a: Ask, boost: float, scored: bool = False) -> Leaf:
        if a not in self.asks:
            self.asks.append(a)
        k = self.asks.index(a)
        return Leaf(F.coalesce(F.col(f"_tf_{k}") > 0, F.lit(False)), boost, a.field if scored else None, None, a.terms if scored else (), k)

    def text_word(self, f: Field, c: Word, boost: float, positive: bool) -> Leaf | None:
        terms = TOKENIZERS[f.tokenizer].terms(c.text)
        if not terms:
            self.note(f"'{f.name}:{c.text}' holds no word that the field's tokenizer keeps")
            return None
        prefix = c.prefix
        if prefix and not c.quoted:
            if len(c.text) < self.min_prefix:
                self.note(f"'{f.name}:{c.text}*': a prefix shorter than {self.min_prefix} characters is matched as that word")
                prefix = False
            elif len(terms) > 1:
                self.note(f"'{f.name}:{c.text}*' is several words for the field's tokenizer, so it is matched without the star")
                prefix = False
        if prefix and c.quoted and len(terms) < 2:
            self.note(f"'\"{c.text}\"*': a phrase prefix needs two words or more")
            return None
        if len(terms) > 1 and not f.positions:
            self.note(f"field '{f.name}' keeps no word positions, so it has no phrases")
            return None
        if c.slop and len(terms) > 1:
            match = lambda x: near(x, terms, c.slop)
            self.tested(f, positive, lambda e: match(self.source.element(f, e)))
            if self.asks is not None:
                return self.asked(Ask(f.name, tuple(terms), slop=c.slop), boost, True)
            return Leaf(match(self.source.text(f)), boost, f.name, None, tuple(terms))
        needle = " " + "  ".join(terms) + ("" if prefix else " ")
        self.tested(f, positive, lambda e: F.contains(self.source.element(f, e), F.lit(needle)))
        if self.exact and f.type == TEXT:
            self.exact_values.append((f.name, c.text))
        if self.asks is not None:
            return self.asked(Ask(f.name, tuple(terms), prefix), boost, f.type == TEXT and not prefix)
        s = self.source.text(f)
        return Leaf(F.contains(s, F.lit(needle)), boost, f.name if f.type == TEXT and not prefix else None, needle, tuple(terms))

    def literal(self, f: Field, text: str) -> object | None:
        """A value of the field's type, or None with a note."""
        t, value = f.type, None
        if t in (STRING, TEXT, FACET):
            value = text
        elif t == I64 and re.fullmatch(r"[+-]?\d+", text) and -(1 << 63) <= int(text) < 1 << 63:
            value = int(text)
        elif t == U64 and re.fullmatch(r"\+?\d+", text) and int(text) < 1 << 64:
            value = Decimal(int(text))
        elif t == F64:
            try:
                value = float(text)
            except ValueError:
                value = None
        elif t == BOOLEAN:
            value = {"true": True, "false": False}.get(text)
        elif t == DATE:
            value = dates.parse(text)
        elif t == IP:
            value = ip.key(text)
        elif t == BYTES:
            try:
                value = base64.b64decode(text, validate=True)
            except (binascii.Error, ValueError):
                value = None
        if value is None:
            self.note(f"'{text}' is no {t} value for field '{f.name}'")
        return value

    def compare(self, f: Field, c: Column, op: str, value: object) -> Column:
        """One comparison of a scalar; dates have whole seconds, addresses are compared by key."""
        if f.type == DATE:
            at = lambda s: self.source.instant(f, s)
            if op == "==":
                return (c >= at(value)) & (c < at(value + 1))
            if op == ">":
                return c >= at(value + 1) if value < dates.MOST else F.lit(False)
            if op == "<=":
                return c < at(value + 1) if value < dates.MOST else c.isNotNull()
            if op == "<" and value == dates.LEAST:
                return F.lit(False)
            return c >= at(value) if op == ">=" else c < at(value)
        x = F.lit(value)
        if f.type == U64:
            x = x.cast("decimal(20,0)")
        return {"==": c == x, ">": c > x, ">=": c >= x, "<": c < x, "<=": c <= x}[op]

    def on(self, f: Field, positive: bool, test: Callable[[Column], Column], keyed: bool = False) -> Column:
        """A test of one value, over a scalar or any element of a list."""
        self.tested(f, positive, lambda e: test(ip_key(e) if keyed else e))
        value = self.source.key(f) if keyed else self.source.value(f)
        return F.exists(value, lambda e: F.coalesce(test(e), F.lit(False))) if f.many else test(value)

    def value_word(self, f: Field, c: Word, boost: float, positive: bool) -> Leaf | None:
        if f.type == IP:
            if c.prefix:
                block = ip.prefix_block(c.text)
                self.note(f"'{f.name}:{c.text}*': an address has no prefix" + (f"; the block is {block}" if block else "; name a CIDR block"))
                return None
            if bounds := ip.block(c.text):
                return Leaf(self.on(f, positive, lambda x: x.between(*bounds), True), boost)
        if c.prefix:
            if f.type != STRING:
                self.note(f"'{f.name}:{c.text}*': {f.type} has no prefix")
                return None
            if len(c.text) >= self.min_prefix:
                return Leaf(self.on(f, positive, lambda x: x.startswith(c.text)), boost)
            self.note(f"'{f.name}:{c.text}*': a prefix shorter than {self.min_prefix} characters is matched as that value")
        if f.type == FACET:
            return self.facet(f, Facet(f.name, c.text), boost)
        value = self.literal(f, c.text)
        if value is None:
            return None
        return Leaf(self.on(f, positive, lambda x: self.compare(f, x, "==", value), f.type == IP), boost)

    def facet(self, f: Field, c: Facet, boost: float) -> Leaf | None:
        if f.type != FACET:
            if len(c.path) > 1 and c.path.endswith("/") or f.type in (TEXT, STRING) and c.path.count("/") >= 2 and not f.type == STRING:
                self.note(f"'{f.name}:{c.path}': regular expressions are disabled")
                return None
            return self.leaf(f, Word(c.path, c.field, boost=c.boost), boost, True)
        path = "/" + c.path.strip("/")
        if path == "/":
            return Leaf(self.on(f, False, lambda x: x.isNotNull()), boost)
        return Leaf(self.on(f, False, lambda x: (x == path) | x.startswith(path + "/")), boost)

    def among(self, f: Field, c: Among, boost: float, positive: bool) -> Leaf | None:
        if f.type == JSON and c.field and "." in c.field:
            return None
        if f.type in (TEXT, JSON):
            kept = []
            for v in c.values:
                terms = TOKENIZERS[f.tokenizer].terms(v)
                if len(terms) != 1:
                    self.note(f"'{v}' in a set on '{f.name}' isn't one word for the field's tokenizer")
                else:
                    kept.append(terms[0])
            if not kept:
                return None
            any_of = lambda s: reduce(lambda a, b: a | b, [F.contains(s, F.lit(f" {t} ")) for t in dict.fromkeys(kept)])
            self.tested(f, positive, lambda e: any_of(self.source.element(f, e)))
            if self.asks is not None:
                return self.asked(Ask(f.name, tuple(dict.fromkeys(kept)), any_of=True), boost)
            return Leaf(any_of(self.source.text(f)), boost)
        if f.type in (IP, FACET, BYTES):
            if f.type == BYTES:
                self.note(f"field '{f.name}' of type {f.type} takes no set")
                return None
        values = [v for v in (self.literal(f, v) for v in c.values) if v is not None]
        if not values:
            return None
        if f.type == DATE:
            return Leaf(self.on(f, positive, lambda x: reduce(lambda a, b: a | b, [self.compare(f, x, "==", v) for v in values])), boost)
        return Leaf(self.on(f, positive, lambda x: x.isin(*values), f.type == IP), boost)

    def between(self, f: Field, c: Between, boost: float, positive: bool) -> Leaf | None:
        if f.type not in RANGED:
            self.note(f"field '{f.name}' of type {f.type} takes no range or comparison")
            return None
        bounds: list[tuple[str, object]] = []
        for text, inclusive, sign in ((c.low, c.with_low, ">"), (c.high, c.with_high, "<")):
            if text is None:
                continue
            if f.type == TEXT:
                terms = TOKENIZERS[f.tokenizer].terms(text)
                if len(terms) > 1:
                    self.note(f"'{text}' as a bound on '{f.name}' isn't one word for the field's tokenizer")
                    return None
                value = terms[0] if terms else ""
            else:
                value = self.literal(f, text)
            if value is None:
                return None
            bounds.append((sign + "=" * inclusive, value))
        if f.type == IP and len(bounds) == 1 and ip.is_v4(bounds[0][1]):
            bounds.append(("<=", ip.V4_HIGH) if bounds[0][0][0] == ">" else (">=", ip.V4_LOW))

        def inside(x: Column) -> Column:
            plain = {">": lambda v: x > F.lit(v), ">=": lambda v: x >= F.lit(v), "<": lambda v: x < F.lit(v), "<=": lambda v: x <= F.lit(v)}
            tests = [plain[op](v) if f.type in (TEXT, STRING, IP) else self.compare(f, x, op, v) for op, v in bounds]
            return reduce(lambda a, b: a & b, tests)

        if f.type == TEXT:
            any_term = lambda s: F.exists(terms_array(s), inside)
            self.tested(f, positive, lambda e: any_term(self.source.element(f, e)))
            if self.asks is not None:
                return self.asked(Ask(f.name, bounds=tuple(bounds)), boost)
            return Leaf(any_term(self.source.text(f)), boost)
        return Leaf(self.on(f, positive, inside, f.type == IP), boost)

    # ---- exact mode: what may be deleted by

    def refuse(self, why: str) -> None:
        raise QueryRefused(f"documents can't be deleted by this query: {why}")

    def screen(self, c: Clause, positive: bool, required: bool) -> None:
        if c.field is None:
            self.refuse("every clause has to name its field")
        f = self.schema.get(c.field)
        if f is None and c.field != "id":
            self.refuse(f"no field '{c.field}'")
        kind = f.type if f else STRING
        if f is not None and (f.ghost or kind in (JSON, BYTES, FACET)):
            self.refuse(f"'{c.field}' is {'a ghost' if f.ghost else kind}")
        if isinstance(c, Word) and (c.prefix or c.slop or c.starred):
            self.refuse("prefixes, stars and slop aren't exact")
        if isinstance(c, Between) and (c.field == "id" or f and f.shadow):
            self.refuse("ids have no ranges here")
        if kind == TEXT and not (f and f.shadow):
            if not (isinstance(c, Word) and c.quoted and positive and required):
                self.refuse(f"text field '{c.field}' needs a required quoted phrase, which is then compared with the stored value")


def near(s: Column, terms: list[str], slop: int) -> Column:
    """Terms within a phrase of at most `slop` extra words; for two terms, a transposition costs 2."""
    quoted = [re.escape(t) for t in terms]
    forward = quoted[0] + " " + "".join(f"(?: (?!\u0001)\\S+ ){{0,{slop}}} {q} " for q in quoted[1:])
    match = s.rlike(" " + forward)
    if len(terms) == 2 and slop >= 2:
        match = match | s.rlike(f" {quoted[1]} (?: (?!\u0001)\\S+ ){{0,{slop - 2}}} {quoted[0]} ")
    if len(terms) > 2:
        match = match & _total(s, terms, slop)
    return match


def _total(s: Column, terms: list[str], slop: int) -> Column:
    """Whether the terms stand in order with at most `slop` words between them in all."""
    tokens = F.split(F.trim(s), r"\s+")

    def from_(i: Column) -> Column:
        at = F.lit(i)
        for t in terms[1:]:
            step = F.array_position(F.slice(tokens, at + 2, F.lit(slop + 1)), F.lit(t))
            at = F.when((at >= 0) & (step > 0), at + step.cast("int")).otherwise(F.lit(-1))
        return (at >= 0) & (at - i <= len(terms) - 1 + slop)

    return F.exists(F.filter(F.transform(tokens, lambda t, i: F.when(t == terms[0], i)), lambda i: i.isNotNull()), from_)


def exact_stored(source: Source, pairs: list[tuple[str, str]]) -> Column:
    """Whether each named text field holds the value as such, alone or as an element."""
    tests = []
    for name, value in pairs:
        f = source.schema.get(name)
        c = source.value(f)
        tests.append(F.coalesce(F.array_contains(c, value) if f.many else c == value, F.lit(False)))
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def occurrences(s: Column, leaf: Leaf) -> Column:
    if leaf.needle is not None:
        return count_of(s, leaf.needle)
    return F.when(leaf.match, F.lit(1)).otherwise(F.lit(0))


__all__ = ["BARE", "GAP", "NUMERIC", "Compiled", "Compiler", "Leaf", "Source", "exact_stored", "near", "occurrences"]
