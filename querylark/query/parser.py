"""Query text to clauses. The parser never raises on odd text: what can't be read is dropped with a note; only nesting beyond
MAX_DEPTH is refused."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

MAX_DEPTH = 64
MUST, SHOULD, MUST_NOT = "+", "", "-"


class QueryRefused(ValueError):
    """The query can't be run at all."""


@dataclass(frozen=True)
class Everything:
    boost: float = 1.0


@dataclass(frozen=True)
class Word:
    """A value: bare or quoted, perhaps a prefix, with slop if a phrase."""

    text: str
    field: str | None = None
    quoted: bool = False
    prefix: bool = False
    slop: int = 0
    boost: float = 1.0
    starred: bool = False  # it held a star that is no prefix


@dataclass(frozen=True)
class Between:
    field: str | None
    low: str | None
    high: str | None
    with_low: bool
    with_high: bool
    boost: float = 1.0


@dataclass(frozen=True)
class Among:
    field: str | None
    values: tuple[str, ...]
    boost: float = 1.0


@dataclass(frozen=True)
class Facet:
    field: str
    path: str
    boost: float = 1.0


@dataclass(frozen=True)
class Group:
    parts: tuple  # (occurrence, clause)
    boost: float = 1.0


Clause = Everything | Word | Between | Among | Facet | Group


@dataclass
class Parsed:
    clause: Clause | None
    notes: list[str] = field(default_factory=list)


_END = set(' ()"')
_NUMBER = re.compile(r"\d+(?:\.\d+)?|\.\d+")


class _Reader:
    def __init__(self, text: str):
        self.s, self.i, self.notes = text, 0, []

    def peek(self, n: int = 1) -> str:
        return self.s[self.i : self.i + n]

    def space(self) -> None:
        while self.peek() == " ":
            self.i += 1

    def keyword(self, word: str) -> bool:
        end = self.i + len(word)
        if self.s.startswith(word, self.i) and (end >= len(self.s) or self.s[end] in " (["):
            self.i = end
            self.space()
            return True
        return False

    # query := and_run (OR | adjacent) and_run ...
    def query(self, depth: int, scope: str | None, inner: bool) -> Clause | None:
        if depth > MAX_DEPTH:
            raise QueryRefused(f"the query is nested deeper than {MAX_DEPTH} levels")
        parts: list[tuple[str, Clause]] = []
        explicit = False
        while True:
            self.space()
            if self.i >= len(self.s) or inner and self.peek() == ")":
                break
            if self.peek() == ")":
                self.notes.append("a closing parenthesis without an opening one was skipped")
                self.i += 1
                continue
            if self.keyword("OR") or self.keyword("AND"):
                explicit = True
                continue
            run = self.and_run(depth, scope)
            if run is None:
                continue
            self.space()
            by_or = explicit or self.s.startswith("OR", self.i) and self.s[self.i + 2 : self.i + 3] in (" ", "(")
            occur, clause = run
            if occur == MUST_NOT and by_or and (parts or by_or):
                # `a OR NOT b`: everything but b is added; at the top level the exclusion would hold for all
                occur, clause = SHOULD, Group(((SHOULD, Everything()), (MUST_NOT, clause)))
            parts.append((occur, clause))
            explicit = False
        return self.assembled(parts)

    @staticmethod
    def assembled(parts: list[tuple[str, Clause]]) -> Clause | None:
        if not parts:
            return None
        if len(parts) == 1 and parts[0][0] == SHOULD:
            return parts[0][1]
        return Group(tuple(parts))

    def and_run(self, depth: int, scope: str | None) -> tuple[str, Clause] | None:
        parts = [self.signed(depth, scope)]
        while True:
            here = self.i
            self.space()
            if not self.keyword("AND"):
                self.i = here
                break
            parts.append(self.signed(depth, scope))
        found = [p for p in parts if p is not None]
        if len(parts) == 1:
            return found[0] if found else None
        return (SHOULD, Group(tuple((MUST if o == SHOULD else o, c) for o, c in found))) if found else None

    def signed(self, depth: int, scope: str | None) -> tuple[str, Clause] | None:
        """One clause with its sign; an even number of NOT is none."""
        self.space()
        negated, nots, sign = False, 0, SHOULD
        while True:
            if self.keyword("NOT"):
                nots += 1
                if depth + nots > MAX_DEPTH:
                    raise QueryRefused(f"the query is nested deeper than {MAX_DEPTH} levels")
                negated = not negated
            elif self.peek() in ("+", "-") and self.peek(2)[1:] not in ("", " "):
                if self.peek() == "-":
                    negated = not negated
                elif sign == SHOULD:
                    sign = MUST
                self.i += 1
            else:
                break
        unit = self.unit(depth, scope)
        if unit is None:
            return None
        return (MUST_NOT if negated else sign), unit

    def boosted(self, clause: Clause | None) -> Clause | None:
        if self.peek() == "^":
            m = _NUMBER.match(self.s, self.i + 1)
            if m:
                self.i = m.end()
                return clause and replace(clause, boost=clause.boost * float(m[0]))
            self.i += 1
            self.notes.append("'^' without a number was skipped")
        return clause

    def unit(self, depth: int, scope: str | None) -> Clause | None:
        if self.peek() == "(":
            self.i += 1
            got = self.query(depth + 1, scope, True)
            if self.peek() == ")":
                self.i += 1
            else:
                self.notes.append("an opening parenthesis without a closing one was closed at the end")
            return self.boosted(got)
        name = self.field_name()
        if name is not None and self.peek() == "(":
            return self.unit(depth, name)
        return self.boosted(self.leaf(name if name is not None else scope, name is not None))

    def field_name(self) -> str | None:
        """`name:` before a value, with escapes; a dot is part of the name."""
        j, name = self.i, []
        while j < len(self.s):
            c = self.s[j]
            if c == "\\" and j + 1 < len(self.s):
                name.append(self.s[j + 1])
                j += 2
                continue
            if c == ":":
                if not name:
                    return None
                self.i = j + 1
                if self.peek() == " ":  # `field: IN [..]`, and a value after a space
                    self.space()
                return "".join(name)
            if not (c.isalnum() or c in "_.-@$/"):
                return None
            name.append(c)
            j += 1
        return None

    def word(self, stop: str = "") -> tuple[str, bool, bool]:
        """Text up to a space or a sign of the grammar; whether it ends in an unescaped star, and whether one stands elsewhere."""
        out, ends, inside = [], False, False
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "\\" and self.i + 1 < len(self.s):
                inside |= ends
                ends = False
                out.append(self.s[self.i + 1])
                self.i += 2
                continue
            if c in _END or c in stop or c == "^" and out:
                break
            inside |= ends
            ends = c == "*"
            out.append(c)
            self.i += 1
        text = "".join(out)
        return (text[:-1] if ends else text), ends, inside

    def quoted(self) -> str | None:
        """A quoted text; None, with a note, if it isn't closed."""
        mark, out, j = self.peek(), [], self.i + 1
        while j < len(self.s):
            c = self.s[j]
            if c == "\\" and j + 1 < len(self.s):
                out.append(self.s[j + 1])
                j += 2
                continue
            if c == mark:
                self.i = j + 1
                return "".join(out)
            out.append(c)
            j += 1
        self.notes.append("a quote that isn't closed was skipped")
        self.i += 1
        return None

    def bound(self, stop: str) -> tuple[str | None, bool] | None:
        """A range's bound: (value or None for an open side, whether there was one)."""
        self.space()
        if self.peek() == '"':
            text = self.quoted()
            return None if text is None else (text, True)
        text, star, _ = self.word(stop)
        if star and not text:
            return None, True
        return (text + "*" * star, True) if text else None

    def leaf(self, name: str | None, named: bool) -> Clause | None:
        begin = self.i
        c = self.peek()
        if named and self.keyword("IN"):
            if self.peek() == "[":
                return self.among(name)
            self.i = begin
        elif name is None and self.s.startswith("IN [", self.i):
            self.i += 3
            return self.among(None)
        if c in "[{" and c:
            return self.between(name)
        if c in ("<", ">"):
            self.i += 1
            equal = self.peek() == "="
            self.i += equal
            got = self.bound("")
            if got is None or got[0] is None:
                self.notes.append(f"a comparison without a value was dropped: {self.s[begin : self.i]}")
                return None
            return Between(name, got[0], None, equal, True) if c == ">" else Between(name, None, got[0], True, equal)
        if c in ('"', "'") and c:
            if c == "'" and "'" not in self.s[self.i + 1 :]:
                pass
            else:
                text = self.quoted()
                if text is None:
                    return None
                slop, prefix = 0, False
                if self.peek() == "~" and (m := re.compile(r"\d+").match(self.s, self.i + 1)):
                    slop, self.i = int(m[0]), m.end()
                elif self.peek() == "*":
                    prefix, self.i = True, self.i + 1
                return Word(text, name, quoted=True, prefix=prefix, slop=slop)
        if c == "/" and named:
            end = self.i
            while end < len(self.s) and self.s[end] not in " )^":
                end += 1
            path, self.i = self.s[self.i : end], end
            return Facet(name, path.rstrip("/") or "/")
        if c == "`" or c in "]}" and c:
            self.i += 1
            self.notes.append(f"'{c}' has no meaning here and was skipped")
            return None
        text, star, inside = self.word()
        if not text and star:
            return Everything() if name is None else Word("", name, prefix=True)
        if not text:
            if self.i == begin:
                self.i += 1
            if named:
                self.notes.append(f"field '{name}' has no value and was dropped")
            return None
        return Word(text, name, prefix=star, starred=inside)

    def among(self, name: str | None) -> Clause | None:
        self.i += 1
        values = []
        while True:
            self.space()
            if self.i >= len(self.s):
                self.notes.append("a set that isn't closed was closed at the end")
                break
            if self.peek() == "]":
                self.i += 1
                break
            if self.peek() == '"':
                text = self.quoted()
                if text is not None:
                    values.append(text)
                continue
            text, star, _ = self.word("]")
            if not text and not star:
                self.i += 1
                continue
            values.append(text + "*" * star)
        if not values:
            self.notes.append("an empty set was dropped")
            return None
        return Among(name, tuple(values))

    def between(self, name: str | None) -> Clause | None:
        begin, with_low = self.i, self.peek() == "["
        self.i += 1
        low = self.bound("]}")
        self.space()
        ok = low is not None and self.keyword("TO")
        high = self.bound("]}") if ok else None
        self.space()
        if high is None or self.peek() not in ("]", "}") or not self.peek():
            while self.i < len(self.s) and self.s[self.i] not in "]}":
                self.i += 1
            self.i = min(self.i + 1, len(self.s))
            self.notes.append(f"a range that can't be read was dropped: {self.s[begin : self.i]}")
            return None
        with_high = self.peek() == "]"
        self.i += 1
        return Between(name, low[0], high[0], with_low, with_high)


def fold_space(text: str) -> str:
    return "".join(" " if c.isspace() else c for c in text)


def parse(text: str) -> Parsed:
    r = _Reader(fold_space(text))
    clause = r.query(0, None, False)
    return Parsed(clause, r.notes)


def point_lookup(text: str, names: tuple[str, ...]) -> str | None:
    """The id, if the whole query is one plain `id:value`."""
    name, colon, value = fold_space(text).strip().partition(":")
    if not colon or name not in names or not value or value[0] in "<>[{":
        return None
    plain, i = [], 0
    while i < len(value):
        if value[i] == "\\" and i + 1 < len(value):
            plain.append(value[i + 1])
            i += 2
            continue
        if value[i] in ' "()*^':
            return None
        plain.append(value[i])
        i += 1
    return "".join(plain)


def show(clause: Clause | None) -> str:
    """The clause as normalized query text."""
    if clause is None:
        return ""

    def boost(x: float) -> str:
        return "" if x == 1.0 else f"^{x:g}"

    def value(v: str) -> str:
        return v if re.fullmatch(r"[\w.:/+@-]+", v) and not v.startswith(("+", "-")) else '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'

    name = f"{clause.field}:" if getattr(clause, "field", None) else ""
    if isinstance(clause, Everything):
        return "*" + boost(clause.boost)
    if isinstance(clause, Word):
        text = '"' + clause.text.replace('"', '\\"') + '"' if clause.quoted else clause.text
        return name + text + (f"~{clause.slop}" if clause.slop else "") + "*" * clause.prefix + boost(clause.boost)
    if isinstance(clause, Between):
        low, high = ("*" if b is None else value(b) for b in (clause.low, clause.high))
        return f"{name}{'[' if clause.with_low else '{'}{low} TO {high}{']' if clause.with_high else '}'}{boost(clause.boost)}"
    if isinstance(clause, Among):
        return f"{name} IN [{' '.join(map(value, clause.values))}]{boost(clause.boost)}"
    if isinstance(clause, Facet):
        return f"{name}{clause.path}{boost(clause.boost)}"
    joined = " ".join(("" if o == SHOULD else o) + (f"({show(c)})" if isinstance(c, Group) else show(c)) for o, c in clause.parts)
    return joined + (boost(clause.boost) if clause.boost == 1.0 else "")
