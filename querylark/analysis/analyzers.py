"""The closed list of tokenizers.

Analysed text is one string in which every term stands between its own two spaces (" a  b "), so a term is found by contains(" a "), a
phrase by contains(" a  b ") and a prefix by contains(" pre"), without lambdas over arrays. Elements of a list are kept apart by
GAP, which no phrase crosses.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from querylark.analysis import cjk, stemmers

MOST_BYTES = 128
#: Bytes of texts that are held as Python strings at once, and mapped terms in a generation, in each Python worker.
PART_BYTES, MOST_SEEN = 1 << 20, 200_000
GAP = " \u0001 "


def _spaced(lowered: Column) -> Column:
    inner = F.trim(F.regexp_replace(lowered, r"[^\p{L}\p{N}]+", "  "))
    s = F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))
    kept = F.array_join(F.filter(F.split(inner, "  "), lambda t: F.octet_length(t) <= MOST_BYTES), "  ")
    long = F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit(" "), kept, F.lit(" ")))
    return F.when(lowered.rlike(r"[\p{L}\p{N}]{33}"), long).otherwise(s)  # 33 characters may be more than 128 bytes


def plain(text: str) -> list[str]:
    """The default analyzer on the driver, for query terms."""
    out, word = [], []
    for c in text.lower():
        if c.isalnum():
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    if word:
        out.append("".join(word))
    return [w for w in out if len(w.encode()) <= MOST_BYTES]


_SINGLE = {chr(c): b[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if (b := unicodedata.normalize("NFD", chr(c))) and b[0].isascii() and b[0].isalpha()}
_SINGLE |= {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ħ": "h", "ı": "i", "ð": "d"}
_DOUBLE = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij"}


_MARKS = re.compile("(?<=[a-zA-Z])[\u0300-\u036f]+")


def fold(text: str) -> str:
    return _MARKS.sub("", "".join(_DOUBLE.get(c, _SINGLE.get(c, c)) for c in unicodedata.normalize("NFC", text)))


def fold_column(c: Column) -> Column:
    c = F.translate(c, "".join(_SINGLE), "".join(_SINGLE.values()))
    for a, b in _DOUBLE.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, "(?<=[a-zA-Z])[\\u0300-\\u036f]+", "")  # marks of decomposed letters


def _mapped(fn: Callable[[str], str]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """Maps every term of analysed texts, a frequent one once in a task. A batch is mapped in parts of PART_BYTES; of terms two generations
    of at most MOST_SEEN are kept, so memory doesn't grow with the texts."""

    def part(texts: pa.Array, seen: list[dict[str, str]]) -> pa.Array:
        new, old = seen
        done = []
        for s in texts.to_pylist():
            if not s:
                done.append(s)
                continue
            out = []
            for t in s.split():
                if (v := new.get(t)) is None:
                    if (v := old.get(t)) is None:
                        v = fn(t)
                    if len(new) >= MOST_SEEN:
                        old, new = new, {}
                    new[t] = v
                out.append(v)
            done.append(" " + "  ".join(out) + " ")
        seen[:] = new, old
        return pa.array(done, pa.string())

    def mapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: list[dict[str, str]] = [{}, {}]
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b), 0).to_numpy(zero_copy_only=False))
            parts, first = [], 0
            while first < len(b):
                past = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PART_BYTES, "right")))
                parts.append(part(b[first:past], seen))
                first = past
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return mapped


def _by_term(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """An Arrow function that maps every term of analysed text."""
    return F.arrow_udf(_mapped(fn), "string")


@dataclass(frozen=True)
class Analyzer:
    name: str
    column: Callable[[Column], Column]
    terms: Callable[[str], list[str]]
    native: bool = True


def _stemmed(name: str, fn: Callable[[str], str]) -> Analyzer:
    # the Arrow function is made when it is first used: that needs a session
    return Analyzer(name, lambda c: _by_term(fn)(_spaced(F.lower(c))), lambda t: [fn(w) for w in plain(t)], native=False)


def _whole(v: Column) -> Column:
    return F.concat(F.lit(" "), v, F.lit(" "))


def _spaces(c: Column) -> Column:
    inner = F.trim(F.regexp_replace(c, r"\s+", "  "))
    return F.when(inner == "", F.lit("")).otherwise(_whole(inner))


def _cjk(name: str, table: dict[str, str], before: Callable[[str], str] = lambda t: t) -> Analyzer:
    def column(c: Column) -> Column:
        c = cjk.split_column(F.translate(c, "".join(table), "".join(table.values())) if table else c)
        return _spaced(F.lower(c))

    return Analyzer(name, column, lambda t: plain(cjk.split(before(t).translate(str.maketrans(table)))))


def _registry() -> dict[str, Analyzer]:
    found = [
        Analyzer("default", lambda c: _spaced(F.lower(c)), plain),
        Analyzer("raw", _whole, lambda t: [t]),
        Analyzer("raw_fold", lambda c: _whole(fold_column(F.lower(c))), lambda t: [fold(t.lower())]),
        Analyzer("whitespace", _spaces, str.split),
        _cjk("cjk", {}),
        _cjk("cjk_fold", cjk.SIMPLIFIED),
        _cjk("cjk_ja_fold", cjk.NEW_KANJI),
        _cjk("cjk_ko_fold", cjk.HANGUL),
        *[_stemmed(name, fn) for name, fn in stemmers.chains(fold).items()],
    ]
    return {a.name: a for a in found}


TOKENIZERS = _registry()


def analysed(c: Column, tokenizer: str, many: bool) -> Column:
    """Analysed text of a string or a list of strings; '' where there is none."""
    a = TOKENIZERS[tokenizer]
    if not many:
        return F.coalesce(a.column(c), F.lit(""))
    if a.native:
        return F.coalesce(F.array_join(F.transform(c, a.column), GAP), F.lit(""))
    joined = F.array_join(F.transform(c, lambda e: F.coalesce(e, F.lit(""))), GAP)  # \u0001 isn't alphanumeric, so gaps go; terms stay
    return F.coalesce(a.column(joined), F.lit(""))


def terms_array(spaced: Column) -> Column:
    return F.filter(F.split(F.trim(spaced), r"\s+"), lambda t: (t != "") & (t != "\u0001"))


def once(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(c), with c evaluated once for a row, however often fn names it; conditions keep Spark from seeing that itself."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def count_terms(spaced: Column) -> Column:
    """Number of terms, from lengths alone; gaps between elements are none."""

    def count(s: Column) -> Column:
        gaps = F.length(s) - F.length(F.replace(s, F.lit("\u0001"), F.lit("")))
        return F.when(s == "", F.lit(0)).otherwise(((F.length(s) - F.length(F.replace(s, F.lit("  "), F.lit("")))) / 2 + 1).cast("int") - gaps)

    return once(spaced, count)


def count_of(spaced: Column, needle: str) -> Column:
    """How often a needle such as ' a ' or ' a  b ' stands in analysed text."""
    return once(spaced, lambda s: ((F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))) / len(needle)).cast("int"))
