"""Quality rules: counts of words, symbols, repeated lines and repeated word windows, and the perplexity of each text under a
modified Kneser-Ney model of its language.

The model is over runs of six whole code points (module points), which Spark counts over all documents; it grows with them. A text
is scored by the texts of the other half. The model over four of 64 character classes here has the same formula in a size that
tests can sum up; nothing is judged by it. A text's perplexity is that of its words: marks within words add to it, marks as
words take from it, while both leave the mean over characters nearly as it is. Texts outside their language's band, on either side,
are rejected; the bands come from all documents of the language.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylark.llm import points
from querylark.llm.common import chunks, materialize, mix, shingle_hashes, small_arrow_batches, texts, word_hashes

ORDER, BITS = 4, 6
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: A band reaches so many robust deviations below and above the language's median. Above is further, since clean texts that
#: quote another language lie there.
BELOW, ABOVE = 5.5, 8.0
#: Relative deviation of a word's cost between long documents, which no length averages out.
BETWEEN = 0.03
#: Code points that are looked at at once.
PART = 1 << 20


@functools.cache
def character_classes() -> np.ndarray:
    """Class of each code point: 0 space, 1-26 letters, 27 digits, 28-31 marks and others, 32-63 further letters by hash."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        k = unicodedata.category(x)[0]
        if k == "L" or k == "M":
            low = x.lower()[0]
            table[c] = ord(low) - 96 if "a" <= low <= "z" else 32 + (ord(low) * 2654435761 >> 7) % 32
        elif k == "N":
            table[c] = 27
        elif k == "P":
            table[c] = 28 if x == "." else 29 if x == "," else 30
        elif k == "S":
            table[c] = 31
    return table


def codes(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of ORDER classes that ends at each character of the texts (a text begins after spaces), and where each begins."""
    pad = " " * (ORDER - 1)
    joined = pad + pad.join(many)
    cls = character_classes()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)].astype(np.uint32)
    code = cls[ORDER - 1 :].copy()
    for j in range(1, ORDER):
        code |= cls[ORDER - 1 - j : len(cls) - j] << np.uint32(BITS * j)
    size = np.array([len(t) for t in many], np.int64)
    begin = np.cumsum(size) - size + (ORDER - 1) * np.arange(len(many))
    own = np.ones(len(code), bool)
    own[(np.append(begin[1:], 0)[:-1, None] - 1 - np.arange(ORDER - 1)).ravel()] = False  # the spaces between texts
    return code[own], np.concatenate(([0], np.cumsum(size)))


def _key(order: int, kind: int, code: np.ndarray) -> np.ndarray:
    return mix(code.astype(np.uint64) | np.uint64(order << 40 | kind << 48))


def kneser_ney(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and natural logarithms: of kind 0 probabilities of n-grams, of kind 1 back-off weights of their contexts."""
    keys, values = [], []
    level: dict[int, tuple[np.ndarray, np.ndarray]] = {ORDER: (code.astype(np.int64), n.astype(np.int64))}
    for o in range(ORDER - 1, 0, -1):  # continuation counts: how many different classes precede the shorter n-gram
        level[o] = np.unique(level[o + 1][0] & ((1 << BITS * o) - 1), return_counts=True)
    lower_code, lower_p = np.arange(1 << BITS), np.full(1 << BITS, 2.0**-BITS)
    for o in range(1, ORDER + 1):
        c, k = level[o]
        t = np.array([(k == i).sum() for i in range(1, 5)], float)
        y = t[0] / max(1.0, t[0] + 2 * t[1])
        d = np.array([min(max(i - (i + 1) * y * t[i] / t[i - 1] if t[i - 1] and y else 0.5, 0.05), i - 0.05) for i in (1, 2, 3)])
        cut = d[np.minimum(k, 3) - 1]
        context, at = np.unique(c >> BITS, return_inverse=True)
        total = np.bincount(at, k)
        back = np.bincount(at, cut) / total
        below = lower_p[np.searchsorted(lower_code, c & ((1 << BITS * (o - 1)) - 1) if o > 1 else c)]
        p = np.maximum(k - cut, 0) / total[at] + back[at] * below
        keys += [_key(o, 0, c), _key(o, 1, context)]
        values += [np.log(p), np.log(back)]
        lower_code, lower_p = c, p
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32)


def log_probability(model: tuple[np.ndarray, np.ndarray], code: np.ndarray) -> np.ndarray:
    """Natural logarithm of each n-gram's probability, by back-off where it wasn't seen."""
    keys, logs = model

    def find(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return logs[at], keys[at] == key

    out = np.zeros(len(code))
    todo = np.arange(len(code))
    for o in range(ORDER, 0, -1):
        c = code[todo] & np.uint32((1 << BITS * o) - 1)
        value, hit = find(_key(o, 0, c))
        out[todo[hit]] += value[hit]
        todo, c = todo[~hit], c[~hit]
        if not len(todo):
            return out
        value, hit = find(_key(o, 1, c >> np.uint32(BITS)))
        out[todo[hit]] += value[hit]
    out[todo] += -BITS * np.log(2)
    return out


def repeated_words(words: np.ndarray, k: int = 5) -> int:
    """Words within runs of k words that occur twice or more in the text."""
    n = len(words)
    if n <= k:
        return 0
    _, at, times = np.unique(shingle_hashes(words, k), return_inverse=True, return_counts=True)
    twice = times[at] > 1
    if not twice.any():
        return 0
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.flatnonzero(twice), 1)
    np.add.at(step, np.flatnonzero(twice) + k, -1)
    return int((np.cumsum(step) > 0).sum())


def repeated_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def marks(text: str) -> tuple[int, int]:
    """Code points that are no space, and SYMBOLS; PART at a time."""
    inner = signs = 0
    for a in range(0, len(text), PART):
        raw = np.frombuffer(text[a : a + PART].encode(), np.uint8)
        n = np.bincount(raw, minlength=256)
        inner += int(n[:128].sum() + n[192:].sum() - n[9:14].sum() - n[32])
        signs += int(n[SYMBOLS].sum())
    return inner, signs


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_perplexity double, log_variance double"


def features(part: pa.RecordBatch, folder: str | None) -> dict:
    """The columns of FEATURES for a chunk with columns text and lang. Each text's model is that of the other fold, in the folder."""
    many, langs = texts(part), part.column("lang").fill_null("").to_pylist()
    h, cut = word_hashes(part, fold=False)
    inner, signs = np.array([marks(t) for t in many], np.int64).reshape(-1, 2).T
    n_words = np.diff(cut)
    repeat = np.array([repeated_words(h[a:b]) for a, b in zip(cut.tolist(), cut[1:].tolist())], np.int64)
    mean, var = np.zeros(len(many)), np.zeros(len(many))
    folds = [points.fold(t) for t in many]
    for lang, f in sorted(set(zip(langs, folds))) if folder else []:
        own = [i for i, x in enumerate(zip(langs, folds)) if x == (lang, f) and many[i]]
        if own:
            mean[own], var[own] = points.costs([many[i] for i in own], points.find(folder, lang, 1 - f))
    return {
        "n_words": n_words, "word_chars": inner, "n_symbols": signs, "n_dup_lines": [repeated_lines(t) for t in many],
        "n_repeat_words": repeat, "base_failed": (n_words < 10) | (100 * repeat > 20 * n_words), "log_perplexity": mean, "log_variance": var,
    }


def score(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_chars and the columns of FEATURES, for the model in folder."""
    small_arrow_batches(docs.sparkSession)
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_chars", pa.int64()), *((n, kinds[k]) for n, k in (x.split() for x in FEATURES.split(", ")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                got = features(part, folder) | {"doc_id": part.column("doc_id").cast(pa.int64()), "lang": part.column("lang").fill_null(""), "n_chars": [len(t) for t in texts(part)]}
                yield pa.RecordBatch.from_arrays([got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in schema], schema=schema)

    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    return own.mapInArrow(run, f"doc_id long, lang string, n_chars long, {FEATURES}")


def _cost() -> Column:
    """Mean negative log probability of a word: that of the text's characters over its words."""
    return F.col("log_perplexity") * F.col("n_chars") / F.greatest("n_words", F.lit(1))


def _deviation() -> Column:
    """Expected relative deviation of the cost: between documents, and of a mean over the text's words."""
    return F.sqrt(F.lit(BETWEEN**2) + F.greatest("word_variance", F.lit(0.0)) / F.greatest("n_words", F.lit(1)))


def bands(scored: DataFrame) -> DataFrame:
    """lang, middle (median logarithm of the cost), word_variance (relative), spread (robust scale of deviations) over the documents
    of the language that pass the base rules."""
    own = scored.filter(~F.col("base_failed") & (F.col("log_perplexity") > 0)).withColumn("cost", _cost())
    relative = F.col("log_variance") * F.col("n_chars") / F.col("n_words") / (F.col("cost") * F.col("cost"))
    middle = own.groupBy("lang").agg(F.log(F.percentile_approx("cost", 0.5, 10_000)).alias("middle"), F.avg(relative).alias("word_variance"))
    off = own.join(middle, "lang").withColumn("off", F.abs(F.log("cost") - F.col("middle")) / _deviation())
    spread = off.groupBy("lang").agg(F.greatest(1.4826 * F.percentile_approx("off", 0.5, 10_000), F.lit(0.1)).alias("spread"))
    return middle.join(spread, "lang")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, low, high.

    A null text is empty: no words, base_failed. A null language is a language of its own. Repeated rows are counted and
    judged each; null doc_ids are carried; other columns are left out. A very long text is scored in parts, of which only word
    hashes are kept. An empty table gives no rows. Kept: the base rules pass and the perplexity lies within
    the band of the language, which is wider for short texts."""
    scored = materialize(score(docs, points.build(docs, text_col, lang_col), id_col, text_col, lang_col))
    out = scored.join(materialize(bands(scored)), "lang", "left")
    unit, cost = F.col("spread") * _deviation(), _cost()
    low, high = F.exp(F.col("middle") - BELOW * unit), F.exp(F.col("middle") + ABOVE * unit)
    inside = F.coalesce(cost.between(low, high), F.lit(False))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"),
        F.exp(cost).alias("perplexity"), F.exp(low).alias("low"), F.exp(high).alias("high"),
    )
