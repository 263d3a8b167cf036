"""Modified Kneser-Ney over runs of ORDER whole code points, in partitioned sorted hash arrays that grow with the corpus.

An n-gram is two 63-bit integers of three code points each, so nothing is merged by class. Each language has two models, of the
texts of either fold (by a hash of the text); a text is scored by the model of the other fold, in which neither it nor its exact
copies are counted. Grams of 3 and more code points, their contexts and their shorter suffixes agree in the last two code points
of the context, by which they are partitioned: each bucket is worked out and searched by itself. Shorter ones are bounded by the
pairs of code points. Buckets are files, mapped into memory by the workers.
"""

from __future__ import annotations

import functools
import itertools
import mmap
import shutil
import tempfile
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylark.llm.common import P, chunks, filesystem, materialize, mix, shared_dir, small_arrow_batches, texts

ORDER, BITS = 6, 21
ONE, TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1
POINTS = 0x110000
#: n-grams that a counting task holds before it passes them on, and of a bucket about.
HELD, BUCKET = 1 << 20, 1 << 20
#: Code points of a text that are looked at at once.
PART = 1 << 20


@functools.cache
def folded() -> np.ndarray:
    """Each code point without case; white space is a space, decimal digits are 0."""
    table = np.arange(POINTS, dtype=np.int64)
    for c in range(POINTS):
        x = chr(c)
        k = unicodedata.category(x)
        if k in ("Lu", "Lt"):
            table[c] = ord(x.lower()[0])
        elif k == "Nd":
            table[c] = 48
        elif x.isspace():
            table[c] = 32
    return table


def fold(text: str) -> int:
    return zlib.crc32(text.encode()) & 1


def grams(many: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of the texts (a text begins after spaces), in two halves, and where each text begins."""
    pad = " " * (ORDER - 1)
    joined = pad + pad.join(many)
    cp = folded()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    m = len(cp) - ORDER + 1
    size = np.array([len(t) for t in many], np.int64)
    begin = np.cumsum(size) - size + (ORDER - 1) * np.arange(len(many))
    own = np.ones(m, bool)
    own[(begin[1:, None] - 1 - np.arange(ORDER - 1)).ravel()] = False  # the spaces between texts
    hi, lo = (cp[j : m + j] << 2 * BITS | cp[j + 1 : m + j + 1] << BITS | cp[j + 2 : m + j + 2] for j in (0, 3))
    return hi[own], lo[own], np.concatenate(([0], np.cumsum(size)))


def parts_of(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of a long text, PART code points at a time, each part after the last code points of the one before."""
    for a in range(0, len(text), PART):
        hi, lo, _ = grams([text[max(0, a - ORDER + 1) : a + PART]])
        yield hi[min(a, ORDER - 1) :], lo[min(a, ORDER - 1) :]


def suffix(hi: np.ndarray, lo: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The last `order` code points."""
    if order > 3:
        return (hi, hi & TWO, hi & ONE)[6 - order], lo
    return np.zeros_like(hi), (lo, lo & TWO, lo & ONE)[3 - order]


def key(order: int, kind: int, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """64-bit hash of the last `order` code points (kind 0) or of the context in them (kind 1)."""
    hi, lo = suffix(hi, lo & ~ONE if kind else lo, order)
    with np.errstate(over="ignore"):
        return mix(mix(hi.astype(np.uint64) + np.uint64(order << 1 | kind) * P) + lo.astype(np.uint64) * P)


def distinct(order: int, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, where each is first, which each is, and how often."""
    return np.unique(key(order, 0, hi, lo), return_index=True, return_inverse=True, return_counts=True)


def count(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, fold, hi, lo, n over all documents. A null language counts as ''."""
    small_arrow_batches(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("fold", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            hi, lo, n = (np.concatenate(x) for x in zip(*parts))
            _, first, which, _ = distinct(ORDER, hi, lo)
            return hi[first], lo[first], np.bincount(which, n).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, f), parts in held.items():
                hi, lo, n = merged(parts)
                for a in range(0, len(n), 100_000):
                    b = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n[b])), pa.array([f] * len(n[b]), pa.int32()), pa.array(hi[b]), pa.array(lo[b]), pa.array(n[b])], schema=schema)
            held.clear()

        for batch in batches:
            for part in chunks(batch):
                kinds: dict[tuple[str, int], Iterator[tuple[np.ndarray, np.ndarray]]] = {}
                several: dict[tuple[str, int], list[str]] = {}
                for t, lang in zip(texts(part), part.column("lang").fill_null("").to_pylist()):
                    if len(t) > PART:  # a chunk of its own
                        kinds[lang, fold(t)] = parts_of(t)
                    elif t:
                        several.setdefault((lang, fold(t)), []).append(t)
                for k, hi, lo in itertools.chain(((k, *x) for k, own in kinds.items() for x in own), ((k, *grams(many)[:2]) for k, many in several.items())):
                    _, first, _, n = distinct(ORDER, hi, lo)
                    own = held.setdefault(k, [])
                    own.append((hi[first], lo[first], n))
                    if len(own) > 8:
                        own[:] = [merged(own)]
                if sum(len(p[2]) for own in held.values() for p in own) > 4 * HELD:
                    for own in held.values():
                        own[:] = [merged(own)]
                    if sum(len(own[0][2]) for own in held.values()) > HELD:
                        yield from out()
        yield from out()

    own = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    return own.mapInArrow(run, "lang string, fold int, hi long, lo long, n long").groupBy("lang", "fold", "hi", "lo").agg(F.sum("n").alias("n"))


def bucket(lo: np.ndarray, buckets: int) -> np.ndarray:
    return (mix((lo >> BITS).astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def levels(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """order, n-grams and their counts; below ORDER continuation counts: how many different code points precede."""
    for o in range(ORDER, least - 1, -1):
        if o < ORDER:
            _, first, _, n = distinct(o, hi, lo)
            hi, lo = suffix(hi[first], lo[first], o)
        yield o, hi, lo, n


def discounts(t: np.ndarray) -> np.ndarray:
    """For counts 1, 2 and more, from how many n-grams have counts 1 to 4."""
    y = t[0] / max(1.0, t[0] + 2 * t[1])
    return np.array([min(max(i - (i + 1) * y * t[i] / t[i - 1] if t[i - 1] and y else 0.5, 0.05), i - 0.05) for i in (1, 2, 3)])


def of_counts(k: np.ndarray) -> np.ndarray:
    return np.array([(k == i).sum() for i in range(1, 5)], float)


def level(order: int, hi: np.ndarray, lo: np.ndarray, k: np.ndarray, d: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, list, list]:
    """Probabilities of one order; keys and logarithms of them and of the contexts' back-off weights. below: that of each suffix."""
    cut = d[np.minimum(k, 3) - 1]
    context, at = np.unique(key(order, 1, hi, lo), return_inverse=True)
    total = np.bincount(at, k)
    back = np.bincount(at, cut) / total
    p = np.maximum(k - cut, 0) / total[at] + back[at] * below
    return p, [key(order, 0, hi, lo), context], [np.log(p), np.log(back)]


def arrays(keys: list, logs: list) -> tuple[np.ndarray, np.ndarray]:
    keys, logs = np.concatenate(keys), np.concatenate(logs)
    order = np.argsort(keys)
    return keys[order], logs[order].astype(np.float32)


def short(pairs: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of orders 2 and 1 from the pairs and their continuation counts."""
    zero = np.zeros_like(pairs)
    one, n = np.unique(pairs & ONE, return_counts=True)
    p, keys, logs = level(1, np.zeros_like(one), one, n, discounts(of_counts(n)), np.full(len(one), 1 / POINTS))
    _, more, values = level(2, zero, pairs, k, discounts(of_counts(k)), p[np.searchsorted(one, pairs & ONE)])
    return arrays(keys + more, logs + values)


def long(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray], d: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of orders 3 and more of one bucket."""
    keys, logs, p, at = [], [], np.zeros(0), np.zeros(0, np.uint64)
    for o, h, x, k in reversed(list(levels(hi, lo, n, 3))):
        suffixes = key(o - 1, 0, h, x)
        below = np.exp(low[1][np.searchsorted(low[0], suffixes)].astype(float)) if o == 3 else p[np.searchsorted(at, suffixes)]
        p, more, values = level(o, h, x, k, d[o], below)
        keys += more
        logs += values
        order = np.argsort(more[0])
        p, at = p[order], more[0][order]
    return arrays(keys, logs)


def build(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> str:
    """Counts, and writes the arrays to a folder that all executors see."""
    counted = materialize(count(docs, text_col, lang_col))
    buckets = 1 + counted.count() // BUCKET
    folder = shared_dir(docs.sparkSession)

    def which(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lo in batches:
            yield pd.Series(bucket(lo.to_numpy(), buckets))

    grouped = counted.withColumn("bucket", F.pandas_udf(which, "int")("lo")) if buckets > 1 else counted.withColumn("bucket", F.lit(0))

    def tally(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for o, hi, lo, k in levels(*(pdf[c].to_numpy() for c in ("hi", "lo", "n")), 3):
            rows.append(pd.DataFrame({"order": o, "code": np.arange(4), "k": of_counts(k).astype(np.int64)}))
        pairs, k = np.unique(lo & TWO, return_counts=True)
        return pd.concat([*rows, pd.DataFrame({"order": 2, "code": pairs, "k": k})]).assign(lang=pdf["lang"].iloc[0], fold=pdf["fold"].iloc[0])[["lang", "fold", "order", "code", "k"]]

    def lower(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = pdf[pdf["order"] == 2]
        keys, logs = short(pairs["code"].to_numpy(), pairs["k"].to_numpy())
        rest = pdf[pdf["order"] > 2].pivot(index="order", columns="code", values="k").sort_index()
        d = np.array([discounts(t) for t in rest.to_numpy(float)])
        write(place(folder, pdf["lang"].iloc[0], pdf["fold"].iloc[0], "low"), np.array([buckets]), d, keys, logs)
        return pd.DataFrame({"n": [len(keys)]})

    tallied = grouped.groupBy("lang", "fold", "bucket").applyInPandas(tally, "lang string, fold int, order int, code long, k long").groupBy("lang", "fold", "order", "code").agg(F.sum("k").alias("k"))
    tallied.groupBy("lang", "fold").applyInPandas(lower, "n long").agg(F.sum("n")).collect()

    def upper(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, f, b = (pdf[c].iloc[0] for c in ("lang", "fold", "bucket"))
        model = find(folder, lang, f)
        keys, logs = long(*(pdf[c].to_numpy() for c in ("hi", "lo", "n")), model.low, model.discounts)
        write(place(folder, lang, f, b), keys, logs)
        return pd.DataFrame({"n": [len(keys)]})

    grouped.groupBy("lang", "fold", "bucket").applyInPandas(upper, "n long").agg(F.sum("n")).collect()
    return folder


def place(folder: str, lang: str, f: int, part: str | int) -> str:
    return f"{folder}/{lang.encode().hex() or '-'}-{f}/{part}"


def write(uri: str, *parts: np.ndarray) -> None:
    """Arrays of eight-byte numbers, the last of four-byte ones, to a file, whole or not at all."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0])
    with fs.open_output_stream(made := f"{path}.{np.random.default_rng().integers(1 << 62)}") as out:
        out.write(np.array([x.size for x in parts[:-1]], np.int64).tobytes() + b"".join(x.tobytes() for x in parts))
    fs.move(made, path)


def read(uri: str, *kinds: str) -> list[np.ndarray] | None:
    """The arrays of a file, mapped, not read; of a file elsewhere, a local copy is. None: there is no such file."""
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    if isinstance(fs, pafs.LocalFileSystem):
        raw = _map(path)
    else:
        with tempfile.NamedTemporaryFile() as local, fs.open_input_stream(path) as src:
            shutil.copyfileobj(src, local)
            local.flush()
            raw = _map(local.name)
    at, out = 8 * (len(kinds) - 1), []
    for kind, n in zip(kinds, [*raw[:at].view(np.int64).tolist(), -1]):
        out.append(np.frombuffer(raw, kind, n, at))
        at += 8 * n
    return out


def _map(path: str) -> np.ndarray:
    """Mapped without keeping the file open, since there may be many."""
    with open(path, "rb") as f:
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8)


class Model:
    """Of one language and fold."""

    def __init__(self, folder: str, lang: str, fold: int):
        self.at = folder, lang, fold
        buckets, d, *low = read(place(*self.at, "low"), "<i8", "<f8", "<u8", "<f4")
        self.low = tuple(low)
        self.discounts = dict(enumerate(d.reshape(-1, 3), 3))
        self.buckets = int(buckets[0])
        self.mapped: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}

    def arrays(self, b: int) -> tuple[np.ndarray, np.ndarray] | None:
        """None: nothing was counted there."""
        if b not in self.mapped:
            found = read(place(*self.at, b), "<u8", "<f4")
            self.mapped[b] = tuple(found) if found else None
        return self.mapped[b]


@functools.lru_cache(64)
def find(folder: str, lang: str, fold: int) -> Model | None:
    """The model of a language and fold, opened when it is first asked for; a Python worker keeps the last 64. None: no text of them was
    counted."""
    fs, path = filesystem(place(folder, lang, fold, "low"))
    return None if fs.get_file_info(path).type == pafs.FileType.NotFound else Model(folder, lang, fold)


def _back_off(found: tuple[np.ndarray, np.ndarray], orders: range, hi: np.ndarray, lo: np.ndarray, todo: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Adds to out; returns those not found in any of the orders."""
    keys, logs = found

    def find(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return logs[at], keys[at] == wanted

    for o in orders:
        if not len(todo):
            break
        value, hit = find(key(o, 0, hi[todo], lo[todo]))
        out[todo[hit]] += value[hit]
        todo = todo[~hit]
        value, hit = find(key(o, 1, hi[todo], lo[todo]))
        out[todo[hit]] += value[hit]
    return todo


def log_probability(model: Model | None, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Natural logarithm of each n-gram's probability, by back-off where it wasn't seen; without a model, code points are equal."""
    out = np.zeros(len(hi))
    todo = np.arange(len(hi))
    if model is not None:
        b = bucket(lo, model.buckets)
        rest = []
        for i in np.unique(b).tolist():
            own = np.flatnonzero(b == i) if model.buckets > 1 else todo
            found = model.arrays(i)
            rest.append(own if found is None else _back_off(found, range(ORDER, 2, -1), hi, lo, own, out))
        todo = _back_off(model.low, range(2, 0, -1), hi, lo, np.concatenate(rest) if rest else todo, out)
    out[todo] -= np.log(POINTS)
    return out


def costs(many: list[str], model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the negative log probability of each text's characters; no text is empty. A long text is read in parts,
    each after the last code points of the one before."""
    if len(many) == 1 and len(many[0]) > PART:
        text, total, squares = many[0], 0.0, 0.0
        for hi, lo in parts_of(text):
            logs = _logs(hi, lo, model)
            total, squares = total + float(logs.sum()), squares + float((logs**2).sum())
        mean = -total / len(text)
        return np.array([mean]), np.array([squares / len(text) - mean**2])
    hi, lo, begin = grams(many)
    logs = _logs(hi, lo, model)
    n = np.diff(begin)
    mean = -np.add.reduceat(logs, begin[:-1]) / n
    return mean, np.add.reduceat(logs**2, begin[:-1]) / n - mean**2


def _logs(hi: np.ndarray, lo: np.ndarray, model: Model | None) -> np.ndarray:
    _, first, which, _ = distinct(ORDER, hi, lo)
    return log_probability(model, hi[first], lo[first])[which]
