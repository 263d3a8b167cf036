"""Language identification: hashed subword embeddings, averaged over the whole text, with a linear softmax; trained by stochastic
gradient descent in numpy on a bounded sample of labelled documents; temperature and rejection threshold are calibrated on
labelled documents that training doesn't see. One more class learns what is no language of the sample from texts made of the
labelled ones: letters out of order, exchanged for others, or of another script."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylark.llm.bpe import C_L, class_table
from querylark.llm.common import discard, materialize, mix, narrow, per_chunk, pieces, read_here, semi_sized, small_arrow_batches, texts

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Most labelled documents that training and calibration see, spread over the languages.
SAMPLE_ROWS = 4000
#: Different subwords of a sampled document that training sees at most: of more, those with the least hashes, from the whole text.
SAMPLE_GRAMS = 8192
#: Share of rightly predicted calibration documents that may fall below the rejection threshold.
FALSE_REJECTS = 0.0005
UNKNOWN = "und"
#: Text handled at once, in bytes: each character gives four rows of the table.
CHUNK = 1 << 18
#: Where a text may be cut without touching a word or how its letters are lower-cased.
_EDGE = re.compile(r"(?<=\S)\s|(?<=\w)[。、，；！？]")
#: Sampled rows of a language at least, or all it has.
LEAST_ROWS = 8


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS, languages and one for none of them): embeddings times output weights, so a text's logits are a mean of rows
    bias: np.ndarray
    temperature: float
    threshold: float


def grams(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords (runs of 1 to 4 letters, with a space for whatever isn't a letter, as a word's edge) of the texts,
    and where each text's begin (texts + 1)."""
    lowered = [f" {t.lower()}    " for t in many]
    cp = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32).astype(np.uint64)
    letter = class_table()[cp] == C_L
    size = np.array([len(t) for t in lowered])
    cp[~letter] = 32
    edge = ~letter
    keep = np.ones(len(cp), bool)
    keep[1:] = letter[1:] | letter[:-1]  # one space between words
    if len(cp):
        keep[np.cumsum(size)[:-1]] = True
    doc = np.repeat(np.arange(len(many)), size)[keep]
    cp, edge = cp[keep], edge[keep]
    n = len(cp)
    found, at = [], []
    h = np.zeros(n, np.uint64)
    letters = np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        for order in range(1, max(ORDERS) + 1):
            m = n - order + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + cp[order - 1 :]
            letters = letters[:m] + ~edge[order - 1 :]
            inner = np.ones(m, bool)
            for j in range(1, order - 1):
                inner &= ~edge[j : j + m]  # a gram lies within a word and its edges
            ok = inner & (letters > (order > 1) * 0) & (doc[:m] == doc[order - 1 :])
            i = np.flatnonzero(ok)
            found.append((mix(h[i] + np.uint64(order)) & np.uint64(BUCKETS - 1)).astype(np.int64))
            at.append(doc[i])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(many) + 1, np.int64)
    found, at = np.concatenate(found), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return found[order], np.searchsorted(at[order], np.arange(len(many) + 1))


def has_letter(many: list[str]) -> list[bool]:
    return [any(map(str.isalpha, t)) for t in many]


def unlike(text: str) -> str:
    """A text of no language: letters shuffled, or each exchanged for another one of the alphabet or of some script."""
    seed = zlib.crc32(text.encode())
    r = np.random.default_rng(seed)
    text = text.lower()
    at = [i for i, c in enumerate(text) if c.isalpha()]
    kind = seed >> 1 & 3
    if kind == 0:
        new = [text[at[i]] for i in r.permutation(len(at))]
    else:
        known = sorted({text[i] for i in at})
        if kind == 1:
            to = [known[i] for i in r.permutation(len(known))]
        elif kind == 2:  # letters evenly
            to = None
            new = [chr(97 + i) for i in r.integers(0, 26, len(at))]
        else:
            first = int(r.choice([0x3B1, 0x430, 0x5D0, 0x627, 0x905, 0xE01, 0x10D0, 0x3041, 0x4E00, 0xAC00]))
            to = [chr(first + i) for i in r.integers(0, 26, len(known))]
        if to is not None:
            exchange = dict(zip(known, to))
            new = [exchange[text[i]] for i in at]
    out = list(text)
    for i, c in zip(at, new):
        out[i] = c
    return "".join(out)


def counted(text: str, change: Callable[[str], str] = str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    total = None
    for p in pieces(text, _EDGE, CHUNK):
        ids, _ = grams([change(p)])
        if len(p) == len(text):
            return np.unique(ids, return_counts=True)
        n = np.bincount(ids, minlength=BUCKETS)
        total = n if total is None else total + n
    u = np.flatnonzero(total)
    return u, total[u]


def sample(docs: DataFrame, rows: int, eligible: Column | None, id_col: str, text_col: str, lang_col: str) -> list[tuple[str | None, np.ndarray, np.ndarray, bool]]:
    """(language, buckets, shares, whether for calibration) of at most `rows` labelled documents, by a hash of doc_id.
    For every other one also one unlike() it, without language. They are held once, in six bytes a subword, and come from files: collected
    rows would be in the driver several times over."""
    small_arrow_batches(docs.sparkSession)
    own = narrow(docs if eligible is None else docs.filter(eligible), id_col, text_col, lang_col).withColumnRenamed(lang_col, "lang")
    own = own.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = own.groupBy("lang").agg(F.count("*").alias("n"))
    known = counts.count()
    each = max(LEAST_ROWS, rows // max(1, known))
    parts = 1_000_003
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    chosen = semi_sized(own, counts.withColumn("below", (parts * F.least(F.lit(1.0), each / F.col("n"))).cast("long")), "lang").filter(pick <= F.col("below"))
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.binary()), ("share", pa.binary()), ("later", pa.bool_())])

    def run(part: pa.RecordBatch) -> dict:
        many, langs, late = texts(part), part.column("lang").to_pylist(), part.column("later").to_pylist()
        made = [i for i, t in enumerate(many) if zlib.crc32(t.encode()) & 1]
        b, s = [], []
        for u, c in (*map(counted, many), *(counted(many[i], unlike) for i in made)):
            n = c.sum()
            if len(u) > SAMPLE_GRAMS:
                some = np.sort(np.argpartition(mix(u.astype(np.uint64)), SAMPLE_GRAMS)[:SAMPLE_GRAMS])
                u, c = u[some], c[some] * (n / c[some].sum())
            b.append(u.astype("<u2").tobytes())
            s.append((c / max(1, n)).astype("<f4").tobytes())
        return {"lang": langs + [None] * len(made), "bucket": b, "share": s, "later": late + [late[i] for i in made]}

    later = F.pmod(F.xxhash64(F.lit("calibration"), F.col("doc_id")), F.lit(5)) == 0
    picked = chosen.select("text", "lang", later.alias("later")).mapInArrow(per_chunk(run, schema, most=CHUNK), "lang string, bucket binary, share binary, later boolean").limit(4 * max(rows, LEAST_ROWS * known))
    table = materialize(picked)
    got = [r for batch in read_here(table) for r in zip(*(batch.column(c).to_pylist() for c in schema.names))]
    discard(table)
    got = sorted((r for r in got if r[1]), key=lambda r: (r[0] or "", r[1], r[2]))
    return [(lang, np.frombuffer(bucket, "<u2"), np.frombuffer(share, "<f4"), late) for lang, bucket, share, late in got]


def fit(data: list[tuple[str | None, np.ndarray, np.ndarray, bool]], dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 11) -> Model:
    langs = sorted({d[0] for d in data if d[0] is not None})
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (dim, len(langs) + 1)).astype(np.float32)
    bias = np.zeros(len(langs) + 1, np.float32)
    index = {x: i for i, x in enumerate([*langs, None])}
    train = [d for d in data if not d[3]] or data
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            lang, b, s, _ = train[i]
            lr = rate * (1 - done / steps)
            done += 1
            x = s @ e[b]
            z = x @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[index[lang]] -= 1
            g = w @ p
            w -= lr * np.outer(x, p)
            bias -= lr * 0.1 * p
            e[b] -= (lr * 20) * s[:, None] * g
    table = (e @ w).astype(np.float32)
    model = Model(langs, table, bias, 1.0, 0.0)
    check = [d for d in data if d[3]] or train
    if langs:
        z = np.array([s @ table[b] + bias for _, b, s, _ in check])
        y = np.array([index[d[0]] for d in check])

        def loss(t: float) -> float:
            q = z / t
            q = q - q.max(axis=1, keepdims=True)
            return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(y)), y]).mean())

        model.temperature = float(min(np.geomspace(0.05, 8, 60), key=loss))
        q = z / model.temperature
        p = np.exp(q - q.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        none = y == len(langs)
        best = p[:, : len(langs)].argmax(axis=1)
        top = p[np.arange(len(y)), best]
        right = ~none & (best == y)
        if right.any():  # midway between the lowest right score and the highest of no language below it
            least = np.quantile(top[right], FALSE_REJECTS)
            below = top[none & (top < least)]
            model.threshold = float((least + below.max()) / 2 if len(below) else least)
    return model


def train(docs: DataFrame, eligible: Column | None = None, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns every language that occurs, from about `rows` rows of those that are eligible and have text and language, spread
    evenly over the languages, about LEAST_ROWS of each at least; of a row at most SAMPLE_GRAMS subwords. So what the driver gets is
    bounded by rows, languages and SAMPLE_GRAMS. Rows without text or language teach nothing; an empty or unlabelled table gives
    a model that knows no language. Repeated rows count each."""
    return fit(sample(docs, rows, eligible, id_col, text_col, lang_col))


def parts_of(many: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """The texts, of at most about CHUNK code points in each step, with the number of each; a longer one comes in parts."""
    held, at, size = [], [], 0
    for i, t in enumerate(many):
        for p in pieces(t, _EDGE, CHUNK):
            if held and size + len(p) > CHUNK:
                yield held, np.array(at)
                held, at, size = [], [], 0
            held.append(p)
            at.append(i)
            size += len(p)
    if held:
        yield held, np.array(at)


def columns(many: list[str], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """lang_pred, score and rejected of each text. Long texts are read in parts that begin at white space, whose sums add up."""
    n, sums = np.zeros(len(many), np.int64), np.zeros((len(many), len(model.langs) + 1), np.float64)
    for group, own in parts_of(many):
        ids, cut = grams(group)
        size = np.diff(cut)
        some = np.flatnonzero(size)
        if len(some):
            np.add.at(n, own[some], size[some])
            np.add.at(sums, own[some], np.add.reduceat(model.table[ids], cut[:-1][some], axis=0))
    known = np.array(has_letter(many), bool) & (len(model.langs) > 0)
    z = (sums / np.maximum(n, 1)[:, None]).astype(np.float32)
    if len(model.langs):
        z += model.bias
    z /= model.temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    of = p[:, : max(1, len(model.langs))]
    best = of.argmax(axis=1)
    score = np.where(known, of.max(axis=1), 0.0)
    return [model.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known)], score.astype(np.float64), ~known | (score < model.threshold)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability), rejected.

    A text that is null or has no letter, and every text if nothing was learned, is `und` with score 0 and rejected. Repeated
    rows get equal predictions. The whole text is read, a very long one in parts. An empty table gives no rows."""
    small_arrow_batches(docs.sparkSession)
    own = narrow(docs, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(part: pa.RecordBatch) -> dict:
        lang, score, rejected = columns(texts(part), model)
        return {"doc_id": part.column("doc_id").cast(pa.int64()), "lang_pred": lang, "score": score, "rejected": rejected}

    return own.mapInArrow(per_chunk(run, schema, most=CHUNK), "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2
