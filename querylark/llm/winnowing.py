"""Document fingerprints by winnowing: rolling hashes of k-grams of code points; of each window of w hashes the least is chosen,
the rightmost among equal ones; positions are kept. Two texts that share a passage of w + k - 1 code points share a fingerprint."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylark.llm.common import P, P_INVERSE, chunks, mix, narrow, per_chunk, power, ranges, small_arrow_batches, texts

K, WINDOW = 16, 33
_LOW = np.uint64(0xFFFFFFFF)
#: Windows of a text that are hashed at once, so memory doesn't follow its length.
PART = 1 << 20


def select(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and positions of a text's fingerprint, by position. A text of fewer than k code points is one gram, one of
    fewer than `window` grams one window; the empty text has none."""
    n = len(text)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k = min(k, n)
    grams = n - k + 1
    w = min(window, grams)
    found = []
    for a in range(0, grams - w + 1, PART):  # windows from a on; each part reads w + k - 2 code points of the next
        b = min(a + PART, grams - w + 1)
        one = _least(text[a : b + w + k - 2], k, w, a)
        found.append(one[1:] if found and one[0] == found[-1][-1] else one)
    least = np.concatenate(found) if len(found) > 1 else found[0]
    return (least >> np.uint64(32)).astype(np.uint32), (_LOW - (least & _LOW)).astype(np.int64)


def _least(text: str, k: int, w: int, begin: int) -> np.ndarray:
    """The least gram of each window of the text, once for each run of windows: hash, then position (from begin), of equal hashes the
    later first."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp + np.uint64(1)) * power(P, len(cp)), out=sums[1:])
        h = mix((sums[k:] - sums[:-k]) * power(P_INVERSE, len(cp))[: len(cp) - k + 1])
    m, size = len(h), 1
    least = (h & ~_LOW) | (_LOW - np.arange(begin, begin + m, dtype=np.uint64))
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: m - w + 1], least[w - size :])
    return least[np.concatenate(([True], least[1:] != least[:-1]))]


def as_string(chosen: tuple[np.ndarray, np.ndarray]) -> str:
    """16 hexadecimal digits for each chosen gram: its hash and its position, 8 each."""
    return ((chosen[0].astype(np.uint64) << np.uint64(32)) | chosen[1].astype(np.uint64)).astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the hash sets (each sorted and distinct); 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, hashes (array<long>), positions (array<long>) of each document.

    A null text is empty and has an empty fingerprint; null and repeated doc_ids are carried as they are."""
    small_arrow_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))])

    def run(part: pa.RecordBatch) -> dict:
        many = texts(part)
        got = [select(t, k, window) for t in many]
        return {"doc_id": part.column("doc_id").cast(pa.int64()), "n_chars": [len(t) for t in many], "hashes": [h.astype(np.int64) for h, _ in got], "positions": [p for _, p in got]}

    return narrow(docs, id_col, text_col).mapInArrow(per_chunk(run, schema), "doc_id long, n_chars long, hashes array<long>, positions array<long>")


def edit(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller doc_id (equal ids: by text; null ids last), after the last the first; a single
    document follows itself. A null text is empty; an empty table gives no rows. Documents go to ranges of doc_id, as many as the
    input's bytes ask for, together with the first document of the range that follows; only doc_id is read to find the ranges. A
    very long text is hashed in parts, so beside it and its edited text a task holds what of the parts is chosen."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    own = narrow(docs, id_col, text_col)
    n = ranges(own)
    ids = own.select(F.col("doc_id").cast("long").alias("doc_id"))
    cut = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n))).first()[0]
    cut = np.unique(np.array((cut or []) if n > 1 else [], np.int64))
    least = -(1 << 63)

    def bucket(col: pa.Array) -> np.ndarray:
        return np.searchsorted(cut, col.fill_null(least).to_numpy(zero_copy_only=False), side="left")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = bucket(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), batch.column("doc_id")], ["bucket", "doc_id"])

    first = {r["bucket"]: r["head"] for r in ids.mapInArrow(heads, "bucket int, doc_id long").groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}
    filled = sorted(first)
    before = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}  # the range that precedes b in descending order
    sent = pa.schema([("bucket", pa.int32()), ("later", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("doc_id").cast(pa.int64())
            b = bucket(known)
            text = batch.column("text")
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(np.zeros(len(b)), pa.int32()), known, text], schema=sent)
            copies = [i for i, (x, d) in enumerate(zip(b.tolist(), known.to_pylist())) if d == first[x]]
            if copies:
                at = pa.array(copies)
                yield pa.RecordBatch.from_arrays([pa.array([before[int(b[i])] for i in copies], pa.int32()), pa.array([1] * len(copies), pa.int32()), known.take(at), text.take(at)], schema=sent)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, doc_id, text, string, sorted hashes
        closed = -1
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for b, later, d, t in zip(part.column("bucket").to_pylist(), part.column("later").to_pylist(), part.column("doc_id").to_pylist(), texts(part)):
                    if later and closed == b:
                        continue
                    got = select(t, k, window)
                    new = (b, d, t, as_string(got), np.unique(got[0]))
                    if held is not None and held[0] == b:
                        changed = edit(held[2], t)
                        other = select(changed, k, window)
                        rows.append((held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(), held[3], as_string(other), likeness(held[4], np.unique(other[0])), likeness(held[4], new[4])))
                    held, closed = (None, b) if later else (new, closed)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    moved = own.mapInArrow(spread, "bucket int, later int, doc_id long, text string").repartitionById(len(cut) + 1, F.col("bucket"))
    ordered = moved.sortWithinPartitions("bucket", "later", F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
