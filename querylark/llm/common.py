"""What the operators share: the folder that all executors see, Arrow chunks, hashing and size-checked joins."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.dataset as ds
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by a numpy kernel, in bytes: small enough for caches, large enough to hide call overhead.
CHUNK_BYTES = 1 << 20
#: Largest number of key rows that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of input for each range of ids where an order over all rows is needed.
RANGE_BYTES = 128 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []
_at: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scope: ContextVar[list[str] | None] = ContextVar("_scope", default=None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor reaches; a path without scheme is one of Hadoop's default file
    system. Where it is unset, a local master (as in tests) gets a local folder, and a cluster is refused: an executor's own disk
    would be lost with it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="querylark-")
        atexit.register(shutil.rmtree, root[7:], True)
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    at = f"{root}/querylark-{uuid.uuid4().hex}"
    _made.append(at)
    if (scope := _scope.get()) is not None:
        scope.append(at)
    return at


def clean(spark: SparkSession) -> None:
    """Deletes the folders that operators have made in this process; for when their results are written."""
    while _made:
        _delete(spark, _made.pop())


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage: a table in the shared folder, read again. It outlives lost executors. Shuffle files go when it is written, not when
    the driver happens to collect its garbage."""
    spark, at = df.sparkSession, shared_dir(df.sparkSession)
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if was is None else spark.conf.set(SHUFFLE_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(at)
    _at[out] = at
    return out


def read_here(df: DataFrame, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of a table that materialize() returned, of so many rows: the driver's Python reads the files, nothing passes the JVM's heap."""
    fs, at = filesystem(_at[df])
    yield from ds.dataset(at, filesystem=fs, format="parquet").to_batches(batch_size=rows, batch_readahead=0, fragment_readahead=0, use_threads=False)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() returned and nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, _at.pop(df))


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, written; the folders that were made on the way are deleted."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        out = materialize(make())
    finally:
        _scope.reset(token)
    for at in own[:-1]:
        _delete(out.sparkSession, at)
    if (scope := _scope.get()) is not None:
        scope.append(own[-1])
    return out


def narrow(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the named columns, so no other column can clash."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[docs[c].alias(c) for c in more])


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most `most` bytes of text, or of one row."""
    n = batch.num_rows
    if not n:
        return
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def ranges(docs: DataFrame) -> int:
    """How many ranges of ids: one for RANGE_BYTES of input as the plan estimates it, at least the shuffle partitions. A plan that knows
    no size (it then says exabytes) has its texts measured."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 52:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def per_chunk(fn: Callable[[pa.RecordBatch], dict], schema: pa.Schema, column: str = "text", most: int = CHUNK_BYTES) -> Callable:
    """A mapInArrow function from one that turns a chunk into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column, most):
                out = fn(part)
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def small_arrow_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch where texts travel, so that neither side holds much of a partition."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def semi(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join; the key side is broadcast only if counted to be at most BROADCAST_ROWS."""
    n = keys.limit(BROADCAST_ROWS + 1).count()
    return df.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, on, how)


def semi_sized(df: DataFrame, more: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join with a side of one row a key; it is broadcast only if counted to be at most BROADCAST_ROWS."""
    n = more.limit(BROADCAST_ROWS + 1).count()
    return df.join(F.broadcast(more) if n <= BROADCAST_ROWS else more, on, how)


_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> _S)
    x = x * _C1
    x ^= x >> _S
    x *= _C2
    x ^= x >> _S
    return x


P = np.uint64(0x9E3779B97F4A7C15)
P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SAME = np.arange(256, dtype=np.uint8)
_FOLD = _SAME.copy()
_FOLD[65:91] = _SAME[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words up to so many bytes are hashed side by side, eight bytes at a time; the few longer ones by BLAKE2.
_SHORT = 64
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # the first i bytes of a lane
_powers: dict[str, np.ndarray] = {}


def power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 2)
        with np.errstate(over="ignore"):
            have = np.full(size, base, np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _powers[str(base)] = have
    return have[:n]


def pieces(text: str, cut: re.Pattern, most: int = CHUNK_BYTES) -> Iterator[str]:
    """The text in parts of about `most` code points, each later one beginning where `cut` matches; without a match the part goes on."""
    at = 0
    while len(text) - at > most:
        found = cut.search(text, at + most)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def word_hashes(batch: pa.RecordBatch, column: str = "text", fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of a chunk, A-Z lower-cased if fold; and where each row's words start (rows + 1).

    A word's bytes are taken in lanes of eight and mixed after each lane, so no pattern of letters makes two words alike as it does for
    sums of powers; two different words have equal hashes with a probability of 2^-64."""
    col = batch.column(column).fill_null("").cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(col) + 1, np.int64)
    word = ~_IS_SPACE[raw]
    at_start = off[(off > 0) & (off < len(raw))]  # a row's text may begin right after the end of another
    edge = word.copy()
    edge[1:] &= ~word[:-1]
    edge[at_start] |= word[at_start]
    starts = np.flatnonzero(edge)
    edge[:] = word
    edge[:-1] &= ~word[1:]
    edge[at_start - 1] |= word[at_start - 1]
    ends = np.flatnonzero(edge) + 1
    padded = np.zeros(len(raw) + 8, np.uint8)
    np.take(_FOLD if fold else _SAME, raw, out=padded[: len(raw)])
    lanes = np.ndarray(len(raw) + 1, "<u8", padded.data, 0, (1,))  # the eight bytes from each position on
    size = ends - starts
    with np.errstate(over="ignore"):
        h = size.astype(np.uint64) * P
        todo = np.flatnonzero(size <= _SHORT)
        for j in range(0, _SHORT, 8):
            todo = todo[size[todo] > j] if j else todo
            if not len(todo):
                break
            lane = lanes[starts[todo] + j] & _HEAD[np.minimum(size[todo] - j, 8)]
            h[todo] = mix((h[todo] ^ lane) + _C2 * np.uint64(j + 1))
    for i in np.flatnonzero(size > _SHORT).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h, np.searchsorted(starts, off)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of k words of one text; with fewer words, of the whole sequence; without words, none."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        m = min(n, k)
        h = words[: n - m + 1].copy()
        for j in range(1, m):
            h *= P
            h += words[j : n - m + 1 + j]
        if m < k:
            h += np.uint64(m)
        return mix(h)
