"""Token ids in files of patched frame-of-reference blocks.

A block holds 256 ids: their minimum is subtracted, the differences are packed at the bit width that 90 % of them fit, and
those that don't fit leave their low bits in place and go whole into the block's exception list. The index holds where each
block starts, so a range of ids is read without the rest.

File: magic, then little-endian u64 numbers of documents, ids and blocks; document ids (i64), whether they are null (u8), lengths
(u32); per block minimum (u32), width (u8), number of exceptions (u16), start of its bytes (u64); then the blocks: packed
differences, exception positions (u8), exception differences (u32).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querylark.llm.bpe import vocabulary
from querylark.llm.common import chunks, filesystem, materialize, narrow, ranges, shared_dir, small_arrow_batches, texts

MAGIC = b"QLPFOR1\n"
BLOCK = 256
PERCENTILE = 90
#: Ids in a file before the next is begun.
FILE_IDS = 1 << 22


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 256) differences to (blocks, 32 * width) bytes, highest bits first: eight values fill `width` bytes."""
    eights = np.ascontiguousarray(values.reshape(-1, 8).T)
    out = np.zeros((len(values) * 32, width), np.uint8)
    for k in range(width):
        for j in range(8 * k // width, -(-8 * (k + 1) // width)):
            beyond = (j + 1) * width - 8 * (k + 1)  # bits of the value behind this byte
            out[:, k] |= (eights[j] >> np.uint32(beyond) if beyond >= 0 else eights[j] << np.uint32(-beyond)).astype(np.uint8)
    return out.reshape(len(values), 32 * width)


def _unpack(raw: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(raw), BLOCK), np.uint32)
    columns = np.ascontiguousarray(raw.reshape(-1, width).T)
    kind = np.uint32 if width <= 24 else np.uint64
    out = np.empty((len(raw) * 32, 8), np.uint32)
    for j in range(8):
        first, last = j * width // 8, ((j + 1) * width - 1) // 8
        x = columns[first].astype(kind) & kind(0xFF >> (j * width & 7))
        for k in range(first + 1, last):
            x = x << kind(8) | columns[k]
        if last > first:
            rest = (j + 1) * width - 8 * last  # bits of the value in its last byte
            x = x << kind(rest) | columns[last] >> np.uint8(8 - rest)
        else:
            x >>= kind(8 * (last + 1) - (j + 1) * width)
        out[:, j] = x
    return out.reshape(len(raw), BLOCK)


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Bytes of a file; ids: those of all documents, one after another."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint32)
    grid[:n] = ids
    if n % BLOCK:
        grid[n:] = ids[-(n % BLOCK) :].min()
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    grid = grid - low[:, None]
    need = np.frexp(grid.astype(np.float64))[1].astype(np.uint8)  # bits of each difference
    k = -(-BLOCK * PERCENTILE // 100) - 1
    width = np.partition(need, k, axis=1)[:, k] if blocks else np.zeros(0, np.uint8)
    out_b, out_at = np.nonzero(need > width[:, None])
    extra = np.bincount(out_b, minlength=blocks)
    size = 32 * width.astype(np.int64) + 5 * extra
    start = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        body[start[own][:, None] + np.arange(32 * int(w))] = _pack(grid[own] & np.uint32((1 << int(w)) - 1), int(w))
    if len(out_b):
        rank = np.arange(len(out_b)) - (np.cumsum(extra) - extra)[out_b]
        base = (start + 32 * width.astype(np.int64))[out_b]
        body[base + rank] = out_at
        body[(base + extra[out_b] + 4 * rank)[:, None] + np.arange(4)] = grid[out_b, out_at].astype("<u4").view(np.uint8).reshape(-1, 4)
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    head = [MAGIC, np.array([len(doc_ids), n, blocks], "<u8"), known, null, lengths.astype("<u4"), low.astype("<u4"), width.astype("u1"), extra.astype("<u2"), start.astype("<u8")]
    return b"".join(x if isinstance(x, bytes) else x.tobytes() for x in head) + body.tobytes()


class TokenFile:
    """Reads such a file."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        docs, self.n_ids, self.blocks = (int(x) for x in np.frombuffer(raw, "<u8", 3, 8))
        at = 32
        parts = []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", self.blocks), ("u1", self.blocks), ("<u2", self.blocks), ("<u8", self.blocks)):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += np.dtype(kind).itemsize * n
        known, null, self.lengths, self.low, self.width, self.extra, start = parts
        self.doc_ids = [None if z else d for d, z in zip(known.tolist(), null)]
        self.start = start.astype(np.int64)
        self.body = np.frombuffer(raw, np.uint8, -1, at)

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids from begin up to end; only their blocks are unpacked."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if begin >= end:
            return np.zeros(0, np.uint32)
        a, b = begin // BLOCK, -(-end // BLOCK)
        grid = np.empty((b - a, BLOCK), np.uint32)
        start, width, extra = self.start[a:b], self.width[a:b].astype(np.int64), self.extra[a:b].astype(np.int64)
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            grid[own] = _unpack(self.body[start[own][:, None] + np.arange(32 * w)], int(w))
        if extra.any():
            block = np.repeat(np.arange(b - a), extra)
            rank = np.arange(len(block)) - (np.cumsum(extra) - extra)[block]
            base = (start + 32 * width)[block]
            at = self.body[base + rank]
            grid[block, at] = np.ascontiguousarray(self.body[(base + extra[block] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel()
        grid += self.low[a:b, None]
        return grid.ravel()[begin - a * BLOCK : end - a * BLOCK]


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes the documents by the vocabulary at path, adds end_id to each and writes files to folder in ascending doc_id order
    (null ids first; equal ids by their tokens). Returns the manifest: bucket, seq, file, n_docs, n_ids, start (ids before it).

    A null text is empty: only the end id. Documents go to buckets by doc_id quantiles, as many as the input's bytes ask for, so no
    order over all rows is sorted in one task, and a bucket's file is closed after FILE_IDS ids. File names and content
    depend only on the data: a task that runs again writes the same. An empty table gives an empty manifest."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    own = narrow(docs, id_col, text_col)
    n = ranges(own)
    cut = own.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n))).first()[0]
    cut = np.unique(np.array(cut or [], np.int64))
    if n == 1:
        cut = cut[:0]
    encoded_schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        kind = "<u2" if max(len(v.tokens), end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for part in chunks(batch):
                known = part.column("doc_id").cast(pa.int64())
                bucket = np.searchsorted(cut, known.fill_null(-(1 << 63)).to_numpy(), side="left")
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), known, pa.array([np.append(x, np.uint32(end_id)).astype(kind).tobytes() for x in v.encode_with_added(texts(part))], pa.binary())], schema=encoded_schema)

    said = pa.schema([("bucket", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def to_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        wide = max(len(vocabulary(path).tokens), end_id + 1) > 1 << 16
        held: list[tuple[int | None, np.ndarray]] = []
        bucket, seq, ids = -1, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, ids, seq
            if not held:
                return
            file = f"{root}/part-{bucket:07d}-{seq:05d}.pfor"
            raw = encode_file([d for d, _ in held], np.array([len(x) for _, x in held]), np.concatenate([x for _, x in held]))
            part = f"{file}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as f:
                f.write(raw)
            fs.move(part, file)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([seq], pa.int32()), pa.array([file]), pa.array([len(held)], pa.int64()), pa.array([ids], pa.int64())], schema=said)
            held, ids, seq = [], 0, seq + 1

        for batch in batches:
            for b, d, raw in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if b != bucket:
                    yield from flush()
                    bucket, seq = b, 0
                x = np.frombuffer(raw.as_buffer(), "<u4" if wide else "<u2")
                held.append((d, x.astype(np.uint32)))
                ids += len(x)
                if ids >= FILE_IDS:
                    yield from flush()
        yield from flush()

    encoded = own.mapInArrow(encode, "bucket int, doc_id long, ids binary")
    ordered = encoded.repartitionById(len(cut) + 1, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "ids")
    manifest = materialize(ordered.mapInArrow(to_files, "bucket int, seq int, file string, n_docs long, n_ids long"))
    before = Window.orderBy("bucket", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_stream(file) as f:
                    t = TokenFile(f.read())
                ids = t.ids().astype("<u4")
                to = np.cumsum(t.lengths.astype(np.int64))
                at = to - t.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), to.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(t.doc_ids, pa.int64()), pa.array(base + at, pa.int64()), pa.array(t.lengths, pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count())  # a file a task
    return manifest.select("file", "start").repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    folder = f"{shared_dir(docs.sparkSession)}"
    return read(write(docs, folder, path, end_id), folder)
