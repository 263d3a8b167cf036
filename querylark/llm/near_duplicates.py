"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A document's set of word shingles gets a signature of 64 MinHashes of 16 bits. The distance of two signatures is the number of
positions where they differ. The 64 positions are split into 15 chunks: signatures at distance 29 or less have, by pigeonhole, a
chunk with at most one error, so they agree on that chunk without one of its positions. Each document therefore gets one key for each
position (its chunk without it), and all pairs within the distance share a key. At Jaccard similarity 0.8 a position differs
with probability 0.2; more than 29 of 64 do with a probability of some 10^-6.

Links are confirmed on full shingle sets, in two rounds that never list the pairs of a group:
 1. in each key's group all members meet only the smallest id; confirmed links give components;
 2. in groups that still hold several components, members of different components whose signatures are within the distance are
    compared in blocks, and what passes is confirmed.
Equal sets are first collapsed to one representative. Before a pair of round 2 is made, a sketch of SKETCH bins (the least shingle of
each bin, one byte) estimates the similarity from up to 1,024 shingles instead of 64, so texts of one template that are less alike than asked
make no pairs. A linked pair falls out with a probability of some 10^-7, as by its distance. So no pair is left out for a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylark.llm.common import chunks, discard, materialize, mix, narrow, semi, settled, shingle_hashes, small_arrow_batches, word_hashes

HASHES = 64
DISTANCE = 29
CHUNKS = np.array_split(np.arange(HASHES), DISTANCE // 2 + 1)
#: Members of a group that are compared at once; larger groups are split into pairs of blocks of this size.
BLOCK = 1024
#: Bins of the sketch, and how many standard deviations below the asked similarity an estimate may lie.
SKETCH, TOLERANCE = 1024, 5.5
#: Partners of a text that one task confirms; more are split.
PARTNERS = 256
#: Links that one task joins into components; more are joined in steps.
LINKS = 1_000_000
_rng = np.random.default_rng(6)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """64 MinHashes of 16 bits of a set of hashed shingles (not empty)."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 4096):
            least = np.minimum(least, (shingles[a : a + 4096, None] * _MUL + _ADD).min(axis=0))
        return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """For each bin (by the highest bits) of the sorted set a byte of its least shingle, 1 to 255; 0 if it has none."""
    at = np.searchsorted(shingles, np.arange(SKETCH, dtype=np.uint64) * np.uint64((1 << 64) // SKETCH))
    out = np.zeros(SKETCH, np.uint8)
    own = np.flatnonzero(np.diff(np.append(at, len(shingles))))
    out[own] = mix(shingles[at[own]]) % np.uint64(255) + np.uint64(1)
    return out


def likely(one: np.ndarray, sizes: int, many: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Which of many sketches may belong to sets that are as similar as asked to that of one. The bins that either set fills hold a sample
    without replacement of the union, whose size the sets' sizes tell at that similarity."""
    least = percent / 100
    used = ((many != 0) | (one != 0)).sum(axis=1)
    same = ((many == one) & (many != 0)).sum(axis=1)
    union = np.maximum((sizes + other) / (1 + least), used)
    spread = np.sqrt(np.maximum(used * least * (1 - least) * (union - used) / np.maximum(union - 1, 1), 0))
    return same + TOLERANCE * spread + 1 >= least * used


def keys(signatures: np.ndarray) -> np.ndarray:
    """(documents, 64) keys: for each position, a hash of its chunk's other positions."""
    out = np.empty(signatures.shape, np.uint64)
    wide = signatures.astype(np.uint64)
    with np.errstate(over="ignore"):
        for chunk in CHUNKS:
            for drop in chunk:
                h = np.full(len(wide), drop + 1, np.uint64)
                for i in chunk:
                    if i != drop:
                        h = mix(h + wide[:, i] * _MUL[i])
                out[:, drop] = h
    return out.view(np.int64)


def shingle_sets(part: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk."""
    h, cut = word_hashes(part)
    cut = cut.tolist()
    return [np.unique(shingle_hashes(h[a:b], k)) for a, b in zip(cut, cut[1:])]


def signatures(own: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128-bit identity of the set), signature, sketch; for empty sets null from set_a on."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for s in shingle_sets(part, k):
                    with np.errstate(over="ignore"):
                        rows.append((len(s), int(s.sum().view(np.int64)), int(mix(s ^ _MUL[0]).sum().view(np.int64)), signature(s).tobytes(), sketch(s).tobytes()) if len(s) else (0, None, None, None, None))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:]))], schema=schema)

    return own.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary, sketch binary")


def keyed(reps: DataFrame) -> DataFrame:
    """key, doc_id: 64 rows for each signature."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                s = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)
                yield pa.RecordBatch.from_arrays([pa.array(keys(s).ravel()), pa.array(np.repeat(part.column("doc_id").to_numpy(), HASHES))], schema=schema)

    return reps.select("doc_id", "signature").mapInArrow(run, "key long, doc_id long")


def _within(a: list[bytes], b: list[bytes]) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(z), np.uint16).reshape(-1, HASHES) for z in (a, b))
    return (x != y).sum(axis=1) <= DISTANCE


def near(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose signatures are within the distance."""
    side = reps.select("doc_id", "signature")
    both = pairs.join(side.toDF("a", "sa"), "a").join(side.toDF("b", "sb"), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = _within(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], schema=schema).filter(pa.array(ok))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, own: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that are linked on their full shingle sets.

    Texts travel, which are smaller than their sets: that of b for each pair, that of a once for PARTNERS of its pairs, so a text
    with any number of partners is split over tasks, and its set is made once in each. Rows of a doc_id have equal sets here, so any of their texts does; the least is taken."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    some = materialize(semi(own.filter(F.col("text").isNotNull()), ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))
    sized = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("splits"))
    left = sized.join(some.toDF("a", "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), F.lit(None).cast("long").alias("b"), "text")
    right = pairs.join(sized, "a").select("a", F.pmod(F.xxhash64("b"), "splits").cast("int").alias("split"), "b").join(some.toDF("b", "text"), "b")
    both = left.unionByName(right).repartition("a", "split").sortWithinPartitions("a", "split", F.asc_nulls_first("b"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for batch in batches:
            for part in chunks(batch):
                a, b = [], []
                for i, j, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), shingle_sets(part, k)):
                    if j is None:
                        x = y
                        continue
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        a.append(i)
                        b.append(j)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return both.select("a", "b", "text").mapInArrow(run, "a long, b long")


def reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in the links a[i]-b[i], and the smallest that each reaches: roots are hung on smaller ones until no link has two."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while (differ := root[x] != root[y]).any():
        x, y = x[differ], y[differ]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    return ids, ids[root]


def components(links: DataFrame) -> DataFrame:
    """doc_id, component (its smallest reachable id) of all ids in the links (a, b), which are read twice.

    Up to LINKS are joined in one task: each step by joins would leave plans, broadcast tables and threads in the driver. Of more, labels
    take the least of their neighbours' and then their label's label, until nothing changes; each step is a table in the shared folder."""
    links = links.select("a", "b")
    if links.limit(LINKS + 1).count() <= LINKS:
        schema = pa.schema([("doc_id", pa.int64()), ("component", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if held := [x for x in batches if x.num_rows]:
                ends = [np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in reachable(*ends)], schema=schema)

        return links.repartition(1).mapInArrow(run, "doc_id long, component long")
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialize(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("doc_id"), "label"))
    while True:
        seen = edges.join(labels.toDF("b", "other"), "b").groupBy("a").agg(F.min("other").alias("other"))
        lower = labels.join(seen.toDF("doc_id", "other"), "doc_id").select("doc_id", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        jump = lower.join(labels.toDF("label", "further"), "label").select("doc_id", "was", F.least("label", "further").alias("label"))
        step = materialize(jump)
        labels = step.select("doc_id", "label")
        if step.filter("was <> label").isEmpty():
            return labels.toDF("doc_id", "component")


def across(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components within a key's group (key, doc_id, component, signature, sketch, n_shingles, size) whose
    signatures are within the distance, whose sets' sizes allow the similarity (it is at most the smaller size over the larger) and whose
    sketches make it likely, each once. A group of more than BLOCK members is split by a hash of the id into blocks, and each pair
    of blocks is compared in a task of its own."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    placed = groups.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "component", "n_shingles", "signature", "sketch")
    ordered = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "doc_id")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids, comp, n, own = (t.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles", "own"))
        s = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)
        bins = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        a, b = [], []
        for x in range(len(ids)):
            y = np.flatnonzero((comp != comp[x]) & (ids > ids[x]) & ((own != own[x]) | same) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])))
            if len(y):
                y = y[(s[y] != s[x]).sum(axis=1) <= DISTANCE]
                y = y[likely(bins[x], n[x], bins[y], n[y], percent)]
                a.append(np.full(len(y), ids[x]))
                b.append(ids[y])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z) if z else [], pa.int64()) for z in (a, b)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            starts = [0, *(np.flatnonzero((g[:, 1:] != g[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for p, q in zip(starts, starts[1:]):
                if held and tuple(g[:, p]) != last:
                    yield compare(held)
                    held = []
                last = tuple(g[:, p])
                held.append(batch.slice(p, q - p))
        if held:
            yield compare(held)

    return ordered.mapInArrow(run, "a long, b long").distinct()


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, of every row.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text of fewer than k words is one shingle. A null or empty text, or one
    without words, has n_shingles 0, its own doc_id as component and is kept. Rows of equal doc_id but different texts are one
    document, linked with all that any of its texts is linked with. Rows with null doc_id are returned with null component and kept
    true. A very long text is one row: its set is held whole, some 16 bytes a word. Other columns are left out. An empty table gives no rows."""
    small_arrow_batches(docs.sparkSession)
    return settled(lambda: _deduplicate(narrow(docs, id_col, text_col), k, percent))


def _deduplicate(own: DataFrame, k: int, percent: int) -> DataFrame:
    """deduplicate(); signatures and sketches are on disk once, in reps or in labelled, and go before the last texts are compared."""
    wide = materialize(signatures(own, k))
    filled = wide.filter(F.col("set_a").isNotNull() & F.col("doc_id").isNotNull())
    identity = ["set_a", "set_b", "n_shingles"]
    if not filled.groupBy("doc_id").agg((F.min(F.struct(*identity)) < F.max(F.struct(*identity))).alias("several")).filter("several").isEmpty():
        discard(wide)
        return by_rows(own, k, percent)
    reps = materialize(filled.groupBy(*identity).agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")))
    table, sets = materialize(wide.select("doc_id", *identity)), materialize(reps.select("doc_id", *identity))
    discard(wide)
    # round 1: each member of a group meets the smallest
    pivots = keyed(reps).groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("size")).filter("size > 1")
    pivots = materialize(pivots)
    stars = keyed(reps).join(pivots, "key").filter("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    first = materialize(near(stars.distinct(), reps))
    links = settled(lambda: confirmed(first, own, k, percent))
    if not links.isEmpty():
        found = settled(lambda: components(links))
        labelled = reps.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    else:
        labelled = reps.withColumn("component", F.col("doc_id"))
    labelled = materialize(labelled.select("doc_id", "component", "n_shingles", "signature", "sketch"))
    discard(reps)
    # round 2: what is in one group but not yet in one component
    member = keyed(labelled).join(pivots.select("key", "size"), "key").join(labelled.select("doc_id", "component"), "doc_id")
    member = materialize(member)
    mixed = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    groups = member.join(mixed, "key").join(labelled.select("doc_id", "signature", "sketch", "n_shingles"), "doc_id")
    second = materialize(across(groups, percent).join(first, ["a", "b"], "left_anti"))
    discard(labelled, member, pivots, first)
    more = settled(lambda: confirmed(second, own, k, percent))
    if not more.isEmpty():
        links = links.union(more)
    found = settled(lambda: components(links)) if not links.isEmpty() else links.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))
    ends = sets.join(found, "doc_id", "left").select(*identity, F.coalesce("component", "doc_id").alias("component_id"))
    by_id = table.filter(F.col("set_a").isNotNull() & F.col("doc_id").isNotNull()).join(ends, identity).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = table.select("doc_id", "n_shingles").join(by_id, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def by_rows(own: DataFrame, k: int, percent: int) -> DataFrame:
    """deduplicate() where a doc_id has several texts: rows are linked first, then those of one doc_id."""
    rows = materialize(own.withColumn("row", F.monotonically_increasing_id()))
    found = deduplicate(rows.filter("doc_id is not null"), k, percent, "row", "text").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"), "n_shingles")
    known = materialize(rows.select("row", "doc_id").join(found, "row"))
    same = known.groupBy("doc_id").agg(F.min("row").alias("first"))
    edges = known.select(F.col("row").alias("a"), F.col("component").alias("b")).union(known.join(same, "doc_id").select("row", "first"))
    ends = components(materialize(edges)).join(known.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("id")), "doc_id")
    ends = materialize(ends.select("id", "component").distinct())
    least = ends.groupBy("component").agg(F.min("id").alias("component_id"))
    of = ends.join(least, "component").select(F.col("id").alias("doc_id"), "component_id")
    out = known.select("doc_id", "n_shingles").join(of, "doc_id").withColumn("kept", F.col("doc_id") == F.col("component_id"))
    none = signatures(rows.filter("doc_id is null").select("doc_id", "text"), k).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.select("doc_id", "n_shingles", "component_id", "kept").union(none)
