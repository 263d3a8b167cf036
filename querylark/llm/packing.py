"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Pieces of equal length are interchangeable, so the problem is the histogram of piece lengths (at most one count per length up to
the capacity, whatever the input), and a solution is a multiset of bin patterns. Best fit decreasing, shuffled best fit, crossover
and mutation all work on whole groups of equal bins at once. Islands evolve in Spark tasks; between epochs the best
solution of each goes to the next. Pieces then take their places by rank among pieces of the same length.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querylark.llm.bpe import vocabulary
from querylark.llm.common import chunks, materialize, narrow, small_arrow_batches, texts

#: Pattern (lengths of a bin's pieces) to the number of such bins.
Solution = Counter


class Packer:
    """Moves on solutions for one histogram."""

    def __init__(self, counts: dict[int, int], capacity: int, seed: int):
        self.counts, self.capacity = {k: v for k, v in counts.items() if v}, capacity
        self.bound = -(-sum(k * v for k, v in self.counts.items()) // capacity)
        self.random = np.random.default_rng(seed)

    def insert(self, bins: Solution, items: list[tuple[int, int]]) -> Solution:
        """Best fit of (length, count) in the given order into bins; groups of equal bins are filled together."""
        room: dict[int, Counter] = defaultdict(Counter)
        full: Solution = Counter()
        mask = 0  # bit r: a bin has r tokens of room
        for p, n in bins.items():
            r = self.capacity - sum(p)
            if r:
                room[r][p] += n
                mask |= 1 << r
            else:
                full[p] += n
        room[self.capacity] = Counter()

        def put(p: tuple, n: int) -> None:
            nonlocal mask
            r = self.capacity - sum(p)
            if r:
                room[r][p] += n
                mask |= 1 << r
            else:
                full[p] += n

        for length, count in items:
            while count:
                fits = mask >> length << length
                if fits:
                    r = (fits & -fits).bit_length() - 1
                    p, n = next(iter(room[r].items()))
                else:
                    r, p, n = self.capacity, (), count
                each = r // length
                k = min(n, count // each)
                used = k if k else 1
                take = each if k else count
                if r < self.capacity or p:
                    room[r][p] -= used
                    if not room[r][p]:
                        del room[r][p]
                    if not room[r]:
                        mask &= ~(1 << r)
                put((*p, *[length] * take), used)
                count -= used * take
        for group in room.values():
            full.update(group)
        return full

    def best_fit_decreasing(self) -> Solution:
        return self.insert(Counter(), sorted(self.counts.items(), reverse=True))

    def shuffled(self) -> Solution:
        """Best fit of lengths in a disturbed decreasing order."""
        keys = np.array(sorted(self.counts, reverse=True))
        order = np.argsort(-keys * self.random.uniform(0.7, 1.3, len(keys)))
        return self.insert(Counter(), [(int(k), self.counts[int(k)]) for k in keys[order]])

    def rest(self, bins: Solution) -> Counter:
        """What the bins don't hold; negative: what they hold too much of."""
        left = Counter(self.counts)
        for p, n in bins.items():
            for length in p:
                left[length] -= n
        return left

    def crossover(self, a: Solution, b: Solution) -> Solution:
        """Whole well-filled bins of b go into a; bins of a with pieces that are then there twice are dropped, the least filled
        first; displaced pieces are put back by best fit decreasing."""
        good = [p for p in b if sum(p) >= self.capacity - 2]
        child: Solution = Counter()
        if good:
            share = self.random.uniform(0.2, 0.8)
            for p in good:
                if self.random.random() < share:
                    child[p] = b[p]
        left = self.rest(child)
        for p, n in sorted(a.items(), key=lambda x: (-sum(x[0]), len(x[0]), x[0])):
            need = Counter(p)
            n = min(n, *(left[length] // k for length, k in need.items()))
            if n > 0:
                child[p] += n
                for length, k in need.items():
                    left[length] -= k * n
        return self.insert(child, sorted(((k, v) for k, v in left.items() if v), reverse=True))

    def mutate(self, a: Solution) -> Solution:
        """Some of the bins, the badly filled ones before all, are emptied and their pieces put back in a disturbed order."""
        keep: Solution = Counter()
        share = self.random.uniform(0.02, 0.15)
        for p, n in a.items():
            if sum(p) >= self.capacity - 2 and self.random.random() > share:
                keep[p] = n
        left = [(k, v) for k, v in self.rest(keep).items() if v]
        noise = self.random.uniform(0.8, 1.2, len(left))
        return self.insert(keep, [left[i] for i in np.argsort([-k * z for (k, _), z in zip(left, noise)])])

    def cost(self, a: Solution) -> tuple[int, float]:
        """Bins, then how unevenly they are filled (more uneven is better)."""
        return sum(a.values()), -sum(n * (sum(p) / self.capacity) ** 2 for p, n in a.items())

    def evolve(self, arrived: list[Solution], generations: int, size: int) -> Solution:
        people = [*arrived, self.best_fit_decreasing()]
        if min(map(self.cost, people))[0] <= self.bound:
            return min(people, key=self.cost)
        while len(people) < size:
            people.append(self.shuffled())
        for _ in range(generations):
            people.sort(key=self.cost)
            if self.cost(people[0])[0] <= self.bound:
                break
            people = people[:size]
            i, j = sorted(self.random.choice(len(people), 2, replace=False))
            people.append(self.crossover(people[i], people[j]))
            people.append(self.crossover(people[j], people[i]))
            people.append(self.mutate(people[0]))
        return min(people, key=self.cost)


def _dump(a: Solution) -> str:
    return json.dumps([[list(p), n] for p, n in sorted(a.items())])


def _load(text: str) -> Solution:
    return Counter({tuple(p): n for p, n in json.loads(text)})


def solve(spark, counts: dict[int, int], capacity: int, islands: int = 6, epochs: int = 3, generations: int = 12, population: int = 8, seed: int = 7) -> Solution:
    """The best solution found by the islands; each epoch is one Spark job of a task per island."""
    start = Packer(counts, capacity, seed)
    best = start.best_fit_decreasing()
    if not counts or start.cost(best)[0] <= start.bound:
        return best
    elites = [_dump(best)] * islands

    for epoch in range(epochs):
        sent = list(elites)

        def island(batches: Iterator[pa.RecordBatch], sent: list[str] = sent, epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column("id").to_pylist():
                    own = Packer(counts, capacity, seed + 1000 * epoch + i)
                    arrived = [_load(x) for x in {sent[i], sent[(i - 1) % islands]}]  # its own and its neighbour's elite
                    yield pa.RecordBatch.from_pydict({"id": [i], "solution": [_dump(own.evolve(arrived, generations, population))]}, schema=pa.schema([("id", pa.int64()), ("solution", pa.string())]))

        got = dict(map(tuple, spark.range(0, islands, 1, islands).mapInArrow(island, "id long, solution string").collect()))
        elites = [got[i] for i in range(islands)]
        best = min([best, *map(_load, elites)], key=start.cost)
        if start.cost(best)[0] <= start.bound:
            break
    return best


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id in pieces of at most capacity, the first the short one."""
    small_arrow_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for d, x in zip(part.column("doc_id").to_pylist(), v.encode_with_added(texts(part))):
                    x = np.append(x, np.uint32(end_id)).astype("<u4")
                    ends = [*range(len(x) % capacity or capacity, len(x) + 1, capacity)]
                    for k, b in enumerate(ends):
                        a = ends[k - 1] if k else 0
                        rows.append((d, k, a, b - a, zlib.crc32(x[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and gives one piece, the end id. Null and repeated doc_ids are packed like others. An empty table
    gives no rows. Only lengths are collected: at most `capacity` counts."""
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, path, capacity, end_id, id_col, text_col))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bins = solve(spark, counts, capacity)
    places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length -> (how many, first sequence, offset)
    base = 0
    for p, n in sorted(bins.items()):
        at = 0
        for length in p:
            places[length].append((n, base, at))
            at += length
        base += n
    table = {length: (np.cumsum([x[0] for x in own]), np.array([x[0] for x in own]), np.array([x[1] for x in own]), np.array([x[2] for x in own])) for length, own in places.items()}
    # rank among equal lengths, split into hash buckets of bounded size so that a common length isn't one task
    buckets = max(1, -(-sum(counts.values()) // 200_000))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "bucket", before.alias("before"))
    ranked = keyed.withColumn("k", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))).join(sizes, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k") - 1).alias("k"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, k = batch.column("length").to_numpy(), batch.column("k").to_numpy()
            sequence, offset = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            order = np.argsort(length, kind="stable")
            found, first = np.unique(length[order], return_index=True)
            for x, own in zip(found.tolist(), np.split(order, first[1:])):
                to, n, base, at = table[x]
                i = np.searchsorted(to, k[own], side="right")
                sequence[own] = base[i] + k[own] - (to[i] - n[i])
                offset[own] = at[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).cast(f.type) for f in list(schema)[:5]), pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
