"""The inverted index as a table: one row for each (field, term, document), with the term's positions, ranged and sorted by field and
term, so that a query reads only the row groups of its terms.

A text clause of a query becomes an Ask. All asks of a query are answered by one pass over their terms' postings: one row for each document
with, for each ask, how often it occurs there. Only these rows meet the documents, whose text isn't read."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylark.analysis.analyzers import TOKENIZERS
from querylark.functions.values import condition
from querylark.schema import JSON, TEXT, Field, Schema

#: Documents with hits that are broadcast at most to the table; more are joined by shuffling.
BROADCAST_ROWS = 1_000_000
#: Bytes of documents for a range of postings; of a row group, the least that a query reads; and of texts for the blocks made at once.
RANGE_BYTES, GROUP_BYTES, CHUNK_BYTES = 16 << 20, 1 << 20, 16 << 20
#: Documents, and the share of them at least, by which ranges of even size are chosen.
SAMPLED, SAMPLED_SHARE = 1_000, 0.0005
#: A term, its least document among some, and its postings there.
BLOCKS = "range int, term string, least string, id array<string>, tf array<int>, dl array<int>, at array<array<bigint>>"
#: Positions between elements of a list, which no phrase crosses.
ELEMENT = 10_000_000
WHOLE = ("raw", "raw_fold")


@dataclass(frozen=True)
class Ask:
    """A clause on a text field: a term or phrase (the last term may be a prefix, the words may have slop between them), any of some
    terms, or a range of terms with tests such as ('>=', 'm')."""

    field: str
    terms: tuple[str, ...] = ()
    prefix: bool = False
    slop: int = 0
    any_of: bool = False
    bounds: tuple[tuple[str, str], ...] = ()

    def tests(self) -> list[Column]:
        """Which postings belong to each term."""
        t, own = F.col("term"), F.col("field") == self.field
        if self.bounds:
            plain = {">": lambda v: t > v, ">=": lambda v: t >= v, "<": lambda v: t < v, "<=": lambda v: t <= v}
            return [own & reduce(lambda a, b: a & b, [plain[op](v) for op, v in self.bounds])]
        if self.any_of:
            return [own & t.isin(*self.terms)]
        return [own & (t.startswith(x) if self.prefix and i == len(self.terms) - 1 else t == x) for i, x in enumerate(self.terms)]

    def phrase(self) -> bool:
        return not self.any_of and len(self.terms) > 1

    def occurrences(self, places: list[Column]) -> Column:
        """How often the phrase occurs, from the positions of its terms; with slop the number of starting points from which every term
        stands within reach, in any order: a term's place counts from where the phrase would have it."""
        shift = lambda p, i: F.transform(p, lambda x: x - i)
        shifted = [shift(p, i) for i, p in enumerate(places)]
        if not self.slop:
            return F.size(reduce(F.array_intersect, shifted))
        least = F.array_distinct(F.concat(*shifted))
        near = lambda x: reduce(lambda a, b: a & b, [F.exists(s, lambda d: (d >= x) & (d <= x + self.slop)) for s in shifted])
        return F.size(F.filter(least, near))


def _texts(df: DataFrame, source, f: Field) -> DataFrame:
    """id, element, analysed text s and, of a list, the number dl of all its terms; a list's elements are analysed each."""
    schema: Schema = source.schema
    base = schema.get(f.ghost.source) if f.ghost else f
    value = source.value(base)
    if f.ghost and f.ghost.when:
        by = schema.get(f.ghost.when)
        value = F.when(condition(source.value(by), f.ghost.within, f.ghost.outside, by.many), value)
    own = df.select("id", value.alias("v"))
    own = own.select("id", F.posexplode("v").alias("element", "v")) if base.many else own.select("id", F.lit(0).alias("element"), "v")
    text = TOKENIZERS[f.tokenizer].column(F.translate(F.col("v").cast("string"), "\u0001", " ") if f.type == JSON else F.col("v"))
    own = own.select("id", F.col("element").cast("long").alias("element"), text.alias("s"))  # no filter by s, which would be analysed twice
    if not base.many:
        return own.withColumn("dl", F.lit(None).cast("int"))
    return own.join(own.filter(F.col("s") != "").groupBy("id").agg(F.sum(F.size(_terms(f))).cast("int").alias("dl")), "id", "left")  # an element knows only its own length


def _terms(f: Field) -> Column:
    inner = F.expr("substring(s, 2, length(s) - 2)")
    return F.array(inner) if f.tokenizer in WHOLE else F.split(inner, "  ")


def _bounds(df: DataFrame, source, fields: list[Field], n: int) -> dict[str, list[str]]:
    """For each field the terms at which a range of postings begins, of about n ranges in all, by a part of the documents; a term that
    begins several is spread over them. Where postings lie depends on them, not which there are."""
    some = df.sample(min(1.0, max(SAMPLED / max(df.count(), 1), SAMPLED_SHARE)), seed=0)
    each = [_texts(some, source, f).filter(F.col("s") != "").select(F.lit(f.name).alias("field"), F.explode(_terms(f)).alias("term")) for f in fields]
    ranged = reduce(DataFrame.unionByName, each).repartitionByRange(n, "field", "term", F.rand(0))
    found = ranged.groupBy(F.spark_partition_id().alias("k")).agg(F.min(F.struct("field", "term")).alias("at")).orderBy("k").select("at.*").collect()
    return {f.name: [r["term"] for r in found if r["field"] == f.name] for f in fields}


def _blocks(whole: bool, bounds: list[str], base: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to blocks: each term of some CHUNK_BYTES of texts, with the postings of the documents there. So what is shuffled and sorted
    are terms, not tokens. Ranges are numbered from base; the field's bounds begin them."""

    def block(b: pa.RecordBatch, k: int) -> pa.RecordBatch:
        inner = pc.utf8_slice_codeunits(b["s"], 1, -1)
        if whole:
            tokens, lengths = inner, np.ones(len(inner), dtype=np.int64)
        else:
            split = pc.split_pattern(inner, "  ")
            tokens, lengths = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + b["element"].to_numpy(zero_copy_only=False)[row] * ELEMENT
        doc = np.zeros(len(lengths), dtype=np.int64)  # elements of a list follow each other
        doc[1:] = np.cumsum(pc.fill_null(pc.not_equal(b["id"][1:], b["id"][:-1]), True).to_numpy(zero_copy_only=False))
        encoded = tokens.dictionary_encode()
        codes = encoded.indices.to_numpy()
        bits = max(len(codes) - 1, 1).bit_length()
        order = np.sort(codes.astype(np.int64) << bits | np.arange(len(codes))) & ((1 << bits) - 1)  # by code, then place
        c, r = codes[order], row[order]
        d = doc[r]
        posting = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
        c, r = c[posting], r[posting]
        term = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        by_term, ends = pa.array(np.r_[term, len(posting)], pa.int32()), np.r_[posting, len(order)]
        ids, dl = b["id"].take(pa.array(r)), pc.coalesce(b["dl"], pa.array(lengths, pa.int32())).take(pa.array(r))
        places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[order]))
        parts = [pa.ListArray.from_arrays(by_term, x) for x in (ids, pa.array(np.diff(ends), pa.int32()), dl, places)]
        terms = encoded.dictionary.take(pa.array(c[term]))
        ends = [(bisect.bisect_left(bounds, t), bisect.bisect_right(bounds, t)) for t in terms.to_pylist()]
        span = pa.array([base + (y if y - x < 2 else x + 1 + k % (y - x)) for x, y in ends], pa.int32())
        return pa.RecordBatch.from_arrays([span, terms, ids.take(pa.array(term)), *parts], ["range", "term", "least", "id", "tf", "dl", "at"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId()  # so that tasks begin in different ranges of a frequent term
        for b in batches:
            b = b.filter(pc.fill_null(pc.not_equal(b["s"], ""), False))
            ends = np.cumsum(pc.binary_length(b["s"]).to_numpy(zero_copy_only=False))
            first = 0
            while first < b.num_rows:
                past = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK_BYTES, "right")))
                yield block(b.slice(first, past - first), k)
                first, k = past, k + 1

    return blocks


def write(df: DataFrame, source, path: str) -> None:
    """Postings of every searchable text or json field, and each field's total length, under path. Texts become blocks of a term's
    postings where they are read, and each block knows its range of (field, term), so texts are analysed once, without a pass to find the
    ranges. A term of any frequency is spread over as many ranges as it needs."""
    fields = [f for f in source.schema.fields if f.type in (TEXT, JSON) and f.indexed]
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 52:  # a plan that knows no size says exabytes
        size = 0
    n = max(-(-size // RANGE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    bounds = _bounds(df, source, fields, n)
    spread = df.repartition(spark.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else df
    made, base = [], 0
    for f in fields:
        made.append(_texts(spread, source, f).mapInArrow(_blocks(f.tokenizer in WHOLE, bounds[f.name], base), BLOCKS).withColumn("field", F.lit(f.name)))
        base += len(bounds[f.name]) + 1
    ranged = reduce(DataFrame.unionByName, made).repartitionById(base, F.col("range")).sortWithinPartitions("field", "term", "least")
    bare = [f.name for f in fields if not f.positions]
    at = F.when(F.col("field").isin(*bare), F.array().cast("array<bigint>")).otherwise(F.col("at")) if bare else F.col("at")
    one = ranged.select("field", "term", F.inline(F.arrays_zip("id", "tf", "dl", "at"))).select("field", "term", "id", "tf", "dl", at.alias("at"))
    one.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/postings")
    spark.read.schema(Postings.SCHEMA).parquet(f"{path}/postings").groupBy("field").agg(F.sum("tf").alias("total")).write.parquet(f"{path}/totals")


class Postings:
    """Opens what write() wrote."""

    SCHEMA = "field string, term string, id string, tf int, dl int, at array<bigint>"

    def __init__(self, spark: SparkSession, path: str):
        self.table = spark.read.schema(self.SCHEMA).parquet(f"{path}/postings")
        self.totals = {r["field"]: r["total"] for r in spark.read.schema("field string, total long").parquet(f"{path}/totals").collect()}
        self.frequencies: dict[tuple[str, str], int] = {}

    def documents_with(self, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Document frequencies of (field, term), asked once each."""
        new = [p for p in pairs if p not in self.frequencies]
        if new:
            wanted = reduce(lambda a, b: a | b, [(F.col("field") == f) & (F.col("term") == t) for f, t in new])
            got = {(r["field"], r["term"]): r["n"] for r in self.table.filter(wanted).groupBy("field", "term").agg(F.count_distinct(F.struct("id")).alias("n")).collect()}
            self.frequencies |= {p: got.get(p, 0) for p in new}
        return {p: self.frequencies[p] for p in pairs}

    def answer(self, asks: list[Ask]) -> DataFrame:
        """id, and for each ask _tf_k (null or 0: not there) and _dl_k (the field's length), of the documents that any ask reaches."""
        tests = [a.tests() for a in asks]
        rows = self.table.filter(reduce(lambda a, b: a | b, [t for own in tests for t in own]))
        columns, phrases = [], {}
        for k, (a, own) in enumerate(zip(asks, tests)):
            columns.append(F.max(F.when(F.col("field") == a.field, F.col("dl"))).alias(f"_dl_{k}"))
            if a.phrase():
                columns += [F.flatten(F.collect_list(F.when(t, F.col("at")))).alias(f"_at_{k}_{i}") for i, t in enumerate(own)]
                phrases[k] = a.occurrences([F.col(f"_at_{k}_{i}") for i in range(len(own))])
            else:
                columns.append(F.sum(F.when(own[0], F.col("tf"))).cast("int").alias(f"_tf_{k}"))
        by_id = rows.groupBy("id").agg(*columns)
        return by_id.select("id", *[(phrases[k] if k in phrases else F.col(f"_tf_{k}")).alias(f"_tf_{k}") for k in range(len(asks))], *[f"_dl_{k}" for k in range(len(asks))])

    def flagged(self, df: DataFrame, asks: list[Ask]) -> DataFrame:
        """The table with _tf_k and _dl_k. The hits are broadcast if counted to be at most BROADCAST_ROWS."""
        found = self.answer(asks)
        n = found.limit(BROADCAST_ROWS + 1).count()
        return df.join(F.broadcast(found) if n <= BROADCAST_ROWS else found, "id", "left")
