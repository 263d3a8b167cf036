"""An index: a DataFrame with a schema, searched by query text."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylark.analysis.analyzers import TOKENIZERS
from querylark.functions import names
from querylark.functions.values import ip_key
from querylark.operators import shaping
from querylark.operators.postings import Postings
from querylark.operators.postings import write as write_postings
from querylark.plans import bm25
from querylark.plans.compiler import Compiled, Compiler, Source, exact_stored
from querylark.query import modifiers, parser
from querylark.query.dates import rfc3339
from querylark.query.parser import QueryRefused
from querylark.schema import DATE, F64, IP, MEASURABLE, STRING, TEXT, Field, Schema, schema_of


@dataclass(frozen=True)
class Limits:
    limit: int = 10
    window: int = 10_000
    array: int = 1_000
    most_array: int = 100_000
    min_prefix: int = 2
    bare_prefix: bool = True
    default_fields: int = 64
    federated: int = 20
    delete: int = 100_000


@dataclass
class Request:
    query: str
    limit: int
    offset: int
    fields: list[str] | None
    sort: tuple[str, bool] | None
    array: int
    matches: bool
    least: list[str]
    most: list[str]


@dataclass
class SearchResult:
    """Hits in order, and what is known about them; counts and measures are computed when asked for."""

    df: DataFrame
    request: Request
    discarded: list[str]
    matched: DataFrame
    schema: Schema
    order: list[Column]
    approximate_sort: str | None = None
    narrowed_default_fields: list[str] | None = None
    began: float = field(default_factory=time.time)

    @cached_property
    def total_hits(self) -> int:
        return self.matched.count()

    @cached_property
    def metrics(self) -> dict[str, dict[str, object]]:
        return _as_metrics(measure(self.matched, self.schema, self.request.least, self.request.most).first(), self.schema, self.request)

    def response(self) -> dict:
        hits = [{k: v for k, v in r.asDict(recursive=True).items() if not (k.startswith("_") and v is None)} for r in self.df.collect()] if self.request.limit else []
        out = {"hits": hits, "hits_returned": len(hits), "total_hits": self.total_hits, "limit": self.request.limit, "offset": self.request.offset, "took_ms": int(1000 * (time.time() - self.began))}
        if self.request.least or self.request.most:
            out["metrics"] = self.metrics
        extra = {"_discarded_clauses": self.discarded, "_approximate_sort": self.approximate_sort, "_narrowed_default_fields": self.narrowed_default_fields}
        return out | {k: v for k, v in extra.items() if v}

    def stream(self) -> Iterator[str]:
        """One JSON text a hit, without holding the page, then a footer."""
        n = 0
        for line in self.df.toJSON().toLocalIterator():
            n += 1
            yield line
        yield f'{{"hits_returned": {n}, "total_hits": {self.total_hits}}}'


def _elements(c: Column, f: Field) -> tuple[Column, Column]:
    """Least and most of a value or list, non-finite numbers left out."""
    fine = (lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) if f.type == F64 else None
    if f.many:
        c = F.filter(c, fine) if fine else c
        return F.array_min(c), F.array_max(c)
    c = F.when(fine(c), c) if fine else c
    return c, c


def measure(df: DataFrame, schema: Schema, least: list[str], most: list[str]) -> DataFrame:
    """One row: min_<field> and max_<field>; partial and final aggregates, no shuffle of rows."""
    for n in [*least, *most]:
        f = schema.get(n)
        if f is None or f.type not in MEASURABLE or not f.is_fast or f.ghost:
            raise QueryRefused(f"'{n}' has no least and greatest value: only number and date fields with a fast column do")
    own = [F.min(_elements(F.col(f"`{n}`"), schema.get(n))[0]).alias(f"min_{n}") for n in dict.fromkeys(least)]
    own += [F.max(_elements(F.col(f"`{n}`"), schema.get(n))[1]).alias(f"max_{n}") for n in dict.fromkeys(most)]
    return df.agg(*own)


def _as_metrics(row, schema: Schema, r: Request) -> dict:
    show = lambda n, v: rfc3339(int(v.timestamp())) if v is not None and schema.get(n).type == DATE else v
    return {side: {n: show(n, row[f"{side}_{n}"]) for n in names_} for side, names_ in (("min", r.least), ("max", r.most)) if names_}


class Index:
    """df has a column `id` (a string; `id_from` makes one) and the schema's fields; ghosts have no column."""

    def __init__(self, name: str, df: DataFrame, schema: Schema | None = None, id_from: list[str] | None = None, limits: Limits = Limits(), postings: Postings | None = None, **types: str | Field):
        """postings: the inverted index of this very table (see invert()), which then answers text clauses."""
        self.name, self.limits, self.inverted = name, limits, postings
        if schema is None:
            schema = schema_of(df.schema, **types)
        self.schema = schema.validate(TOKENIZERS)
        keys = id_from or list(schema.id_fields) or ([schema.shadow.name] if schema.shadow else [])
        if "id" not in df.columns:
            if not keys:
                raise ValueError("the table has no column id, and no other is named for it")
            parts = [F.col(f"`{k}`").cast("string") for k in keys]
            df = df.withColumn("id", F.when(F.array_contains(F.array(*[p.isNull() for p in parts]), F.lit(True)), F.lit(None)).otherwise(F.concat_ws("|", *parts)))
        self.df = df
        self.source = Source(self.schema, dict(df.dtypes))

    # ---- derived tables

    def analysed(self) -> DataFrame:
        """The table with the analysed text of every searchable text field and ghost beside it, so that queries don't analyse again."""
        more = [self.source.analysed(f).alias(Source.ANALYSED + f.name) for f in self.schema.fields if f.type == TEXT and f.indexed]
        return self.df.select("*", *more)

    def build(self, path: str, partitions: int | None = None) -> Index:
        """Writes the analysed table, ranged by id so that files and row groups are pruned by it, and opens it."""
        table = self.analysed()
        table = table.repartitionByRange(partitions, "id") if partitions else table
        table.sortWithinPartitions("id").write.mode("overwrite").parquet(path)
        return Index(self.name, self.df.sparkSession.read.parquet(path), self.schema, limits=self.limits)

    def invert(self, path: str) -> Index:
        """Writes the inverted index of the text fields and opens the index with it. Positions within a document are kept; the table itself
        stays where it is."""
        write_postings(self.df, self.source, path)
        return Index(self.name, self.df, self.schema, limits=self.limits, postings=Postings(self.df.sparkSession, path))

    @cached_property
    def documents(self) -> int:
        return self.df.count()

    def flagged(self, c: Compiled) -> DataFrame:
        """The table with what the postings say about the query's text clauses."""
        return self.inverted.flagged(self.df, c.asks) if c.asks else self.df

    def postings(self, name: str) -> DataFrame:
        """term, id, tf, positions of a text field: the inverted index as a table."""
        f = self.schema.get(name)
        from querylark.analysis.analyzers import terms_array

        terms = self.df.select("id", F.posexplode(terms_array(self.source.text(f))).alias("at", "term"))
        if not f.positions:
            return terms.groupBy("term", "id").agg(F.lit(1).cast("long").alias("tf"))
        return terms.groupBy("term", "id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))

    def statistics(self) -> DataFrame:
        return self.df.agg(F.lit(self.name).alias("index"), F.count("*").alias("documents"), F.lit(len(self.schema.fields)).alias("fields"))

    def inner_fields(self, name: str) -> DataFrame:
        """name: the keys that occur in a json field's objects."""
        return self.df.select(F.explode(F.json_object_keys(F.col(f"`{name}`"))).alias("name")).distinct()

    def percentiles(self, name: str, quantiles: dict[str, float], most: str, error: int | None = None) -> DataFrame:
        """One row: each quantile of a numeric field, and its greatest value. Exact, or with error (say 10_000) to one part in so many,
        in memory that doesn't grow with the values."""
        c = F.col(f"`{name}`")
        of = (lambda q: F.percentile(c, q)) if error is None else (lambda q: F.percentile_approx(c, q, error))
        return self.df.agg(*[of(q).alias(n) for n, q in quantiles.items()], F.max(c).alias(most))

    # ---- requests

    def request(self, query: str, limit=None, offset=None, fields=None, sort=None, array=None, matches=None, least=None, most=None) -> Request:
        """Arguments win over the inline modifiers."""
        m = modifiers.split(query)
        pick = lambda a, b, c: a if a is not None else b if b is not None else c
        r = Request(m.query, pick(limit, m.limit, self.limits.limit), pick(offset, m.offset, 0), pick(fields, m.fields, None), pick(sort, m.sort, None), pick(array, m.array, self.limits.array), pick(matches, m.matches, True), pick(least, m.least, []), pick(most, m.most, []))
        if isinstance(r.sort, str):
            name, _, order = r.sort.partition(":")
            r.sort = (name, order.lower() == "desc")
        if r.limit < 0 or r.offset < 0 or r.limit + r.offset > self.limits.window:
            raise QueryRefused(f"offset and limit reach beyond {self.limits.window}")
        if not 0 <= r.array <= self.limits.most_array:
            raise QueryRefused(f"an array cap is at most {self.limits.most_array}")
        return r

    def compiled(self, query: str, exact: bool = False) -> Compiled:
        c = Compiler(self.source, exact, self.limits.min_prefix, self.limits.bare_prefix, self.limits.default_fields, self.inverted is not None)
        names_ = ("id", self.schema.shadow.name) if self.schema.shadow else ("id",)
        key = parser.point_lookup(query, names_)
        if key is not None:
            return Compiled(F.col("id") == key, [], [], [])
        return c.compile(parser.parse(query))

    def lookup(self, ids: list[str]) -> DataFrame:
        """Documents of the ids, in their order; missing ones are left out."""
        spark = self.df.sparkSession
        asked = spark.createDataFrame(list(enumerate(ids)), "_at int, id string")
        return self.df.join(F.broadcast(asked), "id").orderBy("_at").drop("_at")

    def present(self, ids: DataFrame) -> DataFrame:
        """Which of the ids exist."""
        return ids.join(self.df.select("id"), "id", "left_semi")

    def filter(self, query: str, strict: bool = False) -> DataFrame:
        """Every match, without a page. strict refuses a query of which any clause is dropped."""
        c = self.compiled(query)
        if strict and c.notes:
            raise QueryRefused("; ".join(c.notes))
        return self.flagged(c).filter(c.match).select(*[F.col(f"`{n}`") for n in self.df.columns])

    def count(self, query: str) -> DataFrame:
        """One row: total_hits."""
        return self.filter(query).agg(F.count("*").alias("total_hits"))

    def metrics(self, query: str) -> DataFrame:
        """One row: total_hits and the measures of a query's min() and max(), in one pass."""
        r = self.request(query)
        hits = self.filter(r.query)
        own = measure(hits, self.schema, r.least, r.most)
        return hits.agg(F.count("*").alias("total_hits"), *[F.min(_elements(F.col(f"`{n}`"), self.schema.get(n))[0]).alias(f"min_{n}") for n in r.least], *[F.max(_elements(F.col(f"`{n}`"), self.schema.get(n))[1]).alias(f"max_{n}") for n in r.most]) if own else hits

    def sort_key(self, name: str) -> tuple[Column, str, bool]:
        """The column to sort by, the name it is known by, and whether the order is exact."""
        f = self.schema.get(name)
        if name == "id" or f is not None and f.shadow:
            return F.col("id"), self.schema.shadow.name if self.schema.shadow else "id", True
        if f is None or not f.sortable:
            raise QueryRefused(f"cannot sort by '{name}'")
        c = F.col(f"`{name}`")
        c = F.get(c, F.lit(0)) if f.many else c
        if f.type == IP:
            c = ip_key(c)
        elif f.type == DATE:
            c = F.date_trunc("second", c)
        return c, name, f.is_fast or f.type not in (TEXT, STRING)

    def search(self, query: str, strict: bool = False, exact_sort: bool = False, scores: bool = False, **options) -> SearchResult:
        """strict refuses a query of which any clause is dropped; exact_sort sorts text fields without a fast column exactly; scores
        keeps _score. Ties are broken by id."""
        r = self.request(query, **options)
        c = self.compiled(r.query)
        discarded = list(c.notes)
        measure(self.df, self.schema, r.least, r.most) if r.least or r.most else None
        hits = self.flagged(c).filter(c.match)
        window = r.limit + r.offset
        approximate, ranked = None, hits
        if r.sort is None:
            ranked = hits.withColumn("_score", self.scored(c) if c.leaves else F.lit(1.0))
            order = [F.desc("_score"), F.asc("id")]
        else:
            key, known, fine = self.sort_key(r.sort[0])
            order = [key.desc_nulls_last() if r.sort[1] else key.asc_nulls_last(), F.asc("id")]
            if fine or exact_sort:
                ranked = hits.withColumn("_score", F.lit(1.0))
            else:
                approximate = known
                ranked = hits.withColumn("_score", self.scored(c)).orderBy(F.desc("_score"), F.asc("id")).limit(2 * window)
        page = ranked.orderBy(*order).offset(r.offset).limit(r.limit) if r.offset else ranked.orderBy(*order).limit(r.limit)
        columns = self.projection(r.fields, discarded)
        if strict and discarded:
            raise QueryRefused("; ".join(discarded))
        shadow = self.schema.shadow
        if shadow is not None and "id" in columns:
            page = page.drop(shadow.name).withColumnRenamed("id", shadow.name)
            columns = list(dict.fromkeys(shadow.name if n == "id" else n for n in columns))
        shaped = shaping.shape(page, [*columns, *(["_score"] if scores else [])], r.array, c.elements, r.matches)
        return SearchResult(shaped, r, discarded, hits, self.schema, order, approximate, c.narrowed)

    def scored(self, c: Compiled) -> Column:
        return bm25.from_postings(self.inverted, self.documents, c.leaves) if self.inverted else bm25.score(self.df, self.source, c.leaves)

    def projection(self, wanted: list[str] | None, discarded: list[str]) -> list[str]:
        """Columns of a hit, in the order asked for; what isn't there is noted."""
        stored = [n for n in self.df.columns if not n.startswith(Source.ANALYSED)]
        shadow = self.schema.shadow
        if wanted is None:
            return [n for n in stored if shadow is None or n != shadow.name]
        out = []
        for n in wanted:
            f = self.schema.get(n)
            if shadow is not None and n in ("id", shadow.name):
                out.append("id")
            elif n in stored:
                out.append(n)
            elif f is not None and f.ghost:
                discarded.append(f"'{n}' is a ghost and isn't stored; its text is in '{f.ghost.source}'")
            else:
                near = names.suggestions(n, stored)
                discarded.append(f"no field '{n}' to return" + (f"; similar: {', '.join(near)}" if near else ""))
        return list(dict.fromkeys(out)) or ["id"]

    def validate(self, query: str | None = None, partial_field: str | None = None) -> dict:
        """What a query means without running it, and field names like a partial one."""
        out: dict = {}
        if query is not None:
            m = modifiers.split(query)
            parsed = parser.parse(m.query)
            out["normalized"] = parser.show(parsed.clause)
            try:
                out["discarded"] = self.compiled(m.query).notes
                out["runs"] = True
            except QueryRefused as e:
                out |= {"runs": False, "error": str(e)}
        if partial_field is not None:
            out["fields"] = names.suggestions(partial_field, [f.name for f in self.schema.fields], 10, 0.1)
        return out

    def advice(self, query: str) -> list[str]:
        """After no hit: for up to three whole-value clauses that find nothing alone, the spelling that would."""
        out = []

        def words(c) -> Iterator[parser.Word]:
            if isinstance(c, parser.Group):
                for o, x in c.parts:
                    if o != parser.MUST_NOT:
                        yield from words(x)
            elif isinstance(c, parser.Word) and c.field and not c.prefix:
                yield c

        for w in [w for w in words(parser.parse(modifiers.split(query).query).clause) if (f := self.schema.get(w.field)) and f.type == STRING][:3]:
            tried = names.spellings(w.text)
            c = F.col(f"`{w.field}`")
            counts = self.df.agg(*[F.count_if(F.array_contains(c, s) if self.schema.get(w.field).many else c == s).alias(f"c{i}") for i, s in enumerate(tried)]).first()
            if not counts[0]:
                out += [f"{w.field}: '{s}' is found {counts[i]} times, '{w.text}' never" for i, s in enumerate(tried) if counts[i]]
        return out

    # ---- deletes

    def delete_matches(self, query: str) -> tuple[DataFrame, DataFrame]:
        """Documents that an exact query deletes, and near misses: found by a text clause but not stored as its value."""
        c = self.compiled(query, exact=True)
        if c.notes:
            raise QueryRefused("documents can't be deleted by a query of which clauses were dropped: " + "; ".join(c.notes))
        found, stored = self.flagged(c).filter(c.match), exact_stored(self.source, c.exact)
        return found.filter(stored), found.filter(~stored)

    def delete_by_query(self, query: str, confirm: bool = False, dry_run: bool = False) -> dict:
        """Counts first; more than the limit needs confirm. survivors: the table without the deleted documents."""
        gone, missed = self.delete_matches(query)
        matched, skipped = gone.count(), missed.count()
        if matched > self.limits.delete and not confirm and not dry_run:
            raise QueryRefused(f"{matched} documents match, more than {self.limits.delete}; confirm to delete them")
        out = {"matched": matched, "skipped_inexact": skipped, "deleted": 0 if dry_run else matched}
        return out | {"survivors": self.df if dry_run else self.without(gone.select("id"))}

    def without(self, ids: DataFrame) -> DataFrame:
        """The table less the ids; ids that don't exist don't matter."""
        return self.df.join(ids.select("id").distinct(), "id", "left_anti")

    def at(self, df: DataFrame) -> Index:
        return Index(self.name, df, self.schema, limits=self.limits)


def federated(indexes: list[Index], query: str, limits: Limits = Limits(), **options) -> tuple[DataFrame, list[str]]:
    """One query over several indexes: each gives its whole window, the union is ordered by sort key or score, then by the order
    in which the indexes are named. A clause that any of them drops refuses the search; an index that can't run is reported."""
    seen = [i.name for i in indexes]
    if len(set(seen)) != len(seen) or len(seen) > limits.federated:
        raise QueryRefused(f"an index is named twice, or more than {limits.federated} are")
    parts, errors = [], []
    r = indexes[0].request(query, **options)
    if r.least or r.most:
        raise QueryRefused("measures over rows of different indexes mean nothing")
    for at, index in enumerate(indexes):
        try:
            own = replace(index.limits, window=max(index.limits.window, r.limit + r.offset))
            one = Index(index.name, index.df, index.schema, limits=own, postings=index.inverted)
            got = one.search(r.query, limit=r.limit + r.offset, offset=0, sort=r.sort, array=r.array, fields=None, scores=True)
            if got.discarded:
                raise QueryRefused(f"{index.name}: " + "; ".join(got.discarded))
            key = one.sort_key(r.sort[0])[0].cast("string" if index.schema.get(r.sort[0]).type in (TEXT, STRING, IP) else "double" if index.schema.get(r.sort[0]).type != DATE else "timestamp") if r.sort else F.col("_score")
        except QueryRefused as e:
            if "no field" in str(e) or "dropped" in str(e):
                raise
            errors.append(str(e))
            continue
        body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in got.df.columns if c != "_score"]))
        shadow = index.schema.shadow
        keyed = got.df if shadow is None else got.df.withColumn("id", F.col(f"`{shadow.name}`").cast("string"))
        parts.append(keyed.select(F.lit(index.name).alias("_index_source"), F.col("id"), F.col("_score"), key.alias("_sort_key"), F.lit(at).alias("_at"), body.alias("document")))
    if not parts:
        raise QueryRefused("; ".join(errors))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    order = F.col("_sort_key").desc_nulls_last() if r.sort is None or r.sort[1] else F.col("_sort_key").asc_nulls_last()
    page = union.orderBy(order, "_at", "id").offset(r.offset).limit(r.limit)
    return page.select("_index_source", "id", "_score", "_sort_key", "document"), errors
