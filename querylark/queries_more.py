"""Queries of sources, ingest, schemas, refusals and word forms, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylark import infer
from querylark.analysis import lexicon
from querylark.analysis.analyzers import TOKENIZERS
from querylark.functions import names, values
from querylark.operators import writes
from querylark.operators.catalog import Catalog
from querylark.operators.search import Index, Limits, federated
from querylark.queries import ADDR, addresses, ghosts, index, matches, query, read
from querylark.query.parser import QueryRefused
from querylark.schema import Field, Schema, SchemaError, schema_of
from querylark.sources import files
from querylark.storage import scratch
from querylark.streaming import ingest


def rows(spark: SparkSession, found: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(found, schema)


def values_sql(found: list[tuple], columns: str) -> str:
    said = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in found)}) AS t({columns})"


def refused(fn) -> bool:
    try:
        fn()
    except (QueryRefused, SchemaError):
        return True
    return False


# ---- files: whole tables are written as such files and read back
def _csv(spark, df: DataFrame, sep: str = ",", ending: str | None = None) -> str:
    at = scratch(spark, "querylark-files")
    w = df.write.option("header", True).option("sep", sep).option("quoteAll", True).option("escape", '"')
    (w.option("compression", "gzip") if ending else w).csv(at)
    if ending:
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(path(at)):
            if (n := s.getPath().getName()).startswith("part-"):
                fs.rename(s.getPath(), path(f"{at}/{n.split('.')[0]}{ending}"))
    return at


NOTED = "SELECT o_orderkey AS id, 'of \"' || o_orderstatus || '\",' || chr(10) || o_orderpriority AS note, o_totalprice AS price FROM orders"


def _noted(spark, sf) -> DataFrame:
    note = F.concat(F.lit('of "'), "o_orderstatus", F.lit('",\n'), "o_orderpriority")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id.i64"), note.alias("note"), F.col("o_totalprice").alias("price.float"))


def _typed(got: tuple[DataFrame, dict[str, str]]) -> DataFrame:
    df, types = got
    return df.select(*[values.typed(F.col(c), types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


@query(NOTED)
def csv_scan(spark, sf):
    return _typed(files.read_csv(spark, _csv(spark, _noted(spark, sf))))


@query(NOTED)
def csv_semicolons_by_content(spark, sf):
    return _typed(files.read(spark, _csv(spark, _noted(spark, sf), ";")))


@query(NOTED)
def csv_gz(spark, sf):
    return _typed(files.read(spark, _csv(spark, _noted(spark, sf), "\t", ".csv.gz")))


@query(NOTED)
def csv_gzip(spark, sf):
    at = _csv(spark, _noted(spark, sf).coalesce(1), ",", ".gzip")
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    one = next(s.getPath().toString() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if s.getPath().getName().endswith(".gzip"))
    return _typed(files.read(spark, one))


@query("SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def jsonl_scan(spark, sf):
    doc = F.to_json(F.struct(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")).alias("doc")))
    at = scratch(spark, "querylark-files")
    read(spark, sf, "customer").select(doc.alias("value")).write.text(at)
    return files.read_jsonl(spark, at)[0].select("id", "segment", "balance")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def json_array_scan(spark, sf):
    at = scratch(spark, "querylark-files")
    nations = read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    nations.agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("value")).write.text(at)
    return files.read(spark, at)[0].select("id", "name")


@query("SELECT count(*) AS n FROM orders")
def sampling_scan(spark, sf):
    return files.sample(spark, _csv(spark, _noted(spark, sf)))[0].agg(F.count("*").alias("n"))


@query(values_sql([("a;b\tc,d;e", ";", "csv"), ("a,b\n1;2;3", ",", "csv"), ('{"a":1}\n{"a":2}', ";", "jsonl"), (' [{"a":1}]', ";", "array"), ('{"fields": {}}', ";", "schema"), ('{"a": {}}', ";", "document")], "text, delimiter, format"))
def formats_by_content(spark, sf):
    given = ["a;b\tc,d;e", "a,b\n1;2;3", '{"a":1}\n{"a":2}', ' [{"a":1}]', '{"fields": {}}', '{"a": {}}']
    return rows(spark, [(t, files.sniff_delimiter(t), files.detect_format(t)) for t in given], "text string, delimiter string, format string")


@query(values_sql([("price", "f64"), ("n", "i64"), ("a.b", None), ("when", "date")], "name, type"))
def typed_header(spark, sf):
    found, types = files.typed_header(["price.f64", "n.integer", "a.b", " when.datetime "])
    return rows(spark, [(n, types.get(n)) for n in found], "name string, type string")


# ---- JSON lines by declared types, and as a stream
LINES = Schema((Field("id", "string"), Field("n", "i64"), Field("yes", "boolean"), Field("note", "text"), Field("at", "date")))
_LINE_SQL = "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE user_id END AS n, CASE WHEN event_id % 5 = 4 THEN NULL ELSE true END AS yes, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS note, event_id % 5 = 4 AS refused FROM events"


def _lines(spark, sf) -> DataFrame:
    k, n = F.col("event_id") % 5, F.col("user_id").cast("string")
    number = F.when(k == 0, n).when(k == 1, F.concat(F.lit('"'), n, F.lit('"'))).when(k == 2, F.concat(n, F.lit(".0"))).when(k == 3, F.concat(F.lit('" '), n, F.lit(' "'))).otherwise(F.lit("3.5"))
    text = F.concat(F.lit('{"id": "'), F.col("event_id").cast("string"), F.lit('", "n": '), number, F.lit(', "yes": "TRUE", "note": '), n, F.lit(', "at": "2024-01-02"}'))
    return read(spark, sf, "events").select("event_id", text.alias("text"))


@query(_LINE_SQL)
def json_values_by_type(spark, sf):
    got = ingest.parsed(_lines(spark, sf), LINES)
    return got.select("event_id", "r.n", "r.yes", "r.note", F.col("problem").startswith("n: ").alias("refused")).select("event_id", "n", "yes", "note", F.coalesce("refused", F.lit(False)).alias("refused"))


@query("SELECT CAST(user_id AS VARCHAR) AS id, max(event_id) AS n FROM events GROUP BY user_id")
def ndjson_stream(spark, sf):
    source, log, bad, ck = (scratch(spark, "querylark-stream") for _ in range(4))
    last = read(spark, sf, "events").repartition("user_id").sortWithinPartitions("event_id")  # a user's events are in one file, in order
    last.select(F.concat(F.lit('{"id": "'), F.col("user_id").cast("string"), F.lit('", "n": '), F.col("event_id").cast("string"), F.lit("}")).alias("value")).write.text(source)
    ingest.start(spark, source, log, bad, ck, Schema((Field("id", "string"), Field("n", "i64"))), once=True).awaitTermination()
    return ingest.snapshot(spark, log).select("id", "n")


@query("SELECT o_custkey AS id, arg_max(o_orderkey, o_orderkey) AS last FROM orders GROUP BY o_custkey")
def batches_in_order(spark, sf):
    batch = read(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("last"))
    return writes.put(batch.filter("false"), batch, order=F.col("last")).select("id", "last")


@query("SELECT o_orderkey, o_orderstatus, 2::BIGINT AS files FROM orders")
def compaction(spark, sf):
    at = scratch(spark, "querylark-files")
    writes.compact(read(spark, sf, "orders").repartition(6), at, 2)
    got = spark.read.parquet(at)
    return got.select("o_orderkey", "o_orderstatus", F.lit(len(got.inputFiles())).cast("long").alias("files"))


# ---- clauses that are dropped, and names
matches("ip_prefix_dropped", addresses, "src:10.1.* OR event_type:error", "event_id", "event_type = 'error'", ADDR)
matches("json_range_dropped", "events", "props:[1 TO 5] OR props.k:3 OR event_type:error", "event_id", "event_type = 'error'")
matches("regex_dropped", "documents", "text:/ab.*c/ OR lang:de", "doc_id", "lang = 'de'")


def dotted(spark, sf) -> Index:
    return Index("dotted", read(spark, sf, "events").select("event_id", F.col("event_type").alias("k8s.node")), id_from=["event_id"], **{"k8s.node": "string"})


matches("dotted_field", dotted, "k8s.node:click", "event_id", "event_type = 'click'", "events")


@query("SELECT count(*) AS hits, 2::BIGINT AS dropped FROM events WHERE event_type = 'error'")
def lenient_report(spark, sf):
    i = index(spark, sf, "events")
    c = i.compiled("nosuch:1 value:* event_type:error")
    return i.filter("nosuch:1 value:* event_type:error").agg(F.count("*").alias("hits")).withColumn("dropped", F.lit(len(c.notes)).cast("long"))


@query(values_sql([(q, True) for q in ("nosuch:1", "value:*", "", "event_type:[* TO *]")] + [("event_type:click", False)], "query, refused"))
def emptied_query(spark, sf):
    i = index(spark, sf, "events")
    return rows(spark, [(q, refused(lambda q=q: i.compiled(q))) for q in ("nosuch:1", "value:*", "", "event_type:[* TO *]", "event_type:click")], "query string, refused boolean")


@query(values_sql([(10, False), (60, False), (70, True), (5000, True)], "depth, refused"))
def depth_limit(spark, sf):
    i = index(spark, sf, "events")
    return rows(spark, [(n, refused(lambda n=n: i.compiled("(" * n + "event_type:click" + ")" * n))) for n in (10, 60, 70, 5000)], "depth int, refused boolean")


@query(values_sql([("min(event_type)", True), ("max(props)", True), ("min(nosuch)", True), ("min(value)", False), ("max(ts)", False)], "measure, refused"))
def metric_refusal(spark, sf):
    i = index(spark, sf, "events")
    return rows(spark, [(m, refused(lambda m=m: i.search(f"event_type:click limit 0 {m}"))) for m in ("min(event_type)", "max(props)", "min(nosuch)", "min(value)", "max(ts)")], "measure string, refused boolean")


@query(values_sql([("props", True), ("nosuch", True), ("value", False), ("ts", False), ("event_type", False)], "field, refused"))
def sort_refusals(spark, sf):
    i = index(spark, sf, "events")
    return rows(spark, [(f, refused(lambda f=f: i.search(f"event_type:click sort {f}"))) for f in ("props", "nosuch", "value", "ts", "event_type")], "field string, refused boolean")


@query(values_sql([("measures", True), ("twice", True), ("plain", False)], "asked, refused"))
def federated_refusals(spark, sf):
    a, b = index(spark, sf, "nation"), index(spark, sf, "region")
    asks = {"measures": lambda: federated([a, b], "* min(n_regionkey)"), "twice": lambda: federated([a, a], "*"), "plain": lambda: federated([a, b], "*")}
    return rows(spark, [(n, refused(fn)) for n, fn in asks.items()], "asked string, refused boolean")


@query("SELECT 'id' AS column_name, 1::BIGINT AS notes UNION ALL SELECT 'event_id', 1")
def unknown_projection(spark, sf):
    got = index(spark, sf, "events").search("* return id, nosuch, event_id limit 1")
    return rows(spark, [(c, len(got.discarded)) for c in got.df.columns], "column_name string, notes long")


@query("SELECT unnest(['id', 'doc_id', 'text', 'lang']) AS column_name")
def unstored_columns_left_out(spark, sf):
    return rows(spark, [(c,) for c in ghosts(spark, sf).search("* limit 1").df.columns], "column_name string")


@query("SELECT unnest(['a', 'c']) AS field, true AS narrowed")
def default_fields_narrowed(spark, sf):
    df = read(spark, sf, "nation").select("n_nationkey", *[F.col("n_name").alias(x) for x in "abc"])
    schema = Schema(tuple(Field(x, "text") for x in "abc") + (Field("n_nationkey", "i64"),), ("a", "c", "b"))
    c = Index("n", df, schema, id_from=["n_nationkey"], limits=Limits(default_fields=2)).compiled("nation")
    return rows(spark, [(x, c.narrowed is not None) for x in c.narrowed or []], "field string, narrowed boolean")


@query("SELECT p_partkey, p_type FROM part WHERE p_size < 5 ORDER BY p_type DESC, CAST(p_partkey AS VARCHAR) LIMIT 25")
def sort_string_exact(spark, sf):
    i = Index("part", read(spark, sf, "part"), id_from=["p_partkey"], p_type=Field("p_type", "string", fast=True))
    return i.search("p_size:<5 sort p_type:desc limit 25 return p_partkey, p_type").df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 40 OFFSET 5")
def streamed_hits(spark, sf):
    import json

    lines = list(index(spark, sf, "orders").search("* sort o_totalprice:desc limit 40 offset 5 return o_orderkey, o_totalprice").stream())
    return rows(spark, [(d["o_orderkey"], float(d["o_totalprice"])) for d in map(json.loads, lines[:-1])], "o_orderkey long, o_totalprice double")


# ---- deletes
@query("SELECT count(*) AS matched, 0::BIGINT AS deleted FROM events WHERE event_type = 'error' AND value < 100")
def delete_count(spark, sf):
    got = index(spark, sf, "events").delete_by_query("event_type:error AND value:<100", dry_run=True)
    return rows(spark, [(got["matched"], got["deleted"])], "matched long, deleted long")


@query("SELECT n_nationkey, (SELECT count(*) FROM nation WHERE n_name = 'NATION_3') AS matched FROM nation WHERE n_name <> 'NATION_3'")
def delete_by_exact_text(spark, sf):
    i = Index("nation", read(spark, sf, "nation"), id_from=["n_nationkey"])
    got = i.delete_by_query('n_name:"NATION_3"')
    return got["survivors"].select("n_nationkey", F.lit(got["matched"]).cast("long").alias("matched"))


@query("SELECT count(*) AS skipped FROM nation WHERE n_name = 'NATION_3'")
def delete_near_misses(spark, sf):
    _, missed = Index("nation", read(spark, sf, "nation"), id_from=["n_nationkey"]).delete_matches('n_name:"Nation 3"')
    return missed.agg(F.count("*").alias("skipped"))


_SCREENED = [("n_name:nat*", True), ('n_name:"a b"~2', True), ("nation", True), ("n_name:[a TO b]", True), ("*", True), ("nosuch:1", True), ('n_name:"nation_1"', False), ("n_regionkey:1", False), ("NOT n_regionkey:1", False)]


@query(values_sql(_SCREENED[:-1], "query, refused"))
def delete_screening(spark, sf):
    i = Index("nation", read(spark, sf, "nation"), id_from=["n_nationkey"])
    return rows(spark, [(q, refused(lambda q=q: i.delete_matches(q))) for q, _ in _SCREENED[:-1]], "query string, refused boolean")


@query("SELECT true AS refused, count(*) AS deleted FROM events WHERE event_type = 'error'")
def delete_limit(spark, sf):
    i = Index("events", read(spark, sf, "events"), id_from=["event_id"], limits=Limits(delete=10), event_type="string", props="json")
    return rows(spark, [(refused(lambda: i.delete_by_query("event_type:error")), i.delete_by_query("event_type:error", confirm=True)["deleted"])], "refused boolean, deleted long")


# ---- schemas and the catalog
def _catalog(spark, sf) -> Catalog:
    c = Catalog(spark, scratch(spark, "querylark-catalog"))
    for t in ("nation", "region"):
        c.put_schema(t, schema_of(read(spark, sf, t).withColumn("id", F.lit("")).schema))
        df = read(spark, sf, t)
        c.write(t, df.withColumn("id", F.col(df.columns[0]).cast("string")))
    return c


@query("SELECT 'nation' AS name, count(*) AS documents FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def catalog_listing(spark, sf):
    return _catalog(spark, sf).listing().select("name", "documents")


@query("SELECT 2::BIGINT AS indexes, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS documents, 7::BIGINT AS fields")
def catalog_totals(spark, sf):
    return _catalog(spark, sf).totals().select("indexes", "documents", "fields")


@query(values_sql([("change of a built field", True), ("new field", False), ("rebuild with rows", True), ("rebuild without rows", False)], "what, refused"))
def schema_changes(spark, sf):
    c = _catalog(spark, sf)
    s = c.schema("nation")
    changed = Schema(tuple(Field(f.name, "text" if f.name == "n_regionkey" else f.type) for f in s.fields))
    more = Schema((*s.fields, Field("extra", "text")))
    found = [("change of a built field", refused(lambda: c.put_schema("nation", changed))), ("new field", refused(lambda: c.put_schema("nation", more))), ("rebuild with rows", refused(lambda: c.rebuild("nation", changed)))]
    c.drop("nation", keep_schema=True)
    return rows(spark, [*found, ("rebuild without rows", refused(lambda: c.rebuild("nation", changed)))], "what string, refused boolean")


@query(values_sql([("id", "text", True, True), ("n_name", "text", True, True), ("n_nationkey", "i64", False, True), ("n_regionkey", "i64", True, True)], "name, type, searchable, sortable"))
def describe_index(spark, sf):
    c = _catalog(spark, sf)
    c.patch_schema("nation", indexed={"n_nationkey": False})
    return rows(spark, [(r["name"], r["type"], r["searchable"], r["sortable"]) for r in c.schema("nation").describe()], "name string, type string, searchable boolean, sortable boolean")


@query("SELECT unnest(['region']) AS name, true AS gone")
def drop_index(spark, sf):
    c = _catalog(spark, sf)
    c.drop("nation")
    return rows(spark, [(n, refused_key(lambda: c.schema("nation"))) for n in c.names()], "name string, gone boolean")


def refused_key(fn) -> bool:
    try:
        fn()
    except KeyError:
        return True
    return False


@query(values_sql([("a", "f64", False), ("b", "text", False), ("id", "string", True), ("n", "i64", True)], "name, type, indexed"))
def field_learning(spark, sf):
    one = Schema((Field("id", "string"), Field("n", "i64")))
    got = one.learn(Schema((Field("a", "i64"), Field("b", "i64")))).learn(Schema((Field("a", "f64"), Field("b", "text"), Field("n", "text"))))
    return rows(spark, [(f.name, f.type, f.indexed) for f in got.fields], "name string, type string, indexed boolean")


_BAD = {
    "no tokenizer": Schema((Field("a", "text", tokenizer="nosuch"),)), "tokenizer of a number": Schema((Field("a", "i64", tokenizer="raw"),)), "twice": Schema((Field("a", "i64"), Field("a", "text"))), "no type": Schema((Field("a", "nosuch"),)),
    "default of a number": Schema((Field("a", "i64"),), ("a",)), "long description": Schema((Field("a", "text", description="x" * 201),)), "fine": Schema((Field("a", "text", tokenizer="en_stem"),), ("a",)),
}


@query(values_sql([(n, n != "fine") for n in _BAD], "what, refused"))
def schema_validation(spark, sf):
    return rows(spark, [(n, refused(lambda s=s: s.validate(TOKENIZERS))) for n, s in _BAD.items()], "what string, refused boolean")


@query(values_sql([("order of fields", True), ("version", True), ("type", False), ("description of a field", False)], "what, same"))
def thumbprints(spark, sf):
    a, b = Field("a", "text"), Field("b", "i64")
    base = Schema((a, b)).thumbprint()
    others = {"order of fields": Schema((b, a)), "version": Schema((a, b), version=7), "type": Schema((a, Field("b", "f64"))), "description of a field": Schema((a, Field("b", "i64", description="x")))}
    return rows(spark, [(n, s.thumbprint() == base) for n, s in others.items()], "what string, same boolean")


@query(values_sql([("event_type:click", True, 0), ("nosuch:1 event_type:click", True, 1), ("nosuch:1", False, 0)], "query, runs, dropped"))
def validate_query(spark, sf):
    i = index(spark, sf, "events")
    got = [(q, i.validate(q)) for q in ("event_type:click", "nosuch:1 event_type:click", "nosuch:1")]
    return rows(spark, [(q, v["runs"], len(v.get("discarded", []))) for q, v in got], "query string, runs boolean, dropped int")


@query("SELECT 'event_type' AS field, 'click' AS spelling, count(*) AS n FROM events WHERE event_type = 'click'")
def zero_hit_advice(spark, sf):
    import re

    said = index(spark, sf, "events").advice("event_type:CLICK")
    found = [re.match(r"(\w+): '(\w+)' is found (\d+) times", s).groups() for s in said]
    return rows(spark, [(f, w, int(n)) for f, w, n in found], "field string, spelling string, n long")


@query(values_sql([("evnt_type", "event_type"), ("eventType", "event_type"), ("usr_id", "user_id"), ("qqq", None)], "asked, suggested"))
def did_you_mean(spark, sf):
    known = read(spark, sf, "events").columns
    return rows(spark, [(n, (names.suggestions(n, known, 1) or [None])[0]) for n in ("evnt_type", "eventType", "usr_id", "qqq")], "asked string, suggested string")


@query(values_sql([("new york",), ("New york",), ("New York",), ("NEW YORK",)], "spelling"))
def value_spellings(spark, sf):
    return rows(spark, [(s,) for s in names.spellings("new york")], "spelling string")


@query("SELECT 'o_orderkey' AS name, 'i64' AS type UNION ALL SELECT 'o_orderstatus', 'string'")
def detection_report(spark, sf):
    cells = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string"), "o_orderstatus")
    said = infer.report(infer.profile(cells)).split("\n")
    return rows(spark, [(x.split(":")[0], x.split(": ")[1].split()[0]) for x in said], "name string, type string")


# ---- values
@query("SELECT p_partkey, p_partkey % 3 = 0 AS good FROM part")
def facet_validity(spark, sf):
    k = F.col("p_partkey") % 3
    path = F.when(k == 0, F.concat(F.lit("/"), F.lower(F.regexp_replace("p_type", "[^A-Za-z]", "")), F.lit("/x"))).when(k == 1, F.lit("a/b")).otherwise(F.lit("/a//b"))
    return read(spark, sf, "part").select("p_partkey", values.is_facet(path).alias("good"))


@query("SELECT event_id, CASE WHEN user_id % 300 <= 255 THEN upper(printf('%02x', (user_id % 300)::INT)) || '00' END AS bytes FROM events")
def bytes_validity(spark, sf):
    return read(spark, sf, "events").select("event_id", F.hex(values.bytes_of(F.array(F.col("user_id") % 300, F.lit(0)))).alias("bytes"))


@query(values_sql([("text", 2), ("bare", 0)], "kind, phrases"))
def positions_kept(spark, sf):
    df = read(spark, sf, "nation").filter("n_nationkey < 2").select("n_nationkey", F.lit("of the sea").alias("text"), F.lit("of the sea").alias("bare"))
    i = Index("n", df, id_from=["n_nationkey"], bare=Field("bare", "text", positions=False))
    hits = lambda f: 0 if refused(lambda: i.filter(f'{f}:"of the"')) else i.filter(f'{f}:"of the"').count()
    return rows(spark, [(f, hits(f)) for f in ("text", "bare")], "kind string, phrases int")


# ---- word forms
WORDS = {
    "en_stem": [("running", "run"), ("ponies", "poni"), ("relational", "relat"), ("generously", "generous"), ("hopping", "hop")],
    "de_stem": [("häuser", "haus"), ("aufeinander", "aufeinand"), ("katzen", "katz"), ("freundlichkeit", "freundlich")],
    "fr_stem": [("continuation", "continu"), ("chevaux", "cheval"), ("majestueusement", "majestu"), ("mangeons", "mangeon")],
    "es_stem": [("corriendo", "corr"), ("cheques", "chequ"), ("torneado", "torn"), ("chicas", "chic")],
    "it_stem": [("abbandonata", "abbandon"), ("pronto", "pront"), ("libri", "libr")],
    "pt_stem": [("quilométricas", "quilométr"), ("meninos", "menin")],
    "it_stem_fold": [("città", "citt"), ("perché", "perc")],
    "pt_stem_fold": [("quilométricas", "quilometr"), ("nação", "naca")],
    "es_stem_fold": [("canción", "cancion"), ("corazones", "corazon")],
    "fr_stem_fold": [("générosité", "generos"), ("élèves", "elev")],
    "de_stem_fold": [("häuser", "haus"), ("straße", "strass")],
}


def _forms(name: str) -> None:
    given = WORDS[name]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = rows(spark, [(w,) for w, _ in given], "word string")
        return df.select("word", F.trim(TOKENIZERS[name].column(F.col("word"))).alias("stem"))

    run.__name__ = f"words_{name}"
    query(values_sql(given, "word, stem"))(run)


for _name in WORDS:
    _forms(_name)


@query(values_sql([("a", "c"), ("b", "c"), ("y", "x")], "sign, folded"))
def fold_table(spark, sf):
    return rows(spark, list(lexicon.fold_table({"a": "b", "b": "c", "x": "y", "y": "x"}).items()), "sign string, folded string")


@query(values_sql([("國語", 1), ("国语", 1), ("國", 1), ("漢", 0)], "asked, hits"))
def cjk_folded(spark, sf):
    df = rows(spark, [("1", "他說國語"), ("2", "英文")], "id string, t string")
    i = Index("c", df, t=Field("t", "text", tokenizer="cjk_fold"))
    return rows(spark, [(q, i.filter(f"t:{q}").count()) for q in ("國語", "国语", "國", "漢")], "asked string, hits int")


@query(values_sql([("café", "cafe"), ("café", "cafe"), ("Straße", "strasse"), ("ŒUVRE", "oeuvre"), ("Đura", "dura")], "word, folded"))
def accents_composed_or_not(spark, sf):
    df = rows(spark, [(w,) for w in ("café", "café", "Straße", "ŒUVRE", "Đura")], "word string")
    return df.select("word", F.trim(TOKENIZERS["raw_fold"].column(F.col("word"))).alias("folded"))

