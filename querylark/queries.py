"""Registered queries, one for each operator, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylark import infer
from querylark.analysis.analyzers import TOKENIZERS, terms_array
from querylark.functions import values
from querylark.operators import retention, writes
from querylark.operators.search import Index, federated
from querylark.operators.shaping import cap_bytes, shape
from querylark.schema import Field, Ghost, Schema
from querylark.storage import scratch

TABLES = {
    "events": (["event_id"], {"event_type": "string", "props": "json"}),
    "documents": (["doc_id"], {"lang": "string", "source": "string"}),
    "orders": (["o_orderkey"], {"o_orderstatus": "string", "o_orderpriority": "string"}),
    "lineitem": (["l_orderkey", "l_linenumber"], {"l_returnflag": "string", "l_linestatus": "string", "l_shipmode": "string"}),
    "part": (["p_partkey"], {"p_type": "string", "p_brand": "string", "p_mfgr": "string", "p_container": "string"}),
    "customer": (["c_custkey"], {"c_mktsegment": "string"}),
    "supplier": (["s_suppkey"], {}),
    "nation": (["n_nationkey"], {"n_name": "string"}),
    "region": (["r_regionkey"], {"r_name": "string"}),
    "pages": (["page_id"], {"url": "string"}),
    "benchmark": (["item_id"], {}),
    "conversations": (["conv_id", "turn"], {"role": "string"}),
    "embeddings": (["vec_id"], {}),
}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def index(spark: SparkSession, sf: str, table: str) -> Index:
    keys, types = TABLES[table]
    df = read(spark, sf, table)
    return Index(table, df, id_from=keys, **{k: v for k, v in types.items() if k in df.columns})


_inverted: dict[tuple[str, str, str], tuple[list[tuple[str, int, int]], Index]] = {}


def files(df: DataFrame) -> list[tuple[str, int, int]]:
    """Path, length and time of change of each file that the table is read from."""
    spark, found = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        s = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((name, s.getLen(), s.getModificationTime()))
    return found


def inverted(spark: SparkSession, sf: str, table: str = "documents") -> Index:
    """The index with its postings, which are built when a session first asks for them and stay while the table is the same: its plan,
    its schema and its files, with their lengths and times of change."""
    key, now = (spark.sparkContext.applicationId, sf, table), index(spark, sf, table)
    stamp = files(now.df)
    if key in _inverted:
        was, kept = _inverted[key]
        if was == stamp and kept.schema == now.schema and kept.df.sameSemantics(now.df):
            return kept
    made = now.invert(scratch(spark))
    _inverted[key] = (stamp, made)
    return made


def addresses(spark: SparkSession, sf: str) -> Index:
    df = read(spark, sf, "events")
    n = lambda c: c.cast("string")
    src = F.concat_ws(".", F.lit("10"), n(F.col("user_id") % 4), n(F.col("event_id") % 256), n(F.col("user_id") % 256))
    return Index("addresses", df.select("event_id", "event_type", src.alias("src")), id_from=["event_id"], event_type="string", src=Field("src", "ip", fast=True))


def parts(spark: SparkSession, sf: str) -> Index:
    df = read(spark, sf, "part")
    facet = F.concat(F.lit("/"), F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    return Index("parts", df.select("p_partkey", "p_type", "p_retailprice", facet.alias("category"), F.split("p_name", " ").alias("words")), id_from=["p_partkey"], p_type="string", category="facet", words=Field("words", "string", many=True))


def ghosts(spark: SparkSession, sf: str) -> Index:
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    own = [Field(f"text_{x}", "text", ghost=Ghost("text", "lang", within=(x,))) for x in ("en", "de")]
    rest = Field("text_rest", "text", ghost=Ghost("text", "lang", outside=("en", "de")))
    return Index("ghosts", docs, id_from=["doc_id"], lang="string", text=Field("text", "text", indexed=False), text_en=own[0], text_de=own[1], text_rest=rest)


def stemmed(spark: SparkSession, sf: str) -> Index:
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    more = {f"text_{x}": Field(f"text_{x}", "text", tokenizer=f"{x}_stem", ghost=Ghost("text", "lang", within=(x,))) for x in ("en", "de", "fr", "es")}
    return Index("stemmed", docs, id_from=["doc_id"], lang="string", **more)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def matches(name: str, table: str | Callable, text: str, columns: str, where: str, sql_from: str | None = None) -> None:
    """All documents that a query matches, without a page."""
    names = [c.strip() for c in columns.split(",")]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        i = index(spark, sf, table) if isinstance(table, str) else table(spark, sf)
        return i.filter(text).select(*names)

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {columns} FROM {sql_from or table} WHERE {where}"


def page(name: str, table: str | Callable, text: str, sql: str) -> None:
    """A page of hits: modifiers, order and window as the query says."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        i = index(spark, sf, table) if isinstance(table, str) else table(spark, sf)
        return i.search(text).df

    QUERIES[name] = run
    ORACLES[name] = sql


# Text in SQL: terms with a space on each side.
TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
JOINED = "(' ' || array_to_string(" + TOKENS + ", ' ') || ' ')"
DOCS = f"(SELECT *, {TOKENS.format('text')} AS tok, {JOINED.format('text')} AS s FROM documents)"

# ---- scans and point lookups
matches("scan_all", "nation", "*", "n_nationkey, n_name, n_regionkey", "true")
matches("point_lookup", "orders", "id:7", "o_orderkey, o_totalprice", "o_orderkey = 7")
matches("point_lookup_composite", "conversations", "id:3|1", "conv_id, turn, role", "conv_id = 3 AND turn = 1")
matches("id_in_query", "orders", "id:7 OR id:32 OR (id:100* AND o_orderstatus:F)", "o_orderkey, o_orderstatus", "o_orderkey IN (7, 32) OR (starts_with(CAST(o_orderkey AS VARCHAR), '100') AND o_orderstatus = 'F')")
matches("inverted_term_scan", inverted, "text:thing", "doc_id", "list_contains(tok, 'thing')", DOCS)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 5, 7, 33, 64)")
def batch_lookup(spark, sf):
    return index(spark, sf, "orders").lookup(["33", "1", "7", "64", "5", "no such id"]).select("o_orderkey", "o_orderstatus")


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def key_presence(spark, sf):
    asked = read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id")).distinct()
    return index(spark, sf, "customer").present(asked)


@query("SELECT 'orders' AS index, count(*) AS documents FROM orders")
def index_statistics(spark, sf):
    return index(spark, sf, "orders").statistics().select("index", "documents")


@query("SELECT DISTINCT unnest(json_keys(props)) AS name FROM events")
def field_discovery(spark, sf):
    return index(spark, sf, "events").inner_fields("props")


# ---- predicates
matches("term_string", "events", "event_type:click", "event_id, value", "event_type = 'click'")
matches("term_string_case", "events", "event_type:Click OR event_type:view", "event_id", "event_type = 'view'")
matches("term_i64", "events", "user_id:17", "event_id, user_id", "user_id = 17")
matches("term_f64", "lineitem", "l_discount:0.05", "l_orderkey, l_linenumber", "l_discount = 0.05")
matches("range_num_incl", "events", "value:[10 TO 50]", "event_id, value", "value BETWEEN 10 AND 50")
matches("range_num_excl", "events", "user_id:{10 TO 50}", "event_id, user_id", "user_id > 10 AND user_id < 50")
matches("range_mixed", "events", "user_id:[10 TO 50}", "event_id, user_id", "user_id >= 10 AND user_id < 50")
matches("range_open_low", "events", "value:[* TO 20]", "event_id", "value <= 20")
matches("range_open_high", "events", "value:[300 TO *]", "event_id", "value >= 300")
matches("compare_gt", "orders", "o_totalprice:>300000", "o_orderkey", "o_totalprice > 300000")
matches("compare_le", "lineitem", "l_quantity:<=3", "l_orderkey, l_linenumber", "l_quantity <= 3")
matches("range_date", "orders", "o_orderdate:[1995 TO 1996}", "o_orderkey", "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
matches("compare_date", "events", "ts:>=2024-01-20", "event_id", "ts >= TIMESTAMP '2024-01-20'")
matches("date_forms", "orders", "o_orderdate:[1996/03/01 TO 1996.04.01} OR o_orderdate:[19970301 TO 19970401} OR o_orderdate:[\"Mar 1, 1998\" TO \"1 Apr 1998\"}", "o_orderkey", "strftime(o_orderdate, '%Y-%m') IN ('1996-03', '1997-03', '1998-03')")
matches("date_instant", "orders", "o_orderdate:1996-01-02", "o_orderkey", "o_orderdate >= TIMESTAMP '1996-01-02' AND o_orderdate < TIMESTAMP '1996-01-02 00:00:01'")
matches("date_epoch", "events", "ts:>1705000000", "event_id", "ts >= make_timestamp(1705000001000000)")
matches("date_clamped", "events", "ts:<9999-01-01 AND NOT ts:>9999-01-01 AND user_id:<20", "event_id", "user_id < 20")
matches("in_set", "orders", "o_orderstatus: IN [F P]", "o_orderkey, o_orderstatus", "o_orderstatus IN ('F', 'P')")
matches("in_set_quoted", "orders", 'o_orderpriority: IN ["1-URGENT" "2-HIGH"]', "o_orderkey", "o_orderpriority IN ('1-URGENT', '2-HIGH')")
matches("in_set_num", "part", "p_size: IN [1 7 49]", "p_partkey, p_size", "p_size IN (1, 7, 49)")
matches("in_set_text", inverted, "text: IN [thing anea ndre]", "doc_id", "list_has_any(tok, ['thing', 'anea', 'ndre'])", DOCS)
matches("and_clauses", "events", "event_type:click AND value:>100", "event_id", "event_type = 'click' AND value > 100")
matches("adjacent_or", "orders", "o_orderstatus:P o_totalprice:>400000", "o_orderkey", "o_orderstatus = 'P' OR o_totalprice > 400000")
matches("and_not", "events", "event_type:click AND NOT value:>100", "event_id", "event_type = 'click' AND NOT value > 100")
matches("or_not", "orders", "o_orderstatus:P OR NOT o_totalprice:>50000", "o_orderkey", "o_orderstatus = 'P' OR NOT o_totalprice > 50000")
matches("not_alone", "orders", "NOT o_orderstatus: IN [O F]", "o_orderkey", "o_orderstatus NOT IN ('O', 'F')")
matches("not_not", "orders", "NOT NOT o_orderstatus:P", "o_orderkey", "o_orderstatus = 'P'")
matches("must_occur", "events", "+event_type:click -value:>50 user_id:3", "event_id", "event_type = 'click' AND NOT value > 50")
matches("groups", "events", "(event_type:click OR event_type:view) AND value:(>400 OR <1)", "event_id", "event_type IN ('click', 'view') AND (value > 400 OR value < 1)")
matches("prefix_string", "part", "p_type:PRO*", "p_partkey, p_type", "starts_with(p_type, 'PRO')")
matches("range_string", "orders", 'o_orderpriority:["2" TO "4"}', "o_orderkey", "o_orderpriority >= '2' AND o_orderpriority < '4'")
matches("range_text", inverted, "text:{zz TO *]", "doc_id", "len(list_filter(tok, lambda t: t > 'zz')) > 0", DOCS)
matches("term_text", inverted, "text:the", "doc_id", "list_contains(tok, 'the')", DOCS)
matches("bare_or", inverted, "thing anea", "doc_id", "list_has_any(tok, ['thing', 'anea'])", DOCS)
matches("bare_and", inverted, "+thing +the -lang:fr", "doc_id", "list_contains(tok, 'thing') AND list_contains(tok, 'the') AND lang <> 'fr'", DOCS)
matches("phrase", inverted, 'text:"of the"', "doc_id", "contains(s, ' of the ')", DOCS)
matches("phrase_prefix", inverted, '"of the th"*', "doc_id", "contains(s, ' of the th')", DOCS)
matches("phrase_slop", inverted, 'text:"the of"~2', "doc_id", r"regexp_matches(s, ' the (\S+ ){0,2}of ') OR contains(s, ' of the ')", DOCS)
matches("phrase_slop_three", inverted, 'text:"the of and"~1', "doc_id", r"regexp_matches(s, ' the of (\S+ )?and | the (\S+ )?of and ')", DOCS)
matches("prefix_text", inverted, "text:zu*", "doc_id", "contains(s, ' zu')", DOCS)
matches("prefix_bare", inverted, "zu* AND lang:de", "doc_id", "contains(s, ' zu') AND lang = 'de'", DOCS)
matches("prefix_short", inverted, "text:z* OR text:a*", "doc_id", "list_has_any(tok, ['z', 'a'])", DOCS)
matches("composed_text", "conversations", "text:the AND role:user AND NOT turn:0", "conv_id, turn", f"contains({JOINED.format('text')}, ' the ') AND role = 'user' AND turn <> 0")
matches("json_words", "events", "props:69", "event_id", "list_contains(regexp_split_to_array(lower(props), '[^a-z0-9]+'), '69')")
matches("escaped_value", "part", r"p_brand:Brand\#13 OR p_brand:\Brand#2", "p_partkey, p_brand", "p_brand IN ('Brand#13', 'Brand#2')")
matches("space_folding", "events", "event_type:click AND value:>450", "event_id", "event_type = 'click' AND value > 450")
matches("dropped_clause", "events", "nosuch:1 event_type:error", "event_id", "event_type = 'error'")
matches("presence_dropped", "events", "value:* event_type:error user_id:[* TO *]", "event_id", "event_type = 'error'")
matches("wildcard_inside", "events", "event_type:cl*ck event_type:view", "event_id", "event_type = 'view'")

# ---- lists, addresses, facets, booleans, bytes, unsigned
ADDR = "(SELECT event_id, event_type, concat('10.', user_id % 4, '.', event_id % 256, '.', user_id % 256) AS src, user_id FROM events)"
matches("ip_value", addresses, "src:10.2.5.42 OR src:10.1.77.89", "event_id, src", "src IN ('10.2.5.42', '10.1.77.89')", ADDR)
matches("ip_cidr", addresses, "src:10.2.0.0/16", "event_id", "user_id % 4 = 2", ADDR)
matches("ip_cidr_host_bits", addresses, "src:10.3.64.9/18", "event_id", "user_id % 4 = 3 AND event_id % 256 BETWEEN 64 AND 127", ADDR)
matches("ip_range_open", addresses, "src:>=10.3.200.0", "event_id", "user_id % 4 = 3 AND event_id % 256 >= 200", ADDR)
matches("ip_bare", addresses, "10.0.0.0/24", "event_id", "user_id % 4 = 0 AND event_id % 256 = 0", ADDR)
PARTS = "(SELECT p_partkey, p_type, p_retailprice, concat('/', lower(p_type), '/', lower(replace(p_brand, '#', ''))) AS category, string_split(p_name, ' ') AS words FROM part)"
matches("facet_parent", parts, "category:/promo", "p_partkey, category", "category = '/promo' OR starts_with(category, '/promo/')", PARTS)
matches("facet_leaf", parts, "category:/promo/brand13 OR category:/small/brand2", "p_partkey", "category IN ('/promo/brand13', '/small/brand2')", PARTS)
matches("list_any_element", parts, "words: IN [blue red] AND p_retailprice:<960", "p_partkey", "list_has_any(words, ['blue', 'red']) AND p_retailprice < 960", PARTS)
matches("list_not", parts, "NOT words:green", "p_partkey", "NOT list_contains(words, 'green')", PARTS)


def flags(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("done"), F.encode("o_orderpriority", "UTF-8").alias("raw"), (F.col("o_orderkey").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)").alias("big"))
    return Index("flags", df, id_from=["o_orderkey"], big="u64")


FLAGS = "(SELECT o_orderkey, o_orderstatus = 'F' AS done, o_orderpriority, CAST(o_orderkey AS HUGEINT) + 9223372036854775808 AS big FROM orders)"
matches("term_boolean", flags, "done:true", "o_orderkey, done", "done", FLAGS)
matches("term_bytes", flags, "raw:MS1VUkdFTlQ=", "o_orderkey", "o_orderpriority = '1-URGENT'", FLAGS)
matches("term_u64", flags, "big:[9223372036854775809 TO 9223372036854776000]", "o_orderkey", "big BETWEEN 9223372036854775809 AND 9223372036854776000", FLAGS)

# ---- ghosts and shadows
matches("ghost_lang", ghosts, "text_en:the", "doc_id, lang", "lang = 'en' AND list_contains(tok, 'the')", DOCS)
matches("ghost_complement", ghosts, "text_rest:de", "doc_id, lang", "lang NOT IN ('en', 'de') AND list_contains(tok, 'de')", DOCS)
matches("ghost_unqualified", ghosts, "und la", "doc_id", "(lang = 'en' OR lang = 'de' OR lang NOT IN ('en', 'de')) AND list_has_any(tok, ['und', 'la'])", DOCS)


@query("SELECT doc_id, lang FROM documents WHERE doc_id = 11 OR (starts_with(CAST(doc_id AS VARCHAR), '12') AND lang = 'en')")
def shadow_field(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "lang")
    i = Index("shadow", docs, doc_id=Field("doc_id", "string", shadow=True, indexed=False), lang="string")
    return i.filter("doc_id:11 OR (doc_id:12* AND lang:en)").select(F.col("id").cast("bigint").alias("doc_id"), "lang")


# ---- order, window, projection
page("topk_sort", "events", "event_type:click AND value:[10 TO 50] AND ts:[2024-01-01 TO 2024-01-08} sort value:desc limit 20 return event_id,value", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value BETWEEN 10 AND 50 AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08' ORDER BY value DESC, CAST(event_id AS VARCHAR) LIMIT 20")
page("sort_asc", "orders", "o_orderstatus:P sort o_totalprice limit 15 return o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice, CAST(o_orderkey AS VARCHAR) LIMIT 15")
page("sort_date", "orders", "o_orderstatus:F sort o_orderdate:desc limit 12 return o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 12")
page("sort_string", "part", "p_size:<5 sort p_type:desc limit 25 return p_partkey, p_type", "SELECT p_partkey, p_type FROM (SELECT * FROM part WHERE p_size < 5 ORDER BY CAST(p_partkey AS VARCHAR) LIMIT 50) ORDER BY p_type DESC, CAST(p_partkey AS VARCHAR) LIMIT 25")
page("sort_id", "orders", "o_orderstatus:P sort id limit 10 return o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 10")
page("sort_ip", addresses, "event_type:error sort src:desc limit 20 return event_id, src", f"SELECT event_id, src FROM {ADDR} WHERE event_type = 'error' ORDER BY user_id % 4 DESC, event_id % 256 DESC, user_id % 256 DESC, CAST(event_id AS VARCHAR) LIMIT 20")
page("paging", "events", "event_type:view sort value:desc limit 10 offset 20 return event_id", "SELECT event_id FROM events WHERE event_type = 'view' ORDER BY value DESC, CAST(event_id AS VARCHAR) LIMIT 10 OFFSET 20")
page("past_the_end", "region", "* limit 10 offset 50 return r_name", "SELECT r_name FROM region WHERE false")
page("project_order", "customer", "c_mktsegment:BUILDING sort c_acctbal:desc limit 5 return c_acctbal, c_custkey", "SELECT c_acctbal, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR) LIMIT 5")


@query("SELECT doc_id, CAST(quality AS VARCHAR) AS quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY labels.quality DESC NULLS LAST, CAST(doc_id AS VARCHAR) LIMIT 500")
def sort_nulls_last(spark, sf):
    df = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return Index("labelled", df, id_from=["doc_id"]).search("* sort quality:desc limit 500 return doc_id, quality").df.select("doc_id", F.col("quality").cast("string").alias("quality"))


@query("SELECT vec_id, round(embedding[1], 6) AS first FROM embeddings ORDER BY embedding[1], CAST(vec_id AS VARCHAR) LIMIT 10")
def sort_list_first_value(spark, sf):
    return index(spark, sf, "embeddings").search("* sort embedding limit 10").df.select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


def _bm25_sql(terms: dict[str, float], where: str, limit: int) -> str:
    parts = [f"{boost} * ln(1 + ((SELECT count(*) FROM d) - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i, boost in enumerate(terms.values())]
    tf = ", ".join(f"len(list_filter(tok, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count_if(tf{i} > 0) AS df{i}" for i in range(len(terms)))
    return f"WITH d AS (SELECT doc_id, lang, len(tok) AS dl, {tf} FROM {DOCS}), st AS (SELECT avg(dl) AS avgdl, {df} FROM d), sc AS (SELECT doc_id, {' + '.join(parts)} AS x FROM d, st WHERE {where}) SELECT doc_id, round(x, 6) AS score FROM sc ORDER BY x DESC, CAST(doc_id AS VARCHAR) LIMIT {limit}"


def _scored(spark, sf, text: str) -> DataFrame:
    return inverted(spark, sf).search(text, scores=True).df.select("doc_id", F.round("_score", 6).alias("score"))


@query(_bm25_sql({"the": 1.0, "und": 1.0}, "tf0 + tf1 > 0", 20))
def bm25_topk(spark, sf):
    return _scored(spark, sf, "text:(the und) limit 20 return doc_id")


@query(_bm25_sql({"thing": 3.0, "the": 1.0}, "tf0 + tf1 > 0", 15))
def bm25_boost(spark, sf):
    return _scored(spark, sf, "text:thing^3 OR text:the limit 15 return doc_id")


@query(_bm25_sql({"und": 1.0, "die": 1.0}, "tf0 > 0 AND tf1 > 0 AND lang = 'de'", 10).replace("AS x FROM", "+ 1.0 AS x FROM"))
def bm25_and_constant(spark, sf):
    return _scored(spark, sf, "text:und AND text:die AND lang:de limit 10 return doc_id")


@query(f"WITH d AS (SELECT doc_id, source, s, len(tok) AS dl, len(list_filter(tok, lambda x: x = 'und')) AS tf FROM {DOCS}), st AS (SELECT avg(dl) AS a, count_if(tf > 0) AS df, count(*) AS n FROM d), top AS (SELECT doc_id, source FROM d, st WHERE tf > 0 ORDER BY ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / a)) DESC, CAST(doc_id AS VARCHAR) LIMIT 20) SELECT doc_id, source FROM top ORDER BY source, CAST(doc_id AS VARCHAR) LIMIT 10")
def approximate_text_sort(spark, sf):
    return inverted(spark, sf).search("text:und sort source limit 10 return doc_id, source").df


# ---- counts and measures
@query("SELECT count(*) AS total_hits FROM events WHERE event_type = 'click' OR value > 300")
def count_only(spark, sf):
    return index(spark, sf, "events").count("event_type:click value:>300")


@query("SELECT count(*) AS total_hits FROM lineitem")
def count_all(spark, sf):
    return index(spark, sf, "lineitem").count("*")


@query("SELECT count(*) AS total_hits, min(value) AS min_value, max(value) AS max_value, max(user_id) AS max_user_id FROM events WHERE event_type = 'purchase'")
def metrics_minmax(spark, sf):
    return index(spark, sf, "events").metrics("event_type:purchase limit 0 min(value) max(value, user_id)")


@query("SELECT count(*) AS total_hits, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS min_date, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS max_date FROM orders WHERE o_orderstatus = 'P'")
def metrics_dates(spark, sf):
    m = index(spark, sf, "orders").metrics("o_orderstatus:P limit 0 min(o_orderdate) max(o_orderdate)")
    form = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return m.select("total_hits", form("min_o_orderdate").alias("min_date"), form("max_o_orderdate").alias("max_date"))


@query("SELECT count(*) AS total_hits, round(min(list_min(embedding)), 5) AS least, round(max(list_max(embedding)), 5) AS most FROM embeddings WHERE label < 5")
def metrics_lists(spark, sf):
    m = index(spark, sf, "embeddings").metrics("label:<5 limit 0 min(embedding) max(embedding)")
    return m.select("total_hits", F.round(F.col("min_embedding").cast("double"), 5).alias("least"), F.round(F.col("max_embedding").cast("double"), 5).alias("most"))


@query("SELECT count(*) AS rows, count(o_orderdate) AS populated, count_if(o_orderdate < TIMESTAMP '1996-06-01') AS before FROM orders")
def retention_profile(spark, sf):
    return retention.profile(read(spark, sf, "orders"), "o_orderdate", "1996-06-01").select("rows", "populated", "before")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01'")
def retention_prune(spark, sf):
    return retention.prune(read(spark, sf, "orders"), "o_orderdate", "1999-06-01").select("o_orderkey")


@query("SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.99) AS p99, max(value) AS most FROM events")
def percentiles(spark, sf):
    return index(spark, sf, "events").percentiles("value", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, "most")


# ---- arrays in hits
@query("SELECT p_partkey, array_to_string(words[1:1], ',') AS words, len(words) AS full_size FROM " + PARTS + " WHERE p_retailprice > 950")
def array_cap(spark, sf):
    i = parts(spark, sf)
    hits = shape(i.filter("p_retailprice:>950"), ["p_partkey", "words"], 1, [], False)
    return hits.select("p_partkey", F.array_join("words", ",").alias("words"), F.coalesce(F.element_at("_truncated_arrays", "words"), F.size("words")).cast("bigint").alias("full_size"))


@query("SELECT p_partkey, CASE WHEN words[2] = 'blue' AND words[1] <> 'blue' THEN 'blue' ELSE words[1] END AS lead_word, array_to_string(list_filter([0, 1], lambda i: words[i + 1] = 'blue'), ',') AS positions FROM " + PARTS + " WHERE list_contains(words, 'blue')")
def matched_first(spark, sf):
    i = parts(spark, sf)
    c = i.compiled("words:blue")
    hits = shape(i.df.filter(c.match), ["p_partkey", "words"], 1, c.elements, True)
    at = F.element_at("_matched_elements", "words")
    full = i.df.select("p_partkey", F.array_position("words", "blue").alias("first"), F.col("words").alias("stored"))
    both = hits.join(full, "p_partkey")
    every = F.filter(F.sequence(F.lit(0), F.size("stored") - 1), lambda k: F.get("stored", k) == "blue")
    shown = F.array_join(F.transform(F.when(F.size(at) < F.size(every), every).otherwise(at), lambda k: k.cast("string")), ",")
    return both.select("p_partkey", F.get("words", F.lit(0)).alias("lead_word"), shown.alias("positions"))


@query("WITH p AS (SELECT r_regionkey, r_name, sum(strlen('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}')) OVER (ORDER BY r_regionkey) AS b FROM region) SELECT r_regionkey, r_name, (SELECT count(*) FROM p WHERE b > 100) AS omitted FROM p WHERE b <= 100")
def response_byte_cap(spark, sf):
    page_ = read(spark, sf, "region").select("r_regionkey", "r_name")
    return cap_bytes(page_, [F.col("r_regionkey")], 100).withColumnRenamed("_omitted_hits", "omitted")


# ---- several indexes
@query("SELECT * FROM (SELECT 'orders' AS _index_source, CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS v, 0 AS k FROM orders WHERE o_totalprice > 1000 UNION ALL SELECT 'lineitem', l_orderkey || '|' || l_linenumber, l_extendedprice, 1 FROM lineitem WHERE l_extendedprice > 1000) ORDER BY v DESC, k, id LIMIT 25".replace("SELECT * FROM (", "SELECT _index_source, id, v FROM (", 1))
def federated_sorted(spark, sf):
    a = index(spark, sf, "orders")
    b = index(spark, sf, "lineitem")
    one = Index("orders", a.df.withColumn("amount", F.col("o_totalprice")), id_from=["o_orderkey"])
    two = Index("lineitem", b.df.withColumn("amount", F.col("l_extendedprice")), id_from=["l_orderkey", "l_linenumber"])
    hits, _ = federated([one, two], "amount:>1000 sort amount:desc limit 25")
    return hits.select("_index_source", "id", F.col("_sort_key").alias("v"))


@query("SELECT _index_source, id FROM (SELECT 'nation' AS _index_source, CAST(n_nationkey AS VARCHAR) AS id, 0 AS k FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), 1 FROM region) ORDER BY k, id LIMIT 28")
def federated_scored(spark, sf):
    hits, _ = federated([index(spark, sf, "nation"), index(spark, sf, "region")], "* limit 28")
    return hits.select("_index_source", "id")


# ---- writes and deletes
@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'X' FROM orders WHERE o_orderkey % 300 = 0 AND o_orderkey > 0")
def upsert(spark, sf):
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    changed = orders.filter("id % 3 = 0").withColumn("o_orderstatus", F.lit("X"))
    added = orders.filter("id % 300 = 0 and id > 0").select((-F.col("id")).alias("id"), F.lit("X").alias("o_orderstatus"))
    return writes.put(orders, changed.unionByName(added)).select(F.col("id").alias("o_orderkey"), "o_orderstatus")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def latest_with_tombstones(spark, sf):
    log = read(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("gone"), F.col("event_id").alias("seq"))
    return writes.latest(log, "user_id", "seq", "gone").select("user_id", "event_id")


@query("SELECT count_if(v % 10 <> 0) AS good, count_if(v % 10 = 0) AS rejected FROM (SELECT event_id AS v FROM events)")
def bulk_validation(spark, sf):
    cells = read(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 10 == 0, "not a number").otherwise(F.col("user_id").cast("string")).alias("n"))
    bad = writes.problem(Schema((Field("id", "string"), Field("n", "i64"))))
    return cells.agg(F.count_if(bad.isNull()).alias("good"), F.count_if(bad.isNotNull()).alias("rejected"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def id_ledger(spark, sf):
    return writes.ledger(read(spark, sf, "orders"), "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0")
def delete_many(spark, sf):
    i = index(spark, sf, "orders")
    gone = read(spark, sf, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").cast("string").alias("id")).union(spark.createDataFrame([("none",)], "id string"))
    return i.without(gone).select("o_orderkey")


@query("SELECT event_id FROM events WHERE NOT (event_type = 'error' AND value < 100)")
def delete_by_query(spark, sf):
    i = index(spark, sf, "events")
    gone, _ = i.delete_matches("event_type:error AND value:<100")
    return i.without(gone).select("event_id")


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = 'nation_3'")
def delete_exact_text(spark, sf):
    df = read(spark, sf, "nation")
    return Index("nation", df, id_from=["n_nationkey"]).filter("n_name:\"nation 3\"").select("n_nationkey", "n_name")


@query("SELECT id, a, b, c FROM (SELECT n_nationkey AS id, n_name AS a, CAST(NULL AS VARCHAR) AS b, CAST(n_regionkey AS DOUBLE) AS c FROM nation UNION ALL SELECT r_regionkey + 1000, NULL, r_name, r_regionkey + 0.5 FROM region)")
def learned_schema_union(spark, sf):
    a = read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("a"), F.col("n_regionkey").cast("double").alias("c"))
    b = read(spark, sf, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.col("r_name").alias("b"), (F.col("r_regionkey") + 0.5).alias("c"))
    return a.unionByName(b, allowMissingColumns=True).select("id", "a", "b", F.col("c").cast("double").alias("c"))


# ---- functions
@query(f"SELECT doc_id, len(tok) AS n_terms FROM {DOCS}")
def analyze_default(spark, sf):
    from querylark.analysis.analyzers import count_terms

    return read(spark, sf, "documents").select("doc_id", count_terms(TOKENIZERS["default"].column(F.col("text"))).cast("bigint").alias("n_terms"))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest(tok) AS term FROM {DOCS}) GROUP BY term HAVING count(*) > 20")
def postings_frequency(spark, sf):
    return inverted(spark, sf).inverted.table.filter("field = 'text'").groupBy("term").agg(F.sum("tf").alias("n")).filter("n > 20")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def analyze_raw(spark, sf):
    t = TOKENIZERS["raw"].column(F.col("event_type"))
    return read(spark, sf, "events").select(F.trim(t).alias("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT item_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM benchmark")
def analyze_whitespace(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.size(terms_array(TOKENIZERS["whitespace"].column(F.col("text")))).cast("bigint").alias("n"))


@query("SELECT o_orderkey, " + ", ".join(f"CAST(epoch(o_orderdate) AS BIGINT) AS {n}" for n in "abcd") + " FROM orders")
def parse_dates(spark, sf):
    o = read(spark, sf, "orders")
    said = [F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd'T'HH:mm:ss'Z'", "MM/dd/yyyy", "d MMM yyyy", "yyyyMMdd")]
    return o.select("o_orderkey", *[F.unix_timestamp(values.parse_date(c)).alias(n) for n, c in zip("abcd", said)])


@query("SELECT shape, count(*) AS n FROM (SELECT CASE event_id % 7 WHEN 0 THEN 'integer' WHEN 1 THEN 'decimal' WHEN 2 THEN 'date' WHEN 3 THEN 'ip' WHEN 4 THEN 'text' WHEN 5 THEN 'missing' ELSE 'list' END AS shape FROM events) GROUP BY shape")
def infer_shape_counts(spark, sf):
    e = read(spark, sf, "events")
    k = F.col("event_id") % 7
    n = F.col("event_id").cast("string")
    cell = F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, F.concat(n, F.lit(".25"))).when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(k == 3, F.concat(F.lit("10.0.0."), (F.col("event_id") % 250).cast("string"))).when(k == 4, F.concat(F.lit("word "), "event_type")).when(k == 5, F.lit("n/a")).otherwise(F.concat(F.lit("['a', "), n, F.lit("]")))
    return e.select(values.shape(cell).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))


@query("SELECT 'o_custkey' AS name, 'i64' AS type UNION ALL SELECT 'o_orderdate', 'date' UNION ALL SELECT 'o_orderkey', 'i64' UNION ALL SELECT 'o_orderpriority', 'string' UNION ALL SELECT 'o_orderstatus', 'string' UNION ALL SELECT 'o_totalprice', 'f64'")
def infer_schema(spark, sf):
    o = read(spark, sf, "orders")
    cells = o.select([F.date_format(c, "yyyy-MM-dd").alias(c) if t.startswith("timestamp") else F.col(c).cast("decimal(18,2)").cast("string").alias(c) if t == "double" else F.col(c).cast("string") for c, t in o.dtypes])
    return spark.createDataFrame([(p.name, infer.decide(p).type) for p in infer.profile(cells)], "name string, type string")


@query("SELECT event_id, printf('00000000000000000000ffff0a%02x%02x%02x', (user_id % 4)::INT, (event_id % 256)::INT, (user_id % 256)::INT) AS key FROM events")
def ip_keys(spark, sf):
    return addresses(spark, sf).df.select("event_id", values.ip_key(F.col("src")).alias("key"))


@query("SELECT p_partkey, array_to_string(words, '+') AS joined FROM " + PARTS)
def parse_lists(spark, sf):
    written = F.concat(F.lit("['"), F.array_join("words", "', '"), F.lit("']"))
    return parts(spark, sf).df.select("p_partkey", F.array_join(values.parse_list(written), "+").alias("joined"))


@query("SELECT o_orderkey, o_orderstatus = 'F' AS done FROM orders WHERE o_orderstatus <> 'P'")
def boolean_words(spark, sf):
    said = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "n").otherwise("maybe")
    return read(spark, sf, "orders").select("o_orderkey", values.boolean_word(said).alias("done")).filter("done is not null")


# ---- stemmers, CJK: no SQL says them
for _lang, _word in (("en", "things"), ("de", "heiten"), ("fr", "mentes"), ("es", "ciones")):

    def _stem(spark, sf, lang=_lang, word=_word):
        return stemmed(spark, sf).filter(f"text_{lang}:{word}").select("doc_id", "lang")

    QUERIES[f"stem_{_lang}"] = _stem


# ---- cells, ids, reshaping
@query("SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS VARCHAR) AS n, CASE WHEN event_id % 4 = 1 THEN 'true' ELSE NULL END AS yes FROM events")
def typed_cells(spark, sf):
    k = F.col("event_id") % 4
    cell = F.when(k == 0, "N/A").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string")))
    said = F.when(k == 1, "YES").when(k == 2, "perhaps").otherwise("-")
    return read(spark, sf, "events").select("event_id", values.typed(cell, "i64").cast("string").alias("n"), values.typed(said, "boolean").cast("string").alias("yes"))


@query("SELECT count_if(day(o_orderdate) > 12) AS day_first, 0::BIGINT AS month_first FROM orders")
def date_order_evidence(spark, sf):
    said = F.date_format("o_orderdate", "dd/MM/yyyy")
    e = values.order_evidence(F.col("c"))
    return read(spark, sf, "orders").select(said.alias("c")).agg(e["slash_day"].alias("day_first"), e["slash_month"].alias("month_first"))


@query("SELECT count(*) AS out_of_range FROM orders WHERE o_orderkey % 3 = 0")
def dates_out_of_range(spark, sf):
    far = F.when(F.col("o_orderkey") % 3 == 0, F.expr("TIMESTAMP '2999-01-01 00:00:00'")).otherwise(F.col("o_orderdate").cast("timestamp"))
    return read(spark, sf, "orders").agg(F.count_if(values.out_of_range(far)).alias("out_of_range"))


@query("SELECT 'o_orderkey' AS id")
def choose_id(spark, sf):
    cells = read(spark, sf, "orders").select(*[F.col(c).cast("string") for c in ("o_custkey", "o_orderstatus", "o_orderkey")])
    return spark.createDataFrame([("|".join(infer.choose_id(infer.profile(cells))),)], "id string")


@query("SELECT form, lemma, n FROM (SELECT lower(p_brand) AS form, lower(p_type) AS lemma, count(*) AS n, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY count(*) DESC, lower(p_type)) AS k FROM part GROUP BY 1, 2) WHERE k = 1")
def lexicon_lemmas(spark, sf):
    from querylark.analysis.lexicon import lemmas

    return lemmas(read(spark, sf, "part").select(F.col("p_brand").alias("form"), F.col("p_type").alias("lemma")))


@query("SELECT 'documents' AS index, count(*) AS documents FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def catalog_statistics(spark, sf):
    return reduce_union([index(spark, sf, t).statistics().select("index", "documents") for t in ("documents", "pages")])


@query("SELECT o_custkey % 1000 AS k, count(*) AS n FROM orders GROUP BY 1")
def routing(spark, sf):
    routed = writes.route(read(spark, sf, "orders").withColumn("k", F.col("o_custkey") % 1000), 8, "k")
    per_shard = routed.groupBy("k", F.spark_partition_id().alias("shard")).agg(F.count("*").alias("n"))
    return per_shard.groupBy("k").agg(F.max("n").alias("n"))  # equal keys meet in one shard, so its count is the whole


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01'")
def retention_expired(spark, sf):
    return retention.expired(read(spark, sf, "orders"), "o_orderdate", "1995-06-01").select("o_orderkey")


@query(f"SELECT doc_id FROM {DOCS} WHERE lang = 'en' AND contains(s, ' of the ') AND NOT contains(s, ' and ') ORDER BY doc_id")
def strict_mode(spark, sf):
    i = inverted(spark, sf)
    return i.filter('+text:"of the" -text:and +lang:en', strict=True).select("doc_id")


# ---- values over whole tables
@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def epoch_dates_all(spark, sf):
    return read(spark, sf, "events").select("event_id", F.unix_timestamp(values.epoch_date(F.unix_timestamp("ts"))).alias("seconds"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def object_values_all(spark, sf):
    from querylark.functions.reshape import object_values as of

    return read(spark, sf, "events").select("event_id", F.get(of(F.col("props")), F.lit(0)).alias("value"))


@query("SELECT doc_id, replace(strip_accents(lower(lang || ' ' || text)), 'ß', 'ss') AS folded FROM documents")
def accent_fold_all(spark, sf):
    c = TOKENIZERS["raw_fold"].column(F.concat_ws(" ", "lang", "text"))
    return read(spark, sf, "documents").select("doc_id", F.substring(c, F.lit(2), F.length(c) - 2).alias("folded"))  # longer than the text where a letter becomes two


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 60 + l_linenumber AS seconds FROM lineitem")
def durations_all(spark, sf):
    from querylark.functions.reshape import duration_seconds

    said = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(":"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", duration_seconds(said).alias("seconds"))


@query("SELECT l_orderkey || '|' || l_linenumber AS id FROM lineitem")
def compose_id_all(spark, sf):
    return writes.compose_id(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).select("id")


def reduce_union(parts_: list[DataFrame]) -> DataFrame:
    out = parts_[0]
    for p in parts_[1:]:
        out = out.unionByName(p)
    return out


from querylark import queries_more  # noqa: E402, F401  registers the rest
