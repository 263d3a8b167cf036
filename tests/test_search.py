"""Small indexes built by hand: which ids a query finds, what it reports and what it refuses."""

from datetime import datetime

import pytest

from querylark.operators.search import Index, Limits, federated
from querylark.query.parser import QueryRefused
from querylark.schema import Field, Ghost


def ids(index, query, **options):
    return sorted(r["id"] for r in index.search(query, limit=100, fields=["id"], **options).df.collect())


@pytest.fixture(scope="module")
def titles(spark):
    rows = [("d1", "rust language", "systems"), ("d2", "go language", "systems"), ("d3", "rust cookbook", "draft")]
    return Index("titles", spark.createDataFrame(rows, "id string, title string, tag string"), tag="string", id="string")


@pytest.mark.parametrize(
    "query, found",
    [
        ("title:rust AND NOT tag:draft", "d1"), ("title:rust AND NOT tag:nosuch", "d1 d3"), ("title:rust OR NOT tag:systems", "d1 d3"), ("title:rust OR NOT tag:draft", "d1 d2 d3"),
        ("title:rust OR NOT tag:systems OR title:go", "d1 d2 d3"), ("NOT tag:draft", "d1 d2"), ("title:rust NOT tag:draft", "d1"), ("rust", "d1 d3"), ("rust go", "d1 d2 d3"), ("*", "d1 d2 d3"),
        ("+rust language", "d1 d3"), ("tag:Draft", ""), ("title:(rust AND cookbook)", "d3"), ("id:d2", "d2"), ("id:d3* AND tag:draft", "d3"), ('title:"rust language"', "d1"), ('title:"language rust"', ""),
        ('title:"language rust"~2', "d1"), ('title:"language rust"~1', ""), ('"go lang"*', "d2"), ("title:lang*", "d1 d2"), ("tag: IN [draft x]", "d3"), ("title:[go TO m}", "d1 d2"), ("a not b", ""),
    ],
)
def test_boolean_and_text_forms(titles, query, found):
    assert ids(titles, query) == found.split()


@pytest.mark.parametrize("query", ["nosuch:1", "title:*", "tag:[* TO *]", "title:!!", ""])
def test_a_query_of_which_nothing_is_left_is_refused(titles, query):
    with pytest.raises(QueryRefused):
        titles.search(query)


def test_dropped_clauses_are_reported_and_refused_when_strict(titles):
    r = titles.search("titel:rust tag:draft")
    assert [x["id"] for x in r.df.collect()] == ["d3"] and "title" in r.discarded[0]
    with pytest.raises(QueryRefused):
        titles.search("titel:rust tag:draft", strict=True)


def test_prefixes(spark):
    rows = [("d1", "Quick Brown Fox", "urn:cve:2024"), ("d2", "quid pro quo", "urn:cwe:79"), ("d3", "zebra fo9x zzz ÿak", "zzz")]
    i = Index("p", spark.createDataFrame(rows, "id string, title string, tag string"), tag="string", id="string")
    for q, found in {"title:qui*": "d1 d2", "title:brow*": "d1", "title:xyz*": "", "title:quic*": "d1", "title:QUIC*": "d1", "tag:urn:c*": "d1 d2", "tag:URN*": "", "zeb*": "d3"}.items():
        assert ids(i, q) == found.split(), q
    assert i.search("title:q*").discarded and ids(i, "title:q*") == []
    off = Index("p", i.df, i.schema, limits=Limits(bare_prefix=False))
    assert ids(off, "zeb*") == [] and off.search("zeb*").discarded


def test_dates(spark):
    days = ["2023-06-15", "2024-01-01", "2024-06-15", "2024-07-01", "2025-01-01"]
    i = Index("d", spark.createDataFrame([(d, datetime.fromisoformat(d + "T12:00:00")) for d in days], "id string, created timestamp_ntz"), id="string")
    for q, found in {
        "created:[2024-06 TO 2024-08]": days[2:4], "created:[2024 TO 2025}": days[1:4], "created:>2024-06": days[2:], "created:[2024/06/01 TO 2024/08/01]": days[2:4], "created:[20240601 TO 20240801]": days[2:4],
        "created:1718452800": [days[2]], "created: IN [2024-06-15T12:00:00Z 2025-01-01T12:00:00Z]": [days[2], days[4]], "created:2024-06-15": [], "created:2024-06-15T12:00:00Z": [days[2]],
        "created:[2024-06-15 TO 2024-06-16}": [days[2]], 'created:"2024-06-15 12:00:00"': [days[2]], "created:>9999-01-01": [], "created:<9999-01-01": days, "created:<0001-01-01": [],
    }.items():
        assert ids(i, q) == found, q
    assert i.search("created:2024-06-15 12:00:00").discarded


def test_sort_window_and_refusals(spark):
    rows = [("a", "alpha rust", 2020, 9.5), ("b", "beta rust", 2022, 4.5), ("c", "gamma rust", 2018, 19.0), ("d", "delta rust", 2024, None)]
    i = Index("s", spark.createDataFrame(rows, "id string, title string, year int, price double"), id="string")
    order = lambda q, **o: [r["id"] for r in i.search(q, **o).df.collect()]
    assert order("* sort year") == ["c", "a", "b", "d"] and order("* sort year:desc") == ["d", "b", "a", "c"]
    assert order("* sort price") == ["b", "a", "c", "d"] and order("* sort price:desc") == ["c", "a", "b", "d"]
    assert order("* sort year limit 2 offset 1") == ["a", "b"] and order("* sort year offset 9") == []
    assert i.search("* offset 9").total_hits == 4
    r = i.search("rust sort title:desc limit 2")
    assert r.approximate_sort == "title"
    assert [x["id"] for x in i.search("* sort title:desc", exact_sort=True).df.collect()] == ["c", "d", "b", "a"]
    for bad in ("* sort nosuch", "* limit 9000 offset 2000", "* array 200000"):
        with pytest.raises(QueryRefused):
            i.search(bad)
    assert i.search("year:[2018 TO 2020] limit 0").total_hits == 2


def test_addresses(spark):
    rows = [("d1", "10.1.2.3", ["192.168.0.1", "8.8.8.8"], "router"), ("d2", "2001:db8::1", ["::1"], "v6 host"), ("d3", "::ffff:10.1.2.4", None, "mapped"), ("d4", "10.200.0.1", None, "far"), ("d5", None, None, "none"), ("d6", "9.9.9.9", None, "resolver")]
    i = Index("ip", spark.createDataFrame(rows, "id string, src string, ips array<string>, note string"), src=Field("src", "ip", fast=True), ips=Field("ips", "ip", many=True), id="string")
    for q, found in {
        "8.8.8.8": "d1", "10.1.2.0/24": "d1 d3", "src:10.0.0.0/8": "d1 d3 d4", "src:10.9.9.9/8": "d1 d3 d4", "src:0.0.0.0/0": "d1 d3 d4 d6", "8.8.8.8 AND note:router": "d1",
        'src:"2001:db8::/32"': "d2", "src:>=10.1.2.4": "d3 d4", "ips:[8.0.0.0 TO 9.0.0.0]": "d1", "NOT src:0.0.0.0/0": "d2 d5",
    }.items():
        assert ids(i, q) == found.split(), q
    assert "10.1.0.0/16" in i.search("src:10.1.* note:far").discarded[0]
    assert [r["id"] for r in i.search("* sort src limit 9").df.collect()] == ["d6", "d1", "d3", "d4", "d2", "d5"]


def test_measures(spark):
    t = datetime.fromisoformat
    rows = [("a", -40, 1.5, t("2026-01-10T08:00:00"), [3, 90]), ("b", 12, -2.25, t("2026-03-01T00:00:00"), [-8]), ("c", -900, float("inf"), t("2025-06-30T23:59:59"), None), ("d", None, None, None, None)]
    i = Index("m", spark.createDataFrame(rows, "id string, delta long, score double, seen timestamp_ntz, readings array<long>"), id="string", delta="i64")
    m = i.search("* limit 0 min(delta, readings) max(score, seen)").metrics
    assert m == {"min": {"delta": -900, "readings": -8}, "max": {"score": 1.5, "seen": "2026-03-01T00:00:00Z"}}
    assert i.search("id:d limit 0 min(delta)").metrics == {"min": {"delta": None}}
    with pytest.raises(QueryRefused):
        i.search("* min(id)")


def test_ghosts(spark):
    rows = [("en", "en", "doc-en running shared"), ("hr", "hr", "doc-hr running shared"), ("none", None, "doc-none running shared"), ("empty", "en", None)]
    df = spark.createDataFrame(rows, "id string, lang string, text string")
    en = Field("text_en", "text", tokenizer="en_stem", ghost=Ghost("text", "lang", within=("en",)))
    rest = Field("text_rest", "text", ghost=Ghost("text", "lang", outside=("en",)))
    i = Index("g", df, lang="string", text_en=en, text_rest=rest, id="string")
    assert ids(i, "text_en:run") == ["en"] and ids(i, "text_rest:run") == [] and ids(i, "text_rest:running") == ["hr", "none"] and ids(i, "text:running") == ["en", "hr", "none"]
    assert "text_en" not in i.search("*").df.columns
    assert i.search("*", fields=["id", "text_en"]).discarded


def test_shadow_lists_and_matched_elements(spark):
    rows = [(1, "first", [f"d{i}.org" for i in range(50)]), (2, "second", ["x.org"])]
    df = spark.createDataFrame(rows, "book int, title string, domains array<string>")
    i = Index("b", df, book=Field("book", "string", shadow=True, indexed=False), domains=Field("domains", "string", many=True))
    hit = i.search("domains:d40.org array 3 return id, domains").df.collect()[0]
    assert hit["domains"] == ["d40.org", "d0.org", "d1.org"] and hit["_truncated_arrays"] == {"domains": 50} and hit["_matched_elements"] == {"domains": [40]} and hit["book"] == "1"
    plain = i.search("domains:d40.org array 3 matches off").df.collect()[0]
    assert plain["domains"] == ["d0.org", "d1.org", "d2.org"] and i.search("book:2").total_hits == 1
    assert i.search("domains:d40.org array 0").df.collect()[0]["domains"] == []


def test_nested_arrays_are_cut_with_their_paths(spark):
    df = spark.sql("select 'a' as id, named_struct('names', array('x','y','z')) as dns, array(named_struct('v', array(1,2,3)), named_struct('v', array(4))) as runs")
    hit = Index("n", df, id="string").search("* array 2").df.collect()[0]
    assert hit["dns"]["names"] == ["x", "y"] and hit["_truncated_arrays"] == {"dns.names": 3, "runs[0].v": 3}


def test_federated(spark, titles):
    other = Index("other", spark.createDataFrame([("x1", "rust rust")], "id string, title string"), id="string")
    hits, _ = federated([titles, other], "title:rust limit 10")
    assert sorted((r["_index_source"], r["id"]) for r in hits.collect()) == [("other", "x1"), ("titles", "d1"), ("titles", "d3")]
    for bad in ("tag:draft", "title:rust min(title)"):
        with pytest.raises(QueryRefused):
            federated([titles, other], bad)
    with pytest.raises(QueryRefused):
        federated([titles, titles], "*")


def test_delete_by_query(spark):
    rows = [("a", "expired", ["Acme Corp"], 22, "10.0.0.1"), ("b", "expired", ["ACME CORP"], 443, "10.0.9.9"), ("c", "live", ["Other Ltd", "Acme Corp"], 3389, "192.168.1.1"), ("d", "Expired", ["Beta"], 8080, "2001:db8::1")]
    i = Index("x", spark.createDataFrame(rows, "id string, status string, company array<string>, port int, addr string"), status="string", addr="ip", id="string", company=Field("company", "text", many=True))
    r = i.delete_by_query('company:"Acme Corp"')
    assert (r["matched"], r["skipped_inexact"]) == (2, 1) and sorted(x["id"] for x in r["survivors"].collect()) == ["b", "d"]
    assert i.delete_by_query("status:expired AND port:>100", dry_run=True)["deleted"] == 0
    assert sorted(x["id"] for x in i.delete_matches("addr:10.0.0.0/8")[0].collect()) == ["a", "b"]
    for bad in ("acme", "*", "status:exp*", "company:acme", 'company:"acme corp"~2', "company:[a TO b]", 'status:live OR company:"Beta"', "NOT company:\"Beta\"", "nosuch:1 status:live", "id:>a"):
        with pytest.raises(QueryRefused):
            i.delete_by_query(bad)
    with pytest.raises(QueryRefused):
        Index("x", i.df, i.schema, limits=Limits(delete=1)).delete_by_query("status:expired")


def test_validate_advice_and_response(titles):
    v = titles.validate("title:rust AND NOT tag:draft", "tit")
    assert v["normalized"] == "+title:rust -tag:draft" and v["runs"] and v["fields"][0] == "title"
    assert titles.advice("tag:DRAFT") == ["tag: 'draft' is found 1 times, 'DRAFT' never"]
    r = titles.search("rust limit 1").response()
    assert r["total_hits"] == 2 and r["hits_returned"] == 1 and "_discarded_clauses" not in r
    assert len(list(titles.search("rust").stream())) == 3


def test_a_built_index_answers_alike(titles, tmp_path):
    built = titles.build(str(tmp_path / "i"))
    for q in ("rust", 'title:"go language"', "title:la*"):
        assert ids(built, q) == ids(titles, q)
    assert {(r["term"], r["tf"]) for r in titles.postings("title").filter("id = 'd1'").collect()} == {("rust", 1), ("language", 1)}


def test_missing_values_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None, None)], "id string, t string, n int")
    i = Index("e", df, id="string")
    assert ids(i, "NOT n:1") == ["a"] and ids(i, "t:x OR n:>0") == []
    none = Index("e", df.filter("false"), id="string")
    assert none.search("t:x").total_hits == 0 and none.search("x y").df.collect() == []
