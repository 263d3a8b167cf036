"""The inverted index gives what scanning the text gives."""

import pytest
from pyspark.sql import functions as F

from querylark import queries
from querylark.operators.search import Index
from querylark.schema import Field, Ghost

ROWS = [
    ("1", "the quick brown fox", ["red apple", "green pear"], "en"), ("2", "quick the fox brown quick", ["pear", "red"], "de"), ("3", None, None, None), ("4", "", [], "en"),
    ("5", "fox, THE quick! brown; the the fox", ["apple green"], "en"), ("6", "brown of the fox quick", [None, "fox"], "fr"), ("7", "naïve " * 50 + "the fox", ["a", "b"], "en"),
]
QUERIES = [
    "t:the", "t:the AND NOT t:quick", "NOT t:the", "the fox", "+fox -quick", 't:"the quick"', 't:"quick brown f"*', 't:"the fox"~2', 't:"fox the"~2', 't:"the quick brown"~1', "t:qu*", "t: IN [brown naïve]", "t:[p TO r]",
    "l:red", 'l:"apple green"', 'l:"red apple"', "x:fox", "x:the OR l:fox", "t:nosuch OR lang:fr", "t:the AND lang:en", "id:2 OR t:naïve",
]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, "id string, t string, l array<string>, lang string")
    types = {"t": "text", "l": Field("l", "text", many=True), "lang": "string", "x": Field("x", "text", ghost=Ghost("t", "lang", within=("en",)))}
    plain = Index("p", df, **types)
    return plain, plain.invert(str(tmp_path_factory.mktemp("postings")))


@pytest.mark.parametrize("text", QUERIES)
def test_same_hits(both, text):
    plain, fast = both
    assert sorted(r["id"] for r in fast.filter(text).collect()) == sorted(r["id"] for r in plain.filter(text).collect())


@pytest.mark.parametrize("text", ["t:the", "t:(the quick) limit 5", 't:"the fox"', "the^2 fox", "t:the AND lang:en"])
def test_same_scores(both, text):
    one, two = ([(r["id"], round(r["_score"], 9)) for r in i.search(text, scores=True).df.collect()] for i in both)
    assert one == two


def test_slop_takes_any_order_of_several_terms(both):
    assert {r["id"] for r in both[1].filter('t:"fox the quick"~5').collect()} >= {"1", "2"} and [r["id"] for r in both[1].filter('t:"fox the quick"~1').collect()] == ["5"]


def test_only_the_terms_rows_are_read(both):
    plan = both[1].inverted.answer([both[1].compiled("t:fox").asks[0]])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(field,t)" in plan and "EqualTo(term,fox)" in plan


def test_without_a_broadcast(both, monkeypatch):
    from querylark.operators import postings

    want = sorted(r["id"] for r in both[1].filter("the fox").collect())
    monkeypatch.setattr(postings, "BROADCAST_ROWS", 0)
    assert sorted(r["id"] for r in both[1].filter("the fox").collect()) == want


def test_decomposed_letters_are_found(spark):
    df = spark.createDataFrame([("1", "café"), ("2", "café")], "id string, t string")
    assert Index("d", df, t=Field("t", "text", tokenizer="raw_fold")).filter("t:cafe").agg(F.count("*")).first()[0] == 2


def test_postings_follow_the_table(spark, tmp_path):
    """A table that is written again under the same name is indexed again; one that stays is not."""
    rows = lambda n: spark.range(n).selectExpr("id as doc_id", "'one of the many' as text", "'en' as lang", "'x' as source", "15 as n_chars")
    at = f"{tmp_path}/documents.parquet"
    rows(10).write.parquet(at)
    assert queries.QUERIES["strict_mode"](spark, str(tmp_path)).count() == 10
    first = queries.inverted(spark, str(tmp_path))
    assert queries.inverted(spark, str(tmp_path)) is first
    rows(30).write.mode("overwrite").parquet(at)
    assert queries.QUERIES["strict_mode"](spark, str(tmp_path)).count() == 30


def shuffled_rows(spark) -> int:
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))


def test_terms_are_shuffled_and_not_tokens(spark, tmp_path, monkeypatch):
    from querylark.operators import postings

    monkeypatch.setattr(postings, "SAMPLED", 10, raising=False)
    df = spark.range(2000).selectExpr("cast(id as string) as id", "concat_ws(' ', transform(sequence(0, 199), i -> concat('w', (id + i) % 50))) as t").repartition(4).cache()
    assert df.count() == 2000
    began = shuffled_rows(spark)
    i = Index("many", df, t="text").invert(f"{tmp_path}/many")
    assert shuffled_rows(spark) - began < 20_000  # of 400,000 tokens and 100,000 postings
    assert i.inverted.table.filter("field = 't'").agg(F.sum("tf"), F.count("*"), F.sum("dl")).first()[:] == (400_000, 100_000, 20_000_000)
    assert i.inverted.documents_with([("t", "w7"), ("t", "w8")]) == {("t", "w7"): 2000, ("t", "w8"): 2000} and i.inverted.totals["t"] == 400_000
    assert i.filter('t:"w7 w8 w9"').count() == 2000 and i.filter('t:"w7 w9"').count() == 0


def test_a_frequent_term_is_spread(spark, tmp_path):
    df = spark.range(300).selectExpr("cast(id as string) as id", "concat('the the the the the t', id) as t").repartition(6)
    table = Index("spread", df, t="text").invert(f"{tmp_path}/spread").inverted.table
    files = table.filter("term = 'the'").select(F.input_file_name()).distinct().count()
    assert files > 1 and table.filter("term = 'the'").agg(F.sum("tf"), F.count_distinct("id")).first()[:] == (1500, 300)
