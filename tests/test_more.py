"""Deadlines, lexicons, fold tables, reshaping, analyzers as columns."""

import time

import pytest
from pyspark.sql import functions as F

from querylark.analysis import lexicon
from querylark.analysis.analyzers import GAP, TOKENIZERS, analysed, count_of, count_terms
from querylark.functions import reshape
from querylark.operators.deadline import DeadlineExceeded, deadline


def test_deadline_cancels_jobs(spark):
    slow = F.udf(lambda x: time.sleep(20) or x, "long")
    began = time.time()
    with pytest.raises(DeadlineExceeded), deadline(spark, 2):
        spark.range(4).select(slow("id")).collect()
    assert time.time() - began < 15
    with deadline(spark, 60):
        assert spark.range(4).count() == 4


def test_lexicon_and_rules(spark):
    rows = [("walks", "walk")] * 3 + [("walks", "walks"), ("talks", "talk"), ("Talks", "talk"), ("barks", "bark"), (None, "x")]
    found = lexicon.lemmas(spark.createDataFrame(rows, "form string, lemma string"))
    assert {r["form"]: r["lemma"] for r in found.collect()} == {"walks": "walk", "talks": "talk", "barks": "bark"}
    assert [(r["suffix"], r["replacement"], r["n"]) for r in lexicon.suffix_rules(found).collect()] == [("s", "", 3)]
    assert lexicon.fold_table({"a": "b", "b": "c", "x": "y", "y": "x"}) == {"a": "c", "b": "c", "y": "x"}


def test_reshaping(spark):
    df = spark.createDataFrame([('{"1": "drama", "2": "war"}', "a, b,,c", "2:05", "1:02:03"), ("x", "", "205", None)], "o string, l string, d string, e string")
    got = [tuple(r) for r in df.select(reshape.object_values("o"), reshape.split_list(F.col("l")), reshape.duration_seconds(F.col("d")), reshape.duration_seconds(F.col("e"))).collect()]
    assert got[0] == (["drama", "war"], ["a", "b", "c"], 125, 3723) and got[1][1:] == ([], None, None)


@pytest.mark.parametrize("name", sorted(TOKENIZERS))
def test_columns_analyse_as_the_query_side_does(spark, name):
    texts = ["The Running-dogs, Häuser; mesas", "学習する 國語 abc", "", " .. ", "x" * 200 + " short", "Über straße ŒUVRE"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0].split() for r in df.select(analysed(F.col("t"), name, False)).collect()]
    assert got == [" ".join(TOKENIZERS[name].terms(t)).split() for t in texts]


def test_lists_keep_elements_apart(spark):
    df = spark.createDataFrame([(["a b", "c"], "a a a"), (None, None)], "l array<string>, t string")
    s = analysed(F.col("l"), "default", True)
    t = analysed(F.col("t"), "default", False)
    row, none = df.select(s.alias("s"), F.contains(s, F.lit(" b  c ")).alias("across"), F.contains(s, F.lit(" a  b ")).alias("inside"), count_of(t, " a ").alias("n"), count_terms(t).alias("k")).collect()
    assert row["s"] == f" a  b {GAP} c " and (row["across"], row["inside"], row["n"], row["k"]) == (False, True, 3, 3)
    assert none["s"] == "" and none["k"] == 0


def test_texts_are_analysed_once_to_count_terms(spark):
    from pyspark.sql import functions as F

    from querylark.analysis.analyzers import TOKENIZERS, count_of, count_terms

    df = spark.createDataFrame([("One two,  two",), ("",), (None,), ("...",)], "t string")
    times = lambda c: df.select(c)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")
    analysed = TOKENIZERS["default"].column(F.col("t"))
    assert times(count_terms(analysed)) == times(count_of(analysed, " two ")) == times(analysed)
    assert [tuple(r) for r in df.select(count_terms(analysed), count_of(analysed, " two ")).collect()] == [(3, 2), (0, 0), (None, None), (0, 0)]
