"""Queries that return every match and run over whole tables."""

import pytest

from querylark import queries
from querylark.operators import search

SF = "/root/testdata/sf0.001"


def test_no_row_cap_on_all_matches(spark, monkeypatch):
    many = spark.range(120_000, 130_000).selectExpr("id as doc_id", "'en' as lang", "'one of the many' as text", "15 as n_chars", "'x' as source")
    many = many.union(many.selectExpr("doc_id + 1000000", "lang", "text", "n_chars", "source"))
    monkeypatch.setattr(queries, "read", lambda *_: many)
    assert queries.QUERIES["shadow_field"](spark, SF).count() == 10_000
    monkeypatch.setattr(queries, "index", lambda *_: search.Index("documents", many, doc_id="i64", text="text", lang="string", id_from=["doc_id"]))
    assert queries.QUERIES["strict_mode"](spark, SF).count() == 20_000


@pytest.mark.parametrize("name, table", [("epoch_dates_all", "events"), ("object_values_all", "events"), ("accent_fold_all", "documents"), ("durations_all", "lineitem"), ("compose_id_all", "lineitem")])
def test_every_row_of_the_table(spark, name, table):
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
