"""What stages hold in the driver, and how many jobs it runs for them."""

import tracemalloc

import numpy as np
import pytest

from querylark.llm import common, language, near_duplicates


def jobs(spark, make):
    """The rows of make(), and how many jobs they took."""
    group = f"counted {id(make)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        rows = make().collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_chain_of_links_takes_few_jobs(spark):
    """Steps by joins took more jobs, plans and broadcast tables the longer the chain is."""
    links = common.materialize(spark.createDataFrame([(i, i + 1) for i in range(64)] + [(101, 100), (102, 101)], "a long, b long"))
    rows, n = jobs(spark, lambda: near_duplicates.components(links))
    assert {r["doc_id"]: r["component"] for r in rows} == {i: 0 for i in range(65)} | {100: 100, 101: 100, 102: 100}
    assert len(rows) == 68 and n <= 4


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_components_are_equal_by_steps_and_in_one_task(spark, monkeypatch, most):
    monkeypatch.setattr(near_duplicates, "LINKS", most)
    r = np.random.default_rng(5)
    pairs = r.integers(0, 300, (220, 2))
    want = {int(i): int(i) for i in np.unique(pairs)}
    for _ in want:
        for a, b in pairs.tolist():
            want[a] = want[b] = min(want[a], want[b])
    got = near_duplicates.components(spark.createDataFrame(pairs.tolist(), "a long, b long")).collect()
    assert {x["doc_id"]: x["component"] for x in got} == want and len(got) == len(want)


def test_no_links_have_no_components(spark):
    assert near_duplicates.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_the_sample_is_held_once(spark):
    """Rows, wider numbers and sort keys beside them took over 20 bytes a subword."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    language.sample(docs, 1000, None, "doc_id", "text", "lang")  # what is imported and cached at first isn't counted
    tracemalloc.start()
    try:
        data = language.sample(docs, 1000, None, "doc_id", "text", "lang")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    subwords = sum(len(b) for _, b, _, _ in data)
    assert len(data) > 200 and subwords > 100_000
    assert peak < 14 * subwords
