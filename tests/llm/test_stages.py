"""Stages of the pipeline over null and repeated doc_ids."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from querylark.llm import common, near_duplicates

STAGE = dict(corpus_pipeline.STAGES)


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", len(t)) for d, t in rows], "doc_id long, text string, lang string, n_chars long")


def test_quality_rejects_rows_not_ids(spark):
    good = [(i, " ".join(f"{w} of the {i % 7}" for w in "one two three four five six seven eight".split())) for i in range(20)]
    got = STAGE["quality"](spark, table(spark, good + [(None, "too short"), (3, "also short"), (None, good[0][1])]), "").collect()
    texts = [(r["doc_id"], r["text"]) for r in got]
    assert (None, "too short") not in texts and (3, "also short") not in texts and good[3] in texts and (None, good[0][1]) in texts


def test_one_of_equal_rows_stays(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven", "red green blue cyan pink gold grey")
    got = STAGE["near_duplicates"](spark, table(spark, [(5, a), (5, a), (2, a), (2, b), (None, b), (None, c), (None, c)]), "").collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in got) == sorted([(2, a), (2, b), (0, c)])
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "n_chars"}


def test_every_stage_takes_them(spark):
    docs = table(spark, [(None, "Der Hund und die Katze " * 3), (1, "the cat and the dog " * 3), (1, "the cat and the dog " * 3), (1, "another text of that id")])
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").collect()
        assert stage(spark, docs.filter("false"), "").collect() == [], name


def test_tables_between_steps_are_deleted(spark):
    """Near-duplicates leave their result on disk, and stages the rows they number and the numbers they drop; an outer step keeps it as long as it needs it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

    def left(make):
        before = len(common._made)
        rows = make().collect()
        return sum(os.path.isdir(at.removeprefix("file:")) for at in common._made[before:]), rows

    n, rows = left(lambda: near_duplicates.deduplicate(docs, 5))
    assert n == 1 and len(rows) == docs.count()
    twice = docs.union(docs.withColumn("text", F.concat("text", F.lit(" and one more"))))  # goes by rows
    n, rows = left(lambda: near_duplicates.deduplicate(twice, 5))
    assert n == 1 and len(rows) == 2 * docs.count()
    assert left(lambda: STAGE["quality"](spark, docs, ""))[0] == 2
    assert left(lambda: STAGE["near_duplicates"](spark, docs, ""))[0] == 2
