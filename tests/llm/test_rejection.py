"""Language identification rejects what it never learned."""

import random

from querylark.llm import language

SF = "/root/testdata/sf0.001"
FOREIGN = [
    "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
]


def test_foreign_and_shuffled_texts_are_rejected_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs, ~language.held_out())
    clean = [r["text"] for r in docs.filter(language.held_out()).collect()]
    r = random.Random(2)
    shuffled = []
    for t in clean:
        letters = [c for c in t if c.isalpha()]
        r.shuffle(letters)
        shuffled.append("".join(letters.pop() if c.isalpha() else c for c in t))
    rejected = {k: language.columns(many, model)[2].mean() for k, many in (("clean", clean), ("shuffled", shuffled), ("foreign", FOREIGN), ("even", ["".join(r.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(600)) for _ in range(20)]))}
    assert rejected["clean"] <= 0.03 and rejected["shuffled"] >= 0.9 and rejected["foreign"] == 1 and rejected["even"] == 1
