"""The code-point model of quality: a distribution, whole in buckets, and judging by more than classes."""

import random

import numpy as np
import pytest

from querylark.llm import points, quality


def han(r, words, n=120):
    return " ".join(r.choice(words) for _ in range(n))


def rows():
    r = random.Random(5)
    signs = [chr(0x4E00 + i) for i in range(400)]
    words = ["".join(r.choice(signs) for _ in range(r.randrange(2, 5))) for _ in range(200)]
    clean = [(i, han(r, words), "zh") for i in range(120)]
    classes = quality.character_classes()
    alike = {x: [y for y in signs if classes[ord(y)] == classes[ord(x)]] for x in signs}
    mixed = [(900 + i, "".join(r.choice(alike.get(x, [x])) for x in clean[i][1]), "zh") for i in range(4)]  # the same classes
    return clean + mixed


def test_usual_characters_in_unusual_places_are_rejected(spark):
    got = {x["doc_id"]: x["kept"] for x in quality.judge(spark.createDataFrame(rows(), "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(120)) and not any(got[900 + i] for i in range(4))


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_model_sums_to_one_whatever_the_buckets(spark, monkeypatch, size):
    monkeypatch.setattr(points, "BUCKET", size)
    texts = [t for _, t, _ in rows()[:20]]
    folder = points.build(spark.createDataFrame([(t, "zh") for t in texts], "text string, lang string"))
    every = np.arange(points.POINTS, dtype=np.int64)
    for f, model in ((f, points.find(folder, "zh", f)) for f in (0, 1)):
        hi, lo, _ = points.grams([t for t in texts if points.fold(t) == f])
        for i in (0, 7, 300):
            p = points.log_probability(model, np.full(len(every), hi[i]), lo[i] & ~points.ONE | every)
            assert np.exp(p).sum() == pytest.approx(1, abs=1e-3)
    total = sum(-points.costs([t], points.find(folder, "zh", 1 - points.fold(t)))[0][0] for t in texts)
    assert total == pytest.approx(test_model_sums_to_one_whatever_the_buckets.__dict__.setdefault("total", total), abs=1e-3)
