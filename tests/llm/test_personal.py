"""Personal data without caps, in time in proportion, and what is chosen of overlapping proposals."""

import random
import time

from pyspark.sql import functions as F

from querylark.llm import pii, pii_model, pii_training


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["spans"] for r in pii.summary(pii.find(df)).collect()}


def test_long_and_letter_secrets_and_addresses(spark):
    long, letters, local = "a" * 70 + "1", "hunterhunterhunter", "x" * 70
    texts = [f'the token = "{long}" was', f'the password = "{letters}" was', f"write to {local} [at] mail [dot] com now", "the password = 'kQ7!mzz2x' was", "ein Donaudampfschifffahrtsgesellschaftskapitän kam", "see docs/guide/install/first/steps here"]
    got = spans(spark, texts)
    assert got[0] == f"secret:{texts[0].index(long)}:{texts[0].index(long) + 71}" and got[1] == f"secret:{texts[1].index(letters)}:{texts[1].index(letters) + 18}"
    assert got[2].startswith(f"email_written:{texts[2].index(local)}:") and got[3].startswith("secret:") and got[4] == got[5] == ""


def test_chosen_spans_by_brute_force(spark):
    r = random.Random(12)
    bits = ["a@b.co", "token = \"0a1b2c3d4e5f60718293\"", "tel 555-123-4567", "+1 (407) 555-7710", "10.2.3.4", "ssn 123-45-6789", "jo.b [at] mail [dot] com", "4111 1111 1111 1111", " and ", "x", "5", "-"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 9))) for _ in range(300)] + [" ".join(r.choice(bits) for _ in range(700))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.with_spans(df).withColumn("base", pii.base_spans(F.col("text"))).withColumn("scored", pii.scored(F.col("text"))).collect()
    for x in rows:
        base = [(b["s"], b["e"]) for b in x["base"]]
        kept = []
        for c in sorted(tuple(c) for c in x["scored"]):
            if any(s < c[1] and c[0] < e for s, e in base):
                continue
            if not kept or kept[-1][1] <= c[0]:
                kept.append(c)
            elif c[3] > kept[-1][3]:
                kept[-1] = c
        assert [tuple(s) for s in x["spans"]] == sorted([(b["k"], b["s"], b["e"]) for b in x["base"]] + [(c[2], c[0], c[1]) for c in kept])
    text = F.col("text")
    for x in pii.with_spans(df).withColumn("clean", pii.redacted(text, F.col("spans"))).collect():
        out, at, held = [], 0, None
        for s, e, k in sorted((s["s"], s["e"], s["k"]) for s in x["spans"]):
            if held is not None and s < held:
                held = max(held, e)
            else:
                out += [x["text"][at if held is None else held : s], f"[{pii.KINDS[k].upper()}]"]
                held = e
            at = held
        assert x["clean"] == "".join(out) + x["text"][at:]


def test_many_matches_take_time_in_proportion(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(f"user{i}@mail.example.com 10.0.0.{i % 256}" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert pii.with_spans(df).select(F.size("spans")).first()[0] == 2 * n
        return time.time() - began

    seconds(500)
    small = seconds(2000)
    assert seconds(20_000) < 20 * small + 20


def test_thresholds_are_chosen_on_another_style(spark):
    assert all(t > 0 and t != 0.5 for t in pii_model.THRESHOLDS)
    texts = pii_training.examples(600, 41, pii_training.CHOOSE)
    got = spans(spark, [t for t, _, _ in texts])
    found = [any(s for s in got[i].split(",") if s and int(s.split(":")[1]) < t.index(v) + len(v) and t.index(v) < int(s.split(":")[2])) for i, (t, v, _) in enumerate(texts)]
    personal = [f for f, (_, _, y) in zip(found, texts) if y]
    assert sum(personal) >= 0.97 * len(personal)
