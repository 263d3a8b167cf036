"""Fingerprints, quality, personal data, near-duplicates, language and URL filters against brute force."""

import glob
import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from querylark.llm import common, entry, language, near_duplicates, pii, pii_training, quality, url_filter, winnowing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def long_text(n=200_000):
    return "word " * n


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those that operators make."""
    rows = [(1, "a plain text of some more words than ten here to be read", "en"), (2, None, None), (None, "no id", "en"), (3, "", "fr"), (1, "a plain text of some more words than ten here to be read", "en"), (4, long_text(), "en"), (5, " \n\t ", "en"), (6, "€ 漢 ñ 12.5 !", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("n_chars", "source", "key", "bucket", "component", "component_id", "kept", "label", "start", "length", "size", "signature", "n_words", "score", "rejected", "spans", "k", "n", "a", "b"):
        df = df.withColumn(c, F.lit(None).cast("long") if c == "n_chars" else F.lit("clash"))
    return df


OPERATORS = {
    "winnowing": winnowing.compare_with_next, "fingerprints": winnowing.fingerprints, "quality": quality.judge, "pii": lambda d: pii.summary(pii.find(d)), "near_duplicates": near_duplicates.deduplicate,
    "language": lambda d: language.predict(d, language.train(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, name):
    got = OPERATORS[name](odd).collect()
    assert len(got) == odd.count() and sum(r["doc_id"] is None for r in got) == 1
    same = [r for r in got if r["doc_id"] == 1]
    if name != "winnowing":
        assert same[0] == same[1]
    assert OPERATORS[name](odd.filter("false")).collect() == []


# ---- shared hashing


def test_word_hashes_know_words_rows_and_case():
    texts = ["The the\tTHE\x0bof", "", "of", "é É", None, "x" * 5000 + " x"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    h, cut = common.word_hashes(batch)
    rows = [h[a:b].tolist() for a, b in zip(cut, cut[1:])]
    assert [len(r) for r in rows] == [4, 0, 1, 2, 0, 2] and len(set(rows[0][:3])) == 1 and rows[0][3] == rows[2][0] and rows[3][0] != rows[3][1]
    assert common.word_hashes(batch.slice(2, 1))[0].tolist() == rows[2]
    assert len(set(common.word_hashes(batch, fold=False)[0][:3].tolist())) == 3


# ---- 2


def brute_winnow(text, k, w):
    """By definition, over the same gram hashes (w = 1 selects them all)."""
    h, _ = winnowing.select(text, k, 1)
    out = []
    for i in range(max(1, len(h) - w + 1) if len(h) else 0):
        own = h[i : i + w]
        j = i + len(own) - 1 - int(np.argmin(own[::-1]))
        if not out or out[-1][1] != j:
            out.append((int(h[j]), j))
    return out


def test_winnowing_by_definition(docs):
    r = random.Random(2)
    for t in ["", "a", "ab" * 40, "a" * 100, *("".join(r.choice("ab") for _ in range(80)) for _ in range(50)), *(d["text"] for d in docs[:20])]:
        for k, w in ((3, 4), (5, 1), (winnowing.K, winnowing.WINDOW)):
            h, p = winnowing.select(t, k, w)
            assert list(zip(h.tolist(), p.tolist())) == brute_winnow(t, k, w)


def test_a_shared_passage_is_always_found():
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    for _ in range(200):
        shared = word(winnowing.K + winnowing.WINDOW - 1)
        a, b = (set(winnowing.select(word(r.randrange(90)) + shared + word(r.randrange(90)))[0].tolist()) for _ in range(2))
        assert a & b


def test_op2(spark, docs):
    rows = {r["doc_id"]: r for r in entry.op2_winnowing(spark, SF).collect()}
    order = sorted(docs, key=lambda d: -d["doc_id"])
    assert len(rows) == len(order)
    for d, following in zip(order, [*order[1:], order[0]]):
        half = len(d["text"]) // 2
        changed = d["text"][: len(d["text"]) - half] + following["text"][:half]
        r = rows[d["doc_id"]]
        assert r["n_chars"] == len(d["text"]) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == winnowing.as_string(winnowing.select(d["text"])) and r["edited_fingerprint"] == winnowing.as_string(winnowing.select(changed))
        own, near, other = (set(winnowing.select(t)[0].tolist()) for t in (d["text"], changed, following["text"]))
        for name, x in (("near_edited", near), ("near_next", other)):
            assert r[name] == pytest.approx(len(own & x) / len(own | x) if own | x else 1.0)


# ---- 3


def brute_quality(t):
    words = re.findall("[^\x20\x09-\x0d]+", t)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_op3_counts(spark, docs):
    rows = {r["doc_id"]: r for r in entry.op3_quality(spark, SF).collect()}
    for d in docs:
        r, b = rows[d["doc_id"]], brute_quality(d["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b
        assert r["base_failed"] == (b[0] < 10 or 100 * b[4] > 20 * b[0]) and not (r["base_failed"] and r["kept"])


def test_repeats_by_hand():
    for t in ("a b c d e a b c d e", "a " * 9, "a b c d", "x\nx\n\n\nx y\n x", "  a b"):
        batch = pa.RecordBatch.from_pydict({"text": [t], "lang": ["en"]})
        f = quality.features(batch, None)
        assert (f["n_words"][0], f["word_chars"][0], f["n_symbols"][0], f["n_dup_lines"][0], f["n_repeat_words"][0]) == brute_quality(t)


def test_kneser_ney_is_a_distribution_and_matches_the_plain_formula():
    r = np.random.default_rng(4)
    text = "".join(r.choice(list("abcd "), 3000))
    code, n = np.unique(quality.codes([text])[0], return_counts=True)
    model = quality.kneser_ney(code, n)
    contexts = np.unique(code >> quality.BITS)[:40]
    for c in [*contexts.tolist(), (63 << 12) | (62 << 6) | 61]:
        every = ((np.uint32(c) << np.uint32(quality.BITS)) | np.arange(64, dtype=np.uint32)).astype(np.uint32)
        assert np.exp(quality.log_probability(model, every)).sum() == pytest.approx(1, abs=1e-4)


def test_bands_reject_both_sides(spark):
    r = random.Random(1)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(120)), "en") for i in range(150)]
    rows += [(900, " ".join("".join(r.choice("qxzjkvw#@") for _ in range(6)) for _ in range(120)), "en"), (901, "e e t e e o e t a e " * 1 + " ".join("ee" * (i % 7 + 1) for i in range(150)), "en"), (902, "zu kurz", "de")]
    got = {x["doc_id"]: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(150))
    assert not got[900]["kept"] and got[900]["perplexity"] > got[900]["high"] and not got[902]["kept"]
    assert got[901]["base_failed"] or got[901]["perplexity"] < got[901]["low"]


# ---- 4


def check_digit(d):
    x = [int(c) for c in d][::-1]
    return sum(x[0::2] + [sum(divmod(2 * y, 10)) for y in x[1::2]]) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[ -]", "", m)) <= 19 and check_digit(re.sub("[ -]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def brute_spans(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, t) if ok(m[0])]


def odd_personal():
    r = random.Random(6)
    bits = ["a@b.c", "_d@e.f", "x.y+z%q@", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "5", "--", " ", "+1 (407) 555-7710", "+49", "++1 23", "😀", "é", ".", "-", "0" * 30, "12 34", "\n", "token = \"" + "0a1b" * 10 + "\"", "a.b-c"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(1, 12))) for _ in range(1500)]


def test_base_spans_by_plain_patterns(spark, docs):
    texts = [d["text"] for d in docs] + odd_personal() + ["1" * 50_000, "a" * 50_000 + "@", "a." * 20_000, "+" + "1 " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.summary(pii.find(df)).collect():
        want = brute_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r["doc_id"]][:200]
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if s.split(":")[0] in pii.BASE] == want
        for k in pii.BASE:
            assert r[f"n_{k}"] == sum(s.startswith(k + ":") for s in want)


def test_added_spans_find_secrets_and_leave_numbers(spark):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'the token = "{secret}" was', f"commit {secret} fixed", "order 2504982509303916 shipped", "call tel 555-123-4567 now", "write to jane.doe [at] mail [dot] com", "ssn 123-45-6789", "in 2024-05-06 of"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.summary(pii.find(df)).collect()}
    assert got[0] == f"secret:{texts[0].index(secret)}:{texts[0].index(secret) + 40}" and got[1] == got[2] == got[6] == ""
    assert got[3].startswith("number:") and got[4].startswith("email_written:") and got[5].startswith("number:")


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é mail a@b.co or +1 (407) 555-7710!"), (2, "nothing"), (3, None), (4, "a@b.co")], "doc_id long, text string")
    out = corpus_pipeline.redact(spark, df.withColumn("n_chars", F.lit(0).cast("long")), SF).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["é mail [EMAIL] or [PHONE]!", "nothing", None, "[EMAIL]"] and out[0]["n_chars"] == len(out[0]["text"])


def test_the_shipped_trees_are_those_that_training_gives(spark):
    from querylark.llm import pii_model

    assert pii_training.train(spark) == {"PRIOR": pii_model.PRIOR, "TREES": pii_model.TREES, "CALIBRATION": pii_model.CALIBRATION, "THRESHOLDS": pii_model.THRESHOLDS}


def test_personal_data_runs_no_python(spark):
    plan = entry.op4_pii(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- 5


def test_op5_matches_its_sql(spark):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = sorted(c.sql(url_filter.SQL).fetchall())
    got = sorted(tuple(r) for r in entry.op5_url_filter(spark, SF).select("page_id", "host", "fetched", "blocked", "lists").collect())
    assert got == want and any(r[3] for r in got)


def test_intervals_and_judgement(spark):
    entries = spark.createDataFrame(
        [("bad", "evil.com", "2024-01-10", "add"), ("bad", "evil.com", "2024-02-10", "remove"), ("bad", "EVIL.com", "2024-05-01", "add"), ("x", "evil.com", "2024-01-15", "add"), ("bad", "same.org", "2024-03-01", "add"), ("bad", "same.org", "2024-03-01", "remove"), ("bad", None, "2024-01-01", "add")],
        "list string, pattern string, effective string, action string",
    )
    captures = spark.createDataFrame(
        [(1, "http://evil.com/a", "2024-01-09"), (2, "http://u:p@www.EVIL.com:8080/a", "2024-01-20"), (3, "https://evil.com", "2024-02-10"), (4, "https://evil.com/", "2024-12-31"), (5, "http://notevil.com", "2024-01-20"), (6, None, "2024-01-20"), (7, "/relative", "2024-01-20"), (8, "http://evil.com", None), (9, "http://same.org.", "2024-03-01")],
        "page_id long, url string, fetched string",
    )
    got = {r["page_id"]: r["lists"] for r in url_filter.judge(captures, entries).collect()}
    assert got == {1: "", 2: "bad,x", 3: "x", 4: "bad,x", 5: "", 6: "", 7: "", 8: "", 9: ""}
    assert url_filter.judge(captures.filter("false"), entries).collect() == [] and all(not r["blocked"] for r in url_filter.judge(captures, entries.filter("false")).collect())


def test_judgement_without_a_broadcast(spark, monkeypatch):
    want = sorted(map(tuple, entry.op5_url_filter(spark, SF).collect()), key=str)
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, entry.op5_url_filter(spark, SF).collect()), key=str) == want


# ---- 6


def brute_components(texts, k, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(texts)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


def test_op6(spark, docs):
    want = brute_components({d["doc_id"]: d["text"] for d in docs}, 4, 80)
    got = {r["doc_id"]: r for r in entry.op6_near_duplicates(spark, SF).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def family(r, n, words, changes):
    """Chains of edited copies: neighbours are alike, ends are not."""
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        base = list(base)
        for _ in range(changes):
            base[r.randrange(words)] = f"w{r.randrange(10**6)}"
        yield " ".join(base)


def test_chains_groups_and_blocks(spark, monkeypatch):
    r = random.Random(9)
    texts = [t for n, words, changes in ((12, 120, 1), (12, 120, 3), (25, 90, 2), (6, 60, 4), (8, 3, 0)) for t in family(r, n, words, changes)]
    texts += ["A b C d", "a B c D", "", None, "one", "ONE", "one one"]
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for k in (4, 5):
        want = brute_components(dict(enumerate(texts)), k, 80)
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates.deduplicate(df, k).collect()} == want
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)  # every group is split into pairs of blocks
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates.deduplicate(df, 5).collect()} == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates.deduplicate(df, 5).collect()} == want


def test_pigeonhole():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = r.integers(0, 1 << 16, near_duplicates.HASHES).astype(np.uint16)
        b = a.copy()
        at = r.choice(near_duplicates.HASHES, near_duplicates.DISTANCE, replace=False)
        b[at] ^= 1
        k = near_duplicates.keys(np.stack([a, b]))
        assert (k[0] == k[1]).any()


# ---- 7


def test_op7(spark, docs):
    rows = {r["doc_id"]: r for r in entry.op7_language(spark, SF).collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for d, r in rows.items())
    held = [d for d in docs if rows[d["doc_id"]]["held_out"]]
    assert sum(rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.97 * len(held)


def test_language_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "12 !"), (3, "Der und die ungen schaft"), (4, "")], "doc_id long, text string")
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 4)] == ["und"] * 3 and got[3]["lang_pred"] == "de" and got[1]["rejected"] and got[2]["score"] == 0
    nothing = language.fit([])
    assert [r["lang_pred"] for r in language.predict(df, nothing).collect()] == ["und"] * 4


# ---- pipeline


def test_pipeline_stage_by_stage(spark, docs):
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language", "quality", "near_duplicates", "pii", "packing"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    first = common.materialize(stage["language"](spark, table, SF))
    assert first.dtypes == table.dtypes and first.count() > 0.95 * len(docs)
    second = common.materialize(stage["quality"](spark, first, SF))
    kept = {r["doc_id"] for r in second.collect()}
    assert kept <= {r["doc_id"] for r in first.collect()} and not any(b[0] < 10 or 100 * b[4] > 20 * b[0] for b in (brute_quality(r["text"]) for r in second.collect()))
    third = common.materialize(stage["near_duplicates"](spark, second, SF))
    want = brute_components({r["doc_id"]: r["text"] for r in second.collect()}, 5, 80)
    assert {r["doc_id"] for r in third.collect()} == {d for d, (_, c) in want.items() if c == d}
    fourth = common.materialize(stage["pii"](spark, third, SF))
    assert fourth.dtypes == table.dtypes and not any(brute_spans(r["text"]) for r in fourth.collect())
    last = stage["packing"](spark, fourth, SF).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in fourth.collect()}


def test_whole_pipeline(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
