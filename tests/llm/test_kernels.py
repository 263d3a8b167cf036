"""Texts made to defeat hashes, and long ones: windows change nothing."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import public_tokenizers
from querylark.llm import bpe, common, entry, language, near_duplicates, points, quality, winnowing
from test_texts import brute_components, brute_quality


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


@pytest.mark.parametrize("n", [1024, 2048, 4096, 65536])
def test_pieces_that_sums_of_powers_take_for_equal(n):
    import base64

    one = thue_morse(n)
    text = one + "1" + one.translate(str.maketrans("ab", "ba")) + " " + one
    with open(entry.MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for path, want in ((entry.MULTI, library.encode_ordinary(text)), (entry.PLAIN, Tokenizer.from_file(entry.PLAIN).encode(text, add_special_tokens=False).ids)):
        v = bpe.vocabulary(path)
        ids = v.encode([text])[0]
        assert ids.tolist() == want and v.decode(ids, v.offsets(ids)) == text.encode()


def test_such_words_are_different():
    one = thue_morse(4096)
    two = one.translate(str.maketrans("ab", "ba"))
    words = [one[:n] for n in (8, 16, 64, 65, 1024, 4096)] + [two[:n] for n in (8, 16, 64, 65, 1024, 4096)]
    h, cut = common.word_hashes(pa.RecordBatch.from_pydict({"text": [" ".join(words), one[:64].upper() + " " + one[:65].upper()]}))
    assert len(set(h[: cut[1]].tolist())) == len(words) and set(h[cut[1] :].tolist()) <= set(h[: cut[1]].tolist())
    assert quality.repeated_words(common.word_hashes(pa.RecordBatch.from_pydict({"text": [f"a b c d {one} x a b c d {two}"]}), fold=False)[0]) == 0


def test_such_documents_are_not_linked(spark):
    one = thue_morse(2048)
    texts = {1: f"a b c {one}", 2: "a b c " + one.translate(str.maketrans("ab", "ba")), 3: f"A b c {one}"}
    got = near_duplicates.deduplicate(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, 4, 80)


def test_ids_with_several_texts(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven", "red green blue cyan pink gold grey")
    rows = [(5, a), (5, b), (2, a), (7, b), (9, c), (9, ""), (None, a), (8, None), (11, c)]
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_duplicates.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == {(5, 3): (2, False), (2, 3): (2, True), (7, 3): (2, False), (9, 3): (9, True), (9, 0): (9, True), (None, 3): (None, True), (8, 0): (8, True), (11, 3): (9, False)}


def test_sketches_keep_what_is_alike_and_drop_templates():
    r = np.random.default_rng(3)
    kept = dropped = 0
    for size in (5, 60, 400, 3000):
        for _ in range(200):
            base = r.integers(0, 1 << 63, 2 * size, dtype=np.uint64) << np.uint64(1)
            for share, like in ((0.8, True), (0.65, False)):
                common_ = int(np.ceil(share * 2 * size / (1 + share)))
                x, y = np.sort(base[:size]), np.sort(np.concatenate((base[:common_], base[size : 2 * size - common_])))
                both = len(np.intersect1d(x, y))
                real = both / (2 * size - both)
                got = near_duplicates.likely(near_duplicates.sketch(x), size, near_duplicates.sketch(y)[None], np.array([size]), 80)[0]
                assert got or real < 0.8
                if not like and size >= 400:
                    kept, dropped = kept + got, dropped + (not got)
    assert dropped > 0.9 * (kept + dropped)


def mixed(n):
    r = random.Random(4)
    return "".join(r.choice(["the ", "x's ", "Straße, ", "漢字。", "\n", "  ", "12.5 ", "zu", "𝔘𝔫 "]) for _ in range(n))


def test_parts_of_long_texts_change_nothing(monkeypatch):
    text = mixed(4000)
    batch = pa.RecordBatch.from_pydict({"text": [text, "", "a"], "lang": ["en"] * 3})
    v = bpe.vocabulary(entry.MULTI)
    model = language.fit([("en", *pair, False) for pair in [language.counted("the x")]] + [("de", *pair, False) for pair in [language.counted("Straße zu")]])

    def every():
        return v.encode([text])[0].tolist(), [x.tolist() for x in winnowing.select(text)], language.columns([text, "a"], model), [x.tolist() for x in language.counted(text)], quality.marks(text), points.costs([text], None), [np.concatenate(x).tolist() for x in zip(*points.parts_of(text))]

    whole = every()
    for module in (bpe, winnowing, quality, points):
        monkeypatch.setattr(module, "PART", 257)
    monkeypatch.setattr(language, "CHUNK", 257)
    parts = every()
    assert whole[:2] == parts[:2] and whole[3:5] == parts[3:5] and whole[6] == parts[6]
    assert whole[2][0] == parts[2][0] and np.allclose(whole[2][1], parts[2][1], atol=1e-6) and np.allclose(whole[5], parts[5])
    got = quality.features(batch, None)
    assert (got["n_words"][0], got["word_chars"][0], got["n_symbols"][0], got["n_dup_lines"][0], got["n_repeat_words"][0]) == brute_quality(text)
    assert len(re.findall("[^\x20\x09-\x0d]+", text)) == got["n_words"][0]


def test_memory_does_not_follow_a_long_text():
    text = "some words of a very long text, 12 " * 600_000  # 21 MB
    model = language.fit([("en", *language.counted("the x"), False)])
    for name, run, most in (("bpe", lambda: bpe.vocabulary(entry.MULTI).encode([text]), 12), ("winnowing", lambda: winnowing.select(text), 8), ("language", lambda: language.columns([text], model), 8), ("quality", lambda: points.costs([text], None), 12)):
        run() if name == "bpe" else None
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * len(text), (name, peak / len(text))
