"""Operators on tokens against the tokenizer libraries and exact round trips."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from querylark.llm import bpe, entry, packing, token_counts, token_files
from querylark.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def reference():
    with open(entry.MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(entry.PLAIN)
    t.encode_special_tokens = True
    return t


def odd_texts():
    r = random.Random(3)
    letters = "a b's'tre'll 've 'm 'd \n\t1٣é漢😀!?'d　x\r\n''-—Ⅷ²\x1c\x85"
    return ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)] + ["", "   ", "a" * 20_000, "#" * 3000 + " x", "'", "'s", "''s", " 's", "x's't", "\n\n a", "a \n", "<|endoftext|>"]


def test_encoding_is_that_of_the_libraries(texts, reference, plain):
    many = [*odd_texts(), *texts.values()]
    v = bpe.vocabulary(entry.MULTI)
    got = v.encode(many)
    assert all(g.tolist() == reference.encode_ordinary(t) for g, t in zip(got, many))
    assert all(v.decode(g, v.offsets(g)) == t.encode() for g, t in zip(got, many))
    assert all(g.tolist() == e.ids for g, e in zip(bpe.vocabulary(entry.PLAIN).encode(many), plain.encode_batch(many, add_special_tokens=False)))


def test_texts_that_meet_do_not_mix():
    v = bpe.vocabulary(entry.MULTI)
    pieces = ["it'", "s", "", " ", "a", "  ", "b"]
    assert [x.tolist() for x in v.encode(pieces)] == [v.encode([p])[0].tolist() for p in pieces]


def test_a_full_cache_changes_nothing(monkeypatch, texts):
    v = bpe.Vocabulary(entry.MULTI)
    monkeypatch.setattr(v, "GENERATION", 50)
    some = list(texts.values())[:40]
    first = [x.tolist() for t in some for x in v.encode([t])]
    assert first == [x.tolist() for x in bpe.vocabulary(entry.MULTI).encode(some)] and len(v.young) + len(v.old) < 20_000


def test_op1(spark, texts, reference):
    rows = {r["doc_id"]: r for r in entry.op1_bpe(spark, SF).collect()}
    assert len(rows) == len(texts)
    for d, t in texts.items():
        ids = np.array(reference.encode_ordinary(t), "<u4")
        assert (rows[d]["n_tokens"], rows[d]["ids_sha256"], rows[d]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_short_pieces_come_from_the_slots(monkeypatch, texts, plain):
    """Pieces of up to 15 bytes that were met go past the dictionary; with few slots they displace each other and the ids stay right."""
    odd = ["a", "a\0", "a\0\0", "\0", "abcdefgh", "abcdefgh\0", "abcdefghijklmno", "abcdefghijklmnop", "abcdefghijklmno\0", "漢字漢字漢", "漢字漢字漢字", "x" * 2_000_000 + " y"]
    many = [*odd, *odd_texts(), *texts.values()]
    want = [e.ids for e in plain.encode_batch(many, add_special_tokens=False)]
    v = bpe.Vocabulary(entry.PLAIN)
    v.encode(["a word and another", "word a"])
    monkeypatch.setattr(v, "encode_pieces", lambda pieces: [] if not pieces else pytest.fail(f"asked again: {pieces}"))
    assert v.encode(["a word and another", "word a"])[0].tolist() == plain.encode("a word and another", add_special_tokens=False).ids
    for bits in (3, 18):
        monkeypatch.setattr(bpe, "SLOT_BITS", bits)
        v = bpe.Vocabulary(entry.PLAIN)
        for _ in range(2):
            assert [x.tolist() for x in v.encode(many)] == want
            assert all(v.encode([t])[0].tolist() == w for t, w in zip(many[:600], want))


@pytest.mark.parametrize("width", range(33))
def test_bits_of_every_width(width):
    x = np.random.default_rng(width).integers(0, 1 << width, (3, token_files.BLOCK), np.uint64).astype(np.uint32)
    x[0] = (1 << width) - 1
    raw = token_files._pack(x, width)
    bits = "".join(f"{i:0{width}b}" for i in x.ravel().tolist()) if width else ""
    assert raw.tobytes() == int(bits or "0", 2).to_bytes(len(bits) // 8, "big") and (token_files._unpack(raw, width) == x).all()


def test_encode_then_decode_with_offsets(spark):
    df = spark.createDataFrame([(1, "naïve text's"), (2, None), (None, "x"), (1, "naïve text's")], "doc_id long, text string")
    encoded = bpe.encode(df, entry.MULTI)
    assert sorted(bytes(r["decoded"]).decode() for r in bpe.decode(encoded, entry.MULTI).collect()) == ["", "naïve text's", "naïve text's", "x"]
    r = encoded.filter("doc_id = 1").first()
    assert np.frombuffer(r["offsets"], "<u4")[-1] == len("naïve text's".encode())


@pytest.mark.parametrize("ids", [[], [5], [7] * 1000, list(range(700)), [1, 2, 3, 60_000] * 200, [0, 2**31, 3] * 100, [50_000] * 255 + [1] + [9] * 3])
def test_blocks_come_back(ids):
    x = np.array(ids, np.uint32)
    lengths = np.array([len(x) // 3, len(x) - len(x) // 3])
    f = token_files.TokenFile(token_files.encode_file([4, None], lengths, x))
    assert f.ids().tolist() == ids and f.doc_ids == [4, None] and f.lengths.tolist() == lengths.tolist()
    for a, b in ((0, 10), (200, 300), (255, 257), (len(ids) - 1, len(ids) + 5)):
        assert f.ids(max(a, 0), b).tolist() == ids[max(a, 0) : b]


def test_outliers_are_exceptions_and_the_rest_is_narrow():
    x = np.array(([3] * 250 + [1 << 30] * 6) * 40, np.uint32)
    raw = token_files.encode_file([1], np.array([len(x)]), x)
    assert token_files.TokenFile(raw).ids().tolist() == x.tolist() and len(raw) < len(x)


def test_op10(spark, texts, plain):
    rows = {r["doc_id"]: r for r in entry.op10_token_files(spark, SF).collect()}
    at = 0
    for d in sorted(texts):
        ids = np.array([*plain.encode(texts[d], add_special_tokens=False).ids, 2], "<u4")
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert len(rows) == len(texts)


def test_token_files_of_odd_tables(spark, monkeypatch):
    df = spark.createDataFrame([(3, "c"), (None, "n"), (1, None), (3, "c"), (2, "b " * 3000)], "doc_id long, text string")
    got = token_files.write_and_read(df, entry.PLAIN).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3] and got[1]["n_tokens"] == 1
    assert token_files.write_and_read(df.filter("false"), entry.PLAIN).collect() == []
    folder = shared_dir(spark)
    manifest = token_files.write(df, folder, entry.PLAIN)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == 5


def check_packing(rows, capacity):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence, by_doc


def test_op8(spark, texts, plain):
    rows = entry.op8_packing(spark, SF).collect()
    by_sequence, by_doc = check_packing(rows, 1024)
    crc = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in rows}
    total = 0
    for d, t in texts.items():
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        at = 0
        for piece, start, length in sorted(by_doc[d]):
            assert start == at and length <= 1024 and (piece == 0 or length == 1024) and crc[d, piece] == zlib.crc32(ids[start : start + length])
            at += length
        assert at == len(ids)
    assert len(by_sequence) <= 1.01 * -(-total // 1024) + 1


def test_packing_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c"), (None, None), (1, "a b c"), (2, ""), (3, "x " * 5000)], "doc_id long, text string")
    check_packing(packing.pack(df, entry.PLAIN, 64).collect(), 64)
    assert packing.pack(df.filter("false"), entry.PLAIN).collect() == []


def test_genetic_algorithm_beats_or_equals_best_fit():
    counts = Counter({341: 40, 342: 40, 340: 45, 512: 10, 700: 30, 320: 25, 4: 30, 100: 17, 411: 22})
    p = packing.Packer(counts, 1024, 1)
    start = p.best_fit_decreasing()
    best = p.evolve([], 30, 8)
    assert p.cost(best) <= p.cost(start) and not any(p.rest(best).values()) and all(sum(b) <= 1024 for b in best)
    for child in (p.crossover(start, p.shuffled()), p.mutate(start), p.shuffled()):
        assert not any(p.rest(child).values()) and all(sum(b) <= 1024 for b in child)


def test_islands_exchange_elites(spark):
    counts = {600: 7, 500: 9, 424: 6, 350: 8, 174: 5}
    p = packing.Packer(counts, 1024, 7)
    best = packing.solve(spark, counts, 1024, islands=3, epochs=2, generations=4)
    assert p.cost(best) <= p.cost(p.best_fit_decreasing()) and not any(p.rest(best).values())
    assert packing.solve(spark, {}, 1024) == Counter()


def test_op9_and_its_functions(spark, texts, plain):
    n = [len(e.ids) for e in plain.encode_batch(list(texts.values()), add_special_tokens=False)]
    rows = {r["context_limit"]: r for r in entry.op9_token_counts(spark, SF).collect()}
    assert set(rows) == set(n)
    for limit, r in rows.items():
        assert (r["n_docs"], r["docs_within"], r["docs_cut"]) == (n.count(limit), sum(x <= limit for x in n), sum(x > limit for x in n))
        assert (r["total_tokens"], r["tokens_within"], r["tokens_kept"]) == (sum(n), sum(x for x in n if x <= limit), sum(min(x, limit) for x in n))
    h = token_counts.length_histogram(spark.read.parquet(f"{SF}/documents.parquet"), entry.PLAIN).cache()
    assert token_counts.truncated_total(h, 100).first()[0] == sum(min(x, 100) for x in n)
    assert token_counts.length_quantile(h, 0.5).first()[0] == sorted(n)[-(-len(n) // 2) - 1]
    none = h.filter("false")
    assert token_counts.limits(none).collect() == [] and token_counts.truncated_total(none, 5).first()[0] == 0 and token_counts.length_quantile(none, 0.5).first()[0] is None
