"""Added tokens of the JSON vocabulary, as the tokenizers library finds them by default."""

from tokenizers import Tokenizer

from querylark.llm import bpe, entry, token_counts

MANY = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "it'<|endoftext|>s", "a  <|endoftext|>", "<|endoftext", "", "no more"]


def test_ids_of_texts_with_added_tokens(spark):
    library = [e.ids for e in Tokenizer.from_file(entry.PLAIN).encode_batch(MANY, add_special_tokens=False)]
    v = bpe.vocabulary(entry.PLAIN)
    got = v.encode_with_added(MANY)
    assert [x.tolist() for x in got] == library and library[0] == [64, 220, 50256, 275]
    assert all(v.decode(x, v.offsets(x)) == t.encode() for x, t in zip(got, MANY))
    docs = spark.createDataFrame(list(enumerate(MANY)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.encode(docs, entry.PLAIN).collect()} == {i: len(x) for i, x in enumerate(library)}
    counted = token_counts.length_histogram(docs, entry.PLAIN).collect()
    assert sum(r[0] * r[1] for r in counted) == sum(map(len, library))
