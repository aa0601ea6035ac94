"""Token counts against the tokenizers library on whole texts; chunks far smaller than in production, so that borders fall everywhere."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lagwise.llm import token_counts as tc

FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ("word ", "it's ", "we'll've ", "  ", "\n\n \t", "<|endoftext|>", "<|endof", "text|>", "1234 ", "...!? ", "déjà ", "名前", "\U0001f600\U0001f468‍\U0001f469", "'", "'l", "   <|endoftext|>  ", "́", " ", "\x85", "\x1c", "𝒳 ")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) * r.choice((1, 1, 1, 2, 40)) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_boundaries_of_a_beginning_are_the_whole_texts(tokenizer):
    edge = tc.margin(FILE)
    for text in texts(1, 150):
        at, n = tc.boundaries(text, tokenizer, True, edge)
        whole = dict(zip(at.tolist(), n.tolist()))
        assert whole[len(text)] == len(tokenizer.encode(text, add_special_tokens=False))
        for end in range(0, len(text), 7):
            for p, k in zip(*(x.tolist() for x in tc.boundaries(text[:end], tokenizer, False, edge))):
                assert whole.get(p) == k, (text, end, p)


def test_chunks_give_the_counts_of_whole_texts(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate([*texts(2, 120), "x" * 5000, " " * 3000, "名前" * 900, "a b " * 1500, "word " * 300 + "y" * 900 + " word" * 300, "<|endoftext|>" * 200, "'" * 700])]
    want = sorted((i, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False)), n > 100) for i, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk, overlap in ((64, 1), (40, 16), (300, 8)):
        got = tc.counted(df, FILE, chunk, overlap, 100)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"]: (len(r["text"].encode()), len(tokenizer.encode(r["text"], add_special_tokens=False))) for r in docs.collect()}
    got = tc.counted(docs, FILE, 2000).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want and len(got) == docs.count()


def test_odd_rows(spark, odd, nothing, tokenizer):
    got = tc.counted(odd, FILE)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(tokenizer.encode(r["text"] or "", add_special_tokens=False))) for r in odd.collect()]
    assert sorted(map(str, (tuple(r)[:3] for r in got.collect()))) == sorted(map(str, want))
    assert tc.counted(nothing, FILE).count() == 0


def test_other_tokenizers_are_refused(spark, odd):
    with pytest.raises(ValueError, match="byte-level"):
        tc.margin(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="overlap"):
        tc.counted(odd, FILE, 10, 11)
