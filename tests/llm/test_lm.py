"""LM scores: the base against plain counting, the lattice against plain sums over all segmentations, EM against enumeration."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lagwise.llm import lm_score

DATA, PIECES = "/root/testdata/sf0.01", public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word: str, lattice: lm_score.Lattice):
    """Every way to spell a word: its pieces as (begin, text, known), and its probability."""

    def go(begin: int):
        if begin == len(word):
            yield [], lattice.stop
        for end in range(begin + 1, len(word) + 1):
            text, place = word[begin:end], int(begin > 0)
            p = (lattice.inner if begin else lattice.first).get(text)
            other = lattice.unknown[place] - math.log(1_114_112) if end == begin + 1 else -math.inf
            known = p is not None and p >= other
            value = max(-math.inf if p is None else p, other)
            if value > -math.inf:
                for rest, q in go(end):
                    yield [(begin, text, known), *rest], math.exp(value) * q * (1 - lattice.stop if begin else 1)

    return list(go(0))


TOY = lm_score.Lattice({"a": math.log(0.6), "ab": math.log(0.4)}, {"a": math.log(0.3), "b": math.log(0.5), "ba": math.log(0.2)}, 0.5, whole=0.3)


@pytest.mark.parametrize("long", [256, 0])
def test_the_recursion_sums_all_segmentations(monkeypatch, long):
    monkeypatch.setattr(lm_score, "LONG", long)
    words = ["a", "ab", "aba", "abab", "bab", "xab", "aé名"]
    want = [sum(p for _, p in segmentations(w, TOY)) for w in words]
    assert np.exp(TOY.log_probability(words)) == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("long", [256, 0])
def test_expectations_equal_enumeration(monkeypatch, long):
    monkeypatch.setattr(lm_score, "LONG", long)
    words, count, total = ["aba", "ab", "bxa", "abab"], np.array([4.0, 1.0, 2.0, 3.0]), 10.0
    names = TOY._arrays()[3]
    want = np.zeros(2 * len(names) + 5)
    for w, c in zip(words, count):
        ways = segmentations(w, TOY)
        spelled = sum(p for _, p in ways)
        edge = TOY.whole * (c - 1) / (total - 1)
        left = c * (1 - edge / (edge + (1 - TOY.whole) * spelled))
        want[-4] += left
        want[-1] += c - left
        for pieces, p in ways:
            share = left * p / spelled
            want[-5] += share * len(pieces)
            for begin, text, known in pieces:
                want[names.index(text) + len(names) * (begin > 0) if known else -3 + (begin > 0)] += share
    assert TOY.expectations(words, count, total) == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_the_lattice_holds_the_longest_pieces():
    pieces = lm_score.vocabulary(PIECES)
    lattice = lm_score.Lattice.of(pieces)
    usable = {p.lstrip("▁") for p, _ in pieces if re.fullmatch("▁?[a-z]+", p)}
    assert usable <= set(lattice.first) | set(lattice.inner) and lattice.longest == 16 and max(map(len, usable)) == 15
    for word, got in zip(words := ["internationally", "misunderstandings", "telecommunications"], lattice.log_probability(words)):
        alpha = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for begin in range(end):
                p = (lattice.inner if begin else lattice.first).get(word[begin:end])
                unknown = np.exp(lattice.unknown[begin > 0]) / 1_114_112 if end == begin + 1 else 0.0
                alpha[end] += alpha[begin] * max(0.0 if p is None else np.exp(p), unknown) * (1 - lattice.stop if begin else 1)
        assert np.exp(got) == pytest.approx(alpha[-1] * lattice.stop, rel=1e-6)


def test_long_words_take_time_in_proportion():
    lattice, took = lm_score.Lattice.of(lm_score.vocabulary(PIECES)), []
    for n in (30_000, 120_000):
        began = time.time()
        assert np.isfinite(lattice.log_probability(["unbelievable名" * (n // 13)])[0])
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 1


def test_words_are_gathered_in_bounded_memory():
    import pyarrow as pa

    words = ["a" * 300_000] * 40 + ["b"] * 1000
    batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array(range(len(words)))], ["word", "c"])
    got = list(lm_score.gathered(iter([batch, batch.slice(0, 0), batch]), rows=1500, most=1_000_000))
    assert [w for b in got for w in b.column("word").to_pylist()] == words * 2
    assert max(sum(map(len, b.column("word").to_pylist())) for b in got) <= 2_600_000 and max(b.num_rows for b in got) <= 2500


def test_a_row_of_very_many_repeats(spark):
    docs = spark.range(12_345).selectExpr("7L doc_id", "'the same words again' text").unionByName(spark.createDataFrame([(8, "other words")], "doc_id long, text string"))
    got = lm_score.scored(docs, PIECES).groupBy("doc_id", "n_tokens", "score").count().collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["count"]) for r in got) == [(7, 5, 12_345), (8, 3, 1)]


def test_scores_of_odd_rows(odd, nothing):
    got = lm_score.scored(odd, PIECES).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == 1 and all(r["score"] < 0 and np.isfinite(r["score"]) for r in got)
    for r in odd.collect():
        assert by[r["doc_id"]]["n_tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) + 1
    assert lm_score.scored(nothing, PIECES).count() == 0
    unlearned = odd.where("doc_id is not null").withColumn("doc_id", odd["doc_id"] * 0 + next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1))
    assert all(np.isfinite(r["score"]) and r["train_tokens"] == 0 and r["n_known"] == 0 for r in lm_score.scored(unlearned, PIECES).collect())


def test_base_scores_of_a_whole_table_and_the_model_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    texts = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(lower)) for r in docs.collect()}
    counts, ends = {}, 0
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            ends += 1
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    of = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    # a proper model of words: new ones have the share of words seen once, and are spelled by letters as often as those of training words
    letters = Counter(c for x in counts for c in x)
    all_, new = sum(letters.values()) + len(letters) + 1, sum(c == 1 for c in counts.values()) / (n - ends)
    stop = len(counts) / (all_ + len(counts))
    spelled = lambda x: sum(math.log10((1 - stop) * (letters[c] + 1) / all_ / (1 if c in letters else 1_114_112)) for c in x) + math.log10(stop)
    plain = lambda x: math.log10((1 - ends / n) * ((1 - new) * counts.get(x, 0) / (n - ends) + new * 10 ** spelled(x)))
    tokens = held = base = proper = 0
    for r in lm_score.scored(docs, PIECES).collect():
        w = texts[r["doc_id"]]
        assert r["train_tokens"] == n and r["n_tokens"] == len(w) + 1 and r["n_known"] == sum(x in counts for x in w) + 1
        assert r["base_score"] == pytest.approx(sum(of(counts.get(x, 0)) for x in w) + of(ends), rel=1e-9)
        if r["held_out"]:
            tokens, held, base = tokens + r["n_tokens"], held + r["score"], base + r["base_score"]
            proper += sum(map(plain, w)) + math.log10(ends / n)
    print("held out, a token: model", held / tokens, "base", base / tokens, "words and letters", proper / tokens)
    assert held / tokens > proper / tokens + 0.5


def test_the_files_scores_count(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    pieces = lm_score.vocabulary(PIECES)
    per_token = []
    for scores in ([s for _, s in pieces], [s for _, s in reversed(pieces)]):
        monkeypatch.setattr(lm_score, "vocabulary", lambda file, scores=scores: [(p, s) for (p, _), s in zip(pieces, scores)])
        r = lm_score.scored(docs, PIECES).where("held_out").selectExpr("sum(score) / sum(n_tokens) v").first()
        per_token.append(r["v"])
    assert per_token[0] > per_token[1] + 0.03
