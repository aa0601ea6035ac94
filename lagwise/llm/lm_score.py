"""LM scoring: the marginal likelihood of each text over all ways to spell its words with an existing subword vocabulary.

Tokens: A-Z in lower case, words `[^\\x20\\x09-\\x0D]+`, then one end for each text. No piece runs over a blank, so a document's lattice falls apart at
its blanks: the log-space forward recursion runs over each distinct word once, and a document's marginal is the product of its words' and the end's.

A word's lattice has an edge for each run of letters that is a piece of the vocabulary file (pieces that begin a word and others have distributions
of their own) or a single code point, and one edge over the whole word, whose weight is the word's share of the training words. The file's scores
weight the pieces: a score that is the negative rank of a merge, as in the given file, by Zipf's law of the rank (for a file whose scores are log
probabilities, weigh=math.exp). Expectation-maximisation over all training words (forward and backward recursions over all segmentations, each
word with its count) re-estimates the pieces' weights, of which the file's weights stay the share PRIOR, however large the corpus is, how often a word ends
after a piece, and the share of words that take the edge of the whole word. For that, a word's own occurrence is left out of its count, so that words seen
once count as spelled ones and the share left for spelling is what new words need. All of this is one proper distribution over texts.

Counts of all words are shuffled as a table that grows with the corpus. The FREQUENT most frequent words are sent to the tasks with their values
(a bounded table); other words' occurrences are joined with it by word. Every row gives one row: rows of equal id and text share one calculation.
A null text is an empty one: its only token is the end. An empty table gives no rows. Columns other than doc_id and text are not read. Without
training tokens every word is spelled under the vocabulary's own scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import fold, slices, written

#: PRIOR: the file's share of a piece's weight; LONG: letters above which a word is taken by itself, all edges of a length at once.
FREQUENT, EM_ROUNDS, PRIOR, FLUSH, LONG = 120_000, 2, 0.2, 200_000, 256
#: Repeats of a row that are written out at a time; bytes of words that are put together.
REPEATS, GATHERED = 1000, 32 << 20
_LOWER = {i: i + 32 for i in range(65, 91)}
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_CODEPOINTS = 1_114_112


def words(text: str) -> list[bytes]:
    """The words' UTF-8; of bytes, lower() and split() know just A-Z and the six ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 150_000, most: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows or bytes, and batches of more bytes cut: the lattice works on words of equal length at once."""
    held: list[pa.RecordBatch] = []
    for whole in batches:
        place = np.asarray(pc.fill_null(pc.binary_length(whole.column("word")), 0)).astype(np.int64).cumsum() // most
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), whole.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            held.append(whole.slice(begin, end - begin))
            if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
    if held and sum(b.num_rows for b in held):
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@dataclass
class Lattice:
    """first, inner: natural log probabilities of pieces at a word's beginning and after it; stop: probability that a word ends after a piece;
    whole: that a word takes the edge of the whole word."""

    first: dict[str, float]
    inner: dict[str, float]
    stop: float = 0.4
    unknown: tuple[float, float] = (-14.0, -14.0)  # of a code point that is no piece
    whole: float = 0.0
    table: tuple = field(default=None, repr=False)
    longest: int = field(init=False)  # code points of the longest piece

    def __post_init__(self):
        self.longest = max(map(len, chain(self.first, self.inner)), default=1)

    def __getstate__(self):
        return {**self.__dict__, "table": None}

    @classmethod
    def of(cls, pieces: list[tuple[str, float]], weigh=lambda score: 1 / (10 - score)) -> "Lattice":
        """pieces: text with the word mark as the file has it, and score; weigh: of a score, a weight."""
        first, inner = {}, {}
        for piece, score in sorted(pieces, key=lambda x: -x[1]):
            to, text = (first, piece[1:]) if piece.startswith("▁") else (inner, piece)
            if text and "▁" not in text and not _BLANK.search(text) and text == text.translate(_LOWER):
                to.setdefault(text, weigh(score))
        for own, other in ((first, inner), (inner, first)):
            for text in [t for t in other if len(t) == 1]:
                own.setdefault(text, 1e-5)
        return cls(_logs(first), _logs(inner))

    def _arrays(self):
        """Sorted hashes of all pieces with their log probabilities in either place, their texts, and marks of the hashes' low bits."""
        if self.table is None:
            names = sorted(set(self.first) | set(self.inner))
            h = np.array([_hash_text(t) for t in names], np.uint64)
            order = np.argsort(h)
            first = np.array([self.first.get(names[i], -np.inf) for i in order])
            inner = np.array([self.inner.get(names[i], -np.inf) for i in order])
            marks = np.zeros(int(_MARKS) + 1, bool)
            marks[h & _MARKS] = True
            self.table = (h[order], first, inner, [names[i] for i in order], marks)
        return self.table

    def _edges(self, x: np.ndarray, begin: int, end: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words x (length x n code points) those that have an edge from begin to end, its log probability and table index (-1: an unknown code point)."""
        keys, first, inner, _, marks = self._arrays()
        h = _finish(prefix[end] - prefix[begin] * _power(end - begin), end - begin)
        rows = np.flatnonzero(marks[h & _MARKS])  # most runs of letters are no piece: only likely ones are searched for
        i = np.minimum(np.searchsorted(keys, h[rows]), len(keys) - 1)
        p = (inner if begin else first)[i]
        hit = (keys[i] == h[rows]) & (p > -np.inf)
        rows, i, p = rows[hit], i[hit], p[hit]
        if end > begin + 1:
            return rows, p, i
        n = x.shape[1]
        every, number = np.full(n, self.unknown[begin > 0] - np.log(_CODEPOINTS)), np.full(n, -1)
        better = p >= every[rows]
        every[rows[better]], number[rows[better]] = p[better], i[better]
        return np.arange(n), every, number

    def forward(self, x: np.ndarray, edges: list[tuple] | None = None) -> np.ndarray:
        """alpha (length+1 x n, natural logs; the stop's factor included between pieces) of words x (length x n code points). The edges (begin, end,
        words, log probability with going on after a piece, table index) are put into a list where one is given."""
        length, n = x.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _BASE + x[j].astype(np.uint64) + np.uint64(1)
        alpha = np.zeros((length + 1, n))
        go = np.log1p(-self.stop)
        for end in range(1, length + 1):
            # each word has an edge of one code point, which comes first
            for begin in range(end - 1, max(0, end - self.longest) - 1, -1):
                r, p, i = self._edges(x, begin, end, prefix)
                if not len(r):
                    continue
                p = p + go if begin else p
                if begin == end - 1:
                    alpha[end] = alpha[begin] + p
                else:
                    alpha[end, r] = np.logaddexp(alpha[end, r], alpha[begin, r] + p)
                if edges is not None:
                    edges.append((begin, end, r, p, i))
        return alpha

    def _all_edges(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """begin, end, log probability (with going on after a piece) and table index of all edges of one long word, by end."""
        prefix, h = [0], 0
        for c in x.tolist():
            h = (h * 0x100000001B3 + c + 1) & 0xFFFFFFFFFFFFFFFF
            prefix.append(h)
        keys, first, inner, _, marks = self._arrays()
        prefix, parts = np.array(prefix, np.uint64), []
        for n in range(1, min(self.longest, len(x)) + 1):
            h = _finish(prefix[n:] - prefix[:-n] * _power(n), n)
            begin = np.flatnonzero(marks[h & _MARKS])
            i = np.minimum(np.searchsorted(keys, h[begin]), len(keys) - 1)
            p = np.where(begin > 0, inner[i], first[i])
            hit = (keys[i] == h[begin]) & (p > -np.inf)
            begin, i, p = begin[hit], i[hit], p[hit]
            if n == 1:
                every = np.where(np.arange(len(x)) > 0, self.unknown[1], self.unknown[0]) - np.log(_CODEPOINTS)
                number, better = np.full(len(x), -1), p >= every[begin]
                every[begin[better]], number[begin[better]] = p[better], i[better]
                begin, i, p = np.arange(len(x)), number, every
            parts.append((begin, begin + n, p + np.where(begin > 0, np.log1p(-self.stop), 0.0), i))
        begin, end, p, i = map(np.concatenate, zip(*parts))
        order = np.argsort(end, kind="stable")
        return begin[order], end[order], p[order], i[order]

    def log_probability(self, texts: list[str]) -> np.ndarray:
        """Natural log of each word's marginal spelling probability."""
        out = np.zeros(len(texts))
        for at, x in _by_length(texts):
            if x.shape[1] > LONG:
                for k, one in zip(at, x):
                    out[k] = _recursion(*self._all_edges(one)[:3], len(one))[-1] + np.log(self.stop)
            else:
                out[at] = self.forward(np.ascontiguousarray(x.T))[-1] + np.log(self.stop)
        return out

    def expectations(self, texts: list[str], count: np.ndarray, total: float) -> np.ndarray:
        """Expected uses of each table entry at the beginning of a word, of each after it; then of pieces, spelled words, unknown code points in
        either place, and whole-word edges, for words with their counts among total words."""
        size = len(self._arrays()[0])
        uses, rest = np.zeros(2 * size), np.zeros(5)

        def spelled(at: np.ndarray, log: np.ndarray) -> np.ndarray:
            """How many of the words' occurrences are spelled, with each occurrence itself left out of its count."""
            whole = self.whole * (count[at] - 1) / max(1.0, total - 1)
            left = count[at] * (1 - whole / np.maximum(whole + (1 - self.whole) * np.exp(log + np.log(self.stop)), 1e-300))
            rest[1] += left.sum()
            rest[4] += (count[at] - left).sum()
            return left

        def add(begin: np.ndarray, number: np.ndarray, share: np.ndarray) -> None:
            share, inner = np.where(np.isfinite(share), share, 0), (begin > 0).astype(np.int64)
            got = np.bincount(np.where(number >= 0, number + size * inner, 2 * size + inner), share, 2 * size + 2)
            uses[:] += got[: 2 * size]
            rest[0] += got.sum()
            rest[2:4] += got[2 * size :]

        for at, x in _by_length(texts):
            n, length = x.shape
            if length > LONG:
                for k, one in zip(at, x):
                    begin, end, p, number = self._all_edges(one)
                    alpha = _recursion(begin, end, p, length)
                    back = np.argsort(-begin, kind="stable")
                    beta = _recursion((length - end)[back], (length - begin)[back], p[back], length)[::-1]
                    weight = spelled(np.array([k]), alpha[-1:])
                    add(begin, number, weight * np.exp(np.minimum(0, alpha[begin] + p + beta[end] - alpha[-1])))
                continue
            edges: list[tuple] = []
            alpha = self.forward(np.ascontiguousarray(x.T), edges)
            weight = spelled(at, alpha[-1])
            beta, reached, shares = np.zeros((length + 1, n)), {length}, []
            edges.sort(key=lambda e: (-e[0], e[1]))
            for begin, end, r, p, _ in edges:
                step = p + beta[end, r]
                if begin in reached:
                    beta[begin, r] = np.logaddexp(beta[begin, r], step)
                else:  # the edge of one code point, which each word has
                    beta[begin] = step
                    reached.add(begin)
                shares.append(weight[r] * np.exp(np.minimum(0, alpha[begin, r] + step - alpha[-1, r])))
            begins = np.repeat([e[0] for e in edges], [len(e[2]) for e in edges])
            add(begins, np.concatenate([e[4] for e in edges]), np.concatenate(shares))
        return np.concatenate([uses, rest])


def _recursion(begin: np.ndarray, end: np.ndarray, p: np.ndarray, length: int) -> np.ndarray:
    """The log-space forward recursion of one word over its edges in the order of their ends."""
    alpha = [0.0] + [-math.inf] * length
    for b, e, q in zip(begin.tolist(), end.tolist(), p.tolist()):
        q += alpha[b]
        a = alpha[e]
        alpha[e] = q + math.log1p(math.exp(a - q)) if q > a else a + math.log1p(math.exp(q - a)) if a > -math.inf else a
    return np.array(alpha)


_BASE = np.uint64(0x100000001B3)
_MARKS = np.uint64((1 << 20) - 1)


@cache
def _power(n: int) -> np.uint64:
    return np.uint64(pow(0x100000001B3, n, 2**64))


def _finish(h: np.ndarray, n: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) + np.uint64(n)


def _hash_text(text: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in text:
        h = h * _BASE + np.uint64(ord(c) + 1)
    return int(_finish(h, len(text))[0])


def _logs(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {t: float(np.log(w / total)) for t, w in weights.items()}


def _by_length(texts: list[str], cells: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and code points of texts of equal length, together at most about cells."""
    lengths = np.array([len(t) for t in texts])
    for length in np.unique(lengths):
        where = np.flatnonzero(lengths == length)
        step = max(1, cells // max(1, int(length)))
        for i in range(0, len(where), step):
            part = where[i : i + step]
            yield part, np.frombuffer("".join(texts[k] for k in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)


def vocabulary(file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (occurrences in training texts), n (in all texts). Each task adds up what it has, at most FLUSH words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()

        def out() -> list[pa.RecordBatch]:
            both = []
            for counts, learned in ((train, 1), (rest, 0)):
                n = np.fromiter(counts.values(), np.int64, len(counts))
                both.append(pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(n * learned), pa.array(n)], ["word", "c", "n"]))
                counts.clear()
            return both

        for part in slices(batches):
            for text, held in zip(part["text"], part["held_out"]):
                (rest if held else train).update(words(text))
            if len(train) + len(rest) > FLUSH:
                yield from out()
        yield from out()

    return docs.select("text", "held_out").mapInArrow(run, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def trained(lattice: Lattice, counts: DataFrame, total: int, rounds: int = EM_ROUNDS, prior: float = PRIOR) -> Lattice:
    """The lattice after rounds of EM over all of the total training words; each task adds up its expectations, the driver gets one sum for each piece."""
    if not total:
        return lattice
    given, lattice = lattice, replace(lattice, whole=0.5)
    for _ in range(rounds):
        names = lattice._arrays()[3]
        size = len(names)

        def run(batches: Iterator[pa.RecordBatch], lattice: Lattice = lattice, size: int = size) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(2 * size + 5)
            for part in gathered(batches):
                sums += lattice.expectations(part.column("word").to_pylist(), np.asarray(part.column("c")).astype(float), total)
            k = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(sums[k])], ["k", "v"])

        got = counts.where("c > 0").select("word", "c").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        sums = np.zeros(2 * size + 5)
        sums[got["k"].to_numpy(int)] = got["v"].to_numpy()
        used, spelled, u0, u1, whole = sums[-5:]
        # the file's weights are worth prior of all uses in either place; a little more keeps every spelling possible
        worth, inside = (prior / (1 - prior) * part.sum() for part in (sums[:size], sums[size : 2 * size]))
        first = {t: sums[i] + worth * math.exp(given.first.get(t, -math.inf)) + 1e-3 for i, t in enumerate(names) if t in given.first}
        inner = {t: sums[size + i] + inside * math.exp(given.inner.get(t, -math.inf)) + 1e-3 for i, t in enumerate(names) if t in given.inner}
        a, b = sum(first.values()) + u0 + 1, sum(inner.values()) + u1 + 1
        log = lambda of, all_: {t: math.log(v / all_) for t, v in of.items()}
        stop = float(np.clip((spelled + 1) / (used + 2), 0.05, 0.95))
        lattice = Lattice(log(first, a), log(inner, b), stop, (math.log((u0 + 1) / a), math.log((u1 + 1) / b)), float(min(whole / total, 1 - 1e-6)))
    return lattice


def valued(counts: DataFrame, lattice: Lattice, tokens: int, distinct: int, ends: int) -> DataFrame:
    """word, n, known, base, score: log10 of the word's probability under the base and the model."""
    total, goes_on = tokens - ends, math.log(1 - _end(tokens, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in gathered(batches):
            for at in range(0, whole.num_rows, 200_000):
                part = whole.slice(at, 200_000)
                c = np.asarray(part.column("c")).astype(float)
                with np.errstate(divide="ignore"):
                    edge = np.log(lattice.whole * c / max(1, total))
                p = goes_on + np.logaddexp(edge, math.log1p(-lattice.whole) + lattice.log_probability(part.column("word").to_pylist()))
                base = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array((c > 0).astype(np.int64)), pa.array(base), pa.array(p / math.log(10))], ["word", "n", "known", "base", "score"])

    return counts.mapInArrow(run, "word string, n long, known long, base double, score double")


def _end(tokens: int, ends: int) -> float:
    """Probability that a token is a text's end."""
    return (ends + 0.5) / (tokens + 1)


def scored(docs: DataFrame, vocabulary_file: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 5 is 1), n_tokens, n_known, train_tokens, base_score, score; held-out texts are not learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (fold(5) == 1).alias("held_out"))
    counts = written(word_counts(rows))
    sums = counts.agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = rows.where("not held_out").count()
    total, distinct = (sums["c"] or 0) + ends, sums["v"] + (ends > 0)
    lattice = trained(Lattice.of(vocabulary(vocabulary_file)), counts, total - ends)
    values = written(valued(counts, lattice, total, distinct, ends))
    top = values.orderBy(F.desc("n"), "word").limit(frequent).select("word", "known", "base", "score").toArrow()
    index = spark_broadcast(docs, (top.column("word").cast(pa.binary()).to_pylist(), *(np.asarray(top.column(c)) for c in ("known", "base", "score"))))
    end = (int(ends > 0), math.log10((ends + 0.5) / (total + 0.5 * (distinct + 1))), math.log10(_end(total, ends)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row one without a word: its frequent words' sums and the end; one for each other word: its occurrences."""
        names, known, base, score = index.value
        number = {w: i for i, w in enumerate(names)}
        for part in slices(batches):
            sums, rare, times, each = [], [], [], []
            for text in part["text"]:
                got = words(text)
                k = np.fromiter(map(number.get, got, repeat(-1)), np.int64, len(got))
                hit = k[k >= 0]
                sums.append((len(got) + 1, int(known[hit].sum()) + end[0], float(base[hit].sum()) + end[1], float(score[hit].sum()) + end[2]))
                counts = Counter([got[i] for i in np.flatnonzero(k < 0)]) if len(hit) < len(got) else {}
                rare.extend(counts)
                times.extend(counts.values())
                each.append(len(counts))
            n = len(each)
            row = pa.array(np.concatenate([np.arange(n), np.repeat(np.arange(n), each)]))
            ids = [pa.array(part[c], t).take(row) for c, t in (("doc_id", pa.int64()), ("key", pa.int64()), ("held_out", pa.bool_()))]
            word = pa.array([None] * n + rare, pa.binary()).cast(pa.string())
            texts = [np.concatenate([np.array(column), np.zeros(len(rare), type(column[0]))]) for column in zip(*sums)]
            yield pa.RecordBatch.from_arrays([*ids, word, pa.array([1] * n + times, pa.int64()), *map(pa.array, texts)], ["doc_id", "key", "held_out", "word", "times", "n_tokens", "n_known", "base_score", "score"])

    parts = rows.withColumn("key", F.xxhash64("text")).mapInArrow(run, "doc_id long, key long, held_out boolean, word string, times long, n_tokens long, n_known long, base_score double, score double")
    parts = written(parts)
    index.destroy()
    ids = ["doc_id", "key", "held_out"]
    rare = parts.where("word is not null").select(*ids, "word", "times").join(values.select("word", "known", "base", F.col("score").alias("s")), "word")
    rare = rare.select(*ids, F.lit(0).cast("long").alias("times"), F.lit(0).cast("long").alias("n_tokens"), (F.col("times") * F.col("known")).alias("n_known"), (F.col("times") * F.col("base")).alias("base_score"), (F.col("times") * F.col("s")).alias("score"))
    both = parts.where("word is null").select(*ids, "times", "n_tokens", "n_known", "base_score", "score").unionByName(rare)
    each = both.groupBy(*ids).agg(*[F.sum(c).alias(c) for c in ("times", "n_tokens", "n_known", "base_score", "score")])
    # a row of very many repeats is written out in steps, so that no cell holds them all
    each = each.withColumn("step", F.explode(F.expr(f"sequence(0L, (times - 1) div {REPEATS})")))
    each = each.withColumn("one", F.explode(F.expr(f"sequence(1L, least({REPEATS}L, times - step * {REPEATS}))")))
    whole = lambda c: (F.col(c) / F.col("times")).cast("long").alias(c)
    return each.select("doc_id", "held_out", whole("n_tokens"), whole("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") / F.col("times")).alias("base_score"), (F.col("score") / F.col("times")).alias("score"))


def spark_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)
