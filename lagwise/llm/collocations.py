"""Collocations: phrases of two and three words that occur more often together than their parts would by themselves, by language.

A text is lower-cased (A-Z) and split into pieces at . , ; : ! ? and line ends, and those into words at blanks and tabs. Four passes, each linear in the text:

1. Runs of two and three words go into a count-min sketch of one row whose cells grow with the input (a cell for some BYTES_A_CELL bytes of text, at most
   MOST_CELLS). Tasks send cells as sorted steps in RANGES ranges, none more than least times a batch, so that a very common phrase costs no more than
   others. What is kept of the sketch are bits: which cells reach the least count.
2. A run is a candidate if its cell reaches the least count (an upper bound of its own count, so none is lost), and its two-word parts do so. Candidates are
   dealt into blocks by their first word, as many as the sketch's bits ask for. For each block a text is cut down to the stretches in which a candidate of
   that block begins: all blocks together get each candidate's place once, however many blocks there are. Words are counted here too.
3. Each block's candidates compile into a pyahocorasick automaton of phrases between delimiters; shards of the block's stretches are scanned for all
   matches, overlapping ones too, and the counts are summed. They are exact.
4. Counts below the least go; scores, containment and ranks are joins and windows.

A null text is an empty one, a null language is und; null ids and repeated rows count as all others; an empty table gives no rows; columns other than text
and lang are not read. A piece is held whole, however long; a text of many pieces is worked on in parts of PART bytes.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import shuffle_parts, slices, written

#: Least count of a phrase, phrases reported for a language, percent of a phrase's occurrences that lie in one longer phrase and drop it.
LEAST, TOP, INSIDE = 10, 2000, 50
#: Bytes of text for one cell of the sketch, cells at most (their bits are 128 MB) and at least, ranges of cells that are added up apart; a step that is none.
BYTES_A_CELL, MOST_CELLS, LEAST_CELLS, RANGES, SKIP = 4, 1 << 30, 1 << 20, 256, 65535
#: Bytes of text worked on at a time, candidates expected in an automaton (some 10 MB), bytes of all text in a shard, at most and at least; words whose counts a task
#: keeps before it passes them on (and eight times as many candidates' hashes, so that it names them once).
PART, CANDIDATES, SHARD, SMALL, REMEMBERED = 1 << 21, 30_000, 1 << 26, 1 << 22, 250_000
#: Stands between pieces; no byte of UTF-8.
_END = b"\xff"
_PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + b".,;:!?\n\x0b\x0c\r\t", string.ascii_lowercase.encode() + b"\n" * 10 + b" ")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words(text: bytes) -> list[bytes]:
    """Words of a text (UTF-8), with _END between pieces."""
    return text.translate(_PLAIN).replace(b"\n", b" " + _END + b" ").split()


def parts(text: bytes, size: int = PART) -> Iterator[bytes]:
    """A text in parts that end where a piece does."""
    at = 0
    while len(text) - at > size:
        ends = [text.rfind(c, at, at + size) for c in b".,;:!?\n\x0b\x0c\r"]
        end = max(ends)
        if end < 0:  # a piece longer than the size: up to its end
            ends = [e for c in b".,;:!?\n\x0b\x0c\r" if (e := text.find(c, at + size)) >= 0]
            end = min(ends, default=len(text))
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


def _gathered(batches: Iterator[pa.RecordBatch], size: int = PART) -> Iterator[tuple[str, list[bytes]]]:
    """language, words of some texts in it, about so many bytes at a time."""
    held: dict[str, list[bytes]] = {}
    bytes_ = Counter()
    for rows in slices(batches):
        for lang, text in zip(rows["lang"], rows["text"]):
            for part in parts(text.encode("utf-8", "replace"), size):
                held.setdefault(lang, []).append(part)
                bytes_[lang] += len(part)
                if bytes_[lang] >= size:
                    yield lang, words(b"\n".join(held.pop(lang)))
                    del bytes_[lang]
    for lang, texts in held.items():
        yield lang, words(b"\n".join(texts))


def _hash(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


def distinct(w: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, _END first, and each word's place among them."""
    numbers = defaultdict(count().__next__)
    numbers[_END]
    at = np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))
    return list(numbers), at


def runs(lang: str, names: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, of the runs of two and three that begin at it, and whether there are such runs (within a piece)."""
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[at]
    one = np.append(one, np.zeros(2, np.uint64))  # nothing follows the last words
    inside = np.append(at != 0, [False, False])
    of = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    pair = inside[:-2] & inside[1:-1]
    two = _hash((one[:-2] + of) * _MIX[0] + one[1:-1])
    three = _hash(two * _MIX[2] + one[2:])
    return one[:-2], two, three, pair, pair & inside[2:]


def cells(h: np.ndarray, width: int) -> np.ndarray:
    """The cells of runs in the sketch."""
    return (h & np.uint64(width - 1)).astype(np.uint32)


def steps(at: np.ndarray) -> np.ndarray:
    """Sorted places as steps of two bytes from one to the next; SKIP leads on without a place."""
    step = np.diff(at.astype(np.int64), prepend=0)
    far = step // SKIP
    out = np.full(len(at) + int(far.sum()), SKIP, "<u2")
    out[np.arange(len(at)) + np.cumsum(far)] = step % SKIP
    return out


def places(steps_: np.ndarray) -> np.ndarray:
    return np.cumsum(steps_, dtype=np.int64)[steps_ != SKIP]


def _sketch(width: int, least: int):
    """Texts -> cells (range, steps: sorted places in the range, each up to least times)."""
    size = np.uint32(width // RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, w in _gathered(batches):
            _, two, three, pair, triple = runs(lang, *distinct(w))
            at = np.sort(np.concatenate([cells(two[pair], width), cells(three[triple], width)]))
            if len(at) > least:  # a cell that stands least places before too is there often enough
                at = at[np.append(np.ones(least, bool), at[least:] != at[:-least])]
            cut = np.searchsorted(at, np.arange(RANGES + 1, dtype=np.uint64) * size)
            rows = [(i, steps(at[a:b] - np.uint32(i) * size).tobytes()) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["range", "steps"])

    return run


def _reached(width: int, least: int):
    """range, steps, rows of one range together -> range, bits: the cells that reach the least count."""
    size = width // RANGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, many, counts = None, [], 0, None

        def add() -> None:
            nonlocal held, many
            if held:
                counts[:] += np.bincount(np.concatenate(held), minlength=size)
            held, many = [], 0

        def bits() -> pa.RecordBatch:
            add()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counts >= least).tobytes()], pa.binary())], ["range", "bits"])

        for rows in slices(batches, 100):
            for i, x in zip(rows["range"], rows["steps"]):
                if i != now:
                    if now is not None:
                        yield bits()
                    now, counts = i, np.zeros(size, np.int64)
                held.append(places(np.frombuffer(x, "<u2")))
                many += len(held[-1])
                if many > size:
                    add()
        if now is not None:
            yield bits()

    return run


def stretches(w: list[bytes], block: np.ndarray, pair: np.ndarray, triple: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each block the words that its candidates cover: stretches between line ends, with blanks around each word. pair, triple: where candidates begin."""
    n = len(w)
    begin, long_ = np.flatnonzero(pair), np.flatnonzero(triple)
    of = block.astype(np.int64) * (n + 2)
    at = np.unique(np.concatenate([of[begin] + begin, of[begin] + begin + 1, of[long_] + long_ + 2]))
    cut = np.flatnonzero(np.diff(at) != 1) + 1  # a gap between any two blocks: their places lie 2 apart at least
    place, owner = at % (n + 2), at // (n + 2)
    place = np.insert(place, cut, n)
    owner = np.insert(owner, cut, owner[cut])
    named = [*w, b"\n"]
    edges = np.flatnonzero(np.diff(owner)) + 1
    for few in np.split(np.arange(len(place)), edges):
        if len(few):
            yield int(owner[few[0]]), b" " + b" ".join(map(named.__getitem__, place[few].tolist())) + b" "


def _candidates(bits_sent, width: int, blocks: int):
    """Texts -> candidates (lang, block, phrases: lines, compressed), stretches (lang, block, text) and counts of words (lang, word, n)."""
    columns = ("lang", "block", "phrases", "text", "word", "n")
    types = (pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int64())

    def batch(lang: str, size: int, **given) -> pa.RecordBatch:
        given["lang"] = [lang] * size
        return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(size, t) for c, t in zip(columns, types)], list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, told, counts = bits_sent.value, {}, {}

        def reach(h: np.ndarray) -> np.ndarray:
            at = cells(h, width)
            return (bits[at >> np.uint32(3)] >> (np.uint32(7) - (at & np.uint32(7))).astype(np.uint8)) & 1 == 1

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                for i in range(0, len(own), 50_000):
                    some = dict(islice(own.items(), i, i + 50_000))
                    yield batch(lang, len(some), word=[w.decode("utf-8", "replace") for w in some], n=list(some.values()))
            counts.clear()

        for lang, w in _gathered(batches):
            names, number = distinct(w)
            own = counts.setdefault(lang, Counter())
            own.update(dict(zip(names[1:], np.bincount(number, minlength=len(names))[1:].tolist())))
            if sum(map(len, counts.values())) > REMEMBERED:
                yield from counted()
            one, two, three, pair, triple = runs(lang, names, number)
            pair[pair] = reach(two[pair])
            triple &= pair & np.append(pair[1:], False)
            triple[triple] = reach(three[triple])
            block = (_hash(one) % np.uint64(blocks)).astype(np.int32)
            known = told.get(lang, np.zeros(0, np.uint64))
            known = known if len(known) < REMEMBERED * 8 else known[:0]
            named: dict[int, list[bytes]] = defaultdict(list)
            for h, there, size in ((two, pair, 2), (three, triple, 3)):
                at = np.flatnonzero(there)
                hashes, first = np.unique(h[at], return_index=True)
                place = np.searchsorted(known, hashes)
                new = np.append(known, np.uint64(0))[place] != hashes if len(known) else np.ones(len(hashes), bool)
                known = np.sort(np.concatenate([known, hashes[new]]))
                at = at[first[new]]
                for i, b in zip(at.tolist(), block[at].tolist()):
                    named[b].append(b" ".join(w[i : i + size]))
            told[lang] = known
            if named:
                yield batch(lang, len(named), block=list(named), phrases=[zlib.compress(b"\n".join(sorted(p)), 1) for p in named.values()])
            for owner, text in stretches(w, block, pair, triple):
                yield batch(lang, 1, block=[owner], text=[text.decode("utf-8", "replace")])
        yield from counted()

    return run


def automaton(phrases: dict[str, int]) -> ahocorasick.Automaton:
    """Phrases between delimiters, so that no match begins or ends inside a word."""
    a = ahocorasick.Automaton()
    for p, i in phrases.items():
        a.add_word(f" {p} ", i)
    a.make_automaton()
    return a


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one (lang, block, shard) together, phrases before texts -> lang, phrase, n."""
    now, phrases, found, a = None, {}, Counter(), None

    def counted() -> pa.RecordBatch:
        names = list(phrases)
        got = [(now[0], names[i], n) for i, n in found.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else [()] * 3, (pa.string(), pa.string(), pa.int64()))], ["lang", "phrase", "n"])

    for rows in slices(batches, 1000):
        for lang, block, shard, some, text in zip(*(rows[k] for k in ("lang", "block", "shard", "phrases", "text"))):
            if (lang, block, shard) != now:
                if found:
                    yield counted()
                now, phrases, found, a = (lang, block, shard), {}, Counter(), None
            if text is None:
                for p in zlib.decompress(some).decode("utf-8", "replace").split("\n"):
                    phrases.setdefault(p, len(phrases))
            elif phrases:
                a = a or automaton(phrases)
                found.update(map(itemgetter(1), a.iter(text)))
    if found:
        yield counted()


def phrase_counts(docs: DataFrame, least: int = LEAST, candidates: int = CANDIDATES, cells_least: int = LEAST_CELLS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, n of the phrases of two and three words that occur least times or more, and lang, word, n of all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text <> ''")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = cells_least
    while width < min(MOST_CELLS, size // BYTES_A_CELL):
        width *= 2
    sketch = rows.mapInArrow(_sketch(width, least), "range int, steps binary").repartition(shuffle_parts(spark), "range").sortWithinPartitions("range")
    bits = np.zeros(width // 8, np.uint8)  # of at most MOST_CELLS cells
    for r in sketch.mapInArrow(_reached(width, least), "range int, bits binary").collect():
        bits[r["range"] * (len(bits) // RANGES) : (r["range"] + 1) * (len(bits) // RANGES)] = np.frombuffer(r["bits"], np.uint8)
    blocks = max(1, -(-int(np.bitwise_count(bits).sum()) // candidates))
    sent = spark.sparkContext.broadcast(bits)
    found = written(rows.mapInArrow(_candidates(sent, width, blocks), "lang string, block int, phrases binary, text string, word string, n long"))
    sent.destroy()
    counts = found.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # each shard of a block's stretches gets all of its candidates
    shards = max(1, max(size // SHARD, min(shuffle_parts(spark), size // SMALL)) // blocks)
    every, one = F.sequence(F.lit(0), F.lit(shards - 1)), F.array(F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int"))
    dealt = found.where("block is not null").select("lang", "block", "phrases", "text", F.explode(F.when(F.col("text").isNull(), every).otherwise(one)).alias("shard"))
    dealt = dealt.repartition(max(shuffle_parts(spark), blocks * shards), "lang", "block", "shard").sortWithinPartitions("lang", "block", "shard", F.col("phrases").isNull())
    scanned = dealt.mapInArrow(_scan, "lang string, phrase string, n long")
    return written(scanned.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)), counts


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a (its count), l and r (those of its parts at the cut that scores least), n (words of the language), score: each language's
    first phrases by score, count and bytes."""
    spark = docs.sparkSession
    phrases, single = phrase_counts(docs, least)
    w, size = F.split("phrase", " "), F.size(F.split("phrase", " "))
    piece = lambda cut, right, start, length: F.struct(F.lit(2 * cut + right).alias("at"), F.array_join(F.slice(w, start, length), " ").alias("part"))
    # the parts at each cut: left and right
    pieces = F.when(size == 2, F.array(piece(0, 0, 1, 1), piece(0, 1, 2, 1))).otherwise(F.array(piece(0, 0, 1, 1), piece(0, 1, 2, 2), piece(1, 0, 1, 2), piece(1, 1, 3, 1)))
    known = phrases.where(size == 2).select("lang", F.col("phrase").alias("part"), "n").unionByName(single.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), "n"))
    parts = phrases.select("lang", "phrase", F.col("n").alias("a"), F.explode(pieces).alias("p")).select("lang", "phrase", "a", "p.at", "p.part").join(known, ["lang", "part"])
    side = lambda at: F.max(F.when(F.col("at") == at, F.col("n")))
    cuts = parts.groupBy("lang", "phrase", "a").agg(*[F.when(side(2 * i).isNotNull(), F.struct(side(2 * i).alias("l"), side(2 * i + 1).alias("r"))).alias(f"c{i}") for i in (0, 1)])
    # the most frequent longer phrase around each phrase of two words
    around = phrases.where(size == 3).select("lang", F.explode(F.array_distinct(F.array(F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, 2, 2), " ")))).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    scores = lambda c: F.expr(f"cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast({c}.l as decimal(19,0)) * cast({c}.r as decimal(19,0)))")
    best = cuts.withColumn("s0", scores("c0")).withColumn("s1", scores("c1"))
    second = F.col("s1").isNotNull() & (F.col("s1") < F.col("s0"))
    best = best.select("lang", "phrase", "a", F.when(second, F.col("c1")).otherwise(F.col("c0")).alias("c"), F.when(second, F.col("s1")).otherwise(F.col("s0")).alias("score"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # the first of each of many parts of a language, then the first of those
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(shuffle_parts(spark)))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = single.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", "score")
