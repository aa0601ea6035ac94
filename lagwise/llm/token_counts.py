"""Token counts of whole texts; huge documents are encoded as overlapping chunks that are spliced where their boundaries are proven to agree.

A document of more than two chunks is cut into chunks of CHUNK characters, which are dealt over all tasks; each is encoded with offsets, from its start
to its end and so many characters beyond (the overlap). A byte-level tokenizer matches one pattern after another from left to right, without looking
back, and merges inside a match only. So the encodings of two chunks agree from the first place on at which both begin a match (a boundary), if the left
chunk's boundary there is the whole text's: it is when it lies before the last non-blank character that is MARGIN or more before the chunk's end (see
boundaries). The left chunk's tokens up to that place and the right chunk's from there on are the whole text's. Where an overlap has no common boundary
it is widened WIDEN times, and where it would reach beyond the right chunk, both become one; only the chunks concerned are encoded again.

Shorter documents are counted by their words: a single blank between two characters that are not blank always begins a match, so that a text has as many tokens as
the parts between such blanks have together. A task remembers the counts of parts that it has seen, REMEMBERED or REMEMBERED_CHARS at most.

Other tokenizers (with a normalizer, other pre-tokenizers, or special strings that can overlap) are refused: the proof doesn't hold for them.

A null text is an empty one, of 0 tokens. Null ids and repeated rows are counted each; an empty table gives no rows; columns other than doc_id and text
are not read. A text without blanks is one match: its chunks become one and its memory is that of the whole text, as the library's is.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.common import shuffle_parts, slices, written

#: Characters of a chunk and of the first overlap; times that an overlap grows; tokens beyond which a document is over the limit.
CHUNK, OVERLAP, WIDEN, LIMIT = 16_384, 256, 4, 512
#: Parts, and their characters, whose counts a worker remembers.
REMEMBERED, REMEMBERED_CHARS = 500_000, 32_000_000
#: Characters that a pattern of the pre-tokenizer looks at beyond its match at most, other than blanks: those of 'll, 've and 're.
LOOKAHEAD = 3


@lru_cache(maxsize=1)
def _tokenizer(file: str):
    """Kept by a worker from task to task; a task encodes on its own core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


def margin(file: str) -> int:
    """Characters before a chunk's end at which a match may not be the whole text's; an error for tokenizers that can't be spliced."""
    with open(file, encoding="utf-8") as f:
        said = json.load(f)
    before = said["pre_tokenizer"] or {}
    special = [t for t in said["added_tokens"]]
    strings = [t["content"] for t in special]
    if said["normalizer"] or said["model"].get("dropout") or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
        raise ValueError("only byte-level tokenizers without a normalizer can be spliced")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special) or any(a.endswith(b[:k]) for a in strings for b in strings for k in range(1, min(len(a), len(b)) + (a != b))):
        raise ValueError("special strings that take blanks or can overlap can't be spliced")
    return max([LOOKAHEAD, *map(len, strings)])


def boundaries(text: str, tokenizer, whole: bool, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a match begins (or the text ends), and the tokens before each. whole: the text's end is the document's.

    Else only places up to the last non-blank character that lies margin or more before the end: a match that ends there has seen a character that it
    doesn't take, or a blank run's end, and no special string or apostrophe form that the end cuts off can begin before it."""
    e = tokenizer.encode(text, add_special_tokens=False)
    words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    starts = np.array([o[0] for o in e.offsets], np.int64)
    first = np.flatnonzero((np.diff(words, prepend=-2) != 0) | (words < 0))
    at, n = starts[first], first
    if whole:
        return np.append(at, len(text)), np.append(n, len(words))
    end = len(text) - margin - 1
    while end >= 0 and text[end].isspace():
        end -= 1
    return at[at <= end], n[at <= end]


_RANGE = "array<struct<start:long,stop:long,before:long,after:long>>"
_PIECE = "key long, start long, stop long, before long, after long, size long, piece string"
_SCANNED = "key long, start long, stop long, before long, after long, size long, total long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text, ranges -> a row for each range with its text."""
    names = [x.split()[0] for x in _PIECE.split(", ")]
    for part in slices(batches, 1):
        for key, text, ranges in zip(part["key"], part["text"], part["ranges"]):
            for i in range(0, len(ranges), 64):
                rows = [(key, r["start"], r["stop"], r["before"], r["after"], len(text), text[r["start"] : r["stop"] + r["after"]]) for r in ranges[i : i + 64]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "piece" else pa.int64()) for c, n in zip(zip(*rows), names)], names)


def _scan(file: str, margin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(file)
        names = [x.split()[0] for x in _SCANNED.split(", ")]
        for part in slices(batches, 16):
            rows = []
            for key, start, stop, before, after, size, piece in zip(*(part[n] for n in names[:6]), part["piece"]):
                whole = start + len(piece) == size
                at, n = boundaries(piece, tokenizer, whole, margin)
                at = at + start
                head, tail = at <= start + before, at >= stop
                rows.append((key, start, stop, before, after, size, int(n[-1]) if stop == size else 0, at[head], n[head], at[tail], n[tail]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 7 else pa.list_(pa.int64())) for i, c in enumerate(zip(*rows))], names)

    return run


def _huge_counts(huge: DataFrame, file: str, chunk: int, overlap: int) -> DataFrame:
    """key, n_tokens of a table key, text, n_chars of documents of more than two chunks."""
    spark, edge = huge.sparkSession, margin(file)
    most = F.floor(F.col("n_chars") / chunk) - 1
    ranges = F.transform(F.sequence(F.lit(0).cast("long"), most), lambda i: F.struct(
        (i * chunk).alias("start"), F.when(i == most, F.col("n_chars")).otherwise((i + 1) * chunk).alias("stop"), F.when(i == 0, 0).otherwise(overlap).cast("long").alias("before"),
        F.when(i == most, 0).otherwise(overlap).cast("long").alias("after"),
    ))
    todo, kept = huge.select("key", "text", ranges.alias("ranges")), None
    while True:
        pieces = todo.mapInArrow(_cut, _PIECE).repartition(shuffle_parts(spark), "key", "start")
        scanned = pieces.mapInArrow(_scan(file, edge), _SCANNED)
        scanned = written(scanned if kept is None else kept.unionByName(scanned))
        # rows of one document: at most the characters of a cell of text through CHUNK
        beside = Window.partitionBy("key").orderBy("start")
        pair = scanned.withColumn("next", F.lead(F.struct("stop", "head", "head_n")).over(beside))
        pair = pair.withColumn("p", F.array_min(F.array_intersect("tail", "next.head"))).withColumn("failed", F.col("next").isNotNull() & F.col("p").isNull())
        if pair.where("failed").isEmpty():
            place = lambda at, n: F.get(n, F.array_position(at, F.col("p")).cast("int") - 1)
            return pair.groupBy("key").agg((F.sum("total") + F.coalesce(F.sum(place("tail", "tail_n") - place("next.head", F.col("next.head_n"))), F.lit(0))).alias("n_tokens"))
        wider = F.col("after") * WIDEN
        joins = F.col("failed") & (wider > F.col("next.stop") - F.col("stop"))
        flags = pair.withColumn("joins", joins).withColumn("after", F.when(F.col("failed") & ~F.col("joins"), wider).otherwise(F.col("after")))
        flags = flags.withColumn("left_joins", F.coalesce(F.lag("joins").over(beside), F.lit(False))).withColumn("left_failed", F.coalesce(F.lag("failed").over(beside), F.lit(False)))
        flags = flags.withColumn("left_after", F.coalesce(F.lag("after").over(beside), F.lit(0).cast("long"))).withColumn("whole", F.sum(F.when(F.col("left_joins"), 0).otherwise(1)).over(beside))
        grouped = flags.groupBy("key", "whole").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("left_after", "start").alias("before"), F.max_by("after", "start").alias("after"), F.max(F.col("failed") | F.col("left_failed")).alias("again"))
        grouped = written(grouped)
        kept = scanned.join(grouped.where("not again").select("key", "start"), ["key", "start"], "left_semi").select(*scanned.columns)
        again = grouped.where("again").groupBy("key").agg(F.collect_list(F.struct("start", "stop", "before", "after")).alias("ranges"))
        todo = huge.join(again, "key").select("key", "text", F.col("ranges").cast(_RANGE).alias("ranges"))


#: What Python takes for blank includes all that the pre-tokenizer does.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class _Known(dict):
    """Tokens of a blank and a part, by part."""

    chars = 0

    def counts(self, texts: list[str], tokenizer) -> list[int]:
        split = [_BETWEEN.split(t) for t in texts]
        if len(self) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.clear()
            self.chars = 0
        new = list(set().union(*(s[1:] for s in split)).difference(self))
        n = [len(e) for e in tokenizer.encode_batch_fast([*(s[0] for s in split), *(f" {p}" for p in new)], add_special_tokens=False)]
        self.update(zip(new, n[len(split) :]))
        self.chars += sum(map(len, new))
        return [first + sum(map(self.__getitem__, s[1:])) for first, s in zip(n, split)]


@lru_cache(maxsize=1)
def _known(file: str) -> _Known:
    return _Known()


def _count(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _tokenizer(file), _known(file)
        for part in slices(batches):
            n = known.counts(part["text"], tokenizer)
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array(part["n_bytes"], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def counted(docs: DataFrame, file: str, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; file: a vocabulary of the tokenizers library, at the same path on each executor."""
    if overlap < 1 or overlap > chunk:
        raise ValueError("an overlap is at least 1 character and at most a chunk")
    margin(file)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.length(text).cast("long").alias("n_chars"))
    plain = rows.where(F.col("n_chars") <= 2 * chunk).select("doc_id", "n_bytes", "text").mapInArrow(_count(file), "doc_id long, n_bytes long, n_tokens long")
    huge = written(rows.where(F.col("n_chars") > 2 * chunk).select(F.monotonically_increasing_id().alias("key"), "*"))
    if not huge.isEmpty():
        of = _huge_counts(huge.select("key", "text", "n_chars"), file, chunk, overlap)
        plain = plain.unionByName(huge.select("key", "doc_id", "n_bytes").join(of, "key").drop("key"))
    return plain.withColumn("over_limit", F.col("n_tokens") > limit)
