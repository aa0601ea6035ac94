"""Document fingerprints: digests of the quartiles of hashed byte triplets, and a bounded difference between them.

Each window of four bytes gives three triplets (the first byte of each is the window's); their hashes are counted in 128 buckets. The digest is
text: two hex digits of the length's logarithm, four of the quartiles' ratios, then two bits for each bucket (which quartile its count lies in).
The difference of two digests adds the buckets' distances and bounded distances of length and ratios; likeness is 1 minus its share of the most.

A null text counts as empty. Texts of under four bytes have no triplets: all their buckets are zero and the digest depends on their bytes through
a checksum, so that equal texts have equal digests. For the order, rows go by descending doc_id (null ids last), ties by the text's MD5; the next
document of the last row is the first. Every row gives one row. Columns other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import shuffle_parts

BUCKETS = 128
#: The most that length, either ratio and one bucket can add to a difference.
MOST_LENGTH, MOST_RATIO, MOST_BUCKET = 24, 12, 6
MOST = MOST_LENGTH + 2 * MOST_RATIO + BUCKETS * MOST_BUCKET
_APART = np.array([0, 1, 2, 6])  # distance of quartiles 0 to 3 apart: opposite ones weigh most
_HASH = np.random.default_rng(99).integers(0, BUCKETS, (3, 65536)).astype(np.uint8)  # a pair of bytes to a bucket, before the third is added


def bucket_counts(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(raw) - 3), 1 << 16):
        x = raw[at : at + (1 << 16) + 3].astype(np.uint32)
        a, b, c, d = x[:-3], x[1:-2], x[2:-1], x[3:]
        for i, (p, q) in enumerate(((b, c), (b, d), (c, d))):
            out += np.bincount((_HASH[i][(a << 8) | p] + q * np.uint32(2 * i + 37)) & (BUCKETS - 1), minlength=BUCKETS)
    return out


def digest(text: str) -> str:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    size = min(255, round(np.log(len(raw) + 1) / np.log(1.15)))
    if len(raw) < 4:
        return f"{size:02x}{zlib.crc32(raw.tobytes()) & 0xFFFF:04x}" + "00" * (BUCKETS // 4)
    n = bucket_counts(raw)
    q1, q2, q3 = np.sort(n)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (n > q1).astype(np.uint8) + (n > q2) + (n > q3)
    packed = (code.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
    ratio = lambda q: int(255 * q // q3) if q3 else 0
    return f"{size:02x}{ratio(q1):02x}{ratio(q2):02x}" + packed.tobytes().hex()


def _parsed(d: str) -> tuple[int, int, int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(d), np.uint8)
    return int(raw[0]), int(raw[1]), int(raw[2]), ((raw[3:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).ravel().astype(np.int64)


def difference(a: str, b: str) -> int:
    """From 0 (equal digests) to MOST."""
    (la, pa_, qa, ca), (lb, pb, qb, cb) = _parsed(a), _parsed(b)
    return min(MOST_LENGTH, 2 * abs(la - lb)) + min(MOST_RATIO, abs(pa_ - pb) // 8) + min(MOST_RATIO, abs(qa - qb) // 8) + int(_APART[abs(ca - cb)].sum())


def likeness(a: str, b: str) -> float:
    """1 for equal digests; unrelated texts differ by about a quarter of MOST, which gives 0."""
    return max(0.0, 1 - difference(a, b) / (MOST * 0.3))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    before: tuple | None = None
    for batch in batches:
        out = []
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for bucket, guest, doc, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
                print_ = digest(text)
                if before is not None and before[0] == bucket:
                    _, b_doc, b_text, b_print = before
                    changed = edited(b_text, text)
                    c_print = digest(changed)
                    out.append((b_doc, len(b_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), b_print, c_print, likeness(b_print, c_print), likeness(b_print, print_)))
                before = None if guest else (bucket, doc, text, print_)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, types)], names)


def _range(value, cuts: list[int]):
    """How many of the falling cuts are larger than value: among every STEPth first, then among those of one step."""
    step = max(1, math.isqrt(len(cuts)))
    larger = lambda xs: F.size(F.filter(xs, lambda c: c > value))
    every = larger(F.array(*map(F.lit, cuts[step - 1 :: step])))
    return every * step + larger(F.slice(F.array(*map(F.lit, cuts)), every * step + 1, F.lit(step)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The rows are dealt by ranges of the id, with ranges of about equal numbers of rows; an id (or null) with more rows than a range is cut further by
    the text's MD5. Range i lies in partition i, and the first row of the next range is a guest at the end of each. An id's pieces are as many as its rows ask for, up to the number of
    partitions; rows of equal id and text stay together, one in memory at a time. Only the ranges' borders and first
    rows' keys reach the driver, so many as there are partitions. Texts are shuffled once. Equal rows of one id lie in one range, one after another."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = shuffle_parts(docs.sparkSession)
    found = rows.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")).first()
    many = rows.groupBy("doc_id").count().where(F.col("count") > max(1, found["n"] // parts)).collect()  # fewer than parts
    cuts = sorted({*(found["q"] or []), *(r["doc_id"] for r in many if r["doc_id"] is not None)}, reverse=True)
    # falling ids: the rows above all cuts come first, null ids last
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(_range(F.col("doc_id"), cuts) if cuts else F.lit(0))
    key = F.struct(F.col("doc_id").isNull().alias("a"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("b"), F.md5(F.col("text").cast("binary")).alias("c"))
    sub = F.lit(0)
    for r in many:
        size = -(-r["count"] * parts // found["n"])  # at most parts
        sub = F.when(F.col("doc_id").eqNullSafe(F.lit(r["doc_id"]).cast("long")), F.expr(f"cast(conv(substring(key.c, 1, 8), 16, 10) as bigint) * {size} div 4294967296").cast("int") + 1).otherwise(sub)
    dealt = rows.withColumn("key", key).withColumn("range", F.struct(place.cast("int").alias("p"), sub.cast("int").alias("s")))
    firsts = sorted(dealt.groupBy("range").agg(F.min("key").alias("key")).collect())
    if not firsts:
        return dealt.select(F.lit(0).alias("bucket"), F.lit(False).alias("guest"), "doc_id", "text").mapInArrow(_rows, _RESULT)
    # range, number, its first key, the number of the range before it, in which its first row is a guest
    table = [(tuple(r["range"]), i, tuple(r["key"]), (i - 1) % len(firsts)) for i, r in enumerate(firsts)]
    numbered = docs.sparkSession.createDataFrame(table, "range struct<p:int,s:int>, bucket int, first struct<a:boolean,b:long,c:string>, before int")
    dealt = dealt.join(F.broadcast(numbered), "range")
    there = F.array(F.struct("bucket", F.lit(False).alias("guest")))
    both = F.concat(there, F.array(F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))))
    placed = dealt.select("doc_id", "text", "key", F.explode(F.when(F.col("key") == F.col("first"), both).otherwise(there)).alias("at"))
    placed = placed.select("at.bucket", "at.guest", "doc_id", "text", "key").repartitionById(len(firsts), F.col("bucket"))
    return placed.sortWithinPartitions("bucket", "guest", "key").select("bucket", "guest", "doc_id", "text").mapInArrow(_rows, _RESULT)


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
