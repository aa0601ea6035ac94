"""Fingerprints when one id, null ids or one row make up most of a table, and their digests against plain counting."""

import collections
import hashlib

import numpy as np

from lagwise.llm import fingerprint


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    return collections.Counter(
        (d, len(t or ""), hashlib.sha256(fingerprint.edited(t or "", n or "").encode()).hexdigest(), fingerprint.digest(t or "")) for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1])
    )


def check(spark, rows):
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in got) == expected(rows)


def test_many_rows_of_one_id_null_ids_and_the_least_id(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdé "), int(rng.integers(0, 40))))
    rows = [(7, word()) for _ in range(300)] + [(None, word()) for _ in range(200)] + [(int(i), word()) for i in rng.integers(-(2**63), 2**63, 200)]
    check(spark, rows + [(-(2**63), "least"), (-(2**63), "least"), (2**63 - 1, None)])


def test_one_row_repeated_and_few_rows(spark):
    check(spark, [(5, "same text here")] * 500 + [(4, "another")])
    check(spark, [(1, "alone")])
    check(spark, [(2, "ab"), (1, "cd")])


def test_digests_count_triplets(spark):
    raw = np.frombuffer("plain words, counted one by one é".encode(), np.uint8).astype(int)
    want = np.zeros(fingerprint.BUCKETS, int)
    for a, b, c, d in zip(raw, raw[1:], raw[2:], raw[3:]):
        for i, (p, q) in enumerate(((b, c), (b, d), (c, d))):
            want[(int(fingerprint._HASH[i][a * 256 + p]) + q * (2 * i + 37)) % fingerprint.BUCKETS] += 1
    assert fingerprint.bucket_counts(raw.astype(np.uint8)).tolist() == want.tolist()
    a = fingerprint.digest("the quick brown fox jumps over the lazy dog again and again " * 5)
    b = fingerprint.digest("völlig anderer Text, der nichts damit zu tun hat; 0123456789 " * 5)
    assert fingerprint.likeness(a, a) == 1 and 0 <= fingerprint.likeness(a, b) < 0.5 and fingerprint.likeness(a, b) == fingerprint.likeness(b, a)


def test_likeness_equals_a_plain_loop():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefgh é"), int(n))) for n in rng.integers(0, 3000, 40)]
    texts += [t[: len(t) // 2] + t[len(t) // 3 :] for t in texts]
    digests = [fingerprint.digest(t) for t in texts]
    for a in digests[::3]:
        for b in digests:
            size, low, high = (abs(int(a[i : i + 2], 16) - int(b[i : i + 2], 16)) for i in (0, 2, 4))
            apart = min(24, 2 * size) + min(12, low // 8) + min(12, high // 8)
            for i in range(6, len(a), 2):
                x, y = int(a[i : i + 2], 16), int(b[i : i + 2], 16)
                for shift in (0, 2, 4, 6):
                    d = abs((x >> shift) % 4 - (y >> shift) % 4)
                    apart += 6 if d == 3 else d
            assert fingerprint.likeness(a, b) == max(0.0, 1 - apart / (0.3 * (24 + 12 + 12 + 6 * 128)))


def test_an_ids_pieces_grow_with_its_rows(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        rows = [(7, f"text number {i}") for i in range(1500)] + [(8, "other")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
        assert fingerprint.fingerprints(docs).rdd.getNumPartitions() > 256
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
