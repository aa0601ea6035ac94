"""The trie against one built of nested dictionaries."""

import hashlib
import random
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from lagwise.llm import prefix_trie as pt
from lagwise.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows: list[tuple], branch: bool = True) -> list[tuple]:
    own: dict[int, list] = {}
    for c, t, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode())):
        own.setdefault(c, []).append((role or "", text or ""))
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if branch else 0
        convs[c] = tuple(own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:])
    members: dict[tuple, list] = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members.setdefault(convs[c][:d], []).append(c)
    out = []
    for key, ids in members.items():
        kids = [k for k in members if len(k) == len(key) + 1 and k[: len(key)] == key]
        below = [k for k in members if k[: len(key)] == key]
        leaves = sum(not any(len(m) == len(k) + 1 and m[: len(k)] == k for m in below) for k in below)
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in ids if convs[c] == key)
        out.append((ids[0], len(key), members[key[:-1]][0] if key else None, len(ids), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(df) -> list[tuple]:
    return sorted((tuple(r) for r in pt.trie(pt.branched(pt.conversations(df))).collect()), key=str)


def test_random_conversations(spark):
    r = random.Random(5)
    for many in (3, 40, 160):
        rows = [(c if r.random() < 0.9 else -c, t if r.random() < 0.9 else None, r.choice(("user", "bot", None, "")), r.choice(("a", "a b", "c  d e", None, "", "x\ty z"))) for c in range(many) for t in range(r.randint(0, 5))]
        rows += [(1000 + c, t, "user", "same words here") for c in range(many) for t in range(3)]  # copies, which reach over borders
        rows += [(None, 1, "user", "lost")] * 3 + rows[:5]
        r.shuffle(rows)
        assert built(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_copies_and_long_conversations_reach_over_borders(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 1200, 20) for t in range(60 if c % 40 else 58)] + [(c, t, "user", "hello") for c in range(1, 1200, 20) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = built(df.withColumn("n_convs", F.lit(1)).withColumn("cells", F.lit("x")).withColumn("part", F.lit(0)))
    assert got == plain(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert built(df) == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_nothing_and_nulls(spark):
    assert built(spark.createDataFrame([], SCHEMA)) == [] and built(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []
    rows = [(3, None, None, None)] * 2
    assert built(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_sql(spark):
    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op13_prefix_trie"]).fetchall()
    got = queries.op13_prefix_trie(spark, "/root/testdata/sf0.001")
    assert got.columns == [d[0] for d in con.description]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert built(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")) == plain([tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
