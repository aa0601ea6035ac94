"""Collocations against a plain count over all texts."""

import random
import re
import string
from collections import Counter, defaultdict

import duckdb
import numpy as np

from lagwise.llm import collocations as co
from lagwise.llm import queries

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows: list[tuple], least: int, top: int) -> list[tuple]:
    f: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        n, found = sum(v for p, v in count.items() if len(p) == 1), []
        for p, a in count.items():
            if len(p) == 1 or a < least or any(100 * b >= 50 * a for q, b in count.items() if len(p) == 2 and len(q) == 3 and b >= least and p in (q[:2], q[1:])):
                continue
            score, k = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    w = ["New", "york", "city", "the", "THE", "of", "é", "É", "a b", "x\x00y", "\x1c", "名前", "l'eau", "-", "\x85"]
    gap = (" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?")
    return [(r.choice(("en", "de", None, "")), r.choice((None, "")) if r.random() < 0.1 else "".join(r.choice(w[: r.choice((4, 15))]) + r.choice(gap) for _ in range(r.randint(1, 60)))) for _ in range(n)]


def test_against_plain_counts(spark):
    rows = texts(1, 300) + [("en", "new york city " * 3)] * 7
    df = spark.createDataFrame([(*x, 1, "w") for x in rows], "lang string, text string, n long, phrase string")
    got = co.collocations(df, least=3, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 3, 40)


def test_counts_are_exact_in_many_blocks_and_with_a_full_sketch(spark):
    rows = texts(2, 200)
    df = spark.createDataFrame(rows, "lang string, text string")
    want = {(lang, p, a) for lang, _, p, a, *_ in plain(rows, 3, 10**6)}
    for candidates, width in ((10, 1 << 20), (7, 1 << 11)):
        phrases, words = co.phrase_counts(df, 3, candidates, width)
        got = {tuple(r) for r in phrases.collect()}
        assert want <= got and len(got) == len({x[:2] for x in got})
        assert got == {tuple(r) for r in co.phrase_counts(df, 3)[0].collect()}


def test_long_texts_are_worked_on_in_parts():
    r = random.Random(3)
    for _ in range(50):
        text = "".join(r.choice("ab. \n,") for _ in range(r.randint(0, 400))).encode()
        got = [x for p in co.parts(text, 20) for x in [*co.words(p), b"\xff"]]
        strip = lambda w: b" ".join(w).replace(b"\xff \xff", b"\xff").split(b"\xff")
        assert [x.strip() for x in strip(got) if x.strip()] == [x.strip() for x in strip(co.words(text)) if x.strip()]
    assert list(co.parts(b"x" * 100, 20)) == [b"x" * 100, b""]


def test_steps_lead_to_the_places():
    rng = np.random.default_rng(1)
    for most, n in ((10, 50), (70_000, 20), (1 << 30, 40), (1, 0)):
        at = np.sort(rng.integers(0, most, n).astype(np.uint32))
        assert (co.places(co.steps(at)) == at).all()
    for at in ([65534], [65535], [65536], [131070, 131070]):
        assert co.places(co.steps(np.array(at, np.uint32))).tolist() == at


def test_odd_rows(spark, odd, nothing):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in co.collocations(odd).collect()) == plain(rows, 10, 2000)
    assert co.collocations(nothing).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_collocations"]).fetchall()
    got = queries.op11_collocations(spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(d[0] for d in con.description)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
