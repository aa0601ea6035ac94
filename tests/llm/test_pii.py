"""Strict spans against plain patterns over a whole table, the method's additions, and dense texts."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from lagwise.llm import pii

DATA = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def strict(text: str) -> list[tuple[int, int, int]]:
    """begin, kind, end."""
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def listed(spans) -> str:
    return ",".join(f"{pii.KINDS[k]}:{b}:{e}" for b, k, e in spans)


def compare(rows, texts):
    for r in rows:
        want = strict(texts[r["doc_id"]] or "")
        assert [r[f"n_{kind}"] for kind in pii.KINDS] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest()
        assert set(listed(want).split(",")) <= set(r["spans"].split(","))


def test_strict_spans_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    compare(pii.personal_data(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def test_strict_spans_of_random_strings(spark):
    rng = random.Random(5)
    texts = {i: "".join(rng.choice(["a", "@", ".", "+", "-", " ", "1", "23", "4111111111111111", "é", "(", ")", "300", "x.y", "\n"]) for _ in range(rng.randrange(60))) for i in range(600)}
    compare(pii.personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)


def test_the_classifier_adds_what_the_labelers_believe(spark):
    word = lambda i: f"thing{'abcdefghij'[i % 10]}"
    texts = [f"{word(i)} mail bob{i}@site.com or call +1 415 555 {1000 + i}" for i in range(60)]
    texts += [f"{word(i)} contact ann{i} (at) site (dot) com today" for i in range(60)]
    texts += [f"{word(i)} order 1234567890123{i % 7}{i % 10} is here" for i in range(60)] + [f"We met at noon. Bring in {i}" for i in range(60)]
    got = [r["spans"] for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert all(s.count("email") == 1 for s in got[:120])
    assert not any("email" in s for s in got[180:]) and sum(bool(s) for s in got[120:180]) == sum(bool(strict(t)) for t in texts[120:180])


def test_dense_texts_take_time_in_proportion(spark):
    one = "a1@b.org, (415) 555-0000 +1 (415) 555-0000; 1.2.3.4 "
    took = []
    for n in (3000, 12000):
        text = one * n
        began = time.time()
        r = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        took.append(time.time() - began)
        assert (r["n_email"], r["n_phone"], r["n_ip"]) == (n, n, n) and r["base_sha256"] == hashlib.sha256(listed(strict(text)).encode()).hexdigest()
    assert took[1] < 8 * took[0] + 5


def test_additions_overlap_no_strict_match(spark):
    rng = random.Random(6)
    spans = sorted((b, b + rng.randrange(1, 40), rng.random() < 0.3) for b in (rng.randrange(20_000) for _ in range(1500)))
    rows = spark.createDataFrame([([(b, e, base) for b, e, base in spans],)], "spans array<struct<begin:int,end:int,base:boolean>>")
    got = [tuple(x) for x in rows.select(pii._apart(F.col("spans")).alias("s")).first()["s"]]
    assert got == [(b, e, s) for b, e, s in spans if s or not any(t and x < e and b < y for x, y, t in spans)]
