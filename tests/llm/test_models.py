"""Trained operators on a whole table against plain versions, and their accuracy on rows that were not learned from."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.llm import langid, quality, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def rest(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_quality_equals_plain_ridge_and_isotonic_regression(tables):
    docs, labels = tables
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    s = {i: quality.statistics(t) for i, t in texts.items()}
    ids = [i for i in s if rest(i, 3) != 1 and i in y]
    x, target = np.array([s[i] for i in ids]), np.array([float(y[i]) for i in ids])
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.normal(size=(quality.STATISTICS, quality.FEATURES)) / np.sqrt(quality.STATISTICS), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    sd = x.std(0)
    model = quality.Model(x.mean(0), np.where(sd > 1e-9, sd, 1.0), w, b, np.zeros(0), np.zeros(0), np.zeros(0))
    z = model.features(x)
    model.beta = np.linalg.solve(z.T @ z + quality.RIDGE * np.diag([1e-9, *np.ones(quality.FEATURES)]), z.T @ target)
    raw = model.raw(x)
    bins = (np.clip((raw + 0.5) / 2, 0, 1) * (quality.BINS - 1)).round()
    used = np.unique(bins)
    model.x = np.array([raw[bins == k].mean() for k in used])
    means, weight = [target[bins == k].mean() for k in used], [(bins == k).sum() for k in used]
    # the isotonic fit as the greatest of the least means over all stretches
    mean = lambda i, j: np.average(means[i : j + 1], weights=weight[i : j + 1])
    model.y = np.array([max(min(mean(i, j) for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))])
    got = {r["doc_id"]: r for r in quality.classify_quality(docs, labels).collect()}
    want = dict(zip(texts, model.score(np.array([s[i] for i in texts]))))
    assert {i: r["score"] for i, r in got.items()} == {i: pytest.approx(v, abs=1e-5) for i, v in want.items()}
    held = [(got[i]["predicted"], y[i]) for i in y if i in got and got[i]["held_out"]]
    print("quality: right on held-out", sum(a == b for a, b in held), "of", len(held))
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_telling_features_equal_plain_counts(tables):
    docs, labels = tables
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    of = lambda t: {f for w in set(toxicity._WORD.findall(t.lower())) for f in toxicity.features(w)}
    p, u = {}, {}
    for i, t in texts:
        for f in of(t):
            u[f] = u.get(f, 0) + 1
            if i in toxic:
                p[f] = p.get(f, 0) + 1
    n, m = sum(i in toxic for i, _ in texts), len(texts)
    z = {}
    for f, k in p.items():
        if k >= 3:
            share = (k + u[f] + 1) / (n + m + 2)
            z[f] = ((k + 0.5) / (n + 1) - (u[f] + 0.5) / (m + 1)) / np.sqrt(share * (1 - share) * (1 / n + 1 / m))
    positives = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi")
    got = toxicity.telling(positives, docs, n, m)
    assert set(got) == {f for f in z if z[f] > toxicity.LEAST_Z} and [z[f] for f in got] == sorted((z[f] for f in got), reverse=True)
    assert toxicity.telling(positives, docs, n, m, kept=5) == got[:5]
    assert set(toxicity.telling(positives, docs, n, m, considered=2000)) == set(got) & set(sorted(z, key=lambda f: (-p[f], f))[:2000])


def test_toxicity_on_rows_not_learned_from(tables):
    docs, labels = tables
    rows = toxicity.classify_toxicity(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    found, clean = [r["predicted"] for r in rows if r["toxic"]], [r["predicted"] for r in rows if not r["toxic"]]
    print("toxicity: found", sum(found), "of", len(found), "flagged", sum(clean), "of", len(clean))
    assert sum(clean) <= 0.03 * len(clean) and sum(found) >= 0.4 * len(found)
    # a sample that takes effect is bounded, repeated rows included
    many = docs.limit(50).crossJoin(docs.sparkSession.range(40).drop("id")).select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(toxicity.PICKS)).alias("pick"))
    assert len(toxicity._sampled(many, 2000, 100, toxicity.Model({"the": 0}, np.zeros((0, 1)), np.zeros(0)))) <= 100


def test_language_on_rows_not_learned_from(tables):
    docs = tables[0]
    rows = langid.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    print("language: right", sum(r["lang_pred"] == r["lang"] for r in rows), "of", len(rows))
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(r["languages"][:1] == [r["lang_pred"]] and sum(r["shares"]) == pytest.approx(1) for r in rows if r["lang_pred"] != "und")


def test_the_cheapest_language_goes_first():
    rng = np.random.default_rng(8)
    base = rng.dirichlet(np.ones(60) * 0.3, 5) + 1e-4
    p = base / base.sum(1, keepdims=True)
    model = langid.Model(list("abcde"), p)

    def em(q, n):
        share = np.full(len(q), 1 / len(q))
        for _ in range(5000):
            share = share * (q @ (n / (share @ q))) / n.sum()
        return float(n @ np.log(share @ q))

    for _ in range(30):
        n = rng.multinomial(int(rng.integers(20, 3000)), rng.dirichlet(np.ones(5) * 0.5) @ p).astype(float)
        chosen = list(range(5))
        while len(chosen) > 1:
            cost = {k: em(p[chosen], n) - em(p[[c for c in chosen if c != k]], n) for k in chosen}
            k = min(cost, key=cost.get)
            if cost[k] > langid.PENALTY * np.log(n.sum() + 1):
                break
            chosen.remove(k)
        assert sorted(model.proportions(np.arange(60), n)[0]) == chosen


def test_languages_are_bounded(tables):
    docs, _ = tables
    with pytest.raises(ValueError, match="more than 50 values"):
        langid.fit(docs.withColumn("lang", F.col("doc_id").cast("string")), most_languages=50)
