"""The n-gram join against all pairs of a whole table, and its components."""

import numpy as np
import pytest

from lagwise.llm import ngram_join

DATA = "/root/testdata/sf0.01"


def plain(texts: dict) -> tuple[dict, dict]:
    """For each id: its class's least id, and how many other rows are equal or at least 0.8 alike in five-word runs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(texts)
    links, root = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sizes = np.array([len(sets[i]) for i in ids])
    where = {}
    for k, i in enumerate(ids):
        for s in sets[i]:
            where.setdefault(s, []).append(k)
    for k, i in enumerate(ids):
        both = np.zeros(len(ids), int)
        for s in sets[i]:
            both[where[s]] += 1
        same = both >= 0.8 * (sizes[k] + sizes - both) - 1e-9 if sizes[k] else np.zeros(len(ids), bool)
        for j in np.flatnonzero(same | np.array([(texts[x] or "") == (texts[i] or "") for x in ids])):
            if j != k:
                links[i] += 1
                a, b = find(i), find(ids[j])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, links


def test_links_and_classes_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    classes, links = plain({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    got = ngram_join.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes and {r["doc_id"]: r["links"] for r in got} == links
    kept = sorted(r["doc_id"] for r in ngram_join.one_of_each(docs).select("doc_id").collect())
    assert kept == sorted(set(classes.values()))


def test_long_chains_come_together_or_raise(spark):
    name = lambda i: bytes([i // 256, i % 256])
    edges = spark.createDataFrame([(name(i), name(i + 1)) for i in range(300) if i % 100], "node binary, to binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in ngram_join.components(edges).collect()}
    assert got == {name(i): name(i // 100 * 100 + 1 if i % 100 else i - 99) for i in range(1, 301) if i not in (1, 101, 201)}
    with pytest.raises(RuntimeError):
        ngram_join.components(edges, rounds=2)


def test_one_row_repeated_very_often(spark):
    docs = spark.range(3000).selectExpr("7 as doc_id", "'one two three four five six' as text", "id as node", "'x' as text_md5")
    assert {(r["doc_id"], r["class_id"], r["copies"], r["links"]) for r in ngram_join.near_duplicates(docs).collect()} == {(7, 7, 3000, 2999)}
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 1
