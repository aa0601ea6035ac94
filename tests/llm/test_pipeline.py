"""Each stage of the pipeline against a plain version, on odd and on empty tables, and the whole."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lagwise.llm import decontaminate, pii, toxicity

DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def plain_hits(texts: dict, items: dict) -> set:
    """Pairs of a document and an item of which some 13 tokens in a row (all of a shorter item) agree in four of five places."""
    number: dict = {}
    split = lambda t: np.array([number.setdefault(w, len(number)) for w in __import__("re").findall(r"[^\W_]+", (t or "").lower())])
    words, wanted, out = {i: split(t) for i, t in texts.items()}, {i: split(t) for i, t in items.items()}, set()
    for d, w in words.items():
        for i, v in wanted.items():
            n = min(13, len(v))
            if not n or len(set(w.tolist()) & set(v.tolist())) < 0.5 * n:
                continue
            long = np.concatenate([np.full(len(v), -1), w, np.full(len(v), -1)])
            equal = v[:, None] == long[None, :]
            span = len(long) - n + 1
            rows = sum(equal[k : len(v) - n + 1 + k, k : k + span].astype(int) for k in range(n))
            if rows.max() >= np.ceil(0.8 * n - 1e-9):
                out.add((d, i))
    return out


def test_decontamination_of_a_whole_table(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    ascii_docs = docs.where("text is not null")
    texts, wanted = {r["doc_id"]: r["text"] for r in ascii_docs.collect()}, {r["item_id"]: r["text"] for r in items.collect()}
    want = plain_hits(texts, wanted)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()} == want and want
    kept = {r["doc_id"] for r in corpus_pipeline.without_benchmark(spark, docs, DATA).select("doc_id").collect()}
    assert kept == set(texts) - {d for d, _ in want}


def test_toxic_documents_of_a_whole_table_go(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = docs.select("doc_id", "text").collect()
    training = [r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    model = toxicity.fit(docs.where(F.col("doc_id").isin(training)), labels)
    score = model.scores([r["text"] or "" for r in rows])
    kept = corpus_pipeline.without_toxic(spark, docs, DATA)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r, s in zip(rows, score) if s < 0.5)


def test_personal_data_of_a_whole_table_is_masked(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    spans = {r["doc_id"]: [x.split(":") for x in r["spans"].split(",") if x] for r in pii.personal_data(docs).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in corpus_pipeline.without_personal_data(spark, docs, DATA).collect():
        want, at = "", 0
        for kind, begin, end in spans[r["doc_id"]]:
            if int(begin) >= at:
                want += text[r["doc_id"]][at : int(begin)] + f"<{kind.upper()}>"
            at = max(at, int(end))
        want += (text[r["doc_id"]] or "")[at:]
        assert (r["text"] or "") == want and r["n_chars"] == len(want)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, odd, nothing, name):
    stage, n = dict(corpus_pipeline.STAGES)[name], odd.count()
    got = stage(spark, odd, SMALL)
    assert name == "packing" or got.columns == odd.columns
    assert 0 < got.count() <= (10**6 if name == "packing" else n) and stage(spark, nothing, SMALL).count() == 0
    if name == "personal_data":
        assert got.count() == n


def test_the_whole_pipeline(spark):
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    by: dict = {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(by) < docs
    for parts in by.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total


def test_stages_hand_workers_few_texts_at_once(spark, odd, labels, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from lagwise.llm import ngram_join

    name, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], DataFrameWriter.parquet

    def spied(self, path, **kw):
        plan = self._df._jdf.queryExecution().executedPlan().toString()
        if "MapInArrow" in plan and "text#" in plan.partition("MapInArrow")[2]:
            seen.append(int(spark.conf.get(name)))
        return write(self, path, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", spied)
    before = spark.conf.get(name)
    rows = {}
    for stage in (lambda: toxicity.drop_toxic(odd, labels), lambda: ngram_join.one_of_each(odd)):
        kept = stage()
        rows[len(seen)] = kept.count()
        assert "MapInArrow" not in kept._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 2 and seen and max(seen) <= 1000 and spark.conf.get(name) == before
