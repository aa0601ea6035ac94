"""Toxicity: non-negative positive-unlabelled learning on words and word beginnings.

* Confirmed toxic documents are the positives; all training documents, whatever their label, are the unlabelled text.
* The class prior is the share of toxic ones among the labelled training rows, or a parameter.
* In how many positives a feature stands is counted over all of them, and for the `considered` features that stand in the most (in three at least)
  in how many of all training documents. The `kept` ones whose share among the positives exceeds that among all by the most standard errors stay.
* The classifiers are fitted on a sample of at most max_positive positives and max_unlabelled training documents, chosen by a hash of id and text,
  of which the driver gets the numbers of the kept features: at most 2 * kept bytes a document.
* A null or empty text has no features: its score is the classifier's intercept. Every row gets one row, repeated ones too; repeated rows count
  as often as they are there. Several labels of one id are averaged, null labels and null ids are left out. A row with a null id is unlabelled.
* Without a positive example, or a feature that speaks for toxicity, every score is 0. An empty table gives no rows.
* Columns other than doc_id and text are not read, and drop_toxic gives all columns back, whatever they are called.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lagwise.llm.common import TEXTS, among, batches_of, fold, slices, unused, written
from lagwise.llm.quality import averaged

#: Rows for fitting at most, features kept, steps of the optimiser, classifiers that are averaged.
MAX_POSITIVE, MAX_UNLABELLED, KEPT, STEPS, MEMBERS = 4000, 12000, 1024, 800, 3
#: Values that the hash for sampling takes; features that a task counts before it hands its counts on; features considered.
PICKS, FLUSH, CONSIDERED = 1_000_003, 200_000, 65_536
#: A feature is kept if its share among the positives exceeds that among all documents by so many standard errors.
LEAST_Z = 4.0
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings of four and five letters."""
    return (word, *(f"{word[:n]}*" for n in (4, 5) if len(word) >= n))


class _Known(dict):
    """What `of` gives for the words in a string without blanks, kept for strings seen."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, string: str) -> tuple:
        if len(self) > 100_000:
            self.clear()
        got = self[string] = tuple(x for word in _WORD.findall(string) for x in self.of(word))
        return got




@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray  # members x features
    bias: np.ndarray
    _known: _Known | None = field(default=None, repr=False)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Mean over the members of the probability that the text is toxic."""
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            found = self.found(t)
            z = self.bias + (self.weights[:, found].sum(1) if found else 0)
            out[i] = (1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean() if len(self.bias) else 0.0
        return out

    def found(self, text: str) -> list[int]:
        """The numbers of the kept features in a text."""
        if self._known is None:
            self._known = _Known(lambda word: tuple(self.index[f] for f in features(word) if f in self.index))
        return sorted(set(chain.from_iterable(map(self._known.__getitem__, set(text.lower().split())))))

    def __getstate__(self):
        return {**self.__dict__, "_known": None}


def nnpu(p: list[np.ndarray], u: list[np.ndarray], k: int, prior: float, steps: int, seed: int, l2: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear classifier under the non-negative risk prior*R_p(+) + max(0, R_u(-) - prior*R_p(-)), sigmoid loss (bounded, so
    that positives without any telling word move little), Adam.

    p, u: for each positive and unlabelled document the numbers (below k) of its features. Where the corrected negative risk falls below zero its
    gradient is reversed, as the estimator asks."""
    rng = np.random.default_rng(seed)
    theta, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def laid(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(rows).astype(np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])])

    def batch(flat: np.ndarray, cut: np.ndarray, most: int):
        """Scores of some rows, and what gives the mean gradient from each row's slope."""
        some = rng.integers(0, len(cut) - 1, min(len(cut) - 1, most))
        size = cut[some + 1] - cut[some]
        owner = np.repeat(np.arange(len(some)), size)
        f = flat[np.arange(len(owner)) + np.repeat(cut[some] - np.cumsum(size) + size, size)]
        z = np.bincount(owner, theta[f], len(some)) + theta[k]
        return z, lambda d: np.append(np.bincount(f, d[owner], k), d.sum()) / len(some)

    a, b = laid(p), laid(u)
    for t in range(1, steps + 1):
        za, of_a = batch(*a, 512)
        zb, of_b = batch(*b, 1536)
        negative = sig(zb).mean() - prior * sig(za).mean()
        slope_a, slope_b = sig(za) * sig(-za), sig(zb) * sig(-zb)
        g_neg = of_b(slope_b) - prior * of_a(slope_a)
        g = g_neg - prior * of_a(slope_a) if negative >= 0 else -g_neg
        g[:k] += l2 * theta[:k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta[:k] = np.maximum(theta[:k], 0)  # every feature kept speaks for toxicity
    return theta[:k], float(theta[k])


class _Counts:
    """In how many texts each feature stands. Strings between blanks are numbered, and their features too, so that a text is counted by arrays."""

    def __init__(self):
        self.string: dict[str, int] = {}
        self.feature: dict[str, int] = {}
        self.flat, self.cut, self.n = array("q"), array("q", [0]), np.zeros(0, np.int64)

    def add(self, texts: list[str]) -> None:
        sets = [set(t.lower().split()) for t in texts]
        for new in sets:
            for string in new.difference(self.string):
                self.string[string] = len(self.string)
                self.flat.extend([self.feature.setdefault(f, len(self.feature)) for w in _WORD.findall(string) for f in features(w)])
                self.cut.append(len(self.flat))
        flat, cut = np.frombuffer(self.flat, np.int64), np.frombuffer(self.cut, np.int64)  # the arrays grow again when these are gone
        self.n = np.append(self.n, np.zeros(len(self.feature) - len(self.n), np.int64))
        for s in sets:
            i = np.fromiter(map(self.string.__getitem__, s), np.int64, len(s))
            size = cut[i + 1] - cut[i]
            self.n[flat[np.arange(size.sum()) + np.repeat(cut[i] - np.cumsum(size) + size, size)]] += 1  # numbers that repeat are added to once


def counted(rows: DataFrame) -> DataFrame:
    """f, n: in how many of a task's texts each feature stands; each task adds up what it has, at most about FLUSH features at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for part in slices(batches):
            counts.add([t or "" for t in part["text"]])
            if len(counts.feature) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts.feature), pa.string()), pa.array(counts.n)], ["f", "n"])
                counts = _Counts()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts.feature), pa.string()), pa.array(counts.n)], ["f", "n"])

    return rows.select("text").mapInArrow(run, "f string, n long")


def occurrences(rows: DataFrame, model: Model) -> np.ndarray:
    """In how many of the rows' texts each of the model's features stands; the driver gets one sum for each feature."""
    size = len(model.index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for part in slices(batches):
            for text in part["text"]:
                n[model.found(text or "")] += 1
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k])], ["k", "n"])

    got = rows.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[np.asarray(got.column("k"))] = np.asarray(got.column("n"))
    return out


def telling(toxic: DataFrame, everything: DataFrame, positives: int, total: int, kept: int = KEPT, considered: int = CONSIDERED) -> list[str]:
    """The features that speak most for toxicity: by how many standard errors their share among the positives lies above that among all."""
    often = counted(toxic).groupBy("f").agg(F.sum("n").alias("p")).where(F.col("p") >= min(3, positives)).orderBy(F.desc("p"), "f").limit(considered).collect()
    if not often:
        return []
    p, u = np.array([r["p"] for r in often]), occurrences(everything, Model({r["f"]: i for i, r in enumerate(often)}, np.zeros((0, 0)), np.zeros(0)))
    share = (p + u + 1) / (positives + total + 2)
    z = ((p + 0.5) / (positives + 1) - (u + 0.5) / (total + 1)) / np.sqrt(share * (1 - share) * (1 / positives + 1 / total))
    best = np.argsort(-z, kind="stable")[:kept]
    return [often[i]["f"] for i in best[z[best] > LEAST_Z]]


def _sampled(rows: DataFrame, n: int, most: int, model: Model) -> list[np.ndarray]:
    """The features' numbers of at most most of n rows (text, pick): those of the least pick, a hash of id and text, wherever they lie."""
    if n > most:
        rows = rows.where(F.col("pick") <= int(PICKS * most / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [np.array(model.found(t or ""), np.uint16).tobytes() for t in part["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(part["pick"], pa.int64()), pa.array(found, pa.binary())], ["pick", "f"])

    got = rows.select("pick", "text").mapInArrow(run, "pick long, f binary").orderBy("pick", "f").limit(most).select("f").toArrow()
    return [np.frombuffer(f, np.uint16) for f in got.column("f").to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, kept: int = KEPT) -> Model:
    """docs: doc_id, text of the training documents; labels: doc_id, toxic. kept: at most 65,536."""
    with batches_of(docs.sparkSession):
        return _fit(docs, labels, prior, max_positive, max_unlabelled, kept)


def _fit(docs: DataFrame, labels: DataFrame, prior: float | None, max_positive: int, max_unlabelled: int, kept: int) -> Model:
    y = averaged(labels, "toxic")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(PICKS)).alias("pick"))
    n = plain.select("doc_id").join(y, "doc_id", "left").agg(F.count("*").alias("all"), F.count_if(F.col("y") > 0.5).alias("p"), F.count("y").alias("y")).first()
    empty = Model({}, np.zeros((0, 0)), np.zeros(0))
    if not n["p"]:
        return empty
    prior = min(0.9, max(0.001, n["p"] / n["y"])) if prior is None else prior
    toxic = written(among(plain, y.where("y > 0.5").select("doc_id"), "doc_id"))
    best = telling(toxic, plain, n["p"], n["all"], kept)
    if not best:
        return empty
    model = Model({f: i for i, f in enumerate(best)}, np.zeros((0, len(best))), np.zeros(0))
    p, u = _sampled(toxic, n["p"], max_positive, model), _sampled(plain, n["all"], max_unlabelled, model)
    members = [nnpu(p, u, len(best), prior, STEPS, seed) for seed in range(MEMBERS)]
    return Model(model.index, np.array([w for w, _ in members]), np.array([b for _, b in members]))


def scored(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs with all its columns, and a score between 0 and 1 in the column name, which docs must not have."""
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                p = model.scores([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], [*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def classify_toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 5 is 0), score, predicted for each document; held-out rows are not learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(5) == 0).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")), labels, max_positive=max_positive, max_unlabelled=max_unlabelled)
    return scored(rows, model, "score").select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under 0.5, with their columns; repeated rows share their fate. Labels decide through the classifier only."""
    name = unused(docs, "toxicity")
    model = fit(docs.where(fold(5) != 0), labels)
    return written(scored(docs, model, name).where(F.col(name) < 0.5).select(docs.columns), TEXTS)
