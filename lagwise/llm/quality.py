"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

* A null text counts as empty; every row of the input gets one row, repeated rows included.
* Labels are joined by doc_id; several labels of one id are averaged, null labels are left out.
* Without any label every score is 0.4995 (just below one half, so that nothing is called good unlearned); with labels of one kind it is the one
  value that occurs, at most 0.001 away. An empty table gives no rows; very long texts are described whole.
* Columns of the input other than doc_id and text are not read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import fold, slices, written

#: Random Fourier features, the kernel's width in standard deviations of all statistics, ridge, calibration bins.
FEATURES, WIDTH, RIDGE, BINS, SEED = 128, 1.0, 1.0, 512, 17

_CLASS = np.zeros(256, np.int64)  # 0 control, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 , ; . : - ' ", 6 ! ?, 7 other ASCII signs, 8 bytes of other characters
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 13, 32]] = 1, 2, 3, 4
_CLASS[[33, 63]], _CLASS[128:] = 6, 8
for _c in range(33, 127):
    if _CLASS[_c] == 0:
        _CLASS[_c] = 5 if chr(_c) in ",;.:-'\"" else 7
STATISTICS = 22


def statistics(text: str) -> np.ndarray:
    """Numbers that describe the whole text: shares of character classes, lengths, repetition."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    classes = np.bincount(_CLASS[raw], minlength=9) / n
    bytes_ = np.bincount(raw, minlength=256) / n
    full = bytes_[bytes_ > 0]
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w, distinct = max(1, len(words)), set(words)
    longest = max(map(len, words), default=0)
    per_line = np.array([len(x) for x in lines] or [0])
    upper = sum(map(str.isupper, words)) / w
    same = sum(a == b for a, b in zip(words, words[1:])) / w
    ends = sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines))
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1) if len(words) > 1 else 1.0
    return np.array([
        *np.sqrt(classes), np.log1p(len(raw)), np.log1p(w), sum(map(len, words)) / w, np.log1p(longest), len(distinct) / w, pairs, same, upper,
        np.log1p(per_line.mean()), len(set(lines)) / max(1, len(lines)), ends, np.sqrt(bytes_[124]), -(full * np.log(full)).sum() if len(full) else 0.0,
    ])


@dataclass
class Model:
    """mean, scale: of the statistics; w, b: the random features; beta: ridge weights; x, y: the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def features(self, s: np.ndarray) -> np.ndarray:
        z = np.clip((s - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)])

    def raw(self, s: np.ndarray) -> np.ndarray:
        return self.features(s) @ self.beta

    def score(self, s: np.ndarray) -> np.ndarray:
        """Calibrated, between 0 and 1; within a flat step a thousandth follows the raw score."""
        raw = self.raw(s)
        return np.clip(0.999 * np.interp(raw, self.x, self.y) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the array of statistics; needs the columns doc_id, text, held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([
                pa.array(part["doc_id"], pa.int64()), pa.array(part["held_out"], pa.bool_()), pa.array([statistics(t or "") for t in part["text"]], pa.list_(pa.float64())),
            ], ["doc_id", "held_out", "s"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, s array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("s").flatten()).reshape(-1, STATISTICS)


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic regression: the non-decreasing values nearest to value under the weights."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(labelled: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE) -> Model:
    """labelled: s array<double>, y double. Each task sums its part of the normal equations; only sums reach the driver."""
    k = STATISTICS
    row = labelled.agg(
        F.count("*").alias("n"), *[F.avg(F.col("s")[i]).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.col("s")[i]).alias(f"d{i}") for i in range(k)], F.avg("y").alias("y")
    ).first()
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(size=(k, features)) / (width * np.sqrt(k)), rng.uniform(0, 2 * np.pi, features)
    if not row["n"]:
        return Model(np.zeros(k), np.ones(k), w, b, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    mean, sd = np.array([row[f"m{i}"] for i in range(k)]), np.array([row[f"d{i}"] for i in range(k)])
    model = Model(mean, np.where(sd > 1e-9, sd, 1.0), w, b, np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    upper = np.triu_indices(features + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right, any_ = np.zeros((features + 1, features + 1)), np.zeros(features + 1), False
        for batch in batches:
            if batch.num_rows:
                any_, z = True, model.features(_matrix(batch))
                gram += z.T @ z
                right += z.T @ np.asarray(batch.column("y"))
        if any_:
            v = np.concatenate([gram[upper], right])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["i", "v"])

    found = labelled.select("s", "y").mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
    gram, right = np.zeros((features + 1, features + 1)), found[len(upper[0]) :]
    gram[upper] = found[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    penalty = ridge * np.eye(features + 1)
    penalty[0, 0] = 1e-9
    model.beta = np.linalg.solve(gram + penalty, right)
    return calibrate(model, labelled)


def calibrate(model: Model, labelled: DataFrame, bins: int = BINS) -> Model:
    """Isotonic steps of the label's mean over fixed bins of the raw score; the driver gets a row for each bin."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(_matrix(batch))
                yield pa.RecordBatch.from_arrays([pa.array((np.clip((raw + 0.5) / 2, 0, 1) * (bins - 1)).round().astype(np.int32)), pa.array(raw), batch.column("y")], ["bin", "raw", "y"])

    seen = labelled.select("s", "y").mapInArrow(place, "bin int, raw double, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("raw").alias("x"), F.avg("y").alias("y")).toPandas().sort_values("bin")
    model.x, model.y = seen["x"].to_numpy(), pool_adjacent(seen["y"].to_numpy(), seen["n"].to_numpy())
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = model.score(_matrix(batch))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def averaged(labels: DataFrame, name: str) -> DataFrame:
    """One row for each labelled id: doc_id and y, the mean of its labels."""
    return labels.where(F.col(name).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(name).cast("double")).alias("y"))


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 3 is 1), score, predicted for each document; held-out labels are not used."""
    stats = written(document_statistics(docs.select("doc_id", "text", (fold(3) == 1).alias("held_out"))))
    model = fit(stats.where(~F.col("held_out")).join(averaged(labels, "quality"), "doc_id").select("s", "y"))
    return score(stats, model)
