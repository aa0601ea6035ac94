"""Language identification: expectation-maximisation of a mixture of languages for each document.

For each language, counts of hashed three-byte grams (lower-case letters, words framed by blanks) from a bounded sample of labelled documents give
gram likelihoods. For a document, EM estimates in what proportions the languages' grams make it up, from all languages at first, until no proportion
moves by TOLERANCE. Then the language whose removal costs the least log likelihood is removed, as long as that cost is below the penalty: PENALTY
times the logarithm of the number of grams. (Half that logarithm is what the Bayesian information criterion asks for each proportion; grams overlap in
two of their three bytes and come in repeated words, so that each counts for less than an independent observation, and the penalty is 12 times as
large.) What is left is the document's set of languages; the prediction is that of the largest proportion, score is that proportion.

Texts that are null or have no letter, and letters of which no gram can be made, are `und` with score 0 and no languages. Languages are the non-null
values of lang, MOST_LANGUAGES at most (a document is compared with all of them; more, such as a column of other things, are an error);
rows with a null lang teach nothing. Without any labelled document all are `und`. A sample of about PER_LANGUAGE documents of each
language at most, chosen by a hash of id and text, is learned from. Every row gives one row; an empty table gives none; columns other than doc_id,
text (and lang for learning) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import fold, slices

PER_LANGUAGE, CELLS, SMOOTHING, ROUNDS, TOLERANCE, PENALTY = 3000, 1 << 14, 0.1, 200, 1e-3, 6.0
MOST_LANGUAGES = 400
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123], _LETTER[128:] = np.arange(97, 123), np.arange(128, 256)
_LETTER[65:91] = np.arange(97, 123)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of the text's grams; runs of anything but letters are one blank."""
    low = text if text.isascii() else text.lower()
    raw = _LETTER[np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)]
    raw = np.concatenate([[32], raw, [32]]).astype(np.uint32)
    raw = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))]
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    h = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA77)) ^ (raw[2:] * np.uint32(0xC2B2AE3D))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(18)
    n = np.bincount(h, minlength=CELLS)
    cells = np.flatnonzero(n)
    return cells, n[cells].astype(float)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if text else False


@dataclass
class Model:
    languages: list[str]
    likelihood: np.ndarray  # languages x CELLS

    def proportions(self, cells: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen languages' numbers and their proportions."""
        p = self.likelihood[:, cells]
        chosen = np.arange(len(p))
        share, best = _em(p, n)
        penalty = PENALTY * np.log(n.sum() + 1)
        while len(chosen) > 1:
            least = None
            for drop in np.argsort(share, kind="stable"):
                rest = np.delete(np.arange(len(chosen)), drop)
                fewer, log = _em(p[chosen[rest]], n, share[rest])
                if least is None or log > least[2]:
                    least = rest, fewer, log
                if best - log < 1e-3:  # costs nothing: no other language can cost less
                    break
            if best - least[2] > penalty:
                break
            chosen, share, best = chosen[least[0]], least[1], least[2]
        return chosen, share

    def predict(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        """The language, its proportion, the set of languages by falling proportion, their proportions."""
        if not self.languages or not text or not has_letter(text):
            return "und", 0.0, [], []
        cells, n = grams(text)
        if not len(cells):
            return "und", 0.0, [], []
        chosen, share = self.proportions(cells, n)
        order = np.argsort(-share, kind="stable")
        names, shares = [self.languages[k] for k in chosen[order]], share[order].tolist()
        return names[0], shares[0], names, shares


def _em(p: np.ndarray, n: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Proportions of the rows of p that make counts n likeliest, and the log likelihood."""
    if len(p) == 1:
        return np.ones(1), float(n @ np.log(p[0]))
    share = np.full(len(p), 1 / len(p)) if start is None or start.sum() <= 0 else start / start.sum()
    total = n.sum()
    for _ in range(ROUNDS):
        before, share = share, share * (p @ (n / (share @ p))) / total
        if np.abs(share - before).max() < TOLERANCE:
            break
    return share, float(n @ np.log(share @ p + 1e-300))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    """docs: doc_id, text, lang of the documents to learn from."""
    rows = docs.where("lang is not null and text is not null").withColumn("lang", F.col("lang").cast("string"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"lang has more than {most_languages} values")
    if not sizes:
        return Model([], np.zeros((0, CELLS)))
    part = F.create_map(*chain.from_iterable((F.lit(lang), F.lit(int(1_000_003 * min(1.0, per_language / n)) + 1)) for lang, n in sorted(sizes.items())))[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < part).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches):
            for lang, text in zip(part["lang"], part["text"]):
                cells, n = grams(text)
                sums.setdefault(lang, np.zeros(CELLS))[cells] += n
        for lang, s in sums.items():
            cells = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells)), pa.array(cells.astype(np.int32)), pa.array(s[cells])], ["lang", "cell", "n"])

    got = sample.mapInArrow(count, "lang string, cell int, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    counts = np.full((len(languages), CELLS), SMOOTHING)
    index = {x: i for i, x in enumerate(languages)}
    counts[got["lang"].map(index).to_numpy(int), got["cell"].to_numpy(int)] += got["n"].to_numpy()
    return Model(languages, counts / counts.sum(1, keepdims=True))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, shares; needs doc_id, text, held_out."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"
    types = [pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = list(zip(*map(model.predict, part["text"])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([part["doc_id"], part["held_out"], *got], types)], names)

    return docs.mapInArrow(run, schema)


def identify_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 4 is 2), lang_pred, score, and the languages found with their shares, for each document; held-out rows
    are not learned from."""
    held = (fold(4) == 2).alias("held_out")
    model = fit(docs.where(fold(4) != 2).select("doc_id", "text", "lang"), per_language)
    return identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held), model)
