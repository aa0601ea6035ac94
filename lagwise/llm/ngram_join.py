"""Similarity join on word shingles: MinHash bands propose, a Bayesian posterior prunes, exact Jaccard decides.

A text's shingles are the runs of five words (lower case, split at white space); a text of one to four words is one shingle, an empty or
null text has none. Two different texts are linked if their Jaccard similarity is at least the threshold; equal texts are always copies of
each other. Documents are grouped into the connected components of links and copies.

Nodes are distinct texts (by MD5), each with the number of its rows. MinHash bands propose nodes that share a bucket. A bucket of many
nodes, or of long ones, is cut into blocks of about BLOCK nodes and BLOCK_SHINGLES shingles at most; a unit is a pair of blocks, so that no task
holds more than two blocks at once. Inside a unit a pair counts only in the first band it shares. Pairs are compared a few MinHash values at a time, and dropped when the posterior probability (uniform prior)
of reaching the threshold is below the tolerance; the survivors are verified on all their shingles. Pairs stay inside the task: what leaves
it is each node's number of links and the edges of a spanning forest.

The candidates' texts are looked up through a filter of fixed size that rules most other texts out before the shuffle; the join behind it is
exact, at any number of candidates.

Null ids are kept; repeated rows are copies. Null and empty texts are copies of each other, as are texts of the same blanks. An empty table gives
no rows. Columns other than doc_id and text are not read; one_of_each gives all columns back, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.common import FILTER_BITS, TEXTS, among, slices, unused, written

WORDS, THRESHOLD, BANDS, ROWS, TOLERANCE, BLOCK, STEP = 5, 0.8, 25, 4, 1e-6, 400, 20
#: Shingles (8 bytes each, of texts of about as many bytes) in a block, on the average of its bucket; rounds in which components must be found.
BLOCK_SHINGLES, ROUNDS = 4_000_000, 200
_RNG = np.random.default_rng(20240101)
_MUL = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_POWER = np.array([pow(0x9E3779B97F4A7C15, i, 2**64) for i in range(WORDS)], dtype=np.uint64)


class _Hashes(dict):
    """Word to 64-bit hash, kept for words seen."""

    def __missing__(self, word: str) -> int:
        if len(self) > 50_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hash = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        return _mix(np.array([(h * _POWER[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64))
    n = len(h) - WORDS + 1
    s = np.zeros(n, np.uint64)
    for i in range(WORDS):
        s += h[i : i + n] * _POWER[i]
    return np.unique(_mix(s))


def minhash(s: np.ndarray) -> np.ndarray:
    """BANDS*ROWS values of 32 bits; s must not be empty."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):  # few at a time: stays in the cache, and bounded for long texts
        np.minimum(out, _mix_rows(s[at : at + 2048]), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _mix_rows(s: np.ndarray) -> np.ndarray:
    return (_MUL[:, None] * s[None, :] + _ADD[:, None]).min(1)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature (n x BANDS)."""
    x = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(x.shape[:2], np.uint64)
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x100000001B3) + x[:, :, r] + np.uint64(1))
    return key


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For 20, 40 ... values compared: the fewest matches at which the posterior probability of reaching the threshold is at least the tolerance.

    With a uniform prior the posterior is Beta(m+1, n-m+1); its tail above t is the binomial probability of at most m successes in n+1 trials."""
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def prune(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which of the pairs a[i], b[i] survive the incremental comparison."""
    alive, match = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, m in least.items():
        match[alive] += (sig[a[alive], n - STEP : n] == sig[b[alive], n - STEP : n]).sum(1, dtype=np.int32)
        alive = alive[match[alive] >= m]
    return alive


def candidate_pairs(band: int, low: int, high: int, block: np.ndarray, sig: np.ndarray, keys: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit that share no earlier band and survive pruning; across its two blocks, or within the one."""
    if low == high:
        a, b = np.triu_indices(len(block), 1)
    else:
        x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
        a, b = np.repeat(x, len(y)), np.tile(y, len(x))
    keep_a, keep_b = [], []
    for at in range(0, len(a), 200_000):
        p, q = a[at : at + 200_000], b[at : at + 200_000]
        for earlier in range(band):
            first = keys[p, earlier] != keys[q, earlier]
            p, q = p[first], q[first]
        k = prune(sig, p, q, least)
        keep_a.append(p[k])
        keep_b.append(q[k])
    return (np.concatenate(keep_a), np.concatenate(keep_b)) if keep_a else (a, b)


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[a[i]] and sets[b[i]]: by one product of incidence matrices where that is small, else pair by pair."""
    sizes = np.array([len(s) for s in sets])
    if len(a) > 64:
        vocabulary, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        if len(sets) * len(vocabulary) <= 12_000_000:
            x = np.zeros((len(sets), len(vocabulary)), np.float32)
            x[np.repeat(np.arange(len(sets)), sizes), inverse] = 1
            return (x @ x.T)[a, b].round().astype(np.int64)
    return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)


def _units(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = ("band", "key", "low", "high")) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows of one unit; the input is sorted by unit."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if not t.num_rows:
            continue
        cols = [np.asarray(t.column(n)) for n in names]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        begins = [0, *cut.tolist()]
        for x, y in zip(begins, begins[1:]):
            yield tuple(int(c[x]) for c in cols), t.slice(x, y - x)
        rest = t.slice(begins[-1])
    if rest is not None and rest.num_rows:
        yield tuple(int(rest.column(n)[0].as_py()) for n in names), rest


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


def _surviving(least: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, key, low, high), t in _units(batches):
            sig = _signatures(t.column("sig"))
            a, b = candidate_pairs(band, low, high, np.asarray(t.column("block")), sig, band_keys(sig), least)
            if len(a):
                used = np.unique(np.concatenate([a, b]))
                part = t.take(pa.array(used)).select(["band", "key", "low", "high", "block", "node", "n"])
                yield from part.combine_chunks().to_batches()

    return run


def _verified(least: dict[int, int], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, key, low, high), t in _units(batches):
            sets = [shingles(x) for x in t.column("text").to_pylist()]
            sig = np.array([minhash(s) for s in sets])
            a, b = candidate_pairs(band, low, high, np.asarray(t.column("block")), sig, band_keys(sig), least)
            both = overlaps(sets, a, b) if len(a) else np.zeros(0, np.int64)
            size = np.array([len(s) for s in sets])
            linked = both >= threshold * (size[a] + size[b] - both) - 1e-9
            a, b = a[linked], b[linked]
            if not len(a):
                continue
            n, weight = len(sets), np.asarray(t.column("n"))
            links = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
            root = np.arange(n)
            while True:  # the least member of each component within the unit
                new = root.copy()
                np.minimum.at(new, a, root[b])
                np.minimum.at(new, b, root[a])
                new = np.minimum(new, new[new])
                if (new == root).all():
                    break
                root = new
            used = np.flatnonzero(links)
            nodes = t.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(used)), nodes.take(pa.array(root[used])), pa.array(links[used].astype(np.int64))], ["node", "to", "links"])

    return run


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("node"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node, sig (null without shingles) and the number of shingles of each row; needs doc_id, node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingles(t) for t in part["text"]]
            sig = pa.array([minhash(s).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array(part["node"], pa.binary()), sig, pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "node", "sig", "shingles"])

    return docs.select("doc_id", "node", "text").mapInArrow(run, "doc_id long, node binary, sig binary, shingles long")


def links_between(rows: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, bits: int = FILTER_BITS) -> DataFrame:
    """node, to, links: for each unit and node, the least node it is joined to there and the rows it is linked to.

    rows: node, sig, shingles, n (distinct nodes with their number of rows); texts: node, text, one row or more for each node."""
    least = least_matches(threshold, tolerance)
    keys = written(_keys(rows))
    size = keys.groupBy("band", "key").agg(F.count("*").alias("size"), F.sum("shingles").alias("all")).where("size > 1")
    blocks = F.ceil(F.greatest(F.col("size") / F.lit(block), F.col("all") / F.lit(block_shingles))).cast("int")
    member = keys.drop("shingles").join(size.select("band", "key", F.least(blocks, F.col("size")).cast("int").alias("blocks")), ["band", "key"])
    member = member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(rows.select("node", "sig", "n"), "node")
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = ["band", "key", "low", "high"]
    member = member.select("band", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "n", "sig")
    kept = member.repartition(*[F.col(c) for c in unit]).sortWithinPartitions(*unit).mapInArrow(_surviving(least), "band int, key long, low int, high int, block int, node binary, n long")
    kept = written(kept)
    # copies are combined before the shuffle, so that a node of very many rows reaches its task as one row from each map task
    wanted = among(texts.select("node", "text"), kept.select("node"), "node", bits).groupBy("node").agg(F.first("text").alias("text"))
    full = kept.join(wanted, "node").select(*unit, "block", "node", "n", "text")
    return full.repartition(*[F.col(c) for c in unit]).sortWithinPartitions(*unit).mapInArrow(_verified(least, threshold), "node binary, to binary, links long")


def _keys(rows: DataFrame) -> DataFrame:
    """A row for each band of each node: band, key, node, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                k = band_keys(_signatures(b.column("sig"))).astype(np.int64)
                i = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
                bands = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows))
                yield pa.RecordBatch.from_arrays([bands, pa.array(k.ravel()), b.column("node").take(i), b.column("shingles").take(i)], ["band", "key", "node", "shingles"])

    return rows.select("node", "sig", "shingles").mapInArrow(run, "band int, key long, node binary, shingles long")


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, root: the least node of each connected component. edges: node, to. Alternates large-star and small-star steps, each written out, until
    nothing changes; the number of rounds grows with the logarithm of the largest component. An error if rounds are not enough."""
    edges = edges.where(F.col("node") != F.col("to")).select(F.greatest("node", "to").alias("u"), F.least("node", "to").alias("v")).distinct()
    edges, before = written(edges), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # what is joined is written first: a star's centre may have very many rows, and only a join of plain shuffles is split
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = written(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = now
    raise RuntimeError(f"the components were not found in {rounds} rounds")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, node (MD5 of the text), root (least node of the component), class_id (its least doc_id), copies (its rows), links (rows whose text is the same or linked)."""
    docs = _documents(docs)
    rows = written(signatures(docs), TEXTS)
    nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("shingles").alias("shingles"))
    nodes = written(nodes)
    found = written(links_between(nodes.where("sig is not null"), docs, threshold, tolerance), TEXTS)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select("node", "to"))
    each = nodes.select("node", "n").join(roots, "node", "left").join(links, "node", "left").select("node", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    # both are written before they are joined: only a join of plain shuffles is split where one node or class has very many rows
    member = written(rows.select("doc_id", "node").join(written(each), "node"))
    classes = written(member.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")))
    return member.join(classes, "root").select("doc_id", "node", "root", "class_id", "copies", "links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class stays, with all its columns: that of the least doc_id (null last), then of the least text hash.

    Texts without any word are copies of each other only if they are equal."""
    found = written(near_duplicates(docs, threshold).select("doc_id", "node", "root"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("node").alias("c"))).alias("first")).select("first.b", "first.c")
    repeated = found.groupBy("doc_id", "node").count().where("count > 1").select(F.col("doc_id").alias("b"), F.col("node").alias("c"))
    key = unused(docs, "text_md5")
    marked = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    same = lambda of: marked["doc_id"].cast("long").eqNullSafe(of["b"]) & (marked[key] == of["c"])
    marked = marked.join(first, same(first), "left_semi")
    single = marked.join(repeated, same(repeated), "left_anti")
    several = marked.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", key])
    return single.unionByName(several).select(docs.columns)
