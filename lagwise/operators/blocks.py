"""Least squares over blocks of samples: cross products of a design with itself and with a signal, and Golub-Kahan bidiagonalisation.

A block is BLOCK samples in a row of one series. A packed signal has a block's samples in one row, all channels of a sample side by side; a design's cells
are gathered by block. Tasks multiply block by block and keep sparse sums, which meet by ranges of columns, so no task and no driver adds what the samples
made; what reaches the driver are sums of p x p and p x channels numbers. A block's rows are at most BLOCK times the columns that overlap at a sample,
whatever the length of a series: a series that holds most of the samples is many blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.session import dropped, written

#: Samples in a block; sums (8 bytes each) that a task keeps before it passes them on; sums in a row; pairs of
#: cells multiplied at once; numbers gathered at once.
BLOCK, KEPT, ROW, PAIRS, GATHERED = 512, 4_000_000, 65_536, 2_000_000, 65_536
#: Kinds of sums: products of columns, of columns with channels, squares of the channels.
XX, XY, YY = 0, 1, 2
_SUMS = "series long, kind int, part long, keys array<long>, values array<double>"


@dataclass
class Packed:
    """A signal by blocks: series, block, at (array of places in the block), y (their values, channel after channel for each sample)."""

    rows: DataFrame
    channels: list

    @property
    def width(self) -> int:
        return len(self.channels)


def _block(sample: Column) -> Column:
    return F.floor((sample - 1) / BLOCK).cast("long")


def _series(df: DataFrame, series: str | None) -> Column:
    return F.col(series).cast("long") if series else F.lit(0).cast("long")


def _lists(flat: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, kind))


def _fill(width: int, complete: bool):
    """series, block, at, channel, y, sorted by series and block -> a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def row() -> pa.RecordBatch:
            gone = np.isnan(held)
            keep = np.flatnonzero(~gone.any(1) if complete else ~gone.all(1))
            y = np.nan_to_num(held[keep]) if not complete else held[keep]
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), _lists(keep.astype(np.int32), [len(keep)], pa.int32()), _lists(y.ravel(), [y.size], pa.float64())], ["series", "block", "at", "y"])

        for batch in batches:
            s, b, at, ch, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            cut = np.concatenate([[0], np.flatnonzero((np.diff(s) != 0) | (np.diff(b) != 0)) + 1, [len(s)]]) if len(s) else [0]
            for i, j in zip(cut[:-1], cut[1:]):
                if (s[i], b[i]) != now:
                    if now is not None:
                        yield row()
                    now, held = (s[i], b[i]), np.full((BLOCK, width), np.nan)
                held[at[i:j], ch[i:j]] = y[i:j]
        if now is not None:
            yield row()

    return run


def pack(signal: DataFrame, series: str | None = None, complete: bool = True) -> Packed:
    """A long signal (channel, sample, y) by blocks. complete: without the samples that some channel lacks (null or no row); else what is lacking is 0."""
    channels = [r["channel"] for r in signal.select("channel").distinct().orderBy("channel").collect()]
    number = F.array_position(F.array(*map(F.lit, channels)), F.col("channel")) - 1 if len(channels) > 1 else F.lit(0)
    rows = signal.where("channel is not null").select(_series(signal, series).alias("series"), _block(F.col("sample")).alias("block"), ((F.col("sample") - 1) % BLOCK).cast("int").alias("at"), number.cast("int").alias("channel"), F.col("y").cast("double").alias("y"))
    dealt = rows.repartition("series", "block").sortWithinPartitions("series", "block")
    return Packed(dealt.mapInArrow(_fill(len(channels), complete), "series long, block long, at array<int>, y array<double>"), channels)


def by_block(x: DataFrame, series: str | None = None) -> DataFrame:
    """A design (sample, col_ix, x) by blocks: series, block, r (places in the block), c (columns), v (values), in the order of places and columns."""
    cell = F.struct(((F.col("sample") - 1) % BLOCK).cast("int").alias("r"), F.col("col_ix").cast("int").alias("c"), F.col("x").cast("double").alias("v"))
    rows = x.groupBy(_series(x, series).alias("series"), _block(F.col("sample")).alias("block")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    return rows.select("series", "block", F.col("cells.r").alias("r"), F.col("cells.c").alias("c"), F.col("cells.v").alias("v"))


class Sums:
    """Sparse sums of rows of numbers by (series, kind, key); passed on by add when many are kept."""

    def __init__(self):
        self.held: dict[tuple, list] = {}
        self.size = 0

    def put(self, series: int, kind: int, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: distinct ones; values: a row for each."""
        if len(keys):
            self.held.setdefault((series, kind), []).append((keys, values.reshape(len(keys), -1)))
            self.size += values.size

    def merge(self) -> None:
        self.size = 0
        for name, some in self.held.items():
            if len(some) > 1:
                keys, values = np.concatenate([k for k, _ in some]), np.concatenate([v for _, v in some])
                order = np.argsort(keys, kind="stable")
                first = np.flatnonzero(np.diff(keys[order], prepend=-1))
                self.held[name] = [(keys[order][first], np.add.reduceat(values[order], first))]
            self.size += self.held[name][0][1].size

    def full(self) -> bool:
        if self.size > KEPT:
            self.merge()
            return self.size > KEPT / 2
        return False

    def rows(self, widths: dict[int, int]) -> Iterator[pa.RecordBatch]:
        """All that is kept, in ranges of keys."""
        self.merge()
        for (series, kind), [(keys, values)] in self.held.items():
            part = keys // max(1, ROW // widths[kind])
            cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            for i, j in zip(cut[:-1], cut[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([series], pa.int64()), pa.array([kind], pa.int32()), pa.array([part[i]], pa.int64()), _lists(keys[i:j], [j - i], pa.int64()), _lists(values[i:j].ravel(), [values[i:j].size], pa.float64())], ["series", "kind", "part", "keys", "values"])
        self.held, self.size = {}, 0


def _numpy(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """The arrays of a column of lists."""
    column = batch.column(name)
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _pairs(r: np.ndarray, c: np.ndarray, v: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of the cells of a sample, by i * p + j for columns i <= j. r is sorted, and c for each r."""
    n = np.arange(len(r))
    begin = np.flatnonzero(np.diff(r, prepend=-1))
    size = np.diff(np.append(begin, len(r)))
    if (size * (size + 1) // 2).sum() > PAIRS:  # samples with many cells: a dense product, or one half of the block after the other
        columns = np.unique(c)
        if 4 * len(r) > len(begin) * len(columns):
            dense = np.zeros((len(begin), len(columns)))
            dense[np.repeat(np.arange(len(begin)), size), np.searchsorted(columns, c)] = v
            there = (dense != 0).astype(np.float32)
            i, j = np.nonzero(np.triu(there.T @ there))
            return columns[i].astype(np.int64) * p + columns[j], (dense.T @ dense)[i, j]
        if len(begin) > 1:
            at, both = begin[len(begin) // 2], Sums()
            both.put(0, XX, *_pairs(r[:at], c[:at], v[:at], p))
            both.put(0, XX, *_pairs(r[at:], c[at:], v[at:], p))
            both.merge()
            keys, values = both.held[0, XX][0]
            return keys, values[:, 0]
    many = np.repeat(begin + size, size) - n  # a cell's partners: itself and those after it
    a = np.repeat(n, many)
    b = a + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
    keys, where = np.unique(c[a].astype(np.int64) * p + c[b], return_inverse=True)
    return keys, np.bincount(where, v[a] * v[b], len(keys))


def _products(c: np.ndarray, v: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the cells times their samples' rows r of y, by column; so many cells at a time that what is gathered stays in a core's cache."""
    if not len(c):
        return c.astype(np.int64), np.zeros((0, y.shape[1]))
    order = np.argsort(c, kind="stable")
    c, v, r = c[order], v[order, None], r[order]
    first = np.flatnonzero(np.diff(c, prepend=-1))
    out = np.empty((len(first), y.shape[1]))
    ends = np.append(first, len(c))
    i, many = 0, max(1, GATHERED // y.shape[1])
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + many, "right")) - 1)
        z = y[r[ends[i] : ends[j]]]
        z *= v[ends[i] : ends[j]]
        out[i:j] = np.add.reduceat(z, first[i:j] - ends[i])
        i = j
    return c[first].astype(np.int64), out


def _multiply(p: int, width: int, xx: bool, xy: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, widths = Sums(), {XX: 1, XY: width}
        for batch in batches:
            cells = zip(batch.column("series").to_numpy(), *(_numpy(batch, k) for k in "rcv"))
            signal = zip(_numpy(batch, "at"), _numpy(batch, "y")) if "at" in batch.schema.names else iter(lambda: (None, None), 0)
            for (series, r, c, v), (at, y) in zip(cells, signal):
                if at is not None:
                    place = np.full(BLOCK, -1)
                    place[at] = np.arange(len(at))
                    keep = place[r] >= 0
                    r, c, v = r[keep], c[keep], v[keep]
                if xx:
                    sums.put(series, XX, *_pairs(r, c, v, p))
                if xy:
                    sums.put(series, XY, *_products(c, v, y.reshape(len(at), width), place[r]))
                if sums.full():
                    yield from sums.rows(widths)
        yield from sums.rows(widths)

    return run


def added(sums: DataFrame, widths: dict[int, int]) -> DataFrame:
    """Rows of sums, those of equal ranges of keys added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Sums()
        for batch in batches:
            for series, kind, part, keys, values in zip(*(batch.column(k).to_pylist() for k in ("series", "kind", "part")), _numpy(batch, "keys"), _numpy(batch, "values")):
                if (series, kind, part) != now:
                    yield from held.rows(widths)
                    now = series, kind, part
                held.put(series, kind, keys, values)
                held.full()
        yield from held.rows(widths)

    return sums.repartition("series", "kind", "part").sortWithinPartitions("series", "kind", "part").mapInArrow(run, _SUMS)


def sums(x: DataFrame, p: int, signal: Packed | None = None, series: str | None = None, xx: bool = True, xy: bool = True) -> DataFrame:
    """Sums of products (series, kind, part, keys, values) of a design's columns with each other (key: i * p + j, i <= j) and with a signal's channels (key: the
    column; a value for each channel), over the signal's samples, or without a signal over all."""
    cells, width = by_block(x, series), signal.width if signal else 1
    joined = cells.join(signal.rows, ["series", "block"]) if signal else cells
    return added(joined.mapInArrow(_multiply(p, width, xx, xy and signal is not None), _SUMS), {XX: 1, XY: width})


def gathered(rows: DataFrame, p: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X'X (or an empty array where there are no sums of it), X'y and the channels' squares, on the driver."""
    t = rows.toArrow()
    g, r, squares = None, np.zeros((p, width)), np.zeros(width)
    if t.num_rows:
        for batch in t.combine_chunks().to_batches():
            for kind, keys, values in zip(batch.column("kind").to_pylist(), _numpy(batch, "keys"), _numpy(batch, "values")):
                if kind == XX:
                    g = np.zeros((p, p)) if g is None else g
                    i, j = keys // p, keys % p
                    g[i, j] = g[j, i] = values
                elif kind == XY:
                    r[keys] = values.reshape(len(keys), -1)
                else:
                    squares[:] = values
    return np.zeros((0, 0)) if g is None else g, r, squares


def normal_equations(x: DataFrame, signal: Packed, p: int) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y (a column for each channel) in one pass over the packed signal."""
    g, r, _ = gathered(sums(x, p, signal), p, signal.width)
    return (g if len(g) else np.zeros((p, p))), r


# Golub-Kahan bidiagonalisation


def _turn(p: int, width: int, v, step: np.ndarray | None):
    """Blocks with a left vector y (n x width) -> the blocks with y - and instead A v - step * y where v is given -, and the sums A'y, its squares, and without v
    the squares of the columns."""
    widths = {XX: 1, XY: width, YY: width}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, empty = Sums(), [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))]
        names = ["block", "r", "c", "v", "y", "series", "kind", "part", "keys", "values"]
        blank = [pa.nulls(1, t) for t in (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))]
        for batch in batches:
            packed = _numpy(batch, "at") if "at" in batch.schema.names else None
            for i, (block, r, c, x, y) in enumerate(zip(batch.column("block").to_pylist(), *(_numpy(batch, k) for k in "rcvy"))):
                left = y.reshape(-1, width)
                if packed is not None:  # the first turn: places among the block's samples in the signal
                    place = np.full(BLOCK, -1)
                    place[packed[i]] = np.arange(len(packed[i]))
                    keep = place[r] >= 0
                    r, c, x = place[r][keep].astype(np.int32), c[keep], x[keep]
                    sums.put(0, XX, *_products(c, x * x, np.ones((1, 1)), np.zeros(len(c), np.int64)))
                if v is not None:
                    fitted = np.zeros_like(left)
                    if len(r):
                        first = np.flatnonzero(np.diff(r, prepend=-1))
                        fitted[r[first]] = np.add.reduceat(x[:, None] * v.value[c], first)
                    left = fitted - step * left
                sums.put(0, XY, *_products(c, x, left, r))
                sums.put(0, YY, np.zeros(1, np.int64), (left * left).sum(0))
                if sums.full():
                    sums.merge()
                out = [pa.array([block], pa.int64()), _lists(r, [len(r)], pa.int32()), _lists(c, [len(c)], pa.int32()), _lists(x, [len(x)], pa.float64()), _lists(left.ravel(), [left.size], pa.float64())]
                yield pa.RecordBatch.from_arrays([*out, *empty], names)
        for b in sums.rows(widths):
            yield pa.RecordBatch.from_arrays([*blank, *b.columns], names)

    return run


_STATE = "block long, r array<int>, c array<int>, v array<double>, y array<double>"


def _ortho(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation that makes (a, b) into (h, 0): its cosine, sine, and h."""
    h = np.hypot(a, b)
    safe = np.where(h > 0, h, 1)
    return np.where(h > 0, a / safe, 1.0), b / safe, h


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.where(b != 0, b, 1) * (b != 0)


class Bidiagonal:
    """Least squares by LSMR for all channels at once (Fong and Saunders 2011): what the driver keeps, vectors of p x channels and some numbers a channel.

    A channel has its answer when its residual is as small as btol and atol allow (an exact fit), when the residual is orthogonal to the columns up to atol, or
    when the condition's estimate is over the limit; it doesn't change any more then. again: directions that new ones are made orthogonal to once more."""

    def __init__(self, atol: float, btol: float, condition: float, again: int):
        self.atol, self.btol, self.limit, self.again = atol, btol, condition, again

    def begin(self, t: np.ndarray, squares: np.ndarray) -> None:
        """t: A'y, squares: of y."""
        self.beta = np.sqrt(squares)
        self.v = _over(t, self.beta)
        self.alpha = np.sqrt((self.v**2).sum(0))
        self.v = _over(self.v, self.alpha)
        one, zero = np.ones_like(self.beta), np.zeros_like(self.beta)
        self.size = self.beta.copy()
        self.zeta_bar, self.alpha_bar, self.rho, self.rho_bar, self.c_bar, self.s_bar = self.alpha * self.beta, self.alpha.copy(), one, one.copy(), one.copy(), zero
        self.h, self.h_bar, self.x = self.v.copy(), np.zeros_like(self.v), np.zeros_like(self.v)
        self.b_dd, self.b_d, self.rho_d, self.tau, self.theta, self.zeta = self.beta.copy(), zero.copy(), one.copy(), zero.copy(), zero.copy(), zero.copy()
        self.norm2, self.most, self.least = self.alpha**2, zero.copy(), np.full_like(zero, np.inf)
        self.done = self.alpha * self.beta == 0
        self.past, self.first = [self.v], True

    def step(self, t: np.ndarray, squares: np.ndarray) -> None:
        """t: A'(Av - alpha u), squares: of Av - alpha u."""
        self.beta = np.sqrt(squares)
        v = _over(t, self.beta) - self.beta * self.v
        for w in self.past[-self.again :] if self.again else []:
            v -= (v * w).sum(0) * w
        self.alpha = np.sqrt((v**2).sum(0))
        self.v = _over(v, self.alpha)
        if self.again:
            self.past = [*self.past[-self.again + 1 :], self.v] if self.again > 1 else [self.v]
        rho_old, rho_bar_old, zeta_old, theta_old = self.rho, self.rho_bar, self.zeta, self.theta
        c, s, self.rho = _ortho(self.alpha_bar, self.beta)
        theta_new, self.alpha_bar = s * self.alpha, c * self.alpha
        theta_bar = self.s_bar * self.rho
        before = self.c_bar * self.rho
        self.c_bar, self.s_bar, self.rho_bar = _ortho(before, theta_new)
        self.zeta, self.zeta_bar = self.c_bar * self.zeta_bar, -self.s_bar * self.zeta_bar
        self.h_bar = self.h - _over(theta_bar * self.rho, rho_old * rho_bar_old) * self.h_bar
        self.x = np.where(self.done, self.x, self.x + _over(self.zeta, self.rho * self.rho_bar) * self.h_bar)
        self.h = self.v - _over(theta_new, self.rho) * self.h
        b_hat, self.b_dd = c * self.b_dd, -s * self.b_dd
        c_t, s_t, rho_t = _ortho(self.rho_d, theta_bar)
        self.theta, self.rho_d = s_t * self.rho_bar, c_t * self.rho_bar
        self.b_d = -s_t * self.b_d + c_t * b_hat
        self.tau = _over(zeta_old - theta_old * self.tau, rho_t)
        tau_d = _over(self.zeta - self.theta * self.tau, self.rho_d)
        left = np.sqrt((self.b_d - tau_d) ** 2 + self.b_dd**2)
        self.norm2 = self.norm2 + self.beta**2
        norm = np.sqrt(self.norm2)
        self.norm2 = self.norm2 + self.alpha**2
        self.most = np.maximum(self.most, rho_bar_old)
        self.least = np.minimum(self.least, np.where(self.first, np.inf, rho_bar_old))
        self.first = False
        condition = np.maximum(self.most, before) / np.maximum(np.minimum(self.least, np.abs(before)), np.finfo(float).tiny)
        orthogonal = np.abs(self.zeta_bar) <= self.atol * norm * left
        exact = left <= self.btol * self.size + self.atol * norm * np.sqrt((self.x**2).sum(0))
        self.done = self.done | orthogonal | exact | (condition >= self.limit) | (self.alpha == 0)


def lsmr(x: DataFrame, signal: Packed, p: int, atol: float = 1e-12, btol: float = 1e-12, condition: float = 1e12, rounds: int = 2000, again: int = 32, held: int = 1 << 23) -> np.ndarray:
    """Least squares on Xb = y itself (not on its cross products, whose condition is squared), minimum-norm where columns depend on each other: estimates, a
    column for each channel. Columns are scaled to length 1. The left vectors stay with their samples, in a table that each round writes anew (and drops the one
    before); a round is one pass over it. The driver and each task hold p x channels numbers: more than `held` of them are solved in groups of channels.
    An error if the rounds are not enough."""
    many = max(1, held // max(1, p))
    if signal.width > many:
        took = [lsmr(x, _channels(signal, i, many), p, atol, btol, condition, rounds, again, held) for i in range(0, signal.width, many)]
        return np.concatenate(took, axis=1)
    spark, width = x.sparkSession, signal.width
    widths = {XX: 1, XY: width, YY: width}
    out = f"{_STATE}, {_SUMS}"
    joined = by_block(x).join(signal.rows, ["series", "block"]).select("block", "r", "c", "v", "at", "y")

    def made(df: DataFrame) -> tuple[DataFrame, str, np.ndarray, np.ndarray, dict]:
        table, path = written(df)
        got = added(table.where("kind is not null").select(*[c.split()[0] for c in _SUMS.split(", ")]), widths).toArrow()
        t, squares, columns = np.zeros((p, width)), np.zeros(width), np.zeros(p)
        if got.num_rows:
            for batch in got.combine_chunks().to_batches():
                for kind, keys, values in zip(batch.column("kind").to_pylist(), _numpy(batch, "keys"), _numpy(batch, "values")):
                    if kind == XX:
                        columns[keys] = values
                    elif kind == XY:
                        t[keys] = values.reshape(len(keys), -1)
                    else:
                        squares[:] = values
        return table.where("block is not null").select("block", "r", "c", "v", "y"), path, t, squares, columns

    state, path, t, squares, columns = made(joined.mapInArrow(_turn(p, width, None, None), out))
    scale = np.where(columns > 0, 1 / np.sqrt(np.where(columns > 0, columns, 1)), 0)[:, None]
    run = Bidiagonal(atol, btol, condition, min(again, p))
    run.begin(scale * t, squares)
    try:
        for _ in range(rounds):
            if run.done.all():
                return scale * run.x
            sent = spark.sparkContext.broadcast(scale * run.v)
            # u = left / beta: A v - alpha u
            state, new, t, squares, _ = made(state.mapInArrow(_turn(p, width, sent, _over(run.alpha, run.beta)), out))
            sent.unpersist()
            dropped(spark, path)
            path = new
            run.step(scale * t, squares)
        if run.done.all():
            return scale * run.x
        raise RuntimeError(f"the solver did not converge in {rounds} rounds")
    finally:
        dropped(spark, path)


def inverse_diagonal(x: DataFrame, signal: Packed, p: int, left: float = 1e-11, rounds: int = 5000, held: int = 1 << 22) -> np.ndarray:
    """The diagonal of the inverse of X'X, which isn't made: unit right-hand sides, as many at once as p x their number stays within `held`, are solved by
    conjugate gradients (columns scaled to length 1) in passes over the design's blocks, which are written once. An error where the rounds are not enough, as
    for columns that depend on each other."""
    spark, many = x.sparkSession, max(1, min(p, held // max(1, p)))
    joined = by_block(x).join(signal.rows.select("series", "block", "at"), ["series", "block"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, c, v, at in zip(*(_numpy(batch, k) for k in ("r", "c", "v", "at"))):
                keep = np.isin(r, at)
                yield pa.RecordBatch.from_arrays([_lists(a[keep], [int(keep.sum())], t) for a, t in ((r, pa.int32()), (c, pa.int32()), (v, pa.float64()))], ["r", "c", "v"])

    cells, path = written(joined.mapInArrow(kept, "r array<int>, c array<int>, v array<double>"))

    def times(b: np.ndarray | None) -> np.ndarray:
        """X'Xb; without b the squares of the columns."""
        sent, width = spark.sparkContext.broadcast(b), 1 if b is None else b.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums()
            for batch in batches:
                for r, c, v in zip(*(_numpy(batch, k) for k in "rcv")):
                    if sent.value is None:
                        sums.put(0, XY, *_products(c, v * v, np.ones((1, 1)), np.zeros(len(c), np.int64)))
                    elif len(r):
                        first = np.flatnonzero(np.diff(r, prepend=-1))
                        fitted = np.add.reduceat(v[:, None] * sent.value[c], first)
                        sums.put(0, XY, *_products(c, v, fitted, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(r))))))
                    if sums.full():
                        sums.merge()
            yield from sums.rows({XY: width})

        out = gathered(added(cells.mapInArrow(run, _SUMS), {XY: width}), p, width)[1]
        sent.destroy()
        return out

    try:
        squares = times(None)
        if (squares == 0).any():
            raise ValueError("a column is empty: the inverse doesn't exist")
        scale, out = 1 / np.sqrt(squares), np.zeros(p)
        for i in range(0, p, many):
            res = np.zeros((p, min(many, p - i)))
            res[np.arange(i, i + res.shape[1]), np.arange(res.shape[1])] = 1
            b, d, old = np.zeros_like(res), res.copy(), np.ones(res.shape[1])
            for _ in range(rounds):
                gd = scale * times(scale * d)
                step = _over(old, (d * gd).sum(0))
                b, res = b + step * d, res - step * gd
                new = (res * res).sum(0)
                if (new <= left**2).all():
                    break
                d, old = res + _over(new, old) * d, new
            else:
                raise RuntimeError(f"the inverse did not converge in {rounds} rounds")
            j = np.arange(res.shape[1])
            out[i : i + len(j)] = b[i + j, j] * scale[i + j, 0] ** 2
        return out
    finally:
        dropped(spark, path)


def _channels(signal: Packed, first: int, many: int) -> Packed:
    """Some of the channels."""
    kept = signal.channels[first : first + many]
    rows = signal.rows.withColumn("y", F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - 1), lambda i: F.slice("y", i * signal.width + first + 1, len(kept)))))
    return Packed(rows.where(F.size("at") > 0), kept)


# Many series at once


def solved_by_series(rows: DataFrame, p: int, width: int, solve: Callable) -> DataFrame:
    """series, col_ix, channel (its number), estimate: each series' sums (p x p and p x width numbers) meet in one task and are solved there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, g, r = None, None, None

        def out() -> pa.RecordBatch:
            b = solve(g, r)
            at, ch = np.divmod(np.arange(b.size), width)
            return pa.RecordBatch.from_arrays([pa.array(np.full(b.size, now), pa.int64()), pa.array(at, pa.int32()), pa.array(ch, pa.int32()), pa.array(b.ravel(), pa.float64())], ["series", "col_ix", "channel", "estimate"])

        for batch in batches:
            for series, kind, keys, values in zip(batch.column("series").to_pylist(), batch.column("kind").to_pylist(), _numpy(batch, "keys"), _numpy(batch, "values")):
                if series != now:
                    if now is not None:
                        yield out()
                    now, g, r = series, np.zeros((p, p)), np.zeros((p, width))
                if kind == XX:
                    i, j = keys // p, keys % p
                    g[i, j] = g[j, i] = values
                else:
                    r[keys] = values.reshape(len(keys), -1)
        if now is not None:
            yield out()

    return rows.repartition("series").sortWithinPartitions("series").mapInArrow(run, "series long, col_ix int, channel int, estimate double")
