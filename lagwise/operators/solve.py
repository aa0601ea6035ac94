"""Fitting: mass-univariate and time-expanded models, solvers, standard errors, cross-validation and robust fits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions import basis as bases
from lagwise.functions.basis import Basis
from lagwise.functions.formula import Schema
from lagwise.operators import blocks
from lagwise.operators.blocks import Packed
from lagwise.operators.design import Entry, entries, expanded_design, valid_samples
from lagwise.operators.epochs import drop_missing_epochs
from lagwise.operators.events import ANY, filter_events
from lagwise.session import written

#: Columns of a design whose cross product is solved on the driver: 5,000 make 200 MB. Wider designs are solved in rounds over the samples.
MOST_COLUMNS = 5000
#: The share of X'y that the solver cg may leave in X'(y - Xb).
LEFT = 1e-14
#: Events of one channel and time, or else different ones of them, that a robust fit takes into one task as plain numbers; more are fitted in rounds of
#: partial sums.
MOST_ROWS = 2_000_000


def solve(g: np.ndarray, r: np.ndarray, solver="default") -> np.ndarray:
    """Least squares from the cross products, whose columns are first scaled to length 1, so that no predictor's unit and no signal's matters; the default
    is cholesky, with the minimum-norm solution (of the scaled columns) where g is singular; intern is numpy's general solver. A callable gets (g, r) as
    they are. lsmr works on the design instead: see blocks."""
    if callable(solver):
        return solver(g, r)
    scale = 1 / np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1))[:, None]
    s, y = g * scale * scale.T, scale * r
    if solver == "intern":
        return scale * np.linalg.solve(s, y)
    if solver in ("default", "cholesky"):
        try:
            c = np.linalg.cholesky(s)
            if np.diag(c).min() > 1e-6:
                return scale * np.linalg.solve(c.T, np.linalg.solve(c, y))
        except np.linalg.LinAlgError:
            pass
    if solver in ("default", "cholesky", "pinv"):
        return scale * (np.linalg.pinv(s, hermitian=True, rcond=1e-10) @ y)
    if solver == "qr":
        q, t = np.linalg.qr(s)
        return scale * np.linalg.solve(t, q.T @ y)
    if solver == "cg":
        b, res = np.zeros_like(y), y.copy()
        d, old = res.copy(), (res * res).sum(0)
        first = old
        for _ in range(10 * len(g)):
            if (old <= LEFT**2 * first).all():
                break
            gd = s @ d
            bend = (d * gd).sum(0)
            step = np.where(bend > 0, old / np.where(bend > 0, bend, 1), 0)
            b, res = b + step * d, res - step * gd
            new = (res * res).sum(0)
            d, old = res + np.where(old > 0, new / np.where(old > 0, old, 1), 0) * d, new
        return scale * b
    raise ValueError(f"unknown solver {solver!r}")


@dataclass
class Model:
    """kind: deconvolution or mass-univariate. coefs: channel, time_ix, time, col_ix, event, coefname, basis_time, fold, estimate, stderror."""

    kind: str
    entries: list[Entry]
    coefs: DataFrame
    events: DataFrame
    latency: str = "latency"
    duration: str | None = None
    column: str = "event"
    info: dict = field(default_factory=dict)

    def meta(self) -> dict:
        def of(e: Entry) -> dict:
            b = {"class": type(e.basis).__name__, **{k: v for k, v in e.basis.__dict__.items()}} if e.basis else None
            return {"any": e.key is ANY, "key": None if e.key is ANY else e.key, "schema": e.schema.meta(), "basis": b, "times": e.times, "offset": e.offset}

        return {"kind": self.kind, "latency": self.latency, "duration": self.duration, "column": self.column, "info": self.info, "entries": [of(e) for e in self.entries]}

    @classmethod
    def of(cls, meta: dict, coefs: DataFrame, events: DataFrame) -> "Model":
        def entry(m: dict) -> Entry:
            b = dict(m["basis"]) if m["basis"] else None
            basis = getattr(bases, b.pop("class"))(**{k: tuple(v) if isinstance(v, list) else v for k, v in b.items()}) if b else None
            return Entry(ANY if m["any"] else m["key"], Schema(**m["schema"]), basis, m["times"], m["offset"])

        return cls(meta["kind"], [entry(m) for m in meta["entries"]], coefs, events, meta["latency"], meta["duration"], meta["column"], meta["info"])

    @property
    def times(self) -> list[float]:
        if self.kind == "mass-univariate":
            if any(e.times != self.entries[0].times for e in self.entries):
                raise ValueError("the events' times differ")
            return self.entries[0].times
        return list(max((e.basis.times for e in self.entries), key=len))

    @property
    def eventnames(self) -> list[str]:
        return [e.event for e in self.entries]

    def design_matrix(self, events: DataFrame | None = None) -> DataFrame:
        return expanded_design(self.entries, self.events if events is None else events, self.latency, self.duration, self.column)

    def columns(self) -> list[tuple]:
        """col_ix, event, coefname, number of the coefficient, number and value of the basis column, label."""
        out = []
        for e in self.entries:
            for p, name in enumerate(e.schema.names()):
                for c, t in enumerate(e.basis.colnames if e.basis else [None]):
                    out.append((e.offset + p * (e.basis.width if e.basis else 1) + c, e.event, name, p, c, t, e.basis.label if e.basis else "time"))
        return out

    def coefnames(self) -> list[str]:
        return [" : ".join(map(str, (e, n, t) if t is not None else (e, n))) for _, e, n, _, _, t, _ in self.columns()]

    def coeftable(self) -> DataFrame:
        """channel, coefname, eventname, time (or the basis's own label in label), estimate, stderror, group: one row for each coefficient."""
        c = self.coefs
        time = F.col("time") if self.kind == "mass-univariate" else F.col("basis_time")
        agg = [F.avg("estimate").alias("estimate"), F.avg("stderror").alias("stderror")]
        return c.groupBy("channel", "coefname", F.col("event").alias("eventname"), "label", time.alias("time")).agg(*agg).withColumn("group", F.lit(None).cast("string"))

    def describe(self) -> str:
        """The design in words: a line for each kind of event, one for each of its predictors, and what is known of the fit."""
        lines = [f"{self.kind} model, {sum(e.width for e in self.entries)} columns" + "".join(f", {k} {v}" for k, v in self.info.items() if k in ("solver", "channels", "folds"))]
        for e in self.entries:
            how = f"{type(e.basis).__name__} of {e.basis.width} columns, {e.basis.sfreq:g} samples a second" if e.basis else f"{len(e.times)} times from {e.times[0]:g} to {e.times[-1]:g}"
            lines.append(f"  {e.event}: {e.schema.formula}, {how}")
            for i, name in enumerate(e.schema.names()):
                first = e.offset + i * (e.basis.width if e.basis else 1)
                lines.append(f"    {name}: column {first}" + (f" to {first + e.basis.width - 1}" if e.basis and e.basis.width > 1 else ""))
            lines += [f"    {v}: {e.schema.contrasts[v] if isinstance(e.schema.contrasts[v], str) else 'own'} coding of {', '.join(map(str, levels))}" for v, levels in e.schema.levels.items()]
        return "\n".join(lines)

    def __repr__(self) -> str:
        return f"{self.kind} model of " + ", ".join(f"{e.event}: {e.schema.formula}" + (f" on {type(e.basis).__name__} of {e.basis.width}" if e.basis else f" at {len(e.times)} times") for e in self.entries)


_COEFS = "channel int, time_ix int, time double, col_ix int, event string, coefname string, coef_ix int, basis_ix int, basis_time double, label string, fold int, estimate double, stderror double"


def fit(design, events: DataFrame, data: DataFrame, *, solver="default", stderror: bool = False, contrasts: dict | None = None, latency: str = "latency", duration: str | None = None, column: str = "event", design_only: bool = False) -> Model:
    """A basis in each pair of the design makes a deconvolution of a signal (channel, sample, y); times make a mass-univariate fit of epochs.
    design_only: a model without coefficients, for its design."""
    if isinstance(design, tuple) and isinstance(design[0], str):
        design = [(ANY, design)]
    kinds = {isinstance(how, Basis) for _, (_, how) in (design.items() if isinstance(design, dict) else design)}
    if len(kinds) != 1:
        raise ValueError("a design has bases or times, not both")
    all_ = entries(design, events, contrasts, column)
    if design_only:
        return Model("deconvolution" if kinds == {True} else "mass-univariate", all_, None, events, latency, duration, column)
    if kinds == {True}:
        if "sample" not in data.columns:
            raise ValueError("a deconvolution needs a continuous signal")
        return _deconvolution(all_, events, data, solver, stderror, latency, duration, column)
    if "time_ix" not in data.columns:
        raise ValueError("a mass-univariate fit needs epochs")
    return _mass_univariate(all_, events, data, solver, stderror, latency, column)


def _narrow(p: int) -> None:
    if p > MOST_COLUMNS:
        raise ValueError(f"{p} columns; {MOST_COLUMNS} can be solved on the driver: use the solver lsmr")


def solved(x: DataFrame, signal: DataFrame | Packed, p: int, solver="default", stderror: bool = False) -> tuple[np.ndarray, np.ndarray | None, list[int]]:
    """Estimates (a column for each channel), with stderror the diagonal of the inverse of X'X, and the channels, for a design x: sample, col_ix, x, over the
    samples of the signal that no channel lacks. Wide designs are iterated over the samples, for the inverse too."""
    wide = p > MOST_COLUMNS
    if solver not in ("lsmr", "default"):
        _narrow(p)
    packed = signal if isinstance(signal, Packed) else blocks.pack(signal)
    if solver == "lsmr" or wide:
        return blocks.lsmr(x, packed, p), blocks.inverse_diagonal(x, packed, p) if stderror else None, packed.channels
    g, r = blocks.normal_equations(x, packed, p)
    return solve(g, r, solver), np.diag(solve(g, np.eye(p))) if stderror else None, packed.channels


def fit_series(design, events: DataFrame, signal: DataFrame, series: str, solver="default", contrasts: dict | None = None, latency: str = "latency", duration: str | None = None, column: str = "event") -> DataFrame:
    """A deconvolution of each series (subject, sensor; an integer column of events and signal), all in one job: series, channel, col_ix, coefname, estimate.

    The formulas' schemas are learned once, from all series. Blocks of samples are summed in parallel, whatever their series; what meets in one task are a
    series' sums, p x p and p x channels numbers, and there they are solved. Rows without a series are left out; a column that a series doesn't have is 0 there."""
    all_ = entries(design, events, contrasts, column)
    model = Model("deconvolution", all_, None, events, latency, duration, column)
    p, names = all_[-1].offset + all_[-1].width, model.coefnames()
    _narrow(p)
    packed = blocks.pack(signal.where(F.col(series).isNotNull()), series)
    x = expanded_design(all_, events.where(F.col(series).isNotNull()), latency, duration, column, series)
    out = blocks.solved_by_series(blocks.sums(x, p, packed, series), p, packed.width, lambda g, r: solve(g, r, solver))
    channels, labels = F.array(*map(F.lit, packed.channels)), F.array(*map(F.lit, names))
    return out.select(F.col("series").alias(series), F.get(channels, F.col("channel")).alias("channel"), "col_ix", F.get(labels, F.col("col_ix")).alias("coefname"), "estimate")


def fit_design(x: DataFrame, signal: DataFrame, names: list[str], solver="default") -> DataFrame:
    """channel, col_ix, coefname, estimate of a design that is given: sample, col_ix (from 0), x, and its columns' names."""
    b, _, channels = solved(x, signal, len(names), solver)
    rows = [(int(ch), j, n, float(b[j, i])) for i, ch in enumerate(channels) for j, n in enumerate(names)]
    return x.sparkSession.createDataFrame(rows, "channel int, col_ix int, coefname string, estimate double")


def _deconvolution(all_, events, signal, solver, stderror, latency, duration, column) -> Model:
    p = all_[-1].offset + all_[-1].width
    model = Model("deconvolution", all_, None, events, latency, duration, column)
    b, inverse, channels = solved(model.design_matrix(), signal, p, solver, stderror)
    spark = events.sparkSession

    def rows(se: np.ndarray | None) -> list[tuple]:
        out = []
        for i, ch in enumerate(channels):
            for ix, e, n, k, c, t, label in model.columns():
                out.append((int(ch), None, None, ix, e, n, k, c, None if t is None else float(t), label, None, float(b[ix, i]), None if se is None else float(se[ix, i])))
        return out

    model.info = {"solver": solver if isinstance(solver, str) else "custom", "columns": p, "channels": len(channels)}
    model.coefs = spark.createDataFrame(rows(None), _COEFS)
    if stderror:
        from lagwise.operators.predict import residuals

        left = residuals(model, signal).join(valid_samples(signal), "sample", "left_semi")
        var = {v["channel"]: v["v"] for v in left.groupBy("channel").agg(F.var_samp("residual").alias("v")).collect()}
        model.coefs = spark.createDataFrame(rows(np.sqrt(np.outer(inverse, [var[ch] for ch in channels]))), _COEFS)
    return model


def _sums(x: DataFrame, k: int, n: int) -> np.ndarray:
    """X'X of the array column x, for each of n folds."""
    first = x.select("fold", "x", F.posexplode("x").alias("i", "a"))
    pairs = first.select("fold", "i", "a", F.posexplode(F.slice("x", F.col("i") + 1, F.lit(k))).alias("d", "b"))
    g = np.zeros((n, k, k))
    for row in pairs.groupBy("fold", "i", (F.col("i") + F.col("d")).alias("j")).agg(F.sum(F.col("a") * F.col("b")).alias("g")).collect():
        g[row["fold"], row["i"], row["j"]] = g[row["fold"], row["j"], row["i"]] = row["g"]
    return g


def _times(rows: DataFrame, inverses: np.ndarray) -> DataFrame:
    """rows (channel, time_ix, time, fold, r) with b: the fold's inverse times r."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                fold, r = batch.column("fold").to_numpy(), np.array(batch.column("r").to_pylist())
                b = np.zeros_like(r)
                for f in np.unique(fold):
                    b[fold == f] = r[fold == f] @ inverses[f].T
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(b.tolist(), pa.list_(pa.float64()))], [*batch.schema.names[:4], "b"])

    return rows.select("channel", "time_ix", "time", "fold", "r").mapInArrow(run, "channel int, time_ix int, time double, fold int, b array<double>")


def _mass_univariate(all_, events, epochs, solver, stderror, latency, column, fold: DataFrame | None = None, n: int = 1, fit_test: bool = True) -> Model:
    """fold: event_ix, fold of n folds, each of which gets estimates from the other folds' events, or (fit_test) from its own; without it all events are of
    one fold. The epochs are read once, whatever the number of folds: sums of a fold's events are taken from the sums of all."""
    parts, full = [], drop_missing_epochs(epochs)
    n_times, n_channels = epochs.agg(F.count_distinct("time_ix"), F.count_distinct("channel")).first()
    for e in all_:
        if n_times != len(e.times):
            raise ValueError(f"{len(e.times)} times but epochs of {n_times}")
        design = e.schema.design(filter_events(events, e.key, column))
        design = design.join(fold, "event_ix") if fold is not None else design.withColumn("fold", F.lit(0))
        names, k = e.schema.names(), len(e.schema.names())
        g = _sums(design.join(full.select("event_ix").distinct(), "event_ix", "left_semi"), k, n)
        g = g if fit_test else g.sum(0) - g
        inverses = np.stack([solve(m, np.eye(k), solver) for m in g])
        joined = full.join(design, "event_ix").withColumn("channel", F.col("channel").cast("int")).withColumn("time_ix", F.col("time_ix").cast("int"))
        keys, r = ["channel", "time_ix", "time"], F.array(*[F.sum(F.get("x", F.lit(j)) * F.col("y")) for j in range(k)])
        sums = joined.groupBy(*keys, "fold").agg(r.alias("r"))
        if not fit_test:
            add = lambda a, b: F.zip_with(a, b, lambda u, v: u + v)
            own = sums.groupBy(*keys).agg(F.collect_list(F.struct("fold", "r")).alias("own"))
            others = lambda i: F.aggregate(F.filter("own", lambda s: s["fold"] != i), F.array_repeat(F.lit(0.0), k), lambda t, s: add(t, s["r"]))
            sums = own.select(*keys, "own", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("fold")).withColumn("r", others(F.col("fold")))
        wide = _times(sums, inverses)
        if stderror:
            # the residuals' variance, n - 1 as the denominator: each event with the estimates that it had a part in
            seen = joined.withColumnRenamed("fold", "own").join(wide, keys).where(F.col("fold") == F.col("own") if fit_test else F.col("fold") != F.col("own"))
            fitted = F.aggregate(F.zip_with("x", "b", lambda v, c: v * c), F.lit(0.0), lambda t, v: t + v)
            var = seen.groupBy("channel", "time_ix", "fold").agg(F.var_samp(F.col("y") - fitted).alias("v"))
            d = F.array(*[F.array(*map(F.lit, np.diag(solve(m, np.eye(k))).tolist())) for m in g])
            wide = wide.join(var, ["channel", "time_ix", "fold"]).withColumn("s", F.transform(F.get(d, F.col("fold")), lambda x: F.sqrt(x * F.col("v"))))
        else:
            wide = wide.withColumn("s", F.lit(None).cast("array<double>"))
        long = wide.select(*keys, "fold", F.posexplode("b").alias("coef_ix", "estimate"), "s")
        parts.append(long.select(
            *keys[:2], "time", (F.col("coef_ix") + e.offset).alias("col_ix"), F.lit(e.event).alias("event"), F.get(F.array(*map(F.lit, names)), F.col("coef_ix")).alias("coefname"), "coef_ix",
            F.lit(0).alias("basis_ix"), F.lit(None).cast("double").alias("basis_time"), F.lit("time").alias("label"), F.col("fold") if fold is not None else F.lit(None).cast("int").alias("fold"),
            "estimate", F.get("s", F.col("coef_ix")).alias("stderror"),
        ))
    info = {"solver": solver if isinstance(solver, str) else "custom", "columns": (all_[-1].offset + all_[-1].width) * n_times, "channels": n_channels}
    return Model("mass-univariate", all_, reduce(DataFrame.unionByName, parts), events, latency, None, column, info)


def folds(events: DataFrame, k: int, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """event_ix, fold (from 0): contiguous blocks in event order, or in the order of a seeded hash. Event numbers are counted in parallel ranges."""
    from lagwise.sources.signal import with_index

    if shuffle:
        ids = with_index(events.select(F.col("event_ix").alias("e"), F.xxhash64(F.lit(seed), "event_ix").alias("h")), "h", "e").select(F.col("e").alias("event_ix"), F.col("event_ix").alias("at"))
    else:
        ids = with_index(events.select(F.col("event_ix").alias("e")), "e").select(F.col("e").alias("event_ix"), F.col("event_ix").alias("at"))
    n = events.count()
    big, size = n % k, n // k
    # the first n % k blocks have one more
    at = F.col("at") - 1
    return ids.select("event_ix", F.when(at < big * (size + 1), F.floor(at / (size + 1))).otherwise(big + F.floor((at - big * (size + 1)) / max(1, size))).cast("int").alias("fold"))


def cross_validated(design, events: DataFrame, epochs: DataFrame, k: int = 5, shuffle: bool = True, seed: int = 0, fit_test: bool = False, **options) -> Model:
    """A mass-univariate model whose coefs have one estimate for each fold, from the other folds' events (or, with fit_test, from the fold's own). Formulas learn
    their levels and breaks from all events, so that all folds have the same columns."""
    if isinstance(design, tuple) and isinstance(design[0], str):
        design = [(ANY, design)]
    column, solver, stderror, latency = (options.pop(o, d) for o, d in (("column", "event"), ("solver", "default"), ("stderror", False), ("latency", "latency")))
    all_ = entries(design, events, options.pop("contrasts", None), column)
    if any(e.basis for e in all_) or options:
        raise ValueError(f"cross-validation is of mass-univariate models, without {sorted(options)}")
    model = _mass_univariate(all_, events, epochs, solver, stderror, latency, column, folds(events, k, shuffle, seed), k, fit_test)
    model.info["folds"] = k
    return model


def biweight(c: float = 4.685) -> Callable:
    """Tukey's weights: 0 beyond c scales."""
    return lambda u: np.where(np.abs(u) < c, (1 - (u / c) ** 2) ** 2, 0.0)


def huber(c: float = 1.345) -> Callable:
    """Huber's weights: 1 up to c scales, then as small as the residual is large."""
    return lambda u: np.minimum(1.0, c / np.maximum(np.abs(u), c))


def _median(v: np.ndarray, n: np.ndarray | None) -> float:
    """The median of v, whose values are there n times each."""
    if n is None:
        return np.median(v)
    order = np.argsort(v, kind="stable")
    ends, total = np.cumsum(n[order]), n.sum()
    low, high = np.searchsorted(ends, [(total - 1) // 2, total // 2], "right")
    return (v[order[low]] + v[order[high]]) / 2


def reweighted(x: np.ndarray, y: np.ndarray, weight: Callable, rounds: int = 50, n: np.ndarray | None = None) -> np.ndarray:
    """M-estimate by reweighted least squares; the scale is the median absolute deviation of the residuals. Tolerances are relative to the largest value.
    n: how many times each row is there, once if it isn't given."""
    root = np.ones(len(y)) if n is None else np.sqrt(n)
    b = np.linalg.lstsq(x * root[:, None], y * root, rcond=None)[0]
    size = np.abs(y).max(initial=0) or 1.0
    for _ in range(rounds):
        res = y - x @ b
        scale = max(_median(np.abs(res - _median(res, n)), n) / 0.6745, 1e-12 * size)
        w = np.sqrt(weight(res / scale)) * root
        new = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]
        done = np.abs(x @ (new - b)).max(initial=0) < 1e-12 * size
        b = new
        if done:
            break
    return b


def _medians(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, median: exact ones. An approximate percentile brackets the middle ranks; only the few values in the bracket are ordered."""
    rows = rows.select(*keys, value.alias("v"))
    near = rows.groupBy(*keys).agg(F.percentile_approx("v", [0.4997, 0.5003], 10_000).alias("q"), F.count("*").alias("n"))
    joined = rows.join(F.broadcast(near), keys)
    below = joined.groupBy(*keys).agg(F.count_if(F.col("v") < F.get("q", F.lit(0))).alias("below"))
    counts = joined.where((F.col("v") >= F.get("q", F.lit(0))) & (F.col("v") <= F.get("q", F.lit(1)))).groupBy(*keys, "n", "v").count().join(F.broadcast(below), keys)
    end = F.col("below") + F.sum("count").over(Window.partitionBy(*keys).orderBy("v"))
    at = counts.withColumn("end", end).withColumn("begin", F.col("end") - F.col("count"))
    pick = lambda rank: F.max(F.when((F.col("begin") <= rank) & (rank < F.col("end")), F.col("v")))
    return at.groupBy(*keys).agg(((pick(F.floor((F.col("n") - 1) / 2)) + pick(F.floor(F.col("n") / 2))) / 2).alias("median"))


def _rounds(rows: DataFrame, k: int, weight: Callable, rounds: int = 50) -> dict[tuple, np.ndarray]:
    """What reweighted gives for each (channel, time_ix), in rounds of partial sums; the driver gets k x k sums for each."""
    spark, keys = rows.sparkSession, ["channel", "time_ix"]
    weights = F.pandas_udf(lambda u: pd.Series(weight(u.to_numpy())), "double")
    x = [F.get("x", F.lit(i)) for i in range(k)]

    def solved(weighted: DataFrame) -> dict[tuple, tuple[np.ndarray, np.ndarray, float]]:
        """Estimates, X'WX and the largest value."""
        pairs = [(i, j) for i in range(k) for j in range(i + 1)]
        sums = weighted.groupBy(*keys).agg(*[F.sum(F.col("w") * x[i] * x[j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(F.col("w") * x[i] * F.col("y")).alias(f"r{i}") for i in range(k)], F.max(F.abs("y")).alias("size"))
        out = {}
        for row in sums.collect():
            g = np.zeros((k, k))
            for i, j in pairs:
                g[i, j] = g[j, i] = row[f"g{i}_{j}"]
            out[row["channel"], row["time_ix"]] = solve(g, np.array([[row[f"r{i}"]] for i in range(k)]))[:, 0], g, row["size"] or 1.0
        return out

    first, done = solved(rows.withColumn("w", F.lit(1.0))), set()
    beta, sizes = {key: b for key, (b, _, _) in first.items()}, {key: size for key, (_, _, size) in first.items()}
    for _ in range(rounds):
        now = [(*key, b.tolist()) for key, b in beta.items() if key not in done]
        if not now:
            break
        left = rows.join(F.broadcast(spark.createDataFrame(now, "channel int, time_ix int, b array<double>")), keys)
        left = left.withColumn("res", F.col("y") - sum((F.get("b", F.lit(i)) * x[i] for i in range(k)), F.lit(0.0)))
        here = spark.createDataFrame([tuple(r) for r in _medians(left, keys, F.col("res")).collect()], "channel int, time_ix int, middle double")
        mad = _medians(left.join(F.broadcast(here), keys), keys, F.abs(F.col("res") - F.col("middle"))).collect()
        scales = spark.createDataFrame([(r["channel"], r["time_ix"], max(r["median"] / 0.6745, 1e-12 * sizes[r["channel"], r["time_ix"]])) for r in mad], "channel int, time_ix int, scale double")
        for key, (new, _, _) in solved(left.join(F.broadcast(scales), keys).withColumn("w", weights(F.col("res") / F.col("scale")))).items():
            g = first[key][1]  # without weights, which may all be 0
            if max(0.0, (new - beta[key]) @ g @ (new - beta[key])) ** 0.5 < 1e-12 * sizes[key]:
                done.add(key)
            beta[key] = new
    return beta


def robust(formula: str, events: DataFrame, epochs: DataFrame, contrasts: dict | None = None, weight: Callable = biweight(), most_rows: int = MOST_ROWS) -> DataFrame:
    """channel, time_ix, coefname, estimate: an M-estimate for each channel and time over the events that have a value there.

    weight: biweight(), huber() or a function of one's own: residuals (an array, in units of their scale) to weights. Where no channel and time has more than
    most_rows events, each is a group of its task's. Else events of equal value and predictors become one row with their number; where no channel
    and time has more than most_rows of those, each is a task's group again. Else all are fitted in rounds of partial sums over all rows, with the same scale
    and the same end, so any weights work at any size."""
    schema = Schema.fit(formula, events, contrasts)
    names, keys = schema.names(), ["channel", "time_ix"]

    def one(key: tuple, part: pa.Table) -> pa.Table:
        values = lambda name: part.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        x = part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
        b = reweighted(x, values("y"), weight, n=values("n") if "n" in part.column_names else None)
        same = lambda i, kind: pa.array([key[i].as_py()] * len(names), kind)
        return pa.table([same(0, pa.int32()), same(1, pa.int32()), pa.array(names), pa.array(b, pa.float64())], ["channel", "time_ix", "coefname", "estimate"])

    rows = epochs.where("y is not null").join(schema.design(events), "event_ix").select("channel", F.col("time_ix").cast("int").alias("time_ix"), "y", "x")
    out = "channel int, time_ix int, coefname string, estimate double"
    largest = lambda df: df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest(rows) > most_rows:
        counted, _ = written(rows.groupBy(*keys, "y", "x").agg(F.count("*").alias("n")))
        if largest(counted) <= most_rows:
            return counted.groupBy(*keys).applyInArrow(one, out)
        rows = rows.withColumn("channel", F.col("channel").cast("int")).persist()
        try:
            beta = _rounds(rows, len(names), weight)
        finally:
            rows.unpersist()
        return rows.sparkSession.createDataFrame([(*key, name, float(v)) for key, b in beta.items() for name, v in zip(names, b)], out)
    return rows.groupBy(*keys).applyInArrow(one, out)
