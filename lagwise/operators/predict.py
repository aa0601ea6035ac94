"""Predictions, residuals, explained variance, and marginal effects of fitted models."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.operators.design import non_zero_rows, time_expand
from lagwise.operators.epochs import epoch
from lagwise.operators.events import ANY, filter_events
from lagwise.operators.solve import Model


#: Coefficients (columns times channels) that are broadcast.
MOST_COEFFICIENTS = 1_000_000


def _mean(model: Model) -> DataFrame:
    """Coefficients, averaged over folds where there are any; a few rows for each column of the design."""
    return model.coefs.groupBy("channel", "time_ix", "time", "col_ix", "coef_ix", "basis_ix").agg(F.avg("estimate").alias("b"))


def predict(model: Model, events: DataFrame | None = None, overlap: bool | None = None, keep: list[str] | None = None, exclude: list[str] | None = None, epoch_to=None, window: tuple[float, float] | None = None) -> DataFrame:
    """Fitted values. With overlap (the default without new events) a deconvolution gives channel, sample, yhat; keep or exclude choose kinds of events,
    epoch_to cuts the result around events of that kind. Without overlap each event is alone: event_ix, channel, time_ix, time, yhat."""
    overlap = (events is None) if overlap is None else overlap
    own = model.events if events is None else events
    if keep and exclude:
        raise ValueError("keep and exclude exclude each other")
    if model.kind == "mass-univariate":
        if keep or exclude or epoch_to is not None:
            raise ValueError("a mass-univariate model has no overlap to choose from")
        return _alone_univariate(model, own)
    if not overlap:
        return _alone(model, own)
    if unknown := {*(keep or []), *(exclude or [])} - set(model.eventnames):
        raise ValueError(f"the model has no events {sorted(unknown)}; it has {model.eventnames}")
    chosen = [e for e in model.entries if (not keep or e.event in keep) and (not exclude or e.event not in exclude)]
    if (keep or exclude) and len(model.entries) < 2:
        raise ValueError("only a model of several events has some to choose")
    if not chosen:
        raise ValueError("all of the model's events are excluded")
    x = reduce(DataFrame.unionByName, [time_expand(e, own, model.latency, model.duration, model.column) for e in chosen])
    beta = _mean(model).select("channel", "col_ix", "b")
    yhat = x.join(_small(beta, model), "col_ix").groupBy("channel", "sample").agg(F.sum(F.col("x") * F.col("b")).alias("yhat"))
    if epoch_to is None:
        return yhat
    return _cut(model, yhat, own, epoch_to, window)


def _small(beta: DataFrame, model: Model) -> DataFrame:
    """Coefficients as a broadcast where the model is known to have at most MOST_COEFFICIENTS of them, else as they are."""
    return F.broadcast(beta) if 0 < model.info.get("columns", 0) * model.info.get("channels", 0) <= MOST_COEFFICIENTS else beta


def _cut(model: Model, signal: DataFrame, events: DataFrame, epoch_to, window: tuple[float, float] | None) -> DataFrame:
    """channel, sample and a value, cut around events of one kind or more; the window is the kind's kernel's where none is given."""
    kinds = epoch_to if isinstance(epoch_to, (list, tuple)) else [epoch_to]
    around = events if epoch_to is ANY else events.where(F.col(model.column).isin(*kinds))
    basis = next(e.basis for e in model.entries if e.event in map(str, kinds) or epoch_to is ANY)
    window = window or (basis.times[0], basis.times[-1])
    value = next(c for c in signal.columns if c not in ("channel", "sample"))
    out = epoch(signal.withColumnRenamed(value, "y"), around.withColumn(model.latency, F.floor(model.latency)), window, basis.sfreq, model.latency)
    return out.withColumnRenamed("y", value)


def _alone_univariate(model: Model, events: DataFrame) -> DataFrame:
    parts, beta = [], _mean(model)
    for e in model.entries:
        k = len(e.schema.names())
        b = beta.where(F.col("col_ix").between(e.offset, e.offset + k - 1)).groupBy("channel", "time_ix", "time").agg(F.array_sort(F.collect_list(F.struct("coef_ix", "b"))).alias("b"))
        x = e.schema.design(filter_events(events, e.key, model.column, check=False))
        yhat = F.aggregate(F.zip_with("x", "b", lambda v, c: v * c["b"]), F.lit(0.0), lambda s, v: s + v)
        parts.append(x.join(_small(b, model)).select("event_ix", F.lit(e.event).alias("eventname"), "channel", "time_ix", "time", yhat.alias("yhat")))  # a row for each channel and time
    return reduce(DataFrame.unionByName, parts)


def _alone(model: Model, events: DataFrame) -> DataFrame:
    """Each event placed so that its window begins at sample 1; events of narrower kernels have no rows beyond them; null where a spline is out of range."""
    parts, beta = [], _mean(model).select("channel", "col_ix", "b")
    for e in model.entries:
        own = filter_events(events, e.key, model.column, check=False).withColumn(model.latency, F.lit(float(1 - e.basis.shift)))
        out = e.schema.design(own).where("x is null").select("event_ix")
        fs = F.lit(float(e.basis.sfreq))
        cells = time_expand(e, own, model.latency, model.duration, model.column).join(_small(beta, model), "col_ix")
        yhat = cells.groupBy("event_ix", "channel", (F.col("sample") - 1).cast("int").alias("time_ix")).agg(F.sum(F.col("x") * F.col("b")).alias("yhat"))
        yhat = yhat.where(F.col("time_ix") < len(e.basis.times)) if len(e.basis.times) > 1 else yhat
        channels = beta.select("channel").distinct()
        lost = out.join(F.broadcast(channels)).withColumn("time_ix", F.explode(F.sequence(F.lit(0), F.lit(len(e.basis.times) - 1)))).withColumn("yhat", F.lit(None).cast("double"))
        parts.append(yhat.unionByName(lost).select("event_ix", F.lit(e.event).alias("eventname"), "channel", "time_ix", ((F.col("time_ix") + e.basis.shift) / fs).alias("time"), "yhat"))
    return reduce(DataFrame.unionByName, parts)


def predicttable(model: Model, events: DataFrame | None = None) -> DataFrame:
    """The events' columns with time, eventname, channel and yhat of each event alone."""
    own = model.events if events is None else events
    return own.drop(model.latency).join(predict(model, own, overlap=False), "event_ix")


def residuals(model: Model, data: DataFrame, epoch_to=None, window: tuple[float, float] | None = None) -> DataFrame:
    """data with residual: y less the fitted value; samples that no event reaches keep y. With epoch_to, a deconvolution's residuals are cut around the
    model's events of that kind: channel, event_ix, time_ix, time, residual, null beyond the signal."""
    if epoch_to is not None:
        if model.kind != "deconvolution":
            raise ValueError("the residuals of a mass-univariate model are epochs already")
        return _cut(model, residuals(model, data).select("channel", "sample", "residual"), model.events, epoch_to, window)
    if model.kind == "deconvolution":
        return data.join(predict(model), ["channel", "sample"], "left").withColumn("residual", F.col("y") - F.coalesce("yhat", F.lit(0.0))).drop("yhat")
    return data.join(predict(model).select("event_ix", "channel", "time_ix", "yhat"), ["event_ix", "channel", "time_ix"]).withColumn("residual", F.col("y") - F.col("yhat")).drop("yhat")


def r2(model: Model, data: DataFrame, skip_missing: bool = False, skip_notmodelled: bool = False) -> DataFrame:
    """1 less the share of the variance that stays, by channel (and time); null where a value is missing, unless those are skipped."""
    keys = ["channel"] if model.kind == "deconvolution" else ["channel", "time_ix"]
    rows = residuals(model, data)
    if skip_notmodelled:
        if model.kind != "deconvolution":
            raise ValueError("only a deconvolution has samples that aren't modelled")
        rows = rows.join(non_zero_rows(model.design_matrix()), "sample", "left_semi")
    out = rows.groupBy(*keys).agg(F.var_samp("residual").alias("a"), F.var_samp("y").alias("b"), F.count_if(F.col("y").isNull()).alias("n"))
    value = 1 - F.col("a") / F.col("b")
    return out.select(*keys, (value if skip_missing else F.when(F.col("n") == 0, value)).alias("r2"))


TYPICAL: dict[str, Callable[[str], Column]] = {"mean": F.avg, "max": F.max, "min": F.min, "median": F.median, "mode": F.mode}


def grid(spark, given: dict[str, list]) -> DataFrame:
    """All combinations, the last key fastest, with event_ix; one row without columns where nothing is given."""
    import itertools

    rows = list(itertools.product(*given.values()))
    if not given:
        return spark.range(1).select((F.col("id") + 1).alias("event_ix"))
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], ["event_ix", *given])


def effects(given: dict[str, list], model: Model, typical: str | Callable = "mean") -> DataFrame:
    """Predictions over the grid of the given values; columns of other terms are held at their typical value among each kind's events."""
    spark = model.events.sparkSession
    how = TYPICAL[typical] if isinstance(typical, str) else typical
    points, parts = grid(spark, given), []
    beta = _mean(model)
    for e in model.entries:
        cols = e.schema.columns()
        own = filter_events(model.events, e.key, model.column, check=False)
        atoms = _factors(e.schema)
        mixed = [[f for f in parts_ if not f[0] & set(given)] for parts_ in atoms]
        names, aggs = [], []
        for i, fixed in enumerate(mixed):
            if fixed:
                c = reduce(lambda a, b: a * b, [f[1] for f in fixed])
                names.append(i)
                aggs.append(how(c).alias(f"t{i}"))
        row = own.agg(*aggs).first() if aggs else {}
        x = []
        for i, (parts_, (_, whole)) in enumerate(zip(atoms, cols)):
            free = [f[1] for f in parts_ if f[0] & set(given)]
            value = reduce(lambda a, b: a * b, free) if free else None
            fixed = F.lit(float(row[f"t{i}"])) if i in names else None
            x.append(whole if not parts_ else fixed if value is None else value if fixed is None else value * fixed)
        design = points.select("event_ix", *given, F.array(*[c.cast("double") for c in x]).alias("x"))
        k = len(cols)
        if model.kind == "mass-univariate":
            b = beta.where(F.col("col_ix").between(e.offset, e.offset + k - 1)).select("channel", "time_ix", "time", "coef_ix", "b")
        else:
            # a plain kernel: each basis column is one time
            w = F.broadcast(_kernel_times(spark, e))
            b = beta.where(F.col("col_ix").between(e.offset, e.offset + e.width - 1)).select("channel", "coef_ix", "basis_ix", "b").join(w, "basis_ix").groupBy("channel", "coef_ix", "time_ix", "time").agg(F.sum(F.col("b") * F.col("w")).alias("b"))
        b = b.groupBy("channel", "time_ix", "time").agg(F.array_sort(F.collect_list(F.struct("coef_ix", "b"))).alias("b"))
        yhat = F.aggregate(F.zip_with("x", "b", lambda v, c: v * c["b"]), F.lit(0.0), lambda s, v: s + v)
        parts.append(design.join(_small(b, model)).select("event_ix", *given, F.lit(e.event).alias("eventname"), "channel", "time_ix", "time", yhat.alias("yhat")))
    return reduce(DataFrame.unionByName, parts)


def _kernel_times(spark, e) -> DataFrame:
    one = spark.createDataFrame([(1, float(1 - e.basis.shift), 1.0)], "event_ix long, latency double, duration double")
    t = e.basis.expanded(one, "latency", "duration")
    return t.select(F.col("col").alias("basis_ix"), (F.col("sample") - 1).cast("int").alias("time_ix"), ((F.col("sample") - 1 + e.basis.shift) / F.lit(float(e.basis.sfreq))).alias("time"), "w")


def _factors(schema) -> list[list[tuple[set[str], Column]]]:
    """For each column of the design, its factors with the variables they use, in the columns' order."""
    import itertools

    from lagwise.functions.formula import Numeric, parse
    from lagwise.functions.splines import Spline

    terms = parse(schema.formula)
    there = {frozenset(map(str, t)) for t in terms}
    out = []
    for t in terms:
        if not t:
            out.append([])
            continue
        sides = []
        for a in t:
            used = set(a.variables()) if isinstance(a, Numeric) else {a.var if isinstance(a, Spline) else a}
            full = isinstance(a, str) and a in schema.levels and frozenset(map(str, t)) - {a} not in there
            sides.append([(used, c) for _, c in schema._atom(a, full)])
        for combo in itertools.product(*reversed(sides)):
            out.append(list(combo[::-1]))
    return out
