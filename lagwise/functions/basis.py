"""Kernels of time expansion: how an event's predictor spreads over samples."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions import splines


@dataclass(frozen=True)
class Basis:
    """Common parts. An event's kernel row k (from 0) lies on sample floor(latency) + shift + k."""

    sfreq: float
    name: str = ""
    shift: int = 0
    label: str = "time"

    def bound(self, event: str, any_: bool = False) -> "Basis":
        """With a name: the event's where it has none; another event's name is an error unless the design holds for any event."""
        if not self.name:
            return replace(self, name=str(event))
        if self.name != str(event) and not any_:
            raise ValueError(f"basis {self.name!r} belongs to another event than {event!r}")
        return self

    def expanded(self, events: DataFrame, latency: str = "latency", duration: str | None = None) -> DataFrame:
        """events with k, col (from 0) and w for each non-zero kernel entry, and its sample."""
        rows = self._kernel(events, F.col(latency) - F.floor(latency), F.col(duration) if duration else None)
        return rows.withColumn("sample", F.floor(latency).cast("long") + self.shift + F.col("k")).where((F.col("sample") >= 1) & (F.col("w") != 0))

    def _entries(self, events: DataFrame, entries: Column) -> DataFrame:
        return events.withColumn("_e", F.explode(entries)).select(*events.columns, "_e.k", "_e.col", "_e.w")


def _entry(k: Column, col: Column, w: Column) -> Column:
    return F.struct(k.cast("long").alias("k"), col.cast("int").alias("col"), w.cast("double").alias("w"))


@dataclass(frozen=True)
class Fir(Basis):
    first: int = 0
    last: int = 0
    interpolate: bool = False
    scale: str | None = None  # None, "block" or "linear"

    @property
    def width(self) -> int:
        return self.last - self.first + 1

    @property
    def times(self) -> list[float]:
        return [k / self.sfreq for k in range(self.first, self.last + 1)]

    colnames = times

    def _kernel(self, events: DataFrame, fraction: Column, duration: Column | None) -> DataFrame:
        if self.scale and duration is None:
            raise ValueError("a basis that scales with duration needs a duration column")
        cols = F.sequence(F.lit(0), F.lit(self.width - 1))
        if self.scale == "linear":
            d, w = F.ceil(duration).cast("int"), float(self.width)
            # rows of the identity, resized to d rows with half-pixel alignment
            def row(k: Column) -> Column:
                at = F.greatest(F.lit(0.0), F.least(F.lit(w - 1), (k + 0.5) * F.lit(w) / d - 0.5))
                low = F.floor(at)
                return F.array(_entry(k, low, 1 - (at - low)), _entry(k, F.least(low + 1, F.lit(int(w) - 1)), at - low))

            return self._entries(events, F.flatten(F.transform(F.sequence(F.lit(0), d - 1), row)))
        if self.scale == "block":
            ks = F.sequence(F.lit(0), F.ceil(duration).cast("int") - 1)
            out = self._entries(events, F.flatten(F.transform(cols, lambda c: F.transform(ks, lambda k: _entry(c + k, c, F.lit(1.0))))))
            return out
        if self.interpolate:
            return self._entries(events, F.flatten(F.transform(cols, lambda c: F.array(_entry(c, c, 1 - fraction), _entry(c + 1, c, fraction)))))
        return self._entries(events, F.transform(cols, lambda c: _entry(c, c, F.lit(1.0))))


def fir(times: tuple[float, float], sfreq: float, name: str = "", interpolate: bool = False, scale: str | None = None) -> Fir:
    """Lags from times[0] to times[1] seconds, inclusive. scale: block (a boxcar of the event's duration) or linear (stretched to it)."""
    first, last = round(times[0] * sfreq), round(times[1] * sfreq)
    return Fir(sfreq, name, first, "time", first, last, interpolate, scale)


@dataclass(frozen=True)
class SplineTime(Basis):
    first: int = 0
    last: int = 0
    n: int = 4

    @property
    def times(self) -> list[float]:
        return [k / self.sfreq for k in range(self.first, self.last + 1)]

    @property
    def width(self) -> int:
        return self.n

    @property
    def colnames(self) -> list[float]:
        return splines.linspace(self.times[0], self.times[-1], self.n)

    def _kernel(self, events: DataFrame, fraction: Column, duration: Column | None) -> DataFrame:
        breaks = splines.linspace(self.times[0], self.times[-1], self.n - 2)
        of, x = splines.pieces(splines.clamped(breaks)), F.col("_k") / F.lit(float(self.sfreq)) + F.lit(self.first / self.sfreq)
        table = events.sparkSession.range(len(self.times)).select(F.col("id").alias("_k"))
        table = table.select(F.col("_k").alias("k"), F.posexplode(F.array(*[splines.basis(x, of[i], breaks[-1]) for i in range(self.n)])).alias("col", "w"))
        return events.join(F.broadcast(table))  # times by functions, a fixed small table


def splinebasis(times: tuple[float, float], sfreq: float, n: int, name: str = "spline") -> SplineTime:
    first, last = round(times[0] * sfreq), round(times[1] * sfreq)
    return SplineTime(sfreq, name, first, "splineTerm", first, last, n)


STEPS = 32  # of a sample, on the grid of the haemodynamic kernel


@dataclass(frozen=True)
class Hrf(Basis):
    parameters: tuple = (6, 16, 1, 1, 6, 0, 32)
    width = 1
    times = (float("nan"),)
    colnames = (0.0,)

    def response(self, spark, steps: int) -> DataFrame:
        """i, s: the sum of the response's values at the grid's steps 0 to i. The response is a difference of two gamma densities."""
        p, dt = self.parameters, 1 / self.sfreq / STEPS
        u = F.col("i") - F.lit(p[5] / dt)

        def gamma(shape: float, scale: float) -> Column:
            return F.when(u > 0, F.exp(F.lit(shape - 1) * F.log(u) - u / F.lit(scale) - F.lit(math.lgamma(shape) + shape * math.log(scale)))).otherwise(0.0)

        h = gamma(p[0] / p[2], p[2] / dt) - gamma(p[1] / p[3], p[3] / dt) / F.lit(float(p[4]))
        # one row for each step up to the longest event's
        return spark.range(steps + 1).withColumnRenamed("id", "i").select("i", F.sum(h).over(Window.orderBy("i")).alias("s"))

    def _kernel(self, events: DataFrame, fraction: Column, duration: Column | None) -> DataFrame:
        """The response on a grid of STEPS steps a sample, convolved with a box as long as the event that begins a phase (1 less the latency's fraction, in steps)
        after the first sample, at each whole sample up to the response's and the event's length, and scaled by the response's sum over both lengths. What a box
        sums is the difference of the response's sums at its ends: the table of sums is joined there, for each phase and duration that occur."""
        tr, p = 1 / self.sfreq, self.parameters
        d = F.coalesce(duration.cast("double"), F.lit(0.0)) if duration is not None else F.lit(0.0)
        placed = events.withColumn("_phase", F.rint((1 - fraction) * STEPS).cast("int")).withColumn("_d", F.when(d > 0, d).otherwise(1 / STEPS))
        end = F.ceil((F.lit(float(p[6])) + F.col("_d")) / F.lit(tr / STEPS)).cast("long")
        longest = placed.agg(F.max(end)).first()[0] or 0
        sums = self.response(events.sparkSession, longest)
        boxes = placed.select("_phase", "_d").distinct().withColumn("_end", end).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.lit(p[6] / tr) + F.col("_d")).cast("long"))))
        high = F.col("k") * STEPS - F.col("_phase")
        boxes = boxes.withColumn("_high", F.least(high, "_end")).withColumn("_low", F.least(high - F.ceil(F.col("_d") * STEPS), "_end"))
        of = lambda place, name: sums.select(F.col("i").alias(place), F.col("s").alias(name))
        kernels = boxes.join(of("_end", "_all"), "_end").join(of("_high", "_to"), "_high", "left").join(of("_low", "_from"), "_low", "left")
        kernels = kernels.select("_phase", "_d", "k", ((F.coalesce("_to", F.lit(0.0)) - F.coalesce("_from", F.lit(0.0))) / F.col("_all")).alias("w"))
        return placed.join(kernels, ["_phase", "_d"]).select(*events.columns, "k", "w", F.lit(0).alias("col"))


def hrfbasis(tr: float, parameters=(6, 16, 1, 1, 6, 0, 32), name: str = "") -> Hrf:
    return Hrf(1 / tr, name, 0, "derivative", tuple(parameters))
