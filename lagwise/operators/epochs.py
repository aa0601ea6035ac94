"""Cutting epochs and cleaning signals; range joins are written as generated samples and equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_times(times: tuple[float, float], sfreq: float) -> tuple[int, int]:
    """First and last lag in samples, rounded half to even."""
    return round(times[0] * sfreq), round(times[1] * sfreq)


def lags(times: tuple[float, float], sfreq: float) -> list[float]:
    first, last = round_times(times, sfreq)
    return [k / sfreq for k in range(first, last + 1)]


def epoch(signal: DataFrame, events: DataFrame, times: tuple[float, float], sfreq: float, latency: str = "latency", series: list[str] | None = None) -> DataFrame:
    """channel, event_ix, time_ix (from 0), time, y: each event's window; samples outside the signal give null. The event's sample is rint(latency). A window
    is cut once for each sample at which there is an event, however many there are; the events meet their samples' windows."""
    keys, (first, last) = series or [], round_times(times, sfreq)
    channels = signal.select(*keys, "channel").distinct()
    at = events.select(*keys, "event_ix", F.rint(latency).cast("long").alias("_at"))
    places = at.select(*keys, "_at").distinct().withColumn("k", F.explode(F.sequence(F.lit(first), F.lit(last))))
    wanted = places.select(*keys, "_at", (F.col("_at") + F.col("k")).alias("sample"), (F.col("k") - first).alias("time_ix"), (F.col("k") / F.lit(float(sfreq))).alias("time"))
    full = wanted.join(channels, keys) if keys else wanted.join(F.broadcast(channels))  # as many rows as channels
    windows = full.join(signal.select(*keys, "channel", "sample", "y"), [*keys, "channel", "sample"], "left").drop("sample")
    # an event without a latency has a window too, of nulls
    cut = windows.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_at").alias("_place"), "channel", "time_ix", "time", "y")
    same = reduce(Column.__and__, [F.col(k) == F.col(f"_{k}") for k in keys], F.col("_at").eqNullSafe(F.col("_place")))
    # sorted runs of both sides spill; events, of whose size in memory their files say little, would else be broadcast
    return at.hint("merge").join(cut, same).select(*keys, "channel", "event_ix", "time_ix", "time", "y")


def drop_missing_epochs(epochs: DataFrame) -> DataFrame:
    """Without the events that lack a value in any channel at any time."""
    return epochs.join(epochs.where("y is null").select("event_ix").distinct(), "event_ix", "left_anti").select(epochs.columns)


def clean_data(signal: DataFrame, windows: DataFrame) -> DataFrame:
    """Samples inside any window (first, last; inclusive) become null in all channels."""
    bad = windows.select(F.explode(F.sequence(F.col("first").cast("long"), F.col("last").cast("long"))).alias("sample")).distinct().withColumn("_bad", F.lit(True))
    return signal.join(bad, "sample", "left").withColumn("y", F.when(F.col("_bad"), None).otherwise(F.col("y"))).select(signal.columns)


def equalized(design: DataFrame, signal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both cut to the samples up to the smaller of their last ones."""
    last = F.least(*[F.lit(d.agg(F.max("sample")).first()[0] or 0) for d in (design, signal)])
    return design.where(F.col("sample") <= last), signal.where(F.col("sample") <= last)


def same_size(events: DataFrame, epochs: DataFrame) -> None:
    n, m = events.select("event_ix").distinct().count(), epochs.select("event_ix").distinct().count()
    if n != m:
        raise ValueError(f"{n} events but {m} epochs")


def average(epochs: DataFrame, *by: str | Column) -> DataFrame:
    """Classical averages: mean over events for each channel and time, and each value of by."""
    return epochs.groupBy(*by, "channel", "time_ix").agg(F.avg("y").alias("estimate"), F.count("y").alias("n"))
