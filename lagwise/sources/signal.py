"""Signals and event tables as long DataFrames, and saved models.

signal: channel int, sample bigint (from 1), y double or null. events: event_ix bigint, latency double (in samples), event, predictors.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMAT = 1


def signal_from_arrays(df: DataFrame, values: str = "values", channel: str | None = None) -> DataFrame:
    """Rows that hold a channel's whole series as an array, as a long signal; without a channel column there is one channel, 1."""
    ch = F.col(channel).cast("int") if channel else F.lit(1)
    return df.select(ch.alias("channel"), F.posexplode(values).alias("at", "y")).select("channel", (F.col("at") + 1).cast("long").alias("sample"), F.col("y").cast("double").alias("y"))


def signal_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """A line of comma-separated samples for each channel; a channel's number is its line's."""
    # a line's number: its place in its part of the file after the lines of the parts before, of which the driver gets the counts
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33))
    before, at = {}, 0
    for r in lines.groupBy("part").count().orderBy("part").collect():
        before[r["part"]], at = at, at + r["count"]
    offset = F.element_at(F.map_from_arrays(F.array(*map(F.lit, before)), F.array(*map(F.lit, before.values()))), F.col("part")) if before else F.lit(0)
    numbered = lines.select((offset + F.col("id").bitwiseAND((1 << 33) - 1) + 1).alias("channel"), F.split("value", ",").alias("v"))
    long = numbered.select("channel", F.posexplode("v").alias("at", "text"))
    return long.select(F.col("channel").cast("int").alias("channel"), (F.col("at") + 1).cast("long").alias("sample"), F.expr("try_cast(trim(text) as double)").alias("y"))


def events_from_csv(spark: SparkSession, path: str) -> DataFrame:
    return with_index(spark.read.csv(path, header=True, inferSchema=True))


def with_index(events: DataFrame, *order: str, parts: int = 64) -> DataFrame:
    """Adds event_ix, from 1 in the order given (latency by default; the first column is a number). Ranges of the first column are numbered in parallel
    and offset by the sizes of the ranges before, of which the driver gets as many as there are parts."""
    order = order or ("latency",)
    key = F.col(order[0]).cast("double")
    cuts = sorted(set(events.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < key)) if cuts else F.lit(0)
    rows = events.withColumn("_bucket", bucket)
    sizes, before, at = {r["_bucket"]: r["count"] for r in rows.groupBy("_bucket").count().collect()}, {}, 0
    for b in sorted(sizes):
        before[b], at = at, at + sizes[b]
    offset = F.element_at(F.map_from_arrays(F.array(*map(F.lit, before)), F.array(*[F.lit(n).cast("long") for n in before.values()])), F.col("_bucket")) if before else F.lit(0)
    numbered = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return rows.select((numbered + offset).cast("long").alias("event_ix"), *events.columns)


def sample_of(ts: str, start: int, step: int):
    """The sample (from 1) of a timestamp on a grid that starts at start, both in microseconds."""
    return (F.expr(f"(unix_micros(cast({ts} as timestamp)) - {start}L) div {step}L") + 1).cast("long")


def gridded(rows: DataFrame, ts: str, value, start: int, step: int, samples: int, channel=None, fill: bool = True) -> DataFrame:
    """Sums of value on a regular grid. With fill, samples without rows are 0, else null. channel: a column of integers. A row beyond the grid is an error."""
    ch, at = channel if channel is not None else F.lit(1), sample_of(ts, start, step)
    at = F.when(at.between(1, samples), at).otherwise(F.raise_error(F.lit(f"a row lies beyond the grid of {samples} samples")).cast("long"))
    sums = rows.groupBy(ch.cast("int").alias("channel"), at.alias("sample")).agg(F.sum(value).cast("double").alias("y"))
    grid = rows.sparkSession.range(1, samples + 1).select(F.col("id").alias("sample"))
    channels = sums.select("channel").distinct()
    # channels are few by nature; the grid is generated where it is joined
    full = grid.join(F.broadcast(channels)) if channel is not None else grid.withColumn("channel", F.lit(1))
    y = F.coalesce("y", F.lit(0.0)) if fill else F.col("y")
    return full.join(sums, ["channel", "sample"], "left").select("channel", "sample", y.alias("y"))


def save_model(model, path: str, compression: str = "snappy") -> None:
    """Coefficients and events as Parquet, the rest as JSON; the design matrix is not stored, it is rebuilt."""
    model.coefs.write.mode("overwrite").option("compression", compression).parquet(f"{path}/coefs")
    model.events.write.mode("overwrite").option("compression", compression).parquet(f"{path}/events")
    spark = model.coefs.sparkSession
    spark.createDataFrame([(json.dumps({"format_version": FORMAT, **model.meta()}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str):
    from lagwise.operators.solve import Model

    meta = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/meta").collect()))
    if meta["format_version"] > FORMAT:
        raise ValueError(f"model format {meta['format_version']} is newer than {FORMAT}")
    return Model.of(meta, spark.read.parquet(f"{path}/coefs"), spark.read.parquet(f"{path}/events"))
