"""Design matrices as long tables, time expansion, and their cross products."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.functions.basis import Basis
from lagwise.functions.formula import Schema
from lagwise.operators import blocks
from lagwise.operators.events import ANY, filter_events


@dataclass
class Entry:
    """One kind of event: its key, frozen schema, bound basis (or None and times), and the number of columns before it."""

    key: object
    schema: Schema
    basis: Basis | None
    times: list[float] | None
    offset: int = 0

    @property
    def width(self) -> int:
        return len(self.schema.names()) * (self.basis.width if self.basis else 1)

    @property
    def event(self) -> str:
        return "any" if self.key is ANY else str(self.key)


def entries(design, events: DataFrame, contrasts: dict | None = None, column: str = "event") -> list[Entry]:
    """design: pairs of key and (formula, basis or times), or a dict of them. Learns each formula's schema from its own events."""
    pairs, out, offset = list(design.items() if isinstance(design, dict) else design), [], 0
    for key, (formula, how) in pairs:
        schema = Schema.fit(formula, filter_events(events, key, column), {k: v for k, v in (contrasts or {}).items() if k in formula})
        basis = how.bound("any" if key is ANY else key, key is ANY) if isinstance(how, Basis) else None
        out.append(Entry(key, schema, basis, None if basis else list(how), offset))
        offset += out[-1].width
    return out


def time_expand(entry: Entry, events: DataFrame, latency: str = "latency", duration: str | None = None, column: str = "event", series: str | None = None) -> DataFrame:
    """sample, col_ix, x of one kind of event, and its series if that is asked for; equal cells of different events are added up by expanded_design."""
    own = filter_events(events, entry.key, column, check=False)
    keys = [series] if series else []
    extra = [*keys, latency, *([duration] if duration else [])]
    rows = entry.schema.design(own, extra)
    w = entry.basis.width
    wide = entry.basis.expanded(rows, latency, duration)
    return wide.select(*keys, "event_ix", "sample", "col", "w", F.posexplode("x").alias("p", "v")).select(*keys, "event_ix", "sample", (F.lit(entry.offset) + F.col("p") * w + F.col("col")).cast("int").alias("col_ix"), (F.col("w") * F.col("v")).alias("x"))


def expanded_design(all_: list[Entry], events: DataFrame, latency: str = "latency", duration: str | None = None, column: str = "event", series: str | None = None) -> DataFrame:
    """sample, col_ix, x: the time-expanded design of all kinds, without zeros. series: a column whose values have samples of their own."""
    parts = [time_expand(e, events, latency, duration, column, series) for e in all_]
    return reduce(DataFrame.unionByName, parts).groupBy(*([series] if series else []), "sample", "col_ix").agg(F.sum("x").alias("x")).where("x != 0")


def combined(first: DataFrame, second: DataFrame, columns: int) -> DataFrame:
    """Two designs side by side: the second's columns come after the first's, of which there are so many."""
    return first.unionByName(second.withColumn("col_ix", (F.col("col_ix") + columns).cast("int")))


def non_zero_rows(x: DataFrame) -> DataFrame:
    return x.where("x != 0").select("sample").distinct()


def valid_samples(signal: DataFrame) -> DataFrame:
    """Samples that no channel lacks."""
    return signal.groupBy("sample").agg(F.count_if(F.col("y").isNull()).alias("n")).where("n = 0").select("sample")


def gram(x: DataFrame) -> DataFrame:
    """i, j, g for i <= j: sums of products of the columns, made by blocks of samples."""
    p = 1 << 31  # more than there are columns
    rows = blocks.sums(x, p).select(F.explode(F.arrays_zip("keys", "values")).alias("s"))
    at = F.col("s.keys")
    return rows.select(F.expr(f"cast(s.keys div {p}L as int)").alias("i"), (at % p).cast("int").alias("j"), F.col("s.values").alias("g"))


def cross(x: DataFrame, signal: DataFrame) -> DataFrame:
    """channel, col_ix, r: sums of products of the columns with each channel, over the samples that the channel has."""
    packed = blocks.pack(signal, complete=False)
    n, rows = packed.width, blocks.sums(x, 1, packed, xx=False)
    cells = rows.select("keys", F.posexplode("values").alias("at", "r"))
    channel = F.get(F.array(*map(F.lit, packed.channels)), F.col("at") % n) if n else F.lit(None)
    return cells.select(channel.alias("channel"), F.expr(f"cast(keys[cast(at div {max(1, n)} as int)] as int)").alias("col_ix"), "r")


def gram_lagged(entry: Entry, events: DataFrame, samples: int, latency: str = "latency", column: str = "event") -> DataFrame:
    """The same as gram for one plain FIR entry over samples 1..samples, by lag: events of one sample are added up first; samples nearer than the width meet
    through buckets of that width, and are added up by lag; pairs whose common samples reach beyond the signal are counted cell by cell."""
    w, shift, k = entry.basis.width, entry.basis.shift, len(entry.schema.names())
    design = entry.schema.design(filter_events(events, entry.key, column, check=False), [latency])
    rows = design.groupBy((F.floor(latency).cast("long") + shift).alias("r")).agg(F.array(*[F.sum(F.get("x", F.lit(j))) for j in range(k)]).alias("x")).withColumn("b", F.floor(F.col("r") / w))
    near = rows.select(F.col("x").alias("x2"), F.col("r").alias("r2"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    pairs = rows.join(near, "b").where(F.abs(F.col("r") - F.col("r2")) < w).withColumn("lag", (F.col("r") - F.col("r2")).cast("int"))
    # samples r+c (c of 0..w-1) in 1..samples: whole pairs share one range of c
    pairs = pairs.withColumn("c0", F.greatest(F.lit(0), 1 - F.col("r")).cast("int")).withColumn("c1", F.least(F.lit(w - 1), F.lit(samples) - F.col("r")).cast("int"))
    sums = pairs.select("lag", "c0", "c1", F.posexplode("x").alias("p", "a"), "x2").select("lag", "c0", "c1", "p", "a", F.posexplode("x2").alias("q", "v"))
    sums = sums.groupBy("lag", "c0", "c1", "p", "q").agg(F.sum(F.col("a") * F.col("v")).alias("s")).where("c1 >= c0")
    cells = sums.withColumn("c", F.explode(F.sequence("c0", "c1"))).withColumn("d", F.col("c") + F.col("lag")).where(F.col("d").between(0, w - 1))
    i, j = F.col("p") * w + F.col("c"), F.col("q") * w + F.col("d")
    return cells.select((entry.offset + i).cast("int").alias("i"), (entry.offset + j).cast("int").alias("j"), "s").where("i <= j").groupBy("i", "j").agg(F.sum("s").alias("g")).where("g != 0")
