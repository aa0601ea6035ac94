"""Event-table operators: filtering, checks for missing predictors, and copying values between neighbouring events."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.session import written

ANY = object()
#: Events of a range in which the matchers scan.
RANGE = 500_000


def filter_events(events: DataFrame, key, column: str = "event", check: bool = True) -> DataFrame:
    """The events of one kind; ANY means all. A missing column is an error, and an empty choice too, where it is checked."""
    if key is ANY:
        return events
    if column not in events.columns:
        raise ValueError(f"events have no column {column!r}")
    out = events.where(F.col(column) == F.lit(key))
    if check and out.isEmpty():
        raise ValueError(f"no event has {column} = {key!r}")
    return out


def require_complete(events: DataFrame, columns: list[str]) -> None:
    """An error if a predictor that is used is missing anywhere."""
    if not columns:
        return
    row = events.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    bad = {c: row[c] for c in columns if row[c]}
    if bad:
        raise ValueError(f"missing values in predictors: {bad}")


def _said(latency: str, field: str) -> Column:
    """What a source says: its latency, number and value."""
    return F.struct(F.col(latency).alias("l"), F.col("event_ix").alias("i"), F.col(field).alias("v")).alias("s")


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with _range: the number of the range of `order` that they lie in, each of some RANGE rows at most on the average; written, so that it stays."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows.count() // RANGE))
    return written(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))[0]


def _nearest(events: DataFrame, keys: list[str], source, target, field: str, search: str, column: str, latency: str) -> DataFrame:
    """keys, event_ix of the target of each source, s.

    Sources and targets are sorted in ranges of (keys, latency), targets before sources of equal latency, so that a group of any size is cut too. In each range
    one scan forward has the last target so far, one backward the next (running maxima and minima); what the ranges before and after have to offer follows
    from two rows of each group and range. The work is that of sorting."""
    is_target, is_source = F.col(column) == F.lit(target), F.col(column) == F.lit(source)
    rows = events.where((is_target | is_source) & F.col(latency).isNotNull()).where(" and ".join(f"`{k}` is not null" for k in keys) or "true")
    rows = rows.select(*keys, "event_ix", F.col(latency).alias("_l"), F.when(is_target, 0).otherwise(1).alias("_kind"), is_source.alias("_source"), _said(latency, field))
    order = ["_l", "_kind", "event_ix"]
    rows = _ranged(rows, [*keys, *order])
    # equally near targets: the one of the least number
    back, ahead = F.when(F.col("_kind") == 0, F.struct("_l", (-F.col("event_ix")).alias("ix"))), F.when(F.col("_kind") == 0, F.struct("_l", F.col("event_ix").alias("ix")))
    here, so_far = Window.partitionBy("_range", *keys), (Window.unboundedPreceding, 0)
    near = rows.withColumn("b", F.max(back).over(here.orderBy(*order).rowsBetween(*so_far))).withColumn("f", F.min(ahead).over(here.orderBy(*map(F.desc, order)).rowsBetween(*so_far)))
    ends, ranges = rows.groupBy(*keys, "_range").agg(F.max(back).alias("last"), F.min(ahead).alias("first")), Window.partitionBy(*keys)
    beyond = (Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_range", F.max("last").over(ranges.orderBy("_range").rowsBetween(*beyond)).alias("before"), F.min("first").over(ranges.orderBy(F.desc("_range")).rowsBetween(*beyond)).alias("after"))
    near = near.where("_source").join(carried, [*keys, "_range"]).withColumn("b", F.greatest("b", "before")).withColumn("f", F.least("f", "after"))
    b, at = -F.col("b.ix"), F.col("_l")
    # a target of equal latency lies before its sources; it is the nearest on both sides
    same = F.col("b._l") == at
    f, db, df_ = F.when(same, b).otherwise(F.col("f.ix")), at - F.col("b._l"), F.when(same, F.lit(0.0)).otherwise(F.col("f._l") - at)
    closest = F.when(F.col("b").isNull(), f).when(f.isNull(), b).when(db < df_, b).when(df_ < db, f).otherwise(F.least(b, f))
    return near.select(*keys, {"closest": closest, "backward": b, "forward": f}[search].alias("event_ix"), "s")


def _before(at: Callable[[Column], Column]) -> Column:
    """How many of the latencies _all, which are in order, come first with `at` (of a latency) true: halved steps, each a look at one latency."""
    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), F.lit(0), lambda n, step: F.when(at(F.get("_all", n + step - 1)), n + step).otherwise(n))


def _chosen(sources: DataFrame, targets: DataFrame, keys: list[str], search, reach: float) -> DataFrame:
    """keys, _lat, s of each source, with _seen: the latencies of the targets at most reach away, in order, and event_ix of the one that search chooses.

    Targets are gathered once for each range of latency with a source in it, from it and the ranges beside it; a source looks up where its own ones begin
    and end there, so that no pair of a source and a target becomes a row. Ranges are a little wider than reach: rounded differences reach no further."""
    bucket = lambda c, shift: (F.floor(c / F.lit(reach * 1.0001)) + shift).cast("long")
    at = [*keys, "_bucket"]
    placed = sources.withColumn("_bucket", bucket(F.col("_lat"), 0))
    around = targets.where(~F.isnan("t.lat")).withColumn("_bucket", F.explode(F.array(*[bucket(F.col("t.lat"), i) for i in (-1, 0, 1)])))
    lists = around.join(placed.select(*at).distinct(), at, "left_semi").groupBy(*at).agg(F.array_sort(F.collect_list("t")).alias("t"))
    near = placed.join(lists.select(*at, F.col("t.lat").alias("_all"), F.col("t.ix").alias("_ix")), at, "left").withColumn("_all", F.coalesce("_all", F.array().cast("array<double>")))
    near = near.withColumn("_begin", _before(lambda t: t - F.col("_lat") < -reach)).withColumn("_n", _before(lambda t: t - F.col("_lat") <= reach) - F.col("_begin"))
    near = near.withColumn("_seen", F.slice("_all", F.col("_begin") + 1, F.greatest(F.col("_n"), F.lit(0))))
    near = near.withColumn("_at", search(F.col("_lat"), F.col("_seen")))
    return near.withColumn("event_ix", F.when((F.col("_at") >= 0) & (F.col("_at") < F.col("_n")), F.get("_ix", F.col("_begin") + F.col("_at").cast("int"))))


def _by_function(events: DataFrame, keys: list[str], source, target, field: str, search, column: str, latency: str, within: float | None, settled) -> DataFrame:
    """keys, event_ix of the target of each latency with a source, s: the source that wins there, as all of equal latency choose the same target. Without `within`
    the reach grows in rounds, for those sources only whose answer isn't settled."""
    there = events.where(F.col(latency).isNotNull()).where(" and ".join(f"`{k}` is not null" for k in keys) or "true")
    sources = there.where(F.col(column) == F.lit(source)).select(*keys, F.col(latency).cast("double").alias("_lat"), _said(latency, field))
    sources = sources.groupBy(*keys, "_lat").agg(F.max_by("s", F.struct("s.l", "s.i")).alias("s"))
    targets = there.where(F.col(column) == F.lit(target)).select(*keys, F.struct(F.col(latency).cast("double").alias("lat"), F.col("event_ix").alias("ix")).alias("t"))
    if within is not None:
        return _chosen(sources, targets, keys, search, float(within)).select(*keys, "event_ix", "s")
    span = there.where(F.col(column).isin(source, target)).agg((F.max(latency) - F.min(latency)).cast("double").alias("span"), F.count_if(F.col(column) == F.lit(target)).alias("n")).first()
    reach, picks, span, columns = max(span["span"] or 0.0, 1e-9) / max(1, span["n"]) * 4, [], span["span"] or 0.0, sources.columns
    while True:
        got = _chosen(sources, targets, keys, search, reach)
        last = reach >= span
        done = F.lit(last) if last or settled is None else F.coalesce(settled(F.col("_lat"), F.col("_seen"), F.lit(float(reach))), F.lit(False))
        table, _ = written(got.select(*keys, "_lat", "s", "event_ix", done.alias("_done")))
        picks.append(table.where("_done").select(*keys, "event_ix", "s"))
        sources = table.where("not _done").select(*columns)
        if last or sources.isEmpty():
            return reduce(DataFrame.unionByName, picks)
        reach = reach * 4 if settled is not None else max(span, reach)


def copy_eventinfo(events: DataFrame, source, target, field: str, to: str | None = None, search="closest", column: str = "event", group: str | None = None, latency: str = "latency", within: float | None = None, settled=None) -> DataFrame:
    """For each source event, writes its field into one target event's field `to`: the closest, the nearest at or before (backward), or at or after (forward),
    or the one that a function chooses: search(latency, latencies) gets the source's latency and the array of the targets' latencies, in order, as columns, and
    gives the number (from 0) of one of them, or null. With `within` it sees the targets at most so far away. Without, it sees all of them, or as many as it
    needs: settled(latency, latencies, reach) says that no target beyond the reach can change its choice; where it does not, the reach is widened.

    Equally close targets: the earlier in event_ix. Where several sources choose one target, the last (by latency, then event_ix) wins. Targets that no
    source chooses keep their value, or null in a new column. group: a column within which events are ordered (a series). Events without a latency or group
    choose nothing and are not chosen."""
    if not callable(search) and (within is not None or settled is not None):
        raise ValueError("only a function that chooses has a reach")
    if not callable(search) and search not in ("closest", "backward", "forward"):
        raise ValueError(f"search must be closest, backward or forward, not {search!r}")
    to = to or field
    keys = [group] if group else []
    choose = _by_function(events, keys, source, target, field, search, column, latency, within, settled) if callable(search) else _nearest(events, keys, source, target, field, search, column, latency)
    picks = choose.where("event_ix is not null")
    won = picks.groupBy(*keys, "event_ix").agg(F.max_by("s", F.struct("s.l", "s.i")).alias("s")).select(*keys, "event_ix", F.col("s.v").alias("_new"), F.lit(True).alias("_hit"))
    old = F.col(to) if to in events.columns else F.lit(None)
    return events.join(won, [*keys, "event_ix"], "left").withColumn(to, F.when(F.col("_hit"), F.col("_new")).otherwise(old)).select(*events.columns, *([] if to in events.columns else [to]))
