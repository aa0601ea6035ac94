"""Steps whose rows must grow as the events do, not as their pairs: events crowd at few samples."""

import numpy as np
import pytest
from conftest import most_rows
from pyspark.sql import functions as F

from lagwise.functions import basis as bases
from lagwise.operators import design as dm
from lagwise.operators import epochs as ep
from lagwise.operators import events as ev
from lagwise.operators import solve as sv


def crowd(spark, n):
    """n events of each of two kinds, spread over twelve samples."""
    return spark.createDataFrame([(i + 1, 100.0 + (i * 7 % (12 * 64)) / 64, "SR"[i % 2], float(i % 5)) for i in range(2 * n)], "event_ix long, latency double, event string, v double")


def test_copying_by_a_function_makes_no_pairs(spark):
    e = crowd(spark, 400)
    rows = [tuple(r) for r in e.collect()]
    targets = sorted((lat, i) for i, lat, kind, _ in rows if kind == "R")
    won: dict[int, tuple] = {}
    for i, lat, kind, v in rows:
        seen = [t for t in targets if abs(t[0] - lat) <= 2]
        if kind == "S" and len(seen) > 1:
            won[seen[1][1]] = max(won.get(seen[1][1], (-1.0, 0, 0.0)), (lat, i, v))
    got = ev.copy_eventinfo(e, "S", "R", "v", "got", search=lambda lat, lats: F.lit(1), within=2.0)
    assert {r["event_ix"]: r["got"] for r in got.where("got is not null").collect()} == {i: w[2] for i, w in won.items()}
    assert most_rows(got) <= 4000  # 400 sources see some 50,000 targets


def test_reach_ends_where_differences_do(spark):
    """A number outside what is seen chooses nothing, and targets exactly at the reach are seen, by rounded differences as much."""
    e = spark.createDataFrame([(1, 1.9999999999999998, "S", 1.0), (2, 4.0, "R", 2.0), (3, 9.0, "S", 3.0), (4, 11.5, "R", 4.0)], "event_ix long, latency double, event string, v double")
    for at, want in ((0, {2: 1.0}), (1, {})):
        got = ev.copy_eventinfo(e, "S", "R", "v", "got", search=lambda lat, lats, at=at: F.lit(at), within=2.0)
        assert {r["event_ix"]: r["got"] for r in got.where("got is not null").collect()} == want


def test_cross_products_by_lag_make_no_pairs_of_events(spark):
    e = crowd(spark, 400)
    entry = dm.entries([("S", ("0 ~ 1 + v", bases.fir((-1.0, 3.0), 1.0)))], e)[0]
    lagged = dm.gram_lagged(entry, e, 108)
    plain = {(r["i"], r["j"]): r["g"] for r in dm.gram(dm.expanded_design([entry], e).where("sample <= 108")).collect()}
    assert {(r["i"], r["j"]): r["g"] for r in lagged.collect()} == pytest.approx(plain)
    assert most_rows(lagged) <= 2000  # 160,000 pairs of events


def test_windows_are_cut_once_for_a_sample(spark):
    e = crowd(spark, 400).withColumn("latency", F.when(F.col("event_ix") > 3, F.col("latency")))
    y = spark.createDataFrame([(c, i, float(c * i)) for c in (1, 2) for i in range(1, 105) if i != 103], "channel int, sample long, y double")
    want = {}
    for i, lat in [(r["event_ix"], r["latency"]) for r in e.collect()]:
        for c in (1, 2):
            for k in range(-1, 4):
                s = None if lat is None else round(lat) + k
                want[c, i, k + 1, float(k)] = c * s if s in range(1, 105) and s != 103 else None
    got = ep.epoch(y, e, (-1.0, 3.0), 1.0)
    rows = got.collect()
    assert len(rows) == len(want) and {(r["channel"], r["event_ix"], r["time_ix"], r["time"]): r["y"] for r in rows} == want
    # the samples of the windows are looked up in the signal for 13 places and for none, not for 800 events
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert most_rows(got.where("y > 0").groupBy().agg(F.count("*"))) <= 8000 and "strategy=merge" in plan
    assert most_rows(ep.epoch(y, e, (-1.0, 3.0), 1.0).select("channel", "time_ix", "y").distinct()) <= 8000


@pytest.mark.parametrize("weight", [sv.biweight(), sv.huber()])
def test_robust_fits_count_equal_events(spark, monkeypatch, weight):
    """Events that are there up to four times each: what whole groups give, without a round over all rows."""
    rng = np.random.default_rng(5)
    kinds = [(float(rng.integers(0, 9)), float(rng.integers(0, 40)), i % 4 + 1) for i in range(60)]
    rows = [(x, 2 * x + y, 1) for x, y, n in kinds for _ in range(n)]
    e = spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(rows)], "event_ix long, x double")
    epochs = spark.createDataFrame([(1, t, i, y * (t + 1)) for i, (_, y, _) in enumerate(rows) for t in range(2)], "channel int, time_ix int, event_ix long, y double")
    get = lambda most: {(r["time_ix"], r["coefname"]): r["estimate"] for r in sv.robust("0 ~ 1 + x", e, epochs, weight=weight, most_rows=most).collect()}
    whole = get(1000)

    def none(*_):
        raise AssertionError("rounds over all rows")

    monkeypatch.setattr(sv, "_rounds", none)
    assert len(rows) > 100 and get(60) == pytest.approx(whole, rel=1e-9)


@pytest.mark.parametrize("unit", [1.0, 1e-9])
def test_robust_fits_of_many_different_events_need_no_rounds(spark, monkeypatch, unit):
    """More than 100,000 events of one channel and time, no two alike: their fit is a task's, and equals that of numpy."""
    n = 110_000
    e = spark.range(n).select(F.col("id").alias("event_ix"), (F.col("id") * 7919 % n / n).alias("x"))
    far = F.when(F.col("event_ix") % 10 == 0, 50.0).otherwise(F.sin(F.col("event_ix").cast("double")))
    epochs = e.select(F.lit(1).alias("channel"), F.lit(0).alias("time_ix"), "event_ix", ((F.lit(1.0) + F.col("x") * 2 + far) * unit).alias("y"))

    def none(*_):
        raise AssertionError("rounds over all rows")

    monkeypatch.setattr(sv, "_rounds", none)
    got = {r["coefname"]: r["estimate"] / unit for r in sv.robust("0 ~ 1 + x", e, epochs).collect()}
    i = np.arange(n)
    x = np.column_stack([np.ones(n), i * 7919 % n / n])
    want = sv.reweighted(x, x @ [1.0, 2.0] + np.where(i % 10 == 0, 50.0, np.sin(i)), sv.biweight())
    assert [got["(Intercept)"], got["x"]] == pytest.approx(list(want), rel=1e-6) and abs(want[0] - 1) < 0.05
