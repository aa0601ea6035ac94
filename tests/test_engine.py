"""Simulated box responses, literal matrices and identities."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.functions import basis as bases
from lagwise.functions.formula import Schema, contrast, parse
from lagwise.operators import design as dm
from lagwise.operators import epochs as ep
from lagwise.operators import events as ev
from lagwise.operators import predict as pr
from lagwise.operators import solve as sv
from lagwise.sources import signal as sg


def boxes(spark, events, n, rate):
    """Each event adds its effect to the samples of one second."""
    y = np.zeros(n)
    for lat, effect in events:
        y[lat - 1 : lat - 1 + rate] += effect
    return spark.createDataFrame([(1, i + 1, float(v)) for i, v in enumerate(y)], "channel int, sample long, y double")


def table(spark, rows, schema):
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], f"event_ix long, {schema}")


def test_mass_univariate_truth(spark):
    rng = np.random.default_rng(1)
    rows = [(float(50 + 45 * i), "a", float(rng.integers(2)), float(rng.uniform(-1, 1))) for i in range(40)]
    e = table(spark, rows, "latency double, event string, conditionA double, continuousA double")
    y = boxes(spark, [(int(r[0]), 2 + 3 * r[2] + 4 * r[3]) for r in rows], 2000, 20)
    m = sv.fit(("0 ~ 1 + conditionA + continuousA", ep.lags((-0.2, 0.5), 20)), e, ep.epoch(y, e, (-0.2, 0.5), 20), stderror=True)
    got = {r["coefname"]: r["estimate"] for r in m.coefs.where("time_ix = 6").collect()}
    assert [got[k] for k in ("(Intercept)", "conditionA", "continuousA")] == pytest.approx([2, 3, 4])
    assert pr.r2(m, ep.epoch(y, e, (-0.2, 0.5), 20)).where("time_ix = 6").first()["r2"] == pytest.approx(1)
    table_ = pr.effects({"conditionA": [0.0, 1.0], "continuousA": [-2.0, 0.0, 2.0]}, m).where("time_ix = 6").collect()
    assert {(r["conditionA"], r["continuousA"]): round(r["yhat"], 6) for r in table_} == {(a, c): 2 + 3 * a + 4 * c for a in (0.0, 1.0) for c in (-2.0, 0.0, 2.0)}


def test_deconvolution_of_overlap(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = sorted((float(rng.integers(30, 1900)), "ab"[int(rng.integers(2))]) for _ in range(150))
    e = table(spark, rows, "latency double, event string")
    y = boxes(spark, [(int(lat), 2 if k == "a" else 3) for lat, k in rows], 2000, 20)
    design = [("a", ("0 ~ 1", bases.fir((-0.1, 1.2), 20))), ("b", ("0 ~ 1", bases.fir((-0.1, 1.2), 20)))]
    m = sv.fit(design, e, y, stderror=True)
    got = {(r["eventname"], round(r["time"], 2)): r["estimate"] for r in m.coeftable().collect()}
    assert got["a", 0.5] == pytest.approx(2) and got["b", 0.5] == pytest.approx(3) and got["a", -0.1] == pytest.approx(0, abs=1e-8) and got["b", 1.1] == pytest.approx(0, abs=1e-8)
    assert pr.r2(m, y, skip_notmodelled=True).first()["r2"] == pytest.approx(1)
    for solver in ("pinv", "qr", "cholesky", "cg", "intern", "lsmr"):
        other = sv.fit(design, e, y, solver=solver).coefs.agg(F.sum("estimate")).first()[0]
        assert other == pytest.approx(sum(got.values()), abs=1e-4)
    part = pr.predict(m, keep=["a"]).agg(F.max("yhat")).first()[0]
    assert part >= 2 - 1e-6
    sg.save_model(m, str(tmp_path / "m"))
    again = sg.load_model(spark, str(tmp_path / "m"))
    assert pr.predict(again, overlap=False).agg(F.sum("yhat")).first()[0] == pytest.approx(pr.predict(m, overlap=False).agg(F.sum("yhat")).first()[0])
    assert "deconvolution" in repr(again) and again.coefnames()[0].startswith("a : (Intercept)")
    # shuffled rows and missing samples change nothing but the missing
    gone = y.withColumn("y", F.when(F.col("sample").between(500, 520), None).otherwise(F.col("y")))
    less = sv.fit(design, e.orderBy(F.desc("event_ix")), gone).coeftable().collect()
    assert {(r["eventname"], round(r["time"], 2)): round(r["estimate"], 5) + 0.0 for r in less} == {k: round(v, 5) + 0.0 for k, v in got.items()}


def test_two_events_literal(spark):
    e = table(spark, [(1.0, "a"), (4.0, "a")], "latency double, event string")
    entry = dm.entries([("a", ("0 ~ 1", bases.fir((-3.0, 0.0), 1.0)))], e)[0]
    got = sorted(tuple(r) for r in dm.expanded_design([entry], e).collect())
    assert got == [(1, 0, 1.0), (1, 3, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0)]


def test_gram_by_lag_equals_plain(spark):
    rng = np.random.default_rng(3)
    e = table(spark, [(float(rng.integers(-5, 130)), "a", float(rng.normal())) for _ in range(60)], "latency double, event string, v double")
    entry = dm.entries([("a", ("0 ~ 1 + v", bases.fir((-3.0, 4.0), 1.0)))], e)[0]
    plain = {(r["i"], r["j"]): r["g"] for r in dm.gram(dm.expanded_design([entry], e).where("sample <= 120")).collect()}
    lagged = {(r["i"], r["j"]): r["g"] for r in dm.gram_lagged(entry, e, 120).collect()}
    keys = set(plain) | set(lagged)
    assert [plain.get(k, 0) for k in keys] == pytest.approx([lagged.get(k, 0) for k in keys])


def test_epoch_edges(spark):
    y = spark.createDataFrame([(1, i, float(i)) for i in range(1, 101)], "channel int, sample long, y double")
    e = table(spark, [(50.0,), (1.0,), (100.5,)], "latency double")
    got = {(r["event_ix"], r["time_ix"]): r["y"] for r in ep.epoch(y, e, (-1.0, 1.0), 1).collect()}
    assert [got[1, k] for k in range(3)] == [49, 50, 51] and [got[2, k] for k in range(3)] == [None, 1, 2] and got[3, 1] == 100 and got[3, 2] is None
    assert ep.round_times((-0.07, 0.25), 100) == (-7, 25)


def test_copy_without_match_writes_nothing(spark):
    e = table(spark, [(10.0, "S", 1.0), (20.0, "R", 2.0), (30.0, "R", 3.0)], "latency double, event string, rt double")
    back = {r["event_ix"]: r["got"] for r in ev.copy_eventinfo(e, "R", "S", "rt", "got", search="backward").collect()}
    assert back == {1: 3.0, 2: None, 3: None}  # the later source wins
    ahead = {r["event_ix"]: r["got"] for r in ev.copy_eventinfo(e, "R", "S", "rt", "got", search="forward").collect()}
    assert ahead == {1: None, 2: None, 3: None}


def test_formulas(spark):
    assert parse("0 ~ 1 + a * b") == [(), ("a",), ("b",), ("a", "b")] and parse("0 ~ 0 + a") == [("a",)]
    assert contrast("effects", ["x", "y"])[1] == [[-1.0, 1.0]]
    e = table(spark, [(1.0, "u"), (2.0, "v"), (None, "v")], "x double, c string")
    with pytest.raises(ValueError):
        Schema.fit("0 ~ 1 + x", e)
    assert Schema.fit("0 ~ 1 + c", e).names() == ["(Intercept)", "c: v"]
    with pytest.raises(ValueError):
        Schema.fit("0 ~ 1 + spl(x, 3)", e)


def test_splines(spark):
    e = table(spark, [(float(i),) for i in range(21)], "x double")
    s = Schema.fit("0 ~ 0 + spl(x, 6)", e)
    assert len(s.names()) == 5
    total = e.select(*[c.alias(f"c{i}") for i, c in enumerate(_spline(s).all_columns())]).toPandas().sum(1)
    assert total.to_numpy() == pytest.approx(np.ones(21))
    assert s.design(table(spark, [(25.0,)], "x double")).first()["x"] is None
    c = Schema.fit("0 ~ 0 + circspl(x, 5, 0, 20)", e)
    a, b = (c.design(table(spark, [(v,)], "x double")).first()["x"] for v in (3.0, 23.0))
    assert a == pytest.approx(b) and len(a) == 5


def _spline(s):
    atom = parse(s.formula)[0][0]
    return atom.fitted(s.breaks["x,6"])


def hrf_kernel(phase: int, tr: float, duration: float | None = None, p=(6, 16, 1, 1, 6, 0, 32)) -> np.ndarray:
    """The haemodynamic kernel by a plain convolution on a grid of 32 steps a sample."""
    dt = tr / 32
    d = duration if duration and duration > 0 else 1 / 32
    u = np.arange(0, math.ceil((p[6] + d) / dt) + 1) - p[5] / dt

    def gamma(shape: float, scale: float) -> np.ndarray:
        x = np.maximum(u, 1e-300)
        return np.where(u > 0, np.exp((shape - 1) * np.log(x) - x / scale - math.lgamma(shape) - shape * math.log(scale)), 0.0)

    h = gamma(p[0] / p[2], p[2] / dt) - gamma(p[1] / p[3], p[3] / dt) / p[4]
    box = np.concatenate([np.zeros(phase), np.ones(math.ceil(d * 32))])
    return np.convolve(h / h.sum(), box)[::32][: math.floor(p[6] / tr + d) + 1]


def test_kernels(spark):
    e = table(spark, [(10.25, 3.0)], "latency double, duration double")
    at = lambda b, d="duration": {(r["k"], r["col"]): r["w"] for r in b.expanded(e, "latency", d).collect()}
    assert at(bases.fir((0.0, 1.0), 1.0, interpolate=True)) == {(0, 0): 0.75, (1, 0): 0.25, (1, 1): 0.75, (2, 1): 0.25}
    block = at(bases.fir((0.0, 3.0), 1.0, scale="block"))
    assert all(sum(w for (_, c), w in block.items() if c == k) == 3 for k in range(4))
    same = bases.fir((0.0, 2.0), 1.0, scale="linear")
    assert at(same) == {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0}
    h = hrf_kernel(round(0.7 * 32), 2.0)
    assert len(h) == 17 and int(np.argmax(h)) == 3
    late, early = hrf_kernel(32, 2.0), hrf_kernel(0, 2.0)
    assert late[1:] == pytest.approx(early[:-1], abs=1e-9)
    long = at(bases.hrfbasis(2.0), "duration")
    assert len(hrf_kernel(24, 2.0, 3.0)) == 20 and [long[k, 0] for k in range(1, 20)] == pytest.approx(hrf_kernel(24, 2.0, 3.0)[1:])
    assert sum(at(bases.splinebasis((-1.0, 1.0), 10, 5)).values()) == pytest.approx(20)  # of 21 lags the first lies before sample 1


def test_robust_ignores_an_outlier(spark):
    e = table(spark, [(float(i),) for i in range(30)], "x double")
    rows = [(1, 0, i + 1, 2.0 + 0.5 * i + (500 if i == 7 else 0)) for i in range(30)]
    got = {r["coefname"]: r["estimate"] for r in sv.robust("0 ~ 1 + x", e, spark.createDataFrame(rows, "channel int, time_ix int, event_ix long, y double")).collect()}
    assert got == {"(Intercept)": pytest.approx(2), "x": pytest.approx(0.5)}


def test_folds_cover(spark):
    e = table(spark, [(float(i),) for i in range(12)], "latency double")
    for shuffle in (False, True):
        n = {r["fold"]: r["count"] for r in sv.folds(e, 3, shuffle).groupBy("fold").count().collect()}
        assert n == {0: 4, 1: 4, 2: 4}


def test_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("1,2.5,,4\n")
    got = [tuple(r) for r in sg.signal_from_csv(spark, str(tmp_path / "s.csv")).orderBy("sample").collect()]
    assert got == [(1, 1, 1.0), (1, 2, 2.5), (1, 3, None), (1, 4, 4.0)]


def test_robust_in_rounds_equals_whole_groups(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300).round(2)
    e = table(spark, [(float(v),) for v in x], "x double")
    rows = [(1, t, i + 1, float(1 + t * x[i] + rng.standard_t(2))) for t in range(2) for i in range(300 - t)]
    epochs = spark.createDataFrame(rows, "channel int, time_ix int, event_ix long, y double")
    get = lambda most: {(r["time_ix"], r["coefname"]): r["estimate"] for r in sv.robust("0 ~ 1 + x", e, epochs, most_rows=most).collect()}
    whole, rounds = get(10**9), get(10)
    assert len(whole) == 4 and rounds == {k: pytest.approx(v, abs=1e-7) for k, v in whole.items()}
    # weights of one's own, and Huber's, at any size
    for weight in (sv.huber(), lambda u: 1 / (1 + u * u)):
        few, many = ({(r["channel"], r["time_ix"], r["coefname"]): r["estimate"] for r in sv.robust("0 ~ 1 + x", e, epochs, weight=weight, most_rows=n).collect()} for n in (1000, 10))
        assert few == {k: pytest.approx(v, abs=1e-7) for k, v in many.items()}


def test_medians_are_exact(spark):
    rng = np.random.default_rng(3)
    values = {0: rng.normal(size=20_000), 1: np.r_[np.zeros(5001), rng.normal(size=4000)], 2: np.array([1.0, 5.0]), 3: np.array([7.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "g int, v double")
    assert {r["g"]: r["median"] for r in sv._medians(rows, ["g"], rows["v"]).collect()} == {k: np.median(v) for k, v in values.items()}


def copied(rows: list[tuple], search: str) -> dict:
    """rows: event_ix, latency, event, rt, group. What each target gets, by comparing each source with each target."""
    won: dict[int, tuple] = {}
    for ix, lat, event, rt, g in rows:
        if event != "R" or lat is None or g is None:
            continue
        near = [(abs(l2 - lat), i2) for i2, l2, e2, _, g2 in rows if e2 == "S" and l2 is not None and g2 == g and (search == "closest" or (l2 <= lat if search == "backward" else l2 >= lat))]
        if near:
            won[min(near)[1]] = max(won.get(min(near)[1], (-1.0, -1, None)), (lat, ix, rt))
    return {i: w[2] for i, w in won.items()}


def test_copying_in_ranges_and_groups(spark, monkeypatch):
    monkeypatch.setattr(ev, "RANGE", 100)
    rng = np.random.default_rng(4)
    rows = [(i + 1, float(v) if i % 50 else None, "S" if i % 7 == 5 else "R" if i % 11 else "other", float(i), [None, "a", "b", "b", "b", "b"][int(g)]) for i, (v, g) in enumerate(zip(rng.integers(0, 300, 1500), rng.integers(0, 6, 1500)))]
    e = spark.createDataFrame(rows, "event_ix long, latency double, event string, rt double, g string").repartition(6)
    for search in ("closest", "backward", "forward"):
        for group in (None, "g"):
            got = ev.copy_eventinfo(e, "R", "S", "rt", "got", search=search, group=group)
            assert got.count() == len(rows)
            assert {r["event_ix"]: r["got"] for r in got.where("got is not null").collect()} == copied([(*r[:4], r[4] if group else "all") for r in rows], search)


def test_one_group_is_scanned_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ev, "RANGE", 1000)
    e = spark.range(1, 20_001).select(F.col("id").alias("event_ix"), F.col("id").cast("double").alias("latency"), F.when(F.col("id") % 5000 == 1, "S").otherwise("R").alias("event"), F.col("id").alias("rt"), F.lit("g").alias("g"))
    got = ev.copy_eventinfo(e, "R", "S", "rt", "got", search="backward", group="g").where("got is not null").collect()
    assert {r["event_ix"]: r["got"] for r in got} == {1: 5000, 5001: 10000, 10001: 15000, 15001: 20000}
    cut = ev._ranged(e.select("g", "latency"), ["g", "latency"]).groupBy("_range").count().collect()
    assert len(cut) > 10 and max(r["count"] for r in cut) < 4000


def test_folds_are_taken_from_sums(spark):
    rng = np.random.default_rng(8)
    rows = [(float(20 + 12 * i), "uvw"[int(rng.integers(3))], float(rng.normal())) for i in range(60)]
    e = table(spark, rows, "latency double, c string, v double")
    y = spark.createDataFrame([(ch, i, float(rng.normal())) for ch in (1, 2) for i in range(1, 751)], "channel int, sample long, y double")
    epochs, design = ep.epoch(y, e, (-0.2, 0.3), 10), [(ev.ANY, ("0 ~ 1 + c + v", ep.lags((-0.2, 0.3), 10)))]
    key = lambda df: {(r["channel"], r["time_ix"], r["coefname"]): (pytest.approx(r["estimate"]), pytest.approx(r["stderror"])) for r in df.collect()}
    value = lambda df: {(r["channel"], r["time_ix"], r["coefname"]): (r["estimate"], r["stderror"]) for r in df.collect()}
    for fit_test in (False, True):
        m = sv.cross_validated(design, e, epochs, k=4, seed=3, fit_test=fit_test, stderror=True)
        fold = sv.folds(e, 4, True, 3)
        for f in range(4):
            keep = fold.where(F.col("fold") == f if fit_test else F.col("fold") != f)
            one = sv.fit(design, e.join(keep, "event_ix", "left_semi"), epochs.join(keep, "event_ix", "left_semi"), stderror=True)
            assert value(m.coefs.where(F.col("fold") == f)) == key(one.coefs)
    with pytest.raises(ValueError):
        sv.cross_validated([(ev.ANY, ("0 ~ 1", bases.fir((0.0, 1.0), 10)))], e, epochs)


def test_splines_of_many_functions_are_small_expressions(spark):
    e = spark.range(4001).select(F.col("id").alias("event_ix"), (F.col("id") / 40).alias("x"))
    began = time.time()
    s = Schema.fit("0 ~ 1 + spl(x, 50)", e)
    plan = s.design(e)._jdf.queryExecution().optimizedPlan().toString()
    assert time.time() - began < 12 and len(plan) > 0
    from lagwise.functions import splines

    rng, knots = np.random.default_rng(9), splines.clamped([0.0, 1.0, 1.0, 2.5, 4.0, 4.0])
    xs = np.r_[rng.uniform(0, 4, 50), 0.0, 1.0, 2.5, 4.0]
    of = splines.pieces(knots)

    def cox(i: int, k: int, x: float) -> float:
        if k == 1:
            return float(knots[i] <= x < knots[i + 1] or (x == knots[-1] == knots[i + 1] > knots[i]))
        first = (x - knots[i]) / (knots[i + k - 1] - knots[i]) * cox(i, k - 1, x) if knots[i + k - 1] > knots[i] else 0.0
        return first + ((knots[i + k] - x) / (knots[i + k] - knots[i + 1]) * cox(i + 1, k - 1, x) if knots[i + k] > knots[i + 1] else 0.0)

    got = spark.createDataFrame([(float(x),) for x in xs], "x double").select(*[(splines.basis(F.col("x"), of[i], 4.0) if i in of else F.lit(0.0)).alias(f"b{i}") for i in range(8)]).toPandas().to_numpy()
    assert got == pytest.approx(np.array([[cox(i, 4, x) for i in range(8)] for x in xs]), abs=1e-12)


def test_haemodynamic_kernels_of_any_duration(spark):
    rows = [(float(i * 3) + i / 9, d) for i, d in enumerate([None, 0.0, -1.0, 0.2, 1.0, 7.5, 40.0, 3.0, 3.0])]
    e = table(spark, rows, "latency double, duration double")
    for tr, p in ((2.0, (6, 16, 1, 1, 6, 0, 32)), (0.7, (5, 14, 1, 1.2, 4, 1, 20))):
        got = {(r["event_ix"], r["k"]): r["w"] for r in bases.hrfbasis(tr, p)._kernel(e, F.col("latency") - F.floor("latency"), F.col("duration")).collect()}
        want = {(i + 1, k): w for i, (lat, d) in enumerate(rows) for k, w in enumerate(hrf_kernel(int(np.rint((1 - (lat - math.floor(lat))) * 32)), tr, d, p))}
        assert got == {k: pytest.approx(w, abs=1e-9) for k, w in want.items()}


@pytest.mark.parametrize("unit", [1e-13, 1e-9, 1e6])
def test_robust_fits_do_not_depend_on_the_unit(spark, unit):
    rng = np.random.default_rng(10)
    v = rng.uniform(0, 100, 200)
    rows = [(1, 0, i + 1, float((2 + 3 * x + rng.normal() + (400 if i % 9 == 0 else 0)) * unit)) for i, x in enumerate(v)]
    e, epochs = table(spark, [(float(x),) for x in v], "x double"), spark.createDataFrame(rows, "channel int, time_ix int, event_ix long, y double")
    x, y = np.c_[np.ones(200), v], np.array([r[3] for r in rows])
    want = sv.reweighted(x, y / unit, sv.biweight())
    for most in (1000, 10):
        got = {r["coefname"]: r["estimate"] / unit for r in sv.robust("0 ~ 1 + x", e, epochs, most_rows=most).collect()}
        assert [got["(Intercept)"], got["x"]] == pytest.approx(want, rel=1e-7)


def test_wide_designs_are_iterated(spark, monkeypatch):
    rng = np.random.default_rng(7)
    e = table(spark, [(float(rng.integers(5, 400)), "a", float(rng.normal())) for _ in range(80)], "latency double, event string, v double")
    y = spark.createDataFrame([(c, i, float(v)) for c in (1, 2) for i, v in enumerate(rng.normal(size=420), 1)], "channel int, sample long, y double")
    design = [("a", ("0 ~ 1 + v", bases.fir((-2.0, 6.0), 1.0)))]
    want = {(r["channel"], r["col_ix"]): r["estimate"] for r in sv.fit(design, e, y).coefs.collect()}
    monkeypatch.setattr(sv, "MOST_COLUMNS", 5)
    assert {(r["channel"], r["col_ix"]): r["estimate"] for r in sv.fit(design, e, y).coefs.collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    with pytest.raises(ValueError):
        sv.fit(design, e, y, solver="qr")
    errors = {(r["channel"], r["col_ix"]): r["stderror"] for r in sv.fit(design, e, y, stderror=True).coefs.collect()}
    monkeypatch.undo()
    assert errors == {(r["channel"], r["col_ix"]): pytest.approx(r["stderror"], rel=1e-6) for r in sv.fit(design, e, y, stderror=True).coefs.collect()}
    # two equal columns: no unique solution, but the fitted values are the same
    x = sv.fit(design, e, y, design_only=True).design_matrix().where("col_ix < 9")
    twice = dm.combined(x, x, 9)
    b = sv.fit_design(twice, y, [str(i) for i in range(18)], solver="lsmr")
    left = sv.fit_design(x, y, [str(i) for i in range(9)])
    both = lambda df: {(r["channel"], r["k"]): r["b"] for r in df.groupBy("channel", (F.col("col_ix") % 9).alias("k")).agg(F.sum("estimate").alias("b")).collect()}
    assert both(b) == {k: pytest.approx(v, abs=1e-6) for k, v in both(left).items()}


def test_copying_by_a_function(spark):
    e = table(spark, [(10.0, "S", 1.0), (12.0, "R", 2.0), (14.0, "R", 3.0), (40.0, "R", 4.0)], "latency double, event string, rt double")
    last = lambda lat, lats: F.size(lats) - 1
    assert {r["event_ix"]: r["got"] for r in ev.copy_eventinfo(e, "S", "R", "rt", "got", search=last, within=5.0).collect()} == {1: None, 2: None, 3: 1.0, 4: None}
    never = lambda lat, lats: F.lit(None).cast("int")
    assert ev.copy_eventinfo(e, "S", "R", "rt", "got", search=never, within=5.0).where("got is not null").count() == 0
    # without a distance all targets are seen
    assert {r["event_ix"]: r["got"] for r in ev.copy_eventinfo(e, "S", "R", "rt", "got", search=last).collect()} == {1: None, 2: None, 3: None, 4: 1.0}
    with pytest.raises(ValueError):
        ev.copy_eventinfo(e, "S", "R", "rt", "got", search="closest", within=1.0)


def test_copying_by_a_function_that_settles(spark):
    rng = np.random.default_rng(11)
    rows = [(i + 1, float(x), "SR"[int(rng.integers(2))], float(i), "ab"[i % 2]) for i, x in enumerate(np.cumsum(rng.exponential(1, 200) * (rng.random(200) < 0.9) * rng.choice([1, 50], 200)))]
    e = spark.createDataFrame(rows, "event_ix long, latency double, event string, rt double, g string")
    third = lambda lat, lats: F.size(F.filter(lats, lambda t: t <= lat)) + 2
    settled = lambda lat, lats, reach: F.size(F.filter(lats, lambda t: t > lat)) >= 3
    want: dict[int, tuple] = {}
    for ix, lat, event, rt, g in rows:
        after = sorted((l2, i2) for i2, l2, e2, _, g2 in rows if e2 == "R" and g2 == g and l2 > lat)
        if event == "S" and len(after) >= 3:
            want[after[2][1]] = max(want.get(after[2][1], (-1.0, 0, 0.0)), (lat, ix, rt))
    for options in ({"settled": settled}, {}):
        got = ev.copy_eventinfo(e, "S", "R", "rt", "got", search=third, group="g", **options).where("got is not null").collect()
        assert {r["event_ix"]: r["got"] for r in got} == {i: w[2] for i, w in want.items()}


def test_clear_errors(spark):
    e = table(spark, [(float(5 + 9 * i), "ab"[i % 2]) for i in range(9)], "latency double, event string")
    y = boxes(spark, [], 100, 1)
    m = sv.fit([(k, ("0 ~ 1", bases.fir((0.0, 2.0), 1.0))) for k in "ab"], e, y)
    for wrong in ({"keep": ["x"]}, {"exclude": ["a", "b"]}):
        with pytest.raises(ValueError):
            pr.predict(m, **wrong)
    with pytest.raises(ValueError):
        Schema.fit("0 ~ 1 + c", spark.range(3000).selectExpr("id event_ix", "cast(id as string) c"))
    late = spark.sql("select timestamp'2024-01-01 01:00:00' ts, 1.0 v")
    with pytest.raises(Exception, match="beyond the grid"):
        sg.gridded(late, "ts", F.col("v"), 1704067200000000, 60_000_000, 30).collect()


def test_models_describe_themselves(spark):
    e = table(spark, [(float(5 + 9 * i), "ab"[i % 2], "uv"[i % 2], float(i)) for i in range(9)], "latency double, event string, c string, v double")
    m = sv.fit([("a", ("0 ~ 1 + v", bases.fir((0.0, 2.0), 1.0))), ("b", ("0 ~ 1 + c", bases.fir((0.0, 1.0), 1.0)))], e, boxes(spark, [], 100, 1), design_only=True)
    lines = m.describe().split("\n")
    assert lines[0] == "deconvolution model, 8 columns" and lines[1] == "  a: 0 ~ 1 + v, Fir of 3 columns, 1 samples a second" and lines[2:4] == ["    (Intercept): column 0 to 2", "    v: column 3 to 5"]
    assert lines[-1] == "    c: dummy coding of v" and "b: 0 ~ 1 + c" in lines[4]


def test_csv_lines_of_many_parts(spark, tmp_path):
    (tmp_path / "many.csv").write_text("".join(f"{i},{i + 0.5}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    got = {(r["channel"], r["sample"]): r["y"] for r in sg.signal_from_csv(spark, str(tmp_path / "many.csv")).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(i + 1, k + 1): i + 0.5 * k for i in range(500) for k in range(2)}
