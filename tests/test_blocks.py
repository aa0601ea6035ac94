"""Least squares by blocks against numpy on dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.functions import basis as bases
from lagwise.operators import blocks
from lagwise.operators import design as dm
from lagwise.operators import solve as sv


def long(spark, x: np.ndarray, y: np.ndarray):
    cells = [(int(i) + 1, int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    signal = [(c + 1, i + 1, None if np.isnan(y[i, c]) else float(y[i, c])) for i in range(len(y)) for c in range(y.shape[1])]
    return spark.createDataFrame(cells, "sample long, col_ix int, x double").repartition(5), spark.createDataFrame(signal, "channel int, sample long, y double").repartition(7)


def random(seed: int, n: int, p: int, channels: int, fill: float = 0.3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, p)) * (rng.random((n, p)) < fill), rng.normal(size=(n, channels))


def test_cross_products(spark, monkeypatch):
    x, y = random(1, 1300, 9, 3)
    y[5, 1] = y[700, 0] = np.nan
    there = ~np.isnan(y).any(1)
    for kept, pairs in ((blocks.KEPT, blocks.PAIRS), (10, 100)):
        monkeypatch.setattr(blocks, "KEPT", kept)
        monkeypatch.setattr(blocks, "PAIRS", pairs)
        monkeypatch.setattr(blocks, "ROW", 8)
        cells, signal = long(spark, x, y)
        packed = blocks.pack(signal)
        assert packed.channels == [1, 2, 3] and packed.rows.count() == 3
        g, r = blocks.normal_equations(cells, packed, 9)
        assert g == pytest.approx(x[there].T @ x[there]) and r == pytest.approx(x[there].T @ y[there])
        got = {(a["channel"], a["col_ix"]): a["r"] for a in dm.cross(cells, signal).collect()}
        want = x.T @ np.nan_to_num(y)
        assert got == {(c + 1, j): pytest.approx(want[j, c]) for c in range(3) for j in range(9)}
        pairs_ = {(a["i"], a["j"]): a["g"] for a in dm.gram(cells).collect()}
        assert pairs_ == {(i, j): pytest.approx((x.T @ x)[i, j]) for i in range(9) for j in range(i, 9) if (x[:, i] * x[:, j]).any()}


def test_bidiagonalisation_solves_what_the_cross_products_cannot(spark):
    rng = np.random.default_rng(2)
    u, _ = np.linalg.qr(rng.normal(size=(900, 12)))
    v, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    x = u @ np.diag(np.logspace(0, -7, 12)) @ v.T  # a condition of 1e7
    true = rng.normal(size=(12, 2))
    y = x @ true
    cells, signal = long(spark, x, y)
    packed = blocks.pack(signal)
    assert np.linalg.cond(x / np.linalg.norm(x, axis=0)) > 1e6
    g, r = blocks.normal_equations(cells, packed, 12)
    wrong = sv.solve(g, r)
    good = blocks.lsmr(cells, packed, 12)
    assert np.abs(wrong - true).max() > 1e-3 > 1e-6 > np.abs(good - true).max()


def test_bidiagonalisation_with_a_rest_and_dependent_columns(spark):
    x, y = random(3, 1100, 7, 5)
    cells, signal = long(spark, x, y)
    packed = blocks.pack(signal)
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    assert blocks.lsmr(cells, packed, 7) == pytest.approx(want, abs=1e-9)
    assert blocks.lsmr(cells, packed, 7, held=14) == pytest.approx(want, abs=1e-9)  # two channels at a time
    x[:, 6] = x[:, 5]
    cells, _ = long(spark, x, y)
    scale = np.linalg.norm(x, axis=0)
    want = np.linalg.lstsq(x / scale, y, rcond=None)[0] / scale[:, None]
    assert blocks.lsmr(cells, packed, 7) == pytest.approx(want, abs=1e-9)
    nothing, _ = long(spark, np.zeros((3, 2)), np.zeros((3, 1)))
    assert (blocks.lsmr(nothing, packed, 2) == 0).all()
    with pytest.raises(RuntimeError, match="converge"):
        blocks.lsmr(cells, packed, 7, rounds=1)


@pytest.mark.parametrize("unit", [1.0, 1e-6, 1e-13, 1e9])
def test_units_of_predictors_and_signals_do_not_matter(unit):
    x, y = random(4, 300, 6, 2, 0.8)
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    x[:, 2] *= unit
    for solver in ("default", "cholesky", "pinv", "qr", "cg", "intern"):
        got = sv.solve(x.T @ x, x.T @ (y * unit), solver) / unit
        got[2] *= unit
        assert got == pytest.approx(want, rel=1e-7), solver
    x[:, 5] = x[:, 4]
    columns = x / np.linalg.norm(x, axis=0)
    for solver in ("default", "pinv"):  # what a singular design predicts doesn't depend on the columns' units
        got = x @ sv.solve(x.T @ x, x.T @ (y * unit), solver) / unit
        assert got == pytest.approx(columns @ np.linalg.lstsq(columns, y, rcond=None)[0], abs=1e-6)


def test_the_inverses_diagonal(spark):
    x, y = random(6, 1200, 40, 1)
    x[:, 3] *= 1e-6
    cells, signal = long(spark, x, np.where(np.arange(1200)[:, None] % 7, y, np.nan))
    there = np.arange(1200) % 7 != 0
    packed = blocks.pack(signal)
    want = np.diag(np.linalg.inv(x[there].T @ x[there]))
    assert blocks.inverse_diagonal(cells, packed, 40) == pytest.approx(want, rel=1e-7)
    assert blocks.inverse_diagonal(cells, packed, 40, held=800) == pytest.approx(want, rel=1e-7)  # 20 at once
    with pytest.raises(ValueError, match="empty"):
        blocks.inverse_diagonal(cells, packed, 41)


def test_many_series_at_once(spark):
    rng = np.random.default_rng(5)
    events = spark.createDataFrame([(i + 1, s, float(rng.integers(1, 600)), float(rng.normal())) for i, s in enumerate(rng.integers(0, 12, 700).tolist())], "event_ix long, subject long, latency double, v double")
    signal = spark.createDataFrame([(c, int(s), t, float(rng.normal())) for s in range(12) for c in (1, 4) for t in range(1, 701)], "channel int, subject long, sample long, y double")
    design = [(dm.ANY, ("0 ~ 1 + v", bases.fir((0.0, 3.0), 1.0)))]
    got = {(r["subject"], r["channel"], r["col_ix"]): r["estimate"] for r in sv.fit_series(design, events, signal.unionByName(signal.limit(5).withColumn("subject", F.lit(None).cast("long"))), "subject").collect()}
    assert len(got) == 12 * 2 * 8
    for s in (0, 7):
        own = sv.fit(design, events.where(F.col("subject") == s), signal.where(F.col("subject") == s)).coefs.collect()
        assert {(s, r["channel"], r["col_ix"]): pytest.approx(r["estimate"], abs=1e-9) for r in own} == {k: v for k, v in got.items() if k[0] == s}
