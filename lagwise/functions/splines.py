"""Cubic B-spline predictors as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = 4


def linspace(a: float, b: float, n: int) -> list[float]:
    return [a + (b - a) * i / (n - 1) for i in range(n)]


def clamped(breaks: list[float]) -> list[float]:
    return [breaks[0]] * (ORDER - 1) + list(breaks) + [breaks[-1]] * (ORDER - 1)


def periodic(breaks: list[float]) -> list[float]:
    """Knots that go on beyond both ends with the same spacing."""
    period = breaks[-1] - breaks[0]
    return [x - period for x in breaks[-ORDER:-1]] + list(breaks) + [x + period for x in breaks[1:ORDER]]


def _value(x: float, t: list[float], span: int) -> list[float]:
    """The four functions that are not zero between t[span] and t[span + 1], at x: those of number span - 3 to span (triangular recurrence)."""
    n = [1.0]
    for d in range(1, ORDER):
        out, saved = [], 0.0
        for r in range(d):
            right, left = t[span + r + 1] - x, x - t[span + 1 + r - d]
            share = n[r] / (right + left)
            out.append(saved + right * share)
            saved = left * share
        n = [*out, saved]
    return n


def pieces(knots: list[float]) -> dict[int, list[tuple[float, float, list[float]]]]:
    """For each function its pieces: from, to, and a cubic's four coefficients in Bernstein's form: what it is at both ends is exact, so that zeros are."""
    at = np.array([0.0, 1 / 3, 2 / 3, 1.0])
    invert = np.linalg.inv(np.stack([(1 - at) ** 3, 3 * at * (1 - at) ** 2, 3 * at**2 * (1 - at), at**3], axis=1))
    out: dict[int, list] = {}
    for span in range(ORDER - 1, len(knots) - ORDER):
        a, b = knots[span], knots[span + 1]
        if a < b:
            values = np.array([_value(a + (b - a) * u, knots, span) for u in at])
            for i, c in enumerate(np.where(np.abs(invert @ values) < 1e-14, 0.0, invert @ values).T):
                out.setdefault(span - ORDER + 1 + i, []).append((a, b, c.tolist()))
    return out


def basis(x: Column, parts: list[tuple[float, float, list[float]]], closed: float | None = None) -> Column:
    """A function given by its pieces, in order; 0 elsewhere. closed: the last break, which belongs to the piece before it. The expression's size depends on
    the pieces (four where nothing is periodic), not on how many functions there are."""
    out = F.when(x < F.lit(parts[0][0]), F.lit(0.0))
    end = parts[0][0]
    for a, b, c in parts:
        if a > end:
            out = out.when(x < F.lit(a), F.lit(0.0))
        u, v, end = (x - F.lit(a)) / F.lit(b - a), (F.lit(b) - x) / F.lit(b - a), b
        cubic = v * v * (v * F.lit(c[0]) + u * F.lit(3 * c[1])) + u * u * (v * F.lit(3 * c[2]) + u * F.lit(c[3]))
        out = out.when(x <= F.lit(b) if b == closed else x < F.lit(b), cubic)
    return out.otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Spline:
    """spl(x, df) or, with low and high, circspl(x, df, low, high). breaks are learned for spl, given for circspl."""

    var: str
    df: int
    low: float | None = None
    high: float | None = None
    breaks: tuple[float, ...] = ()

    def __post_init__(self):
        if self.low is None and self.df < 4:
            raise ValueError("spl needs df of at least 4")

    @property
    def circular(self) -> bool:
        return self.low is not None

    def quantiles(self) -> list[float]:
        return linspace(0, 1, self.df - 2)

    def fitted(self, breaks) -> "Spline":
        return Spline(self.var, self.df, self.low, self.high, tuple(float(b) for b in breaks))

    def all_columns(self) -> list[Column]:
        """Before the middle one is dropped; null outside the breaks unless circular."""
        x = F.col(self.var).cast("double")
        if not self.circular:
            b = list(self.breaks)
            of = pieces(clamped(b))
            inside = (x >= F.lit(b[0])) & (x <= F.lit(b[-1]))
            return [F.when(inside, basis(x, of[i], b[-1])) if i in of else F.when(inside, F.lit(0.0)) for i in range(self.df)]
        breaks = linspace(self.low, self.high, self.df + 2)
        n, of = self.df + 1, pieces(periodic(breaks))
        w = F.pmod(x - F.lit(self.low), F.lit(self.high - self.low)) + F.lit(self.low)
        out = []
        for i in range(n):
            # functions that run over the end continue at the beginning: pieces of one place are added
            places: dict[tuple[float, float], np.ndarray] = {}
            for j in range(i, max(of) + 1, n):
                for a, b, c in of.get(j, []):
                    places[a, b] = places.get((a, b), 0) + np.array(c)
            out.append(basis(w, [(a, b, c.tolist()) for (a, b), c in sorted(places.items(), key=lambda p: p[0])]))
        return out

    def columns(self) -> list[tuple[str, Column]]:
        cols = self.all_columns()
        drop = math.ceil(len(cols) / 2) - 1
        end = f",{self.low}:{self.high})" if self.circular else ")"
        kept = [c for i, c in enumerate(cols) if i != drop]
        return [(f"{'circspl' if self.circular else 'spl'}({self.var},{i + 1}{end}", c) for i, c in enumerate(kept)]
