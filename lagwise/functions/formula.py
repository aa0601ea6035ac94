"""Formulas: terms of an event's predictors, coded as columns under a schema that is learned once and kept."""

from __future__ import annotations

import ast
import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.functions.splines import Spline
from lagwise.operators.events import require_complete

#: Levels of a categorical predictor, each of which is a column of the design.
MOST_LEVELS = 1000
FUNCTIONS = {"log": F.log, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs, "sin": F.sin, "cos": F.cos}


@dataclass(frozen=True)
class Numeric:
    """An arithmetic expression of columns."""

    text: str

    def tree(self) -> ast.expr:
        return ast.parse(self.text, mode="eval").body

    def variables(self) -> list[str]:
        return sorted({n.id for n in ast.walk(self.tree()) if isinstance(n, ast.Name) and n.id not in FUNCTIONS})

    def column(self) -> Column:
        def of(n: ast.expr) -> Column:
            if isinstance(n, ast.Constant):
                return F.lit(float(n.value))
            if isinstance(n, ast.Name):
                return F.col(n.id).cast("double")
            if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
                return -of(n.operand)
            if isinstance(n, ast.Call) and n.func.id in FUNCTIONS and len(n.args) == 1:
                return FUNCTIONS[n.func.id](of(n.args[0]))
            if isinstance(n, ast.BinOp):
                a, b = of(n.left), of(n.right)
                ops = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b, ast.Pow: lambda: F.pow(a, b)}
                return ops[type(n.op)]()
            raise ValueError(f"unknown function term: {ast.unparse(n)}")

        return of(self.tree())


def parse(text: str) -> list[tuple]:
    """Terms of "0 ~ rhs" in order; a term is a tuple of names, Numeric and Spline; () is the intercept."""
    left, _, right = text.partition("~")
    if left.strip() != "0":
        raise ValueError("a formula begins with 0 ~")
    tree = ast.parse(right.replace("^", "**").replace("&", "@").strip(), mode="eval").body
    intercept: list[bool | None] = [None]

    def atom(n: ast.expr):
        if isinstance(n, ast.Name):
            return n.id
        if isinstance(n, ast.Call) and n.func.id in ("spl", "circspl"):
            args = [ast.literal_eval(a) for a in n.args[1:]]
            return Spline(n.args[0].id, int(args[0]), *(float(a) for a in args[1:]))
        return Numeric(ast.unparse(n))

    def terms(n: ast.expr) -> list[tuple]:
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add):
            return terms(n.left) + terms(n.right)
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Mult):
            a, b = terms(n.left), terms(n.right)
            return a + b + [x + y for x in a for y in b]
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.MatMult):
            return [x + y for x in terms(n.left) for y in terms(n.right)]
        if isinstance(n, ast.Constant) and n.value in (0, 1):
            intercept[0] = bool(n.value)
            return []
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.BitOr):
            raise ValueError("random effects are not supported")
        return [(atom(n),)]

    rest = terms(tree)
    rest = [t for i, t in enumerate(rest) if t not in rest[:i]]
    rest.sort(key=len)  # main effects before interactions; stable
    return ([()] if intercept[0] is not False else []) + rest


def contrast(kind, levels: list) -> tuple[list[str], list[list[float]]]:
    """Names and, for each name, its value at each level. kind: dummy, effects, helmert, full, or a dict of names to values by level."""
    k = len(levels)
    if isinstance(kind, dict):
        return [str(n) for n in kind], [[float(v[x]) for x in levels] for v in kind.values()]
    if kind == "full":
        return [str(x) for x in levels], [[float(i == j) for j in range(k)] for i in range(k)]
    names = [str(x) for x in levels[1:]]
    if kind == "dummy":
        return names, [[float(j == i) for j in range(k)] for i in range(1, k)]
    if kind == "effects":
        return names, [[1.0 if j == i else -1.0 if j == 0 else 0.0 for j in range(k)] for i in range(1, k)]
    if kind == "helmert":
        return names, [[float(i) if j == i else -1.0 if j < i else 0.0 for j in range(k)] for i in range(1, k)]
    raise ValueError(f"unknown contrast {kind!r}")


@dataclass
class Schema:
    """A formula with what was learned from the events: levels of categorical predictors and breaks of splines."""

    formula: str
    levels: dict[str, list] = field(default_factory=dict)
    contrasts: dict[str, object] = field(default_factory=dict)
    breaks: dict[str, list[float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, formula: str, events: DataFrame, contrasts: dict | None = None) -> "Schema":
        """One aggregation over the events; missing values in predictors that are used are an error."""
        terms = parse(formula)
        atoms = list(dict.fromkeys(a for t in terms for a in t))
        used = sorted({v for a in atoms for v in (a.variables() if isinstance(a, Numeric) else [a.var if isinstance(a, Spline) else a])})
        for v in used:
            if v not in events.columns:
                raise ValueError(f"events have no column {v!r}")
        require_complete(events, used)
        types = {f.name: f.dataType for f in events.schema.fields}
        named = [a for a in atoms if isinstance(a, str)]
        categorical = [a for a in named if isinstance(types[a], (T.StringType, T.BooleanType)) or a in (contrasts or {})]
        splines = [a for a in atoms if isinstance(a, Spline) and not a.circular]
        if categorical:
            n = events.agg(*[F.approx_count_distinct(a).alias(a) for a in categorical]).first()
            if wide := {a: n[a] for a in categorical if n[a] > MOST_LEVELS}:
                raise ValueError(f"categorical predictors of more than {MOST_LEVELS} levels: {wide}")
        aggs = [F.sort_array(F.collect_set(a)).alias(f"l_{a}") for a in categorical] + [F.percentile(F.col(s.var).cast("double"), s.quantiles()).alias(f"b_{i}") for i, s in enumerate(splines)]
        row = events.agg(*aggs).first() if aggs else {}
        return cls(formula, {a: list(row[f"l_{a}"]) for a in categorical}, {a: (contrasts or {}).get(a, "dummy") for a in categorical}, {f"{s.var},{s.df}": list(row[f"b_{i}"]) for i, s in enumerate(splines)})

    def _atom(self, a, full: bool) -> list[tuple[str, Column]]:
        if isinstance(a, Numeric):
            return [(a.text.replace(" ** ", " ^ "), a.column())]
        if isinstance(a, Spline):
            return (a if a.circular else a.fitted(self.breaks[f"{a.var},{a.df}"])).columns()
        if a not in self.levels:
            return [(a, F.col(a).cast("double"))]
        names, values = contrast("full" if full else self.contrasts[a], self.levels[a])
        out = []
        for n, v in zip(names, values):
            c = F.lit(0.0)
            for level, x in zip(self.levels[a], v):
                if x:
                    c = F.when(F.col(a) == F.lit(level), F.lit(x)).otherwise(c)
            out.append((f"{a}: {n}", c))
        return out

    def columns(self) -> list[tuple[str, Column]]:
        """Coefficient names and their predictors. A categorical part is coded in full where the term without it is not in the formula."""
        terms = parse(self.formula)
        there = {frozenset(map(str, t)) for t in terms}
        out: list[tuple[str, Column]] = []
        for t in terms:
            if not t:
                out.append(("(Intercept)", F.lit(1.0)))
                continue
            parts = [self._atom(a, isinstance(a, str) and a in self.levels and frozenset(map(str, t)) - {a} not in there) for a in t]
            for combo in itertools.product(*reversed(parts)):
                combo = combo[::-1]
                c = combo[0][1]
                for _, x in combo[1:]:
                    c = c * x
                out.append((" & ".join(n for n, _ in combo), c))
        return out

    def names(self) -> list[str]:
        return [n for n, _ in self.columns()]

    def design(self, events: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """event_ix, the columns of keep, and x: the predictors as an array; null where a spline is out of its range."""
        cols = [c for _, c in self.columns()]
        x = F.array(*cols)
        return events.select("event_ix", *(keep or []), F.when(F.exists(x, lambda v: v.isNull()), None).otherwise(x).alias("x"))

    def meta(self) -> dict:
        return {"formula": self.formula, "levels": self.levels, "contrasts": self.contrasts, "breaks": self.breaks}
