"""Symbolic expressions: arithmetic, comparison, solving for one variable; they evaluate to numbers or compile to Columns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two sides are equal within this.
TOLERANCE = 1e-10


@dataclass(frozen=True)
class Expression:
    op: str
    args: tuple

    @staticmethod
    def number(v: float) -> Expression:
        return Expression("number", (float(v),))

    @staticmethod
    def variable(name: str) -> Expression:
        return Expression("variable", (name,))

    @staticmethod
    def of(x: Any) -> Expression:
        return x if isinstance(x, Expression) else Expression.variable(x) if isinstance(x, str) else Expression.number(x)

    def _with(self, op: str, other: Any) -> Expression:
        return Expression(op, (self, Expression.of(other)))

    def add(self, o: Any) -> Expression:
        return self._with("+", o)

    def subtract(self, o: Any) -> Expression:
        return self._with("-", o)

    def multiply(self, o: Any) -> Expression:
        return self._with("*", o)

    def divide(self, o: Any) -> Expression:
        return self._with("/", o)

    def power(self, o: Any) -> Expression:
        return self._with("^", o)

    def sqrt(self) -> Expression:
        return Expression("sqrt", (self,))

    __add__, __sub__, __mul__, __truediv__, __pow__ = add, subtract, multiply, divide, power

    def gt(self, o: Any) -> Comparison:
        return Comparison(">", self, Expression.of(o))

    def lt(self, o: Any) -> Comparison:
        return Comparison("<", self, Expression.of(o))

    def eq(self, o: Any) -> Comparison:
        return Comparison("=", self, Expression.of(o))

    def evaluate(self, values: dict[str, float] | None = None) -> float:
        """Raises KeyError for a missing variable and ZeroDivisionError for a division by zero."""
        if self.op == "number":
            return self.args[0]
        if self.op == "variable":
            return float((values or {})[self.args[0]])
        a = [x.evaluate(values) for x in self.args]
        return {"+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1], "/": lambda: a[0] / a[1], "^": lambda: a[0] ** a[1], "sqrt": lambda: a[0] ** 0.5}[self.op]()

    def column(self, columns: dict[str, Column]) -> Column:
        """The same as a Column; division by zero raises, as ANSI mode does."""
        if self.op == "number":
            return F.lit(self.args[0])
        if self.op == "variable":
            return columns[self.args[0]].cast("double")
        a = [x.column(columns) for x in self.args]
        return {"+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1], "/": lambda: a[0] / a[1], "^": lambda: F.pow(a[0], a[1]), "sqrt": lambda: F.sqrt(a[0])}[self.op]()

    def variables(self) -> set[str]:
        if self.op == "variable":
            return {self.args[0]}
        return set().union(*[x.variables() for x in self.args if isinstance(x, Expression)], set())


@dataclass(frozen=True)
class Comparison:
    op: str
    left: Expression
    right: Expression

    def evaluate(self, values: dict[str, float] | None = None) -> bool:
        a, b = self.left.evaluate(values), self.right.evaluate(values)
        return abs(a - b) < TOLERANCE if self.op == "=" else a > b if self.op == ">" else a < b

    def column(self, columns: dict[str, Column]) -> Column:
        a, b = self.left.column(columns), self.right.column(columns)
        return F.abs(a - b) < TOLERANCE if self.op == "=" else a > b if self.op == ">" else a < b

    def solve(self, **known: float) -> float | None:
        """The value of the one free variable at which both sides are equal; of several the smallest that isn't negative.

        The difference is read as a polynomial of degree up to 2, or as a * x^p + b; None if it never vanishes."""
        free = (self.left.variables() | self.right.variables()) - set(known)
        if len(free) != 1:
            raise ValueError(f"one variable must be free, not {sorted(free)}")
        x = free.pop()
        d = lambda v: self.left.evaluate({**known, x: v}) - self.right.evaluate({**known, x: v})
        roots = _roots(d)
        good = [r for r in roots if r >= -TOLERANCE] or roots
        return max(0.0, min(good)) if good and min(good) > -TOLERANCE else min(good) if good else None


def _roots(d) -> list[float]:
    try:
        c = d(0.0)
        p, m = d(1.0), d(-1.0)
        a, b = (p + m) / 2 - c, (p - m) / 2
        if all(abs(a * v * v + b * v + c - d(v)) <= 1e-6 * max(1.0, abs(d(v))) for v in (2.0, 3.0, 0.5)):
            if abs(a) < TOLERANCE:
                return [-c / b] if abs(b) > TOLERANCE else []
            s = b * b - 4 * a * c
            return sorted([(-b - s**0.5) / (2 * a), (-b + s**0.5) / (2 * a)]) if s >= 0 else []
    except (ZeroDivisionError, ValueError, TypeError):
        pass
    lo, hi = 1e-12, 1.0  # monotone on the positive side: bracket and halve
    try:
        while isinstance(d(hi), float) and d(lo) * d(hi) > 0 and hi < 1e15:
            hi *= 2
        if d(lo) * d(hi) > 0:
            return []
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if d(lo) * d(mid) > 0 else (lo, mid)
        return [(lo + hi) / 2]
    except (ZeroDivisionError, TypeError):
        return []
