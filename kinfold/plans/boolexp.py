"""Boolean expressions over any atoms: and, or, not; mapping, search and evaluation on the driver."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

AND, OR, NOT, ATOM = "and", "or", "not", "atom"


@dataclass(frozen=True)
class BoolExp:
    op: str
    left: Any
    right: Any = None

    @staticmethod
    def atom(value: Any) -> BoolExp:
        return BoolExp(ATOM, value)

    @staticmethod
    def of(x: Any) -> BoolExp:
        if isinstance(x, BoolExp):
            return x
        return x.exp if hasattr(x, "exp") else BoolExp.atom(x)

    def and_(self, other: Any) -> BoolExp:
        return BoolExp(AND, self, BoolExp.of(other))

    def or_(self, other: Any) -> BoolExp:
        return BoolExp(OR, self, BoolExp.of(other))

    def not_(self) -> BoolExp:
        return BoolExp(NOT, self)

    @staticmethod
    def all(*values: Any) -> BoolExp | None:
        """And of the values that are not None; None if there are none."""
        return _chain(AND, values)

    @staticmethod
    def any(*values: Any) -> BoolExp | None:
        return _chain(OR, values)

    def atoms(self) -> Iterator[Any]:
        if self.op == ATOM:
            yield self.left
        else:
            yield from self.left.atoms()
            if self.right is not None:
                yield from self.right.atoms()

    def map(self, f: Callable[[Any], Any]) -> BoolExp:
        """Replace each atom; f may return an expression."""
        if self.op == ATOM:
            return BoolExp.of(f(self.left))
        return BoolExp(self.op, self.left.map(f), self.right.map(f) if self.right is not None else None)

    def find(self, f: Callable[[Any], bool]) -> Any | None:
        return next((a for a in self.atoms() if f(a)), None)

    def conjuncts(self) -> list[BoolExp]:
        """The parts of a top-level conjunction; a one-armed one is its left."""
        if self.op == AND:
            return self.left.conjuncts() + (self.right.conjuncts() if self.right is not None else [])
        if self.op == OR and self.right is None:
            return self.left.conjuncts()
        return [self]

    def fold(self, atom: Callable, both: Callable, either: Callable, negate: Callable) -> Any:
        if self.op == ATOM:
            return atom(self.left)
        x = self.left.fold(atom, both, either, negate)
        if self.op == NOT:
            return negate(x)
        if self.right is None:
            return x
        return (both if self.op == AND else either)(x, self.right.fold(atom, both, either, negate))

    def evaluate(self, test: Callable[[Any], bool], inverse: bool = False) -> tuple[bool, list[Any]]:
        """(value, atoms that made it false) with two truth values; negation is pushed to the atoms."""
        if self.op == ATOM:
            ok = bool(test(self.left)) != inverse
            return ok, [] if ok else [self.left]
        if self.op == NOT:
            return self.left.evaluate(test, not inverse)
        a, trail = self.left.evaluate(test, inverse)
        if self.right is None:
            return a, trail
        if (self.op == AND) != inverse:
            return self.right.evaluate(test, inverse) if a else (False, trail)
        if a:
            return True, []
        b, more = self.right.evaluate(test, inverse)
        return b, [] if b else trail + more

    def to_dict(self) -> dict:
        if self.op == ATOM:
            return {"op": ATOM, "value": self.left.to_dict() if hasattr(self.left, "to_dict") else self.left}
        return {"op": self.op, "left": self.left.to_dict(), **({"right": self.right.to_dict()} if self.right is not None else {})}

    @staticmethod
    def from_dict(d: dict, atom: Callable[[Any], Any] = lambda v: v) -> BoolExp:
        if d["op"] == ATOM:
            return BoolExp.atom(atom(d["value"]))
        return BoolExp(d["op"], BoolExp.from_dict(d["left"], atom), BoolExp.from_dict(d["right"], atom) if "right" in d else None)

    @staticmethod
    def parse(text: str) -> BoolExp:
        """Names joined by && || ! and parentheses; each name is an atom."""
        tree = ast.parse(text.replace("&&", " and ").replace("||", " or ").replace("!", " not ").strip(), mode="eval").body

        def walk(n: ast.AST) -> BoolExp:
            if isinstance(n, ast.BoolOp):
                out = walk(n.values[0])
                for v in n.values[1:]:
                    out = out.and_(walk(v)) if isinstance(n.op, ast.And) else out.or_(walk(v))
                return out
            if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
                return walk(n.operand).not_()
            if isinstance(n, ast.Name):
                return BoolExp.atom(n.id)
            raise ValueError(f"not a boolean expression: {text}")

        return walk(tree)


def _chain(op: str, values: tuple) -> BoolExp | None:
    out = None
    for v in values:
        if v is not None:
            out = BoolExp.of(v) if out is None else BoolExp(op, out, BoolExp.of(v))
    return out
