"""The formula language: blocks of `name = expression` lines lowered to Catalyst columns.

From weakest to strongest: comparisons (left to right), + and -, * and /, ** (right to left), a sign, and what stands alone:
numbers, names, $parameters, calls and parentheses. A sign binds tighter than **, so -2**2 is 4. Nothing runs row by row: a
block becomes one projection for each step of its dependency order.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, NotFound, ParseFailure
from . import ieee

TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<param>\$[A-Za-z_]\w*)|(?P<name>[A-Za-z_]\w*)|(?P<op>\*\*|[=!<>]=|[-+*/()<>,]))")
#: Function -> number of arguments.
ARITY = {"sqrt": 1, "abs": 1, "exp": 1, "log": 1, "log10": 1, "pow": 2, "min": 2, "max": 2, "clip": 3, "if": 3}
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")

Node = tuple


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ParseFailure(f"unexpected {text[at:].strip()[:1]!r} in {text!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.text, self.rest = text, tokens(text)[::-1]

    def peek(self, *ops: str) -> bool:
        return bool(self.rest) and self.rest[-1][0] == "op" and self.rest[-1][1] in ops

    def expect(self, op: str) -> None:
        if not self.peek(op):
            raise ParseFailure(f"expected {op!r} in {self.text!r}")
        self.rest.pop()

    def whole(self) -> Node:
        node = self.comparison()
        if self.rest:
            raise ParseFailure(f"unexpected {self.rest[-1][1]!r} in {self.text!r}")
        return node

    def _left(self, below, *ops: str) -> Node:
        node = below()
        while self.peek(*ops):
            node = ("op", self.rest.pop()[1], node, below())
        return node

    def comparison(self) -> Node:
        return self._left(self.total, *COMPARISONS)

    def total(self) -> Node:
        return self._left(self.product, "+", "-")

    def product(self) -> Node:
        return self._left(self.power, "*", "/")

    def power(self) -> Node:
        node = self.signed()
        if self.peek("**"):
            self.rest.pop()
            return ("op", "**", node, self.power())
        return node

    def signed(self) -> Node:
        if self.peek("+", "-"):
            return ("sign", self.rest.pop()[1], self.signed())
        return self.alone()

    def alone(self) -> Node:
        if not self.rest:
            raise ParseFailure(f"{self.text!r} ends too early")
        kind, value = self.rest.pop()
        if kind == "num":
            return ("num", float(value))
        if kind == "param":
            return ("param", value[1:])
        if kind == "name" and self.peek("("):
            self.rest.pop()
            arguments = []
            if not self.peek(")"):
                arguments.append(self.comparison())
                while self.peek(","):
                    self.rest.pop()
                    arguments.append(self.comparison())
            self.expect(")")
            if value not in ARITY:
                raise ParseFailure(f"unknown function {value!r}")
            if len(arguments) != ARITY[value]:
                raise ParseFailure(f"{value} takes {ARITY[value]} arguments, not {len(arguments)}")
            return ("call", value, *arguments)
        if kind == "name":
            return ("name", value)
        if value == "(":
            node = self.comparison()
            self.expect(")")
            return node
        raise ParseFailure(f"unexpected {value!r} in {self.text!r}")


def parse(text: str) -> Node:
    return _Parser(text).whole()


def _leaves(node: Node, kind: str) -> list[str]:
    if node[0] == kind:
        return [node[1]]
    return list(dict.fromkeys(x for part in node[1:] if isinstance(part, tuple) for x in _leaves(part, kind)))


@dataclass(frozen=True)
class Assignment:
    """One line: the name on the left and the parsed right side."""

    lhs: str
    node: Node

    @classmethod
    def parse(cls, line: str) -> Assignment:
        # the first = that is no part of ==, !=, <= or >=
        m = re.search(r"(?<![=!<>])=(?!=)", line)
        if not m:
            raise ParseFailure(f"no assignment in {line!r}")
        name = line[: m.start()].strip()
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise ParseFailure(f"cannot assign to {name!r}")
        return cls(name, parse(line[m.end() :]))

    @property
    def variables(self) -> list[str]:
        return _leaves(self.node, "name")

    @property
    def params(self) -> list[str]:
        return _leaves(self.node, "param")


class FormulaBlock:
    """Assignments in any order; each may use columns, $parameters and the results of others, which hide columns of their name."""

    def __init__(self, assignments: list[Assignment]):
        self.assignments = assignments

    @classmethod
    def parse(cls, lines: str | list[str]) -> FormulaBlock:
        lines = lines.splitlines() if isinstance(lines, str) else lines
        return cls([Assignment.parse(x) for x in lines if x.strip() and not x.strip().startswith("#")])

    @property
    def outputs(self) -> list[str]:
        return [a.lhs for a in self.assignments]

    @property
    def params(self) -> list[str]:
        return list(dict.fromkeys(p for a in self.assignments for p in a.params))

    @property
    def property_dependencies(self) -> list[str]:
        """The columns that the block needs from its input."""
        own = set(self.outputs)
        return list(dict.fromkeys(v for a in self.assignments for v in a.variables if v not in own))

    @cached_property
    def evaluation_order(self) -> list[int]:
        """Dependencies first, else as written."""
        at = {}
        for k, a in enumerate(self.assignments):
            if a.lhs in at:
                raise InvalidArgument(f"{a.lhs} is assigned twice")
            at[a.lhs] = k
        needs = {k: {at[v] for v in a.variables if v in at} for k, a in enumerate(self.assignments)}
        order: list[int] = []
        ready = [k for k in needs if not needs[k]]
        while ready:
            done = ready.pop(0)
            order.append(done)
            for k, rest in needs.items():
                if done in rest:
                    rest.discard(done)
                    if not rest:
                        ready.append(k)
        if len(order) < len(self.assignments):
            raise InvalidArgument("the assignments depend on each other in a circle")
        return order

    def evaluate(self, df: DataFrame, params: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
        """df's columns in `keep` and the outputs."""
        params = params or {}
        for name in self.params:
            if name not in params:
                raise NotFound(f"parameter ${name} is missing")
            if not math.isfinite(params[name]):
                raise InvalidArgument(f"parameter ${name} is not finite")
        for name in self.property_dependencies:
            if name not in df.columns:
                raise NotFound(f"column {name} is missing")
        done: dict[str, str] = {}
        out = df
        # one projection for all assignments whose inputs are there, so that chains of names do not multiply expressions
        todo = list(self.evaluation_order)
        while todo:
            step = [k for k in todo if all(v in done for v in self.assignments[k].variables if v in self.outputs)]
            out = out.select("*", *[lower(self.assignments[k].node, lambda n: F.col(done.get(n, f"`{n}`")), params).alias(f"_formula_{k}") for k in step])
            done |= {self.assignments[k].lhs: f"_formula_{k}" for k in step}
            todo = [k for k in todo if k not in step]
        return out.select(*(keep or []), *[F.col(done[name]).alias(name) for name in self.outputs])


def lower(node: Node, column, params: dict[str, float]) -> Column:
    """A parsed expression as a DOUBLE column. column: name -> Column."""
    kind = node[0]
    if kind == "num":
        return F.lit(node[1])
    if kind == "param":
        return F.lit(float(params[node[1]]))
    if kind == "name":
        return ieee.num(column(node[1]))
    if kind == "sign":
        inner = lower(node[2], column, params)
        return -inner if node[1] == "-" else inner
    arguments = [lower(x, column, params) for x in node[2:]]
    if kind == "op":
        a, b = arguments
        if node[1] in COMPARISONS:
            return ieee.compare(node[1], a, b)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: ieee.div(a, b), "**": lambda: F.pow(a, b)}[node[1]]()
    calls = {"sqrt": F.sqrt, "abs": F.abs, "exp": F.exp, "log": ieee.ln, "log10": ieee.log10, "pow": F.pow, "min": ieee.minimum, "max": ieee.maximum, "clip": ieee.clip, "if": ieee.choose}
    return calls[node[1]](*arguments)


def formula_info(text: str) -> dict:
    """Name, columns and parameters of one line."""
    a = Assignment.parse(text)
    return {"lhs": a.lhs, "variables": a.variables, "params": a.params}


def evaluate_formulas(df: DataFrame, lines: str | list[str], params: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    return FormulaBlock.parse(lines).evaluate(df, params, keep)
