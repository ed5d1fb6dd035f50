"""APPLY and FILTER expressions: one comparison at most, arithmetic with precedence, a few functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.values import Value, compare, divide

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<field>@[\w.]+)|(?P<name>[A-Za-z_][\w.]*)|(?P<op>!=|>=|<=|==|[=<>+\-*/(),]))""")

_NUMBERS: dict[str, Callable[[Column], Column]] = {
    "sqrt": F.sqrt,
    "abs": F.abs,
    "floor": lambda x: F.floor(x).cast("double"),
    "ceil": lambda x: F.ceil(x).cast("double"),
}
_STRINGS: dict[str, Callable[[Column], Column]] = {"lower": F.lower, "tolower": F.lower, "upper": F.upper, "toupper": F.upper}


class ExpressionError(ValueError):
    pass


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"cannot read {source[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Compiler:
    """Compiles over named columns: name -> (column, Spark type)."""

    def __init__(self, fields: Mapping[str, tuple[Column, str]]):
        self.fields = fields

    def compile(self, source: str) -> Value:
        self.rest = _tokens(source)
        value = self._comparison()
        if self.rest:
            raise ExpressionError(f"unexpected {self.rest[0][1]!r} in {source!r}")
        return value

    def condition(self, source: str) -> Column:
        value = self.compile(source)
        return value.text if value.constant == "condition" else value.truthy()

    def _peek(self) -> str:
        return self.rest[0][1] if self.rest and self.rest[0][0] == "op" else ""

    def _comparison(self) -> Value:
        left = self._sum()
        if self._peek() in ("!=", ">=", "<=", "==", "=", ">", "<"):
            op = self.rest.pop(0)[1]
            held = compare(op, left, self._sum())
            return Value(held, held.cast("double"), False, "condition")
        return left

    def _chain(self, part: Callable[[], Value], ops: dict[str, Callable]) -> Value:
        left = part()
        while self._peek() in ops:
            op = self.rest.pop(0)[1]
            left = Value.computed(ops[op](left.num, part().num))
        return left

    def _sum(self) -> Value:
        return self._chain(self._product, {"+": lambda a, b: a + b, "-": lambda a, b: a - b})

    def _product(self) -> Value:
        return self._chain(self._unary, {"*": lambda a, b: a * b, "/": divide})

    def _unary(self) -> Value:
        if self._peek() == "-":
            self.rest.pop(0)
            return Value.computed(-self._unary().num)
        return self._atom()

    def _atom(self) -> Value:
        if not self.rest:
            raise ExpressionError("an expression ends too early")
        kind, text = self.rest.pop(0)
        if kind == "num":
            return Value.number(float(text))
        if kind == "str":
            return Value.string(re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind == "field" or kind == "name" and self._peek() != "(":
            name = text.removeprefix("@")
            if name in self.fields:
                return Value.column(*self.fields[name], missing=text)
            return Value.string(text)  # an unknown name stands for itself
        if kind == "name":
            self.rest.pop(0)
            args = []
            while self._peek() != ")":
                args.append(self._comparison())
                if self._peek() == ",":
                    self.rest.pop(0)
                elif self._peek() != ")":
                    raise ExpressionError(f"a bracket of {text} is not closed")
            self.rest.pop(0)
            return self._call(text.lower(), args)
        if text == "(":
            value = self._comparison()
            if self._peek() != ")":
                raise ExpressionError("a bracket is not closed")
            self.rest.pop(0)
            return value
        raise ExpressionError(f"unexpected {text!r}")

    def _call(self, name: str, args: list[Value]) -> Value:
        if name in _NUMBERS and len(args) == 1:
            return Value.computed(_NUMBERS[name](args[0].num))
        if name in _STRINGS and len(args) == 1:
            text = _STRINGS[name](args[0].text)
            return Value(text, F.lit(None).cast("double"))
        raise ExpressionError(f"no function {name} of {len(args)} arguments")
