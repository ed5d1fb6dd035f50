"""String-first values: everything has a text, and a number where the text is one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number; Spark's cast alone would take padding and type suffixes too.
NUMBER = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|inf|Inf|infinity|Infinity|nan|NaN)$"
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_numeric(kind: str) -> bool:
    return kind in _NUMERIC or kind.startswith("decimal")


def to_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def number_text(x: Column) -> Column:
    """Whole numbers without decimals."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


@dataclass
class Value:
    """A compiled expression. num is null where the value is no number; fixed numbers are known at compile time."""

    text: Column
    num: Column
    numeric: bool = False  # a number wherever it is not null
    constant: float | str | None = None
    nullable: Column | None = None  # where the field is missing
    missing_text: str | None = None

    @staticmethod
    def number(x: float) -> Value:
        shown = str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))
        return Value(F.lit(shown), F.lit(float(x)), True, float(x))

    @staticmethod
    def string(s: str) -> Value:
        return Value(F.lit(s), to_number(F.lit(s)), False, s)

    @staticmethod
    def column(c: Column, kind: str, missing: str) -> Value:
        if kind == "computed":  # a result: where it is null, there was no number
            return Value(F.coalesce(number_text(c), F.lit("")), c, True)
        if is_numeric(kind):
            x = c.cast("double")
            return Value(F.coalesce(number_text(x), F.lit(missing)), x, True, None, c.isNull(), missing)
        s = c if kind == "string" else c.cast("string")
        return Value(F.coalesce(s, F.lit(missing)), to_number(s), False, None, c.isNull(), missing)

    @staticmethod
    def computed(x: Column) -> Value:
        return Value(number_text(x), x, True)

    def truthy(self) -> Column:
        if self.numeric:
            return F.coalesce(self.num != 0, F.lit(self.missing_text is not None))
        return F.coalesce((self.text != "") & (self.text != "0"), F.lit(False))


_OPS = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def compare(op: str, a: Value, b: Value) -> Column:
    """Numeric if both sides are numbers, else by text."""
    f = _OPS["==" if op == "=" else op]
    if a.numeric and b.numeric:
        if a.nullable is None and b.nullable is None:
            return f(a.num, b.num) & a.num.isNotNull() & b.num.isNotNull() if b.constant is None else f(a.num, b.num) & a.num.isNotNull()
        if b.constant is not None and a.missing_text is not None:  # keeps the comparison a predicate that scans can take
            by_text = f(a.missing_text, str(int(b.constant)) if float(b.constant).is_integer() else repr(b.constant))
            return f(a.num, b.num) | a.nullable if by_text else f(a.num, b.num) & ~a.nullable
    if isinstance(b.constant, str) and a.missing_text is not None and not a.numeric and op in ("==", "=", "!="):
        try:
            float(b.constant)
        except ValueError:
            return F.coalesce(f(a.text, b.text), F.lit(False))
    both = a.num.isNotNull() & b.num.isNotNull()
    return F.coalesce(F.when(both, f(a.num, b.num)).otherwise(f(a.text, b.text)), F.lit(False))


def divide(x: Column, y: Column) -> Column:
    """IEEE division: by zero it gives an infinity or NaN, never an error."""
    return F.when(y != 0, x / F.when(y != 0, y)).otherwise(
        F.when(x.isNull() | y.isNull(), F.lit(None)).when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    )
