"""The aggregation pipeline: load, apply, filter, group-by with reducers, sort, limit.

Steps run in the order they are added; sorting and the limit apply once, at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.values import Value, is_numeric, to_number
from quern.plans.expressions import Compiler
from quern.plans.index import Index, columns
from quern.plans.search import _matched

REDUCERS = ("COUNT", "COUNT_DISTINCT", "COUNT_DISTINCTISH", "SUM", "AVG", "MIN", "MAX", "FIRST_VALUE", "TOLIST")


def _typed(value: Value) -> Column:
    """Numbers stay numbers; everything else is text."""
    if value.constant == "condition":
        return value.num
    if value.numeric:
        return value.num
    return value.text


@dataclass(frozen=True)
class Reduce:
    kind: str
    argument: str | None = None
    name: str | None = None

    def __post_init__(self):
        if self.kind.upper() not in REDUCERS:
            raise ValueError(f"unknown reducer {self.kind}")

    def column(self, compiler: Compiler, ordinal: list[Column]) -> Column:
        kind = self.kind.upper()
        name = self.name or {"COUNT_DISTINCTISH": "count_distinct"}.get(kind, kind.lower())
        if kind == "COUNT":
            return F.count(F.lit(1)).alias(name)
        value = compiler.compile(self.argument)
        if kind.startswith("COUNT_DISTINCT"):
            return F.count_distinct(value.text).alias(name)
        if kind in ("SUM", "AVG", "MIN", "MAX"):
            f = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[kind]
            return F.coalesce(f(value.num), F.lit(0.0)).alias(name)
        place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(ordinal)])
        if kind == "FIRST_VALUE":
            return F.min_by(value.text, place).alias(name)
        pairs = F.sort_array(F.collect_list(F.struct(place.alias("o"), value.text.alias("x"))))
        return F.transform(pairs, lambda p: p["x"]).alias(name)


@dataclass(frozen=True)
class Pipeline:
    """aggregate(index, query).apply(...).group(...)...; ``frame()`` is the plan."""

    rows: DataFrame
    key: list[str]
    sorts: tuple[tuple[str, str], ...] = ()
    page: tuple[int, int] | None = None
    shown: tuple[str, ...] | None = None
    computed: frozenset[str] = field(default=frozenset())

    def _fields(self) -> dict[str, tuple[Column, str]]:
        return {n: (c, "computed" if n in self.computed else k) for n, (c, k) in columns(self.rows).items()}

    def load(self, *names: str | tuple[str, str]) -> Pipeline:
        """Fields to show, each with an alias if it is a pair; "*" for all."""
        if names == ("*",):
            return replace(self, shown=tuple(c for c in self.rows.columns if not c.startswith("__")))
        pairs = [(n.removeprefix("@"), n.removeprefix("@")) if isinstance(n, str) else (n[0].removeprefix("@"), n[1]) for n in names]
        missing = [(a, b) for a, b in pairs if a not in self.rows.columns]
        if missing:  # an unknown field is left out
            pairs = [p for p in pairs if p not in missing]
        rows = self.rows.withColumns({b: F.col(f"`{a}`") for a, b in pairs if a != b})
        return replace(self, rows=rows, shown=(self.shown or ()) + tuple(b for _, b in pairs))

    def apply(self, expression: str, name: str) -> Pipeline:
        value = Compiler(self._fields()).compile(expression)
        computed = self.computed | {name} if value.numeric else self.computed - {name}
        return replace(self, rows=self.rows.withColumn(name, _typed(value)), shown=(*(s for s in self.shown or () if s != name), name), computed=computed)

    def filter(self, expression: str) -> Pipeline:
        return replace(self, rows=self.rows.where(Compiler(self._fields()).condition(expression)))

    def group(self, keys: list[str], *reducers: Reduce) -> Pipeline:
        """Keys are text, missing ones empty. Without keys, one group if there is any row."""
        known = self._fields()
        names = [k.removeprefix("@") for k in keys]
        by = [F.coalesce(Value.column(*known[n], missing="").text, F.lit("")).alias(n) if n in known else F.lit("").alias(n) for n in names]
        compiler = Compiler(known)
        cols = [r.column(compiler, [F.col(f"`{k}`") for k in self.key]) for r in reducers]
        if names:
            rows = self.rows.groupBy(*by).agg(*cols) if cols else self.rows.select(*by).distinct()
        else:
            rows = self.rows.agg(*(cols or [F.count(F.lit(1)).alias("__n")]), F.count(F.lit(1)).alias("__rows")).where("__rows > 0").drop("__rows", "__n")
        return replace(self, rows=rows, key=names, shown=tuple(rows.columns), computed=frozenset())

    def sortby(self, *by: tuple[str, str] | str) -> Pipeline:
        return replace(self, sorts=self.sorts + tuple((b, "ASC") if isinstance(b, str) else b for b in by))

    def limit(self, offset: int, n: int) -> Pipeline:
        return replace(self, page=(offset, n))

    def total(self) -> DataFrame:
        """Rows before the limit."""
        return self.rows.agg(F.count(F.lit(1)).alias("total"))

    def frame(self) -> DataFrame:
        known, order = columns(self.rows), []
        for name, way in self.sorts:
            n = name.removeprefix("@")
            c, kind = known[n] if n in known else (F.lit(None).cast("string"), "string")
            number, text = (c.cast("double"), None) if is_numeric(kind) else (to_number(c.cast("string")), F.coalesce(c.cast("string"), F.lit("")))
            desc = way.upper() == "DESC"
            for x in (number, text):
                if x is not None:
                    order.append(x.desc_nulls_last() if desc else x.asc_nulls_first())
        rows = self.rows
        if order or self.page:
            rows = rows.orderBy(*order, *[F.col(f"`{k}`") for k in self.key])
        if self.page:
            rows = rows.offset(self.page[0]).limit(self.page[1]) if self.page[0] else rows.limit(self.page[1])
        return rows.select(*[F.col(f"`{c}`") for c in self.shown]) if self.shown else rows


def aggregate(index: Index, query: str, params: dict | None = None, **options) -> Pipeline:
    """A pipeline over the documents that match; __key is their id."""
    hits, plan = _matched(index, query, params, **options)
    hits = hits.drop(*plan.tokens).withColumn("__key", F.col(f"`{index.key}`"))
    return Pipeline(hits, ["__key"])


def cursor_page(frame: DataFrame, order: list[str], after: tuple | None, count: int = 1000) -> DataFrame:
    """Keyset paging: the next ``count`` rows after the last row's order values."""
    if after is not None:
        held = F.lit(False)
        for i in reversed(range(len(order))):
            held = (F.col(order[i]) > F.lit(after[i])) | ((F.col(order[i]) == F.lit(after[i])) & held)
        frame = frame.where(held)
    return frame.orderBy(*order).limit(count)
