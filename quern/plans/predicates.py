"""Query trees to boolean columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import geo as G
from quern.functions import text as T
from quern.functions.values import is_numeric
from quern.functions.vectors import distance
from quern.plans import query as Q
from quern.plans.index import Field, Index

EPSILON = 0.01


def computed_once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows with columns that no later mention computes anew: a generator of one row each holds
    them, into which no optimiser rule inlines or pushes filters."""
    if not columns:
        return rows
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return rows.select("*", made.alias("_made")).withColumns({n: F.col("_made")[n] for n in columns}).drop("_made")


@dataclass
class Compiled:
    """What a tree asks of a document, and what else the caller needs."""

    index: Index
    params: dict[str, object]
    verbatim: bool = False
    keep_stopwords: bool = False
    tokens: dict[str, Column] = field(default_factory=dict)
    #: Word, fields, weight, and whether its variants are searched for.
    terms: list[tuple[str, tuple[str, ...] | None, float, bool]] = field(default_factory=list)
    knn: Q.VectorKnn | None = None
    ranged: Q.VectorRange | None = None
    slop: int | None = None
    inorder: bool = False

    def token_column(self, f: Field) -> Column:
        name = f"_tokens_{f.name}"
        self.tokens[name] = self.index.tokens(f, raw=self.keep_stopwords)
        return F.col(f"`{name}`")

    def variant_column(self, f: Field) -> Column:
        if not self.index.has_variants(f):
            return self.token_column(f)
        name = f"_variants_{f.name}"
        self.tokens[name] = self.index.variants(f, self.token_column(f))
        return F.col(f"`{name}`")

    def tokenised(self, rows: DataFrame) -> DataFrame:
        """Rows with their tokens, then with the variants that are made of these."""
        rows = computed_once(rows, {n: c for n, c in self.tokens.items() if n.startswith("_tokens_")})
        return computed_once(rows, {n: c for n, c in self.tokens.items() if n.startswith("_variants_")})

    def rough(self, node: Q.Node, names: tuple[str, ...] | None = None) -> Column | None:
        """What every hit's raw texts fulfil and needs no tokens; None where nothing is known.

        Tokens are runs of the lower-case text once inner marks are gone, so what a token holds, the text holds.
        """
        match node:
            case Q.Text() if self.verbatim and (self.keep_stopwords or node.word.lower() not in self.index.stopwords):
                return self._held(self.words(node.word), names)
            case Q.Phrase():
                words = [w for x in node.words for w in self.words(x) if self.keep_stopwords or w not in self.index.stopwords]
                return self._held(words, names) if words else None
            case Q.Prefix():
                return self._held([node.start.lower()], names)
            case Q.Wildcard() if "\\" not in node.pattern:
                return self._held(re.split(r"[*?]+", node.pattern.lower()), names)
            case Q.Scope():
                return self.rough(node.child, node.names)
            case Q.Attributed():
                return self.rough(node.child, names)
            case Q.And():
                known = [c for c in (self.rough(n, names) for n in node.children) if c is not None]
                return reduce(lambda a, b: a & b, known) if known else None
            case Q.Or():
                each = [self.rough(n, names) for n in node.children]
                return None if any(c is None for c in each) else reduce(lambda a, b: a | b, each)
        return None

    def _held(self, pieces: list[str], names: tuple[str, ...] | None) -> Column | None:
        texts = [self.index.unmarked(f) for f in self.index.text_fields(names)]
        pieces = [p for p in dict.fromkeys(pieces) if p]
        if not pieces or not texts or any(t is None for t in texts):
            return None
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains(t, F.lit(p)) for p in pieces]) for t in texts])

    def _texts(self, names: tuple[str, ...] | None) -> list[Field]:
        found = self.index.text_fields(names)
        if names is not None and not found and not any(f.name in names for f in self.index.fields):
            raise Q.QueryError(f"no text field among {names}")
        return found

    def _any_token(self, names, test) -> Column:
        parts = [F.exists(self.token_column(f), test) for f in self._texts(names)]
        return reduce(lambda a, b: a | b, parts, F.lit(False))

    def words(self, word: str) -> list[str]:
        """A query word's tokens and, for each, the words that stand for it."""
        w = "".join(c for i, c in enumerate(word.lower()) if not (c in "'.,’" and 0 < i < len(word) - 1))
        return [w]

    def _word(self, node: Q.Text, names, weight: float) -> Column:
        if not self.keep_stopwords and node.word.lower() in self.index.stopwords:
            return F.lit(True)
        word = self.words(node.word)[0]
        self.terms.append((word, names, weight, not self.verbatim))
        out = F.lit(False)
        for f in self._texts(names):
            own, asked = (self.token_column(f), [word]) if self.verbatim else (self.variant_column(f), self.index.asked(f, word))
            out = out | (F.array_contains(own, word) if len(asked) == 1 else F.arrays_overlap(own, F.array(*map(F.lit, asked))))
        return out

    def _phrase(self, node: Q.Phrase, names, weight: float) -> Column:
        words = [w for x in node.words for w in self.words(x)]
        if not self.keep_stopwords:
            words = [w for w in words if w not in self.index.stopwords]
        if not words:
            return F.lit(True)
        self.terms += [(w, names, weight, False) for w in words]
        slop, inorder = (node.slop, node.inorder) if self.slop is None else (self.slop, self.inorder)
        out = F.lit(False)
        for f in self._texts(names):
            own = self.token_column(f)
            every = reduce(lambda a, b: a & b, [F.array_contains(own, w) for w in dict.fromkeys(words)])
            if slop == 0 and inorder:
                near = F.contains(F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" ")), F.lit(f" {' '.join(words)} "))
            else:
                near = T.phrase_within(slop, inorder, words)(own)
            out = out | (every & near)
        return out

    def _tag(self, node: Q.Tag) -> Column:
        f = self.index.field(node.name)
        if node.values == ("",):
            return F.exists(self.index.values(f), lambda v: v == "")
        wanted = list(node.values) if f.case_sensitive else [v.lower() for v in node.values]
        c, kind = self.index.column(f), self.index.kind_of(f)
        if not kind.startswith("array") and f.separator == "":  # one tag a document: a predicate that scans can take
            return (c if f.case_sensitive else F.lower(c)).isin(wanted) & c.isNotNull()
        if kind.startswith("array"):
            return F.exists(self.index.values(f), lambda v: F.exists(T.tags(v, f.separator, f.case_sensitive), lambda t: t.isin(wanted)))
        return F.exists(T.tags(c.cast("string"), f.separator, f.case_sensitive), lambda t: t.isin(wanted))

    def _numeric(self, node: Q.Numeric) -> Column:
        f = self.index.field(node.name)
        inf = float("inf")

        def inside(x: Column) -> Column:
            low = F.lit(True) if node.low == -inf else x > node.low if node.low_open else x >= node.low
            high = F.lit(True) if node.high == inf else x < node.high if node.high_open else x <= node.high
            return low & high & x.isNotNull()

        if is_numeric(self.index.kind_of(f)):
            return inside(self.index.column(f))  # false, not null, for a missing number
        return F.exists(self.index.numbers(f), inside)

    def _point(self, f: Field) -> tuple[Column, Column]:
        if isinstance(f.source, tuple):
            return F.col(f.source[0]).cast("double"), F.col(f.source[1]).cast("double")
        parts = F.split(self.index.column(f), ",")
        return F.trim(F.get(parts, 0)).try_cast("double"), F.trim(F.get(parts, 1)).try_cast("double")

    def geo(self, name: str, lon: float, lat: float, radius: float, unit: str) -> Column:
        if unit not in G.UNITS:
            raise Q.QueryError(f"unknown unit {unit}")
        x, y = self._point(self.index.field(name))
        return F.coalesce(G.within_radius(x, y, lon, lat, radius * G.UNITS[unit], G.SEARCH_RADIUS), F.lit(False))

    def vector(self, name: str) -> list[float]:
        if name not in self.params:
            raise Q.QueryError(f"no parameter ${name}")
        given = self.params[name]
        if isinstance(given, (bytes, bytearray)):
            import numpy as np

            given = np.frombuffer(given, "<f4").tolist()
        return [float(x) for x in given]

    def distance(self, name: str, vector: str) -> Column:
        f = self.index.field(name)
        return distance(f.metric, self.index.column(f), self.vector(vector))

    def __call__(self, node: Q.Node, names: tuple[str, ...] | None = None, weight: float = 1.0, scored: bool = True) -> Column:
        go = lambda n, s=scored: self(n, names, weight, s)
        match node:
            case Q.All():
                return F.lit(True)
            case Q.Text():
                kept = len(self.terms)
                out = self._word(node, names, weight)
                if not scored:
                    del self.terms[kept:]
                return out
            case Q.Phrase():
                kept = len(self.terms)
                out = self._phrase(node, names, weight)
                if not scored:
                    del self.terms[kept:]
                return out
            case Q.EmptyText():
                fields = [f for f in self._texts(names) if f.index_empty]
                return reduce(lambda a, b: a | b, [F.exists(self.index.values(f), lambda v: v == "") for f in fields], F.lit(False))
            case Q.Prefix():
                return self._any_token(names, lambda t: F.startswith(t, F.lit(node.start.lower())))
            case Q.Wildcard():
                return self._any_token(names, lambda t: t.rlike(T.wildcard_regex(node.pattern)))
            case Q.Fuzzy():
                return self._any_token(names, lambda t: T.near(t, node.word.lower()))
            case Q.Tag():
                return self._tag(node)
            case Q.Numeric():
                return self._numeric(node)
            case Q.Geo():
                return self.geo(node.name, node.lon, node.lat, node.radius, node.unit)
            case Q.GeoShape():
                wkt = str(self.params.get(node.wkt.removeprefix("$"), node.wkt))
                return G.shape_predicate(node.relation, wkt)(self.index.column(self.index.field(node.name)))
            case Q.Missing():
                f = self.index.field(node.name)
                if not f.index_missing:
                    raise Q.QueryError(f"{node.name} does not index missing values")
                return self.index.column(f).isNull() if not self.index.kind_of(f).startswith("array") else F.size(self.index.values(f)) == 0
            case Q.Scope():
                return self(node.child, node.names, weight, scored)
            case Q.And():
                return reduce(lambda a, b: a & b, [go(c) for c in node.children])
            case Q.Or():
                return reduce(lambda a, b: a | b, [go(c) for c in node.children])
            case Q.Not():
                return ~F.coalesce(go(node.child, False), F.lit(False))
            case Q.Optional():
                go(node.child)  # counts for the score only
                return F.lit(True)
            case Q.Attributed():
                given = dict(node.attributes)
                return self(node.child, names, weight * float(given.get("weight", 1.0)), scored)
            case Q.VectorKnn():
                self.knn = node
                return go(node.child)
            case Q.VectorRange():
                self.ranged = node
                return F.coalesce(self.distance(node.name, node.vector) <= node.radius * (1 + EPSILON), F.lit(False))
        raise Q.QueryError(f"cannot compile {node}")
