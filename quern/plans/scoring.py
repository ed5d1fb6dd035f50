"""Relevance: BM25 from one pass of corpus statistics, and simpler scorers."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.plans.index import Index
from quern.plans.predicates import Compiled

K1, B = 1.2, 0.75
SCORERS = ("BM25STD", "BM25", "DISMAX", "DOCSCORE")


def document_score(index: Index) -> Column:
    if index.score_field is None:
        return F.lit(float(index.score))
    x = F.col(index.score_field).try_cast("double")
    return F.when((x >= 0) & (x != float("inf")) & ~F.isnan(x), x).otherwise(F.lit(float(index.score)))


def _places(index: Index, plan: Compiled) -> list[tuple[str, str, float]]:
    """(term, token column, weight), once for each column that a term, or a variant of it, is looked for in."""
    seen = {}
    for word, names, weight, varied in plan.terms:
        for f in index.text_fields(names):
            varied_here = varied and index.has_variants(f)
            for w in index.asked(f, word) if varied_here else [word]:
                place = w, f"_{'variants' if varied_here else 'tokens'}_{f.name}"
                seen[place] = max(weight * f.weight, seen.get(place, 0.0))
    return [(w, n, x) for (w, n), x in sorted(seen.items())]


def _times(tokens: Column, word: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == word)).cast("double")


def _gate(index: Index, plan: Compiled, n: str, words: list[str]) -> tuple[Column, Column] | None:
    """For a token column of which only some words matter: whether the raw text may hold one, and the length."""
    if not n.startswith("_tokens_") or any(m == n.replace("_tokens_", "_variants_", 1) for m in plan.tokens):
        return None
    f = index.field(n.removeprefix("_tokens_"))
    text, length = index.unmarked(f), index.length(f, plan.keep_stopwords)
    return None if text is None or length is None or not words else (reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), length)


def statistics(index: Index, plan: Compiled, places: list[tuple[str, str, float]]) -> tuple[int, list[int], dict[str, float]]:
    """Documents, how many of them have the term of each place, and mean lengths by token column.

    One aggregation over all documents: a row of as many numbers as the query has places. Tokens
    are made only of texts that may have one of the words; of the others they are only counted.
    """
    fields = sorted({n for _, n, _ in places})
    own = lambda n: F.col(f"`{n}`")
    gates = {n: g for n in fields if (g := _gate(index, plan, n, [w for w, m, _ in places if m == n]))}
    made = {n: F.when(gates[n][0], c) if n in gates else c for n, c in plan.tokens.items()}
    read = replace(plan, tokens=made).tokenised(index.documents())
    for n in fields:
        length = F.size(own(n))
        read = read.withColumn(f"_length{n}", F.when(own(n).isNotNull(), length).otherwise(gates[n][1]) if n in gates else length)
    counts = [F.count(F.lit(1)).alias("n")]
    counts += [F.avg(own(f"_length{n}").cast("double")).alias(f"l{n}") for n in fields]
    counts += [F.count_if(F.array_contains(own(n), w)).alias(f"d{i}") for i, (w, n, _) in enumerate(places)]
    stats = read.agg(*counts).first()
    return stats["n"], [stats[f"d{i}"] for i in range(len(places))], {n: float(stats[f"l{n}"] or 1.0) for n in fields}


def combined(index: Index, scorer: str, parts: dict[str, list[Column]]) -> Column:
    """The score of a document from the weights of its terms."""
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    if scorer == "DISMAX":
        every = [p for ps in parts.values() for p in ps]
        return F.greatest(*every) if len(every) > 1 else every[0]
    score = add([add(ps) for ps in parts.values()])
    if scorer == "BM25":
        score = F.when(score > 0, score / (score + 1.2)).otherwise(F.lit(0.0))
    return score * document_score(index)


def weighed(total: int, df: int, tf: Column, length: Column, weight: float) -> Column:
    """BM25 of one term; ``length`` is in mean lengths."""
    idf = F.ln(F.lit(1 + (total - df + 0.5) / (df + 0.5)))
    return F.lit(weight) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))


def with_score(index: Index, plan: Compiled, scorer: str) -> Column:
    """The score column of documents with token columns."""
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer {scorer}")
    if scorer == "DOCSCORE":
        return document_score(index)
    places = _places(index, plan)
    if not places:
        return F.lit(1.0)
    own = lambda n: F.col(f"`{n}`")
    total, found, means = statistics(index, plan, places)
    parts: dict[str, list[Column]] = {}
    for (w, n, weight), df in zip(places, found, strict=True):
        parts.setdefault(w, []).append(weighed(total, df, _times(own(n), w), F.size(own(n)).cast("double") / F.lit(means[n]), weight))
    return combined(index, scorer, parts)
