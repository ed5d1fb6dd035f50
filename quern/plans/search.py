"""Ranked document search, exact vector search and their fusion."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.plans import query as Q
from quern.plans.index import Index
from quern.plans.predicates import Compiled
from quern.plans.scoring import with_score


def _matched(index: Index, query: str, params: dict | None, *, verbatim=False, nostopwords=False, infields=None, slop=None, inorder=False, extra=()) -> tuple[DataFrame, Compiled]:
    """The documents that match, with token columns, and the compiled plan."""
    def compiled() -> Compiled:
        return Compiled(index, params or {}, verbatim, nostopwords, slop=slop, inorder=inorder)

    plan, tree = compiled(), Q.parse(query, params)
    names = tuple(infields) if infields else None
    if slop is not None and isinstance(tree, Q.And) and all(isinstance(c, Q.Text) for c in tree.children):
        tree = Q.Phrase(tuple(c.word for c in tree.children), slop, inorder)
    plan(tree, names)
    # what needs no tokens is a filter that scans can take, and goes first
    hits, late = index.documents(), []
    for part in tree.children if isinstance(tree, Q.And) else (tree,):
        own = compiled()
        held = own(part, names)
        if own.tokens:
            late.append(held)
            held = own.rough(part, names)
        if held is not None:
            hits = hits.where(held)
    for f in extra:
        hits = hits.where(f(plan))
    hits = plan.tokenised(hits)
    for held in late:
        hits = hits.where(held)
    return hits, plan


def search(
    index: Index,
    query: str,
    *,
    params: dict[str, object] | None = None,
    limit: tuple[int, int] | None = (0, 10),
    scorer: str = "BM25STD",
    sortby: tuple[str, str] | None = None,
    returns: Sequence[str | tuple[str, str]] | None = None,
    filters: Sequence[tuple[str, str, str]] = (),
    geofilters: Sequence[tuple[str, float, float, float, str]] = (),
    inkeys: Sequence[object] | None = None,
    infields: Sequence[str] | None = None,
    verbatim: bool = False,
    nostopwords: bool = False,
    slop: int | None = None,
    inorder: bool = False,
    highlight: dict | None = None,
    summarize: dict | None = None,
    explain_score: bool = False,
) -> DataFrame:
    """key, score, sort_key, payload and the asked-for fields, best first.

    Ties go by key. ``limit`` None returns every match. A KNN clause makes the distance the
    score, nearest first, and adds __vector_score and __<field>_score.
    """
    extra = [lambda p, f=f: p(Q._range(f[0], f"{f[1]} {f[2]}")) for f in filters]
    extra += [lambda p, g=g: p.geo(*g) for g in geofilters]
    hits, plan = _matched(index, query, params, verbatim=verbatim, nostopwords=nostopwords, infields=infields, slop=slop, inorder=inorder, extra=extra)
    if inkeys is not None:
        hits = hits.where(F.col(index.key).isin(list(inkeys)))
    added: dict[str, Column] = {}
    if plan.knn or plan.ranged:
        clause = plan.knn or plan.ranged
        score = plan.distance(clause.name, clause.vector)
        added = {"__vector_score": F.col("score"), f"__{clause.name}_score": F.col("score")}
        if plan.knn and plan.knn.alias:
            added[plan.knn.alias] = F.col("score")
        hits = hits.withColumn("score", score).where("score is not null")
        order = [F.col("score").asc(), F.col(index.key).asc()]
        if plan.knn:
            hits = hits.orderBy(*order).limit(plan.knn.k)
    else:
        score = with_score(index, plan, scorer)
        hits = hits.withColumn("score", score.cast("double"))
        order = [F.col("score").desc(), F.col(index.key).asc()]
    number, text = index.sort_columns(sortby[0]) if sortby else (F.lit(None).cast("double"), F.lit(None).cast("string"))
    if sortby:
        f = index.field(sortby[0])
        if not f.sortable:
            raise Q.QueryError(f"{f.name} is not sortable")
        way = (lambda c: c.desc_nulls_last()) if sortby[1].upper() == "DESC" else (lambda c: c.asc_nulls_last())
        order = [way(number), way(text), F.col(index.key).asc()]
    sort_key = F.coalesce(text, number.cast("string"))
    payload = F.col(index.payload_field) if index.payload_field else F.lit(None).cast("string")
    wanted = [(r, r) if isinstance(r, str) else tuple(r) for r in (returns if returns is not None else [f.name for f in index.fields if not isinstance(f.source, tuple) and f.kind != "VECTOR"])]
    words = sorted({w for w, *_ in plan.terms})
    shown = []
    for name, alias in wanted:
        c = index.column(index.field(name)) if any(f.name == name for f in index.fields) else F.col(f"`{name}`")
        if summarize is not None and name in summarize.get("fields", [name]):
            c = T.summarize(c.cast("string"), words, summarize.get("fragments", 1), summarize.get("length", 20), summarize.get("separator", "... "))
        if highlight is not None and name in highlight.get("fields", [name]):
            c = T.highlight(c.cast("string"), words, *highlight.get("tags", ("<b>", "</b>")))
        shown.append(c.alias(alias))
    explained = [F.struct(F.col("score"), F.lit(scorer).alias("scorer")).alias("explanation")] if explain_score else []
    if limit is None and plan.tokens:
        # a global sort samples its input: rows cross a shuffle first, so that texts are not searched twice
        hits = hits.drop(*plan.tokens).repartition(F.col(f"`{index.key}`"))
    ranked = hits.orderBy(*order)
    if limit is not None:
        ranked = ranked.offset(limit[0]).limit(limit[1]) if limit[0] else ranked.limit(limit[1])
    return ranked.select(F.col(f"`{index.key}`").alias("key"), F.col("score"), sort_key.alias("sort_key"), payload.alias("payload"), *[c.alias(n) for n, c in added.items()], *explained, *shown)


def count(index: Index, query: str, **options) -> DataFrame:
    """LIMIT 0 0: the number of matches."""
    hits, _ = _matched(index, query, options.pop("params", None), **options)
    return hits.agg(F.count(F.lit(1)).alias("total"))


def hybrid(
    index: Index,
    query: str,
    field: str,
    vector: Sequence[float],
    *,
    params: dict | None = None,
    k: int = 10,
    radius: float | None = None,
    combine: str = "RRF",
    window: int = 20,
    constant: float = 60.0,
    alpha: float = 0.5,
    beta: float = 0.5,
    scorer: str = "BM25STD",
    verbatim: bool = False,
    post_filter: str | None = None,
    limit: tuple[int, int] | None = (0, 10),
) -> DataFrame:
    """Text and vector lists of at most ``window`` each, fused on the key: key, score, text_score, vector_score.

    Both lists are bounded by the window, so the join and the windows over them are small.
    """
    texts = search(index, query, params=params, scorer=scorer, verbatim=verbatim, limit=(0, window), returns=[]).select("key", F.col("score").alias("text_score"))
    clause = f"@{field}:[VECTOR_RANGE {radius} $__v]" if radius is not None else f"*=>[KNN {k} @{field} $__v]"
    near = search(index, clause, params={"__v": list(vector)}, limit=(0, window), returns=[]).select("key", F.col("score").alias("vector_score"))
    by_text, by_vector = Window.orderBy(F.desc("text_score"), "key"), Window.orderBy("vector_score", "key")
    if combine.upper() == "RRF":
        texts = texts.withColumn("_t", 1.0 / (constant + F.row_number().over(by_text)))
        near = near.withColumn("_v", 1.0 / (constant + F.row_number().over(by_vector)))
    else:
        def scaled(c: str, inverted: bool) -> Column:
            low, high = F.min(c).over(Window.partitionBy()), F.max(c).over(Window.partitionBy())
            x = (F.col(c) - low) / F.when(high > low, high - low)
            return F.coalesce(1 - x if inverted else x, F.lit(1.0))

        texts = texts.withColumn("_t", alpha * scaled("text_score", False))
        near = near.withColumn("_v", beta * scaled("vector_score", True))
    both = texts.join(near, "key", "full_outer").withColumn("score", F.coalesce("_t", F.lit(0.0)) + F.coalesce("_v", F.lit(0.0)))
    if post_filter:
        admitted, _ = _matched(index, post_filter, params)
        both = both.join(admitted.select(F.col(f"`{index.key}`").alias("key")), "key", "left_semi")
    ranked = both.select("key", "score", "text_score", "vector_score").orderBy(F.desc("score"), "key")
    return ranked if limit is None else ranked.offset(limit[0]).limit(limit[1]) if limit[0] else ranked.limit(limit[1])


