"""Dictionaries, suggestions, spelling and synonyms over term tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import near, tags, tokens
from quern.plans.index import Index


def add_terms(terms: DataFrame, dictionary: str, new: Sequence[str]) -> DataFrame:
    rows = terms.sparkSession.createDataFrame([(dictionary, t) for t in new], "dict string, term string")
    return terms.select("dict", "term").unionByName(rows).distinct()


def remove_terms(terms: DataFrame, dictionary: str, gone: Sequence[str]) -> DataFrame:
    return terms.where(~((F.col("dict") == dictionary) & F.col("term").isin(list(gone))))


def dump(terms: DataFrame, dictionary: str) -> DataFrame:
    return terms.where(F.col("dict") == dictionary).select("term").orderBy("term")


def suggestions_put(table: DataFrame, rows: DataFrame, increment: bool = False) -> DataFrame:
    """Upsert (key, string, score[, payload]); with increment, scores add up."""
    new = rows.groupBy("key", "string").agg(F.sum("score").alias("new") if increment else F.max("score").alias("new"), F.max("payload").alias("new_payload"))
    both = table.join(new, ["key", "string"], "full_outer")
    score = F.coalesce("new", F.lit(0.0)) + F.coalesce("score", F.lit(0.0)) if increment else F.coalesce("new", "score")
    return both.select("key", "string", score.alias("score"), F.coalesce("new_payload", "payload").alias("payload"))


def suggest(table: DataFrame, key: str, prefix: str, fuzzy: bool = False, limit: int = 5) -> DataFrame:
    """Strings with the prefix, or with fuzzy also those at most one edit from it; best score first."""
    text = F.lower("string")
    held = F.startswith(text, F.lit(prefix.lower()))
    if fuzzy:
        held = held | (F.levenshtein(text, F.lit(prefix.lower()), 1) >= 0)
    return table.where((F.col("key") == key) & held).select("string", "score", "payload").orderBy(F.desc("score"), "string").limit(limit)


def vocabulary(index: Index, *names: str) -> DataFrame:
    """Terms of text fields with the number of documents that have them."""
    out = None
    for f in index.text_fields(names or None):
        part = index.documents().select(F.explode(F.array_distinct(index.tokens(f))).alias("term"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


def spellcheck(index: Index, query: str, distance: int = 1, include: DataFrame | Sequence[str] | None = None, exclude: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """For words of the query that no document has: term, suggestion, score (share of documents).

    include, exclude: terms of dictionaries (column term) that are suggested as well, or never. A band of
    lengths cuts the vocabulary before distances are taken; the query's words are literals, so there
    is no join with them, and of the dictionaries only those among the query's words reach the driver.
    """
    spark = index.source.sparkSession
    include, exclude = (spark.createDataFrame([(t,) for t in d], "term string") if d is not None and not isinstance(d, DataFrame) else d for d in (include, exclude))
    words = list(dict.fromkeys(query.lower().split()))
    listed = lambda d: {r["term"] for r in d.where(F.col("term").isin(words)).select("term").distinct().collect()} if d is not None else set()
    words = [w for w in words if w not in listed(exclude)]
    terms = vocabulary(index)
    if exclude is not None:
        terms = terms.join(exclude.select("term"), "term", "left_anti")
    known = {r["term"] for r in terms.where(F.col("term").isin(words)).select("term").collect()}  # at most the query's words
    unknown = [w for w in words if w not in known and w not in listed(include)]
    total = index.documents().count()
    pool = terms if include is None else terms.unionByName(include.select("term", F.lit(0).cast("long").alias("documents"))).groupBy("term").agg(F.max("documents").alias("documents"))
    asked = F.explode(F.filter(F.array(*[F.struct(F.lit(w).alias("word"), F.when(F.abs(F.length("term") - len(w)) <= distance, F.levenshtein("term", F.lit(w), distance)).otherwise(-1).alias("d")) for w in unknown]), lambda x: x["d"] >= 0))
    if not unknown:
        return pool.select(F.col("term"), F.col("term").alias("suggestion"), F.lit(0.0).alias("score")).limit(0)
    return pool.select(asked.alias("x"), "term", "documents").select(F.col("x.word").alias("term"), F.col("term").alias("suggestion"), (F.col("documents") / F.lit(float(max(total, 1)))).alias("score"))


def fuzzy_terms(index: Index, word: str) -> DataFrame:
    """Terms one edit or swap away."""
    return vocabulary(index).where(near(F.col("term"), word.lower())).orderBy("term")


def synonyms_update(table: DataFrame, group: str, terms: Sequence[str]) -> DataFrame:
    rows = table.sparkSession.createDataFrame([(group, t.lower()) for t in terms], "grp string, term string")
    return table.select("grp", "term").unionByName(rows).distinct()


def synonyms_dump(table: DataFrame) -> DataFrame:
    return table.groupBy("term").agg(F.sort_array(F.collect_set("grp")).alias("groups"))


def expanded(table: DataFrame, text_table: DataFrame, key: str, text: str) -> DataFrame:
    """Document tokens with their synonyms: a join on the term, for groups too many for a query's literals."""
    words = text_table.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    pairs = table.select("grp", "term").join(table.select("grp", F.col("term").alias("synonym")), "grp")
    return words.join(pairs, "term").select(key, F.col("synonym").alias("term")).unionByName(words.select(key, "term")).distinct()


def tag_values(index: Index, name: str) -> DataFrame:
    f = index.field(name)
    each = F.explode(F.flatten(F.transform(index.values(f), lambda v: tags(v, f.separator, f.case_sensitive))))
    return index.documents().select(each.alias("tag")).distinct().orderBy("tag")
