"""Line dedup: repeated runs of lines by a suffix array over line ids.

Texts are cut at line feeds; a run is ``least`` or more consecutive lines of a document.
Every line that lies in a run which also starts earlier (smaller doc_id, or earlier in the
same document) goes; the first copy of a run stays.

1. Lines become ids (128 bits of two hashes). A line that occurs once ends every run, so
   only repeated lines are ranked: their sorted ids are the suffix array's first order.
2. Prefix doubling: the ranks of a suffix and of the one h lines on, sorted as pairs, rank
   the suffixes by 2h lines; one step on the way ranks them by exactly ``least`` lines, by two
   overlapping prefixes. Pairs are counted before they are sorted, so a run that a third of
   all documents share is one row. Suffixes whose rank has become unique leave; it goes on
   until none is left, so the last depth is beyond the longest repeated run.
3. Suffixes of equal rank at depth h are an interval of the suffix array whose longest common
   prefix is h or more; its first copy is the least position in it. Of the suffixes that are not
   a first copy at depth ``least``, those begin a run that do not continue the run of the line
   before them. Each takes the first copy of the deepest interval in which it is a later one;
   their longest common prefix follows from the ranks at the depths below, from the deepest down.
4. The runs found, each with its length and its first copy, are maximal: neither side goes on alike.
   Together they hold every line of a later copy, and these lines go.

Ranks are Spark's increasing ids over range-sorted pairs: order-preserving, and written
down before use, so a recomputed task cannot change them.

Edge cases.  A null text has no lines, an empty one a single empty line. Rows with equal
doc_id are ordered by a hash of their text; rows equal in both are one document and
each gets its result. A null doc_id orders first. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch

LEAST = 3
_NO_ID = -(1 << 63)
_PLACE = ["id", "tie", "pos"]


def _ranked(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Of rows (id, tie, pos, keys): those whose keys occur more than once, with their rank by keys and the interval's first position."""
    intervals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_PLACE)).alias("first")).where("n > 1")
    ordered = intervals.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id() + 1).drop("n")
    ranks = scratch.save(ordered, f"ranks_{name}")
    return rows.join(ranks.hint("merge"), keys).select(*_PLACE, "rank", "first")  # a hot key's rows can be split, its one rank copied


def suffix_levels(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> dict[int, DataFrame]:
    """Of keyed docs (id, tie, text): by depth, the suffixes whose first so many lines occur more than once: id, tie, pos, rank, first."""
    lines = docs.where("text is not null").select("id", "tie", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    hashed = lines.select(*_PLACE, F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b"))
    hashed = scratch.save(hashed.distinct(), "lines")
    levels, depth = {1: scratch.save(_ranked(hashed, ["a", "b"], scratch, "1"), "suffixes_1")}, 1
    in_doc = Window.partitionBy("id", "tie").orderBy("pos")
    while depth < least or not levels[depth].isEmpty():
        step = min(depth, least - depth) if depth < least else depth
        # suffixes of unique rank are gone, so the neighbour must also be the right number of lines on
        ahead = F.when(F.lead("pos", step).over(in_doc) == F.col("pos") + step, F.lead("rank", step).over(in_doc))
        pairs = levels[depth].withColumn("next", ahead).where("next is not null").select(*_PLACE, F.col("rank").alias("own"), "next")
        pairs = scratch.save(pairs, f"pairs_{depth}")
        depth += step
        levels[depth] = scratch.save(_ranked(pairs, ["own", "next"], scratch, str(depth)), f"suffixes_{depth}")
    return levels


def repeated_runs(levels: dict[int, DataFrame], scratch: Scratch, least: int = LEAST) -> DataFrame:
    """Maximal runs that have an earlier copy: id, tie, pos, first (a struct of these of the copy), length."""
    later = lambda df: df.where(F.struct(*_PLACE) != F.col("first"))
    in_doc = Window.partitionBy("id", "tie").orderBy("pos")
    behind = F.lag(F.struct("pos", "first")).over(in_doc)
    goes_on = (behind["pos"] + 1 == F.col("pos")) & (behind["first"]["id"] == F.col("first.id")) & (behind["first"]["tie"] == F.col("first.tie")) & (behind["first"]["pos"] + 1 == F.col("first.pos"))
    starts = later(levels[least]).withColumn("on", F.coalesce(goes_on, F.lit(False))).where("not on").select(*_PLACE, "first")
    starts = scratch.save(starts, "starts")
    # the deepest interval in which a start is a later copy
    deeper = [later(levels[d]).select(*_PLACE, F.lit(d).alias("depth"), "first") for d in sorted(levels) if d > least]
    every = starts.select(*_PLACE, F.lit(least).alias("depth"), "first")
    for df in deeper:
        every = every.unionByName(df.join(starts.select(*_PLACE).hint("merge"), _PLACE, "left_semi"))
    runs = every.groupBy(*_PLACE).agg(F.max_by(F.struct("depth", "first"), "depth").alias("x")).select(*_PLACE, "x.first", F.col("x.depth").alias("depth"), F.col("x.depth").alias("length"))
    runs = scratch.save(runs, "runs")
    most = runs.agg(F.max("depth")).first()[0] or 0
    for d in sorted((d for d in levels if d < most), reverse=True):
        # as many lines on, do both sides have the same rank at this depth?
        some = runs.where(F.col("depth") > d)
        sides = [some.select(*_PLACE, F.col(f"{of}id").alias("at_id"), F.col(f"{of}tie").alias("at_tie"), (F.col(f"{of}pos") + F.col("length")).alias("at_pos")) for of in ("", "first.")]
        there = levels[d].select(*[F.col(c).alias(f"at_{c}") for c in _PLACE], "rank")
        found = sides[0].unionByName(sides[1]).join(there.hint("merge"), ["at_id", "at_tie", "at_pos"])
        alike = found.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high")).where("n = 2 and low = high")
        longer = runs.join(alike.select(*_PLACE, F.lit(d).alias("more")).hint("merge"), _PLACE, "left")
        runs = scratch.save(longer.select(*_PLACE, "first", "depth", (F.col("length") + F.coalesce("more", F.lit(0))).alias("length")), f"runs_{d}")
    return runs.drop("depth")


def repeated_lines(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """Of keyed docs (id, tie, text): id, tie, spans (structs of first line and the line after) that go, runs they consist of."""
    found = repeated_runs(suffix_levels(docs, scratch, least), scratch, least)
    in_doc = Window.partitionBy("id", "tie").orderBy("pos")
    so_far = F.max(F.col("pos") + F.col("length")).over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("new", F.coalesce((F.col("pos") > so_far).cast("int"), F.lit(1))).withColumn("nth", F.sum("new").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.struct(F.col("pos").alias("begin"), (F.col("pos") + F.col("length")).alias("end"), F.when(F.col("first.id") != _NO_ID, F.col("first.id")).alias("first_doc"), F.col("first.pos").alias("first_line"))
    spans = apart.groupBy("id", "tie", "nth").agg(F.min("pos").alias("begin"), F.max(F.col("pos") + F.col("length")).alias("end"), F.collect_list(run).alias("runs"))
    return spans.groupBy("id", "tie").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"), F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"))


def line_dedup(spark: SparkSession, docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_lines, n_removed, spans, kept_text, runs (begin, end, first_doc, first_line)."""
    scratch = Scratch(spark)
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    repeat = not docs.groupBy(id_.alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    # where no two rows have one doc_id, the text need not tell them apart
    tie = F.coalesce(F.md5("text"), F.lit("")) if repeat else F.lit("")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_.alias("id"), tie.alias("tie"), "text")
    spans = scratch.save(repeated_lines(keyed, scratch, least), "spans")
    lines = F.split("text", "\n")
    # kept pieces: from the end of each span to the begin of the next
    edges = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.element_at("spans", F.greatest(i, F.lit(1)))["end"]).alias("from"),
            F.when(i == F.size("spans"), F.size("lines")).otherwise(F.element_at("spans", F.least(i + 1, F.size("spans")))["begin"]).alias("to"),
        ),
    )
    kept = F.flatten(F.transform(edges, lambda e: F.slice("lines", e["from"] + 1, e["to"] - e["from"])))
    joined = keyed.join(spans.hint("merge"), ["id", "tie"], "left").withColumn("lines", lines)
    removed = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["begin"]), F.lit(0))
    return joined.select(
        "doc_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("_n"), removed.cast("long").alias("n_removed"), "spans",
        F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"), F.col("text").isNull().alias("_no_text"), "runs",
    ).select("doc_id", F.when(F.col("_no_text"), F.lit(0)).otherwise(F.col("_n")).cast("long").alias("n_lines"), "n_removed", "spans", "kept_text", "runs")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = """
WITH l AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), win AS (
  SELECT doc_id, i, lines[i:i + 2] AS win FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines) - 2)) AS i FROM l WHERE len(lines) >= 3)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1
), line AS (
  SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS i FROM l
), marked AS (
  SELECT line.doc_id, line.i, line.line,
    max(CASE WHEN dup.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY line.doc_id ORDER BY line.i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone
  FROM line LEFT JOIN dup ON line.doc_id = dup.doc_id AND line.i = dup.i
), kept AS (
  SELECT doc_id, count(*) AS n_lines, sum(gone) AS n_removed, coalesce(string_agg(CASE WHEN gone = 0 THEN line END, chr(10) ORDER BY i), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
