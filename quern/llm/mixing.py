"""Mixing sources to target weights by repetition rates.

Sizes (words) are summed per source, targets follow from the weights, and each
document is emitted floor(rate) times plus one more time when a seeded hash of its id
and text, read as a number in [0, 1), is below the rate's fraction.

Targets.  All sources share ``budget`` times all sizes in proportion to their
weights, but none gets more than ``most`` times its own size; what a source cannot
take is reshared by weight.  That is water-filling: sources are taken by rising
size / weight, and a source is full if its share of what is then left exceeds its
limit.  Sums over sources are cumulative window sums over one row per source.

Edge cases.  A null text has size 0.  A null source is a source of its own, last
in order.  A source of size 0 has target 0 and its documents are not emitted.
Rows equal in doc_id and text share their draw; each row is emitted on its own.  A null
doc_id or text draws as the empty string.  Extra columns pass through ``mix`` unchanged; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD_PATTERN, every

WEIGHTS, BUDGET, MOST, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 0
#: One row per source is broadcast while there are no more of them than this; beyond it Spark joins by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """sizes: source, source_size (one row per source). Adds weight and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(listed, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_fill = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before, after = Window.orderBy(*by_fill).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*by_fill).rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    step = (
        ranked.withColumn("total", total)
        .withColumn("left", budget * F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("full", F.col("left") * F.col("weight") > most * F.col("source_size") * F.col("open"))
    )
    # the first source that is not full has the level of all that follow
    level = F.first(F.when(~F.col("full"), F.struct("left", "open")), ignorenulls=True).over(
        Window.orderBy(*by_fill).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return step.withColumn("level", level).select(
        "source", "source_size", "weight",
        F.when(F.col("full"), most * F.col("source_size")).otherwise(F.col("level.left") * F.col("weight") / F.col("level.open")).alias("target"),
    )


def draw(doc_id, text, seed: int = SEED) -> F.Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of seed, id and MD5 of the text."""
    row = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(row), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Two structs a document: row, its columns; mix: size, source_size, target, copies."""
    sized = docs.select(F.struct(*every(docs)).alias("row")).withColumn("size", word_count(F.col("row.text")))
    sizes = sized.groupBy(F.col("row.source").alias("source")).agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, budget, most)
    many = docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count()
    if many <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(rate)
    copies = (base + F.when(draw(F.col("row.doc_id"), F.col("row.text"), seed) < rate - base, 1).otherwise(0)).cast("long")
    joined = sized.join(plan, F.col("row.source").eqNullSafe(F.col("source")))
    return joined.select("row", F.struct("size", "source_size", "target", copies.alias("copies")).alias("mix"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as its copies say, with the columns of docs."""
    chosen = with_copies(docs, **options).where("mix.copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies")))).select("row.*")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return with_copies(docs).select("row.doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


OP10_SQL = """
WITH sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source
), step AS (
  SELECT *,
    1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
      - 2.0::DOUBLE * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS remains,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM sources
), marked AS (
  SELECT *, remains * weight > 2.0::DOUBLE * source_size * open AS filled FROM step
), level AS (
  SELECT remains AS l_remains, open AS l_open FROM marked WHERE NOT filled ORDER BY source_size / weight, source NULLS LAST LIMIT 1
), plan AS (
  SELECT source, source_size, CASE WHEN filled THEN 2.0::DOUBLE * source_size ELSE l_remains * weight / l_open END AS target
  FROM marked LEFT JOIN level ON true
), rated AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0.0::DOUBLE END AS rate,
    CAST(CAST('0x' || substr(md5('0:' || coalesce(CAST(s.doc_id AS VARCHAR), '') || ':' || md5(coalesce(s.text, ''))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
