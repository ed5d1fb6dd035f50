"""Registered queries over the driver's tables, each with the DuckDB SQL that checks it.

Every query reads its whole tables. Limits stand only where a top-k or a page is the operator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import hll
from quern.functions import text as T
from quern.functions import vectors as V
from quern.functions.registry import Scripts
from quern.operators import dictionaries, documents, geosets, hashes, keyspace, lists, sets, streams, strings, vectorsets, zsets
from quern.plans.aggregate import Reduce, aggregate
from quern.plans.index import Field, Index
from quern.plans.postings import Postings
from quern.plans.search import count, hybrid, search
from quern.sources import keys as K

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- sources as indexes and structures -------------------------------------------------------


def lineitem_index(spark: SparkSession, d: str) -> Index:
    df = K.table(spark, d, "lineitem").withColumn("__id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return Index(df, "__id", (
        Field("l_returnflag", "TAG", separator="", case_sensitive=True), Field("l_linestatus", "TAG", separator="", case_sensitive=True), Field("l_quantity", "NUMERIC", sortable=True),
        Field("l_extendedprice", "NUMERIC", sortable=True), Field("l_discount", "NUMERIC"), Field("l_tax", "NUMERIC"), Field("l_partkey", "NUMERIC"), Field("l_suppkey", "NUMERIC"),
    ))


def part_index(spark: SparkSession, d: str) -> Index:
    return Index(K.table(spark, d, "part"), "p_partkey", (
        Field("p_name", "TEXT"), Field("p_brand", "TAG"), Field("p_type", "TEXT"), Field("p_size", "NUMERIC", sortable=True),
        Field("p_retailprice", "NUMERIC", sortable=True), Field("p_mfgr", "TAG", "p_brand", index_missing=True),
    ))


def orders_index(spark: SparkSession, d: str) -> Index:
    return Index(K.table(spark, d, "orders"), "o_orderkey", (
        Field("o_orderstatus", "TAG"), Field("o_orderpriority", "TAG"), Field("o_totalprice", "NUMERIC", sortable=True), Field("o_custkey", "NUMERIC"),
    ))


def documents_index(spark: SparkSession, d: str, **options) -> Index:
    docs = K.table(spark, d, "documents")
    return Index(docs, "doc_id", (Field("text", "TEXT"), Field("lang", "TAG"), Field("source", "TAG"), Field("n_chars", "NUMERIC", sortable=True)), **options)


def embeddings_index(spark: SparkSession, d: str, metric: str = "L2") -> Index:
    return Index(K.table(spark, d, "embeddings"), "vec_id", (Field("embedding", "VECTOR", metric=metric), Field("label", "NUMERIC")))


def vector_zero(spark: SparkSession, d: str) -> list[float]:
    return list(K.table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


def customer_zset(spark: SparkSession, d: str) -> DataFrame:
    """One sorted set a segment: customers by balance."""
    return K.table(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


def nation_zsets(spark: SparkSession, d: str) -> DataFrame:
    """Nations by balance, one sorted set of customers and one of suppliers."""
    def one(table: str, nation: str, balance: str) -> DataFrame:
        rows = K.table(spark, d, table).groupBy(nation).agg(F.max(balance).alias("score"))
        return rows.select(F.lit(table).alias("key"), F.col(nation).cast("string").alias("member"), "score")

    return one("customer", "c_nationkey", "c_acctbal").unionByName(one("supplier", "s_nationkey", "s_acctbal"))


def status_sets(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the status of their orders."""
    return K.table(spark, d, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_custkey").alias("member")).distinct()


def part_hashes(spark: SparkSession, d: str) -> DataFrame:
    """One hash a part; fields are its columns."""
    part = K.table(spark, d, "part")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ("p_name", "p_brand", "p_type", "p_size")]))
    return part.select(F.concat(F.lit("part:"), F.col("p_partkey")).alias("key"), pairs.alias("x")).select("key", "x.*").where("value is not null")


def order_lists(spark: SparkSession, d: str) -> DataFrame:
    """One list a customer: order keys in ascending order."""
    return K.table(spark, d, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey")).alias("key"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("value"))


def _millis() -> Column:
    return F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


def event_streams(spark: SparkSession, d: str) -> DataFrame:
    """One stream an event type; ids are the event's time and number."""
    ev = K.table(spark, d, "events")
    return ev.select(F.col("event_type").alias("key"), _millis().alias("ms"), F.col("event_id").alias("seq"), F.array(F.struct(F.lit("user").alias("name"), F.col("user_id").cast("string").alias("value"))).alias("fields"))


def customer_places(spark: SparkSession, d: str) -> DataFrame:
    """Places by arithmetic on customer keys."""
    lon = (F.col("c_custkey") * 37 % 3600) / 10 - 180.0
    lat = (F.col("c_custkey") * 53 % 1600) / 10 - 80.0
    return K.table(spark, d, "customer").select(F.lit("places").alias("key"), F.col("c_name").alias("member"), lon.alias("lon"), lat.alias("lat"))


_PLACES = "SELECT c_name AS member, (c_custkey * 37 % 3600) / 10 - 180.0::DOUBLE AS lon, (c_custkey * 53 % 1600) / 10 - 80.0::DOUBLE AS lat FROM customer"


def _hav(lon1: str, lat1: str, lon2: str, lat2: str, r: str) -> str:
    u, v = f"sin((radians({lat2}) - radians({lat1})) / 2)", f"sin((radians({lon2}) - radians({lon1})) / 2)"
    return f"2.0 * {r} * asin(sqrt({u} * {u} + cos(radians({lat1})) * cos(radians({lat2})) * {v} * {v}))"


# --- aggregation pipeline --------------------------------------------------------------------


@_register("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
  round(avg(l_discount), 6) AS avg_disc, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY ALL""")
def agg_pricing_summary(spark, d):
    p = aggregate(lineitem_index(spark, d), "*").group(
        ["@l_returnflag", "@l_linestatus"], Reduce("COUNT", name="n"), Reduce("SUM", "@l_quantity", "sum_qty"), Reduce("SUM", "@l_extendedprice", "sum_price"),
        Reduce("AVG", "@l_discount", "avg_disc"), Reduce("MIN", "@l_quantity", "min_qty"), Reduce("MAX", "@l_quantity", "max_qty"), Reduce("COUNT_DISTINCT", "@l_suppkey", "suppliers"),
    ).sortby("@l_returnflag", "@l_linestatus")
    return p.frame().withColumns({c: F.round(c, n) for c, n in (("sum_qty", 2), ("sum_price", 2), ("avg_disc", 6))})


@_register("""
SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
WHERE l_quantity >= 10 AND l_quantity < 24 AND l_linestatus = 'O' AND l_extendedprice * (1 - l_discount) >= 1000 GROUP BY 1""")
def agg_apply_filter(spark, d):
    p = aggregate(lineitem_index(spark, d), "@l_quantity:[10 (24] @l_linestatus:{O}").apply("@l_extendedprice * (1 - @l_discount)", "net").filter("@net >= 1000")
    return p.group(["@l_returnflag"], Reduce("SUM", "@net", "revenue")).frame().withColumn("revenue", F.round("revenue", 2))


@_register("""
WITH per AS (SELECT o_custkey, o_orderstatus, sum(o_totalprice) AS total FROM orders GROUP BY ALL)
SELECT o_orderstatus, count(*) AS customers, round(max(total), 2) AS top FROM per GROUP BY 1""")
def agg_group_twice(spark, d):
    p = aggregate(orders_index(spark, d), "*").group(["@o_custkey", "@o_orderstatus"], Reduce("SUM", "@o_totalprice", "total"))
    return p.group(["@o_orderstatus"], Reduce("COUNT", name="customers"), Reduce("MAX", "@total", "top")).frame().withColumn("top", F.round("top", 2))


@_register("""
SELECT o_orderpriority, arg_min(CAST(o_custkey AS VARCHAR), o_orderkey) AS first_customer, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def agg_first_value(spark, d):
    return aggregate(orders_index(spark, d), "*").group(["@o_orderpriority"], Reduce("FIRST_VALUE", "@o_custkey", "first_customer"), Reduce("COUNT_DISTINCTISH", "@o_custkey", "customers")).frame()


@_register("SELECT p_brand, list(p_name ORDER BY p_partkey) AS names FROM part WHERE p_size <= 5 GROUP BY 1")
def agg_tolist(spark, d):
    return aggregate(part_index(spark, d), "@p_size:[-inf 5]").group(["@p_brand"], Reduce("TOLIST", "@p_name", "names")).frame()


@_register("SELECT upper(p_brand) AS brand, p_partkey, floor(p_retailprice / 7) AS f, ceil(sqrt(p_size)) AS c, abs(p_size - 25)::DOUBLE AS a FROM part")
def agg_functions(spark, d):
    p = aggregate(part_index(spark, d), "*").load("@p_partkey").apply("upper(@p_brand)", "brand").apply("floor(@p_retailprice / 7)", "f").apply("ceil(sqrt(@p_size))", "c").apply("abs(@p_size - 25)", "a")
    return p.frame()


@_register("""
SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice ASC, p_partkey LIMIT 25 OFFSET 5""")
def agg_sort_page(spark, d):
    return aggregate(part_index(spark, d), "*").load("@p_partkey", "@p_size", "@p_retailprice").sortby(("@p_size", "DESC"), ("@p_retailprice", "ASC")).limit(5, 25).frame()


@_register("SELECT count(*) AS total FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_discount > 0.05")
def agg_total(spark, d):
    return aggregate(lineitem_index(spark, d), "@l_returnflag:{A|N} @l_discount:[(0.05 +inf]").total()


# --- predicates and search -------------------------------------------------------------------


@_register("""SELECT o_orderkey AS key, o_totalprice AS price FROM orders
WHERE o_orderstatus IN ('F', 'O') AND NOT o_orderpriority = '1-URGENT' AND (o_totalprice BETWEEN 1000 AND 50000 OR o_totalprice > 200000)""")
def search_boolean(spark, d):
    q = r"@o_orderstatus:{F|O} -@o_orderpriority:{1\-URGENT} (@o_totalprice:[1000 50000]|@o_totalprice:[(200000 inf])"
    return search(orders_index(spark, d), q, limit=None, returns=[("o_totalprice", "price")]).select("key", "price")


_JOIN = ", '([\\p{L}\\p{N}_])[''.,’]([\\p{L}\\p{N}_])', '\\1\\2', 'g')"
_TOKENS = f"regexp_extract_all(regexp_replace(regexp_replace(lower(text){_JOIN}{_JOIN}, '[\\p{{L}}\\p{{N}}_]+')"


@_register(f"SELECT doc_id AS key FROM documents WHERE list_contains({_TOKENS}, 'worthless') OR list_contains({_TOKENS}, 'idiot')")
def search_text_or(spark, d):
    return search(documents_index(spark, d), "worthless|idiot", limit=None, returns=[], verbatim=True).select("key")


@_register(f"SELECT doc_id AS key FROM documents WHERE contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' of the ') AND lang = 'en'")
def search_phrase(spark, d):
    return search(documents_index(spark, d), '"of the" @lang:{en}', limit=None, returns=[], verbatim=True).select("key")


@_register(f"SELECT count(*) AS total FROM documents WHERE len(list_filter({_TOKENS}, lambda t: starts_with(t, 'thth'))) > 0")
def search_prefix_count(spark, d):
    return count(documents_index(spark, d), "thth*")


@_register(f"SELECT count(*) AS total FROM documents WHERE len(list_filter({_TOKENS}, lambda t: regexp_full_match(t, 'er.*ng.'))) > 0")
def search_wildcard_count(spark, d):
    return count(documents_index(spark, d), "er*ng?")


@_register("""SELECT p_partkey AS key FROM part WHERE len(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9_]+'),
  lambda t: levenshtein(t, 'smlal') <= 1 OR t IN ('mslal', 'slmal', 'small', 'smlla'))) > 0""")
def search_fuzzy(spark, d):
    return search(part_index(spark, d), "@p_name:%smlal%", limit=None, returns=[]).select("key")


@_register("SELECT p_partkey AS key, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 10")
def search_sorted_page(spark, d):
    return search(part_index(spark, d), "*", sortby=("p_retailprice", "DESC"), limit=(10, 10), returns=["p_name"]).select("key", "p_name")


@_register("SELECT count(*) AS total FROM part WHERE p_size > 40")
def search_missing(spark, d):
    """Brands of large parts are taken away, so that there are missing ones."""
    ix = part_index(spark, d)
    return count(replace(ix, source=ix.source.withColumn("p_brand", F.when(F.col("p_size") <= 40, F.col("p_brand")))), "ismissing(@p_mfgr)")


_BM25 = f"""
WITH t AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents),
s AS (SELECT count(*) AS n, avg(len(tokens)) AS l, count(*) FILTER (list_contains(tokens, 'worthless')) AS d1, count(*) FILTER (list_contains(tokens, 'pathetic')) AS d2 FROM t),
x AS (SELECT doc_id, len(tokens) AS len, len(list_filter(tokens, lambda t: t = 'worthless')) AS t1, len(list_filter(tokens, lambda t: t = 'pathetic')) AS t2, s.* FROM t, s),
r AS (SELECT doc_id, ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * len / l)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * len / l)) AS score
  FROM x WHERE t1 + t2 > 0)
"""


@_register(f"{_BM25} SELECT doc_id AS key, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 20")
def search_bm25(spark, d):
    return search(documents_index(spark, d), "worthless|pathetic", limit=(0, 20), returns=[], verbatim=True).select("key", F.round("score", 6).alias("score"))


def _written(spark: SparkSession, d: str) -> Postings:
    """The words of all documents, written from those that have other texts first and refreshed with theirs."""
    own, folder = documents_index(spark, d), K.scratch(spark, "postings")
    other = own.source.withColumn("text", F.when(F.col("doc_id") % 3 > 0, F.col("text")).otherwise(F.concat(F.lit("worthless "), "text")))
    Postings(replace(own, source=other), folder).build()
    return Postings(own, folder).refresh(own.source.where("doc_id % 3 = 0").select("doc_id"))


@_register(f"{_BM25} SELECT doc_id AS key, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 20")
def postings_bm25(spark, d):
    found = _written(spark, d).search("worthless|pathetic", limit=(0, 20), verbatim=True)
    return found.select(F.col("key").cast("long").alias("key"), F.round("score", 6).alias("score"))


@_register(f"SELECT doc_id AS key FROM documents WHERE contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' of the ') AND lang = 'en'")
def postings_phrase(spark, d):
    found = _written(spark, d).search('"of the" @lang:{en}', limit=None, verbatim=True)
    return found.select(F.col("key").cast("long").alias("key"))


@_register(f"{_BM25} SELECT doc_id AS key, round(score / (score + 1.2), 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 20")
def search_bm25_legacy(spark, d):
    return search(documents_index(spark, d), "worthless|pathetic", limit=(0, 20), returns=[], verbatim=True, scorer="BM25").select("key", F.round("score", 6).alias("score"))


@_register(f"""SELECT documents.doc_id AS key, n_chars::DOUBLE AS score FROM documents WHERE list_contains({_TOKENS}, 'clown') ORDER BY score DESC, key LIMIT 15""")
def search_docscore(spark, d):
    return search(documents_index(spark, d, score_field="n_chars"), "clown", limit=(0, 15), returns=[], verbatim=True, scorer="DOCSCORE").select("key", "score")


@_register(f"""SELECT doc_id AS key, regexp_replace(text, '(clown)', '<b>\\1</b>', 'gi') AS text FROM documents WHERE list_contains({_TOKENS}, 'clown')""")
def search_highlight(spark, d):
    return search(documents_index(spark, d), "clown", limit=None, returns=["text"], verbatim=True, highlight={}).select("key", "text")


@_register()
def search_summarize(spark, d):
    return search(documents_index(spark, d), "clown", limit=None, returns=["text"], verbatim=True, summarize={"fragments": 2, "length": 30}).select("key", "text")


@_register()
def search_slop(spark, d):
    return search(documents_index(spark, d), '"the idiot"=>{$slop:3;$inorder:false}', limit=None, returns=[], verbatim=True).select("key")


@_register(f"SELECT documents.doc_id AS key, n_chars::DOUBLE AS score FROM documents WHERE len(list_filter({_TOKENS}, lambda t: regexp_full_match(t, 'clown(s|ed|ing)?'))) > 0")
def search_stem(spark, d):
    """Words of the query's stem, whatever form the query has."""
    return search(documents_index(spark, d, score_field="n_chars"), "clowns", limit=None, returns=[], scorer="DOCSCORE").select("key", "score")


def _ranked_variants(tokens: str, extra: str, asked: list[str]) -> str:
    """BM25 over tokens and, once each, the variants that are none of them."""
    n = range(len(asked))
    idf = " + ".join(
        f"CASE WHEN t{i} > 0 THEN ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / l)) ELSE 0 END" for i in n
    )
    counts = ", ".join(f"len(list_filter(v, lambda t: t = '{w}')) AS t{i}" for i, w in enumerate(asked))
    return f"""
WITH t AS (SELECT doc_id, {tokens} AS tokens FROM documents), e AS (SELECT doc_id, tokens, {extra} AS extra FROM t),
v AS (SELECT doc_id, list_concat(tokens, list_filter(list_distinct(extra), lambda x: NOT list_contains(tokens, x))) AS v FROM e),
c AS (SELECT doc_id, len(v) AS len, {counts} FROM v),
s AS (SELECT count(*) AS n, avg(len) AS l, {', '.join(f'count(*) FILTER (t{i} > 0) AS d{i}' for i in n)} FROM c),
r AS (SELECT doc_id, {idf} AS score FROM c, s WHERE {' OR '.join(f't{i} > 0' for i in n)})
SELECT doc_id AS key, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 20"""


_SYNONYMS = ("clown", "jester", "idiot")


@_register(_ranked_variants(_TOKENS, f"CASE WHEN list_has_any(tokens, {list(_SYNONYMS)}) THEN {list(_SYNONYMS)} ELSE [] END", ["jester"]))
def search_synonym(spark, d):
    ix = documents_index(spark, d, synonyms=(_SYNONYMS,))
    ix = replace(ix, fields=(replace(ix.fields[0], stem=False), *ix.fields[1:]))
    return search(ix, "jester", limit=(0, 20), returns=[]).select("key", F.round("score", 6).alias("score"))


def _soundex_sql(t: str) -> str:
    t = f"replace({t}, 'ß', 'ss')"  # as upper case has it
    digits = f"translate(upper({t}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
    for k in "0123456789":
        digits = f"regexp_replace({digits}, '{k}{k}+', '{k}', 'g')"
    return f"CASE WHEN regexp_matches({t}, '^[a-z]') THEN 'phon' || lower(rpad(upper({t})[1] || regexp_replace(substr({digits}, 2, 64), '[^1-6]', '', 'g'), 4, '0')[1:4]) END"


@_register(_ranked_variants(_TOKENS, f"list_filter(list_transform(list_distinct(tokens), lambda x: {_soundex_sql('x')}), lambda x: x IS NOT NULL)", ["cloun", "phonc450"]))
def search_phonetic(spark, d):
    ix = documents_index(spark, d)
    ix = replace(ix, fields=(replace(ix.fields[0], stem=False, phonetic=True), *ix.fields[1:]))
    return search(ix, "cloun", limit=(0, 20), returns=[]).select("key", F.round("score", 6).alias("score"))


@_register(f"""{_BM25}, x1 AS (SELECT x.doc_id, greatest(
  ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * len / l)), ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * len / l))) AS score FROM x WHERE t1 + t2 > 0)
SELECT doc_id AS key, round(score, 6) AS score FROM x1 ORDER BY x1.score DESC, doc_id LIMIT 20""")
def search_dismax(spark, d):
    return search(documents_index(spark, d), "worthless|pathetic", limit=(0, 20), returns=[], verbatim=True, scorer="DISMAX").select("key", F.round("score", 6).alias("score"))


@_register(f"""{_BM25.replace("ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1", "3 * ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1")}
SELECT doc_id AS key, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 20""")
def search_weights(spark, d):
    return search(documents_index(spark, d), "(worthless)=>{$weight:3}|pathetic", limit=(0, 20), returns=[], verbatim=True).select("key", F.round("score", 6).alias("score"))


@_register(f"""SELECT member AS key FROM ({_PLACES}) WHERE {_hav('20.0', '10.0', 'lon', 'lat', '6371000.0')} <= 2000000.0""")
def search_geo(spark, d):
    ix = Index(customer_places(spark, d), "member", (Field("at", "GEO", ("lon", "lat")),))
    return search(ix, "@at:[20 10 2000 km]", limit=None, returns=[]).select("key")


@_register(f"""SELECT member AS key FROM ({_PLACES}) WHERE lon >= -10 AND lon <= 30 AND lat >= 0 AND lat <= 40""")
def search_geoshape(spark, d):
    wkt = F.format_string("POINT(%s %s)", F.col("lon"), F.col("lat"))
    ix = Index(customer_places(spark, d).withColumn("shape", wkt), "member", (Field("shape", "GEOSHAPE"),))
    return search(ix, "@shape:[WITHIN $box]", params={"box": "POLYGON((-10 0, 30 0, 30 40, -10 40, -10 0))"}, limit=None, returns=[]).select("key")


@_register("SELECT DISTINCT lower(trim(o_orderpriority)) AS tag FROM orders")
def tag_values(spark, d):
    return dictionaries.tag_values(orders_index(spark, d), "o_orderpriority")


# --- vectors -----------------------------------------------------------------------------------

_Q = "q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
_L2 = "list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_COS = "1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))"


@_register(f"WITH {_Q} SELECT vec_id AS key, round({_L2}, 6) AS distance FROM e, q ORDER BY {_L2}, vec_id LIMIT 10")
def vector_knn_l2(spark, d):
    return search(embeddings_index(spark, d), "*=>[KNN 10 @embedding $v]", params={"v": vector_zero(spark, d)}, returns=[]).select("key", F.round("score", 6).alias("distance"))


@_register(f"WITH {_Q} SELECT vec_id AS key, round({_COS}, 6) AS distance FROM e, q WHERE label >= 2 AND label <= 4 ORDER BY {_COS}, vec_id LIMIT 15")
def vector_knn_filtered(spark, d):
    return search(embeddings_index(spark, d, "COSINE"), "(@label:[2 4])=>[KNN 15 @embedding $v]", params={"v": vector_zero(spark, d)}, limit=(0, 15), returns=[]).select("key", F.round("score", 6).alias("distance"))


@_register(f"WITH {_Q} SELECT vec_id AS key, round(-list_dot_product(e, q), 6) AS distance FROM e, q ORDER BY -list_dot_product(e, q), vec_id LIMIT 10")
def vector_knn_ip(spark, d):
    return search(embeddings_index(spark, d, "IP"), "*=>[KNN 10 @embedding $v]", params={"v": vector_zero(spark, d)}, returns=[]).select("key", F.round("score", 6).alias("distance"))


@_register(f"WITH {_Q} SELECT vec_id AS key FROM e, q WHERE {_L2} <= 1.5 * 1.01")
def vector_range(spark, d):
    return search(embeddings_index(spark, d), "@embedding:[VECTOR_RANGE 1.5 $v]", params={"v": vector_zero(spark, d)}, limit=None, returns=[]).select("key")


@_register(f"""WITH {_Q} SELECT CAST(vec_id AS VARCHAR) AS id, round(greatest(0, least(1, 1 - ({_COS}) / 2)), 6) AS score FROM e, q
WHERE label IN (1, 3) AND vec_id > 20 ORDER BY {_COS}, id LIMIT 12""")
def vector_set_similar(spark, d):
    attrs = F.to_json(F.struct(F.col("label"), F.col("vec_id").alias("n")))
    vs = K.table(spark, d, "embeddings").select(F.lit("v").alias("key"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), attrs.alias("attrs"))
    return vectorsets.similar(vs, "v", vector_zero(spark, d), 12, ".label in (1, 3) && .n > 20").select("id", F.round("score", 6).alias("score"))


@_register("SELECT count(*) AS card, CAST(max(len(embedding)) AS INT) AS dim, 'v' AS key FROM embeddings")
def vector_set_info(spark, d):
    vs = K.table(spark, d, "embeddings").select(F.lit("v").alias("key"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("attrs"))
    return vectorsets.info(vs)


@_register()
def vector_projection(spark, d):
    vs = K.table(spark, d, "embeddings").select(F.lit("v").alias("key"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectorsets.projected(vs, 16).select("id", V.sign_bits(F.col("vector")).alias("bits"))


_HYBRID = f"""
{_BM25.replace("FROM documents)", "FROM (SELECT coalesce(doc_id, vec_id) AS doc_id, coalesce(text, '') AS text FROM documents FULL JOIN embeddings ON doc_id = vec_id))")}, {_Q}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS n FROM r QUALIFY n <= 20),
k AS (SELECT vec_id, row_number() OVER (ORDER BY {_L2}, vec_id) AS n FROM e, q QUALIFY n <= 20)
SELECT coalesce(a.doc_id, k.vec_id) AS key, round(coalesce(1 / (60 + a.n), 0) + coalesce(1 / (60 + k.n), 0), 9) AS score
FROM a FULL JOIN k ON a.doc_id = k.vec_id ORDER BY coalesce(1 / (60 + a.n), 0) + coalesce(1 / (60 + k.n), 0) DESC, key LIMIT 20"""


@_register(_HYBRID)
def hybrid_rrf(spark, d):
    both = K.table(spark, d, "documents").join(K.table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "full_outer")
    ix = Index(both, "doc_id", (Field("text", "TEXT"), Field("embedding", "VECTOR")))
    return hybrid(ix, "worthless|pathetic", "embedding", vector_zero(spark, d), k=20, window=20, limit=(0, 20), verbatim=True).select("key", F.round("score", 9).alias("score"))


# --- sets ---------------------------------------------------------------------------------------


@_register("SELECT DISTINCT o_custkey AS member FROM orders WHERE o_orderstatus IN ('F', 'P')")
def set_union(spark, d):
    return sets.union(status_sets(spark, d), ["F", "P"])


@_register("SELECT o_custkey AS member FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersection(spark, d):
    return sets.intersection(status_sets(spark, d), ["F", "O"])


@_register("SELECT o_custkey AS member FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def set_difference(spark, d):
    return sets.difference(status_sets(spark, d), ["O", "F", "P"])


@_register("SELECT o_orderstatus AS key, count(DISTINCT o_custkey) AS card FROM orders GROUP BY 1")
def set_cardinality(spark, d):
    return sets.cardinality(status_sets(spark, d))


@_register("SELECT least(100, count(*)) AS card FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def set_intersection_size(spark, d):
    return sets.intersection_size(status_sets(spark, d), ["F", "P"], 100)


@_register("SELECT * FROM (VALUES (0, 1::BIGINT, 1), (1, -5, 0), (2, 7, 1)) t(ordinal, member, found) WHERE false UNION ALL SELECT i, m, CAST(EXISTS (SELECT 1 FROM orders WHERE o_custkey = m AND o_orderstatus = 'O') AS INT) FROM (VALUES (0, 1::BIGINT), (1, -5), (2, 7)) v(i, m)")
def set_is_member(spark, d):
    return sets.is_member(status_sets(spark, d), "O", [1, -5, 7])


# --- sorted sets ----------------------------------------------------------------------------------


@_register("SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_name) - 1 AS INT) AS rank FROM customer")
def zset_ranks(spark, d):
    return zsets.ranked(customer_zset(spark, d))


@_register("SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_name DESC) - 1 AS INT) AS rank FROM customer QUALIFY rank < 5")
def zset_top(spark, d):
    return zsets.top(customer_zset(spark, d), 5)


@_register("SELECT c_name AS member, c_acctbal AS score FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY 2, 1 LIMIT 20 OFFSET 10")
def zset_range_by_rank(spark, d):
    return zsets.range_by_rank(customer_zset(spark, d), "BUILDING", 10, 29)


@_register("SELECT c_name AS member, c_acctbal AS score FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100 AND c_acctbal <= 5000")
def zset_range_by_score(spark, d):
    return zsets.range_where(customer_zset(spark, d), "BUILDING", zsets.by_score("(100", 5000))


@_register("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_name >= 'Customer#000000100' AND c_name < 'Customer#000000900'")
def zset_lex_count(spark, d):
    return zsets.count(customer_zset(spark, d), "MACHINERY", zsets.by_lex("[Customer#000000100", "(Customer#000000900"))


@_register("""WITH z AS (SELECT CAST(c_nationkey AS VARCHAR) AS member, max(c_acctbal) * 2 AS score FROM customer GROUP BY 1
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), max(s_acctbal) * 0.5 FROM supplier GROUP BY 1) SELECT member, round(sum(score), 6) AS score FROM z GROUP BY 1""")
def zset_union(spark, d):
    return zsets.union(nation_zsets(spark, d), ["customer", "supplier"], [2.0, 0.5]).select("member", F.round("score", 6).alias("score"))


@_register("""SELECT a.member, least(a.score, b.score) AS score FROM (SELECT CAST(c_nationkey AS VARCHAR) AS member, max(c_acctbal) AS score FROM customer GROUP BY 1) a
JOIN (SELECT CAST(s_nationkey AS VARCHAR) AS member, max(s_acctbal) AS score FROM supplier GROUP BY 1) b USING (member)""")
def zset_intersection(spark, d):
    return zsets.intersection(nation_zsets(spark, d), ["customer", "supplier"], fold="MIN")


@_register("SELECT CAST(o_custkey AS VARCHAR) AS member, max(o_totalprice) AS score FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def zset_difference(spark, d):
    """Customers by their dearest order of a status."""
    dear = K.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("key"), F.col("o_custkey").cast("string").alias("member")).agg(F.max("o_totalprice").alias("score"))
    return zsets.difference(dear, ["O", "P"])


@_register("SELECT CAST(s_nationkey AS VARCHAR) AS member, max(s_acctbal) AS score, 'supplier' AS key FROM supplier GROUP BY 1 ORDER BY score DESC, member DESC LIMIT 3")
def zset_pop(spark, d):
    return zsets.pop(nation_zsets(spark, d), ["none", "supplier", "customer"], 3, highest=True)[0]


# --- hashes and lists --------------------------------------------------------------------------


@_register("SELECT 'part:' || p_partkey AS key, 'p_name' AS field, CAST(strlen(p_name) AS INT) AS length FROM part UNION ALL SELECT 'part:' || p_partkey, 'p_brand', CAST(strlen(p_brand) AS INT) FROM part UNION ALL SELECT 'part:' || p_partkey, 'p_type', CAST(strlen(p_type) AS INT) FROM part UNION ALL SELECT 'part:' || p_partkey, 'p_size', CAST(strlen(CAST(p_size AS VARCHAR)) AS INT) FROM part")
def hash_value_lengths(spark, d):
    return hashes.value_lengths(part_hashes(spark, d))


@_register("SELECT 'part:' || p_partkey AS key, CAST(4 AS BIGINT) AS fields FROM part")
def hash_lengths(spark, d):
    return hashes.lengths(part_hashes(spark, d))


@_register("SELECT 'part:' || p_partkey AS key, 'p_size' AS field, CAST(p_size + 10 AS VARCHAR) AS value FROM part")
def hash_increment(spark, d):
    own = part_hashes(spark, d).where("field = 'p_size'")
    return hashes.increment(own, own.select("key", "field", F.lit(10).alias("delta")))


@_register("SELECT 'part:' || p_partkey AS key, p_name, p_brand FROM part")
def hash_documents(spark, d):
    return K.hash_documents(part_hashes(spark, d), "part:", ["p_name", "p_brand"])


@_register("SELECT 'c:' || o_custkey AS key, count(*) AS length FROM orders GROUP BY 1")
def list_lengths(spark, d):
    return lists.lengths(order_lists(spark, d))


@_register("SELECT 'c:' || o_custkey AS key, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS values FROM orders GROUP BY 1")
def list_arrays(spark, d):
    return lists.as_array(order_lists(spark, d))


@_register("SELECT 'c:' || o_custkey AS key, o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS value, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS INT) AS index FROM orders QUALIFY index < 2")
def list_tails(spark, d):
    return lists.heads(order_lists(spark, d), 2, tail=True)


@_register("SELECT o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey DESC LIMIT 3")
def list_slice(spark, d):
    return lists.slice_(order_lists(spark, d), "c:7", -3, -1)


# --- strings, bits, sketches -------------------------------------------------------------------


@_register("SELECT c_custkey, CAST(strlen(c_name) AS INT) AS bytes, substr(c_name, strlen(c_name) - 3, 3) AS piece FROM customer")
def string_ranges(spark, d):
    return K.table(spark, d, "customer").select("c_custkey", strings.byte_length(F.col("c_name")).alias("bytes"), strings.byte_range(F.col("c_name"), -4, -2).cast("string").alias("piece"))


@_register("SELECT CAST(o_custkey AS VARCHAR) AS key, CAST(sum(floor(o_totalprice)) AS BIGINT) AS value FROM orders GROUP BY 1")
def string_counters(spark, d):
    return strings.counters(K.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.floor("o_totalprice").alias("delta")))


@_register("SELECT o_orderstatus AS key, string_agg(o_orderpriority[1], '' ORDER BY o_orderkey) AS value FROM orders GROUP BY 1")
def string_append(spark, d):
    return strings.appended(K.table(spark, d, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_orderkey").alias("seq"), F.substring("o_orderpriority", 1, 1).alias("value")))


@_register("""SELECT c_custkey, CAST(list_sum(list_transform(range(1, strlen(c_name) + 1), lambda i: bit_count(ord(c_name[i])))) AS INT) AS bits,
  CAST((ord(c_name[2]) >> 5) & 1 AS INT) AS bit10, CAST(ord(c_name[1]) * 256 + ord(c_name[2]) AS BIGINT) AS word FROM customer""")
def string_bits(spark, d):
    c = F.col("c_name")
    return K.table(spark, d, "customer").select("c_custkey", strings.bit_count(c).alias("bits"), strings.bit_at(c, 10).alias("bit10"), strings.bit_field(c, "u16", 0).alias("word"))


@_register("""WITH b AS (SELECT i, max(CASE WHEN ord(c_name[i]) & 1 = 1 THEN 1 ELSE 0 END) FROM customer, range(1, 19) t(i) GROUP BY 1)
SELECT string_agg(chr(CAST(x AS INT)), '' ORDER BY i) AS value FROM (SELECT i, bit_or(ord(c_name[i])) AS x FROM customer, range(1, 19) t(i) GROUP BY i)""")
def string_bitop(spark, d):
    return strings.bit_operation(K.table(spark, d, "customer").select(F.substring("c_name", 1, 18).alias("value")), "OR").select(F.col("value").cast("string").alias("value"))


@_register()
def hll_estimates(spark, d):
    rows = K.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("element"))
    return hll.estimates(hll.registers(rows))


@_register("SELECT c_nationkey AS key, CAST(bit_count(bit_or(1::BIGINT << CAST(c_custkey % 50 AS INT))) AS INT) AS distinct_bits FROM customer GROUP BY 1")
def bitmap_per_key(spark, d):
    bit = F.expr("shiftleft(1L, cast(c_custkey % 50 as int))")
    return K.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.bit_count(F.bit_or(bit)).alias("distinct_bits"))


# --- streams --------------------------------------------------------------------------------------


@_register("SELECT event_type AS key, count(*) AS length FROM events GROUP BY 1")
def stream_lengths(spark, d):
    return streams.lengths(event_streams(spark, d))


@_register("SELECT event_type AS key, (epoch_us(ts) // 1000) AS ms, event_id AS seq FROM events WHERE event_type = 'click' AND (epoch_us(ts) // 1000) >= (SELECT min((epoch_us(ts) // 1000)) + 100000000 FROM events)")
def stream_range(spark, d):
    ev = event_streams(spark, d)
    first = ev.agg(F.min("ms")).first()[0]
    return streams.id_range(ev, "click", f"{first + 100000000}", "+").select("key", "ms", "seq")


@_register("""SELECT event_type AS key, (epoch_us(ts) // 1000) AS ms, event_id AS seq FROM events WHERE event_type IN ('click', 'view')
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000), event_id) <= 50""")
def stream_read(spark, d):
    return streams.read(event_streams(spark, d), {"click": "0", "view": "0"}, 50).select("key", "ms", "seq")


@_register("SELECT event_type AS key, (epoch_us(ts) // 1000) AS ms, event_id AS seq FROM events QUALIFY event_type <> 'click' OR row_number() OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000) DESC, event_id DESC) <= 100")
def stream_trim(spark, d):
    return streams.trim(event_streams(spark, d), "click", 100).select("key", "ms", "seq")


@_register("""WITH x AS (SELECT event_type AS key, event_id, (epoch_us(ts) // 1000) // 60000 AS minute FROM events),
m AS (SELECT *, max(minute) OVER (PARTITION BY key ORDER BY event_id) AS ms FROM x)
SELECT key, event_id AS arrival, ms, row_number() OVER (PARTITION BY key, ms ORDER BY event_id) - 1 AS seq FROM m""")
def stream_assign_ids(spark, d):
    rows = K.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("arrival"), F.floor(_millis() / 60000).alias("now"))
    return streams.assign_ids(rows).select("key", "arrival", "ms", "seq")


def _group_log(spark, d):
    """Every stream has a group: it reads twice, acknowledges nothing, and one consumer claims."""
    keys = K.table(spark, d, "events").select(F.col("event_type").alias("key")).distinct()
    steps = [(0, "CREATE", None, "0", None), (1, "READ", "a", ">", 30), (2, "READ", "b", ">", 20), (3, "AUTOCLAIM", "b", "0", 10)]
    commands = F.array(*[F.struct(F.lit(s).alias("seq"), F.lit(c).alias("cmd"), F.lit(w).cast("string").alias("consumer"), F.lit(i).alias("id"), F.lit(n).cast("long").alias("n")) for s, c, w, i, n in steps])
    log = keys.select("key", F.lit("g").alias("grp"), F.explode(commands).alias("x")).select("key", "grp", "x.*")
    return log.withColumn("ids", F.lit(None).cast("array<string>")).withColumn("now", F.col("seq").cast("long")).withColumn("idle", F.lit(0).cast("long"))


@_register("""WITH x AS (SELECT event_type AS key, (epoch_us(ts) // 1000) AS ms, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events)
SELECT key, ms, seq, CASE WHEN n <= 10 OR n > 30 THEN 'b' ELSE 'a' END AS consumer, CAST(CASE WHEN n <= 10 THEN 2 ELSE 1 END AS BIGINT) AS deliveries FROM x WHERE n <= 50""")
def stream_group_pending(spark, d):
    found = streams.replay_groups(event_streams(spark, d), _group_log(spark, d))
    return found.where("cmd = 'PENDING'").select("key", "ms", "seq", "consumer", "deliveries")


# --- documents -------------------------------------------------------------------------------------


@_register("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_get(spark, d):
    return K.table(spark, d, "events").select("event_id", documents.get(F.col("props"), "$.k").alias("k"))


@_register("SELECT event_id, 'object' AS kind, 'integer' AS inner_kind, ['k'] AS names FROM events")
def json_types(spark, d):
    p = F.col("props")
    return K.table(spark, d, "events").select("event_id", documents.kind(p).alias("kind"), documents.kind(p, "$.k").alias("inner_kind"), documents.keys(p).alias("names"))


@_register("SELECT event_id, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + 5 AS VARCHAR) AS reply FROM events")
def json_increment(spark, d):
    return K.table(spark, d, "events").select("event_id", documents.add_number("$.k", 5)(F.col("props"))["reply"].alias("reply"))


# --- geo sets ---------------------------------------------------------------------------------------


@_register(f"""SELECT member, round({_hav('15.0', '37.0', 'lon', 'lat', '6372797.560856')} / 1000, 3) AS km FROM ({_PLACES})
WHERE {_hav('15.0', '37.0', 'lon', 'lat', '6372797.560856')} <= 3000000""")
def geo_radius(spark, d):
    return geosets.search(customer_places(spark, d).withColumn("score", F.lit(0)), "places", lonlat=(15.0, 37.0), radius=3000, unit="km").select("member", F.round("distance", 3).alias("km"))


@_register(f"""SELECT member FROM ({_PLACES}) WHERE {_hav('lon', '30.0', 'lon', 'lat', '6372797.560856')} <= 1000000 AND {_hav('0.0', 'lat', 'lon', 'lat', '6372797.560856')} <= 2000000""")
def geo_box(spark, d):
    return geosets.search(customer_places(spark, d).withColumn("score", F.lit(0)), "places", lonlat=(0.0, 30.0), box=(4000, 2000), unit="km").select("member")


@_register(f"""SELECT member, round(lon, 3) AS lon, round(lat, 3) AS lat FROM ({_PLACES})""")
def geo_cells(spark, d):
    return geosets.add(customer_places(spark, d)).select("member", F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat"))


@_register()
def geo_hashes(spark, d):
    return geosets.hashes(customer_places(spark, d)).select("member", "geohash")


# --- keys, dictionaries, scripts --------------------------------------------------------------------


def customer_catalog(spark, d):
    return K.table(spark, d, "customer").select(F.col("c_name").alias("key"), F.lit("hash").alias("type"), F.when(F.col("c_custkey") % 3 == 0, F.timestamp_seconds(F.col("c_custkey") * 1000)).alias("expire_at"))


@_register("SELECT c_name AS key FROM customer WHERE regexp_full_match(c_name, 'Customer#.*[0-4]5')")
def key_pattern(spark, d):
    return keyspace.matching(customer_catalog(spark, d), "Customer#*[0-4]5")


@_register("SELECT count(*) AS keys FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey * 1000 > 500000")
def key_live_count(spark, d):
    return keyspace.size(keyspace.sweep(customer_catalog(spark, d), "1970-01-06 18:53:20"))


@_register("SELECT c_name AS key, 'hash' AS type FROM customer WHERE c_name > 'Customer#000000050' ORDER BY 1 LIMIT 40")
def key_scan_page(spark, d):
    return K.scan_page(customer_catalog(spark, d), "key", "Customer#000000050", count=40).select("key", "type")


@_register("""WITH w AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z0-9_]+')) AS term FROM part),
v AS (SELECT term, count(*) AS n FROM w GROUP BY 1), q AS (SELECT unnest(['gren', 'bleu', 'smokee']) AS word)
SELECT word AS term, term AS suggestion, round(n / (SELECT count(*) FROM part), 9) AS score FROM q, v WHERE levenshtein(word, term) <= 2 AND word NOT IN (SELECT term FROM v)""")
def spellcheck(spark, d):
    ix = Index(K.table(spark, d, "part"), "p_partkey", (Field("p_name", "TEXT"),))
    return dictionaries.spellcheck(ix, "gren bleu smokee", 2).withColumn("score", F.round("score", 9))


@_register("""SELECT p_name AS string, max(p_retailprice) AS score FROM part WHERE lower(p_name) LIKE 's%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def suggestions(spark, d):
    rows = K.table(spark, d, "part").groupBy(F.col("p_name").alias("string")).agg(F.max("p_retailprice").alias("score")).select(F.lit("s").alias("key"), "string", "score", F.lit(None).cast("string").alias("payload"))
    return dictionaries.suggest(rows, "s", "s").select("string", "score")


@_register("SELECT c_name AS key, CAST(c_acctbal AS VARCHAR) AS value FROM customer WHERE c_acctbal < 0 AND c_name LIKE 'Customer#0000%'")
def script_scan(spark, d):
    scripts = Scripts()
    scripts.load("negative", lambda k, v: v is not None and float(v) < 0)
    rows = K.table(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_acctbal").cast("string").alias("value"))
    return scripts.scan(rows, "negative", "Customer#0000")


@_register("""SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda w: w) AS words FROM part WHERE false
UNION ALL SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9_]+') FROM part""")
def text_tokens(spark, d):
    return K.table(spark, d, "part").select("p_partkey", T.tokens(F.col("p_name")).alias("words"))


