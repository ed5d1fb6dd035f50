"""Query language, search, pipeline and fusion on small tools."""

import pytest

from quern.plans import query as Q
from quern.plans.aggregate import Reduce, aggregate, cursor_page
from quern.plans.expressions import Compiler, ExpressionError
from quern.plans.index import Field, Index, columns
from quern.plans.search import count, hybrid, search


@pytest.fixture(scope="module")
def tools(spark):
    rows = [
        ("t:1", "garden spade", "digging, steel", 32.0, [1.0, 0.0], "POINT(0 0)", "2.5,1.5", None),
        ("t:2", "border spade", "digging", 18.5, [0.0, 1.0], "POINT(10 10)", "10,10", ""),
        ("t:3", "hedge shears", "cutting", 41.0, [0.9, 0.1], None, None, "x"),
        ("t:4", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "key string, title string, category string, price double, v array<double>, shape string, at string, note string")
    fields = (
        Field("title", "TEXT", stem=True, phonetic=True), Field("category", "TAG"), Field("price", "NUMERIC", sortable=True), Field("v", "VECTOR"),
        Field("shape", "GEOSHAPE"), Field("at", "GEO"), Field("note", "TEXT", index_empty=True, index_missing=True),
    )
    return Index(df, "key", fields)


def keys(df):
    return [r["key"] for r in df.collect()]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("*", {"t:1", "t:2", "t:3", "t:4"}),
        ("spade", {"t:1", "t:2"}),
        ("spades", {"t:1", "t:2"}),
        ("@title:(border|hedge) -shears", {"t:2"}),
        ("@category:{steel|cutting}", {"t:1", "t:3"}),
        ("@price:[(32 +inf]", {"t:3"}),
        ("@price:[32 32] garden", {"t:1"}),
        ('"border spade"', {"t:2"}),
        ('"spade border"', set()),
        ('"spade border"=>{$slop:0;$inorder:false}', {"t:2"}),
        ("spa*", {"t:1", "t:2"}),
        ("g*n", {"t:1"}),
        ("h?dge", {"t:3"}),
        ("%spdae%", {"t:1", "t:2"}),
        ("~garden @category:{digging}", {"t:1", "t:2"}),
        ("ismissing(@note)", {"t:1", "t:4"}),
        ('@note:""', {"t:2"}),
        ("@at:[2 1 200 km]", {"t:1"}),
        ("@shape:[WITHIN POLYGON((-1 -1, 1 -1, 1 1, -1 1, -1 -1))]", {"t:1"}),
        ("@v:[VECTOR_RANGE 0.5 $q]", {"t:1", "t:3"}),
        ("-spade", {"t:3", "t:4"}),
        ("", {"t:1", "t:2", "t:3", "t:4"}),
    ],
)
def test_predicates(tools, query, expected):
    found = search(tools, query, params={"q": [1.0, 0.0]}, limit=None, returns=[])
    assert set(keys(found)) == expected


def test_phonetic(tools):
    assert set(keys(search(tools, "spayd", limit=None, returns=[]))) == {"t:1", "t:2"}
    assert keys(search(tools, "spayd", limit=None, returns=[], verbatim=True)) == []


@pytest.mark.parametrize("bad", ["(a", "a)", "@price:[1]", "=>", "a|@v:[VECTOR_RANGE 1 $q]", "-(@v:[VECTOR_RANGE 1 $q])", "*=>[KNN 2 @v $q] @v:[VECTOR_RANGE 1 $q]", "$gone", "a*"])
def test_refused(tools, bad):
    with pytest.raises(ValueError):
        search(tools, bad, params={"q": [1.0, 0.0]})


def test_knn_is_nearest_first(tools):
    rows = search(tools, "(@category:{digging})=>[KNN 5 @v $q AS d]", params={"q": [1.0, 0.0]}, returns=[]).collect()
    assert [(r["key"], r["d"]) for r in rows] == [("t:1", 0.0), ("t:2", 2.0)]


def test_sort_limit_and_missing_last(tools):
    for way in ("ASC", "DESC"):
        assert keys(search(tools, "*", sortby=("price", way), limit=(3, 1), returns=[])) == ["t:4"]
    assert count(tools, "spade").first()["total"] == 2
    assert keys(search(tools, "*", inkeys=["t:2", "t:9"], returns=[])) == ["t:2"]
    assert keys(search(tools, "*", filters=[("price", "(32", "50")], returns=[])) == ["t:3"]


def test_synonyms_and_stopwords(tools):
    ix = Index(tools.source, "key", tools.fields, synonyms=(("shovel", "spade"),), stopwords=frozenset({"the"}))
    assert set(keys(search(ix, "the shovel", returns=[]))) == {"t:1", "t:2"}


def test_scores_rank(tools):
    rows = search(tools, "border|spade", returns=[]).collect()
    assert rows[0]["key"] == "t:2" and rows[0]["score"] > rows[1]["score"]
    for scorer in ("BM25", "DISMAX", "DOCSCORE"):
        assert search(tools, "border|spade", scorer=scorer, returns=[]).count() == 2


def test_hybrid(tools):
    for way in ("RRF", "LINEAR"):
        rows = hybrid(tools, "spade", "v", [1.0, 0.0], k=2, combine=way).collect()
        assert rows[0]["key"] == "t:1" and {r["key"] for r in rows} == {"t:1", "t:2", "t:3"}
    rows = hybrid(tools, "spade", "v", [1.0, 0.0], k=2, post_filter="@category:{cutting}").collect()
    assert [r["key"] for r in rows] == ["t:3"]


def test_pipeline(tools):
    rows = aggregate(tools, "@category:{digging|cutting}").group(["@category"], Reduce("COUNT"), Reduce("SUM", "@price"), Reduce("AVG", "@price")).sortby("@category").frame().collect()
    assert [tuple(r) for r in rows] == [("cutting", 1, 41.0, 41.0), ("digging", 1, 18.5, 18.5), ("digging, steel", 1, 32.0, 32.0)]
    twice = aggregate(tools, "*").load("@title").apply("@price * 2", "double").filter("@double >= 70").frame().collect()
    assert [tuple(r) for r in twice] == [("hedge shears", 82.0)]
    page = aggregate(tools, "*").load("@title").sortby(("@price", "DESC")).limit(0, 1)
    assert page.frame().collect()[0]["title"] == "hedge shears" and page.total().first()["total"] == 4
    empty = aggregate(tools, "nothing").group([], Reduce("COUNT")).frame()
    assert empty.count() == 0


def test_reducers_of_missing_values(tools):
    row = aggregate(tools, "@note:x").group([], Reduce("SUM", "@title"), Reduce("MIN", "@gone"), Reduce("TOLIST", "@gone"), Reduce("COUNT_DISTINCT", "@gone")).frame().first()
    assert row.asDict() == {"sum": 0.0, "min": 0.0, "tolist": ["@gone"], "count_distinct": 1}


def test_cursor(tools):
    first = cursor_page(tools.source, ["key"], None, 2).collect()
    assert [r["key"] for r in cursor_page(tools.source, ["key"], (first[-1]["key"],), 2).collect()] == ["t:3", "t:4"]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("2 * (@a + 1)", 8.0), ("@a / 0", float("inf")), ("-@a / 0", float("-inf")), ("upper(@s)", "AB"), ("@s == 'ab'", 1.0), ("@t < 10", 1.0), ("'b' > 'a'", 1.0),
        ("abs(-3) + ceil(1.2)", 5.0), ("@missing", "@missing"), ("sqrt(16)", 4.0), ("@a = 3", 1.0), ("floor(@a / 2)", 1.0),
    ],
)
def test_expressions(spark, source, expected):
    df = spark.createDataFrame([(3, "ab", "9")], "a int, s string, t string")
    v = Compiler(columns(df)).compile(source)
    got = df.select((v.num if isinstance(expected, float) else v.text).alias("x")).first()["x"]
    assert got == expected


@pytest.mark.parametrize("bad", ["(1", "f(1)", "1 +", "1 2", "&"])
def test_bad_expressions(spark, bad):
    with pytest.raises(ExpressionError):
        Compiler({}).compile(bad)


def test_explain():
    assert Q.explain(Q.parse("a (b|-c)")).splitlines() == ["AND", "  TEXT word='a'", "  OR", "    TEXT word='b'", "    NOT", "      TEXT word='c'"]


def test_numeric_filter_reaches_the_scan(spark, small):
    from quern.queries import lineitem_index

    plan = aggregate(lineitem_index(spark, small), "@l_quantity:[10 20]").group(["@l_returnflag"], Reduce("SUM", "@l_tax")).frame()._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan
