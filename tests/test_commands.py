import pytest

from quern.plans.commands import CommandError, SearchCatalog

BIRDS = [
    ("h:1", "grey heron", "wades through the still pond", "wading", 98.0, [0.2, 0.9]),
    ("h:2", "tawny owl", "hunts over the dark wood", "raptor", 38.0, [0.8, 0.1]),
    ("h:3", "reed bunting", "sings beside the pond", "song", 15.0, [0.1, 0.8]),
    ("h:4", "barn owl", "glides over open fields", "raptor", 35.0, [0.9, 0.2]),
]


@pytest.fixture(scope="module")
def catalog(spark):
    c = SearchCatalog(spark)
    c.register("bird:", spark.createDataFrame(BIRDS, "key string, name string, habit string, kind string, height double, shape array<double>"), "key")
    c.run("FT.CREATE birds ON HASH PREFIX 1 bird: SCHEMA name TEXT habit TEXT NOSTEM kind TAG height NUMERIC SORTABLE shape VECTOR FLAT 4 DIM 2 DISTANCE_METRIC L2")
    return c


def keys(df):
    return [r["key"] for r in df.collect()]


def test_search(catalog):
    assert sorted(keys(catalog.run("FT.SEARCH birds owl NOCONTENT"))) == ["h:2", "h:4"]
    assert sorted(keys(catalog.run("FT.SEARCH birds '@habit:pond -@kind:{song}'"))) == ["h:1"]
    assert keys(catalog.run("FT.SEARCH birds '@kind:{raptor} over' SORTBY height DESC LIMIT 1 1")) == ["h:4"]
    assert catalog.run("FT.SEARCH birds * LIMIT 0 0").first()["total"] == 4
    assert [r["n"] for r in catalog.run("FT.SEARCH birds * FILTER height (15 35 RETURN 3 name AS n").collect()] == ["barn owl"]
    assert keys(catalog.run("FT.SEARCH", "birds", "*=>[KNN 3 @shape $q]", "PARAMS", 2, "q", [1.0, 0.3])) == ["h:4", "h:2", "h:1"]  # squared distances 0.02, 0.08, 1.0, 1.06
    assert "tawny <b>owl</b>" in [r["name"] for r in catalog.run("FT.SEARCH birds owl HIGHLIGHT FIELDS 1 name").collect()]


def test_aggregate(catalog):
    rows = catalog.run("FT.AGGREGATE birds * GROUPBY 1 @kind REDUCE MAX 1 @height AS tallest REDUCE COUNT 0 AS n SORTBY 2 @tallest ASC").collect()
    assert [tuple(r) for r in rows] == [("song", 15.0, 1), ("raptor", 38.0, 2), ("wading", 98.0, 1)]
    rows = catalog.run("FT.AGGREGATE birds '-@kind:{wading}' LOAD 1 @name APPLY '@height - 5' AS low FILTER '@low < 33' SORTBY 2 @low DESC LIMIT 0 9").collect()
    assert [tuple(r) for r in rows] == [("barn owl", 30.0), ("reed bunting", 10.0)]


def test_cursor(catalog):
    first = catalog.run("FT.AGGREGATE birds * LOAD 1 @name SORTBY 2 @name ASC WITHCURSOR COUNT 3").collect()
    n = catalog.last_cursor
    assert [r["name"] for r in first] == ["barn owl", "grey heron", "reed bunting"]
    assert [r["name"] for r in catalog.run(f"FT.CURSOR READ birds {n}").collect()] == ["tawny owl"] and catalog.run(f"FT.CURSOR READ birds {n}").count() == 0
    catalog.run(f"FT.CURSOR DEL birds {n}")
    with pytest.raises(CommandError):
        catalog.run(f"FT.CURSOR READ birds {n}")


def test_hybrid(catalog):
    found = catalog.run("FT.HYBRID", "birds", "SEARCH", "barn", "VSIM", "@shape", "$q", "KNN", 2, "K", 2, "COMBINE", "RRF", 2, "CONSTANT", 60, "PARAMS", 2, "q", [0.7, 0.1])
    assert keys(found) == ["h:4", "h:2"]


def test_definitions_and_dictionaries(catalog):
    catalog.run("FT.ALIASADD fowl birds")
    assert keys(catalog.run("FT.SEARCH fowl heron")) == ["h:1"] and catalog.run("FT.INFO fowl").count() == 5
    assert [r["tag"] for r in catalog.run("FT.TAGVALS birds kind").collect()] == ["raptor", "song", "wading"]
    assert [r["suggestion"] for r in catalog.run("FT.SPELLCHECK birds herron").collect()] == ["heron"]
    catalog.run("FT.SYNUPDATE birds night owl nightbird")
    assert sorted(keys(catalog.run("FT.SEARCH birds nightbird"))) == ["h:2", "h:4"]
    catalog.run("FT.SUGADD calls rook 5 PAYLOAD caw")
    catalog.run("FT.SUGADD calls robin 2")
    assert [r["string"] for r in catalog.run("FT.SUGGET calls ro").collect()] == ["rook", "robin"]
    catalog.run("FT.DICTADD latin ardea strix tyto")
    assert catalog.run("FT.DICTDUMP latin").count() == 3 and catalog.run("FT._LIST").count() == 1
    assert catalog.run("FT.EXPLAIN birds 'reed bunting pond'").count() == 4 and catalog.run("FT.PROFILE birds SEARCH QUERY pond").count() > 3
    catalog.run("FT.ALIASDEL fowl")
    with pytest.raises(CommandError):
        catalog.run("FT.SEARCH fowl heron")


@pytest.mark.parametrize("bad", ["FT.UNKNOWN a", "HGETALL a", "FT.SEARCH", "FT.SEARCH birds owl SIDEWAYS", "FT.CREATE birds PREFIX 1 bird: SCHEMA n TEXT", "FT.CREATE other PREFIX 1 none SCHEMA n TEXT", "FT.AGGREGATE birds * APPLY 2"])
def test_refused(catalog, bad):
    with pytest.raises(CommandError):
        catalog.run(bad)
