"""Data structures against plain Python."""

import pytest
from pyspark.sql import functions as F

from quern.functions import geo as G
from quern.functions import hll
from quern.functions import text as T
from quern.functions.registry import Scripts
from quern.operators import dictionaries, documents, geosets, hashes, keyspace, lists, sets, streams, strings, vectorsets, zsets
from quern.sources import keys as K


def col(df, name):
    return [r[name] for r in df.collect()]


@pytest.fixture(scope="module")
def zs(spark):
    return spark.createDataFrame([("z", "a", 1.0), ("z", "b", 2.0), ("z", "c", 2.0), ("z", "d", 5.0), ("y", "b", 10.0), ("y", "e", 1.0)], "key string, member string, score double")


def test_zsets(zs, spark):
    assert col(zsets.range_by_rank(zs, "z", 1, -1), "member") == ["b", "c", "d"]
    assert col(zsets.range_by_rank(zs, "z", 0, 1, reverse=True), "member") == ["d", "c"]
    assert col(zsets.range_by_rank(zs, "z", -2, -1), "member") == ["c", "d"]
    assert col(zsets.range_by_rank(zs, "z", -3, -2), "member") == ["b", "c"]
    assert col(zsets.range_by_rank(zs, "z", 2, 1), "member") == []
    assert zsets.rank(zs, "z", "c").first()["rank"] == 2 and zsets.rank(zs, "z", "c", True).first()["rank"] == 1
    assert col(zsets.range_where(zs, "z", zsets.by_score("(1", "+inf"), limit=(1, 1)), "member") == ["c"]
    assert {(r["member"], r["score"]) for r in zsets.union(zs, ["z", "y"], [1, 2]).collect()} == {("a", 1.0), ("b", 22.0), ("c", 2.0), ("d", 5.0), ("e", 2.0)}
    assert [(r["member"], r["score"]) for r in zsets.intersection(zs, ["z", "y"], fold="MAX").collect()] == [("b", 10.0)]
    assert sorted(col(zsets.difference(zs, ["z", "y"]), "member")) == ["a", "c", "d"]
    new = spark.createDataFrame([("z", "a", 0.5), ("z", "n", 9.0)], "key string, member string, score double")
    score = lambda df, m: df.where(F.col("member") == m).where("key = 'z'").select("score").collect()
    assert score(zsets.add(zs, new, "GT"), "a")[0][0] == 1.0 and score(zsets.add(zs, new, "LT"), "a")[0][0] == 0.5
    assert score(zsets.add(zs, new, "XX"), "n") == [] and score(zsets.add(zs, new, "NX"), "a")[0][0] == 1.0
    with pytest.raises(ValueError):
        zsets.add(zs, new, "NX GT")
    popped, rest = zsets.pop(zs, ["none", "z"], 2, highest=True)
    assert col(popped, "member") == ["d", "c"] and rest.count() == 4
    assert col(zsets.scores(zs, "z", ["d", "?"]), "score") == [5.0, None]
    assert zsets.remove_by_rank(zs, "z", 0, 1).where("key='z'").count() == 2
    assert zsets.intersection_size(zs, ["z", "y"], 5).first()["card"] == 1


def test_sets(spark):
    s = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3)], "key string, member int")
    assert sorted(col(sets.union(s, ["a", "b"]), "member")) == [1, 2, 3]
    assert col(sets.intersection(s, ["a", "b"]), "member") == [2] and col(sets.intersection(s, ["a", "gone"]), "member") == []
    assert col(sets.difference(s, ["a", "b"]), "member") == [1] and col(sets.difference(s, ["a", "a"]), "member") == []
    assert col(sets.is_member(s, "a", [2, 9]), "found") == [1, 0]
    assert sets.move(s, "a", "b", 1).where("key = 'b'").count() == 3
    assert len(col(sets.random_members(s, "a", -5, 3), "member")) == 5 and sets.random_members(s, "a", 5).count() == 2
    assert col(sets.scan(s, "a", 1), "member") == [2]


def test_hashes(spark):
    h = spark.createDataFrame([("k", "f", "1", None), ("k", "g", "x", None)], "key string, field string, value string, expire_at timestamp")
    assert col(hashes.get(h, "k", ["g", "?", "f"]), "value") == ["x", None, "1"]
    new = spark.createDataFrame([("k", "f", "2"), ("k", "n", "3")], "key string, field string, value string")
    got = lambda mode: {r["field"]: r["value"] for r in hashes.put(h, new, mode).collect()}
    assert got("") == {"f": "2", "g": "x", "n": "3"} and got("NX") == {"f": "1", "g": "x", "n": "3"} and got("XX") == {"f": "2", "g": "x"}
    delta = spark.createDataFrame([("k", "f", 4)], "key string, field string, delta int")
    assert {r["field"]: r["value"] for r in hashes.increment(h, delta).collect()} == {"f": "5", "g": "x"}
    with pytest.raises(Exception, match="not an integer"):
        hashes.increment(h, spark.createDataFrame([("k", "g", 4)], "key string, field string, delta int")).collect()
    timed = hashes.expire(h, "k", ["f"], "2030-01-01 00:00:00")
    assert col(hashes.ttl(timed, "k", ["f", "g", "?"], "2029-12-31 23:59:00"), "ttl") == [60, -1, -2]
    assert hashes.expire(h, "k", ["f"], "2000-01-01", now="2010-01-01").count() == 1


def test_lists(spark):
    li = spark.createDataFrame([("l", i, v) for i, v in enumerate("abcbd")], "key string, pos long, value string")
    assert col(lists.slice_(li, "l", 1, -2), "value") == ["b", "c", "b"] and col(lists.element(li, "l", -1), "value") == ["d"]
    assert lists.as_array(lists.remove(li, "l", -1, "b")).first()["values"] == ["a", "b", "c", "d"]
    assert lists.as_array(lists.remove(li, "l", 0, "b")).first()["values"] == ["a", "c", "d"]
    assert lists.as_array(lists.insert(li, "l", "c", "X")).first()["values"] == ["a", "b", "X", "c", "b", "d"]
    assert lists.as_array(lists.insert(li, "l", "d", "X", before=False)).first()["values"][-1] == "X"
    assert lists.as_array(lists.set_at(li, "l", -2, "Y")).first()["values"] == ["a", "b", "c", "Y", "d"]
    with pytest.raises(IndexError):
        lists.set_at(li, "l", 9, "Y")
    assert col(lists.positions(li, "l", "b", -1, 0), "index") == [3, 1] and col(lists.positions(li, "l", "b", 2), "index") == [3]
    rows = spark.createDataFrame([("l", 0, "y"), ("l", 1, "z"), ("m", 0, "q")], "key string, seq int, value string")
    assert lists.as_array(lists.push(li, rows, left=True)).where("key='l'").first()["values"][:2] == ["z", "y"]
    assert lists.push(li, rows, only_existing=True).where("key='m'").count() == 0
    moved = {r["key"]: r["values"] for r in lists.as_array(lists.move(li, "l", "m")).collect()}
    assert moved == {"l": ["a", "b", "c", "b"], "m": ["d"]}
    assert lists.as_array(lists.trim(li, "l", 1, 2)).first()["values"] == ["b", "c"]


def test_strings(spark):
    df = spark.createDataFrame([(b"foobar",), (b"\x00\x0f\xff",), (b"",)], "v binary")
    v = F.col("v")
    assert [bytes(x) for x in col(df.select(strings.byte_range(v, -3, -1).alias("x")), "x")] == [b"bar", b"\x00\x0f\xff", b""]
    assert col(df.select(strings.bit_count(v).alias("x")), "x") == [26, 12, 0]
    assert col(df.select(strings.bit_count(v, 5, 30, bits=True).alias("x")), "x")[0] == 17
    assert col(df.select(strings.bit_position(v, 1).alias("x")), "x") == [1, 12, -1]
    assert col(df.select(strings.bit_position(v, 0).alias("x")), "x") == [0, 0, 0]
    assert col(df.select(strings.bit_field(v, "i8", 16).alias("x")), "x")[1] == -1
    assert col(df.select(strings.bit_field(v, "u12", 4).alias("x")), "x")[0] == 0x66F
    assert bytes(df.limit(1).select(strings.overwrite(v, 8, b"!!").alias("x")).first()["x"]) == b"foobar\0\0!!"
    pair = spark.createDataFrame([(b"abc",), (b"a",)], "value binary")
    assert bytes(strings.bit_operation(pair, "AND").first()["value"]) == b"a\0\0"
    assert bytes(strings.bit_operation(pair, "XOR").first()["value"]) == b"\0bc"
    assert bytes(strings.bit_operation(spark.createDataFrame([(b"\x0f",)], "value binary"), "NOT").first()["value"]) == b"\xf0"
    words = spark.createDataFrame([("ohmytext", "mynewtext"), (None, "a")], "a string, b string")
    assert col(strings.common_subsequence(words, "a", "b"), "lcs") == ["mytext", None]


def test_string_log(spark):
    log = [(0, "SET", "5", None), (1, "SETNX", "9", None), (2, "INCRBY", "3", None), (3, "APPEND", "0", None), (4, "GETSET", "a", None), (5, "EXPIREAT", None, 50), (60, "GET", None, None), (61, "INCRBYFLOAT", "1.5", None), (62, "INCRBY", "x", None)]
    df = spark.createDataFrame([(i, "k", c, a, i, at) for i, c, a, at in log], "seq long, key string, cmd string, arg string, now long, at long")
    assert [r["reply"] for r in strings.fold(df).orderBy("seq").collect()] == ["OK", "0", "8", "2", "80", "1", None, "1.5", "ERR not an integer"]
    sums = strings.counters(spark.createDataFrame([("a", 2), ("a", -5), ("b", 7)], "key string, delta long"))
    assert {r["key"]: r["value"] for r in sums.collect()} == {"a": -3, "b": 7}
    with pytest.raises(Exception, match="overflow"):
        strings.counters(spark.createDataFrame([("a", 2**63 - 1), ("a", 1)], "key string, delta long")).collect()


def test_hll(spark):
    regs = hll.registers(spark.createDataFrame([("k", x) for x in "abca"], "key string, element string"))
    assert {(r["register"], r["rank"]) for r in regs.collect()} == {(8436, 1), (12711, 2), (15780, 1)}
    assert hll.estimates(regs).first()["estimate"] == 3
    many = hll.estimates(hll.registers(spark.range(50_000).select(F.lit("k").alias("key"), F.col("id").alias("element")))).first()["estimate"]
    assert abs(many - 50_000) < 1500


def test_geo(spark):
    rows = spark.createDataFrame([("Sicily", "Palermo", 13.361389, 38.115556), ("Sicily", "Catania", 15.087269, 37.502669)], "key string, member string, lon double, lat double")
    places = geosets.add(rows)
    assert geosets.distance(places, "Sicily", "Palermo", "Catania").first()["distance"] == pytest.approx(166274.1516, abs=0.01)
    assert sorted(col(geosets.hashes(places), "geohash")) == ["sqc8b49rny0", "sqdtr74hyu0"]
    assert {r["member"]: r["score"] for r in places.collect()} == {"Palermo": 3479099956230698, "Catania": 3479447370796909}
    assert col(geosets.search(places, "Sicily", lonlat=(15, 37), radius=200, unit="km", order="ASC"), "member") == ["Catania", "Palermo"]
    assert col(geosets.search(places, "Sicily", member="Palermo", box=(10, 10), unit="km"), "member") == ["Palermo"]
    with pytest.raises(Exception, match="invalid longitude"):
        geosets.add(spark.createDataFrame([("k", "m", 999.0, 0.0)], "key string, member string, lon double, lat double")).collect()
    ring = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
    assert G.covers(ring, "POINT(3 3)") and not G.covers(ring, "POINT(1.5 1.5)") and G.covers(ring, "POINT(0 2)")


def test_streams(spark):
    rows = spark.createDataFrame([("s", 0, 5), ("s", 1, 5), ("s", 2, 3), ("s", 3, 9)], "key string, arrival long, now long")
    assert [(r["ms"], r["seq"]) for r in streams.assign_ids(rows).orderBy("arrival").collect()] == [(5, 0), (5, 1), (5, 2), (9, 0)]
    log = streams.assign_ids(rows).withColumn("fields", F.array())
    assert streams.id_range(log, "s", "(5-0", "+", 2).count() == 2 and streams.read(log, {"s": "5-1"}).count() == 2
    assert streams.trim(log, "s", 1).count() == 1 and col(streams.deletion_status(log, "s", ["5-1", "7-0"]), "status") == [1, -1]
    given = spark.createDataFrame([("s", 0, 1, 1), ("s", 1, 1, 1), ("s", 2, 0, 5), ("s", 3, 2, 0)], "key string, arrival long, ms long, seq long")
    assert sorted(col(streams.rejected_ids(given), "arrival")) == [1, 2]


def test_consumer_groups(spark):
    entries = spark.createDataFrame([("s", i, 0) for i in range(1, 6)], "key string, ms long, seq long")
    steps = [("CREATE", None, "0", None, None, 0, None), ("READ", "a", ">", None, 3, 10, None), ("READ", "b", ">", None, 5, 11, None), ("ACK", "a", None, ["1-0", "9-0"], None, 12, None), ("CLAIM", "b", None, ["2-0", "3-0"], None, 13, 3), ("AUTOCLAIM", "a", "4-0", None, 1, 100, 50), ("READ", "b", "0", None, None, 101, None)]
    log = spark.createDataFrame([("s", "g", i, *s) for i, s in enumerate(steps)], "key string, grp string, seq long, cmd string, consumer string, id string, ids array<string>, n long, now long, idle long")
    found = streams.replay_groups(entries, log)
    assert {(r["ms"], r["consumer"], r["deliveries"]) for r in found.where("cmd='PENDING'").collect()} == {(2, "b", 2), (3, "b", 2), (4, "a", 2), (5, "b", 1)}
    assert [r["ms"] for r in found.where("at = 6").orderBy("ms").collect()] == [2, 3, 5]
    summary = streams.pending_summary(found.where("cmd='PENDING'")).first()
    assert summary["count"] == 4 and [tuple(c) for c in summary["consumers"]] == [("a", 1), ("b", 3)]


def test_documents(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, 2.5, "x", true, null]}, "s": "hi"}',), (None,), ("broken",)], "doc string")
    d = F.col("doc")
    one = lambda c: df.select(c.alias("x")).first()["x"]
    assert one(documents.get(d, "$.a.b[1]")) == "2.5" and one(documents.get(d, "$.zz")) is None
    assert [one(documents.kind(d, p)) for p in ("$", "$.a.b", "$.a.b[0]", "$.a.b[1]", "$.a.b[2]", "$.a.b[3]", "$.a.b[4]")] == ["object", "array", "integer", "number", "string", "boolean", "null"]
    assert one(documents.keys(d)) == ["a", "s"]
    reply = lambda udf: df.select(udf(d).alias("x")).first()["x"]
    assert reply(documents.append_array("$.a.b", 7))["reply"] == "6"
    assert reply(documents.insert_array("$.a.b", -1, 9))["doc"] == '{"a":{"b":[1,2.5,"x",true,9,null]},"s":"hi"}'
    assert reply(documents.pop_array("$.a.b", 0))["reply"] == "1" and reply(documents.append_string("$.s", "!"))["reply"] == "3"
    assert reply(documents.delete("$.a"))["doc"] == '{"s":"hi"}' and reply(documents.delete("$.q"))["reply"] == "0"
    assert reply(documents.put("$.n", "1"))["doc"].endswith('"n":1}') and reply(documents.put("$.s", "1", "NX"))["reply"] is None
    assert reply(documents.put("$.q.r", "1"))["reply"] is None


def test_vector_sets(spark):
    v = spark.createDataFrame([("k", "a", [1.0, 0.0], '{"size":"large","price":18.99}'), ("k", "b", [0.0, 1.0], '{"size":"large","price":35.99}'), ("k", "c", [-1.0, 0.0], '{"size":"small","price":25.99}')], "key string, id string, vector array<double>, attrs string")
    assert [(r["id"], round(r["score"], 3)) for r in vectorsets.similar(v, "k", [1.0, 0.0], 3).collect()] == [("a", 1.0), ("b", 0.5), ("c", 0.0)]
    assert col(vectorsets.similar(v, "k", [1.0, 0.0], 3, '.size == "large" && .price > 20'), "id") == ["b"]
    assert col(vectorsets.similar(v, "k", [1.0, 0.0], 3, '.size in ("small", "huge")'), "id") == ["c"]
    assert col(vectorsets.similar(v, "k", [1.0, 0.0], 3, ".gone != 1"), "id") == []
    assert col(vectorsets.id_range(v, "k", "[b", "+"), "id") == ["b", "c"] and vectorsets.info(v).first()["dim"] == 2
    long = spark.createDataFrame([([float(i == j) for j in range(40)],) for i in range(3)] + [(None,), ([1.0],)], "x array<double>")
    from quern.functions.vectors import distance

    q = [1.0] + [0.0] * 39
    assert col(long.select(distance("L2", F.col("x"), q).alias("d")), "d") == [0.0, 2.0, 2.0, None, None]
    assert col(long.select(distance("COSINE", F.col("x"), q).alias("d")), "d")[:2] == [0.0, 1.0]


def test_keys(spark):
    c = spark.createDataFrame([("user:1", "string", None), ("user:22", "set", "2030-01-01 00:00:00"), ("x[1]", "hash", "2000-01-01 00:00:00")], "key string, type string, expire_at string").withColumn("expire_at", F.col("expire_at").cast("timestamp"))
    assert col(keyspace.matching(c, "user:?"), "key") == ["user:1"] and col(keyspace.matching(c, "x\\[[0-9]]"), "key") == ["x[1]"]
    assert sorted(col(keyspace.matching(c, "u[^a]er:*"), "key")) == ["user:1", "user:22"]
    assert keyspace.exists(c, ["user:1", "user:1", "?"]).first()["n"] == 2 and keyspace.type_of(c, "?").first()["type"] == "none"
    assert col(keyspace.ttl(c, ["user:22", "user:1", "x[1]"], "2029-12-31 23:59:30"), "ttl") == [30, -1, -2]
    assert keyspace.expire(c, ["user:1"], "2031-01-01", "GT").where("key='user:1' and expire_at is null").count() == 1
    assert keyspace.sweep(c, "2020-01-01").count() == 2 and col(K.scan_page(c, "key", "user:1", count=1), "key") == ["user:22"]
    assert keyspace.rename(c, "user:1", "x[1]").count() == 2 and keyspace.copy(c, "user:1", "x[1]").count() == 3
    state = spark.createDataFrame([("a", "1", 3)], "key string, value string, version long")
    ops = spark.createDataFrame([("a", "2", 0), ("b", "9", 1)], "key string, value string, seq int")
    done, after = keyspace.commit(state, ops, state.select("key", "version"))
    assert done and {(r["key"], r["value"], r["version"]) for r in after.collect()} == {("a", "2", 4), ("b", "9", 1)}
    assert keyspace.commit(after, ops, state.select("key", "version"))[0] is False


def test_text(spark):
    df = spark.createDataFrame([("Can't stop 3.14 a_b Éa",), (None,), ("",)], "x string")
    assert col(df.select(T.tokens(F.col("x")).alias("t")), "t") == [["cant", "stop", "314", "a_b", "éa"], [], []]
    words = spark.createDataFrame([("Ashcraft",), ("Robert",), ("Tymczak",), ("1",)], "w string")
    assert col(words.select(T.soundex(F.col("w")).alias("s")), "s") == ["A226", "R163", "T522", None]
    assert col(df.limit(1).select(T.highlight(F.lit("a Cat, cat"), ["cat"]).alias("h")), "h") == ["a <b>Cat</b>, <b>cat</b>"]
    cjk = spark.createDataFrame([("数据库",)], "x string").select(T.tokens(F.col("x"), ngrams=True).alias("t")).first()["t"]
    assert {"数", "数据", "据库"} <= set(cjk)


def test_dictionaries(spark):
    t = dictionaries.add_terms(spark.createDataFrame([], "dict string, term string"), "d", ["b", "a", "a"])
    assert col(dictionaries.dump(t, "d"), "term") == ["a", "b"] and dictionaries.remove_terms(t, "d", ["a"]).count() == 1
    s = spark.createDataFrame([("s", "hello", 2.0, None), ("s", "help", 3.0, "p"), ("s", "yellow", 9.0, None)], "key string, string string, score double, payload string")
    assert col(dictionaries.suggest(s, "s", "HEL"), "string") == ["help", "hello"]
    assert col(dictionaries.suggest(s, "s", "yelow", fuzzy=True), "string") == ["yellow"]
    new = spark.createDataFrame([("s", "help", 4.0, None)], "key string, string string, score double, payload string")
    assert dictionaries.suggestions_put(s, new, True).where("string='help'").first()["score"] == 7.0
    syn = dictionaries.synonyms_update(dictionaries.synonyms_update(spark.createDataFrame([], "grp string, term string"), "g", ["Boy", "child"]), "h", ["child"])
    assert {r["term"]: r["groups"] for r in dictionaries.synonyms_dump(syn).collect()} == {"boy": ["g"], "child": ["g", "h"]}


def test_scripts(spark):
    scripts = Scripts()
    digest = scripts.load("big", lambda k, v: int(v) > 1)
    rows = spark.createDataFrame([("k:1", "1"), ("k:2", "2"), ("k:3", "3"), ("q", "9")], "key string, value string")
    assert col(scripts.scan(rows, "big", "k:"), "key") == ["k:2", "k:3"] and col(scripts.scan(rows, digest, "k:", 2), "key") == ["k:2"]
    assert scripts.call("big", "k", "5") and scripts.names() == ["big"] and scripts.delete("big") and not scripts.exists(digest)[0]


def test_store_and_request(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    assert col(K.requested(df, "key", ["b", "?", "a"]), "value") == [2, None, 1]
    K.store(df, str(tmp_path / "t"), "dst")
    K.store(df.limit(1), str(tmp_path / "t"), "other")
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("key").count().orderBy("key").collect()[0]["count"] == 2
