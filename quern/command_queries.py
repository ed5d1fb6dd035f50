"""Commands as text over the driver's tables: scripts whose every reply is checked by SQL.

A script loads whole tables into a store, runs its commands in order and returns all replies as
rows (step, command, reply); cells of a reply's row stand between bars, a null is a tilde. Each
step names the SQL that yields its replies from the tables, or the reply itself where
the command alone determines it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import queries as T
from quern.operators import geosets
from quern.sources import keys as K
from quern.store import Store

Step = tuple[str, str | list[str]]
SCRIPTS: dict[str, tuple[Callable[[Store, str], None], list[Step]]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _cell(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind in ("double", "float"):
        c = F.round(c.cast("double"), 6)
    elif kind.startswith("array<string"):
        return F.coalesce(F.array_join(c, ","), F.lit("~"))
    elif kind.startswith(("array", "struct", "map")):
        c = F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit("~"))


def replies(store: Store, commands: list[str]) -> DataFrame:
    """Step, command and reply of each command's rows; replies stay frames."""
    out = []
    for n, command in enumerate(commands):
        df = store.run(command)
        out.append(df.select(F.lit(n).alias("step"), F.lit(command).alias("command"), F.concat_ws("|", *[_cell(c, k) for c, k in df.dtypes]).alias("reply")))
    return reduce(DataFrame.unionByName, out)


def _script(name: str, load: Callable[[Store, str], None], steps: list[Step], now: str = "2030-01-01 00:00:00") -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        store = Store(spark, now)
        load(store, d)
        return replies(store, [c for c, _ in steps])

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for n, (command, want) in enumerate(steps):
        if isinstance(want, str) and want.startswith(("SELECT", "WITH")):
            sql = want
        else:
            rows = [want] if isinstance(want, str) else want
            if not rows:
                continue
            sql = "SELECT unnest([" + ", ".join(map(quote, rows)) + "])"
        parts.append(f"SELECT {n} AS step, {quote(command)} AS command, CAST(reply AS VARCHAR) AS reply FROM ({sql}) t(reply)")
    SCRIPTS[name], QUERIES[name], ORACLES[name] = (load, steps), query, "\nUNION ALL\n".join(parts)


# --- strings ------------------------------------------------------------------------------------------


def _balances(store: Store, d: str) -> None:
    store.load("string", K.table(store.spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_acctbal").cast("string").alias("value")))


def _balance(of: str, shown: str = "v") -> str:
    return f"SELECT {shown} FROM (SELECT CAST(c_acctbal AS VARCHAR) AS v FROM customer WHERE c_name = '{of}')"


A, B = "Customer#000000007", "Customer#000000011"
_script("kv_string_reads", _balances, [
    (f"GET {A}", _balance(A)), ("GET none", "~"), (f"MGET {A} none {B}", f"{_balance(A, f'''0 || '|{A}|' || v''')} UNION ALL SELECT '1|none|~' UNION ALL {_balance(B, f'''2 || '|{B}|' || v''')}"),
    (f"STRLEN {A}", _balance(A, "strlen(v)")), (f"GETRANGE {A} 0 1", _balance(A, "v[1:2]")), (f"SUBSTR {B} -2 -1", _balance(B, "v[strlen(v) - 1:]")), ("STRLEN none", "0"),
    (f"GETBIT {A} 1", _balance(A, "(ord(v[1]) >> 6) & 1")), (f"BITCOUNT {A} 0 0", _balance(A, "bit_count(ord(v[1]))")), (f"BITPOS {A} 1 0 0", _balance(A, "8 - strlen(bin(ord(v[1])))")),
    (f"BITFIELD_RO {A} GET u8 0 GET u8 8", _balance(A, "ord(v[1]) || '|' || ord(v[2])")), (f"EXISTS {A} {B} none", "2"), (f"TYPE {A}", "string"), (f"TTL {A}", "-1"), (f"EXPIRETIME {A}", "-1"),
    ("DBSIZE", "SELECT count(*) FROM customer"), (f"TOUCH {A}", "1"), ("KEYS Customer#00000000[3-5]", "SELECT c_name FROM customer WHERE c_custkey BETWEEN 3 AND 5"),
    ("SCAN 0 MATCH *5 COUNT 20", "SELECT c_name FROM (SELECT c_name FROM customer ORDER BY 1 LIMIT 20) WHERE c_name LIKE '%5'"), ("PING", "PONG"), ("ECHO hello", "hello"),
])
_script("kv_string_writes", _balances, [
    (f"APPEND {A} xyz", _balance(A, "strlen(v) + 3")), (f"SETRANGE {A} 0 ZZ", _balance(A, "strlen(v) + 3")), (f"GET {A}", _balance(A, "'ZZ' || v[3:] || 'xyz'")),
    (f"GETSET {B} new", _balance(B)), (f"GETDEL {B}", "new"), (f"GET {B}", "~"), (f"SETNX {A} no", "0"), (f"SETNX {B} yes", "1"), (f"SET {B} again GET", "yes"), (f"SET {B} no NX", "~"), (f"SET {B} more XX", "OK"),
    (f"GET {B}", "more"), ("MSET p 1 q two", "OK"), ("MSETNX p 9 z 9", "0"), ("MSETNX y 8 z 9", "1"), ("MGET p q y z", ["0|p|1", "1|q|two", "2|y|8", "3|z|9"]),
    ("LCS q z", "|0"), ("SET m1 saturday", "OK"), ("SET m2 sunday", "OK"), ("LCS m1 m2", "suday|5"), ("DBSIZE", "SELECT count(*) + 6 FROM customer"),
])
_script("kv_counters", _balances, [
    ("INCR n", "1"), ("INCRBY n 41", "42"), ("DECR n", "41"), ("DECRBY n 40", "1"), ("INCRBYFLOAT n 0.5", "1.5"), (f"INCRBYFLOAT {A} 0.25", _balance(A, "CAST(CAST(v AS DOUBLE) + 0.25 AS VARCHAR)")),
    ("SETBIT bits 7 1", "0"), ("SETBIT bits 7 1", "1"), ("SETBIT bits 15 1", "0"), ("GETBIT bits 15", "1"), ("BITCOUNT bits", "2"), ("BITPOS bits 1", "7"), ("STRLEN bits", "2"),
    ("BITFIELD bits INCRBY u8 0 5 GET u8 8 SET u8 8 9", ["0|6", "1|1", "2|1"]), ("BITOP NOT flip bits", "2"), ("BITFIELD_RO flip GET u8 0 GET u8 8", "249|246"),
    ("PFADD h a b c", "1"), ("PFADD h a", "0"), ("PFADD g c d", "1"), ("PFCOUNT h", "3"), ("PFCOUNT h g", "4"), ("PFMERGE all h g", "OK"), ("PFCOUNT all", "4"),
])
_script("kv_expiry", _balances, [
    (f"EXPIRE {A} 100", "1"), (f"TTL {A}", "100"), (f"PTTL {A}", "100000"), (f"EXPIRETIME {A}", "1893456100"), (f"PEXPIRETIME {A}", "1893456100000"), (f"EXPIRE {A} 50 GT", "0"), (f"EXPIRE {A} 50 LT", "1"),
    (f"TTL {A}", "50"), (f"PERSIST {A}", "1"), (f"TTL {A}", "-1"), (f"PEXPIRE {A} 2500", "1"), (f"PTTL {A}", "2500"), (f"EXPIREAT {A} 1893456010", "1"), (f"TTL {A}", "10"), (f"PEXPIREAT {A} 1893456020000", "1"),
    (f"TTL {A}", "20"), ("TTL none", "-2"), ("EXPIRE none 5", "0"), (f"SETEX {B} 30 soon", "OK"), (f"TTL {B}", "30"), (f"PSETEX {B} 40000 later", "OK"), (f"TTL {B}", "40"), (f"GETEX {B} PERSIST", "later"), (f"TTL {B}", "-1"),
    (f"GETEX {B} EX 9", "later"), (f"TTL {B}", "9"), ("MSETEX 2 k1 a k2 b EX 60", "1"), ("TTL k2", "60"), (f"EXPIREAT {A} 1", "1"), (f"GET {A}", "~"), (f"EXISTS {A}", "0"), ("DBSIZE", "SELECT count(*) + 1 FROM customer"),
])
_script("kv_keys", _balances, [
    (f"RENAME {A} renamed", "OK"), ("GET renamed", _balance(A)), (f"EXISTS {A}", "0"), (f"RENAMENX renamed {B}", "0"), (f"RENAMENX renamed {A}", "1"), (f"COPY {A} twin", "1"), ("GET twin", _balance(A)), (f"COPY {A} {B}", "0"),
    (f"COPY {A} {B} REPLACE", "1"), (f"GET {B}", _balance(A)), (f"DEL {A} none", "1"), ("UNLINK twin", "1"), ("MOVE none 1", "0"), (f"MOVE {B} 1", "1"), (f"EXISTS {B}", "0"), ("SELECT 1", "OK"), (f"GET {B}", _balance(A)), ("DBSIZE", "1"),
    ("RANDOMKEY", B), ("FLUSHDB", "OK"), ("DBSIZE", "0"), ("SELECT 0", "OK"), ("DBSIZE", "SELECT count(*) - 2 FROM customer"), ("FLUSHALL", "OK"), ("DBSIZE", "0"),
])
_script("kv_transaction", _balances, [
    (f"WATCH {A}", "OK"), ("MULTI", "OK"), (f"GET {A}", "QUEUED"), ("INCR hits", "QUEUED"), ("EXEC", f"{_balance(A, '''0 || '|[["' || v || '"]]' ''')} UNION ALL SELECT '1|[[\"1\"]]'"), (f"WATCH {A}", "OK"), (f"SET {A} changed", "OK"),
    ("MULTI", "OK"), ("INCR hits", "QUEUED"), ("EXEC", "~|~"), ("GET hits", "1"), ("MULTI", "OK"), ("INCR hits", "QUEUED"), ("DISCARD", "OK"), ("GET hits", "1"), ("UNWATCH", "OK"),
])

# --- hashes ---------------------------------------------------------------------------------------------


def _parts(store: Store, d: str) -> None:
    store.load("hash", T.part_hashes(store.spark, d).withColumn("expire_at", F.lit(None).cast("timestamp")))


def _part(shown: str) -> str:
    return f"SELECT {shown} FROM part WHERE p_partkey = 7"


_script("hash_reads", _parts, [
    ("HGET part:7 p_name", _part("p_name")), ("HMGET part:7 p_brand none p_size", f"{_part('''0 || '|p_brand|' || p_brand''')} UNION ALL SELECT '1|none|~' UNION ALL {_part('''2 || '|p_size|' || p_size''')}"),
    ("HGETALL part:7", _part("unnest(['p_name|' || p_name, 'p_brand|' || p_brand, 'p_type|' || p_type, 'p_size|' || p_size])")), ("HKEYS part:7", ["p_name", "p_brand", "p_type", "p_size"]),
    ("HVALS part:7", _part("unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR)])")), ("HLEN part:7", "4"), ("HLEN none", "0"), ("HEXISTS part:7 p_type", "1"), ("HEXISTS part:7 none", "0"),
    ("HSTRLEN part:7 p_name", _part("strlen(p_name)")), ("HSCAN part:7 0 MATCH p_[bt]* COUNT 10", _part("unnest(['p_brand|' || p_brand, 'p_type|' || p_type])")), ("HTTL part:7 FIELDS 2 p_name none", ["0|p_name|-1", "1|none|-2"]),
    ("HRANDFIELD part:7 9", _part("unnest(['p_name|' || p_name, 'p_brand|' || p_brand, 'p_type|' || p_type, 'p_size|' || p_size])")), ("TYPE part:7", "hash"), ("DBSIZE", "SELECT count(*) FROM part"),
])
_script("hash_writes", _parts, [
    ("HSET part:7 p_size 99 extra x", "1"), ("HGET part:7 p_size", "99"), ("HMSET part:7 extra y other z", "OK"), ("HSETNX part:7 extra no", "0"), ("HSETNX part:7 last w", "1"), ("HINCRBY part:7 p_size 1", "100"),
    ("HINCRBYFLOAT part:7 p_size 0.5", "100.5"), ("HDEL part:7 last none", "1"), ("HLEN part:7", "6"), ("HGETDEL part:7 FIELDS 1 other", "0|other|z"), ("HLEN part:7", "5"), ("HEXPIRE part:7 100 FIELDS 1 extra", "0|extra|100"),
    ("HPTTL part:7 FIELDS 1 extra", "0|extra|100000"), ("HEXPIRETIME part:7 FIELDS 2 extra p_name", ["0|extra|1893456100", "1|p_name|-1"]), ("HPEXPIRETIME part:7 FIELDS 1 extra", "0|extra|1893456100000"), ("HPERSIST part:7 FIELDS 1 extra", "OK"),
    ("HTTL part:7 FIELDS 1 extra", "0|extra|-1"), ("HPEXPIRE part:7 5000 FIELDS 1 extra", "0|extra|5"), ("HEXPIREAT part:7 1893456200 FIELDS 1 extra", "0|extra|200"), ("HPEXPIREAT part:7 1893456300000 FIELDS 1 extra", "0|extra|300"),
    ("HGETEX part:7 EX 60 FIELDS 1 extra", "0|extra|y"), ("HTTL part:7 FIELDS 1 extra", "0|extra|60"), ("HSETEX part:7 FNX EX 70 FIELDS 1 extra q", "0"), ("HSETEX part:7 EX 70 FIELDS 2 extra q more r", "1"), ("HTTL part:7 FIELDS 2 extra more", ["0|extra|70", "1|more|70"]),
    ("HGET part:7 p_name", _part("p_name")),
])

# --- lists --------------------------------------------------------------------------------------------


def _orders(store: Store, d: str) -> None:
    store.load("list", T.order_lists(store.spark, d))


_L = "(SELECT CAST(o_orderkey AS VARCHAR) AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders WHERE o_custkey = 7)"
_script("list_reads", _orders, [
    ("LLEN c:7", "SELECT count(*) FROM orders WHERE o_custkey = 7"), ("LRANGE c:7 0 -1", f"SELECT v FROM {_L}"), ("LRANGE c:7 1 2", f"SELECT v FROM {_L} WHERE i IN (1, 2)"), ("LINDEX c:7 0", f"SELECT v FROM {_L} WHERE i = 0"),
    ("LINDEX c:7 -1", f"SELECT v FROM {_L} WHERE i = n - 1"), ("LLEN none", "0"), ("TYPE c:7", "list"),
])
_script("list_writes", _orders, [
    ("RPUSH c:7 x y x", "SELECT count(*) + 3 FROM orders WHERE o_custkey = 7"), ("LPUSH c:7 a b", "SELECT count(*) + 5 FROM orders WHERE o_custkey = 7"), ("LRANGE c:7 0 1", ["b", "a"]), ("LPUSHX none v", "0"), ("RPUSHX c:7 z", "SELECT count(*) + 6 FROM orders WHERE o_custkey = 7"),
    ("LPOS c:7 x", "SELECT count(*) + 2 FROM orders WHERE o_custkey = 7"), ("LPOS c:7 x RANK -1", "SELECT count(*) + 4 FROM orders WHERE o_custkey = 7"), ("LREM c:7 0 x", "2"), ("LSET c:7 0 B", "OK"), ("LINDEX c:7 0", "B"),
    ("LINSERT c:7 BEFORE a ab", "SELECT count(*) + 5 FROM orders WHERE o_custkey = 7"), ("LRANGE c:7 0 2", ["B", "ab", "a"]), ("LPOP c:7 2", ["B", "ab"]), ("RPOP c:7", "z"), ("LMOVE c:7 other LEFT RIGHT", "a"), ("RPOPLPUSH c:7 other", "y"),
    ("LRANGE other 0 -1", ["y", "a"]), ("LRANGE c:7 0 -1", f"SELECT v FROM {_L}"), ("LTRIM c:7 1 1", "OK"), ("LRANGE c:7 0 -1", f"SELECT v FROM {_L} WHERE i = 1"), ("LMPOP 2 none other LEFT COUNT 1", "other|y"),
    ("BLPOP other 1", "other|a"), ("RPUSH q 1 2 3 4 5", "5"), ("BRPOP q 1", "q|5"), ("BLMPOP 1 1 q LEFT COUNT 2", ["q|1", "q|2"]), ("BLMOVE q w LEFT LEFT 1", "3"), ("BRPOPLPUSH q w 1", "4"), ("LRANGE w 0 -1", ["4", "3"]), ("LLEN q", "0"),
])

# --- sets and sorted sets --------------------------------------------------------------------------------


def _statuses(store: Store, d: str) -> None:
    store.load("set", T.status_sets(store.spark, d))


def _of(status: str) -> str:
    return f"SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = '{status}'"


_script("set_commands", _statuses, [
    ("SMEMBERS P", _of("P")), ("SCARD F", f"SELECT count(*) FROM ({_of('F')})"), ("SADD P new 1x", "2"), ("SREM P 1x none", "1"), ("SISMEMBER P new", "1"), ("SMISMEMBER P new none", ["0|new|1", "1|none|0"]), ("SMOVE P F new", "1"), ("SISMEMBER F new", "1"),
    ("SREM F new", "1"), ("SUNIONSTORE u F P", f"SELECT count(*) FROM ({_of('F')} UNION {_of('P')})"), ("SINTERSTORE i F P", f"SELECT count(*) FROM ({_of('F')} INTERSECT {_of('P')})"), ("SDIFFSTORE d O F", f"SELECT count(*) FROM ({_of('O')} EXCEPT {_of('F')})"),
    ("SMEMBERS d", f"{_of('O')} EXCEPT {_of('F')}"), ("SUNION F P", f"{_of('F')} UNION {_of('P')}"), ("SINTER F O", f"{_of('F')} INTERSECT {_of('O')}"), ("SDIFF O P", f"{_of('O')} EXCEPT {_of('P')}"), ("SINTERCARD 2 F P", f"SELECT count(*) FROM ({_of('F')} INTERSECT {_of('P')})"),
    ("SADD s a b c", "3"), ("SSCAN s 0 MATCH [ab] COUNT 9", ["a", "b"]), ("SRANDMEMBER s 9", ["a", "b", "c"]), ("SPOP s 9", ["a", "b", "c"]), ("SCARD s", "0"), ("TYPE F", "set"),
])


def _segments(store: Store, d: str) -> None:
    store.load("zset", T.customer_zset(store.spark, d).unionByName(T.nation_zsets(store.spark, d)))


_Z = "(SELECT c_name AS m, c_acctbal AS s, row_number() OVER (ORDER BY c_acctbal, c_name) - 1 AS r, count(*) OVER () AS n FROM customer WHERE c_mktsegment = 'BUILDING')"
_M = f"(SELECT m FROM {_Z} WHERE r = 3)"
_script("zset_reads", _segments, [
    ("ZCARD BUILDING", f"SELECT count(*) FROM {_Z}"), (f"ZSCORE BUILDING {A}", "SELECT coalesce(max(CAST(c_acctbal AS VARCHAR)), '~') FROM customer WHERE c_name = 'Customer#000000007' AND c_mktsegment = 'BUILDING'"),
    ("ZRANGE BUILDING 0 2 WITHSCORES", f"SELECT m || '|' || s FROM {_Z} WHERE r < 3"), ("ZREVRANGE BUILDING 0 1", f"SELECT m || '|' || s FROM {_Z} WHERE r >= n - 2"), ("ZCOUNT BUILDING 0 (5000", f"SELECT count(*) FROM {_Z} WHERE s >= 0 AND s < 5000"),
    ("ZRANGEBYSCORE BUILDING (9000 +inf", f"SELECT m || '|' || s FROM {_Z} WHERE s > 9000"), ("ZREVRANGEBYSCORE BUILDING 100 -100", f"SELECT m || '|' || s FROM {_Z} WHERE s BETWEEN -100 AND 100"),
    ("ZRANGEBYLEX BUILDING [Customer#00000005 (Customer#00000009", f"SELECT m || '|' || s FROM {_Z} WHERE m >= 'Customer#00000005' AND m < 'Customer#00000009'"),
    ("ZREVRANGEBYLEX BUILDING (Customer#00000003 -", f"SELECT m || '|' || s FROM {_Z} WHERE m < 'Customer#00000003'"), ("ZRANGE BUILDING -100 100 BYSCORE LIMIT 1 2", f"SELECT m || '|' || s FROM {_Z} WHERE s BETWEEN -100 AND 100 ORDER BY s, m LIMIT 2 OFFSET 1"),
    ("ZLEXCOUNT BUILDING - (Customer#00000003", f"SELECT count(*) FROM {_Z} WHERE m < 'Customer#00000003'"), ("ZINTERCARD 2 customer supplier", "SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)"),
    ("ZDIFF 2 customer none", "SELECT c_nationkey || '|' || max(c_acctbal) FROM customer GROUP BY c_nationkey"), ("ZUNION 2 customer supplier AGGREGATE MAX", "SELECT k || '|' || max(b) FROM (SELECT c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY k"),
    ("ZSCAN customer 0 MATCH 1? COUNT 100", "SELECT c_nationkey || '|' || max(c_acctbal) FROM customer WHERE c_nationkey BETWEEN 10 AND 19 GROUP BY c_nationkey"),
])
_script("zset_writes", _segments, [
    ("ZADD z 1 a 2 b 3 c 4 d", "4"), ("ZADD z CH GT 5 a 1 b", "1"), ("ZADD z XX 9 none", "0"), ("ZADD z INCR 2 b", "4.0"), ("ZINCRBY z 0.5 b", "4.5"), ("ZSCORE z b", "4.5"), ("ZMSCORE z a none", ["0|a|5.0", "1|none|~"]), ("ZRANK z b", "b|2"), ("ZREVRANK z a", "a|0"),
    ("ZRANGESTORE k z 1 2", "2"), ("ZRANGE k 0 -1", ["d|4.0", "b|4.5"]), ("ZREM z d none", "1"), ("ZREMRANGEBYSCORE z (4.5 5", "1"), ("ZREMRANGEBYLEX k [b [b", "1"), ("ZREMRANGEBYRANK z 0 0", "1"), ("ZRANGE z 0 -1", "b|4.5"), ("ZADD p 1 a 2 b 3 c 4 d 5 e 6 f", "6"),
    ("ZPOPMIN p", "p|a|1.0"), ("ZPOPMAX p 2", ["p|f|6.0", "p|e|5.0"]), ("ZMPOP 2 none p MIN", "p|b|2.0"), ("BZPOPMIN p 1", "p|c|3.0"), ("BZPOPMAX p 1", "p|d|4.0"), ("ZCARD p", "0"), ("BZMPOP 1 1 z MAX", "z|b|4.5"),
    ("ZUNIONSTORE u 2 customer supplier", "SELECT count(DISTINCT k) FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)"), ("ZINTERSTORE i 2 customer supplier AGGREGATE MIN", "SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)"),
    ("ZINTER 2 i customer WEIGHTS 0 1", "SELECT c_nationkey || '|' || max(c_acctbal) FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY c_nationkey"), ("ZDIFFSTORE d 2 u customer", "SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)"),
    ("ZADD one 1 m", "1"), ("ZRANDMEMBER one 3", "SELECT 'm|1.0'"),
])

# --- geo ----------------------------------------------------------------------------------------------


def _places(store: Store, d: str) -> None:
    store.load("geo", geosets.add(T.customer_places(store.spark, d)))


_script("geo_commands", _places, [
    ("ZCARD places", "0"), ("GEOADD g 13.361389 38.115556 Palermo 15.087269 37.502669 Catania", "2"), ("GEOADD g NX 0 0 Palermo", "0"), ("GEODIST g Palermo Catania km", "166.2742"), ("GEOPOS g Palermo", "0|Palermo|13.361389|38.115556"), ("GEOHASH g Palermo Catania", ["Palermo|sqc8b49rny0", "Catania|sqdtr74hyu0"]),
    ("GEOSEARCHSTORE one places FROMMEMBER Customer#000000007 BYRADIUS 1 m", "1"), ("GEOSEARCHSTORE near places FROMLONLAT 15 37 BYRADIUS 3000 km", f"SELECT count(*) FROM ({T._PLACES}) WHERE {T._hav('15.0', '37.0', 'lon', 'lat', '6372797.560856')} <= 3000000"),
])

# --- streams -------------------------------------------------------------------------------------------


def _events(store: Store, d: str) -> None:
    store.load("stream", T.event_streams(store.spark, d))


_E = "(SELECT (epoch_us(ts) // 1000) AS ms, event_id AS q, user_id AS u, row_number() OVER (ORDER BY (epoch_us(ts) // 1000), event_id) AS i, count(*) OVER () AS n FROM events WHERE event_type = 'click')"
_ROW = "'click|' || ms || '|' || q || '|' || '[{\"name\":\"user\",\"value\":\"' || u || '\"}]'"
_ID = "'click|' || ms || '|' || q"
_AT = """'{"ms":' || ms || ',"seq":' || q || '}'"""
_script("stream_commands", _events, [
    ("XLEN click", f"SELECT count(*) FROM {_E}"), ("XREVRANGE click + - COUNT 3", f"SELECT {_ROW} FROM {_E} WHERE i > n - 3"), ("XRANGE click - + COUNT 2", f"SELECT {_ROW} FROM {_E} WHERE i <= 2"), ("XREAD COUNT 2 STREAMS click 0", f"SELECT {_ROW} FROM {_E} WHERE i <= 2"),
    ("XADD s 5-1 a b", "5-1"), ("XADD s 5-2 a c", "5-2"), ("XADD s * a d", "1893456000000-0"), ("XADD s * a e", "1893456000000-1"), ("XDEL s 5-1 9-9", "1"), ("XLEN s", "3"), ("XTRIM s MAXLEN 2", "1"), ("XDELEX s KEEPREF IDS 1 1893456000000-0", "0|1"), ("XSETID s 1893456000009-0", "OK"),
    ("XADD s * a f", "1893456000009-1"), ("XRANGE s - +", ['s|1893456000000|1|[{"name":"a","value":"e"}]', 's|1893456000009|1|[{"name":"a","value":"f"}]']), ("TYPE click", "stream"),
])
_script("stream_group_commands", _events, [
    ("XGROUP CREATE click g 0", "OK"), ("XREADGROUP GROUP g ann COUNT 4 STREAMS click >", f"SELECT {_ROW} FROM {_E} WHERE i <= 4"), ("XREADGROUP GROUP g bob COUNT 2 STREAMS click >", f"SELECT {_ROW} FROM {_E} WHERE i IN (5, 6)"),
    ("XPENDING click g", f"SELECT 'click|g|6|' || min({_AT}) FILTER (i = 1) || '|' || min({_AT}) FILTER (i = 6) || '|[{{\"consumer\":\"ann\",\"n\":4}},{{\"consumer\":\"bob\",\"n\":2}}]' FROM {_E}"), ("XREADGROUP GROUP g ann STREAMS click 0", f"SELECT {_ROW} FROM {_E} WHERE i <= 4"),
    ("XAUTOCLAIM click g bob 0 0 COUNT 1 JUSTID", f"SELECT {_ID} FROM {_E} WHERE i = 1"), ("XGROUP DELCONSUMER click g bob", "3"), ("XGROUP DESTROY click g", "1"),
])

# --- documents, vectors --------------------------------------------------------------------------------


def _props(store: Store, d: str) -> None:
    store.load("json", K.table(store.spark, d, "events").select(F.concat(F.lit("e:"), "event_id").alias("key"), F.col("props").alias("doc")))


def _k(shown: str) -> str:
    return f"SELECT {shown} FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id = 7)"


_script("json_commands", _props, [
    ("JSON.GET e:7 $.k", _k("k")), ("JSON.TYPE e:7 $.k", "integer"), ("JSON.OBJKEYS e:7", "k"), ("JSON.NUMINCRBY e:7 $.k 3", _k("k + 3")), ("JSON.SET e:7 $.name '\"ab\"'", '"OK"'), ("JSON.STRAPPEND e:7 $.name '\"cd\"'", "4"), ("JSON.GET e:7 $.name", '"abcd"'),
    ("JSON.SET e:7 $.list '[1,2]'", '"OK"'), ("JSON.ARRAPPEND e:7 $.list 3 4", "4"), ("JSON.ARRINSERT e:7 $.list 0 0", "5"), ("JSON.ARRPOP e:7 $.list", "4"), ("JSON.GET e:7 $.list", "[0,1,2,3]"), ("JSON.DEL e:7 $.list", "1"), ("JSON.OBJKEYS e:7", "k,name"),
    ("JSON.MSET x $ '{\"a\":1}' y $ '{\"a\":2}'", "OK"), ("JSON.MGET x y none $.a", ["0|x|1", "1|y|2", "2|none|~"]), ("DBSIZE", "SELECT count(*) + 2 FROM events"),
])


def _vectors(store: Store, d: str) -> None:
    attrs = F.to_json(F.struct("label"))
    store.load("vector", K.table(store.spark, d, "embeddings").select(F.lit("v").alias("key"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), attrs.alias("attrs")))


_script("vector_commands", _vectors, [
    ("VCARD v", "SELECT count(*) FROM embeddings"), ("VDIM v", "SELECT max(len(embedding)) FROM embeddings"), ("VGETATTR v 7", "SELECT '{\"label\":' || label || '}' FROM embeddings WHERE vec_id = 7"), ("VISMEMBER v 7", "1"), ("VISMEMBER v none", "0"), ("VSIM v ELE 7 COUNT 1", "7|1.0"),
    ("VSETATTR v 7 '{\"label\":99}'", "1"), ("VSIM v ELE 7 COUNT 5 FILTER '.label == 99'", "7|1.0"), ("VRANGE v [100 [102 9", "SELECT CAST(vec_id AS VARCHAR) AS s FROM embeddings WHERE CAST(vec_id AS VARCHAR) BETWEEN '100' AND '102' ORDER BY s LIMIT 9"), ("VREM v 7 none", "1"), ("VCARD v", "SELECT count(*) - 1 FROM embeddings"),
    ("VADD w VALUES 2 1 0 a", "1"), ("VADD w VALUES 2 0 1 b", "1"), ("VEMB w a", "[1.0,0.0]"), ("VLINKS w a", "b|0.5|1.0"), ("VRANDMEMBER w 5", ["a", "b"]), ("VADD w REDUCE 2 VALUES 4 1 2 3 4 c", "1"), ("VINFO w", "w|3|2"),
])
