"""Strings as (key, value) rows, value binary or text: ranges, counters, bits and ordered writes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.keys import requested


def byte_length(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0))


def byte_range(value: Column, start: int, end: int) -> Column:
    """Bytes start to end, both included, negative ones from the end."""
    v = value.cast("binary")
    n = F.octet_length(v)
    first = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    last = F.least(F.lit(end) if end >= 0 else n + end, n - 1)
    return F.when(first > last, F.lit(b"")).otherwise(F.substring(v, first + 1, last - first + 1))


def overwrite(value: Column, offset: int, piece: bytes) -> Column:
    """Pads with zero bytes up to offset, then overwrites."""
    v = F.coalesce(value.cast("binary"), F.lit(b""))
    head = F.rpad(F.substring(v, 1, offset), offset, F.lit(b"\0")) if offset else F.lit(b"")
    return F.concat(head, F.lit(piece), F.substring(v, offset + len(piece) + 1, 2**31 - 1 - offset - len(piece)))


def counters(rows: DataFrame) -> DataFrame:
    """Sums (key, delta) as 64-bit numbers; an overflow is an error. Commutes, so no order is needed."""
    total = F.sum(F.col("delta").cast("decimal(38,0)"))
    whole = total.try_cast("bigint")
    return rows.groupBy("key").agg(F.coalesce(whole, F.raise_error(F.lit("increment would overflow")).cast("bigint")).alias("value"))


def appended(rows: DataFrame) -> DataFrame:
    """Concatenates (key, seq, value) in order of seq."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "value")))
    return rows.groupBy("key").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("value"))


def byte_at(value: Column, index: Column) -> Column:
    """The byte at a 0-based index as a number, 0 beyond the end."""
    one = F.substring(value.cast("binary"), index.cast("int") + 1, F.lit(1))
    return F.when(F.octet_length(one) == 1, F.conv(F.hex(one), 16, 10).cast("int")).otherwise(F.lit(0))


def bit_at(value: Column, offset: int) -> Column:
    """The bit at an offset, the most significant of a byte first."""
    return F.shiftright(byte_at(value, F.lit(offset // 8)), 7 - offset % 8).bitwiseAND(F.lit(1))


def _byte_list(value: Column) -> Column:
    v = value.cast("binary")
    return F.when(F.octet_length(v) > 0, F.transform(F.sequence(F.lit(0), F.octet_length(v) - 1), lambda i: byte_at(v, i))).otherwise(F.array().cast("array<int>"))


def _clamped(n: Column, start: int, end: int) -> tuple[Column, Column]:
    first = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    return first, F.least(F.lit(end) if end >= 0 else n + end, n - 1)


def bit_count(value: Column, start: int = 0, end: int = -1, bits: bool = False) -> Column:
    """Set bits in a range of bytes, or of bits."""
    v = value.cast("binary")
    size = F.octet_length(v) * (8 if bits else 1)
    first, last = _clamped(size, start, end)

    def inside(i: Column) -> Column:
        byte = byte_at(v, i)
        if not bits:
            return F.bit_count(byte)
        high = F.lit(255)
        low_cut = F.greatest(first - i * 8, F.lit(0))
        high_cut = F.greatest(i * 8 + 7 - last, F.lit(0))
        mask = F.call_function("shiftright", high, low_cut).bitwiseAND(F.call_function("shiftleft", high, high_cut))
        return F.bit_count(byte.bitwiseAND(mask))

    a, b = (F.floor(first / 8).cast("int"), F.floor(last / 8).cast("int")) if bits else (first.cast("int"), last.cast("int"))
    found = F.aggregate(F.transform(F.sequence(a, b), inside), F.lit(0), lambda x, y: x + y)
    return F.when((F.octet_length(v) > 0) & (first <= last), found).otherwise(F.lit(0))


def bit_position(value: Column, bit: int, start: int = 0, end: int | None = None, bits: bool = False) -> Column:
    """Place of the first bit of that kind in the range, -1 without one. A search for 0 without an end runs past the value."""
    v = value.cast("binary")
    text = F.array_join(F.transform(_byte_list(v), lambda x: F.lpad(F.bin(x), 8, "0")), "")
    size = F.octet_length(v) * (8 if bits else 1)
    first, last = _clamped(size, start, -1 if end is None else end)
    a, b = (first, last) if bits else (first * 8, last * 8 + 7)
    at = F.locate(str(bit), F.substring(text, a + 1, F.greatest(b - a + 1, F.lit(0))))
    none = F.octet_length(v) * 8 if bit == 0 and end is None else F.lit(-1)
    return F.when(at > 0, a + at - 1).when(F.octet_length(v) == 0, F.lit(-1 if bit else 0)).when(first > last, F.lit(-1)).otherwise(none)


def bit_operation(rows: DataFrame, operation: str) -> DataFrame:
    """AND, OR, XOR of all values (zero-padded to the longest), or NOT of the only one: one row."""
    operation = operation.upper()
    if operation == "NOT":
        flipped = F.transform(_byte_list(F.col("value")), lambda x: x.bitwiseXOR(F.lit(255)))
        codes = rows.select(flipped.alias("codes"))
    else:
        fold = {"AND": F.bit_and, "OR": F.bit_or, "XOR": F.bit_xor}[operation]
        n = rows.agg(F.count(F.lit(1)).alias("n"))
        byte = rows.select(F.posexplode(_byte_list(F.col("value"))).alias("at", "byte")).groupBy("at").agg(fold("byte").alias("byte"), F.count(F.lit(1)).alias("have"))
        whole = byte.join(F.broadcast(n)).select("at", F.when((F.col("have") < F.col("n")) & F.lit(operation == "AND"), F.lit(0)).otherwise(F.col("byte")).alias("byte"))
        codes = whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "byte"))), lambda p: p["byte"]).alias("codes"))
    return codes.select(F.unhex(F.array_join(F.transform("codes", lambda x: F.lpad(F.hex(x), 2, "0")), "")).alias("value"))


def _bounds(kind: str) -> tuple[int, int, int]:
    signed, width = kind[0] == "i", int(kind[1:])
    if kind[0] not in "iu" or not 1 <= width <= (64 if signed else 63):
        raise ValueError(f"unknown type {kind}")
    return width, -(1 << width - 1) if signed else 0, (1 << width - 1) - 1 if signed else (1 << width) - 1


def bit_field(value: Column, kind: str, offset: int) -> Column:
    """A packed number: u1 to u63 or i1 to i64 at a bit offset."""
    width, signed = _bounds(kind)[0], kind[0] == "i"
    out = F.lit(0).cast("bigint")
    for i in range(offset // 8, (offset + width - 1) // 8 + 1):
        lo, hi = max(offset, 8 * i), min(offset + width, 8 * i + 8)
        part = F.shiftright(byte_at(value, F.lit(i)), 8 * i + 8 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).cast("bigint")
        out = out.bitwiseOR(F.shiftleft(part, offset + width - hi))
    if signed and width < 64:
        out = F.shiftright(F.shiftleft(out, 64 - width), 64 - width)
    return out


def field_update(kind: str, offset: int, by: int, increment: bool = False, overflow: str = "WRAP"):
    """Writes a packed number, or adds to it: a function of a binary column to (value, reply).

    Beyond the type's range it wraps, saturates (SAT) or, with FAIL, changes nothing and replies null. The reply is the
    old number of a write and the new one of an addition. Values grow by zero bytes as needed.
    """
    width, low, high = _bounds(kind)
    if overflow not in ("WRAP", "SAT", "FAIL"):
        raise ValueError(f"unknown overflow {overflow}")

    def one(raw: bytes | None) -> tuple[bytes, int | None]:
        size = max(len(raw or b""), (offset + width + 7) // 8)
        whole = int.from_bytes((raw or b"").ljust(size, b"\0"), "big")
        shift = 8 * size - offset - width
        old = whole >> shift & (1 << width) - 1
        old -= (1 << width) * (old > high)
        new = old + by if increment else by
        if not low <= new <= high:
            if overflow == "FAIL":
                return raw or b"", None
            new = min(max(new, low), high) if overflow == "SAT" else (new - low) % (1 << width) + low
        bits = new & (1 << width) - 1
        whole = whole & ~(((1 << width) - 1) << shift) | bits << shift
        return whole.to_bytes(size, "big"), new if increment else old

    @F.pandas_udf("value binary, reply long")
    def run(values: pd.Series) -> pd.DataFrame:
        done = [one(None if v is None else bytes(v)) for v in values]
        return pd.DataFrame({"value": [v for v, _ in done], "reply": pd.array([r for _, r in done], "Int64")})

    return run


def common_subsequence(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds the longest common subsequence of two text columns and its length."""

    def longest(x: str, y: str) -> str:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        out = []
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                out.append(x[i])
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return "".join(out)

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else longest(p, q) for p, q in zip(x, y, strict=True)])

    return pairs.withColumn("lcs", run(a, b)).withColumn("lcs_length", F.length("lcs"))


#: Commands of the ordered fold and the columns of a log row: seq, key, cmd, arg, now (milliseconds), at (expiry or null).
COMMANDS = ("SET", "SETNX", "SETXX", "GETSET", "GETDEL", "APPEND", "INCRBY", "INCRBYFLOAT", "SETRANGE", "EXPIREAT", "PERSIST", "DEL", "GET")


def fold(log: DataFrame) -> DataFrame:
    """Replays an ordered log of writes: per row its reply, in order of seq for each key.

    For order-dependent commands only; counters() and appended() need no single task for a key.
    A key's rows stream through in batches, so its log may be longer than memory.
    """

    def replay(state: dict, cmd: str, arg: str | None, now: int, at: int | None):
        if state["at"] is not None and now >= state["at"]:
            state["value"] = state["at"] = None
        old = state["value"]

        def put(v: str | None, expiry: int | None = None) -> None:
            state["value"], state["at"] = v, expiry

        match cmd:
            case "GET":
                return old
            case "SET":
                put(arg, at)
                return "OK"
            case "SETNX":
                if old is None:
                    put(arg, at)
                return str(int(old is None))
            case "SETXX":
                if old is not None:
                    put(arg, at)
                return str(int(old is not None))
            case "GETSET":
                put(arg)
                return old
            case "GETDEL":
                put(None)
                return old
            case "DEL":
                put(None)
                return str(int(old is not None))
            case "APPEND":
                state["value"] = (old or "") + (arg or "")
                return str(len(state["value"].encode()))
            case "INCRBY":
                try:
                    total = int(old or "0") + int(arg)
                except ValueError:
                    return "ERR not an integer"
                if not -(1 << 63) <= total < 1 << 63:
                    return "ERR overflow"
                state["value"] = str(total)
                return state["value"]
            case "INCRBYFLOAT":
                try:
                    total = float(old or "0") + float(arg)
                except ValueError:
                    return "ERR not a float"
                if total != total or abs(total) == float("inf"):
                    return "ERR not finite"
                state["value"] = str(int(total)) if total.is_integer() and abs(total) < 1e15 else repr(total)
                return state["value"]
            case "SETRANGE":
                offset, piece = arg.split(":", 1)
                raw, new = (old or "").encode("utf-8", "surrogateescape").ljust(int(offset), b"\0"), piece.encode()
                raw = raw[: int(offset)] + new + raw[int(offset) + len(new) :]
                state["value"] = raw.decode("utf-8", "replace")  # text: what a write cuts of a character becomes the replacement character
                return str(len(raw))
            case "EXPIREAT":
                if old is not None:
                    state["at"] = at
                return str(int(old is not None))
            case "PERSIST":
                had, state["at"] = state["at"], None
                return str(int(had is not None))
        raise ValueError(f"unknown command {cmd}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["key"] != key or not state:
                    key, state = r["key"], {"value": None, "at": None}
                out.append((r["seq"], key, replay(state, r["cmd"], r["arg"], r["now"], r["at"]), state["value"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["seq", "key", "reply", "value"])

    ordered = log.select("seq", "key", "cmd", "arg", "now", "at").repartition("key").sortWithinPartitions("key", "seq")
    return ordered.mapInArrow(run, "seq long, key string, reply string, value string")


def final_values(replies: DataFrame) -> DataFrame:
    return replies.groupBy("key").agg(F.max_by("value", "seq").alias("value")).where("value is not null")


def many(strings: DataFrame, keys: Sequence[str]) -> DataFrame:
    return requested(strings, "key", keys).select("ordinal", "key", "value")
