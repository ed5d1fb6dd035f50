"""JSON documents as (key, doc) rows. Reads are built-in path expressions; edits parse in batches.

A text that is no JSON is left as it is, with a null reply.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = re.compile(r"\.([A-Za-z_][\w-]*)|\[(\d+)\]|\[['\"]([^'\"]+)['\"]\]")


def steps(path: str) -> list[str | int]:
    """A path without wildcards: $, .name, [n], ['name']."""
    rest = path[1:] if path.startswith("$") else "" if path == "." else path if path.startswith((".", "[")) else "." + path
    out, at = [], 0
    while at < len(rest):
        m = _STEP.match(rest, at)
        if not m:
            raise ValueError(f"cannot read path {path}")
        out.append(int(m[2]) if m[2] is not None else m[1] or m[3])
        at = m.end()
    return out


def spark_path(path: str) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps(path))


def get(doc: Column, path: str = "$") -> Column:
    """The value's JSON text; null where the path leads nowhere."""
    v = F.try_variant_get(F.try_parse_json(doc), spark_path(path), "variant")
    return F.to_json(v)


def kind(doc: Column, path: str = "$") -> Column:
    """object, array, string, integer, number, boolean or null."""
    name = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), spark_path(path), "variant"))
    return (
        F.when(name.isNull(), F.lit(None)).when(F.startswith(name, F.lit("OBJECT")), "object").when(F.startswith(name, F.lit("ARRAY")), "array").when(name == "STRING", "string")
        .when(name == "BIGINT", "integer").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")
    )


def keys(doc: Column, path: str = "$") -> Column:
    return F.json_object_keys(get(doc, path))


def many(documents: DataFrame, wanted: list[str], path: str = "$") -> DataFrame:
    asked = documents.sparkSession.createDataFrame(list(enumerate(wanted)), "ordinal int, key string")
    own = documents.where(F.col("key").isin(wanted))
    return asked.join(own, "key", "left").select("ordinal", "key", get(F.col("doc"), path).alias("value")).orderBy("ordinal")


class _Absent(Exception):
    pass


def _load(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        raise _Absent from None


def _parent(doc: Any, way: list[str | int]) -> tuple[Any, str | int]:
    for s in way[:-1]:
        try:
            doc = doc[s]
        except (KeyError, IndexError, TypeError):
            raise _Absent from None
    return doc, way[-1]


def _at(doc: Any, way: list[str | int]) -> Any:
    if not way:
        return doc
    holder, last = _parent(doc, way)
    try:
        return holder[last]
    except (KeyError, IndexError, TypeError):
        raise _Absent from None


def _edit(path: str, change: Callable[[Any], tuple[Any, Any]]):
    """A pandas UDF that changes the value at path: struct of the new document and a reply."""
    way = steps(path)

    def one(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, None
        try:
            doc = _load(text)
            new, reply = change(_at(doc, way))
        except _Absent:
            return text, None
        if way:
            holder, last = _parent(doc, way)
            holder[last] = new
        else:
            doc = new
        return json.dumps(doc, ensure_ascii=False, separators=(",", ":")), json.dumps(reply, ensure_ascii=False, separators=(",", ":"))

    @F.pandas_udf("doc string, reply string")
    def run(docs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(d) for d in docs], columns=["doc", "reply"])

    return run


def put(path: str, value: str, mode: str = ""):
    """SET at a path; NX only where nothing is, XX only where something is. The parent must be there."""
    way, new = steps(path), json.loads(value)

    def one(text: str | None) -> tuple[str | None, str | None]:
        if not way:
            done = not (mode == "NX" and text is not None or mode == "XX" and text is None)
            return (value if done else text), ('"OK"' if done else None)
        try:
            if text is None:
                raise _Absent
            doc = _load(text)
            holder, last = _parent(doc, way)
            there = last in holder if isinstance(holder, dict) else isinstance(holder, list) and isinstance(last, int) and last < len(holder)
            if not isinstance(holder, (dict, list)) or isinstance(holder, list) and not there or mode == "NX" and there or mode == "XX" and not there:
                raise _Absent
            holder[last] = new
        except _Absent:
            return text, None
        return json.dumps(doc, ensure_ascii=False, separators=(",", ":")), '"OK"'

    @F.pandas_udf("doc string, reply string")
    def run(docs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(d) for d in docs], columns=["doc", "reply"])

    return run


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def delete(path: str):
    """DEL at a path; the root makes the document null. Reply: how many went."""
    way = steps(path)

    def one(text: str | None) -> tuple[str | None, str]:
        if text is None or not way:
            return None, str(int(text is not None))
        try:
            doc = _load(text)
            holder, last = _parent(doc, way)
            del holder[last]
        except (_Absent, KeyError, IndexError, TypeError):
            return text, "0"
        return json.dumps(doc, ensure_ascii=False, separators=(",", ":")), "1"

    @F.pandas_udf("doc string, reply string")
    def run(docs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(d) for d in docs], columns=["doc", "reply"])

    return run


def add_number(path: str, by: float | int):
    def change(v):
        _need(isinstance(v, (int, float)) and not isinstance(v, bool), "not a number")
        return v + by, v + by

    return _edit(path, change)


def append_string(path: str, piece: str):
    def change(v):
        _need(isinstance(v, str), "not a string")
        return v + piece, len(v + piece)

    return _edit(path, change)


def append_array(path: str, *values: Any):
    def change(v):
        _need(isinstance(v, list), "not an array")
        return [*v, *values], len(v) + len(values)

    return _edit(path, change)


def insert_array(path: str, index: int, *values: Any):
    def change(v):
        _need(isinstance(v, list) and -len(v) <= index <= len(v), "not an array of that many")
        at = index if index >= 0 else len(v) + index
        return [*v[:at], *values, *v[at:]], len(v) + len(values)

    return _edit(path, change)


def pop_array(path: str, index: int = -1):
    def change(v):
        _need(isinstance(v, list), "not an array")
        if not v:
            return v, None
        at = max(0, min(len(v) - 1, index if index >= 0 else len(v) + index))
        return v[:at] + v[at + 1 :], v[at]

    return _edit(path, change)
