"""Named Python functions as scripts: over values, over whole scans, and read-only over a session."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Scripts:
    """Functions by name. ``load`` gives a digest by which a function can be called too."""

    def __init__(self):
        self.known: dict[str, Callable] = {}
        self.digests: dict[str, str] = {}

    def load(self, name: str, function: Callable) -> str:
        digest = hashlib.sha1(f"{name}:{getattr(function, '__code__', function)!r}".encode()).hexdigest()
        self.known[name], self.digests[digest] = function, name
        return digest

    def delete(self, name: str) -> bool:
        self.digests = {d: n for d, n in self.digests.items() if n != name}
        return self.known.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self.known)

    def exists(self, *digests: str) -> list[bool]:
        return [d in self.digests for d in digests]

    def flush(self) -> None:
        self.known, self.digests = {}, {}

    def _get(self, name: str) -> Callable:
        name = self.digests.get(name, name)
        if name not in self.known:
            raise KeyError(f"no script {name}")
        return self.known[name]

    def call(self, name: str, *args: object) -> object:
        return self._get(name)(*args)

    def column(self, name: str, kind: str = "string"):
        """The function as a vectorised column function of one text value."""
        f = self._get(name)

        @F.pandas_udf(kind)
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else f(v))

        return run

    def scan(self, strings: DataFrame, name: str, prefix: str, limit: int | None = None) -> DataFrame:
        """Rows under a key prefix for which the function is true; limit bounds the rows scanned, not the result."""
        rows = strings.where(F.startswith("key", F.lit(prefix)))
        if limit is not None:
            rows = rows.orderBy("key").limit(limit)
        f = self._get(name)

        @F.pandas_udf("boolean")
        def holds(keys: pd.Series, values: pd.Series) -> pd.Series:
            return pd.Series([bool(f(k, v)) for k, v in zip(keys, values, strict=True)], dtype=bool)

        return rows.where(holds("key", "value"))
