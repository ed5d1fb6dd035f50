"""An index is a declared schema over a DataFrame; nothing is stored twice."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.porter import stem
from quern.functions.values import is_numeric, to_number
from quern.plans.expressions import Compiler

KINDS = ("TEXT", "TAG", "NUMERIC", "GEO", "GEOSHAPE", "VECTOR")


@dataclass(frozen=True)
class Field:
    """A field of an index. ``source`` is its column, itself by default; GEO takes "lon,lat" text or a (lon, lat) pair of columns."""

    name: str
    kind: str
    source: str | tuple[str, str] | None = None
    weight: float = 1.0
    separator: str = ","
    case_sensitive: bool = False
    sortable: bool = False
    stem: bool = True
    phonetic: bool = False
    suffixes: bool = False
    index_empty: bool = False
    index_missing: bool = False
    metric: str = "L2"
    no_index: bool = False

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}")


@dataclass(frozen=True)
class Index:
    """source: the documents; key: their id column. ``filter`` is an expression that admits documents."""

    source: DataFrame
    key: str
    fields: tuple[Field, ...] = field(default=())
    stopwords: frozenset[str] = frozenset()
    synonyms: tuple[tuple[str, ...], ...] = ()
    language: str = "english"
    score: float = 1.0
    score_field: str | None = None
    payload_field: str | None = None
    filter: str | None = None
    expire_at: str | None = None
    now: object = None

    def documents(self) -> DataFrame:
        """Live documents that the filter admits."""
        df = self.source
        if self.expire_at:
            df = df.where(F.col(self.expire_at).isNull() | (F.col(self.expire_at) > F.lit(self.now)))
        if self.filter:
            df = df.where(Compiler(columns(df)).condition(self.filter))
        return df

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise ValueError(f"no field {name}")

    def text_fields(self, names: tuple[str, ...] | None = None) -> list[Field]:
        return [f for f in self.fields if f.kind == "TEXT" and not f.no_index and (names is None or f.name in names)]

    def column(self, f: Field) -> Column:
        return F.col(f"`{f.source or f.name}`")

    def altered(self, *added: Field) -> Index:
        return replace(self, fields=self.fields + added)

    def kind_of(self, f: Field) -> str:
        return dict(self.source.dtypes)[f.source or f.name]

    def values(self, f: Field) -> Column:
        """All values of a field as an array of strings, without nulls."""
        c, kind = self.column(f), self.kind_of(f)
        if kind.startswith("array"):
            return F.coalesce(F.filter(F.transform(c, lambda x: x.cast("string")), lambda x: x.isNotNull()), F.array().cast("array<string>"))
        return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c.cast("string")))

    def tokens(self, f: Field, raw: bool = False) -> Column:
        """Tokens of a text field; stop words go, variants come, unless raw."""
        c, kind = self.column(f), self.kind_of(f)
        ngrams = self.language == "chinese"
        found = F.flatten(F.transform(self.values(f), lambda v: T.tokens(v, ngrams))) if kind.startswith("array") else T.tokens(c, ngrams)
        if raw:
            return found
        if self.stopwords:
            found = F.filter(found, lambda t: ~t.isin(sorted(self.stopwords)))
        return found

    def unmarked(self, f: Field) -> Column | None:
        """The lower-case text without the marks that vanish from tokens; None for lists of texts."""
        return None if self.kind_of(f).startswith("array") else F.translate(F.lower(self.column(f).cast("string")), T.MARKS, "")

    def length(self, f: Field, raw: bool = False) -> Column | None:
        """The number of ``tokens`` without making them; None where only they tell."""
        if self.kind_of(f).startswith("array") or self.language == "chinese" or (self.stopwords and not raw):
            return None
        return F.coalesce(T.token_count(self.column(f)), F.lit(0))

    def has_variants(self, f: Field) -> bool:
        return self.stems(f) or f.phonetic or f.suffixes or bool(self.synonyms)

    def stems(self, f: Field) -> bool:
        return f.stem and self.language == "english"

    def variants(self, f: Field, own: Column) -> Column:
        """Tokens of a text field, given as ``own``, and once each what else they can be found by: synonyms, stems, phonetic codes, suffixes."""
        every = own
        for group in self.synonyms:
            terms = F.array(*[F.lit(t.lower()) for t in group])
            every = F.concat(every, F.when(F.arrays_overlap(own, terms), terms).otherwise(F.array().cast("array<string>")))
        more = [every] if self.synonyms else []
        if self.stems(f):
            more.append(T.stems(every))
        if f.phonetic:
            codes = F.transform(every, lambda t: F.concat(F.lit("phon"), F.lower(T.soundex(t))))
            more.append(F.filter(codes, lambda t: t.isNotNull()))
        if f.suffixes:
            more.append(F.flatten(F.transform(every, T.suffixes)))
        return F.concat(own, F.array_except(F.concat(*more), own)) if more else own

    def asked(self, f: Field, word: str) -> list[str]:
        """By what the variants of a field are searched for a word."""
        found = [word]
        if self.stems(f):
            found.append(stem(word))
        if f.phonetic and (code := T.soundex_code(word)):
            found.append(f"phon{code.lower()}")
        return list(dict.fromkeys(found))

    def numbers(self, f: Field) -> Column:
        """All numbers of a field as an array."""
        return F.filter(F.transform(self.values(f), to_number), lambda x: x.isNotNull())

    def sort_columns(self, name: str) -> tuple[Column, Column]:
        """Number and text by which a field sorts: its first value."""
        f = self.field(name)
        if is_numeric(self.kind_of(f)):
            return self.column(f).cast("double"), F.lit(None).cast("string")
        first = F.get(self.values(f), 0)
        return to_number(first), first


def columns(df: DataFrame) -> dict[str, tuple[Column, str]]:
    return {n: (F.col(f"`{n}`"), k) for n, k in df.dtypes}
