"""The search query language: text to a tree of small dataclasses.

    or := and ('|' and)*      and := unary+      unary := ('-' | '~') unary | postfix
    postfix := primary ('=>' '[' KNN ... ']' | '=>' '{' $attribute: value; ... '}')*

At dialect 1 a minus binds to the next postfix only; later dialects agree here, since a
unary already is the smallest unit. Parameters ($name) are replaced before parsing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace


class QueryError(ValueError):
    pass


class Node:
    pass


@dataclass(frozen=True)
class All(Node):
    pass


@dataclass(frozen=True)
class Text(Node):
    word: str


@dataclass(frozen=True)
class Phrase(Node):
    words: tuple[str, ...]
    slop: int = 0
    inorder: bool = True


@dataclass(frozen=True)
class EmptyText(Node):
    pass


@dataclass(frozen=True)
class Prefix(Node):
    start: str


@dataclass(frozen=True)
class Wildcard(Node):
    pattern: str


@dataclass(frozen=True)
class Fuzzy(Node):
    word: str


@dataclass(frozen=True)
class Tag(Node):
    name: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Numeric(Node):
    name: str
    low: float
    high: float
    low_open: bool = False
    high_open: bool = False


@dataclass(frozen=True)
class Geo(Node):
    name: str
    lon: float
    lat: float
    radius: float
    unit: str


@dataclass(frozen=True)
class GeoShape(Node):
    name: str
    relation: str
    wkt: str


@dataclass(frozen=True)
class Missing(Node):
    name: str


@dataclass(frozen=True)
class Scope(Node):
    names: tuple[str, ...]
    child: Node


@dataclass(frozen=True)
class And(Node):
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    child: Node


@dataclass(frozen=True)
class Optional(Node):
    child: Node


@dataclass(frozen=True)
class Attributed(Node):
    child: Node
    attributes: tuple[tuple[str, str], ...] = field(default=())


@dataclass(frozen=True)
class VectorKnn(Node):
    child: Node
    k: int
    name: str
    vector: str
    alias: str | None = None


@dataclass(frozen=True)
class VectorRange(Node):
    name: str
    radius: float
    vector: str


_LEX = re.compile(
    r"""\s*(?:(?P<phrase>"(?:[^"\\]|\\.)*")|(?P<field>@\w+(?:\|\w+)*\s*:)|(?P<missing>ismissing\(\s*@(?P<gone>\w+)\s*\))|(?P<fuzzy>%(?:[^%\\]|\\.)+%)
    |(?P<arrow>=>)|(?P<tag>\{(?:[^}\\]|\\.)*\})|(?P<range>\[[^\]]*\])|(?P<mark>[()|~-])|(?P<word>(?:[^\s()|{}\[\]"%@~\\=-]|\\.)(?:[^\s()|{}\[\]"%\\=]|\\.)*))""",
    re.VERBOSE,
)


def _plain(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def _bound(s: str) -> tuple[float, bool]:
    opened = s.startswith("(")
    try:
        return float(s[1:] if opened else s), opened
    except ValueError:
        raise QueryError(f"not a number: {s}") from None


def with_params(query: str, params: dict[str, object]) -> str:
    def put(m: re.Match) -> str:
        if m[1] not in params:
            raise QueryError(f"no parameter ${m[1]}")
        return m[0] if isinstance(params[m[1]], (list, tuple, bytes)) else str(params[m[1]])

    return re.sub(r"\$(?!weight|slop|inorder|phonetic)(\w+)", put, query)


class Parser:
    def __init__(self, query: str):
        self.tokens, at = [], 0
        while query[at:].strip():
            m = _LEX.match(query, at)
            if not m:
                raise QueryError(f"cannot read {query[at:]!r}")
            kind = m.lastgroup if m.lastgroup != "gone" else "missing"
            self.tokens.append((kind, m["gone"] if kind == "missing" else m[kind]))
            at = m.end()

    def parse(self) -> Node:
        if not self.tokens:
            return All()
        node = self._or()
        if self.tokens:
            raise QueryError(f"unexpected {self.tokens[0][1]!r}")
        _check_vectors(node, False)
        return node

    def _next(self, *marks: str) -> bool:
        return bool(self.tokens) and self.tokens[0][0] == "mark" and self.tokens[0][1] in marks

    def _or(self) -> Node:
        parts = [self._and()]
        while self._next("|"):
            self.tokens.pop(0)
            parts.append(self._and())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def _and(self) -> Node:
        parts = []
        while self.tokens and not self._next("|", ")"):
            parts.append(self._unary())
        if not parts:
            raise QueryError("an empty group")
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def _unary(self) -> Node:
        if self._next("-"):
            self.tokens.pop(0)
            return Not(self._unary())
        if self._next("~"):
            self.tokens.pop(0)
            return Optional(self._unary())
        return self._postfix()

    def _postfix(self) -> Node:
        node = self._primary()
        while self.tokens and self.tokens[0][0] == "arrow":
            self.tokens.pop(0)
            kind, text = self.tokens.pop(0) if self.tokens else ("", "")
            if kind == "range":
                m = re.fullmatch(r"\[\s*KNN\s+(\d+)\s+@(\w+)\s+\$?(\S+?)(?:\s+EF_RUNTIME\s+\d+)?(?:\s+AS\s+(\w+))?\s*\]", text, re.IGNORECASE)
                if not m:
                    raise QueryError(f"cannot read {text}")
                node = VectorKnn(node, int(m[1]), m[2], m[3], m[4])
            elif kind == "tag":
                pairs = []
                for part in filter(None, (p.strip() for p in text[1:-1].split(";"))):
                    m = re.fullmatch(r"\$(weight|slop|inorder|phonetic)\s*:\s*(\S+)", part)
                    if not m:
                        raise QueryError(f"cannot read {part}")
                    pairs.append((m[1], m[2]))
                node = _attributed(node, tuple(pairs))
            else:
                raise QueryError("=> needs [KNN ...] or {$...}")
        return node

    def _primary(self) -> Node:
        kind, text = self.tokens.pop(0)
        if kind == "mark" and text == "(":
            node = self._or()
            if not self._next(")"):
                raise QueryError("a bracket is not closed")
            self.tokens.pop(0)
            return node
        if kind == "phrase":
            words = tuple(_plain(text[1:-1]).split())
            return EmptyText() if not words else Text(words[0]) if len(words) == 1 else Phrase(words)
        if kind == "missing":
            return Missing(text)
        if kind == "fuzzy":
            return Fuzzy(_plain(text[1:-1]))
        if kind == "field":
            return self._scoped(tuple(x.strip() for x in text[1:].rstrip().removesuffix(":").split("|")))
        if kind == "word":
            if text == "*":
                return All()
            bare = re.sub(r"\\.", "", text)
            if bare.endswith("*") and bare.count("*") == 1 and "?" not in bare:
                if len(_plain(text)) < 3:
                    raise QueryError("a prefix needs two letters")
                return Prefix(_plain(text[:-1]))
            if "*" in bare or "?" in bare:
                return Wildcard(text)
            return Text(_plain(text))
        raise QueryError(f"unexpected {text!r}")

    def _scoped(self, names: tuple[str, ...]) -> Node:
        if not self.tokens:
            raise QueryError(f"nothing after @{'|'.join(names)}:")
        kind, text = self.tokens[0]
        if kind == "tag":
            self.tokens.pop(0)
            values = tuple(_plain(v.strip()) for v in re.split(r"(?<!\\)\|", text[1:-1]))
            return Tag(names[0], tuple(v for v in values if v) or ("",))
        if kind == "range":
            self.tokens.pop(0)
            return _range(names[0], text[1:-1].strip())
        return Scope(names, self._unary())


def _range(name: str, text: str) -> Node:
    parts = text.split()
    head = parts[0].upper() if parts else ""
    if head == "VECTOR_RANGE" and len(parts) == 3:
        return VectorRange(name, float(parts[1]), parts[2].removeprefix("$"))
    if head in ("WITHIN", "CONTAINS"):
        return GeoShape(name, head, text[len(head) :].strip())
    if len(parts) == 4:
        return Geo(name, *(float(x) for x in parts[:3]), parts[3].lower())
    if len(parts) == 2:
        (low, a), (high, b) = map(_bound, parts)
        return Numeric(name, low, high, a, b)
    raise QueryError(f"cannot read [{text}]")


def _attributed(node: Node, pairs: tuple[tuple[str, str], ...]) -> Node:
    given = dict(pairs)

    def put(n: Node) -> Node:
        if isinstance(n, Phrase):
            return replace(n, slop=int(given.get("slop", n.slop)), inorder=given["inorder"].lower() == "true" if "inorder" in given else n.inorder and "slop" not in given)
        if isinstance(n, (Scope, Not, Optional)):
            return replace(n, child=put(n.child))
        if isinstance(n, (And, Or)):
            return replace(n, children=tuple(map(put, n.children)))
        return n

    return Attributed(put(node), pairs)


def _check_vectors(node: Node, barred: bool) -> int:
    own = int(isinstance(node, (VectorKnn, VectorRange)))
    if own and barred:
        raise QueryError("a vector clause stands under OR, NOT or OPTIONAL")
    inside = barred or isinstance(node, (Or, Not, Optional))
    kids = node.children if isinstance(node, (And, Or)) else (node.child,) if hasattr(node, "child") else ()
    n = own + sum(_check_vectors(k, inside) for k in kids)
    if n > 1:
        raise QueryError("two vector clauses")
    return n


def parse(query: str, params: dict[str, object] | None = None) -> Node:
    return Parser(with_params(query, params or {})).parse()


def explain(node: Node, depth: int = 0) -> str:
    """The tree, a line a node."""
    kids = node.children if isinstance(node, (And, Or)) else (node.child,) if hasattr(node, "child") else ()
    own = ", ".join(f"{k}={v!r}" for k, v in vars(node).items() if k not in ("child", "children"))
    return "\n".join(["  " * depth + type(node).__name__.upper() + (f" {own}" if own else ""), *(explain(k, depth + 1) for k in kids)])
