"""Search commands as text: FT.CREATE, FT.SEARCH, FT.AGGREGATE, FT.HYBRID and their kin over registered frames."""

from __future__ import annotations

import shlex
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import dictionaries
from quern.plans import query as Q
from quern.plans.aggregate import Reduce, aggregate
from quern.plans.index import KINDS, Field, Index
from quern.plans.search import count, hybrid, search


class CommandError(ValueError):
    pass


class Args:
    """A cursor over the words of a command."""

    def __init__(self, words: Sequence[object]):
        self.words, self.at = list(words), 0

    def __bool__(self) -> bool:
        return self.at < len(self.words)

    def next(self):
        if not self:
            raise CommandError("the command ends too early")
        self.at += 1
        return self.words[self.at - 1]

    def upper(self) -> str:
        return str(self.next()).upper()

    def number(self) -> int:
        try:
            return int(self.next())
        except ValueError:
            raise CommandError(f"not a number: {self.words[self.at - 1]}") from None

    def some(self) -> list:
        """A count and as many words."""
        return [self.next() for _ in range(self.number())]

    def peek(self) -> str:
        return str(self.words[self.at]).upper() if self else ""

    def take(self, word: str) -> bool:
        if self.peek() == word:
            self.at += 1
            return True
        return False


#: Languages that texts are analysed in; words of the others would be split alike, but not stemmed.
LANGUAGES = ("english", "chinese")


class SearchCatalog:
    """Sources by name, indexes over them, aliases, and what dictionaries hold."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sources: dict[str, tuple[DataFrame, str]] = {}
        self.indexes: dict[str, Index] = {}
        self.source_of: dict[str, str] = {}
        self.aliases: dict[str, str] = {}
        self.synonyms: dict[str, dict[str, set[str]]] = {}
        self.cursors: dict[int, tuple[DataFrame, int, int]] = {}
        self.settings: dict[str, str] = {}
        self.terms = spark.createDataFrame([], "dict string, term string")
        self.suggestions = spark.createDataFrame([], "key string, string string, score double, payload string")

    def register(self, name: str, source: DataFrame, key: str) -> None:
        """A frame that FT.CREATE can name after PREFIX."""
        self.sources[name] = (source, key)

    def index(self, name: str) -> Index:
        name = self.aliases.get(name, name)
        if name not in self.indexes:
            raise CommandError(f"no such index {name}")
        groups = self.synonyms.get(name, {})
        return replace(self.indexes[name], synonyms=tuple(tuple(sorted(g)) for g in groups.values())) if groups else self.indexes[name]

    def run(self, *words: object) -> DataFrame:
        """One command: as words, or as one text with shell quoting."""
        if len(words) == 1 and isinstance(words[0], str):
            words = tuple(shlex.split(words[0]))
        args = Args(words)
        name = args.upper()
        handler = getattr(self, "_" + name.lower().replace(".", "_"), None)
        if not name.startswith("FT.") or handler is None:
            raise CommandError(f"unknown command {name}")
        return handler(args)

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _ok(self) -> DataFrame:
        return self._rows([("OK",)], "reply string")

    # --- definitions -------------------------------------------------------------------------

    def _schema(self, args: Args) -> list[Field]:
        fields = []
        while args:
            source = name = str(args.next())
            if args.take("AS"):
                name = str(args.next())
            kind = args.upper()
            if kind not in KINDS:
                raise CommandError(f"unknown kind {kind}")
            given: dict[str, object] = {"stem": kind == "TEXT"}
            if kind == "VECTOR":
                args.upper()  # the algorithm: search is exact
                options = args.some()
                pairs = {str(k).upper(): v for k, v in zip(options[::2], options[1::2], strict=True)}
                given["metric"] = str(pairs.get("DISTANCE_METRIC", "L2")).upper()
            while args.peek() in ("SORTABLE", "UNF", "NOINDEX", "WEIGHT", "NOSTEM", "PHONETIC", "SEPARATOR", "CASESENSITIVE", "WITHSUFFIXTRIE", "INDEXEMPTY", "INDEXMISSING"):
                match args.upper():
                    case "SORTABLE":
                        given["sortable"] = True
                    case "NOINDEX":
                        given["no_index"] = True
                    case "WEIGHT":
                        given["weight"] = float(args.next())
                    case "NOSTEM":
                        given["stem"] = False
                    case "PHONETIC":
                        args.next()
                        given["phonetic"] = True
                    case "SEPARATOR":
                        given["separator"] = str(args.next())
                    case "CASESENSITIVE":
                        given["case_sensitive"] = True
                    case "WITHSUFFIXTRIE":
                        given["suffixes"] = True
                    case "INDEXEMPTY":
                        given["index_empty"] = True
                    case "INDEXMISSING":
                        given["index_missing"] = True
            fields.append(Field(name, kind, source if source != name else None, **given))
        return fields

    def _ft_create(self, args: Args) -> DataFrame:
        name, given, source = str(args.next()), {}, None
        while not args.take("SCHEMA"):
            match args.upper():
                case "ON":
                    args.next()
                case "PREFIX":
                    source = str(args.some()[0])
                case "FILTER":
                    given["filter"] = str(args.next())
                case "LANGUAGE":
                    given["language"] = str(args.next()).lower()
                case "SCORE":
                    given["score"] = float(args.next())
                case "SCORE_FIELD":
                    given["score_field"] = str(args.next())
                case "PAYLOAD_FIELD":
                    given["payload_field"] = str(args.next())
                case "STOPWORDS":
                    given["stopwords"] = frozenset(str(w).lower() for w in args.some())
                case "LANGUAGE_FIELD" | "TEMPORARY":
                    args.next()
                case "MAXTEXTFIELDS" | "NOOFFSETS" | "NOHL" | "NOFIELDS" | "NOFREQS" | "SKIPINITIALSCAN" | "INDEXALL":
                    pass  # storage hints
                case other:
                    raise CommandError(f"unknown option {other}")
        if name in self.indexes:
            raise CommandError(f"index {name} exists")
        source = source or name
        if source not in self.sources:
            raise CommandError(f"no source {source}")
        df, key = self.sources[source]
        self.indexes[name], self.source_of[name] = Index(df, key, tuple(self._schema(args)), **given), source
        return self._ok()

    def _ft_alter(self, args: Args) -> DataFrame:
        name = self.aliases.get(n := str(args.next()), n)
        args.take("SKIPINITIALSCAN")
        if not (args.take("SCHEMA") and args.take("ADD")):
            raise CommandError("SCHEMA ADD is missing")
        self.indexes[name] = self.index(name).altered(*self._schema(args))
        return self._ok()

    def _ft_dropindex(self, args: Args) -> DataFrame:
        name = self.aliases.get(n := str(args.next()), n)
        self.index(name)
        if args.take("DD"):
            self.sources.pop(self.source_of[name], None)
        del self.indexes[name], self.source_of[name]
        self.aliases = {a: n for a, n in self.aliases.items() if n != name}
        return self._ok()

    def _ft__list(self, args: Args) -> DataFrame:
        return self._rows([(n,) for n in sorted(self.indexes)], "name string")

    def _ft_aliasadd(self, args: Args) -> DataFrame:
        if args.words[args.at] in self.aliases:
            raise CommandError("the alias exists")
        return self._ft_aliasupdate(args)

    def _ft_aliasupdate(self, args: Args) -> DataFrame:
        alias, name = str(args.next()), str(args.next())
        self.index(name)
        self.aliases[alias] = name
        return self._ok()

    def _ft_aliasdel(self, args: Args) -> DataFrame:
        if self.aliases.pop(str(args.next()), None) is None:
            raise CommandError("no such alias")
        return self._ok()

    def _ft_info(self, args: Args) -> DataFrame:
        ix = self.index(str(args.next()))
        n = ix.documents().count()
        return self._rows([(f.name, f.kind, f.sortable, f.weight, n) for f in ix.fields], "field string, kind string, sortable boolean, weight double, documents long")

    # --- search ---------------------------------------------------------------------------------

    def _options(self, args: Args) -> dict:
        given: dict = {"params": {}}
        while args:
            match word := args.upper():
                case "LIMIT":
                    given["limit"] = (args.number(), args.number())
                case "NOCONTENT":
                    given["returns"] = []
                case "VERBATIM":
                    given["verbatim"] = True
                case "NOSTOPWORDS":
                    given["nostopwords"] = True
                case "WITHSCORES" | "WITHPAYLOADS" | "WITHSORTKEYS" | "WITHCURSOR":
                    pass  # these columns are always there
                case "RETURN":
                    names = []
                    listed = Args(args.some())
                    while listed:
                        name = str(listed.next()).removeprefix("@")
                        names.append((name, str(listed.next())) if listed.take("AS") else (name, name))
                    given["returns"] = names
                case "FILTER":
                    given.setdefault("filters", []).append((str(args.next()), str(args.next()), str(args.next())))
                case "GEOFILTER":
                    given.setdefault("geofilters", []).append((str(args.next()), float(args.next()), float(args.next()), float(args.next()), str(args.next()).lower()))
                case "INKEYS":
                    given["inkeys"] = args.some()
                case "INFIELDS":
                    given["infields"] = [str(x) for x in args.some()]
                case "SORTBY":
                    name = str(args.next()).removeprefix("@")
                    given["sortby"] = (name, args.upper() if args.peek() in ("ASC", "DESC") else "ASC")
                case "SLOP":
                    given["slop"] = args.number()
                case "INORDER":
                    given["inorder"] = True
                case "SCORER":
                    given["scorer"] = args.upper()
                case "EXPLAINSCORE":
                    given["explain_score"] = True
                case "SUMMARIZE" | "HIGHLIGHT":
                    own: dict = {}
                    while args.peek() in ("FIELDS", "FRAGS", "LEN", "SEPARATOR", "TAGS"):
                        match args.upper():
                            case "FIELDS":
                                own["fields"] = [str(x) for x in args.some()]
                            case "FRAGS":
                                own["fragments"] = args.number()
                            case "LEN":
                                own["length"] = args.number()
                            case "SEPARATOR":
                                own["separator"] = str(args.next())
                            case "TAGS":
                                own["tags"] = (str(args.next()), str(args.next()))
                    given[word.lower()] = own
                case "PARAMS":
                    pairs = args.some()
                    given["params"] |= dict(zip(map(str, pairs[::2]), pairs[1::2], strict=True))
                case "LANGUAGE":
                    given["language"] = str(args.next()).lower()
                    if given["language"] not in LANGUAGES:
                        raise CommandError(f"unsupported language {given['language']}")
                case "EXPANDER":
                    if args.upper() != "DEFAULT":
                        raise CommandError("there is no expander but DEFAULT")
                case "PAYLOAD":
                    args.next()  # no scorer reads it
                case "TIMEOUT":
                    if args.number() < 0:
                        raise CommandError("a timeout is not negative")
                case "DIALECT":
                    if not 1 <= args.number() <= 4:
                        raise CommandError("dialects are 1 to 4")
                case _:
                    raise CommandError(f"unknown option {word}")
        return given

    def _ft_search(self, args: Args) -> DataFrame:
        ix, query = self.index(str(args.next())), str(args.next())
        given = self._options(args)
        ix = replace(ix, language=given.pop("language", ix.language))
        if given.get("limit") == (0, 0):
            kept = ("params", "verbatim", "nostopwords", "infields", "slop", "inorder")
            return count(ix, query, **{k: v for k, v in given.items() if k in kept})
        return search(ix, query, **given)

    def _ft_aggregate(self, args: Args) -> DataFrame:
        ix, query = self.index(str(args.next())), str(args.next())
        rest = Args(args.words[args.at :])
        params: dict = {}
        words = [str(w).upper() for w in rest.words]
        if "PARAMS" in words:
            at = words.index("PARAMS")
            tail = Args(rest.words[at + 1 :])
            pairs = tail.some()
            params = dict(zip(map(str, pairs[::2]), pairs[1::2], strict=True))
            rest = Args(rest.words[:at] + tail.words[tail.at :])
        verbatim = "VERBATIM" in words
        p, limited, page = aggregate(ix, query, params, verbatim=verbatim), False, None
        while rest:
            match word := rest.upper():
                case "LOAD":
                    if rest.take("*"):
                        p = p.load("*")
                    else:
                        listed, names = Args(rest.some()), []
                        while listed:
                            name = str(listed.next())
                            names.append((name, str(listed.next())) if listed.take("AS") else name)
                        p = p.load(*names)
                case "APPLY":
                    expression = str(rest.next())
                    if not rest.take("AS"):
                        raise CommandError("APPLY needs AS")
                    p = p.apply(expression, str(rest.next()))
                case "FILTER":
                    p = p.filter(str(rest.next()))
                case "GROUPBY":
                    keys, reducers = [str(x) for x in rest.some()], []
                    while rest.take("REDUCE"):
                        kind, own = rest.upper(), rest.some()
                        name = str(rest.next()) if rest.take("AS") else None
                        reducers.append(Reduce(kind, str(own[0]) if own else None, name))
                    p = p.group(keys, *reducers)
                case "SORTBY":
                    listed, by = Args(rest.some()), []
                    while listed:
                        name = str(listed.next())
                        by.append((name, listed.upper() if listed.peek() in ("ASC", "DESC") else "ASC"))
                    p = p.sortby(*by)
                    if rest.take("MAX"):
                        p, limited = p.limit(0, rest.number()), True
                case "LIMIT":
                    p, limited = p.limit(rest.number(), rest.number()), True
                case "WITHCURSOR":
                    page = 1000
                    while rest.peek() in ("COUNT", "MAXIDLE"):
                        if rest.upper() == "COUNT":
                            page = rest.number()
                        else:
                            rest.next()
                    limited = True
                case "VERBATIM":
                    pass
                case "DIALECT" | "TIMEOUT":
                    rest.next()
                case _:
                    raise CommandError(f"unknown step {word}")
        if page is not None:  # pages come in the pipeline's order, so it always has one
            self.last_cursor = max(self.cursors, default=0) + 1
            self.cursors[self.last_cursor] = ((p if p.sorts or p.page else p.sortby(*p.key)).frame(), 0, page)
            return self._ft_cursor(Args(["READ", "", self.last_cursor]))
        return (p if limited else p.limit(0, 10)).frame()

    def _ft_cursor(self, args: Args) -> DataFrame:
        """READ gives the next page; an empty one ends the cursor."""
        word, _, n = args.upper(), args.next(), args.number()
        if n not in self.cursors:
            raise CommandError("no such cursor")
        if word == "DEL":
            del self.cursors[n]
            return self._ok()
        frame, at, size = self.cursors[n]
        size = args.number() if args.take("COUNT") else size
        self.cursors[n] = (frame, at + size, size)
        return frame.offset(at).limit(size) if at else frame.limit(size)

    def _ft_config(self, args: Args) -> DataFrame:
        if args.upper() == "SET":
            self.settings[args.upper()] = str(args.next())
            return self._ok()
        name = args.upper()
        return self._rows([x for x in sorted(self.settings.items()) if name in ("*", x[0])], "name string, value string")

    def _ft_hybrid(self, args: Args) -> DataFrame:
        ix, given, query, field, vector = self.index(str(args.next())), {}, "*", None, None
        params: dict = {}
        while args:
            match word := args.upper():
                case "SEARCH":
                    query = str(args.next())
                case "SCORER":
                    given["scorer"] = args.upper()
                case "VSIM":
                    field, vector = str(args.next()).removeprefix("@"), args.next()
                case "KNN" | "RANGE":
                    own = args.some()
                    pairs = {str(k).upper(): v for k, v in zip(own[::2], own[1::2], strict=True)}
                    if word == "KNN":
                        given["k"] = int(pairs.get("K", 10))
                    else:
                        given["radius"] = float(pairs["RADIUS"])
                case "FILTER":
                    given["post_filter"] = str(args.next())
                case "COMBINE":
                    given["combine"] = args.upper()
                    own = args.some()
                    pairs = {str(k).upper(): v for k, v in zip(own[::2], own[1::2], strict=True)}
                    for name, key, kind in (("WINDOW", "window", int), ("CONSTANT", "constant", float), ("ALPHA", "alpha", float), ("BETA", "beta", float)):
                        if name in pairs:
                            given[key] = kind(pairs[name])
                case "LIMIT":
                    given["limit"] = (args.number(), args.number())
                case "PARAMS":
                    pairs = args.some()
                    params = dict(zip(map(str, pairs[::2]), pairs[1::2], strict=True))
                case _:
                    raise CommandError(f"unknown option {word}")
        if field is None:
            raise CommandError("VSIM is missing")
        if isinstance(vector, str):
            vector = params[vector.removeprefix("$")]
        return hybrid(ix, query, field, list(vector), params=params, **given)

    def _ft_explain(self, args: Args) -> DataFrame:
        self.index(str(args.next()))
        tree = Q.parse(str(args.next()), self._options(args)["params"])
        return self._rows([(line,) for line in Q.explain(tree).splitlines()], "line string")

    _ft_explaincli = _ft_explain

    def _ft_profile(self, args: Args) -> DataFrame:
        """The physical plan of a search or an aggregation, a line a row."""
        name, kind = args.next(), args.upper()
        args.take("LIMITED")
        if not args.take("QUERY"):
            raise CommandError("QUERY is missing")
        df = self.run(f"FT.{kind}", name, *args.words[args.at :])
        return self._rows([(x,) for x in df._jdf.queryExecution().toString().splitlines() if x.strip()], "line string")

    def _ft_tagvals(self, args: Args) -> DataFrame:
        return dictionaries.tag_values(self.index(str(args.next())), str(args.next()))

    # --- dictionaries --------------------------------------------------------------------------

    def _ft_dictadd(self, args: Args) -> DataFrame:
        self.terms = dictionaries.add_terms(self.terms, str(args.next()), [str(x) for x in args.words[args.at :]])
        return self._ok()

    def _ft_dictdel(self, args: Args) -> DataFrame:
        self.terms = dictionaries.remove_terms(self.terms, str(args.next()), [str(x) for x in args.words[args.at :]])
        return self._ok()

    def _ft_dictdump(self, args: Args) -> DataFrame:
        return dictionaries.dump(self.terms, str(args.next()))

    def _ft_spellcheck(self, args: Args) -> DataFrame:
        ix, query, distance, lists = self.index(str(args.next())), str(args.next()), 1, {"INCLUDE": [], "EXCLUDE": []}
        while args:
            match word := args.upper():
                case "DISTANCE":
                    distance = args.number()
                case "TERMS":
                    way = args.upper()
                    if way not in lists:
                        raise CommandError(f"unknown list {way}")
                    lists[way].append(dictionaries.dump(self.terms, str(args.next())))
                case "DIALECT":
                    args.next()
                case _:
                    raise CommandError(f"unknown option {word}")
        return dictionaries.spellcheck(ix, query, distance, *(reduce(DataFrame.unionByName, lists[way]) if lists[way] else None for way in ("INCLUDE", "EXCLUDE")))

    def _ft_sugadd(self, args: Args) -> DataFrame:
        key, text, score = str(args.next()), str(args.next()), float(args.next())
        increment = args.take("INCR")
        payload = str(args.next()) if args.take("PAYLOAD") else None
        row = self._rows([(key, text, score, payload)], "key string, string string, score double, payload string")
        self.suggestions = dictionaries.suggestions_put(self.suggestions, row, increment)
        return self._ok()

    def _ft_sugget(self, args: Args) -> DataFrame:
        key, prefix, fuzzy, most = str(args.next()), str(args.next()), False, 5
        while args:
            match args.upper():
                case "FUZZY":
                    fuzzy = True
                case "MAX":
                    most = args.number()
        return dictionaries.suggest(self.suggestions, key, prefix, fuzzy, most)

    def _ft_sugdel(self, args: Args) -> DataFrame:
        key, text = str(args.next()), str(args.next())
        self.suggestions = self.suggestions.where(~((F.col("key") == key) & (F.col("string") == text)))
        return self._ok()

    def _ft_suglen(self, args: Args) -> DataFrame:
        return self.suggestions.where(F.col("key") == str(args.next())).agg(F.count(F.lit(1)).alias("n"))

    def _ft_synupdate(self, args: Args) -> DataFrame:
        name, group = str(args.next()), str(args.next())
        name = self.aliases.get(name, name)
        self.index(name)
        args.take("SKIPINITIALSCAN")
        self.synonyms.setdefault(name, {}).setdefault(group, set()).update(str(x).lower() for x in args.words[args.at :])
        return self._ok()

    def _ft_syndump(self, args: Args) -> DataFrame:
        name = self.aliases.get(n := str(args.next()), n)
        rows = [(g, t) for g, terms in self.synonyms.get(name, {}).items() for t in terms]
        return dictionaries.synonyms_dump(self._rows(rows, "grp string, term string"))
