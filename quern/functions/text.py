"""Text analysis as column expressions: tokens, tags, phonetic codes, edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quern.functions.porter import stem

WORD = r"[a-z0-9_\p{L}\p{N}]++"
MARKS = "'.,’"
_MARKS = f"[{MARKS}]"
_MARKED = f"({WORD}(?:{_MARKS}{WORD})*+)"
_HAN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


def tokens(text: Column, ngrams: bool = False) -> Column:
    """Lower-case words; marks inside words vanish (can't: cant, 3.14: 314). With ngrams, runs
    of ideographs become their single characters and pairs. Null text has no tokens."""
    # words with their inner marks, one pass over the text; then the marks go from all words at once
    marked = F.regexp_extract_all(F.lower(text), F.lit(_MARKED), F.lit(1))
    found = F.filter(F.split(F.translate(F.array_join(marked, " "), MARKS, ""), " "), lambda t: t != "")
    if ngrams:
        def cut(t: Column) -> Column:
            ones = F.split(t, "")
            twos = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
            return F.when(t.rlike(_HAN), F.array_distinct(F.concat(ones, twos))).otherwise(F.array(t))

        found = F.flatten(F.transform(found, cut))
    return F.coalesce(found, F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    """The number of ``tokens`` without ngrams; null for null text."""
    return F.regexp_count(F.lower(text), F.lit(_MARKED))


def tags(text: Column, separator: str = ",", case_sensitive: bool = False) -> Column:
    """Split, trimmed, without empty ones, lower-cased unless case_sensitive."""
    parts = F.transform(F.split(text if case_sensitive else F.lower(text), f"\\Q{separator}\\E"), lambda t: F.trim(t))
    return F.coalesce(F.filter(parts, lambda t: t != ""), F.array().cast("array<string>"))


def soundex(word: Column) -> Column:
    """Four-place code in which vowels, H and W separate equal digits (Ashcraft: A226)."""
    upper = F.upper(word)
    digits = F.translate(upper, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    coded = F.regexp_replace(F.substring(F.regexp_replace(digits, r"(\d)\1+", "$1"), 2, 64), "[^1-6]", "")
    return F.when(upper.rlike("^[A-Z]"), F.rpad(F.concat(F.substring(upper, 1, 1), coded), 4, "0"))


def soundex_code(word: str) -> str | None:
    """``soundex`` of a query's word."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    upper = word.upper()
    if not upper or not "A" <= upper[0] <= "Z":
        return None
    digits, coded = upper.translate(table)[:64], []
    for i, c in enumerate(digits):
        if c.isdigit() and i and digits[i - 1] == c:
            continue
        coded.append(c)
    return (upper[0] + "".join(c for c in coded[1:] if c in "123456") + "000")[:4]


def suffixes(token: Column) -> Column:
    """Suffixes of tokens of four or more characters, from the second character on, of two bytes or more."""
    from_each = F.transform(F.sequence(F.lit(2), F.greatest(F.length(token), F.lit(2))), lambda i: F.substring(token, i, F.length(token)))
    return F.when(F.length(token) >= 4, F.filter(from_each, lambda s: F.octet_length(s) >= 2)).otherwise(F.array().cast("array<string>"))


def near(token: Column, word: str) -> Column:
    """At most one insertion, deletion, replacement or swap of neighbours away."""
    swaps = sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word})
    by_edit = F.levenshtein(token, F.lit(word), 1) >= 0
    return by_edit | token.isin(swaps) if swaps else by_edit


def glob_regex(pattern: str) -> str:
    """Anchored Java regex of a glob: * ? [class] and backslash."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            negated = body.startswith(("^", "!"))
            body = (body[1:] if negated else body).replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            out.append(c if c.isalnum() or c in " _" else "\\" + c if ord(c) < 128 else c)
        i += 1
    return "^" + "".join(out) + "$"


def wildcard_regex(pattern: str) -> str:
    """Like a glob, but without classes."""
    return glob_regex(pattern.lower().replace("[", "\\["))


@F.pandas_udf(ArrayType(StringType()))
def stems(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of token arrays; each distinct token of a batch is stemmed once."""
    for s in parts:
        known = {t: stem(t) for t in {t for row in s if row is not None for t in row}}
        yield s.map(lambda row: None if row is None else [known[t] for t in row])


def phrase_within(slop: int, inorder: bool, words: list[str]):
    """A pandas UDF over token arrays: do the words stand within slop other words, in order if asked for?"""

    def fits(row) -> bool:
        if row is None:
            return False
        places = [[i for i, t in enumerate(row) if t == w] for w in words]
        if not all(places):
            return False
        if inorder:
            for first in places[0]:
                at = first
                for p in places[1:]:
                    at = next((i for i in p if i > at), None)
                    if at is None:
                        break
                if at is not None and at - first + 1 - len(words) <= slop:
                    return True
            return False
        # a window slides over all places; equal words need different places
        events = sorted({(i, w) for w, p in zip(words, places, strict=True) for i in p})
        need = {w: words.count(w) for w in words}
        have, lo, missing = dict.fromkeys(need, 0), 0, len(need)
        for i, w in events:
            have[w] += 1
            missing -= have[w] == need[w]
            while missing == 0:
                if i - events[lo][0] + 1 - len(words) <= slop:
                    return True
                gone = events[lo][1]
                missing += have[gone] == need[gone]
                have[gone] -= 1
                lo += 1
        return False

    @F.pandas_udf("boolean")
    def matches(rows: pd.Series) -> pd.Series:
        return rows.map(fits).astype(bool)

    return matches


def highlight(text: Column, terms: list[str], opening: str = "<b>", closing: str = "</b>") -> Column:
    """Each term wrapped wherever it occurs, in any case, one term after another."""
    quote = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    for t in terms:
        text = F.regexp_replace(text, F.lit(f"(?iu)(\\Q{t}\\E)"), F.lit(f"{quote(opening)}$1{quote(closing)}"))
    return text


def summarize(text: Column, terms: list[str], fragments: int = 1, length: int = 20, separator: str = "... ") -> Column:
    """The first fragments of ``length`` characters around matches, in text order."""
    if not terms:
        return F.substring(text, 1, length)
    any_term = "|".join(f"\\Q{t}\\E" for t in terms)
    half = max(0, (length - max(map(len, terms))) // 2)
    found = F.regexp_extract_all(text, F.lit(f"(?ius)(.{{0,{half}}}(?:{any_term}).{{0,{half}}})"), F.lit(1))
    return F.when(F.size(found) > 0, F.concat(F.array_join(F.slice(found, 1, fragments), separator), F.lit(separator))).otherwise(F.substring(text, 1, length))


def spelling_variants(word: str) -> set[str]:
    """Words one swap of neighbours away."""
    return {word[:i] + b + a + word[i + 2 :] for i, (a, b) in enumerate(zip(word, word[1:], strict=False))}


