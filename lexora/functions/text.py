"""Text functions on columns, all inside the JVM but for rows whose characters
need full Unicode decomposition."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HEBREW = r"\x{05D0}-\x{05EA}"
TOKEN = rf"""[A-Za-z{HEBREW}]+(?:["'\x{{05F3}}\x{{05F4}}][A-Za-z{HEBREW}]+)*"""
SCRIPT_WORD = r"[\x{0590}-\x{05FF}]+"
#: Fixed character sets of the punctuation features.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~־–—…׳״“”‘’"
QUOTES = "\"'׳״“”‘’"
BRACKETS = "()[]{}"
#: White space as (?U)\\s has it, and line breaks, for Python's patterns.
SPACES = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BREAKS = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def ends_line(text: str) -> bool:
    return text[-1:] in "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"


def _fold(s: str, form: str = "NFKD") -> str:
    plain = "".join(c for c in unicodedata.normalize(form, s) if unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", plain)


@lru_cache(None)
def _simple() -> tuple[str, str, str]:
    """Characters that fold to themselves or to one other, by rule: the sources
    and targets of the second kind, and a class of all of them."""
    ranges = [(0x00, 0x17F), (0x5BE, 0x5BE), (0x5C0, 0x5C0), (0x5C3, 0x5C3), (0x5D0, 0x5EA), (0x5F0, 0x5F4), (0x2010, 0x2023), (0x2028, 0x202F)]
    source, target = "", ""
    runs: list[list[int]] = []
    for a, b in ranges:
        for i in range(a, b + 1):
            f = _fold(chr(i))
            if len(f) == 1:
                if runs and runs[-1][1] == i - 1:
                    runs[-1][1] = i
                else:
                    runs.append([i, i])
                if f != chr(i):
                    source, target = source + chr(i), target + f
    return source, target, "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


@F.pandas_udf(StringType())
def _fold_any(s: pd.Series) -> pd.Series:
    return s.map(_fold, na_action="ignore")


def fold_marks(text: Column) -> Column:
    """NFKD, combining marks dropped, NFC. Rows of common letters only are
    translated in the JVM; the Arrow function sees null for them."""
    source, target, covered = _simple()
    easy = text.rlike(f"^[{covered}]*$")
    return F.when(easy, F.translate(text, source, target)).otherwise(_fold_any(F.when(~easy, text)))


@lru_cache(None)
def python_class(pattern: str) -> re.Pattern:
    """A Java pattern of classes as Python's: \\p{L}, \\p{N} and \\x{...}."""

    def ranges(kind: str) -> str:
        runs: list[list[int]] = []
        for i in range(0x110000):
            if unicodedata.category(chr(i))[0] == kind:
                if runs and runs[-1][1] == i - 1:
                    runs[-1][1] = i
                else:
                    runs.append([i, i])
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)

    for kind in "LN":
        if f"\\p{{{kind}}}" in pattern:
            inside = re.search(rf"\[[^\]]*\\p{{{kind}}}", pattern)
            pattern = pattern.replace(f"\\p{{{kind}}}", ranges(kind) if inside else f"[{ranges(kind)}]")
    return re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern))


_ALPHA = re.compile(r"[^\W\d_]+")


def finder(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a Java pattern of classes. \\w is just letters, numbers
    and _; classes of all letters are slow to search, so they are left to texts
    with numbers that are no digits."""
    if pattern == r"[\p{L}\p{N}_]{2,}":
        return re.compile(r"\w{2,}").findall
    exact = python_class(pattern).findall
    if pattern != r"\p{L}+":
        return exact

    def letters(text: str) -> list[str]:
        found = _ALPHA.findall(text)
        return found if all(map(str.isalpha, found)) else exact(text)

    return letters


@lru_cache(None)
def _folds() -> dict[str, str]:
    """What ``_simple`` covers beyond ASCII, and what each character becomes."""
    source, target, covered = _simple()
    other = dict(zip(source, target))
    inside = python_class(f"[{covered}]")
    return {c: other.get(c, c) for c in map(chr, range(0x80, 0x3000)) if inside.match(c)}


_RARE = re.compile("[^\x00-\x7f]")


def clean_text(text: str | None) -> str:
    """``normalize_text`` of one string."""
    if not text:
        return ""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    rare, to = set(_RARE.findall(text)), _folds()
    if not rare <= to.keys():
        return _fold(text)
    for c in rare:
        if to[c] != c:
            text = text.replace(c, to[c])
    return text


def normalize_text(text: Column) -> Column:
    """Null is empty; line ends become newlines; marks are folded."""
    return fold_marks(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"))


def normalize_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_label(label: Column) -> Column:
    """A decade label: 1980s, 2000s, 2020s, empty for empty, else an error."""
    v = normalize_spaces(F.lower(F.coalesce(label, F.lit(""))))
    return (
        F.when(v == "", "")
        .when(v.contains("1980") | v.rlike(r"\b80'?s\b|\b80\b"), "1980s")
        .when(v.contains("2000") | v.rlike(r"\b00'?s\b"), "2000s")
        .when(v.contains("2020") | v.rlike(r"\b20'?s\b"), "2020s")
        .otherwise(F.raise_error(F.concat(F.lit("unknown label: "), v)))
    )


def tokenize(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def non_empty_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), normalize_spaces), lambda s: s != "")


def safe_divide(a: Column, b: Column) -> Column:
    """0 where the denominator is 0 (or the ratio is not a number)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def count_in(tokens: Column, words: list[str]) -> Column:
    """How many tokens are in a word list. The list is a literal; membership is
    a hash-set probe."""
    if not words:
        return F.lit(0).cast("long")
    return F.size(F.filter(tokens, lambda t: t.isin(*words))).cast("long")


def char_class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


def count_chars(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


_QUOTE_FOLD = ("‘’׳“”״–—−", "'''\"\"\"---")


@F.pandas_udf(StringType())
def _compose_any(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def match_key(text: Column) -> Column:
    """Normalised join key: NFKC, Hebrew points removed (the maqaf with them),
    quotes and dashes folded, all but letters, digits and ' made spaces."""
    v = F.coalesce(text.cast("string"), F.lit(""))
    ascii_ = v.rlike(r"^\p{ASCII}*$")
    v = F.when(ascii_, v).otherwise(_compose_any(F.when(~ascii_, v)))
    v = F.regexp_replace(v, r"[\x{0591}-\x{05C7}]", "")
    v = F.translate(v, *_QUOTE_FOLD)
    v = F.regexp_replace(v, rf"[^A-Za-z0-9{HEBREW}']", " ")
    return F.lower(normalize_spaces(v))


def script_words(text: Column, pattern: str = SCRIPT_WORD) -> Column:
    """Runs of a script's characters; missing text reads as the word nan."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("nan")), F.lit(pattern), F.lit(0))


def split_lines_count(text: Column) -> Column:
    """Lines as str.splitlines counts them, blank ones included."""
    breaks = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
    v = F.coalesce(text, F.lit("nan"))
    return F.when(v == "", 0).otherwise(F.size(F.split(F.regexp_replace(v, f"({breaks})$", ""), breaks))).cast("long")


def topic_text(text: Column, stop: list[str], pattern: str = SCRIPT_WORD) -> Column:
    return F.array_join(F.filter(script_words(text, pattern), lambda w: ~w.isin(*stop) & (F.length(w) > 1)), " ")


def terms(text: Column, n: int = 1) -> Column:
    """The default analyser: lower-case runs of two or more word characters,
    and joined pairs of them for n = 2."""
    one = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    if n == 1:
        return one
    two = F.when(F.size(one) > 1, F.zip_with(F.slice(one, 1, F.size(one) - 1), F.slice(one, 2, F.size(one) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(one, F.coalesce(two, F.array().cast("array<string>")))


def parse_float(v: Column) -> Column:
    """Numbers as Python's float() reads them; null otherwise."""
    t = F.lower(F.trim(v))
    number = t.rlike(r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+)?$")
    odd = F.when(t.rlike(r"^[+-]?nan$"), F.lit(float("nan"))).when(t.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf"))).when(t.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
    return F.when(number, F.replace(t, F.lit("_"), F.lit("")).try_cast("double")).otherwise(odd)


def is_missing(v: Column) -> Column:
    return v.isNull() | F.lower(F.trim(v)).isin("", "nan")


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def parse_feats(feats: Column) -> Column:
    """Annotation features as an array of distinct (key, value) pairs."""
    v = F.coalesce(feats, F.lit(""))
    chunks = F.filter(F.split(F.when(v == "_", "").otherwise(v), "[|]"), lambda c: c.contains("="))

    def pairs(c: Column) -> Column:
        key = F.trim(F.substring_index(c, "=", 1))
        values = F.filter(F.transform(F.split(F.regexp_replace(c, "^[^=]*=", ""), ","), F.trim), lambda x: ~x.isin("", "_"))
        return F.transform(values, lambda x: F.struct(key.alias("key"), x.alias("value")))

    return F.array_distinct(F.flatten(F.transform(chunks, pairs)))
