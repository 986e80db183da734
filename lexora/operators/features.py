"""Document features: 55 stylometric columns, and the cohort variants.

Everything is one narrow pass: no shuffle, no explode. ``feature_columns`` has
the features as columns; Spark interprets those for each token, so
``document_features`` counts a document's words in a Python worker instead,
some documents at a time, in time linear in the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from lexora import lexicons
from lexora.functions import text as T

BASIC = ["word_count", "unique_word_count", "char_count", "line_count", "avg_words_per_line", "median_words_per_line", "max_words_per_line", "min_words_per_line", "avg_word_length", "lexical_diversity", "repetition_ratio"]
PUNCTUATION = ["punctuation_count", "punctuation_ratio", "question_mark_count", "exclamation_mark_count", "comma_count", "quote_count", "parenthesis_count", "digit_count", "english_char_count", "english_char_ratio"]
LINES = ["repeated_lines_count", "repeated_lines_ratio", "unique_lines_count", "most_repeated_line_count", "chorus_repetition_score"]
WORDS = ["repeated_words_count", "repeated_words_ratio", "most_common_word_count", "most_common_word_ratio"]
PERSONS = [f"{p}_{k}" for p in lexicons.PRONOUNS for k in ("count", "ratio")] + ["we_vs_i_ratio", "direct_address_score"]
SEMANTIC = list(lexicons.SEMANTIC)
LAST_WORDS = ["last_word_unique_count", "last_word_repetition_ratio", "avg_last_word_length"]
FEATURES = BASIC + PUNCTUATION + LINES + WORDS + PERSONS + SEMANTIC + LAST_WORDS


def prepared(docs: DataFrame, body: str = "text") -> DataFrame:
    """``docs`` with clean text, tokens, lines and words per line."""
    return (
        docs.withColumn("__clean", T.normalize_text(F.col(body)))
        .withColumns({"__tok": T.tokenize(F.col("__clean")), "__lines": T.non_empty_lines(F.col("__clean"))})
        .withColumn("__line_tok", F.transform("__lines", T.tokenize))
    )


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("long"), lambda a, x: a + x)


def _runs(arr: Column) -> Column:
    """(prev, run, best, multi, spread) over a sorted array: longest run, how
    many values occur more than once, and how many items those make up."""
    start = F.struct(F.lit("").alias("prev"), *[F.lit(0).cast("long").alias(k) for k in ("run", "best", "multi", "spread")])

    def step(a: Column, x: Column) -> Column:
        same = (a["run"] > 0) & (a["prev"] == x)
        run = F.when(same, a["run"] + 1).otherwise(1).cast("long")
        return F.struct(
            x.alias("prev"), run.alias("run"), F.greatest(a["best"], run).alias("best"),
            (a["multi"] + F.when(run == 2, 1).otherwise(0)).alias("multi"),
            (a["spread"] + F.when(run == 2, 2).when(run > 2, 1).otherwise(0)).alias("spread"),
        )

    return F.aggregate(F.array_sort(arr), start, step)


def feature_columns(pronouns: dict[str, list[str]] | None = None, semantic: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """Expressions over ``prepared`` columns, in output order. The word lists
    are parameters; the fixed ones are the default."""
    pronouns = pronouns or {k: lexicons.normalise(v) for k, v in lexicons.PRONOUNS.items()}
    semantic = semantic or {k: lexicons.normalise(v) for k, v in lexicons.SEMANTIC.items()}
    clean, tok, lines = F.col("__clean"), F.col("__tok"), F.col("__lines")
    n, u = F.size(tok).cast("long"), F.size(F.array_distinct(tok)).cast("long")
    c, m, mu = F.length(clean).cast("long"), F.size(lines).cast("long"), F.size(F.array_distinct(lines)).cast("long")
    wpl = F.array_sort(F.transform("__line_tok", lambda t: F.size(t).cast("long")))
    half = (F.size(wpl) / 2).cast("int")
    middle = F.when(F.size(wpl) == 0, 0.0).when(F.size(wpl) % 2 == 1, F.try_element_at(wpl, half + 1).cast("double")).otherwise((F.try_element_at(wpl, half) + F.try_element_at(wpl, half + 1)) / 2.0)
    count = lambda chars: T.count_chars(clean, T.char_class(chars))
    out: dict[str, Column] = {
        "word_count": n, "unique_word_count": u, "char_count": c, "line_count": m,
        "avg_words_per_line": T.safe_divide(_total(wpl), m), "median_words_per_line": middle,
        "max_words_per_line": F.coalesce(F.array_max(wpl), F.lit(0)).cast("long"), "min_words_per_line": F.coalesce(F.array_min(wpl), F.lit(0)).cast("long"),
        "avg_word_length": T.safe_divide(_total(F.transform(tok, lambda t: F.length(t).cast("long"))), n),
        "lexical_diversity": T.safe_divide(u, n), "repetition_ratio": T.safe_divide(n - u, n),
        "punctuation_count": count(T.PUNCTUATION), "punctuation_ratio": T.safe_divide(count(T.PUNCTUATION), c),
        "question_mark_count": count("?"), "exclamation_mark_count": count("!"), "comma_count": count(","),
        "quote_count": count(T.QUOTES), "parenthesis_count": count(T.BRACKETS), "digit_count": T.count_chars(clean, r"\p{Nd}"),
        "english_char_count": T.count_chars(clean, "[A-Za-z]"), "english_char_ratio": T.safe_divide(T.count_chars(clean, "[A-Za-z]"), c),
    }
    lr, wr = F.col("__line_runs"), F.col("__word_runs")
    out |= {
        "repeated_lines_count": m - mu, "repeated_lines_ratio": T.safe_divide(m - mu, m), "unique_lines_count": mu,
        "most_repeated_line_count": lr["best"], "chorus_repetition_score": T.safe_divide(lr["spread"], m),
        "repeated_words_count": wr["multi"], "repeated_words_ratio": T.safe_divide(wr["multi"], u),
        "most_common_word_count": wr["best"], "most_common_word_ratio": T.safe_divide(wr["best"], n),
    }
    person = {k: T.count_in(tok, w) for k, w in pronouns.items()}
    for k, v in person.items():
        out |= {f"{k}_count": v, f"{k}_ratio": T.safe_divide(v, n)}
    i, we, you, they = (person[k] for k in lexicons.PRONOUNS)
    out |= {"we_vs_i_ratio": T.safe_divide(we, F.greatest(i, F.lit(1))), "direct_address_score": T.safe_divide(you, i + we + you + they)}
    out |= {k: T.safe_divide(T.count_in(tok, w), n) for k, w in semantic.items()}
    last = F.transform(F.filter("__line_tok", lambda t: F.size(t) > 0), lambda t: F.element_at(t, -1))
    k, ku = F.size(last).cast("long"), F.size(F.array_distinct(last)).cast("long")
    out |= {"last_word_unique_count": ku, "last_word_repetition_ratio": T.safe_divide(k - ku, k), "avg_last_word_length": T.safe_divide(_total(F.transform(last, lambda t: F.length(t).cast("long"))), k)}
    return out


#: Documents that are Python objects at a time.
SLICE = 256
_LETTERS = re.compile("[A-Za-z]+")
_SPACE = re.compile(T.SPACES + "+")


def _type(name: str) -> Y.DataType:
    return Y.LongType() if name.endswith("_count") or name in ("max_words_per_line", "min_words_per_line") else Y.DoubleType()


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def _longer(counts: Counter) -> tuple[int, int, int]:
    """The greatest count, how many exceed 1, and their sum."""
    more = [c for c in counts.values() if c > 1]
    return (max(more) if more else min(len(counts), 1)), len(more), sum(more)


def _lines(clean: str) -> list[str]:
    if clean.isascii() and not any(c in clean for c in "\x1c\x1d\x1e\x1f"):
        found = (" ".join(x.split()) for x in clean.split("\n"))
    else:
        found = (_SPACE.sub(" ", x).strip(" ") for x in clean.split("\n"))
    return [x for x in found if x]


def measurer(wanted: list[str], pronouns: dict[str, list[str]], semantic: dict[str, list[str]]) -> Callable[[str | None], list]:
    """A function from a text to its wanted features, the same as
    ``feature_columns``; parts that nothing wanted needs are not counted."""
    need = set(wanted)
    by_line = bool(need & {"avg_words_per_line", "median_words_per_line", "max_words_per_line", "min_words_per_line", *LAST_WORDS})
    chars, letters = need & {*PUNCTUATION} - {"english_char_count", "english_char_ratio"}, need & {"english_char_count", "english_char_ratio"}
    token = T.python_class(T.TOKEN)
    sets = {k: set(w) for k, w in pronouns.items()}, {k: set(w) for k, w in semantic.items()}
    i, we, you, they = lexicons.PRONOUNS

    def measure(text: str | None) -> list:
        clean = T.clean_text(text)
        lines, c = _lines(clean), len(clean)
        if by_line:
            each = [[t.lower() for t in token.findall(x)] for x in lines]
            tok = [t for x in each for t in x]
        else:
            each, tok = [], token.findall(clean.lower()) if clean.isascii() else [t.lower() for t in token.findall(clean)]
        words, kinds = Counter(tok), Counter(lines)
        n, u, m, mu = len(tok), len(words), len(lines), len(kinds)
        best, multi, _spread = _longer(words)
        lbest, _multi, lspread = _longer(kinds)
        f = {
            "word_count": n, "unique_word_count": u, "char_count": c, "line_count": m, "avg_word_length": _ratio(sum(map(len, tok)), n),
            "lexical_diversity": _ratio(u, n), "repetition_ratio": _ratio(n - u, n),
            "repeated_lines_count": m - mu, "repeated_lines_ratio": _ratio(m - mu, m), "unique_lines_count": mu, "most_repeated_line_count": lbest, "chorus_repetition_score": _ratio(lspread, m),
            "repeated_words_count": multi, "repeated_words_ratio": _ratio(multi, u), "most_common_word_count": best, "most_common_word_ratio": _ratio(best, n),
        }
        if by_line:
            wpl, half = sorted(map(len, each)), m // 2
            last = [x[-1] for x in each if x]
            k, ku = len(last), len(set(last))
            f |= {
                "avg_words_per_line": _ratio(n, m), "median_words_per_line": 0.0 if not m else float(wpl[half]) if m % 2 else (wpl[half - 1] + wpl[half]) / 2.0,
                "max_words_per_line": wpl[-1] if m else 0, "min_words_per_line": wpl[0] if m else 0,
                "last_word_unique_count": ku, "last_word_repetition_ratio": _ratio(k - ku, k), "avg_last_word_length": _ratio(sum(map(len, last)), k),
            }
        if chars:
            count = lambda of: sum(map(clean.count, of))
            marks = count(T.PUNCTUATION)
            digits = count("0123456789") + (0 if clean.isascii() else sum(x.isdecimal() for x in T._RARE.findall(clean)))
            f |= {"punctuation_count": marks, "punctuation_ratio": _ratio(marks, c), "question_mark_count": count("?"), "exclamation_mark_count": count("!"), "comma_count": count(","), "quote_count": count(T.QUOTES), "parenthesis_count": count(T.BRACKETS), "digit_count": digits}
        if letters:
            v = sum(map(len, _LETTERS.findall(clean)))
            f |= {"english_char_count": v, "english_char_ratio": _ratio(v, c)}
        person = {k: sum(words[w] for w in ws) for k, ws in sets[0].items()}
        for k, v in person.items():
            f[f"{k}_count"], f[f"{k}_ratio"] = v, _ratio(v, n)
        f["we_vs_i_ratio"], f["direct_address_score"] = person[we] / max(person[i], 1), _ratio(person[you], person[i] + person[we] + person[you] + person[they])
        for k, ws in sets[1].items():
            f[k] = _ratio(sum(words[w] for w in ws), n)
        return [f[x] for x in wanted]

    return measure


def by_text(docs: DataFrame, keys: list[str], body: str, types: dict[str, Y.DataType], make: Callable[[], Callable[[str | None], list]]) -> DataFrame:
    """``keys`` and the values that a function gives for each text; a task makes
    its function once."""
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [docs.schema[k] for k in keys]
    kinds = [(n, to_arrow_type(t)) for n, t in types.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = make()
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                columns = list(zip(*map(measure, part.column(len(keys)).to_pylist())))
                values = [pa.array(x, t) for x, (_n, t) in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *values], names=[*keys, *types])

    return docs.select(*keys, F.col(body).alias("__text")).mapInArrow(run, Y.StructType([*fields, *[Y.StructField(n, t) for n, t in types.items()]]))


def document_features(docs: DataFrame, keys: list[str], body: str = "text", only: list[str] | None = None, pronouns: dict[str, list[str]] | None = None, semantic: dict[str, list[str]] | None = None) -> DataFrame:
    """``keys`` and the features (all 55, or ``only`` some). Null text is
    empty; empty text has all features 0."""
    pronouns = pronouns or {k: lexicons.normalise(v) for k, v in lexicons.PRONOUNS.items()}
    semantic = semantic or {k: lexicons.normalise(v) for k, v in lexicons.SEMANTIC.items()}
    wanted = only or FEATURES
    return by_text(docs, keys, body, {c: _type(c) for c in wanted}, lambda: measurer(wanted, pronouns, semantic))


def cohort_features(docs: DataFrame, keys: list[str], body: str = "text", pattern: str = T.SCRIPT_WORD, pronouns: dict[str, list[str]] | None = None) -> DataFrame:
    """The exploration variant: script words as they are, all lines counted,
    merged pronoun lists; missing text reads as nan."""
    pronouns = pronouns or lexicons.COHORT_PRONOUNS
    names = ["word_count", "unique_word_count", "lexical_diversity", "line_count", "avg_line_length", "repetition_ratio", *[f"{k}_{x}" for k in pronouns for x in ("count", "ratio")]]

    def make() -> Callable[[str | None], list]:
        word, breaks, sets = T.finder(pattern), re.compile(T.BREAKS), [set(w) for w in pronouns.values()]

        def measure(text: str | None) -> list:
            text = "nan" if text is None else text
            words = Counter(word(text))
            n, u, m = words.total(), len(words), len(breaks.findall(text)) + (not T.ends_line(text)) if text else 0
            out = [n, u, _ratio(u, n), m, _ratio(n, m), 0.0 if n == 0 else 1 - _ratio(u, n)]
            for ws in sets:
                v = sum(words[w] for w in ws)
                out += [v, _ratio(v, n)]
            return out

        return measure

    return by_text(docs, keys, body, {c: _type(c) for c in names}, make)


def table_summary(features: DataFrame, label: str) -> DataFrame:
    """Rows and missing values per column, and rows per class, as a long
    table (what, name, n): one aggregation and one grouped count."""
    cols = features.columns
    missing = [F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in cols]
    wide = features.agg(F.count("*").alias("__rows"), *missing)
    entries = F.array(F.struct(F.lit("rows").alias("what"), F.lit("rows").alias("name"), F.col("__rows").alias("n")), *[F.struct(F.lit("missing").alias("what"), F.lit(c).alias("name"), F.col(c).alias("n")) for c in cols])
    by = features.groupBy(F.lit("class").alias("what"), F.col(label).cast("string").alias("name")).agg(F.count("*").alias("n"))
    return wide.select(F.inline(entries)).unionByName(by)
