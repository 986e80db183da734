"""Morphological annotations: a windowed parser of numbered lines, features per
song and tables per cohort.

``lines(file, ln, line)`` holds numbered lines. The parser's states are reset at
each title, so only the number of titles so far needs the whole file: titles are
counted per ``RANGE`` lines, and the rest are running counts within a song, over
one sort that they share. A file is thus read by many tasks. Where songs arrive
whole, ``blocks`` parses them without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexora.functions.text import match_key, parse_feats, safe_divide

#: Fixed values of the tag sets and feature names.
CONTENT = ["NOUN", "VERB", "ADJ", "ADV", "PROPN"]
VERBAL = ["VERB", "AUX"]
POS = ["NOUN", "VERB", "ADJ", "ADV", "PRON", "PROPN", "ADP", "DET", "CCONJ", "SCONJ", "AUX", "NUM", "INTJ"]
BINYAN = {"paal": "PAAL", "piel": "PIEL", "hifil": "HIFIL", "hitpael": "HITPAEL", "nifal": "NIFAL", "pual": "PUAL", "hufal": "HUFAL"}
TENSE = {"tense_past": ("Tense", "Past"), "tense_present": ("Tense", "Pres"), "tense_future": ("Tense", "Fut"), "verb_inf": ("VerbForm", "Inf"), "verb_participle": ("VerbForm", "Part"), "imperative": ("Mood", "Imp")}
NOMINAL = {"masculine": ("Gender", "Masc"), "feminine": ("Gender", "Fem"), "singular": ("Number", "Sing"), "plural": ("Number", "Plur"), "first_person_morph": ("Person", "1"), "second_person_morph": ("Person", "2"), "third_person_morph": ("Person", "3")}
#: Counted features by what their ratio is to: tokens but punctuation, verbs.
OVER_NP = [*[f"pos_{p.lower()}" for p in POS], *NOMINAL, "dicta_unknown_token", "dicta_x_pos"]
OVER_VL = [*TENSE, *[f"binyan_{k}" for k in BINYAN]]
NO_TOKEN = ["PUNCT", "X", "_"]
SUMMARY_POS = [*POS, "PART"]
SELECTED = ["Person=1", "Person=2", "Person=3", "Tense=Past", "Tense=Pres", "Tense=Fut", "Number=Sing", "Number=Plur", "Number=Dual", "Gender=Masc", "Gender=Fem", "Voice=Act", "Voice=Mid", "Voice=Pass", "VerbForm=Inf", "VerbForm=Part", "Mood=Imp"]
COUNTERS = ["song_title_lines", "artist_continuation_lines", "token_rows_before_first_song", "title_sentence_token_rows_skipped", "multi_token_rows_skipped", "decimal_token_rows_skipped", "non_integer_token_rows_skipped", "short_token_rows", "processed_token_rows", "songs_parsed"]

#: Fixed patterns of the two kinds of heading lines.
_TITLE = r"^#\s*text\s*=\s*###\s*(.+?)\s*$"
_ARTIST = r"^#\s*text\s*=\s*/\s*(.+?)\s*$"

RANGE = 100_000
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: filters and later
    projections see a generator's output and do not repeat the expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def title_parts(payload: Column) -> tuple[Column, Column]:
    """Title and artist, cut at the last " / ", else the last "/"."""
    wide, slim = r"(?s)^(.*) / (.*)$", r"(?s)^(.*)/(.*)$"
    pick = lambda g, last: F.when(payload.rlike(wide), F.regexp_extract(payload, wide, g)).when(payload.contains("/"), F.regexp_extract(payload, slim, g)).otherwise(last)
    return _strip(pick(1, payload)), _strip(pick(2, F.lit("")))


def classify_lines(lines: DataFrame) -> DataFrame:
    """Lines with song number, kind and whether a token row is kept."""
    s = F.col("s")
    note = F.col("line").startswith("#")
    d = once(lines, s=_strip(F.col("line")))
    d = once(d, t=F.when(s.startswith("#"), F.regexp_extract(s, _TITLE, 1)).otherwise(""), again=F.when(s.startswith("#"), F.regexp_extract(s, _ARTIST, 1)).otherwise(""))
    title, artist = (F.when(F.col("t") != "", x).otherwise("") for x in title_parts(F.col("t")))
    d = once(d.withColumns({"is_title": F.col("t") != "", "range": F.floor(F.col("ln") / RANGE)}), title=title, artist=artist).drop("t")
    # titles before a range of lines: one row for each range of a file
    heads = once(lines.where(F.col("line").contains("#")).select("file", F.floor(F.col("ln") / RANGE).alias("range"), _strip(F.col("line")).alias("s")), t=F.regexp_extract("s", _TITLE, 1))
    heads = heads.where("t <> ''").groupBy("file", "range").agg(F.count("*").alias("titles"))
    ranges = d.select("file", "range").distinct().join(heads, ["file", "range"], "left").fillna(0, ["titles"])
    ranges = ranges.withColumn("base", F.sum("titles").over(Window.partitionBy("file").orderBy("range")) - F.col("titles")).drop("titles")
    upto = lambda w: w.orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("song", F.sum(F.col("is_title").cast("int")).over(upto(Window.partitionBy("file", "range"))))
    d = d.join(ranges, ["file", "range"]).withColumn("song", F.col("song") + F.col("base")).drop("range", "base")
    run = upto(Window.partitionBy("file", "song"))
    since = lambda c, mark: F.col(c) - F.coalesce(F.last(F.when(mark, F.col(c)), ignorenulls=True).over(run), F.lit(0))
    maybe = ~F.col("is_title") & (F.col("again") != "") & (F.col("song") > 0) & (F.first("artist").over(run) == "")
    d = d.withColumn("maybe", maybe).withColumn("nth", F.sum(F.col("maybe").cast("int")).over(run))
    d = d.withColumn("is_artist", F.col("maybe") & (F.col("nth") == 1))
    # token rows and blank lines since the last heading line
    heading = F.col("is_title") | F.col("is_artist")
    d = d.withColumn("blank", s == "").withColumn("token_row", ~heading & ~note & (s != ""))
    d = d.withColumn("rows", F.sum(F.col("token_row").cast("int")).over(run))
    d = d.withColumn("closes", F.col("blank") & (since("rows", heading) > 0)).withColumn("closed", F.sum(F.col("closes").cast("int")).over(run))
    d = d.withColumn("open", since("closed", heading) > 0).drop("maybe", "nth", "rows", "closes", "closed")
    d = once(once(d, f=F.split("line", "\t")), id=F.trim(F.col("f")[0]))
    kind = (
        F.when(F.col("is_title"), "song_title_lines").when(F.col("is_artist"), "artist_continuation_lines").when(~F.col("token_row"), "other")
        .when(F.col("song") == 0, "token_rows_before_first_song").when(~F.col("open"), "title_sentence_token_rows_skipped")
        .when(F.col("id").contains("-"), "multi_token_rows_skipped").when(F.col("id").contains("."), "decimal_token_rows_skipped")
        .when(~F.col("id").rlike("^[0-9]+$"), "non_integer_token_rows_skipped").otherwise("processed_token_rows")
    )
    return d.withColumn("kind", kind)


def parse_counters(classified: DataFrame) -> DataFrame:
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    short = F.count_if((F.col("kind") == "processed_token_rows") & (F.size("f") < 6)).alias("short_token_rows")
    songs = F.count_if(F.col("is_title")).alias("songs_parsed")
    return classified.groupBy("file").agg(*[short if k == "short_token_rows" else songs if k == "songs_parsed" else count(k) for k in COUNTERS])


def songs(classified: DataFrame) -> DataFrame:
    """(file, song, song_name, artist_name, source_line), songs without tokens
    included."""
    return classified.where("song > 0").groupBy("file", "song").agg(
        F.max(F.when(F.col("is_title"), F.col("title"))).alias("song_name"),
        F.coalesce(F.nullif(F.max(F.when(F.col("is_title"), F.col("artist"))), F.lit("")), F.max(F.when(F.col("is_artist"), F.col("again"))), F.lit("")).alias("artist_name"),
        F.min("ln").alias("source_line"),
    )


def tokens(classified: DataFrame) -> DataFrame:
    """Kept token rows with their fields and parsed features."""
    get = lambda i: F.coalesce(F.get("f", F.lit(i)), F.lit(""))
    d = classified.where("kind = 'processed_token_rows'").select("file", "song", "ln", get(1).alias("form"), get(2).alias("lemma"), F.upper(get(3)).alias("upos"), F.upper(get(4)).alias("xpos"), get(5).alias("raw"))
    d = once(d, feats=parse_feats(F.col("raw")))
    note = F.exists("feats", lambda p: (p["key"] == "DictaNote") & (p["value"] == "Unknown"))
    bare = F.trim("lemma").isin("", "_") & ~F.col("upos").isin("PUNCT", "")
    return d.withColumn("is_unknown", (F.col("upos") == "X") | (F.col("xpos") == "X") | note | bare)


def _has(key: str, value: str) -> Column:
    """By the pairs of ``_said``; a key has no "=" and neither part a "|"."""
    return F.contains(F.col("__said"), F.lit(f"|{key}={value}|"))


def _said(feats: str) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.transform(feats, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "|"), F.lit("|"))


def song_features(toks: DataFrame, by: list[str]) -> DataFrame:
    """The 79 morphology features, in one aggregation by ``by``."""
    np_, vl = F.col("upos") != "PUNCT", F.col("upos").isin(*VERBAL)
    known = np_ & ~F.col("is_unknown") & (F.col("upos") != "X")
    lemma = F.when(known, F.nullif(match_key(F.col("lemma")), F.lit("")))
    roots = F.when(known, F.filter(F.transform(F.filter("feats", lambda p: p["key"] == "HebRoot"), lambda p: p["value"]), lambda r: r != ""))
    d = once(toks, __lemma=lemma, __roots=roots, __said=_said("feats"))
    aggs: dict[str, Column] = {"dicta_token_count": F.count("*"), "dicta_non_punct_token_count": F.count_if(np_), "__vl": F.count_if(vl), "dicta_content_token_count": F.count_if(F.col("upos").isin(*CONTENT))}
    over_np = {f"pos_{p.lower()}": F.col("upos") == p for p in POS} | {k: np_ & _has(*v) for k, v in NOMINAL.items()} | {"dicta_unknown_token": np_ & F.col("is_unknown"), "dicta_x_pos": F.col("upos") == "X"}
    over_vl = {k: vl & _has(*v) for k, v in TENSE.items()} | {f"binyan_{k}": vl & _has("HebBinyan", v) for k, v in BINYAN.items()}
    aggs |= {f"{k}_count": F.count_if(c) for k, c in {**over_np, **over_vl}.items()}
    aggs |= {"lemma_count": F.count("__lemma"), "unique_lemma_count": F.count_distinct("__lemma")}
    g = d.groupBy(*by).agg(*[c.cast("long").alias(k) for k, c in aggs.items()])
    r = d.where("size(__roots) > 0").select(*by, F.explode("__roots").alias("root")).withColumn("root", match_key(F.col("root"))).where("root <> ''")
    r = r.groupBy(*by).agg(F.count("*").alias("root_count"), F.count_distinct("root").alias("unique_root_count"))
    return with_ratios(g.join(r, by, "left").fillna(0, ["root_count", "unique_root_count"]))


def with_ratios(g: DataFrame) -> DataFrame:
    """Ratios and diversities beside a song's counts; ``__vl`` goes."""
    ratio = {f"{k}_ratio": safe_divide(F.col(f"{k}_count"), F.col("dicta_non_punct_token_count")) for k in OVER_NP}
    ratio |= {f"{k}_ratio": safe_divide(F.col(f"{k}_count"), F.col("__vl")) for k in OVER_VL}
    ratio |= {"lemma_diversity": safe_divide(F.col("unique_lemma_count"), F.col("lemma_count")), "root_diversity": safe_divide(F.col("unique_root_count"), F.col("root_count"))}
    return g.withColumns(ratio).drop("__vl")


# ---- cohort tables: another parser (any line with four fields), other rules


def cohort_tokens(lines: DataFrame, cohort: Column) -> DataFrame:
    d = once(lines.where(~F.col("line").startswith("#")).select(cohort.alias("cohort"), "line"), f=F.split(_strip(F.col("line")), "\t")).where(F.size("f") >= 4)
    d = d.where(~F.col("f")[0].contains("-") & ~F.col("f")[0].contains(".") & ~F.col("f")[3].isin(*NO_TOKEN))
    return d.select("cohort", F.col("f")[1].alias("form"), F.col("f")[2].alias("lemma"), F.col("f")[3].alias("upos"), F.coalesce(F.get("f", F.lit(5)), F.lit("_")).alias("raw"))


def cohort_feats(toks: DataFrame) -> DataFrame:
    """One row per feature string of each token, or of ``n`` equal ones."""
    return toks.where("raw not in ('', '_')").select(*[c for c in toks.columns if c in ("cohort", "n")], F.explode(F.split("raw", "[|]")).alias("feat")).where(F.col("feat").contains("="))


def _counted(df: DataFrame) -> DataFrame:
    """A row may stand for ``n`` equal ones."""
    return df if "n" in df.columns else df.withColumn("n", F.lit(1).cast("long"))


def shares(df: DataFrame, key: str) -> DataFrame:
    """(cohort, key, count, ratio to the cohort's total)."""
    c = _counted(df).groupBy("cohort", key).agg(F.sum("n").alias("count"))
    return c.withColumn("ratio", F.col("count") / F.sum("count").over(Window.partitionBy("cohort")))


def wide_shares(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts and ratios of fixed values side by side; the ratio is to all rows
    of the cohort."""
    one = [F.coalesce(F.sum(F.when(F.col(key) == v, F.col("n"))), F.lit(0)).cast("long").alias(f"{v}_count") for v in values]
    g = _counted(df).groupBy("cohort").agg(F.sum("n").alias("__n"), *one)
    return g.select("cohort", *[c for v in values for c in (F.col(f"{v}_count"), safe_divide(F.col(f"{v}_count"), F.col("__n")).alias(f"{v}_ratio"))])


def top_values(df: DataFrame, key: str, k: int, pool: int | None = None, stop: list[str] | None = None) -> DataFrame:
    """Most frequent values of a cohort with rank; with ``pool`` the stop words
    and one-letter values go after the ``pool`` most frequent were taken."""
    c = _counted(df).groupBy("cohort", key).agg(F.sum("n").alias("count"))
    w = Window.partitionBy("cohort").orderBy(F.desc("count"), key)
    if pool:
        c = c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= pool).drop("r").where((F.length(key) > 1) & ~F.col(key).isin(*(stop or [""])))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
