"""Hand-made inputs with hand-derived results, and every SQL pair on sf0.001."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lexora import lexicons
from lexora.functions import text as T
from lexora.operators import annotations as A
from lexora.operators import experiments as E
from lexora.operators import features as D
from lexora.operators import learning as L
from lexora.operators import profiling as P
from lexora.operators import relational as R
from lexora.plans import queries as Q
from lexora.session import ship_package
from lexora.sources import tables as S

SMALL = "/root/testdata/sf0.001"
SONG = "אני אוהב אותך\nאני אוהב אותך\nYeah!"


def one(spark, expr, value):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(expr(F.col("v"))).first()[0]


def test_features_of_one_document(spark):
    ship_package(spark)
    rows = [(0, SONG), (1, None), (2, ""), (3, "...\nword"), (4, "a\r\nb\rc"), (5, "שָׁלוֹם…\xa0it's א\"ב a1b")]
    got = {r.doc_id: r for r in D.document_features(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    want = {
        "word_count": 7, "unique_word_count": 4, "char_count": 33, "line_count": 3, "unique_lines_count": 2, "avg_words_per_line": 7 / 3, "median_words_per_line": 3.0,
        "max_words_per_line": 3, "min_words_per_line": 1, "avg_word_length": 26 / 7, "lexical_diversity": 4 / 7, "repetition_ratio": 3 / 7, "repeated_lines_count": 1,
        "repeated_lines_ratio": 1 / 3, "most_repeated_line_count": 2, "chorus_repetition_score": 2 / 3, "repeated_words_count": 3, "repeated_words_ratio": 3 / 4,
        "most_common_word_count": 2, "most_common_word_ratio": 2 / 7, "first_person_singular_count": 2, "second_person_count": 2, "direct_address_score": 0.5, "we_vs_i_ratio": 0.0,
        "love_words_ratio": 2 / 7, "last_word_unique_count": 2, "last_word_repetition_ratio": 1 / 3, "avg_last_word_length": 4.0, "punctuation_count": 1, "exclamation_mark_count": 1,
        "english_char_count": 4, "english_char_ratio": 4 / 33,
    }
    for k, v in want.items():
        assert got[0][k] == pytest.approx(v), k
    assert len(D.FEATURES) == 55 and list(got[0].asDict())[1:] == list(D.feature_columns())
    assert all(got[i][c] == 0 for i in (1, 2) for c in D.FEATURES)
    assert (got[3].min_words_per_line, got[3].line_count) == (0, 2) and got[4].line_count == 3
    assert got[5].punctuation_count == 5 and got[5].word_count == 5  # three dots, two inner quotes


def test_text_functions(spark):
    ship_package(spark)
    assert one(spark, T.match_key, "שיר־יפה") == "שיריפה" and one(spark, T.match_key, "It’s / OK") == "it's ok" and one(spark, T.match_key, None) == ""
    assert one(spark, T.normalize_label, " The 80s ") == "1980s" and one(spark, T.normalize_label, None) == ""
    with pytest.raises(Exception, match="unknown label"):
        one(spark, T.normalize_label, "1970s")
    assert [one(spark, T.parse_float, v) for v in ("1_0", " 2.5e1 ", "1d", "", None)] == [10.0, 25.0, None, None, None]
    assert one(spark, T.split_lines_count, "a\n\nb\n") == 3 and one(spark, T.split_lines_count, "") == 0
    assert one(spark, lambda c: T.terms(c, 2), "a Bc de f gh") == ["bc", "de", "gh", "bc de", "de gh"] and one(spark, lambda c: T.terms(c, 2), "solo") == ["solo"]
    pairs = one(spark, T.parse_feats, "A=x,y|B|A=x|C=_|D=1=2")
    assert {(p.key, p.value) for p in pairs} == {("A", "x"), ("A", "y"), ("D", "1=2")}
    assert len(lexicons.SEMANTIC) == 12 and lexicons.normalise(["אֲנִי", "a b"]) == ["a", "b", "אני"]


ANNOTATED = """1\tpre\tpre\tNOUN\t_\t_
# text = ### S1
1\tt\tt\tNOUN\t_\t_

# text = / Art
1\tt2\tt2\tNOUN\t_\t_

# text = x
1-2\tab\t_\t_\t_\t_
1\ta\ta\tVERB\tVERB\tTense=Past|Gender=Fem,Masc
2\tb\t_\tX\tX\t_

# text = / NotArtist
1\tc\tc\tNOUN\t_\t_
# text = ### S2 / B/C

1\ttt\ttt\tNOUN\t_\t_

3.1\te\te\tNOUN\t_\t_
1\td\td\tPUNCT\t_\t_
"""


def test_annotation_parser(spark, tmp_path):
    (tmp_path / "a.txt").write_text(ANNOTATED, encoding="utf-8")
    lines = S.read_lines(spark, {"2020s": [str(tmp_path / "a.txt")]})
    c = A.classify_lines(lines)
    want = {"song_title_lines": 2, "artist_continuation_lines": 1, "token_rows_before_first_song": 1, "title_sentence_token_rows_skipped": 3, "multi_token_rows_skipped": 1, "decimal_token_rows_skipped": 1, "non_integer_token_rows_skipped": 0, "short_token_rows": 0, "processed_token_rows": 4, "songs_parsed": 2}
    got = A.parse_counters(c).first().asDict()
    assert {k: got[k] for k in want} == want
    assert [(r.song_name, r.artist_name, r.source_line) for r in A.songs(c).orderBy("song").collect()] == [("S1", "Art", 2), ("S2", "B/C", 15)]
    f = {r.song: r for r in A.song_features(A.tokens(c), ["file", "song"]).collect()}
    assert [f[1][k] for k in ("dicta_token_count", "dicta_non_punct_token_count", "dicta_content_token_count", "tense_past_count", "masculine_count", "feminine_count", "dicta_unknown_token_count", "dicta_x_pos_count", "lemma_count")] == [3, 3, 2, 1, 1, 1, 1, 1, 2]
    assert f[1].tense_past_ratio == 1 and f[2].dicta_token_count == 1 and f[2].dicta_non_punct_token_count == 0 and f[2].lemma_diversity == 0
    assert len(A.song_features(A.tokens(c), ["file", "song"]).columns) == 2 + 79


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write('song_name,artist_name,decade,lyrics\na,b,1980s,"x ""q""\ny"\n')
    assert tuple(S.read_corpus(spark, path).first()) == ("a", "b", "1980s", 'x "q"\ny')
    with pytest.raises(ValueError):
        S.read_corpus(spark, path, ["song_name"])
    df = spark.createDataFrame([("m", 0.5), ("n", 0.7)], "model string, Accuracy double")
    S.write_csv(df, str(tmp_path / "r"))
    assert S.old_best(spark, str(tmp_path / "r")).first().model == "n" and S.old_best(spark, str(tmp_path / "none")) is None
    assert S.read_feature_table(spark, str(tmp_path / "r")).columns == ["model", "Accuracy"]
    S.write_json(spark, {"שם": df, "rows": df.agg(F.count("*").alias("n")), "list": [1]}, str(tmp_path / "j"))
    said = "\n".join(r.value for r in spark.read.text(str(tmp_path / "j"), wholetext=True).collect())
    assert json.loads(said) == {"שם": [{"model": "m", "Accuracy": 0.5}, {"model": "n", "Accuracy": 0.7}], "rows": 2, "list": [1]} and "שם" in said and '\n  "rows": 2' in said
    plot = S.plot_rows(spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("c", "x", 3.0)], "feature string, cohort string, mean double"), ["c", "a"])
    assert [r.feature for r in plot.collect()] == ["c", "a"]
    parts = R.cohort_text_lines(spark.createDataFrame([("x", 1, "au", "b")], "c string, t int, a string, b string"), "c", "t", "a", "b", ["t"])
    S.write_cohort_texts(parts, "c", str(tmp_path / "t"))
    assert "### 1 / au" in [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]


def test_checks_and_properties(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 5), (None, 6)], "k int, w int")
    assert {r.w for r in R.one_to_one(a, b, ["k"]).collect()} == {5, 6}
    with pytest.raises(Exception, match="keys repeat"):
        R.one_to_one(a, b.union(b), ["k"]).collect()
    f = Q.profiled(spark, SMALL)
    long = P.melt(f, Q.PROFILED, "lang")
    for r in P.eta_squared(long, Q.COHORTS).collect():
        assert 0 <= r.eta_squared <= 1
    neg = f.withColumn("minus", -F.col("word_count")).withColumn("flat", F.lit(1.0))
    got = {(r.f1, r.f2): r.corr for r in P.correlations(neg, ["word_count", "minus", "flat"]).collect()}
    assert got["word_count", "minus"] == pytest.approx(-1) and got["word_count", "flat"] is None
    folds = Q.QUERIES["stratified_folds"](spark, SMALL).groupBy("lang", "fold").count().toPandas()
    assert folds.groupby("lang")["count"].agg(lambda x: x.max() - x.min()).max() <= 1
    assert P.cohort_order(["z", "2000s", "1980s"], ["1980s", "2000s", "2020s"]) == ["1980s", "2000s", "z"]
    assert R.ordered(spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "s double"), "s").first().s == 1.0


def test_stream_equals_batch(spark, tmp_path):
    from lexora.streaming.features import stream_features

    docs = S.table(spark, SMALL, "documents").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    stream = stream_features(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), ["doc_id"], only=["word_count"])
    q = stream.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in D.document_features(docs, ["doc_id"], only=["word_count"]).collect()}
    assert {tuple(r) for r in spark.table("streamed").collect()} == want


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_sql(spark, duck, name):
    ship_package(spark)
    got, want = Q.QUERIES[name](spark, SMALL).toPandas(), duck.sql(Q.ORACLE[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    text = lambda df: sorted(map(tuple, df[cols].astype(str).to_numpy().tolist()))
    assert text(got) == text(want)
    assert L.SEED == 42


def test_text_folds_fit_their_own_terms_and_keep_all_documents(spark, tmp_path):

    rows = [(i, ("en", "fr")[i % 2], f"own{i} shared") for i in range(18)] + [(18, "en", ""), (19, "fr", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = spark.read.parquet(f"{tmp_path}/documents.parquet")
    keys = found.select("doc_id", "lang").transform(L.with_fold, "doc_id", "lang", 3)
    for k, f in enumerate(E.text_frames(found, keys, 1, E.Settings(folds=3, terms=500))):
        got = {r.doc_id: r for r in f.collect()}
        assert sorted(got) == list(range(20))
        for i, r in got.items():  # a held-out document's own term is not known
            assert r.features.numNonzeros() == (0 if i >= 18 else 1 if r.fold == k else 2)


def plain_parser(lines):
    """The parser as a loop: (song, is kept) for each line of a file."""
    import re

    song, armed, rows, open_ = 0, False, 0, False
    out = []
    for line in lines:
        s = line.strip()
        title, again = re.match(r"^#\s*text\s*=\s*###\s*(.+?)\s*$", s), re.match(r"^#\s*text\s*=\s*/\s*(.+?)\s*$", s)
        kept = False
        if title:
            song, armed, rows, open_ = song + 1, "/" not in title[1], 0, False
        elif again and song and armed:
            armed, rows, open_ = False, 0, False
        elif line.startswith("#"):
            pass
        elif not s:
            open_ = open_ or rows > 0
        else:
            rows += 1
            kept = song > 0 and open_ and re.fullmatch("[0-9]+", line.split("\t")[0].strip()) is not None
        out.append((song, kept))
    return out


@pytest.mark.parametrize("size", [100_000, 7])
def test_parser_states_by_a_loop(spark, size, monkeypatch):
    import random

    monkeypatch.setattr(A, "RANGE", size)
    rnd = random.Random(4)
    kinds = ["# text = ### T", "# text = ### T / A", "# text = / B", "#text=###U", "# text = ###", "# note", "", "  ", "1\tw\tw\tNOUN\t_\tGender=Masc", "2\tv\tv\tVERB", "3-4\tx", "5.1\ty", "q\tz", "text ### T"]
    files = {f: [rnd.choice(kinds) for _ in range(120)] for f in ("a", "b", "c")}
    rows = [(f, i + 1, x) for f, xs in files.items() for i, x in enumerate(xs)]
    got = {(r.file, r.ln): (r.song, r.kind == "processed_token_rows") for r in A.classify_lines(spark.createDataFrame(rows, "file string, ln long, line string")).collect()}
    assert got == {(f, i + 1): v for f, xs in files.items() for i, v in enumerate(plain_parser(xs))}


def test_experiment_parts(spark):
    rows = [(i, "xy"[i % 2], float(i % 2) + (i % 5) / 10, 0.0, None if i % 7 == 0 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, word_count double, char_count double, digit_count double")
    df = L.with_fold(df, "doc_id", "lang", 3)
    columns = ["word_count", "char_count", "digit_count"]
    assert E.usable_columns(df, columns) == ["word_count", "digit_count"]
    assert E.feature_groups(columns)["reduced_non_redundant"] == ["word_count", "digit_count"] and "dicta_pos" not in E.feature_groups(columns)
    frames = E.scaled_frames(df, ["word_count"], 3, "v")
    train = [r.word_count for r in frames[1].where("fold <> 1").collect()]
    assert abs(sum(train)) < 1e-9 and abs(sum(x * x for x in train) / len(train) - 1) < 1e-9
    grid = E.numeric_grid(df, columns, "lang", "doc_id", E.Settings(folds=3, groups=("basic_surface",), models=("Majority Baseline", "Stratified Random Baseline", "Logistic Regression"))).collect()
    assert {(r.model, r.n_features) for r in grid} == {(m, 1) for m in ("Majority Baseline", "Stratified Random Baseline", "Logistic Regression")}
    assert next(r.accuracy for r in grid if r.model == "Logistic Regression") == 1.0
