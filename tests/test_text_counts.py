"""Features counted in workers equal the columns of ``feature_columns``."""

import random

import pytest
from pyspark.sql import functions as F

from lexora.functions import text as T
from lexora.operators import features as D
from lexora.plans import queries as Q
from lexora.session import ship_package

WORDS = ["a", "The", "the", "it's", "א\"ב", "שָׁלוֹם", "É", "ﬁn", "İx", "xKy", "…", "½", "٣", "7", "“q”", "(x)", "?!", ",", " ", "\x1c", "\x85", " ", "\t", "  ", "\n", "\r\n", "\r", "\n\n", "of", "de", "\U0001f600"]


def columns(df, only):
    """As features were made before: columns in the JVM."""
    staged = D.prepared(df).withColumns({"__line_runs": D._runs(F.col("__lines")), "__word_runs": D._runs(F.col("__tok"))})
    return staged.select("doc_id", *[c.alias(k) for k, c in D.feature_columns(Q.PRONOUNS, Q.SEMANTIC).items() if k in only])


@pytest.mark.parametrize("only", [D.FEATURES, Q.PROFILED, D.LAST_WORDS])
def test_features_equal_columns(spark, only):
    ship_package(spark)
    rnd = random.Random(3)
    texts = [None, "", " ", "\n", "a\n\n"] + [" ".join(rnd.choices(WORDS, k=rnd.choice([1, 5, 40]))) for _ in range(300)] + ["".join(rnd.choices(WORDS, k=12)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = D.document_features(df, ["doc_id"], only=only, pronouns=Q.PRONOUNS, semantic=Q.SEMANTIC)
    want = columns(df, only).select(got.columns)
    assert got.dtypes == want.dtypes
    assert sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan and "aggregate(" not in plan  # interpreted for each token


def test_cohort_lines_as_splitlines(spark):
    ship_package(spark)
    texts = ["", "a", "a\n\n", "a\r\n\r\nb\x0bc ", "\n", "é½² x"]
    got = {r.doc_id: r for r in D.cohort_features(spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string"), ["doc_id"], pattern=r"\p{L}+").collect()}
    assert all(got[i].line_count == len(x.splitlines()) for i, x in enumerate(texts))
    assert (got[5].word_count, got[9].word_count) == (2, 1)
    assert T.python_class(r"[\p{L}\p{N}_]{2,}").findall("é½ a_1 b") == ["é½", "a_1"]


def test_summary_reads_documents_once_for_both_sides(spark):
    plan = Q.QUERIES["final_summary_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
