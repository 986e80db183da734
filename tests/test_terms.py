"""Terms counted in workers equal those of joins and sums; documents are not shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from lexora.operators import learning as L
from lexora.plans import queries as Q
from lexora.session import ship_package


@pytest.fixture
def docs(spark):
    ship_package(spark)
    rnd = random.Random(6)
    words = [f"w{int(rnd.paretovariate(0.7)) % 60}" for _ in range(2000)] + ["É½", "İx", "a", "²", "_"]
    rows = [(i, "en" if i % 3 else "fr", i % 4, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 30])))) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, lang string, fold long, text string").repartition(3)


@pytest.mark.parametrize("n,size,min_df,share", [(1, 20, 1, 1.0), (1, 500, 3, 0.5), (2, 30, 1, 1.0), (2, 30, 2, 0.3), (2, 9999, 1, 1.0)])
def test_vocabulary_and_weights(docs, n, size, min_df, share, monkeypatch):
    monkeypatch.setattr(L, "HELD", 5)  # counts leave a task in parts
    counts = L.term_counts(docs, ["doc_id"], "text", n)
    want = L.vocabulary(counts, docs.count(), size, min_df, share)
    got = L.document_vocabulary(docs, "text", docs.count(), size, n, min_df, share)
    assert sorted(got.collect()) == sorted(want.collect())
    for sub in (True, False):
        a, b = ({(r.doc_id, r.term): r.weight for r in x.collect()} for x in (L.document_terms(docs, ["doc_id"], "text", got, n, sub), L.tfidf(counts, want, ["doc_id"], sub)))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    tf = {(r.doc_id, r.term): r.tf for r in L.document_terms(docs, ["doc_id"], "text", got, n, counts=True).collect()}
    assert tf == {(r.doc_id, r.term): r.tf for r in counts.join(want, "term").collect()}
    vectors = {r.doc_id: r.features for r in L.document_vectors(docs, ["doc_id"], "text", got, size, n).collect()}
    joined = {r.doc_id: r.features for r in L.text_vectors(L.tfidf(counts, want, ["doc_id"]), want, ["doc_id"], size, docs.select("doc_id")).collect()}
    assert vectors.keys() == joined.keys()
    for k, v in vectors.items():
        assert list(v.indices) == list(joined[k].indices) and list(v.values) == pytest.approx(list(joined[k].values))


def test_totals_by_fold_and_holdout(docs):
    counts = L.term_counts(docs, ["doc_id", "fold"], "text")
    want = counts.groupBy("fold", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    assert sorted(L.term_totals(docs, "text", by="fold").collect()) == sorted(want.collect())
    a, b = (f(docs, "doc_id", "lang").select("doc_id", "held_out") for f in (L.holdout_flag, L.with_holdout))
    assert sorted(a.collect()) == sorted(b.collect())


def test_documents_are_not_shuffled(spark):
    plan = Q.QUERIES["tfidf_bigram"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
