"""Vectorisation, topics, folds, baselines, metrics and the experiment grid."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.ml import classification as C
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from lexora.functions.text import finder, safe_divide, terms
from lexora.sources.tables import write_and_read

SEED = 42


def term_counts(docs: DataFrame, keys: list[str], body: str, n: int = 1, analysed: bool = False) -> DataFrame:
    toks = F.col(body) if analysed else terms(F.coalesce(F.col(body), F.lit("")), n)
    return docs.select(*keys, F.explode(toks).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, size: int, min_df: int = 1, max_share: float = 1.0) -> DataFrame:
    """``(term, df, cf, idf)`` of the most frequent terms by corpus count."""
    return most_frequent(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), n_docs, size, min_df, max_share)


def most_frequent(totals: DataFrame, n_docs: int, size: int, min_df: int = 1, max_share: float = 1.0) -> DataFrame:
    v = totals.where((F.col("df") >= min_df) & (F.col("df") <= max_share * n_docs)).orderBy(F.desc("cf"), "term").limit(size)
    return v.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


TERM = r"[\p{L}\p{N}_]{2,}"

#: Distinct terms that a task adds up before it hands their counts on.
HELD = 200_000
#: Documents that are Python objects at a time.
SLICE = 256


def _grams(words: list[str], m: int, inside: set[str] | None) -> Iterator[str]:
    """``m`` neighbours as terms; given ``inside``, those of its words only."""
    return (" ".join(p) for p in zip(*(words[j:] for j in range(m))) if inside is None or all(w in inside for w in p))


def _lower(docs: DataFrame, keys: list[str], body: str) -> DataFrame:
    return docs.select(*keys, F.lower(F.coalesce(F.col(body), F.lit(""))).alias("__lower"))


def term_totals(docs: DataFrame, body: str, n: int = 1, inside: set[str] | None = None, least: int = 1, by: str | None = None) -> DataFrame:
    """``(by, term, df, cf)`` of all terms of ``least`` to n words. Each row is a
    document; what is shuffled are the terms of ``HELD`` or more, added up,
    not those of documents. ``by`` is a whole number."""
    names = [*([by] if by else []), "term", "df", "cf"]
    schema = pa.schema([(x, pa.string() if x == "term" else pa.int64()) for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = finder(TERM)
        held: dict[int | None, tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for k, (df, cf) in held.items():
                items = list(cf)
                for a in range(0, len(items), 10_000):
                    part = items[a : a + 10_000]
                    values = [part, [df[t] for t in part], [cf[t] for t in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([[k] * len(part), *values] if by else values, schema)], schema=schema)
            held.clear()

        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                keys = part.column(0).to_pylist() if by else [None] * part.num_rows
                for k, text in zip(keys, part.columns[-1].to_pylist()):
                    words = word(text)
                    found = words if least == 1 else []
                    for m in range(max(least, 2), n + 1):
                        found = [*found, *_grams(words, m, inside)]
                    df, cf = held.setdefault(k, (Counter(), Counter()))
                    cf.update(found)
                    df.update(set(found))
                if sum(len(cf) for _df, cf in held.values()) > HELD:
                    yield from flush()
        yield from flush()

    found = _lower(docs, [F.col(by).cast("long").alias(by)] if by else [], body).mapInArrow(run, ", ".join(f"{x} {'string' if x == 'term' else 'long'}" for x in names))
    return found.groupBy(*names[:-2]).agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def document_vocabulary(docs: DataFrame, body: str, n_docs: int, size: int, n: int = 1, min_df: int = 1, max_share: float = 1.0) -> DataFrame:
    """``vocabulary`` of a table with a row for each document. A pair occurs no
    more often than either of its words, so once ``size`` words make the list,
    only pairs of words as frequent as the last of them can enter it."""
    totals = write_and_read(term_totals(docs, body), "terms")
    first = most_frequent(totals, n_docs, size, min_df, max_share)
    if n == 1:
        return write_and_read(first, "vocab")
    least = first.agg(F.count("*").alias("n"), F.min("cf").alias("cf")).first()
    inside = None
    if least.n == size:  # else every pair may enter
        often = totals.where(F.col("cf") >= least.cf).select("term")
        if often.count() <= 10 * size:
            inside = {r.term for r in often.collect()}
    pairs = term_totals(docs, body, n, inside, least=2)
    return write_and_read(most_frequent(totals.unionByName(pairs), n_docs, size, min_df, max_share), "vocab")


def document_vectors(docs: DataFrame, keys: list[str], body: str, vocab: DataFrame, size: int, n: int = 1) -> DataFrame:
    """``docs``' keys with their TF-IDF vectors over a fixed vocabulary, in its
    order by frequency; empty where no term is known. Nothing is shuffled."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    rows = vocab.select("term", "idf").orderBy(F.desc("cf"), "term").collect()  # at most the vocabulary's size
    idf, at = {r.term: r.idf for r in rows}, {r.term: i for i, r in enumerate(rows)}
    inside = {w for t in idf if " " in t for w in t.split(" ")}

    @F.udf(VectorUDT())
    def vector(lower: str) -> SparseVector:
        words = finder(TERM)(lower)
        tf = Counter(w for w in words if w in idf)
        for m in range(2, n + 1):
            tf.update(t for t in _grams(words, m, inside) if t in idf)
        w = sorted((at[t], (1.0 + math.log(c)) * idf[t]) for t, c in tf.items())
        norm = math.sqrt(math.fsum(x * x for _i, x in w)) or 1.0
        return SparseVector(size, [i for i, _x in w], [x / norm for _i, x in w])

    return _lower(docs, keys, body).select(*keys, vector("__lower").alias("features"))


def document_terms(docs: DataFrame, keys: list[str], body: str, vocab: DataFrame, n: int = 1, sublinear: bool = True, counts: bool = False) -> DataFrame:
    """``tfidf`` of a table with a row for each document: ``(keys, term,
    weight)``, or ``(keys, term, tf)``; the vocabulary, of a fixed size, goes to
    the tasks and nothing is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema

    idf = {r.term: r.idf for r in vocab.select("term", "idf").collect()}
    inside = {w for t in idf if " " in t for w in t.split(" ")}
    fields = [docs.schema[k] for k in keys]
    out = Y.StructType([*fields, Y.StructField("term", Y.StringType()), Y.StructField("tf", Y.LongType()) if counts else Y.StructField("weight", Y.DoubleType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = finder(TERM)
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                rows, terms_, values = [], [], []
                for i, text in enumerate(part.column(len(keys)).to_pylist()):
                    words = word(text)
                    tf = Counter(w for w in words if w in idf)
                    for m in range(2, n + 1):
                        tf.update(t for t in _grams(words, m, inside) if t in idf)
                    if counts:
                        w = list(tf.values())
                    else:
                        w = [((1.0 + math.log(c)) if sublinear else float(c)) * idf[t] for t, c in tf.items()]
                        norm = math.sqrt(math.fsum(x * x for x in w))
                        w = [x / norm for x in w]
                    rows += [i] * len(w)
                    terms_ += tf
                    values += w
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in part.columns[: len(keys)]], pa.array(terms_, pa.string()), pa.array(values, schema.field(len(keys) + 1).type)], schema=schema)

    return _lower(docs, keys, body).mapInArrow(run, out)


def tfidf(counts: DataFrame, vocab: DataFrame, keys: list[str], sublinear: bool = True) -> DataFrame:
    """``(keys, term, weight)``, rows of unit length. Fit the vocabulary on the
    training part only to keep test rows unseen."""
    w = (1.0 + F.log("tf") if sublinear else F.col("tf").cast("double")) * F.col("idf")
    raw = counts.join(vocab.select("term", "idf"), "term").withColumn("w", w)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return raw.select(*keys, "term", (F.col("w") / norm).alias("weight"))


def ranked(df: DataFrame, key: str, label: str, seed: int = SEED) -> DataFrame:
    """``df`` with ``__rank`` (from 0) in its class by a seeded hash order, and
    ``__size`` of the class. Ranks go through buckets of the hash, so no window
    holds a whole class."""
    d = df.withColumn("__h", F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("__b", F.substring("__h", 1, 2))
    sums = d.groupBy(F.col(label).alias("__label"), F.col("__b").alias("__bucket")).agg(F.count("*").alias("__n"))
    by = Window.partitionBy("__label")  # 256 rows for each class
    sums = sums.select("__label", "__bucket", (F.sum("__n").over(by.orderBy("__bucket")) - F.col("__n")).alias("__base"), F.sum("__n").over(by).alias("__size"))
    d = d.withColumn("__in", F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key)) - 1)
    d = d.join(sums, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__b") == F.col("__bucket")))
    return d.withColumn("__rank", F.col("__base") + F.col("__in")).drop("__h", "__b", "__label", "__bucket", "__base", "__in")


def with_fold(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = SEED) -> DataFrame:
    """``df`` with its fold 0..folds-1, balanced in each class."""
    return ranked(df, key, label, seed).withColumn("fold", F.pmod("__rank", F.lit(folds)).cast("long")).drop("__rank", "__size")


def with_holdout(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = SEED, name: str = "held_out") -> DataFrame:
    """``df`` with a flag on the same share of each class."""
    return ranked(df, key, label, seed).withColumn(name, F.col("__rank") < F.ceil(share * F.col("__size"))).drop("__rank", "__size")


def holdout_flag(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = SEED, name: str = "held_out") -> DataFrame:
    """``with_holdout`` where rows are wide: only keys and classes are shuffled,
    for the last hash of each class that is held out."""
    at = F.struct(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key))
    held = with_holdout(df.select(key, label), key, label, share, seed, "__held")
    last = held.where("__held").groupBy(F.col(label).alias("__label")).agg(F.max(at).alias("__last"))  # the classes
    out = df.join(F.broadcast(last), F.col(label).eqNullSafe(F.col("__label")), "left")
    return out.withColumn(name, F.coalesce(at <= F.col("__last"), F.lit(False))).drop("__label", "__last")


def scale_by_training(df: DataFrame, columns: list[str], fold: str = "fold") -> DataFrame:
    """Each fold's rows scaled by mean and population deviation of the other
    folds, both from per-fold sums: one aggregation, a row for each fold."""
    sums = [f(c).alias(f"{k}_{c}") for c in columns for k, f in (("n", F.count), ("s", F.sum))] + [F.sum(F.col(c).cast("double") * F.col(c)).alias(f"q_{c}") for c in columns]
    per = df.groupBy(fold).agg(*sums)
    every = Window.partitionBy()  # one row for each fold
    exprs = {}
    for c in columns:
        n, s, q = (F.sum(f"{k}_{c}").over(every) - F.col(f"{k}_{c}") for k in "nsq")
        exprs |= {f"m_{c}": s / n, f"d_{c}": F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))}
    stats = per.select(fold, *[v.alias(k) for k, v in exprs.items()])
    out = df.join(F.broadcast(stats), fold)
    return out.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"m_{c}")) / F.when(F.col(f"d_{c}") < 1e-12, 1.0).otherwise(F.col(f"d_{c}")) for c in columns}).drop(*exprs)


def majority_label(df: DataFrame, label: str, by: str) -> DataFrame:
    return df.groupBy(by, label).agg(F.count("*").alias("c")).groupBy(by).agg(F.min_by(label, F.struct(-F.col("c"), F.col(label))).alias("majority"))


def confusion(pred: DataFrame, label: str, guess: str, labels: list[str]) -> DataFrame:
    return pred.groupBy(label).pivot(guess, labels).count().fillna(0)


def class_report(pred: DataFrame, label: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support of each class (0 where undefined)."""
    both = pred.select(F.inline(F.array(F.struct(F.col(label).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(label) == F.col(guess)).cast("int").alias("tp")), F.struct(F.col(guess).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))))
    g = both.groupBy("cls").agg(F.sum("t").alias("support"), F.sum("p").alias("guessed"), F.sum("tp").alias("tp"))
    pr, rc = safe_divide(F.col("tp"), F.col("guessed")), safe_divide(F.col("tp"), F.col("support"))
    return g.select("cls", pr.alias("precision"), rc.alias("recall"), safe_divide(2 * pr * rc, pr + rc).alias("f1"), "support")


def scores(pred: DataFrame, label: str, guess: str, by: list[str]) -> DataFrame:
    """Accuracy and macro-F1 for each ``by``."""
    cell = pred.groupBy(*by, label, guess).agg(F.count("*").alias("c"))
    wide = cell.select(*by, F.inline(F.array(F.struct(F.col(label).alias("cls"), F.col("c").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col(label) == F.col(guess), F.col("c")).otherwise(0).alias("tp")), F.struct(F.col(guess).alias("cls"), F.lit(0).cast("long").alias("t"), F.col("c").alias("p"), F.lit(0).cast("long").alias("tp")))))
    per = wide.groupBy(*by, "cls").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    f1 = safe_divide(2.0 * F.col("tp"), F.col("t") + F.col("p"))
    return per.groupBy(*by).agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def naive_bayes(train: DataFrame, test: DataFrame, key: str, label: str, by: list[str] = (), alpha: float = 1.0) -> DataFrame:
    """Multinomial naive Bayes over long ``(by, key, label, term, weight)``
    tables, in joins and sums; returns (by, key, predicted)."""
    by = list(by)
    # a row for each class and term; written, so that it is broadcast if small
    mass = write_and_read(train.groupBy(*by, label, "term").agg(F.sum("weight").alias("s")), "mass")
    known = mass.select(*by, "term").distinct()
    n_terms = known.groupBy(*by).agg(F.count("*").alias("v"))
    total = train.select(*by, label, key).distinct().groupBy(*by, label).agg(F.count("*").alias("docs"))
    total = total.join(mass.groupBy(*by, label).agg(F.sum("s").alias("z")), [*by, label])
    total = total.withColumn("prior", F.log(F.col("docs") / F.sum("docs").over(Window.partitionBy(*by))))
    total = total.join(n_terms, by) if by else total.crossJoin(n_terms)
    t = test.select(*by, key, "term", "weight").join(known, [*by, "term"])
    # absent terms add log(alpha / (z + alpha v)) for each unit of weight
    hit = t.join(mass, [*by, "term"]).groupBy(*by, key, label).agg(F.sum(F.col("weight") * (F.log(F.col("s") + alpha) - F.log(F.lit(alpha)))).alias("gain"))
    size = t.groupBy(*by, key).agg(F.sum("weight").alias("w"))
    every = size.join(total, by) if by else size.crossJoin(F.broadcast(total))
    s = every.join(hit, [*by, key, label], "left")
    score = F.col("prior") + F.coalesce("gain", F.lit(0.0)) + F.col("w") * (F.log(F.lit(alpha)) - F.log(F.col("z") + alpha * F.col("v")))
    return s.withColumn("score", F.round(score, 9)).groupBy(*by, key).agg(F.max_by(label, F.struct("score", label)).alias("predicted"))


def numeric_models(n_train: int, trees: int = 200, stages: int = 200) -> dict:
    """The model line-up; small settings make a quick grid."""
    lr = C.LogisticRegression(family="multinomial", regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False, maxIter=100)
    svm = C.OneVsRest(classifier=C.LinearSVC(regParam=1.0 / max(n_train, 1), standardization=False, maxIter=50))
    gbt = C.OneVsRest(classifier=C.GBTClassifier(maxIter=stages, maxDepth=3, seed=SEED))
    return {"Logistic Regression": lr, "Linear SVM": svm, "Random Forest": C.RandomForestClassifier(numTrees=trees, seed=SEED), "Gradient Boosting": gbt}


def with_vector(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df.fillna(0, columns))


def text_vectors(weights: DataFrame, vocab: DataFrame, keys: list[str], size: int, rows: DataFrame | None = None) -> DataFrame:
    """Sparse vectors of a fixed vocabulary, one row for each key with a term;
    given ``rows``, one for each of them, empty where it has none."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    index = vocab.select("term", (F.row_number().over(Window.orderBy(F.desc("cf"), "term")) - 1).alias("i"))  # at most the vocabulary's size
    packed = weights.join(index, "term").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "weight"))).alias("iw"))
    make = F.udf(lambda iw: SparseVector(size, [x.i for x in iw or ()], [x.weight for x in iw or ()]), VectorUDT())
    if rows is not None:
        packed = rows.join(packed, keys, "left")
    return packed.select(*(keys if rows is None else rows.columns), make("iw").alias("features"))


def indexed(df: DataFrame | list[DataFrame], label: str, key: str) -> list[DataFrame]:
    """Frames as ``cross_validate`` needs them, written once for all models."""
    each = df if isinstance(df, list) else [df]
    indexer = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(each[0].select(label))
    return [write_and_read(indexer.transform(x).select("fold", key, label, "__y", "features"), "cv") for x in each]


def cross_validate(df: DataFrame | list[DataFrame], model, label: str, key: str, folds: int = 5) -> DataFrame:
    """Predictions ``(fold, key, label, predicted)`` of a model fitted on the
    other folds; ``df`` has features, label, key and fold. Where features are
    fitted themselves, it is a list: all rows for each fold, as that fold's
    training part makes them. Frames of ``indexed`` are taken as they are."""
    each = df if isinstance(df, list) else [df]
    if "__y" not in each[0].columns:
        each = indexed(each, label, key)
    classes = [r[label] for r in each[0].select(label, "__y").distinct().orderBy("__y").collect()]
    names = F.array(*[F.lit(x) for x in classes])

    def one(k: int) -> DataFrame:
        data = each[k % len(each)]
        fitted = model.copy({model.getParam("labelCol"): "__y"}) if model.hasParam("labelCol") else model
        fitted = fitted.fit(data.where(F.col("fold") != k))
        return write_and_read(fitted.transform(data.where(F.col("fold") == k)).select("fold", key, label, F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted")), "predicted")

    with ThreadPoolExecutor(min(folds, 4)) as pool:  # folds are independent jobs
        parts = list(pool.map(one, range(folds)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary_row(pred: DataFrame, label: str, group: str, name: str, n_features: int) -> DataFrame:
    per = scores(pred, label, "predicted", ["fold"])
    return per.agg(F.lit(group).alias("feature_group"), F.lit(name).alias("model"), F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("acc_std"), F.avg("macro_f1").alias("macro_f1"), F.stddev_pop("macro_f1").alias("f1_std"), F.lit(n_features).cast("long").alias("n_features"))


def nmf(weights: DataFrame, key: str, topics: int = 8, rounds: int = 10, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Non-negative factors by multiplicative updates on a long table: (key,
    w array) and (term, h array). Each half-round is two equi-joins with sums;
    only topics x topics products reach the driver."""
    draw = lambda c: F.transform(F.sequence(F.lit(0), F.lit(topics - 1)), lambda i: F.pmod(F.xxhash64(c, i, F.lit(seed)), F.lit(1000)) / 1000.0 + 0.01)
    v = write_and_read(weights.select(key, "term", "weight"), "nmf")
    # written, so that the terms' factors are broadcast where they are few
    w = write_and_read(v.select(key).distinct().withColumn("w", draw(F.col(key))), "nmf")
    h = write_and_read(v.select("term").distinct().withColumn("h", draw(F.col("term"))), "nmf")

    def gram(df: DataFrame, c: str) -> list[list[float]]:
        row = df.agg(*[F.sum(F.col(c)[i] * F.col(c)[j]).alias(f"g{i}_{j}") for i in range(topics) for j in range(topics)]).first()
        return [[row[f"g{i}_{j}"] or 0.0 for j in range(topics)] for i in range(topics)]

    def update(own: DataFrame, k: str, c: str, other: DataFrame, ko: str, co: str) -> DataFrame:
        g = gram(other, co)
        num = v.join(other, ko).groupBy(k).agg(*[F.sum(F.col("weight") * F.col(co)[i]).alias(f"n{i}") for i in range(topics)])
        den = [sum((F.col(c)[j] * F.lit(float(g[j][i])) for j in range(topics)), F.lit(1e-12)) for i in range(topics)]
        return own.join(num, k).select(k, F.array(*[F.col(c)[i] * F.col(f"n{i}") / den[i] for i in range(topics)]).alias(c))

    for _ in range(rounds):
        w = write_and_read(update(w, key, "w", h, "term", "h"), "nmf")
        h = write_and_read(update(h, "term", "h", w, key, "w"), "nmf")
    return w, h


def importances(df: DataFrame, columns: list[str], label: str, trees: int = 200, top: int = 20) -> DataFrame:
    df = write_and_read(df.select(label, *columns), "importances")  # fitting reads it many times
    y = StringIndexer(inputCol=label, outputCol="__y").fit(df).transform(with_vector(df, columns))
    model = C.RandomForestClassifier(numTrees=trees, seed=SEED, labelCol="__y").fit(y)
    pairs = sorted(zip(columns, model.featureImportances.toArray().tolist()), key=lambda p: (-p[1], p[0]))[:top]
    return df.sparkSession.createDataFrame([(i + 1, c, v) for i, (c, v) in enumerate(pairs)], "rank int, feature string, importance double")
