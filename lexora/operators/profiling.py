"""Feature-table profiling on a long table ``(feature, ord, cohort, value)``.

One unpivot feeds every statistic, so a table of any width is one scan and one
aggregation per question; order among features is their column ordinal. NaN and
infinity are told apart from null here once: ``value`` keeps them, ``finite`` is
null for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexora.functions.text import is_finite, is_missing, parse_float, safe_divide

#: Features that are bounded by 1 beside the ratios.
BOUNDED = ["lexical_diversity", "chorus_repetition_score", "direct_address_score"]


def numeric_columns(df: DataFrame, exclude: list[str] = (), need_value: bool = True) -> list[str]:
    """Columns whose every present value is a number (and at least one is,
    unless ``need_value`` is off). Typed columns need no scan."""
    typed = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    if texts:
        checks = [F.struct(F.count_if(~is_missing(F.col(c))).alias("n"), F.count(F.when(~is_missing(F.col(c)), parse_float(F.col(c)))).alias("ok")).alias(c) for c in texts]
        row = df.agg(*checks).first()
        typed += [c for c in texts if row[c].n == row[c].ok and (row[c].n or not need_value)]
    return [c for c in df.columns if c in typed]


def to_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: parse_float(F.col(c)) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c).cast("double") for c in columns})


def melt(df: DataFrame, features: list[str], cohort: str | None = None, keys: list[str] = ()) -> DataFrame:
    """The long table."""
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("ord"), F.col(c).cast("double").alias("value")) for i, c in enumerate(features)])
    lead = [*keys, *([F.col(cohort).alias("cohort")] if cohort else [])]
    return df.select(*lead, F.inline(items)).withColumn("finite", F.when(is_finite(F.col("value")), F.col("value")))


def missing_and_infinite(long: DataFrame) -> DataFrame:
    inf = F.lit(float("inf"))
    return long.groupBy("feature").agg(F.count_if(F.col("value").isNull() | F.isnan("value")).alias("n_missing"), F.count_if(F.abs("value") == inf).alias("n_infinite"), F.count("*").alias("n_rows"))


def constant_columns(long: DataFrame) -> DataFrame:
    """``constant``: one distinct finite value; ``strict``: and nothing else in
    the column; ``all_zero``: only zeros among finite values."""
    g = long.groupBy("feature").agg(F.min("finite").alias("lo"), F.max("finite").alias("hi"), F.count("finite").alias("k"), F.count("*").alias("n"))
    one = (F.col("k") > 0) & (F.col("lo") == F.col("hi"))
    return g.select("feature", one.alias("constant"), (one & (F.col("k") == F.col("n"))).alias("strict"), (one & (F.col("lo") == 0)).alias("all_zero"))


def near_constant_columns(long: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Columns one value of which has more than ``threshold`` of all rows."""
    counts = long.where("finite is not null").groupBy("feature", "finite").agg(F.count("*").alias("c"))
    top = counts.groupBy("feature").agg(F.max_by("finite", F.struct("c", -F.col("finite"))).alias("dominant_value"), F.max("c").alias("dominant_count"))
    total = long.groupBy("feature").agg(F.count("*").alias("n"))
    return top.join(total, "feature").where(F.col("dominant_count") > threshold * F.col("n")).select("feature", "dominant_value", "dominant_count", (F.col("dominant_count") / F.col("n")).alias("share"))


def upper_bound(feature: F.Column, diversity: bool = False) -> F.Column:
    hit = feature.endswith("_ratio") | feature.isin(*BOUNDED)
    if diversity:
        hit = (hit | feature.endswith("_diversity")) & (feature != "we_vs_i_ratio")
    return F.when(hit, 1.0)


def suspicious_maxima(long: DataFrame, diversity: bool = False) -> DataFrame:
    """Columns whose maximum exceeds its bound or lies far above the quartiles
    (inclusive quartiles, exact; from four values on)."""
    g = long.where("finite is not null").groupBy("feature").agg(F.max("finite").alias("max_value"), F.percentile("finite", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    g = g.select("feature", "max_value", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).withColumn("bound", upper_bound(F.col("feature"), diversity))
    above = F.when(F.col("max_value") > F.col("bound") + 1e-9, "above_expected_bound")
    far = F.when((F.col("n") >= 4) & (F.col("max_value") > F.col("q3") + 3 * (F.col("q3") - F.col("q1"))), "extreme_outlier")
    return g.withColumn("reasons", F.array_join(F.array_compact(F.array(above, far)), ",")).where("reasons <> ''").select("feature", "max_value", "q1", "q3", "reasons")


def column_groups(columns: list[str]) -> dict[str, list[str]]:
    """Morphology columns by kind."""
    start = lambda p: [c for c in columns if c.startswith(p)]
    named = ["lemma_count", "unique_lemma_count", "lemma_diversity", "root_count", "unique_root_count", "root_diversity"]
    return {
        **{f"{p}_prefix_columns": start(f"{p}_") for p in ("dicta", "pos", "tense", "verb", "binyan")},
        "morph_ratio_columns": [c for c in columns if c.endswith("_morph_ratio")],
        "lemma_root_diversity_columns": [c for c in named if c in columns],
    }


def cohort_means(long: DataFrame) -> DataFrame:
    """Mean of the finite values of each feature in each cohort."""
    return long.groupBy("feature", "ord", "cohort").agg(F.avg("finite").alias("mean"))


def mean_differences(means: DataFrame, cohorts: list[str]) -> DataFrame:
    """Spread of the cohort means, with the means side by side."""
    sides = [F.max(F.when(F.col("cohort") == c, F.col("mean"))).alias(f"{c}_mean") for c in cohorts]
    return means.where(F.col("cohort").isin(*cohorts)).groupBy("feature", "ord").agg((F.max("mean") - F.min("mean")).alias("mean_difference"), *sides)


def eta_squared(long: DataFrame, cohorts: list[str]) -> DataFrame:
    """Between-group share of the sum of squares, and the F statistic. Rows of
    other cohorts add to the total only."""
    g = long.where("finite is not null").groupBy("feature", "ord", "cohort").agg(F.count("*").alias("n"), F.avg("finite").alias("m"), (F.var_pop("finite") * F.count("*")).alias("ss"))
    w = Window.partitionBy("feature")  # a row for each cohort
    g = g.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    part = F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))
    known = F.col("cohort").isin(*cohorts)
    t = g.groupBy("feature", "ord").agg(F.sum(F.when(known, part)).alias("between_ss"), F.sum(F.col("ss") + part).alias("total_ss"), F.sum("n").alias("n"), F.count_if(known).alias("k"))
    t = t.withColumn("between_ss", F.coalesce("between_ss", F.lit(0.0))).withColumn("eta_squared", safe_divide(F.col("between_ss"), F.col("total_ss")))
    return t.withColumn("f_statistic", safe_divide(F.col("eta_squared") * (F.col("n") - F.col("k")), (1 - F.col("eta_squared")) * (F.col("k") - 1)))


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """Pairwise-finite Pearson correlations ``(f1, f2, corr)``, i < j, in one
    aggregation over the rows: a fixed number of sums per pair, no self-join.
    Null where a column does not vary over the pair's rows."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]
    x = {c: F.when(is_finite(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    both = [F.struct(F.lit(features[i]).alias("f1"), F.lit(features[j]).alias("f2"), F.when(x[features[j]].isNotNull(), x[features[i]]).alias("a"), F.when(x[features[i]].isNotNull(), x[features[j]]).alias("b")) for i, j in pairs]
    g = df.select(F.inline(F.array(*both))).where("a is not null and b is not null").groupBy("f1", "f2")
    g = g.agg(F.covar_pop("a", "b").alias("c"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), F.count("*").alias("n"))
    flat = (F.col("n") < 2) | (F.col("sa") * F.col("sb") < 1e-300)
    return g.select("f1", "f2", F.when(~flat, F.try_divide("c", F.col("sa") * F.col("sb"))).alias("corr"))


def full_matrix(pairs: DataFrame, features: list[str], spark) -> DataFrame:
    """All ordered pairs, 1 on the diagonal."""
    diagonal = spark.createDataFrame([(f, f, 1.0) for f in features], "f1 string, f2 string, corr double")
    return pairs.unionByName(pairs.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "corr")).unionByName(diagonal)


def high_pairs(pairs: DataFrame, threshold: float = 0.95) -> DataFrame:
    return pairs.where(F.abs("corr") >= threshold)


def cohort_order(observed: list[str], expected: list[str]) -> list[str]:
    """Known classes first, others sorted after; absent ones left out."""
    return [c for c in expected if c in observed] + sorted(set(observed) - set(expected))
