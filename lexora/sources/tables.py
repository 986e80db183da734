"""Sources and sinks: corpus and feature CSVs, annotation files, JSON summaries,
and durable intermediate tables."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = ["song_name", "artist_name", "decade", "lyrics"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_and_read(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage with a Parquet table in the folder that executors share."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if not at and held.isDefined():
        at = held.get()
    if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="lexora-")
        sc.setCheckpointDir(at)
    path = f"{at.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _csv(spark: SparkSession):
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", 10_000_000)


def read_corpus(spark: SparkSession, path: str, columns: list[str] = CORPUS) -> DataFrame:
    """Quoted CSV with line breaks in fields; exactly the stated columns."""
    df = _csv(spark).option("inferSchema", False).csv(path)
    if sorted(df.columns) != sorted(columns):
        raise ValueError(f"columns {sorted(df.columns)} are not {sorted(columns)}")
    return df.select(*columns).fillna("")


def read_feature_table(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    """A feature CSV as strings, or with inferred types."""
    df = _csv(spark).option("inferSchema", typed).csv(path)
    if not df.columns:
        raise ValueError(f"{path} has no header")
    return df


def read_lines(spark: SparkSession, cohorts: dict[str, list[str]]) -> DataFrame:
    """Numbered lines ``(file, cohort, ln, line)`` of text files; the cohort
    comes from the mapping, not the content."""
    parts = []
    for i, (cohort, paths) in enumerate(cohorts.items()):
        raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit(cohort).alias("cohort"), F.lit(i).alias("cohort_ord"), F.posexplode(F.split("value", "\r\n|\r|\n")).alias("p", "line"))
        parts.append(raw.select("file", "cohort", "cohort_ord", (F.col("p") + 1).cast("long").alias("ln"), "line"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """One CSV part for small result tables, in UTF-8 with a byte order mark on
    its first column name; Parquet serves between stages."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def summary_json(parts: dict[str, DataFrame | int | float | str | list]) -> str:
    """A nested summary as JSON text (indented, characters as they are). Small
    result tables become lists of their rows, in order; a one-row table with
    a single column becomes its value."""

    def plain(v):
        if not isinstance(v, DataFrame):
            return v
        rows = [r.asDict(recursive=True) for r in v.collect()]  # summary tables: a row per feature, class or model
        return rows[0][v.columns[0]] if len(rows) == 1 and len(v.columns) == 1 else rows

    return json.dumps({k: plain(v) for k, v in parts.items()}, ensure_ascii=False, indent=2, default=str)


def write_json(spark: SparkSession, parts: dict, path: str) -> None:
    """The summary as one text file in any store that Spark writes."""
    spark.createDataFrame([(summary_json(parts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def plot_rows(means: DataFrame, features: list[str]) -> DataFrame:
    """What a grouped bar plot shows: ``(feature, cohort, mean)`` of the asked
    features, in their order."""
    at = F.array_position(F.array(*map(F.lit, features)), F.col("feature"))
    return means.where(F.col("feature").isin(*features)).orderBy(at, "cohort").select("feature", "cohort", "mean")


def write_cohort_texts(parts: DataFrame, cohort: str, path: str) -> None:
    """One folder of text per cohort, in order within each file."""
    ready = parts.repartition(cohort).sortWithinPartitions(cohort, "ord")
    ready.select(cohort, F.concat("part", F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy(cohort).text(path)


def old_best(spark: SparkSession, path: str, score: str = "Accuracy") -> DataFrame | None:
    """Best row of an earlier result table; None if absent, empty or without
    the score."""
    try:
        df = read_feature_table(spark, path, typed=True)
    except Exception as e:  # Spark reports a missing path by an analysis error
        if "PATH_NOT_FOUND" in str(e) or isinstance(e, ValueError):
            return None
        raise
    if score not in df.columns or df.isEmpty():
        return None
    return df.orderBy(F.desc(score)).limit(1)
