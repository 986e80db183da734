"""Pieces that the training-data operators share: table access, durable
checkpoints, words of Arrow batches, grouped streaming of sorted partitions and
connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the ASCII controls 9 to 13; on
#: bytes, ``bytes.split()`` yields exactly these runs.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. It is ``spark.checkpoint.dir``;
    only where that is unset, in local mode, a folder is made and recorded."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if not at and held.isDefined():
        at = held.get()
    if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="lexora-")
    if not held.isDefined():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def persist_table(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors and is columnar, unlike checkpoint()."""
    path = scratch_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables of ``persist_table`` that nothing reads any more."""
    for df in tables:
        hadoop = df.sparkSession._jsc.hadoopConfiguration()
        for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(hadoop).delete(path, True)


def release() -> None:
    """Give freed memory of a Python worker back: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def text_slices(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Consecutive parts of at most ``limit`` bytes, or of one text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, limit + (ends[a - 1] if a else 0), side="right")))
        yield texts.slice(a, b - a)
        a = b


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of texts: how many each has, a code for each word in order, and
    the word that each code stands for."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    count = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    blank = np.flatnonzero(pc.equal(words, "").to_numpy(zero_copy_only=False))
    if len(blank):  # before a leading space, or in place of no text
        real = codes != blank[0]
        owner = np.repeat(np.arange(len(count)), count)
        count = np.bincount(owner[real], minlength=len(count))
        codes = codes[real]
    return count, codes, words


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of one key each, from batches of a partition that is sorted by
    ``keys``; memory is one group and one batch."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        code = batch[keys].ne(batch[keys].shift()).any(axis=1).to_numpy().copy()
        code[0] = True
        starts = list(code.nonzero()[0]) + [len(batch)]
        for a, b in zip(starts, starts[1:]):
            part = batch.iloc[a:b]
            key = tuple(part[keys].iloc[0])
            if held and key != last:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            last = key
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups of ``key``, from batches of a partition
    that is sorted by it; memory is one group and one batch."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        code = b[key].to_numpy()
        if held and code[-1] == held[-1][key].iloc[-1] and code[0] == code[-1]:
            held.append(b)  # still the same group
            continue
        last = int(np.flatnonzero(code != code[-1])[-1]) + 1 if code[0] != code[-1] else 0
        done = [*held, b.iloc[:last]]
        held = [b.iloc[last:]]
        if any(len(d) for d in done):
            yield pd.concat(done, ignore_index=True)
    if held:
        yield pd.concat(held, ignore_index=True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``edges``; component is its
    smallest reachable node. Alternates large-star and small-star rounds until
    the edge set is a set of stars. Each round is two aggregations with
    map-side combination and one join that AQE may split, is written to the
    shared folder, and sends two numbers to the driver. Self-loops are fine;
    null ends are ignored; an empty edge table gives an empty result."""
    work = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    work = persist_table(work, "edges")

    def star(sym: DataFrame, large: bool) -> DataFrame:
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = sym.join(low, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return (
            joined.select("v", "m")
            .union(low.select(F.col("u").alias("v"), "m"))
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )

    seen = None
    for _ in range(max_rounds):
        sym = work.union(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = star(sym, True).where("u <> v").distinct()
        last, work = work, persist_table(star(big, False).distinct(), "edges")
        drop_tables(last)
        row = work.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == seen:
            break
        seen = (row.n, row.s)
    else:
        raise RuntimeError("connected components did not settle")
    return work.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
