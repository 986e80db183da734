"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt into index blocks of about ``BLOCK_ROWS`` rows. A block holds
``TREES`` trees; a tree is a sorted array of hash strings of ``BITS`` signs of
random projections (seeded, the same in every block). A query descends each tree
to its longest-prefix match and then all trees ascend together: at prefix length
x the candidates are, in every tree, the rows that share x bits with the query;
x falls, and at the last length the trees follow one after another, until there
are ``candidates`` times the block's rows, whatever the block's size. Candidates
are scored by exact Euclidean distance in double precision and the blocks' best
are merged.

High-dimensional vectors with no close neighbours need many candidates: recall
0.9 on nearly orthogonal embeddings takes the default 0.45. Lower it where
neighbours are close. Equal vectors are one index row that keeps its k+1 smallest
ids, so groups of copies of any size cost one row. Queries come in parts of about
``QUERY_ROWS`` and meet index blocks by an equi-join on block numbers; a block's
forest is built once for each part, a small share of the part's probing.

Edge cases: vectors that are null, all zero, or hold null or non-finite numbers
take no part, as query or candidate; a query's own row is never its neighbour,
but equal vectors of other rows are; with fewer candidates than k all are
returned; ties go to the smaller id; an empty table gives an empty result; a row
of another dimension than the first block's is compared with its own kind only.
Extra columns are ignored; repeated ids count as one row for each vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexora.llm.common import persist_table, table

K, TREES, BITS, CANDIDATES = 10, 192, 24, 0.45
BLOCK_ROWS, QUERY_ROWS = 8192, 16384


class Forest:
    """The trees of one block."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 7):
        self.x, self.bits = x, bits
        self.mean = x.mean(0)
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((trees, x.shape[1], bits))
        self.order, self.keys = [], []
        for h in self._strings(x):
            o = np.argsort(h, kind="stable")
            self.order.append(o)
            self.keys.append(h[o])

    def _strings(self, x: np.ndarray) -> Iterator[np.ndarray]:
        weight = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int32)
        for p in self.planes:
            yield ((x - self.mean) @ p > 0) @ weight

    def _ranges(self, strings: list[np.ndarray], x: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query, the run of rows that share x bits."""
        shift = self.bits - x
        lo, hi = (np.empty((len(strings), len(some)), np.int64) for _ in range(2))
        for t, h in enumerate(strings):
            prefix = h[some] >> shift
            lo[t] = np.searchsorted(self.keys[t], prefix << shift)
            hi[t] = np.searchsorted(self.keys[t], (prefix + 1) << shift)
        return lo, hi

    def candidates(self, q: np.ndarray, want: int) -> Iterator[np.ndarray]:
        """For each query the rows that the ascent meets until there are
        ``want`` of them (or a few more)."""
        strings = list(self._strings(q))
        none = np.zeros((len(strings), len(q)), np.int64)
        below, runs = (none, none), (none, none)  # one bit longer; the runs to add
        level = np.full(len(q), -1)
        for x in range(self.bits, -1, -1):  # ascend together
            open_ = np.flatnonzero(level < 0)
            if not len(open_):
                break
            lo, hi = self._ranges(strings, x, open_)
            done = (hi - lo).sum(0) >= want
            level[open_[done]] = x
            runs = tuple(_put(r, open_, v) for r, v in zip(runs, (lo, hi)))
            below = tuple(_put(r, open_[~done], v[:, ~done]) for r, v in zip(below, (lo, hi)))
        for i in range(len(q)):
            hit = np.zeros(len(self.x), bool)
            for o, a, b in zip(self.order, below[0][:, i], below[1][:, i]):
                hit[o[a:b]] = True
            x, lo, hi = level[i], runs[0][:, i], runs[1][:, i]
            while True:
                for t, o in enumerate(self.order):
                    hit[o[lo[t] : hi[t]]] = True
                    if t % 16 == 15 and np.count_nonzero(hit) >= want:
                        break
                if x <= 0 or np.count_nonzero(hit) >= want:
                    break
                x -= 1
                lo, hi = (v[:, 0] for v in self._ranges(strings, x, np.array([i])))
            yield np.flatnonzero(hit)


def _put(into: np.ndarray, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = into.copy()
    out[:, columns] = values
    return out


def usable(col: str) -> F.Column:
    c = F.col(col)
    return (
        c.isNotNull() & (F.size(c) > 0)
        & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists(c, lambda v: v != 0)
    )


def nearest(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, candidates: float = CANDIDATES, trees: int = TREES) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the k nearest of each query."""
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(usable("v") & F.col("id").isNotNull())
    # one index row per distinct vector, with its k+1 smallest ids
    ranked = base.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    index = persist_table(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v")), "vectors")
    blocks = index.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))  # a row for each dimension
    index = index.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(usable("v") & F.col("id").isNotNull()).distinct().withColumn("dim", F.size("v"))
    asked = persist_table(asked, "queries")
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).join(blocks, "dim")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ["dim", "block", "part"]

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            x, q = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            forest = Forest(x, trees)
            want = max(k + 1, int(np.ceil(candidates * len(x))))
            ids = left["ids"].tolist()
            for qid, v, cand in zip(right["id"], q, forest.candidates(q, want)):
                d = np.sqrt(((x[cand] - v) ** 2).sum(1))
                near = cand[d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)]]
                dist = dict(zip(cand.tolist(), d.tolist()))
                best = sorted((dist[int(c)], int(i)) for c in near for i in ids[c] if i != qid)[:k]
                rows.extend((int(qid), s, i) for s, i in best)
        return pd.DataFrame(rows, columns=["query_id", "score", "vec_id"]).astype({"query_id": "int64", "score": "float64", "vec_id": "int64"})

    found = index.select(*keys, "v", "ids").groupBy(*keys).cogroup(asked.select(*keys, "id", "v").groupBy(*keys)).applyInPandas(probe, "query_id long, score double, vec_id long")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))


QUERIES = {"op6_nearest": op6_nearest}
ORACLE: dict[str, str] = {}
