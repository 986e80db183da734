"""N-gram Jaccard self-join with signature trees.

A document is the set of its distinct five-word shingles, as 64-bit hashes.
Documents with equal sets form one class (first aggregation), so groups of exact
copies cost one row. Classes whose Jaccard similarity is 0.8 or more share a
shingle among the first floor(n/5)+1 of any common order of shingles (prefix
principle). The order is by hash, with the ``HOT`` most frequent prefix shingles
moved to its end, so a common passage does not gather unrelated documents. Their
counts leave out what a batch of documents holds once; any order of shingles
gives the same result, so this costs no links.

Prefix shingles travel packed, dealt by hash, and are shuffled without being
written first; of a shingle ``TOKEN_BITS`` bits go beside its bucket, so unlike
shingles may meet, which can add candidates and takes none away. The ``HOT`` ones
come out as rows, so that they are combined map-side and their join may be split. Where ``FEW`` classes or
fewer hold a shingle, their pairs count what they share; similar sets of n and m
share at least (4/9)(n + m) - (n - prefix) of the prefixes, so pairs with less
go, the others form a group about the smaller class. All classes that hold a more
frequent shingle belong to the group of the smallest class among them. Groups are dealt into chunks of
bounded total size, each chunk also holding the group's smallest document. In a
chunk signature trees are built, one for each bitmap width (a set's bitmap has
two to four bits for each shingle): nodes hold OR-combined token bitmaps, size
ranges and the largest excess of tokens over bits; a dual traversal prunes node
pairs whose greatest possible overlap is too small for the similarity, and skips
those that are connected already. A first traversal on the bitmaps alone decides
whose texts move at all. Surviving pairs are verified on the whole sets, and only links that connect something new leave the
task: no chunk emits all pairs of a group. Groups of several chunks whose
members are not connected after that go through a second round, in which the
members outside the group's largest component meet all its chunks. No pair that
could link is left unseen; components come from alternating star rounds.

Edge cases: fewer than five words make one shingle of the whole sequence; no
words (or null text) make an empty set, which links with nothing; a document
with only null or empty text is its own component; very long texts are taken
whole; an empty table gives an empty result. Rows are numbered once in a written
table and that number is the document throughout; ids are a payload. So rows
with a null id are compared like others, and rows with equal ids are documents
of their own, each in the component of its text. A component has the smallest
id of its rows, null only if none has one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.llm.common import connected_components, drop_tables, persist_table, release, shuffle_width, sorted_groups, table, text_slices, whole_groups, word_codes

WORDS, NUM, DEN = 5, 4, 5  # shingle width; similarity NUM/DEN
HOT, HOT_AT_LEAST = 1 << 16, 200
CHUNK_TOKENS, CHUNK_ROWS = 4_000_000, 2000
LEAF, FEW = 8, 4
TOKEN_BITS = 32  # of a prefix shingle, beside its bucket
GROUP_BYTES = 8_000_000  # of texts whose words are hashed together
#: Rows of a few numbers that may be broadcast, some 100 MB as a hash table;
#: beyond that the join shuffles.
BROADCAST_ROWS = 2_000_000


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_sets(texts: pa.Array, width: int = WORDS) -> Iterator[np.ndarray]:
    """For each whole text the sorted distinct 64-bit hashes of its word
    shingles; each distinct word of some texts is hashed once."""
    for part in text_slices(texts.cast(pa.string()), GROUP_BYTES):
        count, codes, words = word_codes(part, lower=True)
        said = words.to_pylist()
        w = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in said), np.uint64, len(said))[codes]
        h = np.zeros(max(0, len(w) - width + 1), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(width):
                h = (h ^ w[i : len(w) - width + 1 + i]) * _MIX[i % 5]
                h ^= h >> np.uint64(32)
        upto = np.concatenate([[0], np.cumsum(count)]).tolist()
        for a, z in zip(upto, upto[1:]):
            if a == z:
                yield h[:0]
            elif z - a < width:
                yield np.array([xxhash.xxh3_64_intdigest(" ".join(said[c] for c in codes[a:z]), seed=z - a)], np.uint64)
            else:
                s = np.sort(h[a : z - width + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]


def shingles(text: str | None) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string())))


def prefix(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first floor(n * (1 - similarity)) + 1 in the common order."""
    k = len(s) - -(-NUM * len(s) // DEN) + 1
    if not len(s):
        return s
    if len(hot):
        late = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
        if late.any():
            return np.concatenate([s[~late], s[late]])[:k]
    return s[:k]


def class_key(s: np.ndarray) -> int:
    """64 bits of a set. Classes whose keys collide share their groups; the
    class itself is known by 128 bits."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _count(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(-1, dtype=np.int64)


class Tree:
    """Signature tree over sets: level 0 are the sets, ordered by size; each
    further level joins ``LEAF`` neighbours, until one node is left. ``ids``
    are the sets' numbers in that order."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.ids = ids[order].tolist()
        bitmap, n = bitmaps[order], sizes[order].astype(np.int64)
        self.levels = [(bitmap, n, n, n - _count(bitmap))]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, ex = self.levels[-1]
            cut = np.arange(0, len(b), LEAF)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(ex, cut)))

    def span(self, level: int, i: int) -> tuple[int, int]:
        """Children of node i of a level, in the level below."""
        return i * LEAF, min((i + 1) * LEAF, len(self.levels[level - 1][0]))


def bits_for(n: int) -> int:
    """Bits of the bitmap of a set of n: a power of two, twice n at least, so
    that bitmaps of long texts tell them apart too."""
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap_of(s: np.ndarray) -> np.ndarray:
    bits = bits_for(len(s))
    flags = np.zeros(bits, np.uint8)
    flags[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def fold(bitmaps: np.ndarray) -> np.ndarray:
    """Bitmaps of half the bits."""
    half = bitmaps.shape[-1] // 2
    return bitmaps[..., :half] | bitmaps[..., half:]


def _enough(common: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Could sets of these sizes be similar, if they share so many at most?"""
    return ((NUM + DEN) * common >= NUM * (na + nb)) & (DEN * na >= NUM * nb) & (DEN * nb >= NUM * na)


def forest(bitmaps: list[np.ndarray], sizes: np.ndarray, ids: np.ndarray) -> Iterator[tuple[Tree, Tree]]:
    """Pairs of trees that hold every pair of sets whose sizes allow it. Sets
    have a tree for each bitmap width; a similar pair has the same width or
    neighbouring ones, and then the wider bitmaps are folded."""
    width = np.array([len(b) for b in bitmaps])
    for w in np.unique(width):
        low = np.flatnonzero(width == w)
        tree = Tree(np.stack([bitmaps[i] for i in low]), sizes[low], ids[low])
        yield tree, tree
        high = np.flatnonzero((width == 2 * w) & (NUM * sizes <= DEN * sizes[low].max()))
        if len(high):
            yield tree, Tree(fold(np.stack([bitmaps[i] for i in high])), sizes[high], ids[high])


def dual(ta: Tree, tb: Tree, skip: Callable[[list, list], bool], found: Callable[[int, int], None]) -> None:
    """Dual traversal of two trees (or of one with itself): calls ``found`` for
    each pair of sets that could be similar, except below pairs of nodes whose
    sets ``skip`` finds settled."""
    stack = [(len(ta.levels) - 1, 0, len(tb.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        da, a0, a1 = (la - 1, *ta.span(la, i)) if la else (0, i, i + 1)
        db, b0, b1 = (lb - 1, *tb.span(lb, j)) if lb else (0, j, j + 1)
        if da == db == 0 and skip(ta.ids[a0:a1], tb.ids[b0:b1]):
            continue
        ba, na, ma, xa = (v[a0:a1, None] for v in ta.levels[da])
        bb, nb, mb, xb = (v[None, b0:b1] for v in tb.levels[db])
        # overlap >= (smallest sizes) * NUM / (NUM + DEN); size ranges may meet
        ok = ((NUM + DEN) * (_count(ba & bb) + np.minimum(xa, xb)) >= NUM * (na + nb)) & (DEN * ma >= NUM * nb) & (DEN * mb >= NUM * na)
        for x, y in zip(*(v.tolist() for v in np.nonzero(ok))):
            x, y = x + a0, y + b0
            if ta is tb and da == db and y < x:
                continue
            if da or db:
                stack.append((da, x, db, y))
            elif ta.ids[x] != tb.ids[y]:
                found(ta.ids[x], tb.ids[y])


def with_partner(bitmaps: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Sets that could be similar to another one, by the trees alone."""
    hit = np.zeros(len(sizes), bool)

    def found(x: int, y: int) -> None:
        hit[x] = hit[y] = True

    for ta, tb in forest(bitmaps, sizes, np.arange(len(sizes))):
        dual(ta, tb, lambda a, b: bool(hit[a].all() and hit[b].all()), found)
    return hit


def with_partner_leaves(group: np.ndarray, bitmaps: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The same for many groups of at most ``LEAF`` sets, whose trees are one
    leaf: all their pairs are tested together. Rows are ordered by group."""
    hit = np.zeros(len(group), bool)
    width = np.array([len(b) for b in bitmaps])
    for step in range(1, LEAF):
        a = np.flatnonzero(group[step:] == group[:-step])
        b = a + step
        ok = (DEN * sizes[a] >= NUM * sizes[b]) & (DEN * sizes[b] >= NUM * sizes[a]) & ~(hit[a] & hit[b])
        a, b = a[ok], b[ok]
        a, b = np.where(width[a] <= width[b], a, b), np.where(width[a] <= width[b], b, a)
        for w in np.unique(width[a]):
            for c in range(0, len(pair := np.flatnonzero(width[a] == w)), 4096):
                x, y = a[pair[c : c + 4096]], b[pair[c : c + 4096]]
                bx = np.stack([bitmaps[i] for i in x])
                by = np.stack([bitmaps[i] if len(bitmaps[i]) == w else fold(bitmaps[i]) for i in y])
                most = _count(bx & by) + np.minimum(sizes[x] - _count(bx), sizes[y] - _count(by))
                sure = _enough(most, sizes[x], sizes[y])
                hit[x[sure]] = hit[y[sure]] = True
    return hit


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * common >= NUM * (len(a) + len(b) - common)


class Links:
    """Union-find over the rows of a task."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def tree_links(sets: list[np.ndarray], uf: Links, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """New links among ``sets``, or only those between the two values of ``side``."""
    out: list[tuple[int, int]] = []

    def settled(a: list[int], b: list[int]) -> bool:
        return len({uf.find(x) for x in (*a, *b)}) == 1 or (side is not None and len({side[x] for x in (*a, *b)}) == 1)

    def found(x: int, y: int) -> None:
        u, v = uf.find(x), uf.find(y)
        if u != v and (side is None or side[x] != side[y]) and similar(sets[x], sets[y]):
            uf.up[max(u, v)] = min(u, v)
            out.append((x, y))

    for ta, tb in forest(list(map(bitmap_of, sets)), np.array(list(map(len, sets)), np.int64), np.arange(len(sets))):
        dual(ta, tb, settled, found)
    return out


def few(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be sent to the other side of a
    join if it has at most ``BROADCAST_ROWS``; beyond that both are shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shared(a: str, b: str) -> Column:
    """(NUM + DEN) times the shingles that the prefixes of similar sets of these sizes
    share at least, if a's prefix ends first: what lies behind it is no more
    than the rest of a."""
    n, m = F.col(a), F.col(b)
    size = n - F.floor((NUM * n + DEN - 1) / DEN) + 1
    return NUM * (n + m) - (NUM + DEN) * (n - size)


def class_links(src: DataFrame, facts: DataFrame, classes: DataFrame, hot_limit: int = HOT_AT_LEAST, chunk_rows: int = CHUNK_ROWS, token_bits: int = TOKEN_BITS) -> DataFrame:
    """Links ``(a, b)`` that connect the classes ``(cls, rep, bits)`` of the
    documents ``src(row, text)``; ``facts`` has the counts of shingles."""

    none = np.zeros(0, np.uint64)

    def first_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"token": np.frombuffer(b"".join(b["often"]), np.int64), "n": np.frombuffer(b"".join(b["times"]), np.int64)})

    counts = facts.where("often is not null").select("often", "times").mapInPandas(first_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= hot_limit).orderBy(F.desc("n"), "token").limit(HOT).select("token").toPandas()["token"]  # at most HOT numbers
    hot = np.sort(top.to_numpy(np.int64).view(np.uint64))

    width = shuffle_width(src.sparkSession)
    buckets = 4 * width

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                sets = list({class_key(s): s for s in shingle_sets(b.column(0)) if len(s)}.items())
                pre = [prefix(s, hot) for _, s in sets]
                size = list(map(len, pre))
                token = np.concatenate([none, *pre])
                cls = np.repeat(np.array([k for k, _ in sets], np.int64), size)
                n = np.repeat(np.array([len(s) for _, s in sets], np.int32), size)
                place = (token % np.uint64(buckets)).astype(np.int64)
                short = ((token // np.uint64(buckets)) & np.uint64((1 << token_bits) - 1)).astype(np.uint32)
                if len(hot):  # these go by their number, a cell for the batch
                    at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                    late = hot[at] == token
                    place[late], short[late] = -1 - int(cls[0] % buckets) if len(cls) else -1, at[late]
                order = np.argsort(place, kind="stable")
                short, cls, n, place = short[order], cls[order], n[order], place[order]
                cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
                ends = np.append(cut[1:], len(place))
                data = [packed(short[x:y], cls[x:y], n[x:y]) for x, y in zip(cut, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(place[cut], pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])
        finally:
            release()

    def packed(token: np.ndarray, cls: np.ndarray, n: np.ndarray) -> bytes:
        # sizes byte by byte: the upper bytes are nearly all zero
        return token.tobytes() + cls.tobytes() + n.view(np.uint8).reshape(-1, 4).T.tobytes()

    def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = len(data) // 16
        n = np.frombuffer(data, np.uint8, 4 * k, 12 * k).reshape(4, k).T
        return np.frombuffer(data, np.uint32, k).astype(np.int64), np.frombuffer(data, np.int64, k, 4 * k), np.ascontiguousarray(n).view(np.int32)[:, 0].astype(np.int64)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["a", "b", "na", "nb", "o"]
        for g in sorted_groups(batches, ["bucket"]):
            cells = list(map(unpacked, g["data"]))
            token, cls, n = map(np.concatenate, zip(*cells))
            if g["bucket"].iloc[0] < 0:
                yield pd.DataFrame(dict(zip(columns, (token, cls, n, n, np.full(len(n), -1)))))
                continue
            cell = np.repeat(np.arange(len(cells)), [len(c[0]) for c in cells])
            order = np.lexsort((cell, cls, token))
            token, cls, n, cell = token[order], cls[order], n[order], cell[order]
            # a class has the same shingles in all cells: those of its first
            # stay, and if two of them look alike, both do
            head = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])]))
            once = cell == np.repeat(cell[head], np.diff(np.append(head, len(cell))))
            token, cls, n = token[once], cls[once], n[once]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(first, len(token)))
            few = np.repeat(size <= FEW, size)
            parts = []
            for step in range(1, FEW):
                x = np.flatnonzero((token[step:] == token[:-step]) & few[step:] & (cls[step:] != cls[:-step]))
                y = x + step
                near = (DEN * n[x] >= NUM * n[y]) & (DEN * n[y] >= NUM * n[x])
                parts.append(np.stack([cls[x[near]], cls[y[near]], n[x[near]], n[y[near]], np.ones(int(near.sum()), np.int64)]))
            pivot, head = np.repeat(cls[first], size), np.repeat(n[first], size)
            many = np.repeat(size > FEW, size)
            parts.append(np.stack([pivot[many], cls[many], head[many], n[many], np.zeros(int(many.sum()), np.int64)]))
            yield pd.DataFrame(np.concatenate(parts, axis=1).T, columns=columns).groupby(columns[:4], as_index=False)["o"].sum()

    dealt_out = src.select("text").mapInArrow(postings, "bucket int, data binary").repartition(width, "bucket").sortWithinPartitions("bucket")
    met = persist_table(dealt_out.mapInPandas(meet, "a long, b long, na long, nb long, o long"), "met")
    # with few classes to a shingle, pairs are counted: two similar sets share
    # so many of their prefixes that this leaves few others
    pairs = met.where("o > 0").groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o")).where((NUM + DEN) * F.col("o") >= F.least(_shared("na", "nb"), _shared("nb", "na")))
    pairs = persist_table(pairs, "pairs")
    joined = pairs.select(F.col("a").alias("pivot"), F.col("b").alias("cls"), F.col("nb").alias("n")).union(pairs.select("a", "a", "na"))
    # shingles of more classes gather a group about their smallest class; of
    # the hot ones, which any number of classes may hold, by map-side counts
    joined = joined.union(met.where("o = 0").select("a", "b", "nb"))
    warm = met.where("o < 0").select(F.col("a").alias("token"), F.col("b").alias("cls"), F.col("na").alias("n"))
    shared = warm.groupBy("token").agg(F.min("cls").alias("pivot"), F.max("cls").alias("other")).where("pivot < other").select("token", "pivot")
    joined = joined.union(warm.join(shared, "token").select("pivot", "cls", "n"))
    grouped = persist_table(joined.groupBy("pivot", "cls").agg(F.first("n").alias("n")), "grouped")
    members = persist_table(classes.join(few(grouped), "cls").select("pivot", "rep", "n", "bits", (F.col("cls") == F.col("pivot")).alias("is_pivot")), "members")
    drop_tables(met, pairs, grouped)
    groups = members.groupBy("pivot").agg(F.greatest(F.ceil(F.sum("n") / CHUNK_TOKENS), F.ceil(F.count("*") / chunk_rows)).cast("int").alias("chunks"))
    dealt = members.join(groups, "pivot").withColumn("chunk", F.pmod(F.xxhash64("rep", "pivot"), F.col("chunks")).cast("int"))

    def promising(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "pivot"):
            group, n = frame["pivot"].to_numpy(), frame["n"].to_numpy(np.int64)
            bitmaps = [np.frombuffer(b, np.uint64) for b in frame["bits"]]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.append(first, len(group)))
            small = np.flatnonzero(np.repeat(size <= LEAF, size))
            hit = np.zeros(len(group), bool)
            hit[small] = with_partner_leaves(group[small], [bitmaps[i] for i in small], n[small])
            for a, k in zip(first[size > LEAF], size[size > LEAF]):
                hit[a : a + k] = with_partner(bitmaps[a : a + k], n[a : a + k])
            yield frame.loc[hit, ["pivot", "rep"]]

    # groups of one chunk are thinned by their trees before any text moves
    single = dealt.where("chunks = 1").select("pivot", "rep", "n", "bits").repartition(width, "pivot").sortWithinPartitions("pivot")
    single = single.mapInPandas(promising, "pivot long, rep long").select("pivot", F.lit(0).alias("chunk"), F.lit(1).alias("chunks"), "rep")
    dealt = dealt.where("chunks > 1").drop("bits")
    spare = dealt.where("is_pivot and chunks > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    columns = ["pivot", "chunk", "chunks", "rep"]
    dealt = persist_table(dealt.select(*columns).union(spare.select(*columns)).union(single.select(*columns)).distinct(), "dealt")
    drop_tables(members)
    texts = src.where("text is not null").withColumnRenamed("row", "rep")
    # texts of the classes that have a group, once for each of their chunks
    tasks = texts.join(few(dealt), "rep").repartition(width, "pivot", "chunk").sortWithinPartitions("pivot", "chunk", "rep")

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, ["pivot", "chunk"]):
            if len(g) > 1:
                sets, ids = list(shingle_sets(pa.array(g["text"], pa.string()))), g["rep"].tolist()
                links = tree_links(sets, Links(ids))
                if links:
                    yield pd.DataFrame([(ids[i], ids[j]) for i, j in links], columns=["a", "b"])

    links = persist_table(tasks.select("pivot", "chunk", "rep", "text").mapInPandas(within, "a long, b long"), "links")
    large = dealt.where("chunks > 1").select("pivot", "chunk", "rep").distinct()
    if large.isEmpty():
        return links
    parts = connected_components(links).withColumnRenamed("node", "rep")
    named = persist_table(large.join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "named")
    weight = named.groupBy("pivot", "component").agg(F.count("*").alias("w"))
    best = weight.groupBy("pivot").agg(F.max_by("component", F.struct("w", -F.col("component"))).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rest = named.join(best, "pivot").where("component <> main").select("pivot", "rep", "component").distinct()
    rest_size = rest.groupBy("pivot").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("cuts"))
    rest = rest.join(rest_size, "pivot").withColumn("cut", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
    chunks = named.select("pivot", "chunk").distinct()
    side_a = rest.join(chunks, "pivot").select("pivot", "chunk", "cut", "rep", "component", F.lit(0).alias("side"))
    side_b = named.join(rest_size, "pivot").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("pivot", "chunk", "cut", "rep", "component", F.lit(1).alias("side"))
    cross = texts.join(few(persist_table(side_a.union(side_b), "sides")), "rep").repartition(width, "pivot", "chunk", "cut").sortWithinPartitions("pivot", "chunk", "cut", "side", "rep")

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, ["pivot", "chunk", "cut"]):
            sets, ids, side = list(shingle_sets(pa.array(g["text"], pa.string()))), g["rep"].tolist(), g["side"].to_numpy()
            if 0 < side.sum() < len(side) and (links := tree_links(sets, Links(g["component"].tolist()), side)):
                yield pd.DataFrame([(ids[i], ids[j]) for i, j in links], columns=["a", "b"])

    more = persist_table(cross.select("pivot", "chunk", "cut", "side", "rep", "component", "text").mapInPandas(between, "a long, b long"), "links")
    return links.union(more)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``__row``, written so that each row keeps it."""
    return persist_table(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")


def row_components(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``(row, id, anon, n_shingles, best)`` for each row of a numbered table.
    ``best`` is the row of its component with the smallest ``(anon, id, row)``,
    where ``anon`` marks a null id; null for a row without words."""
    number = rows[id_col].cast("long")
    src = rows.select(rows["__row"].alias("row"), F.coalesce(number, F.lit(0)).alias("id"), number.isNull().alias("anon"), rows[text_col].alias("text"))

    none = np.zeros(0, np.uint64)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                sets = list(shingle_sets(b.column(3)))
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                token, n = np.unique(np.concatenate([none, *(prefix(s, none) for s in sets)]), return_counts=True)
                # counts of the batch are held by its first row
                held = [[x, *[None] * (len(sets) - 1)][: len(sets)] for x in (token[n > 1].tobytes(), n[n > 1].astype(np.int64).tobytes())]
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(1), b.column(2), pa.array(list(map(len, sets)), pa.int64()), pa.array(digest, pa.binary()), pa.array(list(map(class_key, sets)), pa.int64()),
                    pa.array([bitmap_of(s).tobytes() if len(s) else None for s in sets], pa.binary()), pa.array(held[0], pa.binary()), pa.array(held[1], pa.binary()),
                ], ["row", "id", "anon", "n_shingles", "digest", "cls", "bits", "often", "times"])
        finally:
            release()

    facts = persist_table(src.mapInArrow(describe, "row long, id long, anon boolean, n_shingles long, digest binary, cls long, bits binary, often binary, times binary"), "facts")
    classes = facts.where("digest is not null").groupBy("digest", "cls").agg(F.min(F.struct("anon", "id", "row")).alias("best"), F.first("bits").alias("bits"))
    classes = persist_table(classes.withColumn("rep", F.col("best.row")), "classes")
    links = class_links(src.select("row", "text"), facts, classes.select("cls", "rep", "bits"), **kw)
    parts = connected_components(links)
    linked = persist_table(classes.select("digest", "rep", "best").join(parts, F.col("rep") == parts["node"]).select("digest", "component", "best"), "linked")
    first = linked.groupBy("component").agg(F.min("best").alias("best"))
    named = linked.select("digest", "component").join(first, "component").select("digest", F.col("best").alias("linked"))
    named = classes.select("digest", "best").join(named, "digest", "left").select("digest", F.coalesce("linked", "best").alias("best"))
    return facts.select("row", "id", "anon", "n_shingles", "digest").join(named, "digest", "left").drop("digest")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row."""
    found = row_components(numbered(docs.select(id_col, text_col)), id_col, text_col, **kw)
    own, best = F.when(~F.col("anon"), F.col("id")), F.when(~F.col("best.anon"), F.col("best.id"))
    return found.select(own.alias("doc_id"), "n_shingles", F.when(F.col("best").isNull(), own).otherwise(best).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one row of each group: of those with the smallest id, the
    first; a null id counts as the largest. Rows of no words belong to no group
    and stay. Neither null nor repeated ids lose a row or keep a copy."""
    rows = numbered(docs)
    found = row_components(rows, id_col, text_col, **kw).where("best is null or best.row = row").select(F.col("row").alias("__row"))
    return rows.join(found, "__row", "left_semi").select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLE: dict[str, str] = {}
