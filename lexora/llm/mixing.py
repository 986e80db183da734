"""Mixing sources to target weights, with DataFrame functions only.

Words of a source are laid end to end (documents in hash order) and packed into
blocks of ``BLOCK`` words. Output shards have ``SLOTS`` slots; each shard draws
its counts per source by one multinomial draw. Slots of a source are numbered
through. Draws have noise, and small sources would miss their targets by it, so
draws beyond a source's quota (some square root of them all) are given to the
sources that fell short. Number j maps to block permutation(j mod blocks) in
epoch j div blocks, where the permutation is a pseudorandom one for each source
and epoch (swap-or-not rounds), computed from the index alone. Slots and
documents meet by an equi-join on (source, block).

Targets: sources by code point, null last, weigh 3, 1, 2, repeating; they share
150 % of all words; a target stops at twice its source's words and the excess is
shared by weight among the others, which is one threshold on size/weight found
with running sums over the sources (one row each).

Prefix sums of documents go through buckets of a source, so no window holds
more than about ``BUCKET_ROWS`` rows of a hot source.

Edge cases: null and empty texts have size 0 and are never taken; a null source
is a source of its own; without any word all targets are 0; repeated rows and
ids are separate documents; results depend on the rows only, so reruns agree as
long as equal (id, text) rows are interchangeable; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexora.llm.common import WORD, persist_table, shuffle_width, table

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
BLOCK, SLOTS, ROUNDS, SEED = 256, 4096, 10, 20
BUCKET_ROWS = 2_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(source, source_size)`` with rank and target. The windows here run
    over one row per source."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("cap", cap * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    # water level if exactly the sources before this one stop at their caps
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level)
    # the first source, by size over weight, that the water does not fill
    ratio = F.col("cap") / F.col("w")
    final = F.min(F.when(F.col("level") <= ratio, F.struct(ratio.alias("r"), "rank", "level"))).over(everything)["level"]
    return ranked.withColumn("target", F.least("cap", F.coalesce(final, F.lit(float("inf"))) * F.col("w"))).drop("level", "cap")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1: in each round an index either
    stays or swaps with its mirror about a random point, by one hash bit of the
    pair."""

    def turn(acc: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, *key), n) + n - acc, n)
        bit = F.pmod(F.xxhash64(F.greatest(acc, mirror), r, *key), F.lit(2))
        return F.when(bit == 1, mirror).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), turn)


def _sized(id_col: str, text_col: str, source_col: str) -> list[Column]:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    h = F.xxhash64(F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h")
    return [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size, h]


def size_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(rid, doc_id, source, size, h)``, written once; text is read once."""
    return persist_table(docs.select(F.monotonically_increasing_id().alias("rid"), *_sized(id_col, text_col, source_col)), "sized")


def quotas(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sources with their blocks and the blocks that the mix takes of them
    (``quota``: the target in blocks, cumulatively rounded), laid on a line:
    ``lo`` to ``hi``."""
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    want = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    line = sources.withColumn("blocks", blocks).withColumn("upto", F.sum(want).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    line = line.withColumn("hi", F.round("upto").cast("long"))
    line = line.withColumn("lo", F.lag("hi", 1, 0).over(Window.orderBy("rank")))
    return line.withColumn("quota", F.col("hi") - F.col("lo")).drop("upto")


def draw(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``(shard, rank, n)``: for each output shard one multinomial draw of its
    slots, with the quotas as weights. A slot's number alone decides its draw,
    so slots are drawn where they are and counted map-side."""
    spark = sources.sparkSession
    total, n_sources = sources.agg(F.coalesce(F.max("hi"), F.lit(0)), F.count("*")).first()
    cells = min(max(1, total), max(4096, 4 * n_sources))
    parts = max(spark.sparkContext.defaultParallelism, total // 1_000_000)
    at = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(max(1, total)))
    drawn = spark.range(0, total, 1, parts).select(F.floor(F.col("id") / slots).alias("shard"), at.alias("v")).withColumn("cell", F.floor(F.col("v") * F.lit(cells) / F.lit(max(1, total))))
    # a few sources overlap each cell of the line
    cell = lambda x: F.floor(x * F.lit(cells) / F.lit(max(1, total)))
    spread = sources.where("quota > 0").select("rank", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"))
    hit = drawn.join(spread, "cell").where("v >= lo and v < hi")
    return hit.groupBy("shard", "rank").agg(F.count("*").alias("n"))


def plan_mix(sized: DataFrame, block: int = BLOCK, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """The sources with targets, and the mix: ``(rank, shard, slot, epoch,
    block)`` with one row per output block."""
    spark = sized.sparkSession
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = persist_table(quotas(sources, block).coalesce(1), "sources")
    draws = persist_table(draw(sources, slots), "draws")
    # running numbers of a source's slots, in two levels of shards
    draws = draws.withColumn("super", F.floor(F.col("shard") / 4096))
    above = draws.groupBy("rank", "super").agg(F.sum("n").alias("b"))
    above = above.withColumn("base", F.sum("b").over(Window.partitionBy("rank").orderBy("super")) - F.col("b")).drop("b")
    draws = draws.withColumn("inner", F.sum("n").over(Window.partitionBy("rank", "super").orderBy("shard")) - F.col("n"))
    draws = draws.withColumn("slot0", F.sum("n").over(Window.partitionBy("shard").orderBy("rank")) - F.col("n"))
    draws = draws.join(above, ["rank", "super"]).withColumn("first", F.col("base") + F.col("inner"))
    # draws beyond a source's quota go to the sources that fell short of theirs
    held = draws.groupBy("rank").agg(F.sum("n").alias("drawn"))
    line = Window.orderBy("rank")
    over, short = F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))
    known = sources.select("rank", "quota", "blocks").join(held, "rank", "left").fillna(0, ["drawn"]).withColumn("over", over).withColumn("short", short)
    known = known.withColumn("over0", F.sum("over").over(line) - F.col("over")).withColumn("short0", F.sum("short").over(line) - F.col("short"))
    known = persist_table(known, "known")
    spots = draws.join(known, "rank").repartition(shuffle_width(spark), "shard", "rank")
    spots = spots.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("j", F.col("first") + F.col("i"))
    spots = spots.select("rank", "shard", (F.col("slot0") + F.col("i")).alias("slot"), "j", "blocks", "quota", (F.col("over0") + F.col("j") - F.col("quota")).alias("e"))
    needs = known.where("short > 0").withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("short") - 1)))
    needs = needs.select((F.col("short0") + F.col("t")).alias("e"), "rank", (F.col("drawn") + F.col("t")).alias("j"), "blocks")
    moved = spots.where("j >= quota").select("e", "shard", "slot").join(needs, "e")
    mix = spots.where("j < quota").select("rank", "shard", "slot", "j", "blocks").union(moved.select("rank", "shard", "slot", "j", "blocks"))
    epoch = F.floor(F.col("j") / F.col("blocks"))
    mix = mix.select("rank", "shard", "slot", epoch.alias("epoch"), permuted(F.pmod("j", "blocks"), F.col("blocks"), F.col("rank"), epoch).alias("block"))
    return sources, mix


def place(known: DataFrame, buckets: int) -> DataFrame:
    """``known`` documents that have words, with ``a``, the place of their
    first word in their source."""
    placed = known.where("size > 0").withColumn("bucket", F.pmod("h", F.lit(buckets)))
    inner = Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size", "rid")
    sums = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("b"))
    sums = sums.withColumn("base", F.sum("b").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("b")).drop("b")
    upto = placed.withColumn("upto", F.sum("size").over(inner))
    return upto.join(sums, ["rank", "bucket"]).withColumn("a", F.col("base") + F.col("upto") - F.col("size")).drop("bucket", "base", "upto")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """One row per document: ``rid, doc_id, size, source_size, target, taken``."""
    sized = size_documents(docs, id_col, text_col, source_col)
    sources, mix = plan_mix(sized, block, slots)
    known = sized.join(sources.select("source", "rank", "source_size", "target"), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = place(known, max(1, sized.count() // BUCKET_ROWS))
    cut = placed.select("rid", "rank", "a", (F.col("a") + F.col("size")).alias("z"))
    cut = cut.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("z") - 1) / block))))
    cut = cut.withColumn("words", F.least("z", (F.col("block") + 1) * block) - F.greatest("a", F.col("block") * block))
    use = mix.groupBy("rank", "block").agg(F.count("*").alias("times"))
    # the optimiser takes the exploded slots for as small as the sources table
    taken = cut.join(use.hint("merge"), ["rank", "block"]).groupBy("rid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return known.join(taken, "rid", "left").select("rid", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """The mix itself: ``(shard, slot, source, words)``, one row per output
    block of up to ``block`` words. Each document is cut where its source's
    blocks end, blocks are packed from the pieces, and slots fetch blocks by
    index."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), F.monotonically_increasing_id().alias("rid"))
    keyed = persist_table(keyed, "numbered")
    sized = persist_table(keyed.select("rid", *_sized("doc_id", "text", "source")), "sized")
    sources, mix = plan_mix(sized, block, slots)
    known = sized.join(sources.select("source", "rank"), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = place(known, max(1, sized.count() // BUCKET_ROWS)).select("rid", "rank", "a", (F.col("a") + F.col("size")).alias("z"))
    words = keyed.select("rid", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w")).join(placed, "rid")

    def piece(b: Column) -> Column:
        start, stop = F.greatest(F.col("a"), b * block), F.least(F.col("z"), (b + 1) * block)
        return F.struct(b.alias("block"), start.alias("at"), F.slice("w", (start - F.col("a") + 1).cast("int"), (stop - start).cast("int")).alias("w"))

    pieces = words.select("rank", F.explode(F.transform(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("z") - 1) / block)), piece)).alias("p")).select("rank", "p.*")
    # at most ``block`` pieces to a block
    packed = pieces.groupBy("rank", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"])).alias("words"))
    return mix.join(packed.hint("merge"), ["rank", "block"]).join(sources.select("rank", "source"), "rank").select("shard", "slot", "source", "words")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """``docs`` as the mix takes them: a document appears taken/size times,
    rounded up or down by a hash of its columns so that the expectation is
    exact: at most twice; documents of no words are not taken. Same columns."""
    key = F.xxhash64(*[F.col(c).cast("string") for c in docs.columns if docs.schema[c].dataType.typeName() in ("string", "long", "integer")])
    numbered = docs.withColumn("__row", key)
    mixed = mix_documents(numbered, "__row", **kw).groupBy(F.col("doc_id").alias("__row")).agg(F.first("size").alias("__size"), F.avg("taken").alias("__taken"))
    u = F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("__row")), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(F.col("__taken") / F.col("__size") + u).cast("int")
    return numbered.join(mixed.where("__size > 0"), "__row").withColumn("__n", times).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("rid")


QUERIES = {"op10_mixing": op10_mixing}
ORACLE: dict[str, str] = {}
