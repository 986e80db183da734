"""Operators over the whole corpus against brute force: repeats, Jaccard join,
nearest neighbours, sharding, mixing, and the pipeline."""

import hashlib
import os
import random
from collections import Counter, defaultdict
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexora.llm import ann, dedup, jaccard, mixing, sharding
from lexora.llm.common import connected_components, table

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, rid string, a int")


def plain_repeats(texts, length):
    seen = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[hashlib.blake2b(d[i : i + length], digest_size=16).digest()] += 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[hashlib.blake2b(d[i : i + length], digest_size=16).digest()] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        hit = np.cumsum(gone)[:-1] > 0 if len(d) else np.zeros(0, bool)
        edges = np.diff(np.concatenate([[0], hit.astype(int), [0]]))
        kept = bytes(c for c, h in zip(d, hit) if not h)
        out.append((len(d), int(hit.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [20_000, 2])
def test_repeats_match_brute_force(spark, limit):
    rnd = random.Random(limit)
    texts = [None, "", "short", "a" * 300, "ab" * 200, "x" * 39, "é" * 50]
    shared = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(30, 200))) for _ in range(8)]
    for _ in range(60):
        parts = [rnd.choice(shared) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 90))) for _ in range(rnd.randint(1, 5))]
        t = "".join(parts)
        texts.append(t[: rnd.randint(0, len(t))] + rnd.choice("qrstuv") + t[5:])
    texts += [texts[-1], texts[-1]]
    got = {r.doc_id: tuple(r)[1:] for r in dedup.remove_repeats(docs_of(spark, texts), length=40, anchor=16, group_limit=limit).collect()}
    want = plain_repeats(texts, 40)
    assert [got[i] for i in range(len(texts))] == want
    assert dedup.remove_repeats(docs_of(spark, texts).limit(0)).count() == 0


def test_repeats_of_the_query(spark):
    texts = [r.text for r in table(spark, SMALL, "documents").orderBy("doc_id").collect()]
    got = sorted(tuple(r) for r in dedup.op1_dedup(spark, SMALL).collect())
    assert [g[1:] for g in got] == plain_repeats(texts, 400)


def test_long_text_is_cut_in_pieces():
    rnd = random.Random(9)
    part = "".join(rnd.choice("abcdef") for _ in range(700)).encode()
    data = part + bytes(rnd.choice(b"ghijkl") for _ in range(dedup.PIECE - 300)) + part
    first, last, place, h = dedup.segments(data)
    assert first[0] == 0 and last[-1] == len(data) - 400 and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place + dedup.ANCHOR <= first + 400)).all()
    assert len(set(h[first < 250]) & set(h[first > dedup.PIECE])) > 0


def plain_components(texts):
    sets = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in where[g]:
                if j < i:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("chunk", [2000, 3])
def test_jaccard_components(spark, chunk):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    boiler = [rnd.choice(vocab) for _ in range(30)]
    texts = [None, "", "  ", "one two", "ONE two", "one two three four five", "É a b c d e", "é a b c d e"]
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(6, 120))] + (boiler if rnd.random() < 0.5 else [])
        for _ in range(rnd.choice([1, 1, 2, 12])):
            words = list(base)
            for _ in range(rnd.randint(0, 6)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            texts.append(" ".join(words))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs_of(spark, texts), hot_limit=3, chunk_rows=chunk).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts)


@pytest.mark.parametrize("bits", [0, 3])
def test_jaccard_of_shingles_that_look_alike(spark, bits):
    rnd = random.Random(bits)
    texts = []
    for _ in range(30):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.randint(5, 90))]
        for _ in range(rnd.choice([1, 2, 2, 9])):
            words = list(base)
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(300)}"
            texts += [" ".join(words)] * rnd.choice([1, 1, 2])  # copies of a class in several batches
    rnd.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs_of(spark, texts), hot_limit=3, token_bits=bits).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts)


def test_jaccard_writes_less_than_its_input(spark, monkeypatch):
    size = {}

    def persist(df, what, keep=jaccard.persist_table):
        out = keep(df, what)
        size[what] = size.get(what, 0) + sum(os.path.getsize(urlparse(f).path) for f in out.inputFiles())
        return out

    monkeypatch.setattr(jaccard, "persist_table", persist)
    jaccard.near_duplicates(table(spark, SF, "documents")).count()
    own = size.pop("rows")
    assert sum(size.values()) < 0.75 * own, size


def test_jaccard_of_the_query(spark):
    rows = table(spark, SF, "documents").orderBy("doc_id").collect()
    want = plain_components([r.text for r in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op5_jaccard_join(spark, SF).collect()}
    assert got == {r.doc_id: (n, rows[c].doc_id) for r, (n, c) in zip(rows, want)}
    assert jaccard.near_duplicates(table(spark, SF, "documents").limit(0)).count() == 0


def test_jaccard_of_null_and_repeated_ids(spark):
    word = lambda k, n=30: " ".join(f"{k}{i}" for i in range(n))
    big = (1 << 60) + 1
    rows = [
        (None, word("a")), (None, word("a") + " end"), (None, word("b")),  # near copies without ids, one alone
        (5, word("c")), (2, word("c")), (5, word("d")),  # a class named by 2, and its id again
        (7, word("e")), (7, word("e")), (7, word("e") + " end"),  # copies with one id
        (None, word("f")), (big, word("f")),
        (None, ""), (None, None), (7, " "),
    ]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").coalesce(1)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.n for r in kept.collect()) == [0, 2, 4, 5, 6, 10, 11, 12, 13]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    assert got == Counter([(None, 26, None), (None, 27, None), (None, 26, None), (5, 26, 2), (2, 26, 2), (5, 26, 5), (7, 26, 7), (7, 26, 7), (7, 27, 7), (None, 26, big), (big, 26, big), (None, 0, None), (None, 0, None), (7, 0, 7)])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


def test_nearest_recall_scores_and_edges(spark):
    rows = table(spark, SF, "embeddings")
    got = ann.op6_nearest(spark, SF).collect()
    data = rows.collect()
    ids = np.array([r.vec_id for r in data])
    x = np.array([r.embedding for r in data], float)
    hits = total = 0
    per = defaultdict(list)
    for r in got:
        per[r.query_id].append(r)
    assert set(per) == {i for i in ids.tolist() if i % 100 == 0}
    for q, rs in per.items():
        rs.sort(key=lambda r: r["rank"])
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        assert [r["rank"] for r in rs] == list(range(1, 11))
        assert all(abs(r.score - d[ids == r.vec_id][0]) < 1e-12 for r in rs)
        assert [(r.score, r.vec_id) for r in rs] == sorted((r.score, r.vec_id) for r in rs)
        true = sorted((v, i) for v, i in zip(d.tolist(), ids.tolist()) if i != q)[:10]
        hits += len({i for _, i in true} & {r.vec_id for r in rs})
        total += 10
    assert hits / total >= 0.9
    odd = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "e") for i, v in odd], "vec_id long, embedding array<float>, rank string")
    out = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, df.where("vec_id in (0, 2, 3)")).collect())
    assert out == [(0, 1, 1), (0, 2, 7), (0, 3, 6)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_recall_over_blocks(spark):
    x = np.random.default_rng(3).standard_normal((12_000, 48)).astype("float32")
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 200 = 0")
    got = defaultdict(set)
    for r in ann.nearest(df, asked).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q, found in got.items():
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(got) == 60 and hits / 600 >= 0.9
    forest = ann.Forest(x[:4000].astype(float), 16)
    want = [len(c) for c in forest.candidates(x[:30].astype(float), 400)]
    assert min(want) >= 400 and np.mean(want) < 800  # the ascent stops near what it was asked for


def test_sharding_splits_only_what_is_too_large(spark):
    rnd = random.Random(5)
    rows = [(i, "x" * rnd.randint(0, 400)) for i in range(500)] + [(None, None), (7, "y" * 3000), (8, "z" * 900), (8, "z" * 900)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard_docs_ int")
    got = sharding.assign(df, limit_bytes=1500).collect()
    assert len(got) == len(rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.depth, r.prefix].append(r)
        assert r.address >> (60 - r.depth) == r.prefix if r.depth else r.prefix == 0
    for (depth, prefix), rs in shards.items():
        size = sum(r.n_bytes for r in rs)
        assert size == rs[0].shard_bytes and len(rs) == rs[0].shard_docs
        assert size <= 1500 or (rs[0].oversized and depth == 60)
        if depth:  # the parent did not fit
            assert sum(r.n_bytes for r in got if r.address >> (61 - depth) == prefix >> 1) > 1500
    assert sharding.assign(df.limit(0)).count() == 0
    few = sharding.assign(df, limit_bytes=1500, step=3)  # several passes
    key = lambda r: (r.doc_id or 0, r.n_bytes, r.shard)
    assert sorted(map(key, few.collect())) == sorted(map(key, got))
    clash = df.limit(5).withColumns({"prefix": F.lit("p"), "n_bytes": F.lit("n"), "shard": F.lit("s"), "depth": F.lit("d")})
    out = sharding.assign(clash)
    assert out.columns == [*clash.columns, "address", "n_bytes_", "depth_", "prefix_", "shard_bytes", "shard_docs", "oversized", "shard_"]
    assert {(r.prefix, r.n_bytes, r.shard, r.depth) for r in out.collect()} == {("p", "n", "s", "d")}


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix_reaches_its_targets(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 300)), rnd.choice(["a", "b", "B", None, "é", "small"][: 6 if i < 40 else 5])) for i in range(3000)] + [(1, None, "a"), (2, "", "void")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, target int")
    got = mixing.mix_documents(df, block=32, slots=64).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    by_target = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_target[r.target, r.source_size] += r.taken
    assert len(by_target) == len({(round(want[s], 6), sizes[s]) for s in order})
    for s in order:
        key = next(k for k in by_target if abs(k[0] - want[s]) < 1e-6 * max(1, want[s]) and k[1] == sizes[s])
        assert abs(by_target[key] - want[s]) <= max(64, 0.03 * want[s]), s
    again = mixing.mix_documents(df.repartition(5), block=32, slots=64)
    strip = lambda rs: sorted((r.doc_id, r.size, r.taken) for r in rs)
    assert strip(got) == strip(again.collect())
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 4
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_mix_by_brute_force(spark):
    """Words taken, counted from the blocks that the slots name."""
    rnd = random.Random(8)
    rows = [(i, " ".join([f"d{i}"] * rnd.randint(0, 90)), rnd.choice("aaaab") if i else "tiny") for i in range(300)] + [(7, "d7 d7", "a")] * 3 + [(400, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    block, slots = 16, 32
    sized = mixing.size_documents(df)
    sources, mix = mixing.plan_mix(sized, block, slots)
    src = {r["rank"]: r for r in sources.collect()}
    names = {r.source: k for k, r in src.items()}
    line, at = {}, defaultdict(int)
    for r in sorted(sized.collect(), key=lambda r: (r.h % 1, r.h)):  # one bucket
        line[r.rid] = (names[r.source], at[names[r.source]], r.size, r.doc_id)
        at[names[r.source]] += r.size
    rows_of_mix = mix.collect()
    times = Counter((r["rank"], r.block) for r in rows_of_mix)
    want = defaultdict(int)
    for rank, a, size, doc in line.values():
        want[doc] += sum(times[rank, w // block] for w in range(a, a + size))
    got = defaultdict(int)
    for r in mixing.mix_documents(df, block=block, slots=slots).collect():
        got[r.doc_id] += r.taken
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    # every slot of every shard once, quotas met, shards drawn apart
    assert len({(r.shard, r.slot) for r in rows_of_mix}) == len(rows_of_mix) == sum(r.quota for r in src.values())
    assert {k: v for k, v in Counter(r["rank"] for r in rows_of_mix).items()} == {k: r.quota for k, r in src.items() if r.quota}
    assert len({(r["rank"], r.epoch, r.block) for r in rows_of_mix}) == len(rows_of_mix)
    big = names["a"]
    counts = Counter(r.shard for r in rows_of_mix if r["rank"] == big)
    assert len(set(counts.values())) > 3  # draws, not equal shares
    said = Counter(w for r in mixing.mixed_blocks(df, block=block, slots=slots).collect() for w in r.words)
    assert {int(w[1:]): n for w, n in said.items()} == {k: v for k, v in got.items() if v}


def test_permutation_is_one(spark):
    for n in (1, 2, 17, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))
        assert n < 100 or got != list(range(n))


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from lexora.llm import pii
    from tests.llm.test_text_operators import plain_quality

    docs = table(spark, SMALL, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = cp.quality_stage(spark, docs, SMALL)
    good = {i for i, r in rows.items() if plain_quality(r.text)[-1]}
    assert {r.doc_id for r in kept.collect()} == good and kept.schema == docs.schema
    one = cp.near_duplicate_stage(spark, kept, SMALL)
    ids = sorted(good)
    parts = plain_components([rows[i].text for i in ids])
    assert {r.doc_id for r in one.collect()} == {ids[c] for _, c in parts} and one.schema == docs.schema
    clean = cp.personal_data_stage(spark, one, SMALL)
    texts = [r.text for r in clean.collect()]
    assert len(texts) == one.count() and clean.columns == docs.columns and not any(pii.base_spans(t) for t in texts)
    mixed = cp.mixing_stage(spark, clean, SMALL)
    n = mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert mixed.columns == docs.columns and 1 <= n <= 2
    out = cp.run(spark, SMALL)
    assert out.count() == mixed.count() > 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [len(cp.STAGES), cp.ORACLE_SQL] == [5, None]
