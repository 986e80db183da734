"""Removal of repeated byte strings by column-wise suffix ordering.

Every byte that lies in a ``length``-byte string which starts at two or more
places (of the same or different documents) is removed.

Co-location. For each window of ``length`` bytes the anchor is its leftmost
smallest hash of ``ANCHOR`` bytes. Equal windows have equal anchors at equal
offsets, so windows are dealt by anchor: a document becomes segments, one per
run of windows with the same anchor (one per ~100 bytes), each known by the
anchor's hash and its content's. One aggregation over these small rows tells
which segment contents occur twice or more (all their windows repeat) and which
anchors have only one content (none of theirs does). Only the contents between,
of anchors with several, are ordered as suffixes.

Ordering. The segments of a task are aligned at their anchors and their
collection is built column-wise, from the right: each round inserts one symbol
of every segment, turning the order of the suffixes that start one column to the
right into the order at this column, and updating the collection's
Burrows-Wheeler transform and common prefixes. Since symbols are told apart by
column, a round only appends to the transform; a round's symbols and prefixes go
to sequential external files. A second sequential reading rebuilds each order
from the transform and finds the windows whose common prefix with a neighbour
reaches ``length``. Equal segments are one row with their number of copies.
Memory is one task's segments, bounded by ``TASK_BYTES``.

Anchors with more than ``GROUP_LIMIT`` distinct contents are not gathered in a
task: their windows are counted by 128-bit content hash, an aggregation that
combines map-side; with equal results.

Edge cases: null is empty; texts below ``length`` bytes keep all; overlapping
occurrences count; a document of one repeated byte collapses entirely, its first
copy included; repeated rows remove each other; rows are told apart by scan
position, so repeated ids are separate; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.llm.common import drop_tables, persist_table, shuffle_width, table

LENGTH, ANCHOR = 400, 200
GROUP_LIMIT, TASK_BYTES = 20_000, 24_000_000
PIECE = 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _B)]), dtype=np.uint64)
            _INV = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _B_INV)]), dtype=np.uint64)
    return _POW[:n], _INV[:n]


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string, from one running sum."""
    n = len(raw)
    with np.errstate(over="ignore"):
        power, inverse = _powers(n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])
        h = (total[k:] - total[:-k]) * inverse[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, size = v, 1
    while size < w:
        step = min(size, w - size)
        out = np.minimum(out[: len(out) - step], out[step:])
        size += step
    return out


def segments(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First windows, last windows, anchor places and anchor hashes of the
    runs. Texts beyond PIECE bytes are cut in pieces of windows; a run that a
    piece's end cuts is two runs with the same anchor, which is allowed."""
    firsts, lasts, places, hashes = [], [], [], []
    n = len(data) - length + 1
    low = np.uint64((1 << 24) - 1)
    for base in range(0, max(n, 0), PIECE):
        raw = np.frombuffer(data, np.uint8)[base : min(base + PIECE, n) + length - 1]
        h = gram_hashes(raw, anchor)
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        best = (sliding_min(packed, length - anchor + 1) & low).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        firsts.append(base + start)
        lasts.append(base + np.concatenate([start[1:], [len(best)]]) - 1)
        places.append(base + best[start])
        hashes.append(h[best[start]])
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(map(np.concatenate, (firsts, lasts, places, hashes)))  # type: ignore[return-value]


def repeated_windows(rows: list[tuple[int, bytes, int]], multiple: list[int], length: int = LENGTH) -> np.ndarray:
    """Column-wise construction over segments ``(group, content, anchor
    offset)``; a segment with ``multiple`` over 1 stands for so many copies.
    Returns a flag per segment and column, columns counted from the left of the
    widest alignment, and is True where a window that starts there repeats."""
    n = len(rows)
    left = max(r[2] for r in rows)
    width = left + max(len(r[1]) - r[2] for r in rows)
    matrix = np.zeros((width, n), np.uint8)  # 0 is no symbol; bytes of UTF-8 text may be 0, so shift
    mask = np.zeros((width, n), bool)
    for i, (_, content, off) in enumerate(rows):
        a = left - off
        matrix[a : a + len(content), i] = np.frombuffer(content, np.uint8)
        mask[a : a + len(content), i] = True
    group = np.unique([r[0] for r in rows], return_inverse=True)[1].astype(np.int64)
    order = np.argsort(group, kind="stable")
    lcp = np.zeros(n + 1, np.int32)  # lcp[i]: with the neighbour before; lcp[n] = 0
    first = order
    with tempfile.TemporaryFile() as transform, tempfile.TemporaryFile() as prefixes:
        for t in range(width - 1, -1, -1):
            # the symbols before the ordered suffixes: this column's part of the
            # Burrows-Wheeler transform, from which the next order follows
            code = np.where(mask[t, order], matrix[t, order].astype(np.uint16) + 1, 0).astype(np.uint16)
            turn = _insert(group, order, code)
            # the neighbours' common prefix: 1 + the least of those between
            same = np.zeros(n + 1, bool)
            key = (group[order] << 9) | code
            ks = key[turn]
            same[1:n] = (ks[1:] == ks[:-1]) & (code[turn][1:] > 0)
            new = np.zeros(n + 1, np.int32)
            at = np.flatnonzero(same)
            lo, hi = turn[at - 1] + 1, turn[at]
            near = lo == hi
            new[at[near]] = lcp[hi[near]] + 1
            far = ~near
            if far.any():
                cut = np.empty(2 * int(far.sum()), np.int64)
                cut[0::2], cut[1::2] = lo[far], hi[far] + 1
                new[at[far]] = np.minimum.reduceat(lcp, cut)[0::2] + 1
            order, lcp = order[turn], new
            transform.write(code.tobytes())
            prefixes.write(lcp.astype("<i4").tobytes())
        for file in (transform, prefixes):
            file.flush()
            file.seek(0)
        out = np.zeros((n, width), bool)
        many = np.array(multiple) > 1
        order = first
        for t in range(width - 1, -1, -1):  # orders come back from the transform
            order = order[_insert(group, order, np.frombuffer(transform.read(2 * n), np.uint16))]
            c = np.frombuffer(prefixes.read(4 * (n + 1)), "<i4")
            hit = (c[:n] >= length) | (c[1:] >= length) | many[order]
            out[order[hit], t] = True
    return out


def _insert(group: np.ndarray, order: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Where the suffixes of an order go when these symbols come before them:
    a stable sort by symbol within each group."""
    return np.argsort((group[order] << 9) | code, kind="stable")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(rid, a, b)``: spans of window starts a..b-1 that repeat, of
    ``docs(rid, text)``; a row may have several, in any order."""
    spark = docs.sparkSession

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 200):  # a frame for 200 documents
                parts: list[tuple] = []
                part = b.iloc[at : at + 200]
                for rid, text in zip(part["rid"].tolist(), part["text"]):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    first, last, place, h = segments(data, length, anchor)
                    view = memoryview(data)
                    dig = b"".join(xxhash.xxh3_128_digest(view[a : z + length]) for a, z in zip(first.tolist(), last.tolist()))
                    parts.append((_signed(h), np.frombuffer(dig, ">i8").reshape(-1, 2), np.full(len(first), rid), first, last + 1, place - first))
                h, dig, rid, a, z, off = map(np.concatenate, zip(*parts))
                yield pd.DataFrame({"anchor": h, "d1": dig[:, 0].astype(np.int64), "d2": dig[:, 1].astype(np.int64), "rid": rid, "a": a.astype(np.int64), "z": z.astype(np.int64), "off": off.astype(np.int32)})

    # place within a segment is part of its identity: the same bytes may be cut
    # with another anchor offset only if the anchor differs
    segs = persist_table(docs.select("rid", "text").mapInPandas(cut, "anchor long, d1 long, d2 long, rid long, a long, z long, off int"), "segments")
    kinds = persist_table(
        segs.groupBy("anchor", "d1", "d2", "off").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "a", "z")).alias("at")), "kinds"
    )
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 and least = 1")
    many = kinds.where("copies > 1").select("anchor", "d1", "d2", "off")
    whole = persist_table(segs.join(many, ["anchor", "d1", "d2", "off"]).select("rid", "a", F.col("z").alias("b")), "whole")
    drop_tables(segs)
    # contents are cut from the documents where their first copy is
    wanted = kinds.join(groups.drop("least"), "anchor").select("anchor", "off", "copies", "kinds", "at.*")
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("anchor", "off", "copies", "kinds", "a", "z")).alias("need"))
    source = docs.select("rid", "text").join(lists, "rid")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["anchor", "kinds", "copies", "rid", "a", "off", "content"]
        for b in batches:
            rows: list[tuple] = []
            for rid, text, need in zip(b["rid"].tolist(), b["text"], b["need"]):
                data = text.encode("utf-8", "surrogatepass")
                rows.extend((x["anchor"], x["kinds"], x["copies"], rid, x["a"], x["off"], data[x["a"] : x["z"] + length - 1]) for x in need)
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    contents = persist_table(source.mapInPandas(fetch, "anchor long, kinds long, copies long, rid long, a long, off int, content binary"), "contents")
    tasks = contents.where(F.col("kinds") <= group_limit).repartition(shuffle_width(spark), "anchor").sortWithinPartitions("anchor")

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def flush() -> pd.DataFrame:
            flags = repeated_windows([(h[0], h[5], h[4]) for h in held], [h[1] for h in held], length)
            left, rows = max(h[4] for h in held), []
            for h, f in zip(held, flags):
                if h[1] == 1:  # copies are reported as a whole
                    for a, b in zip(*_runs(f)):
                        rows.append((h[2], h[3] + int(a) - left + h[4], h[3] + int(b) - left + h[4]))
            return pd.DataFrame(rows, columns=["rid", "a", "b"]).astype("int64")

        for b in batches:
            for row in b[["anchor", "copies", "rid", "a", "off", "content"]].itertuples(index=False, name=None):
                if held and row[0] != held[-1][0] and (len(held) >= 4000 or size > TASK_BYTES):
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush()

    ordered = tasks.mapInPandas(order, "rid long, a long, b long")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rid, a, copies, content in zip(b["rid"], b["a"], b["copies"], b["content"]):
                dig = [xxhash.xxh3_128_intdigest(content[i : i + length]) for i in range(len(content) - length + 1)]
                yield pd.DataFrame({"d1": np.array([d >> 64 for d in dig], np.uint64).view(np.int64), "d2": np.array([d & (1 << 64) - 1 for d in dig], np.uint64).view(np.int64), "rid": rid, "a": a + np.arange(len(dig)), "copies": copies})

    hot = contents.where(F.col("kinds") > group_limit).select("rid", "a", "copies", "content").mapInPandas(windows, "d1 long, d2 long, rid long, a long, copies long")
    again = hot.groupBy("d1", "d2").agg(F.sum("copies").alias("n")).where("n > 1").drop("n")
    single = hot.where("copies = 1").join(again, ["d1", "d2"]).select("rid", "a", (F.col("a") + 1).alias("b"))
    spans = persist_table(whole.unionByName(ordered).unionByName(single), "spans")
    drop_tables(whole, kinds, contents)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, group_limit: int = GROUP_LIMIT, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per document,
    and with ``with_text`` the kept bytes."""
    src = persist_table(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid")), "numbered")
    spans = repeated_spans(src, length, anchor, group_limit)
    # lists are bounded by their document
    lists = spans.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    full = src.join(lists, "rid", "left")
    kind = full.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, spans in zip(b["doc_id"], b["text"], b["spans"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                kept, removed, runs = data, 0, 0
                if spans is not None and len(spans):
                    ab = np.array([(x["a"], x["b"]) for x in spans], np.int64)
                    delta = np.zeros(len(data) + 1, np.int64)
                    np.add.at(delta, ab[:, 0], 1)
                    np.add.at(delta, ab[:, 1] - 1 + length, -1)
                    gone = np.cumsum(delta[:-1]) > 0
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    removed, runs = int(gone.sum()), len(_runs(gone)[0])
                row = (doc, len(data), removed, runs, hashlib.sha256(kept).hexdigest())
                rows.append(row + (kept,) if with_text else row)
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    return full.select("doc_id", "text", "spans").mapInPandas(apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))


def op1_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op1_dedup": op1_dedup}
ORACLE: dict[str, str] = {}
