"""Language by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text. A text is parsed against each automaton into longest matches; with n
letters of training text and m characters parsed into p phrases the entropy
estimate is p * log2(n) / m, and the smallest wins. Texts are cut in blocks of
``BLOCK`` characters, and all blocks of a batch advance through an automaton
together, one character a step; a second pass from the states in which the
blocks before ended makes the phrases those of one parse of the whole text. A
character of no language's sample is code 0, which no automaton has seen.

The sample is the only thing learned: at most ``rows`` distinct labelled texts a
language, chosen by hash, each giving up to ``row_chars`` characters to the training text
of at most ``chars`` characters. It is bounded, so it travels in the task
closure. Prediction is row-local.

Edge cases: null text, or text without a letter, gives ``und`` and score 0; no
labelled row at all gives ``und`` everywhere; ties go to the smaller language
name; repeated rows agree; null ids are held out or not by the crc of ''.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexora.llm.bpe import IntMap
from lexora.llm.common import release, table, text_slices

ROWS, ROW_CHARS, CHARS = 200, 400, 40_000
BLOCK = 1024
#: Bytes of text that are parsed together; entries of a dense transition table.
GROUP_BYTES, DENSE = 4_000_000, 1 << 24


def plain(text: str) -> np.ndarray:
    """Lower-case code points; runs of other than letters become one space."""
    low = text.lower()
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = np.fromiter(map(str.isalpha, low), bool, len(low)) if not low.isascii() else ((code >= 97) & (code <= 122))
    out = np.where(keep, code, 32)
    gap = out == 32
    return out[~(gap & np.concatenate([[True], gap[:-1]]))] if len(out) else out


class Automaton:
    """Suffix automaton of a text of integers (1..width-1). Its transitions are
    a dense table, or a hash map where that would be large; 0 is none. State 0
    is nowhere, 1 the root."""

    def __init__(self, seq: list[int], width: int):
        size = 2 * len(seq) + 3
        nxt: list[dict[int, int]] = [{}, {}]
        link, length = [0, 0], [0, 0]
        last = 1
        for c in seq:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(1)
            p = last
            while p and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        assert len(nxt) <= size
        self.width = width
        keys = np.fromiter((s * width + c for s, row in enumerate(nxt) for c in row), np.int64)
        to = np.fromiter((t for row in nxt for t in row.values()), np.int64, len(keys))
        if len(nxt) * width <= DENSE:
            self.table = np.zeros(len(nxt) * width, np.int32)
            self.table[keys] = to
        else:
            self.table, self.sparse = None, IntMap(keys, to, 0)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        at = state * self.width + code
        return self.table[at].astype(np.int64) if self.table is not None else self.sparse.get(at)

    def advance(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one more character, and the phrases that it ends."""
        new = self.step(state, code)
        ended = np.zeros(len(state), np.int64)
        cut = np.flatnonzero(new == 0)
        # the phrase ends before this character, which starts the next;
        # from the root a character that occurs nowhere is its own phrase
        again = self.step(np.ones(len(cut), np.int64), code[cut])
        ended[cut] = 1 + ((state[cut] != 1) & (again == 0))
        new[cut] = np.where(again == 0, 1, again)
        return new, ended


class Parser:
    """Cross-parsing against every language's automaton."""

    def __init__(self, samples: dict[str, str]):
        seqs = {k: plain(v) for k, v in sorted(samples.items())}
        alphabet = np.unique(np.concatenate([*seqs.values(), np.array([32], np.uint32)]))
        self.map = np.zeros(0x110000, np.int32)
        self.map[alphabet] = np.arange(1, len(alphabet) + 1)
        self.names = [k for k, s in seqs.items() if len(s)]
        self.bits = [np.log2(len(seqs[k]) + 1) for k in self.names]
        self.automata = [Automaton(self.map[seqs[k]].tolist(), len(alphabet) + 1) for k in self.names]

    def phrases(self, a: Automaton, codes: list[np.ndarray], block: int = BLOCK) -> np.ndarray:
        """Phrases of each text. Blocks of all texts advance together, each from
        the root; then each block is parsed again from the state in which the
        block before it ended, in step with its first parse, until both are in
        one state, which is soon. The counts are those of one parse."""
        flat = np.concatenate([*codes, np.zeros(0, np.int64)]).astype(np.int64)
        size = np.array([-(-len(c) // block) for c in codes], np.int64)
        owner = np.repeat(np.arange(len(codes)), size)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        long = np.array([len(c) for c in codes], np.int64)
        start = (np.cumsum(long) - long)[owner] + nth * block
        length = np.minimum(block, long[owner] - nth * block)
        order = np.argsort(-length, kind="stable")  # long blocks first
        state, count = np.ones(len(owner), np.int64), np.zeros(len(owner), np.int64)
        for i in range(int(length.max(initial=0))):
            order = order[: np.searchsorted(-length[order], -i, side="left")]
            state[order], ended = a.advance(state[order], flat[start[order] + i])
            count[order] += ended
        alone_count, alone_end = count.copy(), state.copy()
        done = np.ones(len(owner), np.int64)  # incoming states that the counts are for
        while True:
            came = np.where(nth > 0, np.concatenate([[1], state])[:-1], 1)
            redo = np.flatnonzero(came != done)
            if not len(redo):
                break
            done = came
            x, y, live = came[redo], np.ones(len(redo), np.int64), np.arange(len(redo))
            delta, ends = np.zeros(len(redo), np.int64), alone_end[redo]
            for i in range(block + 1):
                same, over = x == y, length[redo[live]] <= i
                ends[live[over & ~same]] = x[over & ~same]
                on = ~(same | over)
                live, x, y = live[on], x[on], y[on]
                if not len(live):
                    break
                code = flat[start[redo[live]] + i]
                x, more = a.advance(x, code)
                y, less = a.advance(y, code)
                delta[live] += more - less
            count[redo], state[redo] = alone_count[redo] + delta, ends
        out = np.bincount(owner, count, len(codes)).astype(np.int64)
        some = np.flatnonzero(size)
        out[some] += state[np.cumsum(size)[some] - 1] != 1  # the last phrase
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.names:
            return out
        codes, total = [np.zeros(0, np.int64)] * len(texts), np.zeros(len(texts))
        for i, t in enumerate(texts):
            seq = plain(t) if t else np.zeros(0, np.uint32)
            if (seq != 32).any():
                codes[i], total[i] = self.map[seq], len(seq)
        if not total.any():
            return out
        cost = np.array([self.phrases(a, codes) * b for a, b in zip(self.automata, self.bits)])
        for i in np.flatnonzero(total):
            c = cost[:, i]
            best = int(np.argmin(c))
            rest = np.delete(c, best)
            out[i] = (self.names[best], float(1 - c[best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0)
        return out


def held_out(id_col: str = "doc_id", rest: int = 2):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == rest


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, row_chars: int = ROW_CHARS, chars: int = CHARS) -> dict[str, str]:
    """Training text per language from a bounded sample of distinct texts (see
    above). Long rows give a slice at a place chosen by hash."""
    src = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    keyed = src.withColumn("h", F.xxhash64("text"))
    # copies are one hash before the smallest are chosen; hashes alone move
    chosen = keyed.select("lang", "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= rows).drop("r")
    cut = F.expr(f"substring(text, cast(1 + pmod(h, greatest(1, length(text) - {row_chars})) as int), {row_chars})")
    top = keyed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(cut).alias("text"))  # rows x languages
    out: dict[str, str] = {}
    for r in top.orderBy("lang", "h").collect():  # rows x languages, each at most row_chars
        if len(have := out.get(r.lang, "")) < chars:
            out[r.lang] = (have + " " + r.text)[:chars]
    return out


_LOADED: dict[int, Parser] = {}


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' ids with lang_pred and score."""
    src = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("__text"))
    key = hash(tuple(sorted(samples.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Parser(samples)
        try:
            for b in batches:
                got: list[tuple[str, float]] = []
                for part in text_slices(b.column(1), GROUP_BYTES):
                    got += _LOADED[key].predict(part.to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [id_col, "lang_pred", "score"])
        finally:
            release()

    return src.mapInArrow(run, f"{id_col} {src.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = learn(docs.where(~held_out()))
    return identify(docs, samples).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLE: dict[str, str] = {}
