"""BPE encoding and decoding by speculation and verification.

Text is cut into chunks that no pre-token crosses. For each distinct new chunk,
greedy longest match proposes tokens; one vectorised check over all proposals
tests every adjacent pair of tokens for compatibility (whether merging the two
tokens' bytes by rank gives back exactly these two tokens); a sequence of
self-encoding tokens whose adjacent pairs are all compatible is the exact BPE
encoding. Only words with a failing pair are merged exactly by rank, all of them
together, a merge of each word in a round.

The operator is row-local (no shuffle). A task keeps a bounded cache of chunks,
which is trimmed when full, so memory does not grow with the data; texts go
through it in groups of ``GROUP_BYTES``.

Edge cases: null and empty text encode to no ids and decode to the empty text;
the string of a special token in a text becomes its id, as in the library;
any length of text and of word is allowed (long words use a heap); repeated
rows give equal results; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from lexora.llm.common import release, table, text_slices

_WS = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Fixed pattern of the byte-level pre-tokenizer, with white space spelled out.
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: A run of white space with what follows it: pre-tokens never cross its ends.
CHUNK = re.compile(rf"[{_WS}]*[^{_WS}]+|[{_WS}]+")
SPACE = frozenset("\t\n\v\f\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])))
#: White space beyond ASCII.
ODD_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
FAR = np.int64(1 << 40)
#: Bytes of text whose chunks are looked up together; bytes from which a word
#: is merged on its own.
GROUP_BYTES, LONG_WORD = 16_000_000, 256


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte, by the public rule:
    printable Latin-1 stands for itself, the rest follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in keep}
    for i, b in enumerate(x for x in range(256) if x not in set(keep)):
        out[chr(256 + i)] = b
    return out


class IntMap:
    """A fixed map of non-negative 64-bit keys for whole arrays: open addressing
    with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            win = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[win]], self.values[slot[win]] = keys[win], values[win]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found, out = self.keys[slot], self.values[slot]
        lost = np.flatnonzero((found != keys) & (found >= 0))
        while len(lost):
            slot[lost] = (slot[lost] + 1) & self.last
            found = self.keys[slot[lost]]
            out[lost] = self.values[slot[lost]]
            lost = lost[(found != keys[lost]) & (found >= 0)]
        return out


class Bpe:
    """A byte-level vocabulary with its merges, and a chunk cache."""

    def __init__(self, path: str, cache_size: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        raw = {t: bytes(alphabet[c] for c in t) for t in vocab}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = raw[t] if t not in self.special else t.encode()
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.base = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.base[b] = vocab[c]
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.formed = np.full(size, -1, np.int64)  # rank of the merge that makes a token
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.size = size
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.merge[i, j] = (rank, k)
            self.left[k], self.right[k], self.formed[k] = i, j, rank
        keys = np.array([a * size + b for a, b in self.merge], np.int64)
        self.pairs = IntMap(keys, np.array([r for r, _ in self.merge.values()], np.int64), int(FAR))
        self.made = np.array([k for _, k in self.merge.values()], np.int64)  # by rank
        inner = np.flatnonzero(self.formed >= 0)
        sound = np.ones(size, bool)
        sound[inner] = self._compatible(self.left[inner], self.right[inner], self.formed[inner])
        for k in inner[np.argsort(self.formed[inner])]:
            sound[k] &= sound[self.left[k]] and sound[self.right[k]]
        # the trie of the tokens that encode to themselves
        step: dict[int, int] = {}
        token = {0: -1}
        for t, i in vocab.items():
            if sound[i] and t not in self.special:
                node = 0
                for c in self.bytes_of[i]:
                    node = step.setdefault(node * 256 + c, len(step) + 1)
                token[node] = i
        self.step = IntMap(np.fromiter(step, np.int64, len(step)), np.fromiter(step.values(), np.int64, len(step)), -1)
        self.node_token = np.full(len(step) + 1, -1, np.int64)
        self.node_token[list(token)] = list(token.values())
        self.decimal = pa.array(map(str, range(size)), pa.string())
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.width = np.array([len(b) for b in self.bytes_of], np.int64)
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(self.width)])[:-1]
        self.cache_size = cache_size
        self._reset()

    def _reset(self) -> None:
        self.cache: dict[str, int] = {}
        self.said: list[str] = []
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0
        for t, i in self.special.items():
            self.flat[self.used], self.start[self.used], self.count[self.used] = i, self.used, 1
            self.cache[t] = self.used
            self.said.append(str(i))
            self.used += 1

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.pairs.get(x * self.size + y)

    def _compatible(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray | None = None) -> np.ndarray:
        """For each pair: does no merge cross the border? The border's two
        pieces are followed back in time, undoing the later merge first. A
        crossing merge fires if its rank comes before the left piece is
        absorbed, and not after the right one is (of equal merges the leftmost
        goes first)."""
        x, y = a.astype(np.int64), b.astype(np.int64)
        stay_x = np.full(len(x), FAR) if bound is None else bound.copy()
        stay_y = stay_x.copy()
        ok = np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            r = self._rank(x[live], y[live])
            bad = (r < stay_x[live]) & (r <= stay_y[live]) & (r < FAR)
            ok[live[bad]] = False
            live = live[~bad]
            fx, fy = self.formed[x[live]], self.formed[y[live]]
            live, fx, fy = (v[(fx >= 0) | (fy >= 0)] for v in (live, fx, fy))
            back = fx > fy
            i, j = live[back], live[~back]
            stay_x[i], x[i] = fx[back], self.right[x[i]]
            stay_y[j], y[j] = fy[~back], self.left[y[j]]
        return ok

    def propose(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words ``raw[start:end]`` at once, by
        walking the vocabulary's trie: tokens in order, and how many a word has."""
        at = start.astype(np.int64)
        live = np.flatnonzero(at < end)
        places, tokens = [], []
        while len(live):
            here = at[live]
            best, size = self.base[raw[here]], np.ones(len(live), np.int64)
            node, walk, depth = np.zeros(len(live), np.int64), np.arange(len(live)), 0
            while len(walk):
                node = self.step.get(node * 256 + raw[here[walk] + depth])
                depth += 1
                on = node >= 0
                walk, node = walk[on], node[on]
                token = self.node_token[node]
                hit = token >= 0
                best[walk[hit]], size[walk[hit]] = token[hit], depth
                more = here[walk] + depth < end[live[walk]]
                walk, node = walk[more], node[more]
            places.append(here)
            tokens.append(best)
            at[live] = here + size
            live = live[at[live] < end[live]]
        if not places:
            return np.zeros(0, np.int64), np.zeros(len(start), np.int64)
        where = np.concatenate(places)
        order = np.argsort(where, kind="stable")
        ends = np.searchsorted(where[order], end)
        return np.concatenate(tokens)[order], ends - np.searchsorted(where[order], start)

    def merge_all(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merging by rank, leftmost first, of many words at once: each round
        applies every word's next merge. Same layout in and out."""
        owner = np.repeat(np.arange(len(count)), count)
        rank = np.full(len(ids), FAR)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        rank[pair] = self._rank(ids[pair], ids[pair + 1])
        done_ids, done_owner = [], []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.concatenate([first, [len(ids)]]))
            low = np.repeat(np.minimum.reduceat(rank, first), size)
            over = low == FAR
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                stay = ~over
                ids, owner, rank, low = ids[stay], owner[stay], rank[stay], low[stay]
                if not len(ids):
                    break
            hit = rank == low
            i = np.flatnonzero(hit)
            if (i[1:] == i[:-1] + 1).any():  # a run of one token: every other pair
                fresh = np.concatenate([[True], i[1:] != i[:-1] + 1])
                i = i[(i - np.maximum.accumulate(np.where(fresh, i, 0))) % 2 == 0]
            ids[i] = self.made[low[i]]
            keep = np.ones(len(ids), bool)
            keep[i + 1] = False
            new = np.cumsum(keep)[i] - 1
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            turn = np.unique(np.concatenate([new, new[new > 0] - 1]))
            rank[turn] = FAR
            turn = turn[turn + 1 < len(ids)]
            turn = turn[owner[turn] == owner[turn + 1]]
            rank[turn] = self._rank(ids[turn], ids[turn + 1])
        if not done_ids:
            return ids, count
        owner = np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(done_ids)[order], np.bincount(owner, minlength=len(count))

    def exact(self, w: bytes) -> list[int]:
        """Merging by rank, leftmost first, of one long word."""
        ids = [int(self.base[c]) for c in w]
        merge = self.merge
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(*merge[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merge]
        heap = [(r, i, k, p) for r, k, i, p in heap]
        heapq.heapify(heap)
        gone = [False] * len(ids)
        while heap:
            _, i, k, p = heapq.heappop(heap)
            j = after[i] if not gone[i] else len(ids)
            if j >= len(ids) or (ids[i], ids[j]) != p:
                continue
            ids[i], gone[j] = k, True
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for u, v in ((before[i], i), (i, after[i])):
                if u >= 0 and v < len(ids) and (q := (ids[u], ids[v])) in merge:
                    heapq.heappush(heap, (merge[q][0], u, merge[q][1], q))
        return [t for t, g in zip(ids, gone) if not g]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Exact encodings of pre-tokens, end to end, and how many ids each
        has: propose all, verify all, mend the failing ones."""
        offset = np.asarray(pa.Array.from_buffers(pa.int32(), len(words) + 1, [None, words.buffers()[1]], offset=words.offset)).astype(np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8)
        start, end = offset[:-1], offset[1:]
        flat, count = self.propose(raw, start, end)
        owner = np.repeat(np.arange(len(count)), count)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        bad = np.zeros(len(count), bool)
        bad[owner[inner[~self._compatible(flat[inner], flat[inner + 1])]]] = True
        if not bad.any():
            return flat, count
        size = end - start
        short, long = np.flatnonzero(bad & (size <= LONG_WORD)), np.flatnonzero(bad & (size > LONG_WORD))
        mended, n = self.merge_all(self.base[raw[spread(start[short], size[short])]], size[short])
        more = [self.exact(raw[a:b].tobytes()) for a, b in zip(start[long], end[long])]
        pool = np.concatenate([flat, mended, *(np.array(m, np.int64) for m in more)])
        begin = np.cumsum(count) - count
        extra = np.concatenate([n, np.fromiter(map(len, more), np.int64, len(more))])
        fixed = np.concatenate([short, long])
        begin[fixed], count[fixed] = len(flat) + np.cumsum(extra) - extra, extra
        return pool[spread(begin, count)], count

    def _learn(self, new: list[str]) -> None:
        """Append the encodings of chunks to the arrays, in order."""
        # in a chunk of white space and then text, pre-tokens are the same
        # when such chunks stand end to end; others get a call of their own
        whole = [c[0] in SPACE and c[-1] not in SPACE for c in new]
        said: list[str] = []
        size: list[int] = []
        for joint, run in itertools.groupby(range(len(new)), whole.__getitem__):
            chunks = [new[i] for i in run]
            if joint:
                pieces = PRETOKEN.findall("".join(chunks))
                ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
                upto = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))), side="right")
                said += pieces
                size += np.diff(upto, prepend=0).tolist()
            else:
                for c in chunks:
                    pieces = PRETOKEN.findall(c)
                    said += pieces
                    size.append(len(pieces))
        coded = pa.array(said, pa.string()).dictionary_encode()
        flat, count = self.encode_words(coded.dictionary)
        begin, which = np.cumsum(count) - count, coded.indices.to_numpy(zero_copy_only=False)
        ids = flat[spread(begin[which], count[which])]
        upto = np.concatenate([[0], np.cumsum(count[which])])
        last = np.cumsum(size)
        n = upto[last] - upto[last - size]
        i, k = len(self.said), len(new)
        while i + k > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[i : i + k], self.count[i : i + k] = self.used + np.cumsum(n) - n, n
        self.used += len(ids)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), self.decimal.take(pa.array(ids)))
        self.said.extend(pc.binary_join(lists, ",").to_pylist())

    def _cut(self, keep: int) -> None:
        """Keep the first entries of the arrays."""
        if keep < len(self.said):
            del self.said[keep:]
            self.used = int(self.start[keep])

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks of texts, and how many each text has. Where all white space
        is ASCII and no special token occurs, bytes tell where chunks start."""
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        offset = np.asarray(pa.Array.from_buffers(pa.int32(), len(texts) + 1, [None, texts.buffers()[1]], offset=texts.offset)).astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]]
        offset -= offset[0]
        space = IS_SPACE[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[1:-1] = space[1:] & ~space[:-1]
        first[offset] = True
        cut = np.flatnonzero(first).astype(np.int32)
        chunks = pa.StringArray.from_buffers(max(0, len(cut) - 1), pa.py_buffer(cut), pa.py_buffer(raw))
        upto = np.searchsorted(cut, offset)
        if not len(odd):
            return chunks, np.diff(upto)
        out, counts = [], np.diff(upto)
        done = 0
        for i in odd.tolist():
            out.append(chunks.slice(upto[done], upto[i] - upto[done]))
            pieces = self.split_special.split(texts[i].as_py()) if self.split_special else [texts[i].as_py()]
            mine = [c for p in pieces if p for c in ([p] if p in self.special else CHUNK.findall(p))]
            out.append(pa.array(mine, pa.string()))
            counts[i] = len(mine)
            done = i + 1
        out.append(chunks.slice(upto[done]))
        return pa.concat_arrays(out), counts

    def encode_many(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, str]]:
        """For each whole text its ids, and the same in decimals joined by
        commas. Each distinct chunk of some texts is looked up once; those that
        occur once are not remembered."""
        for part in text_slices(pc.fill_null(texts.cast(pa.string()), ""), GROUP_BYTES):
            chunks, counts = self._chunks(part)
            coded = chunks.dictionary_encode()
            distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            if len(self.cache) > self.cache_size:
                self._cut(max(self.cache_size // 5, len(self.special)))  # early ones are mostly the frequent ones
                self.cache = {c: i for c, i in self.cache.items() if i < len(self.said)}
            entry = np.fromiter(map(self.cache.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
            new = np.flatnonzero(entry < 0)
            stay = len(self.said)
            if len(new):
                often = np.bincount(codes, minlength=len(distinct))[new] > 1
                new = np.concatenate([new[often], new[~often]])
                entry[new] = stay + np.arange(len(new))
                names = list(map(distinct.__getitem__, new.tolist()))
                self._learn(names)
                kept = int(often.sum())
                self.cache.update(zip(names[:kept], range(stay, stay + kept)))
                stay += kept
            entry = entry[codes]
            upto = np.concatenate([[0], np.cumsum(counts)])
            for a, b in zip(upto, upto[1:]):
                e = entry[a:b]
                yield self.flat[spread(self.start[e], self.count[e])], ",".join(map(self.said.__getitem__, e.tolist()))
            self._cut(stay)

    def encode(self, text: str | None) -> tuple[np.ndarray, str]:
        return next(self.encode_many(pa.array([text], pa.string())))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; broken UTF-8 is replaced."""
        ids = np.asarray(ids, np.int64)
        step = 1 << 20
        return b"".join(self.blob[spread(self.offset[p], self.width[p])].tobytes() for p in (ids[a : a + step] for a in range(0, len(ids), step))).decode("utf-8", "replace")


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start..start+count-1 of every range, in order."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - ends + count, count)


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One vocabulary per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256; with ``with_ids``
    the ids and the decoded text too."""
    src = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("__text"))
    more = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        try:
            for b in batches:
                n, said_hash, back_hash, all_ids, texts = [], [], [], [], []
                for ids, said in bpe.encode_many(b.column(1)):
                    back = bpe.decode(ids)
                    n.append(len(ids))
                    said_hash.append(hashlib.sha256(said.encode()).hexdigest())
                    back_hash.append(hashlib.sha256(back.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                        texts.append(back)
                more = [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] if with_ids else []
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(said_hash, pa.string()), pa.array(back_hash, pa.string()), *more], [id_col, *NAMES[: 3 + len(more)]])
        finally:
            bpe._reset()
            release()

    return src.mapInArrow(run, f"{id_col} {src.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


NAMES = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES = {"op9_bpe": op9_bpe}
ORACLE: dict[str, str] = {}
