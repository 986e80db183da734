"""Token ids in a binary format: static range asymmetric numeral systems.

One frequency table, counted over all documents and bounded by the vocabulary,
is shared by all blocks. A block holds whole documents (about ``BLOCK_TOKENS``
ids; a longer document gets a block of its own, with checkpoints inside) and is
coded on its own by ``LANES`` interleaved 64-bit states with 32-bit
renormalisation, vectorised over the lanes. The container is Parquet, so that any store Spark reads will do:
``table/`` has the frequencies, ``blocks/`` one row per block. A block row is a
checkpoint: its partition, document ids, token offsets and counts say where it
starts, so blocks decode in parallel and in any order; CRC-32 sums of the payload
and of the ids guard each one and a mismatch raises. Documents are laid out in ascending id
order by a range partitioning; offsets are relative to the range, and the sums
of the ranges (one row each) turn them into offsets in the whole output.

Edge cases: null and empty text hold just the end id; null ids sort first;
repeated ids keep one row each, ordered by a hash of the text, then the text; an empty table writes and reads
back nothing; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexora.llm.bpe import spread, vocabulary
from lexora.llm.common import drop_tables, persist_table, release, scratch_path, shuffle_width, table, text_slices, word_codes

END_ID = 1
SCALE = 20
LANES = 2048
CHECK_ROWS = 128
BLOCK_TOKENS = CHECK_ROWS * LANES
LOW = np.uint64(1 << 31)
MAGIC = b"RANS"


class Table:
    """Frequencies that add up to 2**SCALE, every counted id at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)])[:-1].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    @staticmethod
    def from_counts(counts: np.ndarray) -> Table:
        """Proportional shares; the most frequent ids take up the rounding."""
        counts = np.asarray(counts, np.float64)
        total, room = counts.sum(), 1 << SCALE
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts / max(total, 1) * room)), 0).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        rest = room - int(freq.sum())
        if total and rest > 0:
            freq[order[0]] += rest
        for i in order if rest < 0 else ():
            take = min(-rest, int(freq[i]) - 1)
            freq[i] -= take
            rest += take
            if not rest:
                break
        return Table(freq)

    def encode(self, ids: np.ndarray, every: int = CHECK_ROWS) -> bytes:
        """Header, checkpoints, final states, then the renormalisation words in
        the order in which the decoder asks for them. A checkpoint after each
        ``every`` rows of lanes has the states there and the words read by
        then, so the parts of a long block decode on their own."""
        n = len(ids)
        lanes = min(LANES, max(1, n))
        x = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, bytes]] = []
        said = 0
        up, low32, scale = np.uint64(63 - SCALE), np.uint64(0xFFFFFFFF), np.uint64(SCALE)
        for a in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
            row = ids[a : a + lanes]
            m = len(row)
            f, c, v = self.freq[row], self.cum[row], x[:m]
            over = (v >> up) >= f
            words.append((v[over] & low32).astype(np.uint32))
            said += len(words[-1])
            v = np.where(over, v >> np.uint64(32), v)
            q, r = np.divmod(v, f)
            x[:m] = (q << scale) + r + c
            if a and a // lanes % every == 0:
                marks.append((said, x.astype("<u8").tobytes()))
        body = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        held = b"".join(struct.pack("<Q", len(body) - w) + states for w, states in reversed(marks))
        return MAGIC + struct.pack("<QIIII", n, lanes, len(body), len(marks), every) + held + x.astype("<u8").tobytes() + body.astype("<u4").tobytes()

    @staticmethod
    def checkpoints(data: bytes) -> int:
        """Parts of a block that decode on their own."""
        return struct.unpack_from("<QIIII", data, 4)[3] + 1

    def decode(self, data: bytes, part: int | None = None) -> np.ndarray:
        """The ids of a block, or of one of its parts."""
        if data[:4] != MAGIC:
            raise ValueError("not a block of this format")
        n, lanes, k, marks, every = struct.unpack_from("<QIIII", data, 4)
        begin = 28 + marks * (8 + 8 * lanes)
        body = np.frombuffer(data, "<u4", k, begin + 8 * lanes).astype(np.uint64)
        x, at = np.frombuffer(data, "<u8", lanes, begin).copy(), 0
        if part:
            mark = 28 + (part - 1) * (8 + 8 * lanes)
            at, x = struct.unpack_from("<Q", data, mark)[0], np.frombuffer(data, "<u8", lanes, mark + 8).copy()
        if part is not None:
            body, at, n = body[at:], 0, min(n - part * every * lanes, every * lanes)
        out = np.empty(n, np.int32)
        mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
        for a in range(0, n, lanes):
            v = x[: min(lanes, n - a)]
            slot = v & mask
            s = self.symbol[slot]
            out[a : a + len(v)] = s
            v = self.freq[s] * (v >> scale) + slot - self.cum[s]
            under = np.flatnonzero(v < LOW)
            v[under] = (v[under] << np.uint64(32)) | body[at : at + len(under)]
            at += len(under)
            x[: len(v)] = v
        return out


#: Characters whose lower case, normal form and class are the same in every
#: Unicode version; they need no normaliser (\u0130 becomes two characters).
PLAIN = r"^[\x21-\x7e\x{a1}-\x{12f}\x{131}-\x{17f}]+$"
#: Fixed pattern of this tokenizer's pre-tokenizer, on plain lower-case text.
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^ {_LETTER}{_NUMBER}]+")
END_OF_WORD = "</w>"
#: Bytes of text that are tokenised together.
GROUP_BYTES = 16_000_000


def _sizes(items: list) -> np.ndarray:
    return np.fromiter(map(len, items), np.int64, len(items))


class WordTokenizer:
    """The library's encoder with a bounded cache of white-space-free chunks;
    white space is dropped by this kind of tokenizer and no token crosses it.

    Chunks of plain characters are cut into their pre-tokens here, and each
    distinct new pre-token goes once through the library's model; all other
    chunks, and those that may hold a special token, go through the library
    whole. The model marks the last id of each pre-token as a word end, so many
    pre-tokens share one call."""

    def __init__(self, path: str, cache_size: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        self.words = Tokenizer.from_file(path)
        self.words.no_truncation()
        self.words.no_padding()
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.vocab_size, bool)
        self.ends[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith(END_OF_WORD)]] = True
        self.cache_size = cache_size
        self.reset()

    def reset(self) -> None:
        """Forget all chunks."""
        self.at: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.held, self.used = 1, 0  # entries and ids in the arrays

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        i, k = self.held, len(counts)
        while i + k > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[i : i + k] = self.used + np.cumsum(counts) - counts
        self.count[i : i + k] = counts
        self.held, self.used = i + k, self.used + len(ids)

    def _cut(self, keep: int) -> None:
        """Keep the first entries of the arrays."""
        if keep < self.held:
            self.held, self.used = keep, int(self.start[keep])

    def _model(self, pieces: list[str], step: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, end to end, and how many each has."""
        ids, counts = [], []
        for a in range(0, len(pieces), step):
            part = pieces[a : a + step]
            ids.append(np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32))
            last = np.flatnonzero(self.ends[ids[-1]])
            if len(last) != len(part):
                raise ValueError("this vocabulary does not mark word ends")
            counts.append(np.diff(last, prepend=-1))
        return np.concatenate(ids), np.concatenate(counts)

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, end to end, and how many each has."""
        simple = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, "<|")))
        here = simple.to_numpy(zero_copy_only=False)
        begin, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        pool = [np.zeros(0, np.int32)]
        if not here.all():
            seqs = [e.ids for e in self.tok.encode_batch_fast(words.filter(pc.invert(simple)).to_pylist(), add_special_tokens=False)]
            pool.append(np.fromiter(itertools.chain.from_iterable(seqs), np.int32))
            counts[~here] = _sizes(seqs)
            begin[~here] = np.cumsum(counts[~here]) - counts[~here]
        if here.any():
            plain = words.filter(simple)
            said = PRETOKEN.findall(" ".join(plain.to_pylist()).lower())
            coded = pa.array(said, pa.string()).dictionary_encode()
            ids, sizes = self._model(coded.dictionary.to_pylist())
            which = coded.indices.to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(sizes[which])])
            # pre-tokens fill their chunks without gaps
            last = np.searchsorted(np.cumsum(_sizes(said)), np.cumsum(pc.utf8_length(plain).to_numpy(), dtype=np.int64), side="right")
            counts[here] = np.diff(upto[last], prepend=0)
            begin[here] = sum(map(len, pool)) + upto[last] - counts[here]
            pool.append(ids[spread((np.cumsum(sizes) - sizes)[which], sizes[which])])
        return np.concatenate(pool)[spread(begin, counts)], counts

    def encode_many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each whole text. Each distinct chunk of some texts is looked
        up once, and the new ones are encoded in one call; those that occur
        once are not remembered."""
        for part in text_slices(texts.cast(pa.string()), GROUP_BYTES):
            count, codes, words = word_codes(part)
            distinct = words.to_pylist()
            if len(self.at) > self.cache_size:
                self._cut(self.cache_size // 5)  # early ones are mostly the frequent ones
                self.at = {k: i for k, i in self.at.items() if i < self.held}
            entry = np.fromiter(map(self.at.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
            new = np.flatnonzero(entry < 0)
            stay = self.held
            if len(new):
                often = np.bincount(codes, minlength=len(distinct))[new] > 1
                new = np.concatenate([new[often], new[~often]])
                self._add(*self._encode_words(words.take(pa.array(new))))
                entry[new] = stay + np.arange(len(new))
                kept = new[: int(often.sum())].tolist()
                self.at.update(zip(map(distinct.__getitem__, kept), range(stay, stay + len(kept))))
                stay += len(kept)
            entry = entry[codes]
            upto = np.concatenate([[0], np.cumsum(count)])
            for a, b in zip(upto, upto[1:]):
                e = entry[a:b]
                yield self.flat[spread(self.start[e], self.count[e])]
            self._cut(stay)

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_many(pa.array([text], pa.string())))


_LOADED: dict[str, WordTokenizer] = {}


def load(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def _kind(vocab_size: int) -> str:
    return "<u2" if vocab_size <= 65536 else "<u4"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_tokens(docs: DataFrame, path: str, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the format to ``path``."""
    spark = docs.sparkSession
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    # the driver gets a sample of the range keys: numbers, never texts
    keyed = src.withColumn("tie", F.xxhash64("text"))
    ranged = keyed.repartitionByRange(shuffle_width(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").withColumn("part", F.spark_partition_id())

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, done = load(vocab_path), 0
        kind = _kind(tok.vocab_size)
        try:
            for b in batches:
                data, total = [], np.zeros(tok.vocab_size, np.int64)
                for seq in tok.encode_many(b.column(2)):
                    ids = np.append(seq, END_ID)
                    if len(ids) > tok.vocab_size // 8:
                        total += np.bincount(ids, minlength=tok.vocab_size)
                    else:
                        np.add.at(total, ids, 1)
                    data.append(ids.astype(kind).tobytes())
                ends = done + np.cumsum(np.array(list(map(len, data)), np.int64) // np.dtype(kind).itemsize)
                rel = np.concatenate([[done], ends[:-1]])[: len(data)]
                done = int(ends[-1]) if len(ends) else done
                at = np.flatnonzero(total)
                said = [np.concatenate([at, total[at]]).tobytes(), *[None] * (len(data) - 1)][: len(data)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rel, pa.int64()), pa.array(data, pa.binary()), pa.array(said, pa.binary())], ["part", "doc_id", "rel", "ids", "counts"])
        finally:
            release()

    ids = persist_table(ranged.select("part", "doc_id", "text").mapInArrow(tokenise, "part int, doc_id long, rel long, ids binary, counts binary"), "ids")
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(vocab_path).get_vocab_size(with_added_tokens=True)
    kind = _kind(size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for held in b.column(0).to_pylist():
                at, n = np.frombuffer(held, np.int64).reshape(2, -1)
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["symbol", "n"])

    # each batch counted its ids; one row of it has the counts
    counted = ids.where("counts is not null").select("counts").mapInArrow(count, "symbol long, n long")
    seen = counted.groupBy("symbol").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    counts = np.zeros(size, np.int64)
    counts[seen["symbol"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)
    freq = Table.from_counts(counts).freq.astype("<u4")
    spark.createDataFrame([(SCALE, bytearray(freq.tobytes()))], "scale int, freq binary").coalesce(1).write.parquet(f"{path}/table")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = Table(freq)
        for b in batches:
            data = b.column(3).cast(pa.large_binary())
            offset = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] // np.dtype(kind).itemsize
            flat = np.frombuffer(data.buffers()[2] or b"", kind)
            part, rel = b.column(0).to_numpy(), b.column(2).to_numpy()
            known = b.column(1).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            doc = pc.fill_null(b.column(1), 0).to_numpy()
            stop = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))  # ranges end here
            a = 0
            while a < len(part):
                z = max(a + 1, int(np.searchsorted(offset, offset[a] + BLOCK_TOKENS, side="right")) - 1)
                z = min(z, int(stop[np.searchsorted(stop, a, side="right")]))
                seq = flat[offset[a] : offset[z]].astype(np.int32)
                payload = tab.encode(seq)
                row = (int(part[a]), int(rel[a]), z - a, len(seq), doc[a:z].astype("<i8").tobytes(), known[a:z].tobytes(), rel[a:z].astype("<i8").tobytes(), np.diff(offset[a : z + 1]).astype("<i8").tobytes(), _crc(seq), zlib.crc32(payload), payload)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, BLOCK_TYPES)], COLUMNS)
                a = z

    ids.select("part", "doc_id", "rel", "ids").mapInArrow(pack, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    ends = ids.groupBy("part").agg(F.max(F.col("rel") + F.octet_length("ids") / np.dtype(kind).itemsize).cast("long").alias("n"))
    ends.write.parquet(f"{path}/parts")
    drop_tables(ids)


COLUMNS = ["part", "first", "n_docs", "n_tokens", "doc_ids", "known", "rel", "sizes", "crc32", "payload_crc32", "payload"]
BLOCK_SCHEMA = "part int, first long, n_docs int, n_tokens long, doc_ids binary, known binary, rel binary, sizes binary, crc32 long, payload_crc32 long, payload binary"
BLOCK_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64(), pa.binary()]


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, and its ids."""
    freq = np.frombuffer(bytes(spark.read.parquet(f"{path}/table").first().freq), "<u4")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = Table(freq)
        for b in batches:
            for i in range(len(b)):
                r = {name: b.column(j)[i] for j, name in enumerate(COLUMNS)}
                view = lambda name, kind: np.frombuffer(r[name].as_buffer(), kind)  # noqa: E731, B023
                payload = r["payload"].as_buffer().to_pybytes()
                seq = tab.decode(payload) if zlib.crc32(payload) == r["payload_crc32"].as_py() else np.zeros(0, np.int32)
                said = seq.astype("<u4").tobytes()
                if len(seq) != r["n_tokens"].as_py() or zlib.crc32(said) != r["crc32"].as_py():
                    raise ValueError(f"block {r['part']}:{r['first']} is damaged")
                sizes = view("sizes", "<i8")
                upto, whole = np.concatenate([[0], np.cumsum(sizes)]), memoryview(said)
                crc = [zlib.crc32(whole[4 * x : 4 * y]) for x, y in zip(upto.tolist(), upto[1:].tolist())]
                doc = pa.array(view("doc_ids", "<i8"), mask=view("known", np.uint8) == 0)
                part = pa.array(np.full(len(sizes), r["part"].as_py(), np.int32))
                ids = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(seq))] if with_ids else []
                yield pa.RecordBatch.from_arrays([part, doc, pa.array(view("rel", "<i8")), pa.array(sizes), pa.array(crc, pa.int64()), *ids], ["part", "doc_id", "rel", "n_tokens", "ids_crc32", "ids"][: 5 + len(ids)])

    schema = "part int, doc_id long, rel long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    rows = spark.read.parquet(f"{path}/blocks").mapInArrow(unpack, schema)
    # one row per range partition; the running sum is over ranges, not documents
    base = spark.read.parquet(f"{path}/parts").withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return read_tokens(spark, path)


QUERIES = {"op2_token_output": op2_token_output}
ORACLE: dict[str, str] = {}
