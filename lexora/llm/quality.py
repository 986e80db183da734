"""Quality rules by repetition coverage.

Rolling hashes of several word n-gram lengths, computed in numpy over the
UTF-8 bytes of a document, give the share of word characters that lie inside
duplicated n-grams; duplicated lines are measured the same way. The operator
is row-local: no shuffle, and memory is one Arrow batch of documents and one
text's arrays.

Edge cases: a null or empty text has no words and fails the base rule; a text
without line breaks is one line; lines without a word never count; repeated
rows are judged alike, each on its own; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexora.llm.common import release, table, text_slices

#: Fixed values of the published repetition rules: highest share of characters
#: inside duplicated n-grams of n words, and inside duplicated lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_CHAR_LIMIT = 0.20
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    ngram_limits: dict[int, float] = field(default_factory=lambda: dict(NGRAM_LIMITS))
    line_char_limit: float = LINE_CHAR_LIMIT
    min_words: int = 50
    max_repeat_percent: int = 50


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _repeated(codes: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    if not len(codes):
        return np.zeros(0, bool)
    order = np.argsort(codes, kind="stable")
    s = codes[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    out = np.empty(len(s), bool)
    out[order] = same
    return out


def _covered(starts_dup: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside a window of n words whose start is flagged."""
    delta = np.zeros(words + 1, np.int32)
    at = np.flatnonzero(starts_dup)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + n, -1)
    return np.cumsum(delta[:-1]) > 0


def measure(text: str | None, rules: QualityRules = QualityRules()) -> dict:
    """All figures of one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    out = {"n_words": n, "word_chars": 0, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "line_share": 0.0, "gram_share": [0.0] * len(rules.ngram_limits)}
    raw = np.frombuffer(data, np.uint8)
    out["n_symbols"] = int(_SYMBOL[raw].sum())
    if n:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        space = _SPACE[raw]
        lead = ((raw & 0xC0) != 0x80) & ~space
        ends = np.concatenate([[0], np.cumsum(lead)])
        edge = np.diff(np.concatenate([[1], space.astype(np.int8), [1]]))
        chars = ends[np.flatnonzero(edge == 1)] - ends[np.flatnonzero(edge == -1)]
        total = int(chars.sum())
        out["word_chars"] = total
        if n >= 3:  # exact: ranks of pairs, then of triples
            pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
            triple = pair[:-1].astype(np.int64) * len(ids) + code[2:]
            out["n_repeat_words"] = int(_covered(_repeated(triple), 3, n).sum())
        seen: set[bytes] = set()
        dup_chars = 0
        for line in data.split(b"\n"):
            if line in seen:
                out["n_dup_lines"] += 1
                piece = np.frombuffer(line, np.uint8)
                dup_chars += int((((piece & 0xC0) != 0x80) & ~_SPACE[piece]).sum())
            elif line.strip(b" \t\n\r\x0b\x0c"):
                seen.add(line)
        out["line_share"] = dup_chars / total
        # rolling: the hash of n words is the hash of n-1 words times a
        # constant plus the next word, so every length reuses the last
        with np.errstate(over="ignore"):
            word_hash = (code.astype(np.uint64) + np.uint64(1)) * _MULT
            word_hash ^= word_hash >> np.uint64(29)
            roll = word_hash.copy()
            for size in range(2, max(rules.ngram_limits) + 1):
                if size > n:
                    break
                roll = roll[:-1] * _STEP + word_hash[size - 1 :]
                if size in rules.ngram_limits:
                    cover = _covered(_repeated(roll ^ (roll >> np.uint64(31))), size, n)
                    out["gram_share"][list(rules.ngram_limits).index(size)] = float(chars[cover].sum()) / total
    out["base_failed"] = n < rules.min_words or 100 * out["n_repeat_words"] > rules.max_repeat_percent * n
    out["kept"] = not (
        out["base_failed"]
        or out["line_share"] > rules.line_char_limit
        or any(s > limit for s, limit in zip(out["gram_share"], rules.ngram_limits.values()))
    )
    return out


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_share double, gram_share array<double>"
TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.list_(pa.float64())]
GROUP_BYTES = 4_000_000  # of texts that are Python strings at a time


def quality_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: its id and the figures of ``measure``."""
    src = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("__text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                rows = [measure(t, rules) for part in text_slices(b.column(1), GROUP_BYTES) for t in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], t) for k, t in zip(names, TYPES)]], [id_col, *names])
        finally:
            release()

    return src.mapInArrow(run, f"{id_col} {src.schema[id_col].dataType.simpleString()}, {SCHEMA}")


def keep_good(docs: DataFrame, text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with all their columns, untouched."""

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                keep = [measure(t, rules)["kept"] for part in text_slices(b.column(at), GROUP_BYTES) for t in part.to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))
        finally:
            release()

    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_figures(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    cover = []
    for n, limit in NGRAM_LIMITS.items():
        cover.append(f"""
  SELECT doc_id, sum(CASE WHEN hit THEN length(w) ELSE 0 END) > {limit} * sum(length(w)) AS bad FROM (
    SELECT doc_id, w, coalesce(bool_or(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), false) AS hit FROM (
      SELECT doc_id, i, w, i + {n - 1} <= n AND count(*) OVER (PARTITION BY doc_id, i + {n - 1} <= n, list_slice(ws, i, i + {n - 1})) > 1 AS dup FROM pos)) GROUP BY doc_id""")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
rep AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n_repeat_words, sum(length(w)) AS word_chars FROM (
    SELECT doc_id, w, coalesce(bool_or(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), false) AS hit FROM (
      SELECT doc_id, i, w, i + 2 <= n AND count(*) OVER (PARTITION BY doc_id, i + 2 <= n, list_slice(ws, i, i + 2)) > 1 AS dup FROM pos)) GROUP BY doc_id),
lines AS (SELECT doc_id, l, list_sum(list_transform(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), lambda x: length(x))) AS c, count(*) - 1 AS more FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
ln AS (SELECT doc_id, sum(more) AS n_dup_lines, sum(more * c) AS dup_chars FROM lines GROUP BY doc_id),
grams AS (SELECT doc_id, bool_or(bad) AS bad FROM ({" UNION ALL ".join(cover)}) GROUP BY doc_id),
j AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(dup_chars, 0) > {LINE_CHAR_LIMIT} * coalesce(word_chars, 0) OR coalesce(bad, false) AS bad
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN grams USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR bad) AS kept FROM j"""


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLE = {"op4_quality_rules": _oracle()}
