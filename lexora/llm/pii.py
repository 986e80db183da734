"""Personal data: fixed patterns plus information-theoretic sanitisation.

Patterns find e-mail addresses, IPv4 addresses, card and phone numbers. Each
distinct such string is a protected entity, and so are its classes: the kind,
and the domain of an e-mail address. An exact string mostly stands in one text,
so its classes are where terms can meet it repeatedly. A term (a run of three
letters or more, lower-cased) that stands within ``window`` characters of an
entity is a candidate; over all documents, with n_c documents holding the
entity, n_t the term, n_ct both close together, and N in all,

    PMI(c;t) = log(n_ct * N / (n_c * n_t)),   IC(c) = log(N / n_c),

and the term discloses the entity when PMI >= alpha * IC and the counts bear it:
n_ct counts at least ``support`` different texts, or, with fewer, the log
likelihood ratio of the two (Dunning's G2, which holds for rare counts; copies
of a text count once in it) is at least ``ratio``. A term seen once, beside a
string seen once, so counts among many documents but not among few. Every occurrence of a disclosing term, in any
document, becomes a span of kind ``term``; sanitising replaces it by the general
word TERM, and pattern spans by their kind.

Scale: three passes over the text, none of which shuffles it. Pass 1 counts
(entity, term) pairs; pairs that would fail even if the term were nowhere else
are dropped. Pass 2 counts document frequencies of the terms left, found through
a bit array of fixed size (``BITS``) in the closure and confirmed by an exact
join. Pass 3 emits spans: up to ``TERMS_SENT`` disclosing terms go to the tasks;
beyond that it emits positions of possible terms, confirmed by a join. All
counts combine map-side.

Edge cases: null and empty text have no spans; of overlapping spans of different
kinds all pattern spans stay and a term inside a pattern span is not reported;
repeated rows each get their spans; with no entity at all there are no terms.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.llm.common import drop_tables, persist_table, release, table, text_slices

KINDS = ["email", "ip", "card", "phone", "term"]
ALPHA, SUPPORT, WINDOW = 0.95, 3, 60
RATIO = 10.83  # chi-square of one degree of freedom at 0.001
BITS = 1 << 22
#: Disclosing terms that travel in the task closure, some 30 MB; beyond that
#: their positions are confirmed by joins. Bytes of texts held as strings.
TERMS_SENT, GROUP_BYTES = 500_000, 4_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, sorted by start, then kind."""
    out: list[tuple[int, int, str]] = []
    if not text:
        return out
    # An address starts where its run of local characters does (or the last
    # address ended), so looking at each @ finds the leftmost matches in
    # linear time, however long a run is.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def entities(kind: str, said: str) -> list[int]:
    """The exact string and its classes."""
    said = said.lower()
    names = [kind + said, f"kind {kind}"]
    if kind == "email":
        names.append("domain " + said.rpartition("@")[2])
    return [_hash(x) for x in names]


def _terms(text: str) -> set[str]:
    """Terms of a text, each lower-cased on its own."""
    return {t.lower() for t in set(_TERM.findall(text))}


def near_terms(text: str, spans: list[tuple[int, int, str]], window: int) -> dict[int, set[str]]:
    """Terms close to each entity of a text, outside all spans."""
    out: dict[int, set[str]] = {}
    for a, b, k in spans:
        lo, hi = max(0, a - window), b + window
        terms = set()
        for m in _TERM.finditer(text, lo, min(len(text), hi)):
            whole = (m.start() > lo or lo == 0) and (m.end() < hi)
            if whole and not any(m.start() < e and m.end() > s for s, e, _ in spans if s < hi and e > lo):
                terms.add(m[0].lower())
        for c in entities(k, text[a:b]):
            out.setdefault(c, set()).update(terms)
    return out


def _bits(terms: DataFrame) -> bytes:
    """A bit array over term hashes; at most BITS small numbers are gathered."""
    slots = terms.select(F.pmod(F.xxhash64("term"), F.lit(BITS)).cast("int").alias("slot")).distinct().toPandas()["slot"]
    flags = np.zeros(BITS, bool)
    flags[slots.to_numpy(np.int64)] = True
    return np.packbits(flags).tobytes()


class _Maybe(dict):
    """Whether a term's bit may be set; remembers a bounded number of words."""

    def __init__(self, bits: bytes):
        self.flags = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)

    def __missing__(self, term: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        h = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), seed=42)
        hit = self[term] = bool(self.flags[h % BITS if h < 1 << 63 else (h - (1 << 64)) % BITS])
        return hit


def _likelihood_ratio(k: Column, t: Column, c: Column, n: Column) -> Column:
    """Dunning's G2 of k texts with both, t with the term, c with the entity, n in all."""

    def part(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)

    return 2 * (part(k, t, c) + part(t - k, t, n - c) + part(c - k, n - t, c) + part(n - t - c + k, n - t, n - c))


def disclosing_terms(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA, support: int = SUPPORT, window: int = WINDOW, ratio: float = RATIO) -> DataFrame:
    """The distributed table ``(term)`` of terms that disclose an entity."""
    src = docs.select(docs[text_col].alias("text"))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                spans = base_spans(text)
                if spans:
                    h = _hash(text)
                    for c, terms in near_terms(text, spans, window).items():
                        rows.append((c, "", h))  # the entity itself
                        rows.extend((c, t, h) for t in terms)
            yield pd.DataFrame(rows, columns=["entity", "term", "h"]).astype({"entity": "int64", "h": "int64", "term": "object"})

    # per text first, so that copies count once for support, all for n_ct
    per_text = src.mapInPandas(pairs, "entity long, term string, h long").groupBy("entity", "term", "h").agg(F.count("*").alias("k"))
    counts = persist_table(per_text.groupBy("entity", "term").agg(F.sum("k").alias("n_ct"), F.count("*").alias("texts")), "pairs")
    total = docs.count()
    n = F.lit(float(total))
    held = counts.where("term = ''").select("entity", F.col("n_ct").alias("n_c"), F.col("texts").alias("c_texts"))

    def disclosing(scored: DataFrame) -> DataFrame:
        pmi = F.log(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t")))
        once = F.col("n_t") * F.col("texts") / F.col("n_ct")  # the term's documents, less the copies
        borne = (F.col("texts") >= support) | (_likelihood_ratio(F.col("texts"), once, F.col("c_texts"), n) >= ratio)
        return scored.where((F.col("n_c") < total) & (pmi >= alpha * F.log(n / F.col("n_c"))) & borne)

    # a term is in at least as many documents as it is near one entity in; both
    # conditions only get harder with its frequency, so what fails here is out
    near = counts.where("term <> ''")
    least = near.groupBy("term").agg(F.max("n_ct").alias("n_t"))
    candidates = persist_table(disclosing(near.join(least, "term").join(held, "entity")).drop("n_t"), "candidates")
    maybe_bits = _bits(candidates)

    def freq(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maybe, seen = _Maybe(maybe_bits), Counter()
        for b in batches:
            for text in b["text"]:
                if text:
                    seen.update(t for t in _terms(text) if maybe[t])
            if len(seen) > 200_000:
                yield pd.DataFrame({"term": list(seen.keys()), "n_t": list(seen.values())})
                seen.clear()
        yield pd.DataFrame({"term": list(seen.keys()), "n_t": list(seen.values())}).astype({"n_t": "int64", "term": "object"})

    freqs = persist_table(src.mapInPandas(freq, "term string, n_t long").groupBy("term").agg(F.sum("n_t").alias("n_t")), "freqs")
    terms = persist_table(disclosing(candidates.join(freqs, "term")).select("term").distinct(), "terms")
    drop_tables(counts, candidates, freqs)
    return terms


def known_terms(terms: DataFrame) -> frozenset[str] | None:
    """The terms themselves, if at most ``TERMS_SENT``; else they stay where
    they are and positions are confirmed by joins."""
    return frozenset(terms.toPandas()["term"]) if terms.count() <= TERMS_SENT else None


def term_spans(text: str | None, base: list[tuple[int, int, str]], terms: frozenset[str]) -> list[tuple[int, int, str]]:
    """Occurrences of terms outside the spans of the patterns."""
    if not text or not terms or _terms(text).isdisjoint(terms):
        return []
    return [(m.start(), m.end(), "term") for m in _TERM.finditer(text) if m[0].lower() in terms and not any(m.start() < e and m.end() > s for s, e, _ in base)]


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None, **kw) -> DataFrame:
    """Per document: id, counts per base kind, base_sha256, spans, and ``rid``,
    the row's number in the scan."""
    terms = disclosing_terms(docs, text_col, **kw) if terms is None else terms
    exact = known_terms(terms)
    src = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("rid"))
    kind = src.schema[id_col].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                rows = []
                for part in text_slices(b.column(1), GROUP_BYTES):
                    for text in part.to_pylist():
                        base = base_spans(text)
                        n = Counter(k for _, _, k in base)
                        rows.append((*(n[k] for k in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + term_spans(text, base, exact))))
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2)], b.column(2)], [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "rid"])
        finally:
            release()

    if exact is not None:
        return src.mapInArrow(whole, f"{id_col} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, rid long").select(id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "rid")
    bits = _bits(terms)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maybe = _Maybe(bits)
        for b in batches:
            rows = []
            for doc, text, rid in b[[id_col, "text", "rid"]].itertuples(index=False, name=None):
                spans = base_spans(text)
                n = Counter(k for _, _, k in spans)
                may: list[dict] = []
                if text and any(maybe[t] for t in _terms(text)):
                    edge = [(s, e) for s, e, _ in spans]
                    for m in _TERM.finditer(text):
                        if maybe[t := m[0].lower()] and not any(m.start() < e and m.end() > s for s, e in edge):
                            may.append({"term": t, "a": m.start(), "b": m.end()})
                said = joined(spans)
                rows.append((doc, rid, *(n[k] for k in KINDS[:4]), hashlib.sha256(said.encode()).hexdigest(), said, may))
            yield pd.DataFrame(rows, columns=[id_col, "rid", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "may"])

    found = src.mapInPandas(scan, f"{id_col} {kind}, rid long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, may array<struct<term:string,a:int,b:int>>")
    found = persist_table(found, "found")
    sure = (
        found.select("rid", F.explode("may").alias("m")).select("rid", "m.*")
        .join(terms, "term", "left_semi")
        .groupBy("rid").agg(F.collect_list(F.struct("a", F.lit(4).alias("k"), F.concat_ws(":", F.lit("term"), "a", "b").alias("s"))).alias("more"))
    )  # a list is bounded by its document
    base = F.filter(F.split("base", ","), lambda s: s != "")
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    base = F.transform(base, lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("a"), F.element_at(order, F.split_part(s, F.lit(":"), F.lit(1))).alias("k"), s.alias("s")))
    every = F.transform(F.array_sort(F.concat(base, F.coalesce("more", F.array().cast("array<struct<a:int,k:int,s:string>>")))), lambda x: x["s"])
    return found.join(sure, "rid", "left").select(id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(every, ",").alias("spans"), "rid")


def rewrite(text: str | None, spans: str | None) -> str | None:
    """Spans replaced by their kind in capitals; overlapping ones as one."""
    if not text or not spans:
        return text
    out, done = [], 0
    for s in spans.split(","):
        k, a, b = s.split(":")
        a, b = int(a), int(b)
        if a >= done:
            out += [text[done:a], k.upper()]
        done = max(done, b)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with all spans generalised, same rows and columns; an integer
    column ``n_chars`` is counted anew. Spans depend on the text alone, so
    documents meet them by id and text hash."""
    exact = known_terms(terms := disclosing_terms(docs, text_col, **kw))
    full = docs.withColumn("__spans", F.lit(None).cast("string"))
    if exact is None:  # spans come by a join
        keyed = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text_col, F.lit(""))))
        spans = find_spans(keyed, "__h", text_col, terms=terms, **kw).where("spans <> ''").groupBy("__h").agg(F.first("spans").alias("__spans"))
        full = keyed.join(spans, "__h", "left").drop("__h")
    out = docs.schema

    names = docs.columns
    counted = [c for c in ("n_chars",) if c in names and out[c].dataType.typeName() in ("long", "integer")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                at = b.schema.names.index
                column = dict(zip(b.schema.names, b.columns))
                texts: list[str | None] = []
                for part in text_slices(column[text_col], GROUP_BYTES):
                    said = part.to_pylist()
                    if exact is None:
                        spans = column["__spans"].slice(len(texts), len(part)).to_pylist()
                    else:
                        spans = [joined((base := base_spans(t)) + term_spans(t, base, exact)) for t in said]
                    texts += map(rewrite, said, spans)
                column[text_col] = pa.array(texts, b.column(at(text_col)).type)
                for c in counted:
                    column[c] = pc.utf8_length(column[text_col]).cast(b.column(at(c)).type)
                yield pa.RecordBatch.from_arrays([column[c] for c in names], names)
        finally:
            release()

    return full.mapInArrow(run, out)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents")).drop("rid")


QUERIES = {"op7_pii": op7_pii}
ORACLE: dict[str, str] = {}
