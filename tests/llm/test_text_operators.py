"""Row-local operators against plain versions: quality, personal data,
language, BPE and token output."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from lexora.llm import bpe, language, pii, quality, tokens  # noqa: E402
from lexora.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "x" * 5000, "same line here\nsame line here\n", "naïve   café x", "日本語 текст", "<|endoftext|> a <|startoftext|>", "a@b.c" * 50]


def docs_of(spark, texts, extra=True):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    return df if extra else df.select("doc_id", "text")


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, total = len(words), sum(map(len, words))
    hit3 = [False] * n
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    for i in range(n - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            hit3[i : i + 3] = [True] * 3
    lines, dup, chars = set(), 0, 0
    for line in (text or "").split("\n"):
        w = re.findall(r"[^\x20\x09-\x0D]+", line)
        if w:
            dup += line in lines
            chars += sum(map(len, w)) * (line in lines)
            lines.add(line)
    failed = n < 50 or 100 * sum(hit3) > 50 * n
    bad = n and chars / total > quality.LINE_CHAR_LIMIT
    for size, limit in quality.NGRAM_LIMITS.items():
        grams = collections.Counter(tuple(words[i : i + size]) for i in range(n - size + 1))
        hit = [False] * n
        for i in range(n - size + 1):
            if grams[tuple(words[i : i + size])] > 1:
                hit[i : i + size] = [True] * size
        bad = bad or (n and sum(len(w) for w, h in zip(words, hit) if h) / total > limit)
    return n, total, sum(c in "#*$%&|<>" for c in text or ""), dup, sum(hit3), failed, not (failed or bad)


def test_quality_matches_plain_version(spark):
    rnd = random.Random(1)
    texts = ODD + ["\n".join(" ".join(rnd.choice("ab cd ef gh #x ij".split()) for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    texts += [r.text for r in table(spark, SF, "documents").collect()]
    got = {r.doc_id: tuple(r)[1:8] for r in quality.quality_figures(docs_of(spark, texts)).collect()}
    assert got == {i: plain_quality(t) for i, t in enumerate(texts)}
    kept = quality.keep_good(docs_of(spark, texts))
    assert kept.columns == ["doc_id", "text", "kept", "n_words"]
    assert {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if v[-1]}
    assert quality.quality_figures(docs_of(spark, texts).limit(0)).count() == 0


def plain_spans(text):
    """The base patterns run as they are."""
    out = []
    text = text or ""
    out += [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_match_the_patterns(spark):
    rnd = random.Random(2)
    pieces = ["a@b.c", "@", ".", "x.y", "1.2.3.4", "255", "999", "4111 1111 1111 1111", "+1 (234) 567-8901", "+", "-", " ", "_", "%", "é", "0" * 20, "12"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    texts += [r.text for r in table(spark, SF, "documents").collect()] + ODD
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


@pytest.mark.parametrize("sent", [pii.TERMS_SENT, 0])
def test_disclosing_terms(spark, sent, monkeypatch):
    monkeypatch.setattr(pii, "TERMS_SENT", sent)
    filler = [f"word{'abcdefghij'[i % 10]} and the other day number {i}" for i in range(60)]
    name = [f"{p} please write to Zebulon at zeb@site.org and the rest {p}" for p in ("one", "two", "three", "four")]
    texts = ODD[:3] + filler + name + ["Zebulon alone in a text", name[0]]
    docs = docs_of(spark, texts)
    # plain version of the counts
    near, df, ent, sup = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for t in texts:
        for w in set(re.findall(r"[^\W\d_]{3,}", (t or "").lower())):
            df[w] += 1
        for c, ws in pii.near_terms(t or "", pii.base_spans(t), pii.WINDOW).items():
            ent[c] += 1
            for w in ws:
                near[c, w] += 1
                sup[c, w].add(t)
    n = len(texts)
    want = {w for (c, w), k in near.items() if len(sup[c, w]) >= pii.SUPPORT and math.log(k * n / (ent[c] * df[w])) >= pii.ALPHA * math.log(n / ent[c])}
    got = {r.term for r in pii.disclosing_terms(docs).collect()}
    assert got == want and "please" in got and "and" not in got
    rows = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base = plain_spans(t)
        terms = [(m.start(), m.end(), "term") for m in re.finditer(r"[^\W\d_]{3,}", t or "") if m[0].lower() in want and not any(m.start() < e and m.end() > s for s, e, _ in base)]
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert rows[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert rows[i].spans == pii.joined(base + terms)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert len(clean) == len(texts) and clean[0] is None
    assert not any("zeb@" in (t or "") or "please" in (t or "") for t in clean.values())


def test_sanitise_keeps_other_columns(spark):
    big = (1 << 60) + 1
    rows = [(None, "a@b.cd and x", 5, None, big), (1, None, None, "s", None), (1, "plain ΟΔΟΣ İx text", 7, "s", big), (1, "plain ΟΔΟΣ İx text", 7, "s", big)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string, rid long")
    got = pii.sanitise(docs)
    assert got.dtypes == docs.dtypes
    strip = lambda rs: sorted(tuple(map(str, r)) for r in rs)
    assert strip(got.collect()) == strip([(None, "EMAIL and x", 11, None, big), (1, None, None, "s", None), (1, rows[2][1], 18, "s", big), (1, rows[2][1], 18, "s", big)])
    assert pii.sanitise(docs.limit(0)).count() == pii.find_spans(docs.limit(0)).count() == 0
    assert pii._terms("ΟΔΟΣ ΟΔΟΣ") == {"ΟΔΟΣ".lower()}


def test_terms_beside_entities_of_one_text(spark):
    names = ["Quillon", "Vasterby", "Ombrecht", "Tarwinkel", "Ysolde"]
    filler = [f"word{'abcdefghij'[i % 10]} and the other day with plenty of rest" for i in range(300)]
    texts = filler + [f"and the other day mailto {w} under {w[:3]}x@{w[1:4]}y.org with plenty of rest" for w in names]
    docs = docs_of(spark, texts)
    got = {r.term for r in pii.disclosing_terms(docs).collect()}
    assert got == {w.lower() for w in names} | {"mailto", "under"}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[300] == "and the other day TERM TERM TERM EMAIL with plenty of rest" and clean[0] == texts[0]
    # seen once each, but among few documents: no evidence
    assert pii.disclosing_terms(docs_of(spark, texts[295:301])).count() == 0


def test_automaton_parses_like_substring_search(spark):
    rnd = random.Random(3)
    samples = {k: "".join(rnd.choice(a) for _ in range(300)) for k, a in (("aa", "abc "), ("bb", "bcd "))}
    parser = language.Parser(samples)
    for _ in range(60):
        text = "".join(rnd.choice("abcdx ") for _ in range(rnd.randint(1, 200)))
        code = language.plain(text)
        if not (code != 32).any():
            continue
        said = "".join(map(chr, code))
        want = []
        for name in parser.names:
            train = "".join(map(chr, language.plain(samples[name])))
            i = n = 0
            while i < len(said):
                j = i + 1
                while j <= len(said) and said[i:j] in train:
                    j += 1
                i = max(i + 1, j - 1)
                n += 1
            want.append(n)
        for block in (1, 3, 7, 1024):  # blocks do not show in the counts
            assert [parser.phrases(a, [parser.map[code], parser.map[code[:5]]], block)[0] for a in parser.automata] == want


def test_language_accuracy_and_edges(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    samples = language.learn(docs.where(~language.held_out()))
    got = language.identify(docs, samples).join(docs.where(language.held_out()).select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()
    odd = {r.doc_id: r for r in language.identify(docs_of(spark, ODD + ["12 34 !"]), samples).collect()}
    assert len(odd) == len(ODD) + 1
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2, 3, len(ODD)))
    assert language.identify(docs_of(spark, ["a"]), {}).first().lang_pred == "und"


def test_language_of_large_alphabets(spark, monkeypatch):
    rnd = random.Random(12)
    text = lambda a, z, n: "".join(chr(rnd.randint(a, z)) if rnd.random() < 0.9 else " " for _ in range(n))
    scripts = {"han": (0x4E00, 0x4E00 + 6500), "ko": (0xAC00, 0xAC00 + 3000), "th": (0x0E01, 0x0E2E), "en": (97, 122)}
    samples = {k: text(*v, 12_000) for k, v in scripts.items()}
    parser = language.Parser(samples)
    assert len(np.unique(parser.map)) > 6000 and all(parser.map[ord(c)] for s in samples.values() for c in s if c != " ")
    tests = [(k, text(*v, 300)) for k, v in scripts.items() for _ in range(5)]
    got = [g[0] for g in parser.predict([t for _, t in tests])]
    assert got == [k for k, _ in tests]
    monkeypatch.setattr(language, "DENSE", 0)
    assert language.Parser(samples).predict([t for _, t in tests])[0] == parser.predict([tests[0][1]])[0]
    unseen = parser.predict(["русский текст без образца", "Ελληνικά"])
    assert all(g[0] in samples and 0 <= g[1] <= 1 for g in unseen)
    # a large group of copies is one text of the sample
    rows = [("a", "copy of one text")] * 500 + [("a", f"text {chr(97 + i % 26)}{chr(97 + i // 26)} apart") for i in range(60)] + [(None, "x"), ("b", None)]
    learned = language.learn(spark.createDataFrame(rows, "lang string, text string"), rows=50)
    assert set(learned) == {"a"} and learned["a"].count("copy of") <= 1 and learned["a"].count("apart") >= 49
    assert language.identify(docs_of(spark, ["a"]).limit(0), samples).count() == 0


def random_texts(seed, n):
    rnd = random.Random(seed)
    bits = list(" \n\t'sStdll 0123abcéßñ日本́\x1c\x85 .,!") + ["<|endoftext|>", "'ll", "the", "  ", "Ġ", "<|startoftext|>"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_bpe_equals_library_and_round_trips(spark):
    path = bpe.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = random_texts(4, 1500) + ODD + ["ab" * 900, "!" * 500, "word" * 60] + [r.text for r in table(spark, SF, "documents").limit(60).collect()]
    got = {r.doc_id: r for r in bpe.encode_decode(docs_of(spark, texts), path, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == back, t
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    small = bpe.Bpe(path, cache_size=50)  # a cache that keeps overflowing
    for t in texts[:300]:
        assert small.encode(t)[0].tolist() == lib.encode(t or "", add_special_tokens=False).ids
    words = ["aaaaaaaaa", " thethethe", "überraschung", "日本語のテキスト", "x", "!!!!====!!!!"] + ["ab" * k for k in range(1, 9)]
    base = [small.base[list(w.encode())] for w in words]
    ids, counts = small.merge_all(np.concatenate(base), np.array([len(b) for b in base]))
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == small.exact(words[0].encode())
    assert ids.tolist() == [i for w in words for i in small.exact(w.encode())]
    assert bpe.encode_decode(docs_of(spark, texts).limit(0), path).count() == 0


def test_token_file_round_trip(spark, tmp_path):
    path = bpe.vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = random_texts(5, 300) + ODD + ["word " * 60_000] + [r.text for r in table(spark, SF, "documents").limit(60).collect()]
    docs = docs_of(spark, texts).repartition(3)
    tokens.write_tokens(docs, f"{tmp_path}/out", path)
    rows = sorted(tokens.read_tokens(spark, f"{tmp_path}/out", with_ids=True).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, t in zip(rows, texts, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [tokens.END_ID]
        assert r.ids == ids and r.start == at and r.n_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        at += len(ids)
    tokens.write_tokens(docs.limit(0), f"{tmp_path}/none", path)
    assert tokens.read_tokens(spark, f"{tmp_path}/none").count() == 0


def test_word_tokenizer_equals_library_with_small_caches():
    path = bpe.vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(11)
    marks = "aAeEsSéÉ'’0²½<|>/w_ \t\n\x0b\xa0\u0301İıſŉµªº×÷¼.-#&ΣК語👍"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ODD + ["<|endoftext|> x<|startoftext|>y <|EndOfText|>", "it's I'LL 'Re’s x²y", "H\u0331 İstanbul </w> a</w>b"]
    for ids, t in zip(tokens.WordTokenizer(path, cache_size=100).encode_many(pa.array(texts)), texts, strict=True):
        assert ids.tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def test_damaged_block_is_found():
    ids = np.arange(2 * tokens.LANES * 2 + 9) % 97
    tab = tokens.Table.from_counts(np.bincount(ids))
    parted = tab.encode(ids, every=2)
    assert tab.checkpoints(parted) == 3
    assert (np.concatenate([tab.decode(parted, k) for k in range(3)]) == ids).all() and (tab.decode(parted) == ids).all()
    data = bytearray(tab.encode(ids))
    assert (tab.decode(bytes(data)) == ids).all()
    data[-3] ^= 5
    assert zlib.crc32(data) != zlib.crc32(tab.encode(ids))  # what a reader checks first
    with pytest.raises(ValueError):
        tab.decode(b"XXXX" + bytes(data[4:]))
