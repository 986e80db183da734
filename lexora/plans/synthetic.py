"""Annotations synthesised from documents: one song per document. Workers make
the lines where they parse them; ``queries.annotation_lines`` is the same in
columns."""

from __future__ import annotations

import re

import pyarrow as pa

from lexora.operators import annotations as A

TAGS = [*A.POS, "PUNCT", "X", "_"]
FEATS = ["_", "Gender=Masc|Number=Sing", "Gender=Fem,Masc|Number=Plur|Person=3", "HebBinyan=PAAL|Tense=Past|HebRoot=k.t.b", "HebBinyan=PIEL|Mood=Imp|Person=2", "Tense=Fut|Person=1|Number=Sing", "VerbForm=Inf", "VerbForm=Part|HebBinyan=HIFIL|HebRoot=sh.m.r,l.m.d", "DictaNote=Unknown", "Tense=Pres|Voice=Act"]
_WORD = re.compile("[a-z]+")
_IDS: list[tuple[str, bool, bool]] = []


def _id(i: int) -> tuple[str, bool, bool]:
    """A row's first field, and whether lemma and last fields are left out."""
    tid = f"{i}-{i + 1}" if i % 17 == 0 else f"{i}.1" if i % 19 == 0 else f"x{i}" if i % 23 == 0 else str(i)
    return tid, i % 31 == 0, i % 29 == 0


def lines(doc_id: int, source: str | None, lower: str | None) -> tuple[list[int], list[str | None]]:
    """Numbers and texts of a document's lines; ``lower`` is its text."""
    words = _WORD.findall(lower or "")
    _IDS.extend(_id(i) for i in range(len(_IDS) + 1, len(words) + 1))
    title, blank = f"# text = ### T{doc_id}", doc_id % 5 == 0
    again = source and f"# text = / {source}"
    out = [title if blank else source and f"{title} / {source}", "1\tt\tt\tNOUN\t_\t_", "", again if blank else "# text = / ignored", "1\tt2\tt2\tNOUN\t_\t_" if blank else "# note", ""]
    i = 0
    for w, (tid, bare, short) in zip(words, _IDS):
        i += 1
        tag = TAGS[(len(w) * 7 + i) % 16]
        lemma = "_" if bare else w
        out.append(f"{tid}\t{w}\t{lemma}\t{tag}" if short else f"{tid}\t{w}\t{lemma}\t{tag}\t{tag}\t{FEATS[(doc_id + i) % 10]}")
    at = doc_id * 100000
    return [*range(at, at + 6), *range(at + 11, at + 11 + len(words))], out


def unpack(batch: pa.RecordBatch) -> list[tuple[str, list[int], list[str | None]]]:
    return [(file, *lines(i, source, lower)) for file, i, source, lower in zip(*(batch.column(n).to_pylist() for n in ("file", "doc_id", "source", "lower")))]
