"""License scans: exact base phrases and a fuzzy search for short notices.

A text is reduced to its words (see ``normalise``). A notice of m characters
with at most k errors is split into k + 1 pieces, one of which must stand
unchanged (pigeonhole). An Aho-Corasick automaton finds the pieces of all
notices in one pass; around each hit the ``regex`` library's bounded-error
matching verifies the notice and reports its span and edits.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlens.llm.common import map_arrow, with_columns_of

#: phrase and label of the base search
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: label and wording of the notices of the fuzzy search
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("gpl", "licensed under the gnu general public license version"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("reserved", "all rights reserved"),
]
#: share of a notice's characters that may be wrong
ERRORS = 0.1

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normalise(text: str | None) -> tuple[str, int]:
    """The words, each between single blanks (one character per byte), and their number.

    A-Z are lower-cased; words are runs of 0-9, a-z and non-ASCII characters.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return (b" " + b" ".join(words) + b" ").decode("latin-1") if words else " ", len(words)


def base_places(s: str, phrases=BASE) -> list[tuple[int, str]]:
    """``(first word, label)`` of all places, overlapping ones too."""
    out = []
    for phrase, label in phrases:
        needle = f" {phrase} "
        at = s.find(needle)
        while at >= 0:
            out.append((s.count(" ", 0, at), label))
            at = s.find(needle, at + 1)
    return out


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """The notice split into ``errors + 1`` pieces of about equal length, with their places."""
    cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Finder:
    """Automaton over the pieces, and one bounded-error pattern per notice."""

    def __init__(self, notices=None, errors: float = ERRORS):
        import ahocorasick
        import regex

        self.notices = [(label, text, int(len(text) * errors)) for label, text in (NOTICES if notices is None else notices)]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(t, literal_spaces=True)}){{e<={k}}}") for _, t, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, k) in enumerate(self.notices):
            for at, piece in pieces(text, k):
                seeds.setdefault(piece, []).append((i, at))
        self.machine = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.machine.add_word(piece, (len(piece), places))
        if seeds:
            self.machine.make_automaton()
        self.empty = not seeds

    def find(self, s: str) -> list[tuple[str, int, int, int, float]]:
        """``(label, start, end, edits, similarity)`` of verified notices, by characters of ``s``."""
        if self.empty:
            return []
        found: dict[tuple[int, int, int], tuple] = {}
        done: dict[int, int] = {}
        for end, (size, places) in self.machine.iter(s):
            for i, at in places:
                label, text, k = self.notices[i]
                start = end - size + 1 - at
                if done.get(i, -1) == start:
                    continue  # another piece of the same place
                done[i] = start
                m = self.patterns[i].search(s, max(0, start - k), min(len(s), start + len(text) + k))
                if m:
                    found.setdefault((i, *m.span()), (label, *m.span(), sum(m.fuzzy_counts), 1 - sum(m.fuzzy_counts) / len(text)))
        return sorted(found.values(), key=lambda x: (x[1], x[2], x[0]))


@functools.lru_cache(4)
def _finder(errors: float) -> Finder:
    return Finder(errors=errors)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, n_found long, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                    ("n_found", pa.int64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()),
                                                                            ("last_word", pa.int64()), ("edits", pa.int32())])))])


def scan_text(text: str | None, finder: Finder) -> dict:
    s, n = normalise(text)
    base = base_places(s)
    found = finder.find(s)
    labels = {x for _, x in base}
    spans = [{"label": x, "first_word": max(0, s.count(" ", 0, a + (s[a] == " ")) - 1),
              "last_word": max(0, s.count(" ", 0, b - 1) - 1), "edits": e} for x, a, b, e, _ in found]
    return {"n_words": n, "n_base": len(base), "first_word": min((w for w, _ in base), default=None),
            "last_word": max((w for w, _ in base), default=None), "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {x[0] for x in found})),
            "score": 1.0 if base else max((x[4] for x in found), default=0.0), "n_found": len(found), "spans": spans}


def scan(documents: DataFrame, errors: float = ERRORS) -> DataFrame:
    """One row per document: words, base places, labels, score and the verified notices' word spans.

    ``score`` is the best similarity found (1 for a base phrase, 0 without a
    find). Whole texts are read in one pass without a shuffle. A null text is
    empty: no words, no labels. Rows are independent, so repeated rows, null
    ids and extra columns need no care. An empty table gives no rows.
    """
    with_columns_of(documents, "doc_id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        finder = _finder(errors)
        rows = [{"doc_id": i.as_py(), **scan_text(t.as_py(), finder)} for i, t in zip(batch.column(0), batch.column(1))]
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return map_arrow(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
