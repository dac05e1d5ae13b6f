"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes.

A text is encoded as space+text by a byte-level BPE (A) and by a sentencepiece
model with byte fallback (B, which adds the space itself). Byte offsets where
tokens of both end cut them into groups; every A token of a group is linked
with every B token of it. The number of documents in which a pair of ids is
linked, over the whole corpus, tells good alignments from chance ones.

Token ends: A's character offsets and B's character spans are coarse cuts, exact
wherever a token ends with a character. Tokens that end inside one (pieces of
multibyte characters, byte fallbacks) are placed between two such cuts by the
lengths of their decoded bytes. The joined bytes are then compared with the
text. B's spans are those of the library's offset mapping; the immutable proto
that carried them before is gone from it.

Neither tokenizer joins characters across a single space between two
characters that are no white space, so texts are cut there and the distinct
units of some megabytes of texts are aligned at once; a text without such spaces is one unit.
Models for which this cannot be shown take each text as one unit.

Counting and scoring are joins on the pair. Pairs in more than one row of 2**18
are fewer than 2**18, so they are broadcast; the others are shuffled.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlens.llm.common import with_columns_of, written
from contactlens.llm.tokenizers import tokenizer_path

BYTE_MODEL, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: bytes of texts whose distinct units are aligned together (one text is never cut), and characters of units encoded as one text
SLICE, LINE = 4_000_000, 4_000
#: characters given to the libraries at once, and pairs of texts added up at once (whole texts)
AT_ONCE, PAIRS = 200_000, 500_000
#: links of a group from which on they are counted by its distinct ids
LARGE = 1 << 14
#: pairs in more than total / 2**FREQUENT rows are broadcast: fewer than 2**FREQUENT rows of 24 bytes
FREQUENT = 18
#: factor of the A id in a pair's number
WIDE = 1 << 32

_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level BPE writes for each byte, by its rule: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Units:
    """Alignments of many units: per unit its tokens of A and B, groups and links, its groups as text, and its linked pairs.

    ``pairs[first[i]:first[i + 1]]`` are unit i's distinct pairs, sorted, and
    ``times`` their links. A unit that one side does not give back byte for
    byte has ``ok`` false.
    """

    __slots__ = ("ok", "numbers", "text", "pairs", "times", "first")

    def __init__(self, ok: np.ndarray, numbers: np.ndarray, text: list[str], pairs: np.ndarray, times: np.ndarray, first: np.ndarray):
        self.ok, self.numbers, self.text, self.pairs, self.times, self.first = ok, numbers, text, pairs, times, first


def _summed(owner: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (owner, pair) in order, with the sums of ``times``."""
    if not len(pair):
        return owner, pair, times
    known, place = np.unique(pair, return_inverse=True)
    order = np.argsort(owner * len(known) + place, kind="stable")
    key = (owner * len(known) + place)[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key = key[first]
    return key // len(known), known[key % len(known)], np.add.reduceat(times[order], first)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i], start[i] + 1, ... (size[i] of them) for all i in one array."""
    total = np.cumsum(size)
    return np.repeat(start - total + size, size) + np.arange(total[-1] if len(total) else 0)


class Aligner:
    """Both tokenizers with the bytes of all their tokens."""

    def __init__(self, byte_model: str, piece_model: str):
        self.A = tokenizers.Tokenizer.from_file(byte_model)
        self.A.encode_special_tokens = True  # special tokens' strings in a text are plain text
        self.B = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        letters = byte_alphabet()
        vocabulary = self.A.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in self.A.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.b_bytes = [self._piece(i) for i in range(self.B.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        n = max(len(self.a_bytes), len(self.b_bytes))
        # an id's decimal text with what follows it: another token of its side, the other side, another group
        self.written = [np.array([f"{i}{c}" for i in range(n)], object) for c in ",|;"]
        self.separable = self._separable()

    def _piece(self, i: int) -> bytes:
        if self.B.is_byte(i):
            return bytes([int(self.B.id_to_piece(i)[3:5], 16)])
        return b"" if self.B.is_control(i) or self.B.is_unknown(i) else self.B.id_to_piece(i).replace("▁", " ").encode()

    def _separable(self) -> bool:
        """Whether no token of either model can cross a single space between two characters that are no white space."""
        pre = self.A.pre_tokenizer
        a = self.A.normalizer is None and isinstance(pre, tokenizers.pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
        # pieces with a space behind another character could be merged over the cut; normalisers could look over it
        b = all(" " not in p.decode("utf-8", "replace").lstrip(" ") for p in self.b_bytes)
        probe = "ﬁ x ① ½ é  Å"
        return a and b and self.B.normalize(probe).replace("▁", " ").lstrip(" ") == probe

    def cut(self, text: str) -> list[str]:
        """The units between the cuts; each stands behind a space."""
        return _CUT.split(text) if self.separable else [text]

    def _lines(self, units: list[str]) -> list[list[int]]:
        """Units (by number) that are encoded as one text, joined by single spaces."""
        lines, line, size = [], [], 0
        for i, u in enumerate(units):
            if not self.separable or not u or len(u.strip()) < len(u) or len(u) > LINE:
                lines.append([i])
                continue
            line.append(i)
            size += len(u)
            if size > LINE:
                lines.append(line)
                line, size = [], 0
        return [*lines, line] if line else lines

    def _encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """Per text: ids and byte ends of A's tokens and of B's in space+text; None if one side's bytes are others."""
        out, at, size = [], 0, 0
        for k, t in enumerate(texts):  # the libraries' own objects take some 300 bytes a token
            size += len(t)
            if size > AT_ONCE or k + 1 == len(texts):
                out += self._spans(texts[at:k + 1])
                at, size = k + 1, 0
        return out

    def _spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        out = []
        pieces = self.B.encode(texts, return_type="offset_mapping", num_threads=1)
        for text, x, y in zip(texts, self.A.encode_batch([" " + t for t in texts], add_special_tokens=False), pieces, strict=True):
            data, a, b = b" " + text.encode(), x.ids, y["ids"]
            if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
                out.append(None)
                continue
            byte_of = _byte_places(text)
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            a_spans, b_spans = (np.fromiter(chain.from_iterable(s), np.int64, 2 * len(s)).reshape(-1, 2) for s in (x.offsets, y["offsets"]))
            out.append((a, _ends(a_spans, self.a_size[a], np.concatenate([[0], byte_of + 1])),  # A's character 0 is the space
                        b, _ends(b_spans, self.b_size[b], byte_of + 1)))
        return out

    def units(self, units: list[str]) -> Units:
        """The alignments of space+unit for all ``units``."""
        lines = self._lines(units)
        got = self._encoded([" ".join([units[i] for i in line]) for line in lines])
        # one of a line's units is not given back: each of them is encoded alone
        again = [[i] for line, x in zip(lines, got, strict=True) if x is None and len(line) > 1 for i in line]
        found = [(line, x) for line, x in zip(lines, got, strict=True) if x is not None]
        found += [(line, x) for line, x in zip(again, self._encoded([units[i] for [i] in again]) if again else [], strict=True) if x is not None]

        n = len(units)
        ok, numbers, text = np.zeros(n, bool), np.zeros((4, n), np.int64), [""] * n
        if not found:
            return Units(ok, numbers, text, *(np.zeros(0, np.int64),) * 2, np.zeros(n + 1, np.int64))
        # all lines as one run of bytes; `order` are the units as they stand in it
        order = np.concatenate([line for line, _ in found])
        unit_ends = np.cumsum([1 + len(units[i].encode()) for i in order])
        base = np.concatenate([[0], unit_ends[np.cumsum([len(line) for line, _ in found]) - 1][:-1]])
        a, b = (np.concatenate([x[k] for _, x in found]) for k in (0, 2))
        a_ends, b_ends = (np.concatenate([x[k] + s for (_, x), s in zip(found, base, strict=True)]) for k in (1, 3))

        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_to, b_to = np.searchsorted(a_ends, cuts, "right"), np.searchsorted(b_ends, cuts, "right")
        a_n, b_n = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
        unit_of = np.searchsorted(unit_ends, cuts)  # of each group
        whole = np.searchsorted(cuts, unit_ends, "right")  # groups up to each unit's end
        ok[order] = True
        for k, x in enumerate((a_n, b_n, np.ones(len(cuts), np.int64), a_n * b_n)):
            numbers[k, order] = np.diff(np.concatenate([[0], np.cumsum(x)])[whole], prepend=0)

        # groups as text: A's tokens, then B's, each with what follows
        group_a, group_b = np.repeat(np.arange(len(cuts)), a_n), np.repeat(np.arange(len(cuts)), b_n)
        tokens = np.empty(len(a) + len(b), object)
        last = np.zeros(len(a), np.int64)
        last[a_to - 1] = 1
        b_before = np.concatenate([[0], b_to])
        tokens[np.arange(len(a)) + b_before[group_a]] = np.where(last, self.written[1][a], self.written[0][a])
        last = np.zeros(len(b), np.int64)
        last[b_to - 1] = 1
        tokens[np.arange(len(b)) + a_to[group_b]] = np.where(last, self.written[2][b], self.written[0][b])
        tokens, at = tokens.tolist(), 0
        upto = np.concatenate([[0], a_to + b_to])[whole]
        for i, to in zip(order.tolist(), upto.tolist(), strict=True):
            text[i] = "".join(tokens[at:to])[:-1]
            at = to

        owner, pair, times = [], [], []
        large = a_n * b_n > LARGE
        small = ~large[group_a]
        size = b_n[group_a[small]]
        owner.append(np.repeat(unit_of[group_a[small]], size))
        pair.append(np.repeat(a[small] * WIDE, size) + b[_runs((b_to - b_n)[group_a[small]], size)])
        times.append(np.ones(len(pair[0]), np.int64))
        for g in np.flatnonzero(large):  # by the distinct ids of each side
            (x, m), (y, k) = (np.unique(t[to[g] - c[g]:to[g]], return_counts=True) for t, to, c in ((a, a_to, a_n), (b, b_to, b_n)))
            pair.append((x[:, None] * WIDE + y[None, :]).ravel())
            times.append((m[:, None] * k[None, :]).ravel())
            owner.append(np.full(len(pair[-1]), unit_of[g]))
        owner, pair, times = _summed(order[np.concatenate(owner)], np.concatenate(pair), np.concatenate(times))
        return Units(ok, numbers, text, pair, times, np.searchsorted(owner, np.arange(n + 1)))

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Numbers (A tokens, B tokens, groups, links) per text, its groups as text, and its pairs as in ``Units``."""
        place: dict[str, int] = {}
        rows = [[place.setdefault(u, len(place)) for u in self.cut(t)] if t else [] for t in texts]
        units = self.units(list(place))
        rows = [np.array(r, np.int64) for r in rows]
        rows = [r if units.ok[r].all() else r[:0] for r in rows]
        size = np.array([len(r) for r in rows], np.int64)
        flat, doc = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), size)
        upto = np.concatenate([[0], np.cumsum(size)])
        total = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(units.numbers[:, flat], axis=1)], axis=1)[:, upto]
        text = [";".join([units.text[u] for u in r.tolist()]) for r in rows]
        # a unit that a text holds several times counts at once
        doc, unit, copies = _summed(doc, flat, np.ones(len(flat), np.int64))
        count = units.first[unit + 1] - units.first[unit]
        parts = [(np.zeros(0, np.int64),) * 3]
        upto = np.cumsum(count)
        i = 0
        while i < len(doc):  # some texts at a time, whole ones
            j = max(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS), i + 1)
            j = np.searchsorted(doc, doc[j - 1], "right")
            at = _runs(units.first[unit[i:j]], count[i:j])
            parts.append(_summed(np.repeat(doc[i:j], count[i:j]), units.pairs[at], units.times[at] * np.repeat(copies[i:j], count[i:j])))
            i = j
        doc, pairs, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        return np.diff(total, axis=1), text, pairs, times, np.searchsorted(doc, np.arange(len(rows) + 1))


def _byte_places(text: str) -> np.ndarray:
    """Where each character of the text begins in its UTF-8 form, and its end."""
    if text.isascii():
        return np.arange(len(text) + 1)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))])


def _ends(spans: np.ndarray, size: np.ndarray, byte_of: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: of those that end with a character by its place, of others by the bytes since the last such.

    A token ends with its span's last character if the next one begins there or
    later; else more tokens of that character follow. Of a character's byte
    fallbacks only the last has a span that is not empty.
    """
    coarse = spans[:, 1] > spans[:, 0]
    coarse[:-1] &= spans[1:, 0] >= spans[:-1, 1]
    ends = byte_of[spans[:, 1]]
    if coarse.all():
        return ends
    total = np.cumsum(size)
    last = np.maximum.accumulate(np.where(coarse, np.arange(len(size)), -1))  # the last token placed by its span
    since = np.where(last >= 0, ends[last] - total[last], 0)
    return np.where(coarse, ends, total + since)


@lru_cache(maxsize=2)
def _aligner(byte_model: str, piece_model: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    return Aligner(byte_model, piece_model)


DOCUMENT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def _encode(byte_model: str, piece_model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_model, piece_model)
        for batch in batches:
            at, size = 0, 0
            for k, n in enumerate(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
                size += n
                if size > SLICE or k + 1 == batch.num_rows:
                    part = batch.slice(at, k + 1 - at)
                    yield _batch(part.column(0), aligner.documents(part.column(1).to_pylist()))
                    at, size = k + 1, 0
    return run


def _batch(ids: pa.Array, found: tuple) -> pa.RecordBatch:
    numbers, text, pairs, times, first = found
    sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text]
    flat = lambda x: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int64()))
    return pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in numbers), pa.array(sha, pa.string()), flat(pairs), flat(times)],
                                      names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def aligned(documents: DataFrame, byte_model: str, piece_model: str) -> DataFrame:
    """One row per document: its numbers, its groups' digest, its distinct linked pairs (A id * 2**32 + B id) and their links. Written."""
    with_columns_of(documents, "doc_id", "text")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(byte_model, piece_model), DOCUMENT)
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(pair, docs, best)``: in how many rows each pair is linked, and whether that is the most of its A id. Written."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "pairs")
    a = F.floor(F.col("pair") / WIDE).cast("long")
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return written(counts.withColumn("a", a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "counts")


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with ``n_best`` (links of a pair that is its A id's most frequent) and ``count_sum`` (over links, the pair's documents)."""
    total = counts.agg(F.sum("docs")).first()[0] or 0
    frequent = F.col("docs") > (total >> FREQUENT)
    linked = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times").toDF("row", "pair", "times")
    placed = linked.join(F.broadcast(counts.where(frequent)), "pair", "left")
    sums = [F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")]
    rare = placed.where("docs is null").drop("docs", "best").join(counts.where(~frequent), "pair")
    both = placed.where("docs is not null").groupBy("row").agg(*sums).unionByName(rare.groupBy("row").agg(*sums))
    sums = both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return (rows.drop("pairs", "times").join(sums, "row", "left").drop("row")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
                    F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"))


def align(documents: DataFrame, byte_model: str, piece_model: str) -> DataFrame:
    """Per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``groups_sha256`` is the digest of all groups as ``a1,a2|b1;a3|b2`` (decimal
    ids in order). A text that is null, empty, or not given back byte for byte by
    both tokenizers has no tokens: zeros and an empty digest. Every row is a
    document of its own, whatever its id (null too), and repeated rows count
    as often as they stand. Other columns are not read. An empty table gives an
    empty result.
    """
    rows = aligned(documents, byte_model, piece_model)
    return scored(rows, pair_counts(rows))


def alignment_table(documents: DataFrame, byte_model: str, piece_model: str) -> DataFrame:
    """``(a, b, docs, best)`` for every pair of ids that is linked anywhere: the tokenizers' alignment over the corpus."""
    counts = pair_counts(aligned(documents, byte_model, piece_model))
    return counts.select(F.floor(F.col("pair") / WIDE).cast("int").alias("a"), (F.col("pair") % WIDE).cast("int").alias("b"), "docs", "best")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(BYTE_MODEL), tokenizer_path(PIECE_MODEL))
