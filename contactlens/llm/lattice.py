"""SentencePiece encoding and decoding: distinct sampled segmentations of whole texts.

A text's lattice has an edge for every vocabulary piece that fits; an edge's
probability follows from the pieces' weights by a backward sum. Segmentations
are drawn without replacement by a perturbed A-star search (Gumbel top-k): the
best perturbed segmentation is an ordinary draw; every edge on it leaves a
node "same edges so far, then another one", whose best perturbed score is a
Gumbel number cut at its parent's; the best open node gives the next
segmentation. All random numbers are hashed from the row's key.

Pieces never reach over a blank that follows a non-blank, so a text's lattice
is a chain of word lattices, and equal words of a slice share one.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlens.llm.common import with_columns_of
from contactlens.llm.textkernel import _BYTE, _powers, mix, slices

#: samples per text, and sharpness of the piece weights (probability ~ weight ** THETA)
SAMPLES, THETA = 2, 1.0
SEED = 8
#: rank added before the piece weight 1 / (rank + OFFSET) is taken; byte pieces count as rarer than any other
OFFSET = 10.0
#: bytes of text that share one set of word lattices
SLICE = 1 << 20
#: stands for a blank inside a lattice; no UTF-8 text holds this byte
BLANK = 0xFF


@dataclass(frozen=True)
class Pieces:
    hashes: np.ndarray      # sorted hashes of the pieces' bytes
    ids: np.ndarray         # their ids, in that order
    weight: np.ndarray      # log weight per id
    lengths: np.ndarray     # distinct byte lengths
    data: np.ndarray        # all pieces' bytes, one after the other
    begin: np.ndarray       # where an id's bytes begin (n + 1 entries)
    byte_id: np.ndarray     # id of each byte piece
    slot: np.ndarray        # by the top 20 bits of a hash: where its pieces begin in hashes, -1 if there are none
    most: int               # pieces that share these bits at most


@functools.lru_cache(2)
def load_pieces(path: str, theta: float = THETA) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    raw: list[bytes] = []
    byte_id, whole = np.zeros(256, np.int64), []
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            b = int(piece[3:5], 16)
            byte_id[b] = i
            raw.append(bytes([b]))
        elif sp.is_control(i) or sp.is_unknown(i):
            raw.append(b"")
        else:
            raw.append(piece.replace("▁", "\x00").encode().replace(b"\x00", bytes([BLANK])))
            whole.append(i)
    rank = np.array([-sp.get_score(i) for i in range(n)])
    rank[[i for i in range(n) if sp.is_byte(i)]] = 100.0 * n
    size = np.array([len(x) for x in raw])
    begin = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids = np.array(whole)
    h = _hashes(data, begin[ids], begin[ids] + size[ids])
    order = np.argsort(h)
    weight = -theta * np.log(np.maximum(rank, 0) + OFFSET)
    top, at, count = np.unique((h[order] >> np.uint64(44)).astype(np.int64), return_index=True, return_counts=True)
    slot = np.full(1 << 20, -1, np.int32)
    slot[top] = at
    return Pieces(h[order], ids[order], weight, np.unique(size[ids]), data, begin, byte_id, slot, int(count.max()))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * power[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


class Lattice:
    """Edges of all words of a flat byte array; ``border`` has each word's begin and the end of the last."""

    def __init__(self, data: np.ndarray, border: np.ndarray, p: Pieces):
        n = len(data)
        stop = np.repeat(border[1:], np.diff(border))
        power, inverse = _powers(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[data] * power[:n], out=total[1:])
        s = np.arange(n)
        left = stop - s
        # a place has at most one edge of each length, so a length's edges are found and put in place at once
        found = []
        for size in p.lengths:
            s = s[left[s] >= size]
            if not len(s):
                break
            h = mix((total[s + size] - total[s]) * inverse[s])
            k = p.slot[(h >> np.uint64(44)).astype(np.int64)]
            fit = np.flatnonzero(k >= 0)
            h, k = h[fit], k[fit]
            ok = p.hashes[k] == h
            for _ in range(p.most - 1):  # the next ones with the same top bits
                no = np.flatnonzero(~ok)
                k[no] = np.minimum(k[no] + 1, len(p.hashes) - 1)
                ok[no] = p.hashes[k[no]] == h[no]
            found.append((s[fit[ok]], size, p.ids[k[ok]].astype(np.int32)))
        byte = np.flatnonzero(data != BLANK)  # a blank is never a byte
        found.insert(0, (byte, 1, p.byte_id[data[byte]].astype(np.int32)))
        count = np.zeros(n, np.int64)
        for place, _, _ in found:
            count[place] += 1
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.start = np.repeat(np.arange(n, dtype=np.int32), count)
        self.end, self.piece = np.empty(self.first[-1], np.int32), np.empty(self.first[-1], np.int32)
        free = self.first[:-1].copy()
        for place, size, piece in found[::-1]:  # long pieces, the likely ones, come first
            e = free[place]
            self.end[e], self.piece[e] = place + size, piece
            free[place] = e + 1
        w = p.weight[self.piece]
        # log of the summed weights from each place to its word's end, by distance from the end
        self.sum = np.zeros(n + 1)
        by_left = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
        cut = np.searchsorted(left[by_left], np.arange(1, (left.max() if n else 0) + 2))
        ends_word = np.zeros(n + 1, bool)
        ends_word[border] = True
        # a word's end is the next one's begin, whose sum is kept apart
        begin_sum = np.zeros(n + 1)
        size = count[by_left]
        begin = np.concatenate([[0], np.cumsum(size)])
        e = np.repeat(self.first[by_left] - begin[:-1], size) + np.arange(begin[-1])
        sorted_w, sorted_end = w[e], self.end[e]
        for a, b in zip(cut, cut[1:]):
            place, edges = by_left[a:b], slice(begin[a], begin[b])
            v = sorted_w[edges] + self.sum[sorted_end[edges]]
            off = begin[a:b] - begin[a]
            top = np.maximum.reduceat(v, off)
            got = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, size[a:b])), off))
            starts_word = ends_word[place]
            self.sum[place] = np.where(starts_word, 0.0, got)
            begin_sum[place] = np.where(starts_word, got, 0.0)
        self.ends_word = ends_word
        self.logp = w + self.sum[self.end] - (self.sum + begin_sum)[self.start]
        run = np.cumsum(np.exp(self.logp))
        base = np.where(self.first[:-1] > 0, run[np.maximum(self.first[:-1], 1) - 1], 0.0)
        self.cdf = run - base[self.start]
        if n:
            self.cdf[self.first[1:] - 1] = np.inf

    def walk(self, place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From each place to its word's end: ``(which, step, edge)`` of drawn edges; ``key`` seeds each walk."""
        which, steps, edges = [], [], []
        on, step = np.arange(len(place)), 0
        place = place.copy()
        while len(on):
            u = (mix(key[on] + np.uint64(step)) >> np.uint64(12)).astype(np.float64) / (1 << 52)
            e = self.first[place]
            late = np.flatnonzero(self.cdf[e] <= u)
            while len(late):
                e[late] += 1
                late = late[self.cdf[e[late]] <= u[late]]
            which.append(on)
            steps.append(np.full(len(on), step))
            edges.append(e)
            more = ~self.ends_word[self.end[e]]
            on, place, step = on[more], self.end[e][more], step + 1
        if not which:
            z = np.zeros(0, np.int64)
            return z, z, z
        return np.concatenate(which), np.concatenate(steps), np.concatenate(edges)


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((mix(key) >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a blank put in front and blanks as BLANK: bytes, word begins (and the end), first word per text.

    Empty texts stay empty. A word is a run of blanks and what follows up to the next blank.
    """
    size = np.diff(off)
    full = size > 0
    new = np.concatenate([[0], np.cumsum(size + full)])
    out = np.full(new[-1], BLANK, np.uint8)
    at = np.repeat(new[:-1] + full - off[:-1], size) + np.arange(len(data))
    out[at] = np.where(data == 32, BLANK, data)
    blank = out == BLANK
    begin = np.zeros(len(out), bool)
    begin[1:] = blank[1:] & ~blank[:-1]
    begin[new[:-1][full]] = True
    starts = np.flatnonzero(begin)
    return out, np.concatenate([starts, [len(out)]]), np.searchsorted(starts, new)


class _Paths:
    """One segmentation of every text: edges in order, with each text's first one."""

    def __init__(self, text, word, step, edge, texts):
        order = np.lexsort((step, word))
        self.text, self.word, self.edge = text[order], word[order], edge[order]
        self.first = np.searchsorted(self.text, np.arange(texts + 1))


def sample_texts(data: np.ndarray, off: np.ndarray, keys: np.ndarray, p: Pieces, samples: int = SAMPLES):
    """Yields per sample ``(ids, first, log_prob, perturbed, exists)``; then the scores of the next best nodes."""
    flat, border, first_word = words_of(data, off)
    texts, n_words = len(off) - 1, len(border) - 1
    h = _hashes(flat, border[:-1], border[1:])
    _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
    size = np.diff(border)[index]
    own = np.concatenate([[0], np.cumsum(size)])
    lat = Lattice(flat[np.repeat(border[index] - own[:-1], size) + np.arange(own[-1])], own, p)
    text_of = np.repeat(np.arange(texts), np.diff(first_word))
    place = own[inverse]
    number = (np.arange(n_words) - first_word[text_of]).astype(np.uint64)
    word_key = lambda turn: mix(mix(keys[text_of] + np.uint64(1000 * turn)) + number) << np.uint64(16)

    def finish(path: _Paths, parent: np.ndarray, since: np.ndarray, turn: int, excluded: dict):
        """Log probabilities and the open nodes' perturbed scores of a new path."""
        lp = lat.logp[path.edge]
        run = np.concatenate([[0.0], np.cumsum(lp)])
        before = run[:-1] - run[path.first[:-1]][path.text]
        other = -np.expm1(np.minimum(lp, 0.0))
        for k, gone in excluded.items():  # at the edge where the path left its parent more is taken already
            other[k] = max(0.0, 1.0 - np.exp(lat.logp[list(gone)]).sum())
        few = lat.first[lat.start[path.edge] + 1] - lat.first[lat.start[path.edge]] <= 1
        other[few] = 0.0
        number = np.arange(len(lp)) - path.first[path.text]
        live = np.flatnonzero((other > 1e-15) & (number >= since[path.text]))  # the others have no open node
        text = path.text[live]
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            phi = before[live] + np.log(other[live])
            u = _uniform(keys[text] + mix(number[live].astype(np.uint64) + np.uint64(turn << 40)))
            near = phi - np.logaddexp(phi - parent[text], np.log(-np.log(u)))
        g = np.full(len(lp), -np.inf)
        g[live] = np.where(np.isfinite(phi), near, -np.inf)
        return run[path.first[1:]] - run[path.first[:-1]], g

    which, step, edge = lat.walk(place, word_key(0))
    path = _Paths(text_of[which], which, step, edge, texts)
    score = -np.log(-np.log(_uniform(keys + np.uint64(77))))
    exists = np.ones(texts, bool)
    lp, g = finish(path, score, np.zeros(texts, np.int64), 1, {})
    paths, open_g, excluded = [path], [g], [{}]
    yield lat.piece[path.edge], path.first, lp, score, exists
    for turn in range(1, samples + 1):
        best, source, at = np.full(texts, -np.inf), np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        for r, (q, g) in enumerate(zip(paths, open_g)):
            some = np.flatnonzero(np.diff(q.first) > 0)
            if not len(some):
                continue
            top = np.full(texts, -np.inf)
            top[some] = np.maximum.reduceat(g, q.first[some])
            better = top > best
            hit = np.flatnonzero((g == top[q.text]) & better[q.text] & np.isfinite(g))
            where = np.zeros(texts, np.int64)
            where[q.text[hit][::-1]] = hit[::-1]
            best, source, at = np.where(better, top, best), np.where(better, r, source), np.where(better, where, at)
        exists = np.isfinite(best)
        if turn == samples:
            yield best
            return
        # leave each text's best open node by an edge not taken yet, then walk on
        keep_t, keep_w, keep_s, keep_e, go_place, go_word, go_text = [], [], [], [], [], [], []
        taken: dict[int, set] = {}
        step_in_word: dict[int, int] = {}
        draw = _uniform(keys + np.uint64(91 + turn))
        for t in np.flatnonzero(exists):
            q, k = paths[source[t]], at[t]
            gone = excluded[source[t]].get(k, {int(q.edge[k])})
            open_g[source[t]][k] = -np.inf
            a, b = lat.first[lat.start[q.edge[k]]], lat.first[lat.start[q.edge[k]] + 1]
            choice = np.array([e for e in range(a, b) if e not in gone])
            c = np.cumsum(np.exp(lat.logp[choice] - lat.logp[choice].max()))
            y = int(choice[min(np.searchsorted(c, draw[t] * c[-1]), len(choice) - 1)])
            taken[t] = gone | {y}
            f = q.first[t]
            keep_t.append(np.full(k - f + 1, t))
            keep_w.append(q.word[f:k + 1])
            keep_e.append(np.concatenate([q.edge[f:k], [y]]))
            step_in_word[t] = k - f
            if not lat.ends_word[lat.end[y]]:
                go_place.append(lat.end[y])
                go_word.append(q.word[k])
                go_text.append(t)
        kept = np.concatenate(keep_e) if keep_e else np.zeros(0, np.int64)
        kept_t = np.concatenate(keep_t) if keep_t else np.zeros(0, np.int64)
        kept_w = np.concatenate(keep_w) if keep_w else np.zeros(0, np.int64)
        left_word = np.full(texts, n_words)
        for t in taken:
            left_word[t] = paths[source[t]].word[at[t]]
        later = np.flatnonzero(np.arange(n_words) > left_word[text_of])
        seeds = word_key(turn)
        go = np.concatenate([np.array(go_word, np.int64), later])
        which, step, edge = lat.walk(np.concatenate([np.array(go_place, np.int64), place[later]]), seeds[go])
        # steps after kept ones of the same word come after them
        path = _Paths(np.concatenate([kept_t, text_of[go[which]]]), np.concatenate([kept_w, go[which]]),
                      np.concatenate([np.arange(len(kept)) - (1 << 40), step]), np.concatenate([kept, edge]), texts)
        since = np.array([step_in_word.get(t, 0) for t in range(texts)])
        gone_at = {int(path.first[t] + step_in_word[t]): gone for t, gone in taken.items()}
        lp, g = finish(path, best, since, turn + 1, gone_at)
        paths.append(path)
        open_g.append(g)
        excluded.append(gone_at)
        yield lat.piece[path.edge], path.first, lp, best, exists


def decode(ids: np.ndarray, first: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts that runs of ids stand for, and each text's first byte; the leading blank is taken away."""
    size = p.begin[ids + 1] - p.begin[ids]
    end = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(p.begin[ids] - end[:-1], size) + np.arange(end[-1])
    out = p.data[at]
    byte = end[first]
    keep = np.ones(len(out), bool)
    some = np.diff(byte) > 0
    keep[byte[:-1][some]] = out[byte[:-1][some]] != BLANK
    lost = np.concatenate([[0], np.cumsum(~keep)])
    out = out[keep]
    return np.where(out == BLANK, 32, out).astype(np.uint8), byte - lost[byte]


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("sample", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("log_prob", T.DoubleType()),
    T.StructField("inclusion", T.DoubleType()), T.StructField("exact", T.BooleanType())])


def encode(documents: DataFrame, model: str, samples: int = SAMPLES, theta: float = THETA, seed: int = SEED,
           copy: str | None = None) -> DataFrame:
    """Distinct sampled segmentations of every text: ``(doc_id, sample, n_tokens, ids, log_prob, inclusion, exact)``.

    ``sample`` counts from 1 in the order of the perturbed scores; a text with
    fewer than ``samples`` segmentations returns all it has. ``inclusion`` is
    the chance that the segmentation is among the samples, given the next
    best score (1 if there is none). ``exact`` tells that decoding the ids
    gives the text back, byte by byte. Null and empty texts have one sample
    without tokens. The row key is the doc_id (null hashes as -1) and, if
    ``copy`` names one, a copy number; rows of one key and text get the same
    samples. Rows are independent; an empty table gives no rows.
    """
    with_columns_of(documents, "doc_id", "text")
    cols = [F.col("doc_id").cast("long"), F.col("text").cast("string")] + ([F.col(f"`{copy}`").cast("long")] if copy else [])

    def run(batches):
        p = load_pieces(model, theta)
        for batch in batches:
            ids = batch.column(0)
            key = mix(ids.fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(seed << 32))
            if copy:
                key = mix(key + batch.column(2).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for i, data, off in slices(batch.column(1), SLICE):
                m = len(off) - 1
                found = list(sample_texts(data, off, key[i:i + m], p, samples))
                kappa = found.pop()
                out = []
                for r, (tokens, first, lp, score, exists) in enumerate(found):
                    back, byte = decode(tokens, first, p)
                    same = np.diff(byte) == np.diff(off)
                    if len(back) == len(data) and same.all() and (back == data).all():
                        equal = same
                    else:
                        equal = np.array([same[t] and (back[byte[t]:byte[t + 1]] == data[off[t]:off[t + 1]]).all() for t in range(m)], bool)
                    with np.errstate(over="ignore"):
                        inclusion = np.where(np.isfinite(kappa), -np.expm1(-np.exp(np.minimum(lp - kappa, 700.0))), 1.0)
                    t = pa.table({
                        "doc_id": ids.slice(i, m), "sample": pa.array(np.full(m, r + 1, np.int32)),
                        "n_tokens": pa.array(np.diff(first).astype(np.int64)),
                        "ids": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens.astype(np.int32))),
                        "log_prob": pa.array(lp), "inclusion": pa.array(inclusion), "exact": pa.array(equal)})
                    out.append(t.filter(pa.array(exists)))
                yield from pa.concat_tables(out).combine_chunks().to_batches()

    return documents.select(*cols).mapInArrow(run, SCHEMA)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    from contactlens.llm.tokenizers import tokenizer_path

    return encode(docs, tokenizer_path("piece_bpe_32k.model"))


def query(spark, sf_dir: str) -> DataFrame:
    return stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
