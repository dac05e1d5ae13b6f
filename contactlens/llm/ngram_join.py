"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct word 5-grams. Two documents with a
Jaccard similarity of t or more miss at most tau = n - ceil(t n) tokens of
either one. Tokens fall into a rare class and, by a hash, into several classes
of frequent ones. Sorted rare first, a document's prefix is extended until

    (rare tokens) + sum over frequent classes (tokens - 1)  >=  tau + 1,

and indexed by its single rare tokens and by all 2-token combinations within a
frequent class. Destroying every signature takes more than tau missing tokens,
so linked documents share one. Candidates are verified exactly.

Links are needed for connected components only: every document is checked
against single documents of its signatures' lists for some rounds, then all
pairs that are still in different components are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlens.llm.bits import bit_array, contains
from contactlens.llm.common import components, map_arrow, partitions, with_columns_of, written
from contactlens.llm.textkernel import mix, shingle_sets, slices

#: words of a shingle, and the similarity as a percentage
WORDS, PERCENT = 5, 80
#: a token in more documents than this is frequent; the mark rises until at most FREQUENT tokens are
OFTEN, FREQUENT = 16, 1 << 20
#: a frequent class for so many tokens of a document's size (sizes by powers of two)
CLASS_SIZE = 16
#: star rounds at most before all remaining pairs are taken, and centres a set meets in one
STAR_ROUNDS, CENTRES = 4, 4
#: smallest open signatures that a set takes along, so that a pair is told from its other common lists
LOW = 16
#: longs of the parity bitmap that bounds two sets' difference
LONGS = 16
_NODE, _PAIR = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def needed(n: int, percent: int = PERCENT) -> int:
    """tau + 1: the tokens of a set of ``n`` of which a linked set holds at least one."""
    return n - -(-percent * n // 100) + 1


def levels(n: int, percent: int = PERCENT) -> list[int]:
    """Size levels floor(log2) of all sets that a set of ``n`` can be linked with."""
    low, high = -(-percent * n // 100), 100 * n // percent
    return list(range(max(low, 1).bit_length() - 1, max(high, 1).bit_length()))


def node_of(s: np.ndarray) -> np.uint64:
    """64-bit digest of a set."""
    return mix(np.array([np.bitwise_xor.reduce(mix(s ^ _NODE))]) + s.sum(keepdims=True, dtype=np.uint64))[0]


def bitmap_of(s: np.ndarray) -> np.ndarray:
    """Parity of the tokens per slot, packed: differing bits are a lower bound of differing tokens."""
    odd = np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(s: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of a sorted token set; ``frequent`` marks its frequent tokens."""
    need = needed(len(s), percent)
    rare = s[~frequent]
    if len(rare) >= need:
        return rare[:need]
    often, out = s[frequent], [rare]
    for level in levels(len(s), percent):
        groups = max(1, (1 << level) // CLASS_SIZE)
        cls = (mix(often) % np.uint64(groups)).astype(np.int64)
        again = np.ones(len(often), bool)
        again[np.unique(cls, return_index=True)[1]] = False
        enough = np.flatnonzero(np.cumsum(again) >= need - len(rare))
        stop = int(enough[0]) + 1 if len(enough) else len(often)
        order = np.argsort(cls[:stop], kind="stable")
        tokens, c = often[:stop][order], cls[:stop][order]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1, [len(c)]])
        for a, b in zip(edge, edge[1:]):
            if b - a > 1:
                i, j = np.triu_indices(b - a, 1)
                out.append(mix(tokens[a:b][i] * _PAIR + mix(tokens[a:b][j]) + np.uint64(level)))
    return np.unique(np.concatenate(out))


def _distinct_sets(column: pa.Array):
    """``(rows, node, set)`` of a batch: each set once, with the rows that have it; None for empty sets."""
    found: dict[int, tuple[list[int], np.ndarray]] = {}
    empty: list[int] = []
    for i, data, off in slices(column):
        for k, s in enumerate(shingle_sets(data, off, WORDS)):
            if not len(s):
                empty.append(i + k)
                continue
            d = int(node_of(s))
            if d in found:
                found[d][0].append(i + k)
            else:
                found[d] = ([i + k], s)
    return empty, found


def _dealt(part: np.ndarray, records: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    order = np.argsort(part, kind="stable")
    part, records = part[order], records[order]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, int)
    return [(int(part[a]), kind, records[a:b].tobytes()) for a, b in zip(edge, edge[1:])]


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch | None:
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                       pa.array([r[2] for r in rows], pa.binary())], names=["part", "kind", "data"])


_BLOB = "part int, kind int, data binary"


def _gather(table: pa.Table, kind: int, dtype) -> np.ndarray:
    k = table.column("kind").to_numpy()
    data = table.column("data").to_pylist()
    return np.frombuffer(b"".join(d for d, x in zip(data, k) if x == kind), dtype)


def frequent_tokens(texts: DataFrame, bits: int, often: int = OFTEN, most: int = FREQUENT) -> np.ndarray:
    """Sorted codes (the top 32 + ``bits`` bits) of tokens in more than ``often`` documents, at most ``most``.

    All tokens of all documents are counted. Tasks add up their own batch
    (copies within it once), then deal 4 bytes per token by hash range. The
    mark ``often`` doubles until the class is small enough to broadcast; any
    table gives right results, the class only decides how tokens are indexed.
    """
    tail = np.uint64(64 - bits - 32)
    counted = np.dtype([("code", "<u4"), ("n", "<u4")])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        _, found = _distinct_sets(batch.column(1))
        if not found:
            return None
        code, n = np.unique(np.concatenate([s for _, s in found.values()]) >> tail, return_counts=True)
        part, low = (code >> np.uint64(32)).astype(np.int32), code.astype(np.uint32)
        once = n == 1
        pairs = np.zeros((~once).sum(), counted)
        pairs["code"], pairs["n"] = low[~once], n[~once]
        return _blobs(_dealt(part[once], low[once], 0) + _dealt(part[~once], pairs, 1))

    def meet(table: pa.Table) -> pa.Table:
        one, more = _gather(table, 0, "<u4"), _gather(table, 1, counted)
        code = np.concatenate([one, more["code"]])
        order = np.argsort(code, kind="stable")
        code, n = code[order], np.concatenate([np.ones(len(one), np.int64), more["n"].astype(np.int64)])[order]
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, int)
        n = np.add.reduceat(n, at) if len(at) else n
        top = n > often
        whole = (np.int64(table.column("part")[0].as_py()) << 32) | code[at][top].astype(np.int64)
        return pa.table({"code": whole, "n": n[top]})

    counts = written(map_arrow(texts, count, _BLOB).groupBy("part").applyInArrow(meet, "code long, n long"), "tokens")
    sizes = counts.groupBy(F.floor(F.log2(F.col("n") / F.lit(often))).cast("int").alias("step")).count().toPandas()
    step = 0
    while sizes[sizes["step"] >= step]["count"].sum() > most:
        step += 1
    top = counts.where(F.col("n") >= F.lit(often << step)).select("code").toPandas()["code"].to_numpy()
    return np.sort(top).astype(np.uint64)


ENTRY = np.dtype([("sig", "<u4"), ("node", "<u8"), ("n", "<i4"), ("seen", "u1")])
DOC = np.dtype([("doc", "<i8"), ("null", "u1"), ("node", "<u8"), ("n", "<i4"), ("bitmap", "<i8", LONGS)])
INDEX = "kind int, sig long, node long, n int, doc_id long, key long, bitmap array<long>"


def index(texts: DataFrame, bits: int, frequent: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """The written index: kind 0, signatures that more than one set has; kind 1, one row per document.

    A batch passes on one entry of a signature, marked if it holds more; the
    others are known to be shared and are dealt by their set instead, so no
    signature gathers in one task.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    tail, parts = np.uint64(64 - bits - 32), np.uint64(64 - bits)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        table = shared.value
        empty, found = _distinct_sets(batch.column(1))
        ids = batch.column(0)
        null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
        docs = np.zeros(len(ids), DOC)
        docs["doc"], docs["null"] = batch.column(2).to_numpy(zero_copy_only=False), null
        sig_parts, entry_parts = [], []
        for d, (rows, s) in found.items():
            docs["node"][rows], docs["n"][rows], docs["bitmap"][rows] = d, len(s), bitmap_of(s)
            if len(table):
                code = s >> tail
                often = table[np.minimum(np.searchsorted(table, code), len(table) - 1)] == code
            else:
                often = np.zeros(len(s), bool)
            sig = signatures(s, often, percent)
            e = np.zeros(len(sig), ENTRY)
            e["node"], e["n"] = d, len(s)
            sig_parts.append(sig)
            entry_parts.append(e)
        out = []
        if sig_parts:
            sig, e = np.concatenate(sig_parts), np.concatenate(entry_parts)
            order = np.argsort(sig, kind="stable")
            sig, e = sig[order], e[order]
            e["sig"] = (sig >> tail).astype(np.uint32)
            at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            size = np.diff(np.concatenate([at, [len(sig)]]))
            e["seen"] = 2
            e["seen"][at] = np.where(size > 1, 1, 0)
            first = e["seen"] < 2
            out += _dealt((sig[first] >> parts).astype(np.int32), e[first], 0)
            full = np.zeros((~first).sum(), [("sig", "<u8"), ("node", "<u8"), ("n", "<i4")])
            full["sig"], full["node"], full["n"] = sig[~first] >> tail, e["node"][~first], e["n"][~first]
            out += _dealt((full["node"] >> parts).astype(np.int32), full, 2)
        where = np.where(docs["n"] > 0, mix(docs["doc"].view(np.uint64) ^ docs["node"]), mix(docs["doc"].view(np.uint64)))
        return _blobs(out + _dealt((where >> parts).astype(np.int32), docs, 1))

    def meet(table: pa.Table) -> pa.Table:
        part = np.int64(table.column("part")[0].as_py())
        e = _gather(table, 0, ENTRY)
        e = e[np.lexsort((e["node"], e["sig"]))]
        at = np.flatnonzero(np.concatenate([[True], e["sig"][1:] != e["sig"][:-1]])) if len(e) else np.zeros(0, int)
        if len(at):
            size = np.diff(np.concatenate([at, [len(e)]]))
            other = (np.maximum.reduceat(e["node"], at) != np.minimum.reduceat(e["node"], at)) | (np.maximum.reduceat(e["seen"], at) > 0)
            e = e[np.repeat(other, size)]
            e = e[np.concatenate([[True], (e["sig"][1:] != e["sig"][:-1]) | (e["node"][1:] != e["node"][:-1])])] if len(e) else e
        full = _gather(table, 2, [("sig", "<u8"), ("node", "<u8"), ("n", "<i4")])
        docs = _gather(table, 1, DOC)
        sig = np.concatenate([(part << 32) | e["sig"].astype(np.int64), full["sig"].astype(np.int64)])
        node = np.concatenate([e["node"], full["node"]]).view(np.int64)
        n = np.concatenate([e["n"], full["n"]])
        k, m = len(sig), len(docs)
        bitmap = pa.ListArray.from_arrays(np.concatenate([np.zeros(k, np.int32), np.arange(m + 1, dtype=np.int32) * LONGS]),
                                          pa.array(docs["bitmap"].reshape(-1)))
        return pa.table({
            "kind": np.concatenate([np.zeros(k, np.int32), np.ones(m, np.int32)]),
            "sig": np.concatenate([sig, np.zeros(m, np.int64)]), "node": np.concatenate([node, docs["node"].copy().view(np.int64)]),
            "n": np.concatenate([n, docs["n"]]),
            "doc_id": pa.array(np.concatenate([np.zeros(k, np.int64), docs["doc"]]), mask=np.concatenate([np.ones(k, bool), docs["null"] > 0])),
            "key": np.concatenate([np.zeros(k, np.int64), docs["doc"]]),
            "bitmap": bitmap})

    return written(map_arrow(texts, cut, _BLOB).groupBy("part").applyInArrow(meet, INDEX), "index")


def _sized(a: str, b: str, percent: int = PERCENT):
    """Two sets' sizes allow a link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _close(percent: int = PERCENT):
    """Sizes and bitmaps allow a link: the symmetric difference is at most (100 - p) / (100 + p) of the sizes' sum."""
    differ = F.aggregate(F.zip_with("a_map", "b_map", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return _sized("a_n", "b_n", percent) & (differ * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` of nodes that are linked.

    The bitmaps rule out pairs that differ too much; the sets of what is left
    are taken from the whole texts once more and intersected.
    """
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("bitmap").alias(f"{x}_map"), F.col("n").alias(f"{x}_n"),
                                  F.col("key").alias(f"{x}_doc"))
    left = written(pairs.join(side("a"), "a").join(side("b"), "b").where(_close(percent))
                   .select("a", "b", "a_doc", "b_doc"), "close")
    bits = texts.sparkSession.sparkContext.broadcast(
        bit_array(left.select(F.explode(F.array("a_doc", "b_doc")).alias("d")).distinct()))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ok = contains(bits.value, batch.column(2).to_numpy(zero_copy_only=False))
        if not ok.any():
            return None
        _, found = _distinct_sets(batch.column(1).filter(pa.array(ok)))
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.array(list(found), np.uint64).view(np.int64)),
                                           pa.array([s.view(np.int64) for _, s in found.values()], pa.list_(pa.int64()))], names=["node", "tokens"])

    used = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = map_arrow(texts, sets, "node long, tokens array<long>").join(used, "node", "left_semi").dropDuplicates(["node"])
    found = written(found, "sets")
    # a is the centre of a star, so the many b sides move first and the few centres come to them
    side_b = found.join(left.select(F.col("b").alias("node")), "node", "left_semi").select(F.col("node").alias("b"), F.col("tokens").alias("b_set"))
    side_a = found.join(left.select(F.col("a").alias("node")), "node", "left_semi").select(F.col("node").alias("a"), F.col("tokens").alias("a_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return written(left.select("a", "b").join(side_b, "b").join(side_a, "a").withColumn("both", both)
                   .where(F.col("both") * 100 >= (F.size("a_set") + F.size("b_set") - F.col("both")) * percent).select("a", "b"), "links")


def _open(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """The entries ``(sig, node, n, component)`` of lists that hold more than one component, written."""
    placed = entries.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    return written(placed.join(mixed, "sig", "left_semi").select("sig", "node", "n", "component"), "open")


def _rest(left: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the open lists' sets in different components that sizes and bitmaps allow.

    A pair meets in every list that both sets have. It is taken in the list of
    the smallest signature that both take along, which they both are in; only
    a pair without such a one is taken in all its lists (and made one after).
    """
    taken = left.groupBy("node").agg(F.collect_set("sig").alias("all")).select("node", F.slice(F.sort_array("all"), 1, LOW).alias("low"))
    side = left.join(nodes.select("node", "bitmap"), "node").join(taken, "node")
    cols = lambda x: side.select("sig", F.col("node").alias(x), F.col("n").alias(f"{x}_n"),
                                 F.col("component").alias(f"{x}_c"), F.col("bitmap").alias(f"{x}_map"), F.col("low").alias(f"{x}_low"))
    first = F.coalesce(F.array_min(F.array_intersect("a_low", "b_low")), F.col("sig"))
    met = cols("a").join(cols("b"), "sig").where((F.col("a") < F.col("b")) & (F.col("a_c") != F.col("b_c")) & _close(percent) & (F.col("sig") == first))
    return met.select("a", "b")


def _star(entries: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b): every set b against up to CENTRES sets a, drawn by hash from its lists' largest components."""
    centre = F.min(F.struct(F.xxhash64("node", "sig", F.lit(turn)), F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("component").alias("a_c")))
    lists = (entries.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("m"), centre.alias("x"))
             .groupBy("sig").agg(F.max_by("x", F.struct("m", "component")).alias("x")).select("sig", "x.a", "x.a_n", "x.a_c"))
    met = entries.join(lists, "sig").where((F.col("component") != F.col("a_c")) & _sized("n", "a_n", percent))
    picks = [F.min(F.struct(F.xxhash64("a", F.lit(j)), "a")).alias(f"p{j}") for j in range(CENTRES)]
    return (met.groupBy(F.col("node").alias("b")).agg(*picks)
            .select("b", F.explode(F.array_distinct(F.array(*[F.col(f"p{j}.a") for j in range(CENTRES)]))).alias("a"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def join_components(documents: DataFrame, percent: int = PERCENT, often: int = OFTEN, most: int = FREQUENT) -> DataFrame:
    """One row per document: ``(doc_id, n_shingles, component_id)``.

    Tokens are the distinct 5-word shingles of the whole text (words: runs of
    non-space bytes, A-Z lower-cased; with fewer words the whole sequence is
    the one token). Documents link when 100 * intersection >= ``percent`` *
    union. Documents without words (null or empty texts) have 0 shingles and
    link with nothing. ``component_id`` is the smallest doc_id reachable, the
    own one included. Rows with a null doc_id take part and pass links on,
    but their id never names a component; a component of such rows alone has
    a null id. Repeated rows come back as often as they stand. Sets are told
    apart by 64-bit token hashes and a 64-bit digest.
    """
    with_columns_of(documents, "doc_id", "text")
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))  # where a set's text is found again
    bits = max(1, math.ceil(math.log2(max(2, partitions(spark)))))
    idx = index(texts, bits, frequent_tokens(texts, bits, often, most), percent)
    docs = idx.where("kind = 1").select("doc_id", "key", "n", "node", "bitmap")
    nodes = written(docs.where("n > 0").groupBy("node")
                    .agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")), "nodes")
    entries = idx.where("kind = 0").select("sig", "node", "n")

    # each set against the smallest set of its signatures' lists
    lists = entries.groupBy("sig").agg(F.min(F.struct("node", "n")).alias("top"))
    star = (entries.join(lists, "sig").where(F.col("node") != F.col("top.node"))
            .withColumn("top_n", F.col("top.n")).where(_sized("n", "top_n", percent))
            .groupBy(F.col("node").alias("b")).agg(F.min("top.node").alias("a")).select("a", "b"))
    links = _verified(star, nodes, texts, percent)
    parts = components(links)
    left = _open(entries, parts)
    size = left.count()

    # lists still in several components: against some sets of the list's largest component, while that helps
    for turn in range(STAR_ROUNDS):
        if size == 0:
            break
        links = links.unionByName(_verified(_star(left, turn, percent), nodes, texts, percent))
        parts = components(links)
        left = _open(left.select("sig", "node", "n"), parts)
        size, before = left.count(), size
        if size > before // 2:
            break

    # what is left: all pairs of a list in different components; the join itself drops those whose bitmaps differ too much,
    # and a pair's other lists
    if size:
        rest = _rest(left, nodes, percent).distinct()
        parts = components(links.unionByName(_verified(rest, nodes, texts, percent)))
    named = docs.join(parts, "node", "left").withColumn("c", F.coalesce("component", "node"))
    small = named.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"))
    return (named.join(small, "c", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one of smallest doc_id (of repeated rows, one)."""
    gone = join_components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return (docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").dropDuplicates(["doc_id", "text"]))


def query(spark, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
