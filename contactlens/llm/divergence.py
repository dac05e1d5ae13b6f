"""Source divergence audit: which sources of a language differ, and by which terms.

Terms are runs of letters (ASCII letters and every non-ASCII character). A
language keeps the V terms that stand in at least LEAST_DOCS of its documents.
A group (a language's documents of one source, or all of the language's) gives
a kept term p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), N being the group's
occurrences of kept terms. Two groups with p and q differ by
f = floor((p - q)^2 / (p + q)) in a term. All arithmetic is on integers.

``pair``: sources of one language are compared by the sum of f over all kept
terms. A term that is missing in a group has the group's least p there, so only
the terms' own (group, count) rows are needed: a sum over the counts of one
group against the other's least p, and corrections for terms that both hold.

``term``: a group's most typical terms, those with p above the language's q.
f grows with the count in the group and falls with the one in the language, so
a term that k others dominate (higher group count, lower language count,
earlier in UTF-8) is not among the first k. Each partition keeps the skyband of
its terms, those that fewer than k others dominate; skybands are merged, and
what is left is ranked exactly.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactlens.llm.common import partitions, with_columns_of, written

LEAST_DOCS = 10
TOP = 10
#: terms held by a task before it passes its counts on
FLUSH = 300_000
#: sources of a language whose pairs a task adds up in one array; terms in more sources pass theirs on at once
WIDE = 1024
#: groups that may be broadcast (some 100 bytes each); beyond that they are joined on (lang, source, salt)
BROADCAST_GROUPS = 50_000
SALTS = 64
#: terms compared with the skyband at a time
CHUNK = 256

# A-Z lower-cased, every other byte under 0x80 that is no letter a blank
_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.encode("utf-8").translate(_LETTERS).split() if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, source, term, n, docs)`` of the rows that a task reads, added up as far as FLUSH terms allow."""
    n: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), c in n.items():
            keys, d = list(c), docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array([source] * len(keys), pa.string()),
                 pa.array(keys, pa.binary()).cast(pa.string()),
                 pa.array(list(c.values()), pa.int64()), pa.array([d[k] for k in keys], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = Counter(terms(text))
            group = n[lang, source]
            before = len(group)
            group.update(own)
            docs[lang, source].update(own.keys())
            held += len(group) - before
            if held > FLUSH:
                yield from out()
                n.clear()
                docs.clear()
                held = 0
    yield from out()


def _p(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * count / total) by long division in three steps of 1,000, so longs suffice up to totals of 9 * 10^15."""
    p, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        p, rest = p * 1000 + F.call_function("div", rest * 1000, total), (rest * 1000) % total
    return p + 1


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_counts(documents: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """``(rows, groups)``, both written.

    ``rows(lang, source, term, n, lang_n, p, q, p0)``: the kept terms that a group
    holds, with the counts and the p of group and language; p0 is the p that the group gives
    terms it lacks. ``groups(lang, source, p0)``: every group, p0 null where its language keeps no term.
    """
    texts = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    raw = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = written(raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                   .where(F.col("docs") >= least).drop("docs"), "kept")
    rows = written(counts.drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("V"), F.sum("lang_n").alias("lang_total"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("N"))
    own = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    size = F.coalesce("N", F.lit(0)) + 2 * F.col("V")
    groups = written(own.select("lang", "source", size.alias("size"), (F.col("lang_total") + 2 * F.col("V")).alias("lang_size"), "V",
                                _p(F.lit(2).cast("long"), size).alias("p0")), "groups")
    rows = _with_groups(rows, groups).select(
        "lang", "source", "term", "n", "lang_n", _p(F.col("n") + 2, F.col("size")).alias("p"),
        _p(F.col("lang_n") + 2, F.col("lang_size")).alias("q"), "p0")
    return written(rows, "term-p"), groups


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), ["lang", "source"])
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"])


# -- pairs of sources -----------------------------------------------------------

def _fs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _changes(p: np.ndarray, p0: np.ndarray, i: slice) -> np.ndarray:
    """For pairs of sources (rows ``i``, all), the sum over terms (rows of ``p``) of what their being in both changes."""
    a, b = p[:, i, None], p[:, None, :]
    a0, b0 = p0[i][None, :, None], p0[None, None, :]
    return (_fs(a, b) - _fs(a, b0) - _fs(a0, b)).sum(0) + len(p) * _fs(a0, b0)[0]


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, a, b, value)``: what terms that both groups hold change against each being alone.

    Without a term in either group f is that of the two least p; the term
    in one of them gives f(p, least) there. For a term in both the two single
    changes are taken back and f(p, q) put in.
    """
    index: dict[str, dict[str, int]] = defaultdict(dict)
    held: dict[str, np.ndarray] = {}

    def rows(lang: str, a: list[str], b: list[str], value: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(value)
        names = [pa.array(x, pa.string()).take(pa.array(k)) for x, k in ((a, i), (b, j))]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), *names, pa.array(value[i, j])],
                                          names=["lang", "a", "b", "value"])

    def out() -> Iterator[pa.RecordBatch]:
        for lang, value in held.items():
            names = list(index[lang])
            yield rows(lang, names, names, value[:len(names), :len(names)])

    for batch in batches:
        # terms with the same sources are handled together
        same: dict[tuple, tuple[list, list]] = {}
        for lang, s, p, p0 in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            same.setdefault((lang, *s), ([], p0))[0].append(p)
        for (lang, *s), (p, p0) in same.items():
            p, p0, m = np.array(p, np.int64), np.array(p0, np.int64), len(s)
            if m > WIDE:
                for i in range(0, m, 16):
                    for term in p:
                        yield rows(lang, s[i:i + 16], s, _changes(term[None, :], p0, slice(i, i + 16)))
                continue
            if len(index[lang].keys() | set(s)) > WIDE:
                yield from out()
                held.clear()
                index.clear()
            places = index[lang]
            at = np.array([places.setdefault(x, len(places)) for x in s])
            if lang not in held or len(held[lang]) < len(places):
                wider = np.zeros((2 * len(places),) * 2, np.int64)
                if lang in held:
                    wider[:len(held[lang]), :len(held[lang])] = held[lang]
                held[lang] = wider
            step = max(1, (1 << 19) // (m * m))
            for k in range(0, len(p), step):
                held[lang][np.ix_(at, at)] += _changes(p[k:k + step], p0, slice(None))
    yield from out()


def pair_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, a, b, value)`` for all sources a <> b of a language: the sum of f over all its kept terms."""
    side = lambda x: groups.select("lang", F.col("source").alias(x), F.col("p0").alias(f"{x}_p0"), F.col("V").alias("V"))
    pairs = side("a").join(side("b").drop("V"), "lang").where("a <> b")
    # a term in one group alone: by the group's distinct counts, against the other's least p
    alone = rows.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count(F.lit(1)).alias("terms"))
    base = _f(F.col("a_p0"), F.col("b_p0"))
    single = (alone.join(pairs, ["lang", "a"])
              .groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * (_f(F.col("p"), F.col("b_p0")) - base)).alias("value")))
    shared = (rows.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("g"))
              .where(F.size("g") > 1)
              .select("lang", F.col("g.source").alias("s"), F.col("g.p").alias("p"), F.col("g.p0").alias("p0")))
    both = shared.mapInArrow(_both, "lang string, a string, b string, value long").where("a <> b")
    turned = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    none = pairs.select("lang", "a", "b", F.coalesce(F.col("V") * base, F.lit(0)).alias("value"))
    parts = none.unionByName(single).unionByName(turned(single)).unionByName(both)
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


# -- typical terms ----------------------------------------------------------------

class Skyband:
    """The items that fewer than ``k`` others dominate, of items added by falling group count, rising language count, term.

    An item is dominated by another with a group count at least as high, a
    language count at least as low and an earlier term, so its dominators come
    before it. Counting those that are themselves in the band suffices, since
    the first k dominators of an item have fewer than k each.
    """

    def __init__(self, k: int):
        self.k, self.rows = k, None

    def add(self, rows: pa.Table) -> None:
        """Take the next rows (with columns ``lang_n`` and ``term``) in."""
        m = self.rows.num_rows if self.rows is not None else 0
        both = pa.concat_tables([self.rows, rows]) if m else rows
        lang = both.column("lang_n").to_numpy()
        rank = np.empty(both.num_rows, np.int64)
        rank[pc.sort_indices(both.column("term").combine_chunks().cast(pa.binary())).to_numpy()] = np.arange(both.num_rows)
        band = np.arange(m)
        for i in range(m, both.num_rows, CHUNK):
            new = np.arange(i, min(i + CHUNK, both.num_rows))
            before = ((lang[band][None, :] <= lang[new][:, None]) & (rank[band][None, :] < rank[new][:, None])).sum(1)
            new, before = new[before < self.k], before[before < self.k]
            own = (lang[new][None, :] <= lang[new][:, None]) & (rank[new][None, :] < rank[new][:, None])
            stays = np.ones(len(new), bool)
            for x in range(len(new)):  # those of this chunk that are in the band count as well
                stays[x] = before[x] + np.count_nonzero(own[x, :x] & stays[:x]) < self.k
            band = np.concatenate([band, new[stays]])
        self.rows = both.take(pa.array(band))


BAND = "lang string, source string, term string, n long, lang_n long, p long, q long"


def _skybands(rows: DataFrame, k: int) -> DataFrame:
    """The skyband of every group within each partition; a task holds one band and one batch at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, band = None, Skyband(k)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lang, source = (table.column(i).combine_chunks().dictionary_encode() for i in range(2))
            code = lang.indices.to_numpy() * np.int64(len(source.dictionary)) + source.indices.to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if j > i:
                    own = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                    if own != key and band.rows is not None:
                        yield from band.rows.to_batches()
                        band = Skyband(k)
                    key = own
                    band.add(table.slice(i, j - i))
        if band.rows is not None:
            yield from band.rows.to_batches()
    return rows.sortWithinPartitions("lang", "source", F.desc("n"), "lang_n", "term").mapInArrow(run, BAND)


def typical_terms(rows: DataFrame, k: int = TOP) -> DataFrame:
    """``(lang, source, term, value, rank)``: each group's ``k`` terms of the largest f among those with p > q."""
    first = _skybands(rows.select("lang", "source", "term", "n", "lang_n", "p", "q"), k)
    # skybands of a group from all tasks meet in slots, whose number grows with the root of the number of tasks
    slots = max(1, int(partitions(rows.sparkSession) ** 0.5))
    dealt = first.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(slots))).repartition("lang", "source", "slot").drop("slot")
    merged = _skybands(dealt, k)
    value = _f(F.col("p"), F.col("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return (merged.where("p > q").select("lang", "source", "term", value.alias("value"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def audit(documents: DataFrame, least: int = LEAST_DOCS, k: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every group of a language and a source.

    Part ``pair``: every other source of the language by falling divergence.
    Part ``term``: the ``k`` terms most typical of the group. Ranks start at 1;
    ties go to the item that is earlier in UTF-8. Null text, lang and source
    count as empty strings; a group without terms has pairs alone. A language
    that keeps no term has pairs of value 0 and no terms. Repeated rows count
    as often as they stand; other columns are not read. An empty table gives
    an empty result.
    """
    with_columns_of(documents, "text", "lang", "source")
    rows, groups = kept_counts(documents, least)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (pair_values(rows, groups).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
             .withColumn("rank", F.row_number().over(order)))
    top = typical_terms(rows, k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r
  FROM documents
), t AS (
  SELECT lang, source, r, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10
), lang AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS n FROM kept GROUP BY lang
), c AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL
), x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (coalesce(c.n, 0) + 2)::HUGEINT * 1000000000 // (g.n + 2 * l.v) AS p,
         1 + (k.lang_n + 2)::HUGEINT * 1000000000 // (l.n + 2 * l.v) AS q
  FROM g JOIN kept k USING (lang) JOIN lang l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), ab AS (
  SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM ab LEFT JOIN f USING (lang, source, item)
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM x WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r
) WHERE part = 'pair' OR rank <= 10
"""
