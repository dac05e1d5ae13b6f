"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of the target (documents
labelled good) and one of the raw text (all documents), give every document
the logarithm of its likelihood ratio, the sum over all its n-grams. With
standard Gumbel noise from a hash of the id added, an exact cut at the k-th
largest key samples k documents without replacement in proportion to their
ratios. Ratios of whole documents often lie hundreds of nats apart; there the
noise decides nothing, as it should.

The n-grams are 5-grams of character shapes (letters, capitals and digits are
one sign each, all other signs stay) and runs of word repetitions (how many
words ago a word last stood). Word identities are left out on purpose: they
follow the mix of languages and topics in the labelled sample, not quality.
Counts are smoothed towards the raw model, never by more than one half: mass
given to buckets that do not occur would cost every document something per n-gram,
and long good documents more than short bad ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlens.llm.common import with_columns_of, written
from contactlens.llm.mixing import uniform
from contactlens.llm.textkernel import SPACE, mix, slices, words

#: bound of the labelled sample that the target model and the cut are fitted on (smallest id hashes)
LABELLED = 20_000
#: buckets of the hashed n-grams of each kind
BUCKETS = 1 << 16
#: kinds of n-grams: character shapes, word repetitions
KINDS = 2
#: characters of a shape n-gram, and how many words back a repetition is looked for
SHAPE_N, WINDOW = 5, 8
#: scale of the Gumbel noise; 1 draws in proportion to the ratios themselves
TEMPERATURE = 1.0
SEED = 6
#: columns that ``resample`` adds
ADDED = ("_ratio", "_features", "_key")

_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def shapes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the shape n-grams within each text, and per text the index of its first one."""
    b = _SHAPE[data]
    m = len(b) - SHAPE_N + 1
    length = np.maximum(np.diff(off) - SHAPE_N + 1, 0)
    first = np.concatenate([[0], np.cumsum(length)])
    if m <= 0 or not first[-1]:
        return np.zeros(0, np.int64), first
    g = b[:m].copy()
    for j in range(1, SHAPE_N):
        g = g * np.uint64(257) + b[j:j + m]
    at = np.repeat(off[:-1] - first[:-1], length) + np.arange(first[-1])
    return (mix(g[at]) & np.uint64(BUCKETS - 1)).astype(np.int64), first


def repetitions(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word how many words ago it last stood (0: not within ``WINDOW``), and per text its first word."""
    _, _, h, first = words(data, off, SPACE)
    out = np.zeros(len(h), np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    for k in range(WINDOW, 0, -1):
        same = (h[k:] == h[:-k]) & (text[k:] == text[:-k])
        out[k:][same] = k
    return out, first


def features(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind the buckets of all texts' n-grams and the index of each text's first one."""
    return [shapes(data, off), repetitions(data, off)]


def _labelled(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """``(label_id, good)``: at most ``bound`` labelled ids, those of smallest hash; conflicting labels count as bad."""
    return (labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id"))
            .agg(F.min(F.col("quality").cast("int")).alias("good"))
            .orderBy(F.xxhash64("label_id"), "label_id").limit(bound))


def model(documents: DataFrame, labelled: DataFrame, smoothing: float = 0.5) -> np.ndarray:
    """Log ratio of target to raw probability per bucket; counts over all documents.

    With ``e`` the target count that the raw rate lets expect, both models get
    ``smoothing * min(1, e)`` more. Without good documents all ratios are 0.
    Every task adds up its own documents first, so at most ``KINDS * BUCKETS``
    rows leave a task and as many reach the driver.
    """
    rows = (documents.select(F.col("doc_id").cast("long"), "text")
            .join(F.broadcast(labelled.where("good = 1")), F.col("doc_id") == F.col("label_id"), "left")
            .select("text", F.col("good").isNotNull().alias("good")))

    def count(batches):
        total = np.zeros((2, KINDS, BUCKETS), np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            for i, data, off in slices(batch.column(0)):
                for kind, (f, start) in enumerate(features(data, off)):
                    total[0, kind] += np.bincount(f, minlength=BUCKETS)
                    own = np.repeat(good[i:i + len(off) - 1], np.diff(start))
                    total[1, kind] += np.bincount(f[own], minlength=BUCKETS)
        flat = total.reshape(2, -1)
        at = np.flatnonzero(flat[0])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[0][at]), pa.array(flat[1][at])],
                                             names=["bucket", "raw", "good"])

    got = (rows.mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket")
           .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas())
    counts = np.zeros((2, KINDS * BUCKETS))
    counts[:, got["bucket"]] = got[["raw", "good"]].to_numpy(float).T
    return ratios_of(*counts.reshape(2, KINDS, BUCKETS), smoothing)


def ratios_of(raw: np.ndarray, good: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    """Smoothed log ratios from the counts ``(kind, bucket)``; 0 for buckets that do not occur."""
    out = np.zeros(raw.shape)
    for kind in range(len(raw)):
        if not good[kind].sum():
            continue
        there = raw[kind] > 0
        e = raw[kind][there] * (good[kind].sum() / raw[kind].sum())
        more = smoothing * np.minimum(1, e)
        target, base = good[kind][there] + more, e + more
        out[kind][there] = np.log(target / target.sum()) - np.log(base / base.sum())
    return out


def log_ratios(documents: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``documents`` with ``_ratio`` (summed over all n-grams) and ``_features`` (number of n-grams)."""
    shared = documents.sparkSession.sparkContext.broadcast(ratio)

    @F.arrow_udf("struct<ratio:double,n:long>")
    def score(text: pa.Array) -> pa.Array:
        weight = shared.value
        total, number = [np.zeros(0)], [np.zeros(0, np.int64)]
        for _, data, off in slices(text):
            t, n = 0.0, 0
            for kind, (f, start) in enumerate(features(data, off)):
                run = np.concatenate([[0.0], np.cumsum(weight[kind][f])])
                t = t + run[start[1:]] - run[start[:-1]]
                n = n + np.diff(start)
            total.append(t)
            number.append(n)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(total)), pa.array(np.concatenate(number))], names=["ratio", "n"])

    both = score(F.col("text").cast("string"))
    own = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in ADDED]
    held = "_score" + "_" * max(map(len, documents.columns))  # longer than any column of the input
    return (documents.select(*own, both.alias(held))
            .select(*own, F.round(f"{held}.ratio", 6).alias("_ratio"), F.col(f"{held}.n").alias("_features")))


def gumbel(id_col, seed: int):
    """Standard Gumbel noise hashed from the id."""
    u = (uniform(id_col, seed) * F.lit(float(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def best_cut(ratio: np.ndarray, good: np.ndarray) -> float:
    """Ratio between bad and good labelled documents with the best balanced accuracy (0 without both kinds)."""
    if not good.any() or good.all():
        return -math.inf  # nothing to part: all stay
    order = np.argsort(ratio, kind="stable")
    r, g = ratio[order], good[order]
    kept_good = g.sum() - np.concatenate([[0], np.cumsum(g)])
    lost_bad = np.concatenate([[0], np.cumsum(~g)])
    value = kept_good / g.sum() + lost_bad / (~g).sum()
    ok = np.concatenate([[True], r[1:] > r[:-1], [True]])
    i = int(np.flatnonzero(ok & (value == value[ok].max()))[0])
    if i == 0:
        return -math.inf
    return float((r[i - 1] + r[i]) / 2) if i < len(r) else math.inf


def kth_largest(keys: DataFrame, column: str, k: int, collect: int = 10_000, bins: int = 4096) -> float:
    """The ``k``-th largest value, exactly: histograms of a narrowing range until few rows are left."""
    if k <= 0:
        return math.inf
    v = F.col(column)
    low, high = keys.agg(F.min(v), F.max(v)).first()
    while True:
        if low == high:
            return low
        width = (high - low) / bins
        b = F.least(F.greatest(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        rows = (keys.where((v >= F.lit(low)) & (v <= F.lit(high))).groupBy(b.alias("b"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).orderBy(F.desc("b")).collect())
        for r in rows:  # at most ``bins`` rows
            if k <= r["n"]:
                break
            k -= r["n"]
        if r["n"] <= collect:
            left = keys.where((v >= F.lit(r["lo"])) & (v <= F.lit(r["hi"]))).select(v).toPandas()[column].to_numpy()
            return float(np.sort(left)[::-1][k - 1])
        if (r["lo"], r["hi"]) == (low, high):
            raise RuntimeError("the range does not narrow")
        low, high = r["lo"], r["hi"]


def resample(documents: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, seed: int = SEED,
             k: int | None = None, bound: int = LABELLED) -> DataFrame:
    """The documents of the sample, with ``_ratio``, ``_features`` and ``_key`` added (in place of columns of these names).

    ``k`` is the sample's size; by default the number of documents whose ratio
    reaches the cut that best parts the labelled sample. Equal keys (repeated
    rows) are taken together, so ties can add rows. Documents without any
    feature (null, empty or only blank texts) are rejected. A null id is
    hashed as the text 'null'. Without labels of both kinds all documents with
    features stay. An empty table gives no rows.

    The scored documents are written once, so that the kernel reads every text
    twice in all: once to count, once to score.
    """
    with_columns_of(documents, "doc_id", "text")
    with_columns_of(labels, "doc_id", "quality")
    labelled = written(_labelled(labels, bound), "labelled")
    ratio = model(documents, labelled)
    keyed = log_ratios(documents, ratio).withColumn(
        "_key", F.col("_ratio") + F.lit(float(temperature)) * gumbel(F.col("doc_id"), seed))
    scored = written(keyed.where("_features > 0"), "scored")
    if k is None:
        own = (scored.select(F.col("doc_id").cast("long").alias("id"), "_ratio")
               .join(F.broadcast(labelled), F.col("id") == F.col("label_id"))
               .groupBy("label_id", "good").agg(F.min("_ratio").alias("_ratio")).toPandas())  # at most ``bound`` rows
        cut = best_cut(own["_ratio"].to_numpy(float), own["good"].to_numpy(int) == 1)
        k = scored.where(F.col("_ratio") >= F.lit(cut)).count()
    border = kth_largest(scored, "_key", min(k, scored.count()))
    return scored.where(F.col("_key") >= F.lit(border))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the sample, as they came (whatever their columns are named)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = {c: c + "_" * max(map(len, docs.columns)) for c in docs.columns if c.lower() in ADDED}  # names no column has
    out = resample(docs.withColumnsRenamed(held), labels)
    return out.select(*[F.col(f"`{held.get(c, c)}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document of the sample."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(docs, labels).select("doc_id", F.col("_features").alias("n_features"), F.col("_ratio").alias("log_ratio"),
                                         F.col("_key").alias("key"), F.lit(True).alias("kept"))
