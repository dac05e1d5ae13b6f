"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate, the target share of its characters
over their actual share. A document's number of copies is the Poisson quantile
of a uniform number hashed from its id, so it depends on nothing but the row.
Copies are exploded and dealt out in a global random order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlens.llm.common import partitions, with_columns_of, written

SEED = 17
#: bytes of probabilities that may be broadcast; beyond that they come by a shuffle join on (source, salt)
BROADCAST_BYTES = 16 << 20
SALTS = 64
#: rate beyond which exp(-rate) is not used
LARGE = 700.0
#: power of the actual share that makes the default target: below 1 it lifts small sources
ALPHA = 0.5


def uniform(id_col, seed: int):
    """Number in [0, 1) from the id's decimal text (52 bits of md5); null ids hash as the text 'null'."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_window(rate):
    """``(low, steps)``: cumulative Poisson probabilities P(X <= low), P(X <= low + 1), ... until they are 1 in double precision.

    exp(-rate) leaves the range of doubles beyond a rate of 700. From there on
    the terms are taken relative to the one 12 deviations and 24 below the
    mean, ``low`` (e**-72 of the mode at most; those before it count as 0), and
    divided by their sum. A row holds about 24 sqrt(rate) numbers at most.
    """
    n = (F.ceil(rate + F.lit(12.0) * F.sqrt(rate)) + 24).cast("int")
    low = (F.floor(rate - F.lit(12.0) * F.sqrt(rate)) - 24).cast("int")
    start = lambda p: F.struct(p.alias("p"), F.array(p).alias("c"))
    step = lambda a, i: F.struct((a["p"] * rate / i).alias("p"),
                                 F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * rate / i)).alias("c"))
    direct = F.aggregate(F.sequence(F.lit(1), n), start(F.exp(-rate)), step)["c"]
    relative = F.aggregate(F.sequence(low + 1, n), start(F.lit(1.0)), step, lambda a: F.transform(a["c"], lambda c: c / F.element_at(a["c"], -1)))
    return F.when(rate <= LARGE, F.struct(F.lit(0).alias("low"), direct.alias("steps"))).otherwise(F.struct(low.alias("low"), relative.alias("steps")))


def poisson_steps(rate):
    """Cumulative Poisson probabilities P(X <= 0), P(X <= 1), ...: the window behind as many zeros as it leaves out."""
    window = poisson_window(rate)
    return F.concat(F.array_repeat(F.lit(0.0), window["low"]), window["steps"])


def quantile(low, steps, u, longest: int):
    """How many cumulative probabilities do not exceed ``u``, ``low`` and the entries of the sorted ``steps``, by bisection."""
    middle = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")
    right = lambda a: F.get(steps, middle(a)) <= u
    halve = lambda a, _: F.when(a["lo"] >= a["hi"], a).when(
        right(a), F.struct((middle(a) + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), middle(a).alias("hi")))
    turns = F.sequence(F.lit(1), F.lit(max(1, longest.bit_length())))
    return low + F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.size(steps).alias("hi")), halve)["lo"]


def rates(documents: DataFrame, targets: DataFrame | None = None, source: str = "source", text: str = "text",
          size: float = 1.0, alpha: float = ALPHA) -> DataFrame:
    """``(source, chars, rate)`` per source, from all documents.

    ``targets(source, weight)`` names the target weights; a source that it
    does not list gets weight 0. Without it the weight is the source's actual
    share to the power ``alpha``. The mixture has ``size`` times the corpus's
    characters on average. A source without any character gets rate 0.
    """
    own = (documents.groupBy(F.col(f"`{source}`").alias("source"))
           .agg(F.coalesce(F.sum(F.length(F.col(f"`{text}`"))), F.lit(0)).cast("double").alias("chars")))
    if targets is not None:
        goal = targets.groupBy(F.col("source").alias("goal_source")).agg(F.sum("weight").cast("double").alias("w"))
        own = (own.join(goal, F.col("source").eqNullSafe(F.col("goal_source")), "left")
               .withColumn("w", F.coalesce("w", F.lit(0.0))).drop("goal_source"))
    else:
        own = own.withColumn("w", F.sqrt("chars") if alpha == 0.5 else F.pow("chars", F.lit(alpha)))
    own = written(own, "rates")
    total = own.agg(F.sum("chars").alias("c"), F.sum(F.when(F.col("chars") > 0, F.col("w"))).alias("w")).first()
    if not total["w"]:
        return own.select("source", "chars", F.lit(0.0).alias("rate"))
    share = F.col("w") / F.lit(float(total["w"]))
    return own.select("source", "chars", F.when(F.col("chars") > 0, F.lit(size * float(total["c"])) * share / F.col("chars"))
                      .otherwise(F.lit(0.0)).alias("rate"))


def mix(documents: DataFrame, targets: DataFrame | None = None, id_col: str = "doc_id", source: str = "source",
        text: str = "text", size: float = 1.0, alpha: float = ALPHA, seed: int = SEED, number: str | None = "copy") -> DataFrame:
    """The mixture: every document as often as its Poisson count, in a global random order.

    All columns of ``documents`` stay; ``number`` (if not None) adds the copy's
    number from 0. Rows with the same id in one source share their count.
    A null source is a source of its own; null or empty texts weigh nothing
    but are replicated at their source's rate. An empty table stays empty.
    No source is gathered in one task: the rates are one row per source and
    come to the documents by broadcast, or by a salted join if they are many.
    """
    with_columns_of(documents, id_col, source, text)
    if number in documents.columns:
        raise ValueError(f"the table has a column {number} already; name another")
    table = rates(documents, targets, source, text, size, alpha)
    table = table.select(F.col("source").alias("_mix_source"), poisson_window(F.col("rate")).alias("_mix"))
    table = written(table.select("_mix_source", F.col("_mix.low").alias("_mix_low"), F.col("_mix.steps").alias("_mix_steps")), "steps")
    held = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("_mix_steps")), F.lit(0)).alias("numbers"),
                     F.coalesce(F.max(F.size("_mix_steps")), F.lit(1)).alias("longest")).first()
    docs = documents.withColumn("_mix_u", uniform(F.col(f"`{id_col}`"), seed))
    same = F.col(f"`{source}`").eqNullSafe(F.col("_mix_source"))
    if 8 * held["numbers"] + 100 * held["rows"] <= BROADCAST_BYTES:
        joined = docs.join(F.broadcast(table), same)
    else:
        salted = table.withColumn("_mix_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn("_mix_salt", F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(SALTS)).cast("int"))
        joined = docs.join(salted, same & (F.col("_mix_salt") == F.col("_mix_salt2"))).drop("_mix_salt", "_mix_salt2")
    count = quantile(F.col("_mix_low"), F.col("_mix_steps"), F.col("_mix_u"), held["longest"])
    out = (joined.withColumn("_mix_n", count).where("_mix_n > 0")
           .withColumn("_mix_copy", F.explode(F.sequence(F.lit(0), F.col("_mix_n") - 1))))
    order = F.xxhash64(F.lit(seed + 1), F.col(f"`{id_col}`"), F.col("_mix_copy"))
    out = (out.withColumn("_mix_order", order).drop("_mix_u", "_mix_low", "_mix_steps", "_mix_source", "_mix_n")
           .repartition(partitions(documents.sparkSession), "_mix_order").sortWithinPartitions("_mix_order"))
    kept = [F.col(f"`{c}`") for c in documents.columns]
    return out.select(*kept, *([F.col("_mix_copy").alias(number)] if number else []))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH RECURSIVE s AS (
  SELECT source, CAST(coalesce(SUM(length(text)), 0) AS DOUBLE) AS chars FROM documents GROUP BY source
), t AS (SELECT SUM(chars) AS c, SUM(CASE WHEN chars > 0 THEN sqrt(chars) END) AS w FROM s
), r AS (
  SELECT source, CASE WHEN chars > 0 THEN t.c * (sqrt(chars) / t.w) / chars ELSE 0.0 END AS rate FROM s, t
), steps AS (
  SELECT source, rate, CASE WHEN rate > 700 THEN CAST(floor(rate - 12e0 * sqrt(rate)) AS BIGINT) - 24 ELSE 0 END AS k,
         CASE WHEN rate > 700 THEN 1e0 ELSE exp(-rate) END AS p, CASE WHEN rate > 700 THEN 1e0 ELSE exp(-rate) END AS c FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps
  WHERE k < ceil(rate + 12e0 * sqrt(rate)) + 24
), low AS (
  SELECT source, CASE WHEN max(rate) > 700 THEN min(k) ELSE 0 END AS low, CASE WHEN max(rate) > 700 THEN max(c) ELSE 1e0 END AS total
  FROM steps GROUP BY source
), d AS (
  SELECT *, row_number() OVER () AS r, CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0 AS u
  FROM documents
), n AS (
  SELECT d.r, any_value(low.low) + COUNT(steps.k) AS n
  FROM d JOIN low ON d.source IS NOT DISTINCT FROM low.source
  LEFT JOIN steps ON d.source IS NOT DISTINCT FROM steps.source AND steps.c / low.total <= d.u GROUP BY d.r
)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(n)) AS INTEGER) AS copy FROM d JOIN n USING (r)"""
