"""Table profile: head, shape, describe, missing values, duplicates, distinct values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlens.functions import expressions as X
from contactlens.functions.quantiles import continuous
from contactlens.functions.selection import select_quantiles
from contactlens.sources import schema as S

ID = "row_id"


def business_columns(df: DataFrame) -> list[str]:
    """All columns but the row id (which stands for the pandas index)."""
    return [c for c in df.columns if c != ID]


def profile_head(df: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` rows by row id (TakeOrderedAndProject: a top-n per task, no full sort)."""
    return df.orderBy(ID).limit(n)


def profile_shape(df: DataFrame) -> DataFrame:
    """``(n_rows, n_cols)``; the row id is the index, not a column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(business_columns(df))).alias("n_cols"))


def profile_describe(df: DataFrame, columns: Sequence[str] = S.DESCRIBE_COLUMNS,
                     std_digits: int | None = None, exact: bool = True,
                     accuracy: int = 10000) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75% (linear), max per numeric column.

    Built on the (variable, value) count table: exact quantiles without
    holding raw rows, and a centred variance over the distinct values. One
    scan of the input. ``exact=False`` (for continuous columns with very many
    distinct values) uses fixed-size sketches instead: ``percentile_approx``,
    ``stddev_samp`` and ``avg`` straight over the rows.
    """
    long = (df.select(*[X.col(c).cast("double").alias(c) for c in columns])
            .unpivot([], list(columns), "variable", "value")
            .where(F.col("value").isNotNull()))
    if not exact:
        approx = long.groupBy("variable").agg(
            F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"), F.percentile_approx("value", [0.25, 0.5, 0.75], accuracy).alias("q"),
            F.max("value").alias("max"))
        std = F.round("std", std_digits) if std_digits is not None else F.col("std")
        return approx.select("variable", "count", "mean", std.alias("std"), "min",
                             F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")
    if continuous(df, columns):
        quartiles = select_quantiles(long, "value", [0.25, 0.5, 0.75], ["variable"], ["p25", "p50", "p75"])
        rest = long.groupBy("variable").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                            F.min("value").alias("min"), F.max("value").alias("max"))
        std = F.round("std", std_digits) if std_digits is not None else F.col("std")
        return (rest.join(quartiles, "variable")
                .select("variable", "count", "mean", std.alias("std"), "min", "p25", "p50", "p75", "max"))
    vc = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("cnt"))
    # the mean rides along as a window aggregate over the value-count rows of
    # the same variable, so the centred variance needs no second pass
    w = Window.partitionBy("variable")
    vc = vc.withColumn("mean", F.sum(F.col("value") * F.col("cnt")).over(w) / F.sum("cnt").over(w))
    stats = vc.groupBy("variable").agg(
        F.sum("cnt").alias("count"), F.first("mean").alias("mean"),
        F.sqrt(F.try_divide(F.sum(F.col("cnt") * (F.col("value") - F.col("mean")) ** 2),
                            F.sum("cnt") - 1)).alias("std"),
        F.min("value").alias("min"),
        F.percentile(F.col("value"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("cnt")).alias("q"),
        F.max("value").alias("max"))
    std = F.round("std", std_digits) if std_digits is not None else F.col("std")
    return stats.select(
        "variable", "count", "mean", std.alias("std"), "min",
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def profile_missing(df: DataFrame) -> DataFrame:
    """Per column: position, type and NULL count, from one aggregate."""
    cols = business_columns(df)
    types = dict(df.dtypes)
    row = df.agg(*[F.count_if(X.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    entries = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                        F.lit(types[c]).alias("dtype"), F.col(f"m{i}").alias("n_missing"))
               for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def profile_duplicates(df: DataFrame, columns: Sequence[str] | None = None,
                       max_hot_groups: int = 2048) -> DataFrame:
    """Rows equal (NULL-safe) on ``columns`` to a row with a smaller row id.

    1. Groups of copies are counted with a partially aggregated ``groupBy``
       (a group holding a third of the table is reduced map-side), keeping
       each group's first row id and size.
    2. With ``T`` = rows / ``max_hot_groups``, a group
       larger than ``T`` is hot; there are at most ``max_hot_groups`` of
       them, so that table is broadcast. A hot group is split ``ceil(n/T)``
       ways: its rows get a salt from their row id, and its single group row
       is repeated once per salt (at most ``2 * max_hot_groups`` extra rows
       in all).
    3. Rows meet their group on (columns, salt) in one shuffle join; no task
       receives more than about ``T`` rows of any one group.

    Cost: the input is read three times (the group count for the hot list,
    the group count for the join, the rows), in exchange for a split that
    does not depend on run-time skew detection.
    """
    cols = list(columns or business_columns(df))
    keys = [X.col(c).alias(c) for c in cols]
    # T from the row count (Parquet answers it from file footers), used as a literal
    per_task = max(math.ceil(df.count() / max_hot_groups), 1)
    groups = (df.groupBy(*keys).agg(F.min(ID).alias("_first"), F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") > 1)
              .withColumn("_splits", F.when(F.col("_n") > per_task, F.ceil(F.col("_n") / per_task))
                          .otherwise(F.lit(1)).cast("int")))
    hot = groups.where(F.col("_splits") > 1).select(*[F.col(f"`{c}`").alias(f"_h{i}") for i, c in enumerate(cols)],
                                                    "_splits")
    build = groups.select(*[F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(cols)], "_first",
                          F.explode(F.sequence(F.lit(0), F.col("_splits") - 1)).alias("_gsalt"))
    tag = [X.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(cols)]
    probe = (df.join(F.broadcast(hot), tag, "left")
             .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(ID), F.col("_splits")), F.lit(0)).cast("int")))
    cond = [X.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(cols)] + [F.col("_salt") == F.col("_gsalt")]
    return (probe.join(build, cond).where(F.col(ID) != F.col("_first"))
            .select(ID, *[X.col(c) for c in cols if c != ID]))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with the row id of their first appearance (pandas ``unique`` order)."""
    return df.groupBy(X.col(column).alias(column)).agg(F.min(ID).alias("first_row"))
