"""Equi-join of a large table to a table with one row per key, with hot keys split."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_key_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str, salt_from: str,
                 counts_from: DataFrame | None = None, max_hot_keys: int = 2048) -> DataFrame:
    """Inner join ``big.big_key = small.small_key`` where ``small`` has one row per key.

    A key holding more than ``T = rows / max_hot_keys`` rows of ``big`` is hot;
    there are at most ``max_hot_keys`` of them, so their list is collected
    once and broadcast to both sides.
    A hot key's rows get a salt in ``[0, ceil(n / T))`` from ``salt_from``
    (a row id), and its single ``small`` row is repeated once per salt, so
    the shuffle join sends at most about ``T`` rows of any key to a task.
    ``counts_from`` is a cheaper source with the same key column (for
    example the table ``big`` was derived from), used to count the keys.
    """
    src = counts_from if counts_from is not None else big
    per_task = max(math.ceil(src.count() / max_hot_keys), 1)
    hot_rows = (src.groupBy(F.col(big_key).alias("_hk")).agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") > per_task)
                .select("_hk", F.ceil(F.col("_n") / per_task).cast("int").alias("_splits"))
                .collect())  # at most max_hot_keys rows: each holds more than rows / max_hot_keys
    key_type = src.schema[big_key].dataType.simpleString()
    hot = src.sparkSession.createDataFrame(hot_rows, f"_hk {key_type}, _splits int")
    b = (big.join(F.broadcast(hot), F.col(big_key) == F.col("_hk"), "left")
         .withColumn("_bsalt", F.coalesce(F.pmod(F.xxhash64(salt_from), F.col("_splits")), F.lit(0)).cast("int"))
         .drop("_hk", "_splits"))
    s = (small.join(F.broadcast(hot), F.col(small_key) == F.col("_hk"), "left")
         .withColumn("_ssalt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)))
         .drop("_hk", "_splits"))
    return (b.join(s, (F.col(big_key) == F.col(small_key)) & (F.col("_bsalt") == F.col("_ssalt")))
            .drop("_bsalt", "_ssalt"))
