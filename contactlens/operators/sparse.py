"""One-hot encoding of columns with any number of categories, as sparse vectors.

The fitted categories stay a table, ``(value, index)``, in the scratch folder
(or wherever they are saved): values are numbered in their order by a range
partitioning, place in the partition plus the rows of the partitions before
it, so the driver sees one count per partition and no category. Encoding joins
that table: values that hold more than one row in ``HOT`` are resolved by a
broadcast of fewer than ``HOT`` rows, the others by a shuffle on the value.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlens.functions import expressions as X
from contactlens.sources.storage import materialize, scratch_dir

#: values with more than one row in HOT of all are hot; there are fewer than HOT of them
HOT = 2048
#: null values are spread over as many keys of the join
SPREAD = 64


def fit_categories(train: DataFrame, column: str) -> DataFrame:
    """``(value, index)`` of the column's distinct non-null values as text, numbered from 0 in their (byte) order. Written."""
    spark = train.sparkSession
    values = train.select(X.col(column).cast("string").alias("value")).where("value is not null").distinct()
    # the ids of a partition's rows are consecutive from the partition's number * 2**33
    placed = values.repartitionByRange("value").sortWithinPartitions("value").withColumn("id", F.monotonically_increasing_id())
    placed = materialize(spark, placed, f"categories-{column}-placed", uuid.uuid4().hex)
    counts = placed.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, rows = 0, []
    for r in sorted(counts, key=lambda r: r["part"]):
        rows.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(spark.createDataFrame(rows, "part long, start long"))
    numbered = placed.withColumn("part", F.shiftright("id", 33)).join(starts, "part")
    index = F.col("start") + F.col("id") - F.shiftleft("part", 33)
    return materialize(spark, numbered.select("value", index.alias("index")), f"categories-{column}", uuid.uuid4().hex)


def index_of(df: DataFrame, column: str, categories: DataFrame, name: str, spread: Column) -> DataFrame:
    """``df`` with ``name``, the index of the column's value; null for null and unseen values. ``spread`` tells rows apart (a key)."""
    value = X.col(column).cast("string")
    counts = df.groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).where("_v is not null")
    limit = max(1, df.count() // HOT)
    hot = (counts.where(F.col("_n") > limit).join(categories, F.col("_v") == F.col("value"), "left")
           .select(F.col("_v").alias("_hot"), F.col("index").alias("_hot_index")))
    out = df.withColumn("_value", value).join(F.broadcast(hot), F.col("_value") == F.col("_hot"), "left")
    # what needs no look-up, hot or null, must not meet on one key
    done = F.col("_hot").isNotNull() | F.col("_value").isNull()
    out = (out.withColumn("_key", F.when(~done, F.col("_value")))
           .withColumn("_part", F.when(done, F.pmod(F.xxhash64(spread), F.lit(SPREAD)) + 1).otherwise(0)))
    table = categories.select(F.col("value").alias("_cat"), F.col("index").alias("_index"), F.lit(0).cast("long").alias("_zero"))
    out = out.join(table, (F.col("_key") == F.col("_cat")) & (F.col("_part") == F.col("_zero")), "left")
    return (out.withColumn(name, F.coalesce("_hot_index", "_index"))
            .drop("_value", "_hot", "_hot_index", "_key", "_part", "_cat", "_index", "_zero"))


def onehot_indices(df: DataFrame, categories: Mapping[str, DataFrame], key: str = "row_id") -> DataFrame:
    """``(key, size, indices)``: the places of the ones in the vector of all columns' categories, in the order of ``categories``.

    The same vector as the dense ``encode_onehot``: an unseen or null value has no one.
    """
    out, at, places = df, 0, []
    for i, (column, table) in enumerate(categories.items()):
        out = index_of(out, column, table, f"_i{i}", X.col(key))
        places.append(F.col(f"_i{i}") + F.lit(at))
        at += table.count()
    if at >= 1 << 31:
        raise ValueError(f"{at} categories; a vector has fewer than 2**31 places")
    return out.select(X.col(key).alias(key), F.lit(at).alias("size"), F.array_compact(F.array(*places)).cast("array<int>").alias("indices"))


def onehot_vectors(df: DataFrame, categories: Mapping[str, DataFrame], key: str = "row_id", name: str = "onehot") -> DataFrame:
    """``(key, name)`` with sparse vectors for Spark ML; written in their stored form and read back as vectors."""
    spark = df.sparkSession
    found = onehot_indices(df, categories, key)
    ones = F.transform("indices", lambda _: F.lit(1.0))
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), F.col("size"), F.col("indices"), ones.alias("values"))
    path = f"{scratch_dir(spark)}/contactlens/onehot-{uuid.uuid4().hex}"
    found.select(X.col(key).alias(key), stored.alias(name)).write.parquet(path)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(name, VectorUDT())])
    return spark.read.schema(schema).parquet(path)


def fit_all(train: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    return {c: fit_categories(train, c) for c in columns}
