"""Shared helpers: the shared scratch folder, written tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a single-process local session without that setting gets a folder of
    its own (tests); any cluster must name a shared one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="contactlens-llm-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read back (cuts the lineage).

    The folder's name is new for every call, so a table is never stale.
    """
    path = f"{scratch(df.sparkSession)}/contactlens-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Number of partitions for an explicit deal, as for Spark's own shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_columns_of(df: DataFrame, *needed: str) -> None:
    """Raise if a needed column is missing (extra columns are always allowed)."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None],
              schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` for a function of one batch; empty batches are skipped."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield from (out.to_batches() if isinstance(out, pa.Table) else [out])
    return df.mapInArrow(run, schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)``, component = smallest node.

    Distributed union-find by alternating large-star and small-star steps
    (DataFrame aggregates and joins only). Each round is written to the shared
    scratch folder. Nodes are any ordered type. A star's centre is found by a
    partially aggregated ``min``, so a hub with very many edges never gathers
    in one task; the joins on it are plain equi-joins that adaptive execution
    can split. Nodes without edges are not returned; null ends and self-loops
    are ignored.
    """
    e = written(edges.where("a is not null and b is not null and a <> b")
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        # done when every node has one edge, to a node that has none to a smaller one
        inner = e.select(F.col("u").alias("v"), F.lit(1).alias("inner")).distinct()
        state = e.join(inner, "v", "left").agg(F.count("inner").alias("deep"), F.count(F.lit(1)).alias("edges"),
                                               F.countDistinct("u").alias("nodes")).first()
        if state["deep"] == 0 and state["edges"] == state["nodes"]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above a node move to the smallest of its neighbourhood
        large = (e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u")
                 .select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        e = written(small, "cc")
    else:
        raise RuntimeError("components did not settle")
    tops = e.select(F.col("v").alias("node")).distinct()
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(tops.select("node", F.col("node").alias("component"))))
