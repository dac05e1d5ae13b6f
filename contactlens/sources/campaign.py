"""Reading the contact table.

``load_campaign`` reads a contact file (CSV with header, or Parquet) with a
declared schema. ``campaign_from_tables`` derives the same table from the
order tables of a TPC-H-like warehouse (one contact per order), which is the
test input; ``campaign`` returns that derivation written once to the shared
scratch folder, so every query scans a pruned, pushed-down Parquet table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlens.operators.joins import hot_key_join
from contactlens.sources import schema as S
from contactlens.sources.storage import fingerprint, materialize

_VERSION = "campaign-v4"


def load_campaign(spark: SparkSession, path: str, fmt: str | None = None, key: str | None = None) -> DataFrame:
    """Read the contact table with an explicit schema (no inference pass).

    In CSV files the usual words for a missing value (``schema.NULL_TOKENS``) are
    null; any other text in a number column is an error.

    ``row_id`` is the column ``key`` where one is named, or the input's own
    ``row_id``; otherwise rows are numbered from 0 in file order (files by
    name), which does not depend on how Spark cuts the files into partitions.
    """
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    if fmt == "csv":
        schema = S.CAMPAIGN_FILE_SCHEMA
        if key and key not in schema.names:
            raise ValueError(f"a CSV contact file has no column {key}")
        text = T.StructType([T.StructField(c, T.StringType()) for c in schema.names])
        df = spark.read.schema(text).option("header", True).option("mode", "FAILFAST").csv(path)
        # read as text first: the reader itself knows one null token only
        df = df.select(*[F.when(~F.col(f.name).isin(*S.NULL_TOKENS), F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields],
                       F.col("_metadata"))
    else:
        df = spark.read.parquet(path)
    if key:
        df = df.withColumn("row_id", F.col(key))
    elif "row_id" not in df.columns:
        df = _numbered(df)
    return df.select("row_id", *S.CAMPAIGN_COLUMNS)


def _numbered(df: DataFrame) -> DataFrame:
    """``df``, just read from files, with ``row_id``: its row number in file order.

    A split (a byte range of a file) is read by one task from front to back,
    so a row's place in it is its increasing id less the split's smallest.
    The running sum over the splits is made on the driver, which plans every
    scan from the same list: one row of four values per split, 128 MB of input each by default.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                   F.monotonically_increasing_id().alias("_id"))
    splits = at.groupBy("_file", "_start").agg(F.min("_id").alias("_lo"), F.count(F.lit(1)).alias("_n")).collect()
    before, rows = 0, []
    for r in sorted(splits, key=lambda r: (r["_file"].encode(), r["_start"])):
        rows.append((r["_file"], r["_start"], r["_lo"], before))
        before += r["_n"]
    table = df.sparkSession.createDataFrame(rows, "_file string, _start long, _lo long, _before long")
    return (at.join(table, ["_file", "_start"])
            .withColumn("row_id", F.col("_before") + F.col("_id") - F.col("_lo")).drop("_file", "_start", "_id", "_lo", "_before"))


def _customer_sequence(orders: DataFrame, n_parts: int,
                       stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per order: its rank among the customer's orders and the previous order.

    A plain window partitioned by customer would put a customer with a third
    of all orders into one task. Instead the orders are range-partitioned on
    (customer, date, order), which splits a hot customer over many tasks; the
    window runs per (partition, customer) chunk, and only customers crossing a
    partition border (at most two per partition) need a correction. Those
    corrections form a table of at most 3 * n_parts rows, so broadcasting it
    is bounded by the partition count, not by the data.

    The range bounds come from a sample seeded by the RDD id, so two
    executions of the same exchange can cut differently. ``stage`` writes the
    chunk assignment once (to the shared scratch folder) and every branch
    reads that copy.
    """
    at = "ots" if "ots" in orders.columns else "od"  # the full timestamp, where there is one
    order_key = ["o_custkey", at, "o_orderkey"]
    ranged = stage(orders.repartitionByRange(n_parts, *order_key)
                   .withColumn("pid", F.spark_partition_id()))

    w_chunk = Window.partitionBy("pid", "o_custkey").orderBy(at, "o_orderkey")
    local = (ranged
             .withColumn("local_seq", F.row_number().over(w_chunk) - 1)
             .withColumn("local_prev_od", F.lag("od").over(w_chunk))
             .withColumn("local_prev_status", F.lag("o_orderstatus").over(w_chunk)))

    edges = ranged.groupBy("pid").agg(F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi"))
    border = (edges.select(F.explode(F.array("lo", "hi")).alias("o_custkey")).distinct())
    chunks = (ranged.join(F.broadcast(border), "o_custkey", "left_semi")
              .groupBy("pid", "o_custkey")
              .agg(F.count(F.lit(1)).alias("n"),
                   F.max_by(F.struct("od", "o_orderstatus"), F.struct(at, "o_orderkey")).alias("last")))
    w_cust = Window.partitionBy("o_custkey").orderBy("pid")
    carry = chunks.select(
        "pid", "o_custkey",
        F.coalesce(F.sum("n").over(w_cust.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("carry_n"),
        F.lag("last").over(w_cust).alias("carry_last"),
    )
    joined = local.join(F.broadcast(carry), ["pid", "o_custkey"], "left")
    first = F.col("local_seq") == 0
    return joined.select(
        *[c for c in orders.columns],
        (F.col("local_seq") + F.coalesce("carry_n", F.lit(0))).alias("seq"),
        F.when(first, F.col("carry_last.od")).otherwise(F.col("local_prev_od")).alias("prev_od"),
        F.when(first, F.col("carry_last.o_orderstatus"))
        .otherwise(F.col("local_prev_status")).alias("prev_status"),
    )


def campaign_from_tables(spark: SparkSession, sf_dir: str, n_parts: int | None = None,
                         key: str | None = None) -> DataFrame:
    """Contact table derived from ``orders``, ``lineitem`` and ``customer``.

    Writes one intermediate table (the range-chunked orders) to the scratch
    folder; ``key`` names it (default: a fingerprint of the inputs).
    """
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = key or _key(sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
        F.to_date("o_orderdate").alias("od"), F.col("o_orderdate").alias("ots"))
    lines = (spark.read.parquet(f"{sf_dir}/lineitem.parquet")
             .groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines")))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")

    o = _customer_sequence(orders, n_parts,
                           lambda df: materialize(spark, df, "orders-chunked", f"{key}-{n_parts}"))
    # a customer with a large share of the orders is split over several join tasks
    b = (hot_key_join(o, customer, "o_custkey", "c_custkey", salt_from="o_orderkey",
                      counts_from=orders.select("o_custkey"))
         .join(lines, F.col("o_orderkey") == lines.l_orderkey, "left"))

    ck, nk = F.col("c_custkey"), F.col("c_nationkey")
    months = F.array(*[F.lit(m) for m in S.MONTHS])
    base = b.select(
        F.col("o_orderkey").alias("row_id"),
        (F.lit(18) + ck % 78).cast("int").alias("age"),
        F.lower("c_mktsegment").alias("job"),
        F.when(ck % 3 == 0, "married").when(ck % 3 == 1, "single").otherwise("divorced").alias("marital"),
        F.when(nk % 7 == 0, "unknown").when(nk % 7 <= 2, "primary")
        .when(nk % 7 <= 4, "tertiary").otherwise("secondary").alias("education"),
        F.when(F.col("c_acctbal") < -800, "yes").otherwise("no").alias("default"),
        F.floor("c_acctbal").cast("int").alias("balance"),
        F.when(nk % 2 == 0, "yes").otherwise("no").alias("housing"),
        F.when(F.col("o_orderpriority") == "5-LOW", "yes").otherwise("no").alias("loan"),
        F.when(F.col("o_orderstatus") == "F", "cellular")
        .when(F.col("o_orderstatus") == "O", "telephone").otherwise("unknown").alias("contact"),
        F.dayofmonth("od").alias("day"),
        F.element_at(months, F.month("od")).alias("month"),
        F.floor(F.col("o_totalprice") / 130).cast("int").alias("duration"),
        F.coalesce("n_lines", F.lit(1)).cast("int").alias("campaign"),
        F.coalesce(F.datediff("od", "prev_od"), F.lit(-1)).cast("int").alias("pdays"),
        F.col("seq").cast("int").alias("previous"),
        F.when(F.col("prev_status") == "F", "success").when(F.col("prev_status") == "O", "failure")
        .when(F.col("prev_status") == "P", "other").otherwise("unknown").alias("poutcome"),
    )
    score = ((F.col("duration") > 1900).cast("int") * 2
             + (F.col("poutcome") == "success").cast("int")
             + (F.col("housing") == "no").cast("int")
             - (F.col("loan") == "yes").cast("int")
             + F.col("row_id") % 3 - 1)
    return base.withColumn("deposit", F.when(score >= 2, "yes").otherwise("no"))


def _key(sf_dir: str) -> str:
    return fingerprint(_VERSION, *(f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem", "customer")))


def campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived contact table, built once per input and read back from Parquet."""
    key = _key(sf_dir)
    return materialize(spark, lambda: campaign_from_tables(spark, sf_dir, key=key), "campaign", key)
