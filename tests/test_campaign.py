"""The skew-safe customer sequence equals a plain per-customer window, hot customer included."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from contactlens.sources import schema as S
from contactlens.sources.campaign import _customer_sequence, load_campaign
from contactlens.sources.storage import materialize


def _orders(spark, n=3000, hot_share=1 / 3, seed=7):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        cust = 1 if rnd.random() < hot_share else rnd.randint(2, 120)
        rows.append((k, cust, rnd.choice("FOP"), rnd.randint(0, 400)))
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, d int")
    return df.select("o_orderkey", "o_custkey", "o_orderstatus",
                     F.date_add(F.lit("1995-01-01").cast("date"), F.col("d")).alias("od"))


def test_sequence_matches_window_with_hot_customer(spark):
    orders = _orders(spark)
    for n_parts in (1, 4, 9):
        key = f"test-seq-{n_parts}-{random.random()}"
        got = _customer_sequence(orders, n_parts, lambda df, k=key: materialize(spark, df, "test-chunks", k))
        w = Window.partitionBy("o_custkey").orderBy("od", "o_orderkey")
        want = orders.select("o_orderkey", (F.row_number().over(w) - 1).alias("seq"),
                             F.lag("od").over(w).alias("prev_od"), F.lag("o_orderstatus").over(w).alias("prev_status"))
        diff = (got.select("o_orderkey", "seq", "prev_od", "prev_status").exceptAll(want).count()
                + want.exceptAll(got.select("o_orderkey", "seq", "prev_od", "prev_status")).count())
        assert diff == 0, n_parts


def test_csv_round_trip(spark, tmp_path):
    rows = [(30, "admin.", "married", "secondary", "no", 100, "yes", "no", "cellular", 5, "may", 261, 1, -1, 0,
             "unknown", "no")]
    df = spark.createDataFrame(rows, S.CAMPAIGN_FILE_SCHEMA)
    path = str(tmp_path / "contacts.csv")
    df.coalesce(1).write.option("header", True).csv(path)
    back = load_campaign(spark, path, "csv")
    assert back.columns == ["row_id", *S.CAMPAIGN_COLUMNS]
    assert back.drop("row_id").collect() == df.collect()


def test_csv_round_trip_full_table(spark, tmp_path):
    from conftest import SF001
    from contactlens.sources.campaign import campaign
    src = campaign(spark, SF001)
    path = str(tmp_path / "contacts_full.csv")
    src.drop("row_id").write.option("header", True).csv(path)
    back = load_campaign(spark, path, "csv").drop("row_id")
    assert back.schema == spark.createDataFrame([], S.CAMPAIGN_FILE_SCHEMA).schema
    assert back.exceptAll(src.drop("row_id")).count() == 0
    assert src.drop("row_id").exceptAll(back).count() == 0


def test_fresh_build_through_nested_materialize(spark):
    """The table builder writes its own intermediate table from inside the outer build."""
    import uuid

    from conftest import SF0001
    from contactlens.sources.campaign import campaign_from_tables
    key = f"test-{uuid.uuid4().hex[:8]}"
    built = materialize(spark, lambda: campaign_from_tables(spark, SF0001, key=key), "campaign-test", key)
    assert built.count() == spark.read.parquet(f"{SF0001}/orders.parquet").count()
    again = materialize(spark, lambda: 1 / 0, "campaign-test", key)  # published: builder not called
    assert again.count() == built.count()


def test_many_chunks_match_duckdb(spark):
    """With 50 range chunks on 1,500 customers most customers cross a chunk border."""
    import uuid

    import duckdb

    from conftest import SF001
    from contactlens.plans.oracle import with_campaign
    from contactlens.sources.campaign import campaign_from_tables
    key = f"test-many-{uuid.uuid4().hex[:8]}"
    got = (campaign_from_tables(spark, SF001, n_parts=50, key=key)
           .select("row_id", "pdays", "previous", "poutcome").toPandas().sort_values("row_id"))
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    want = con.execute(with_campaign("SELECT row_id, pdays, previous, poutcome FROM campaign ORDER BY row_id")).fetchdf()
    assert got.reset_index(drop=True).astype(object).equals(want.astype(object))


def test_hot_key_join_matches_plain_join(spark):
    from contactlens.operators.joins import hot_key_join
    orders = _orders(spark, n=3000, hot_share=1 / 3)
    cust = spark.range(0, 130).select(F.col("id").alias("c_custkey"), (F.col("id") * 7).alias("attr"))
    got = hot_key_join(orders, cust, "o_custkey", "c_custkey", "o_orderkey", max_hot_keys=16)
    want = orders.join(cust, orders.o_custkey == cust.c_custkey)
    cols = ["o_orderkey", "o_custkey", "c_custkey", "attr"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.select(cols).exceptAll(got.select(cols)).count() == 0
    assert got.count() == 3000
