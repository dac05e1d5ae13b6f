"""Defects of the first round: silent data changes, stale keys, unlabelled rows."""

import pytest
from pyspark.sql import functions as F

from contactlens.operators import features as FE
from contactlens.operators import models as M
from contactlens.operators import stats
from contactlens.plans import preprocess as PP
from contactlens.sources import storage
from contactlens.sources import schema as S
from contactlens.sources.campaign import campaign, load_campaign
from conftest import SF001


def test_fractions_are_not_cut(spark):
    df = spark.createDataFrame([("yes", 1.2), ("yes", 1.9), ("no", 2.4), ("no", 2.6)], "deposit string, x double")
    box = {r["deposit"]: r for r in stats.box_summary(df, ["x"]).collect()}
    assert (box["yes"]["min"], box["yes"]["max"]) == (1.2, 1.9)
    assert (box["no"]["min"], box["no"]["max"]) == (2.4, 2.6)
    hist = stats.numeric_histogram(df, ["x"], n_bins=2).orderBy("bin").collect()
    assert [r["count"] for r in hist] == [1, 3] or [r["count"] for r in hist] == [2, 2]
    assert min(r["bin_lo"] for r in hist) == 1.2


def test_no_category_is_lost_and_too_many_raise(spark, monkeypatch):
    train = campaign(spark, SF001).withColumn("job", F.when(F.col("row_id") % 2 == 0, None).otherwise(
        F.concat(F.lit("j"), (F.col("row_id") % 4).cast("string"), F.col("marital"))))
    prep = PP.preprocess(train)
    n = prep.where("job is not null").select("job").distinct().count()
    monkeypatch.setattr(FE, "MAX_CATEGORIES", max(n, 4))
    assert len(FE.fit_encoding(prep).categories["job"]) == n
    monkeypatch.setattr(FE, "MAX_CATEGORIES", n - 1)
    with pytest.raises(ValueError):
        FE.fit_encoding(prep)


def test_key_follows_a_single_file(spark, tmp_path):
    p = tmp_path / "t.parquet"
    p.write_bytes(b"1234")
    before = storage.fingerprint("v", str(p))
    assert before == storage.fingerprint("v", str(p))
    remote = storage.fingerprint("v", f"file://{p}")
    p.write_bytes(b"123456")
    assert storage.fingerprint("v", str(p)) != before
    assert storage.fingerprint("v", f"file://{p}") != remote


def test_unknown_label_raises(spark):
    df = spark.createDataFrame([("maybe",)], "deposit string")
    with pytest.raises(Exception, match="unknown category"):
        df.select(FE.encode_label("deposit", ["no", "yes"])).collect()


def test_rows_without_label_are_scored(spark):
    rows = [(i, i % 4 == 0, float(i % 2), float(i % 2), float(i % 3)) for i in range(60)]
    enc = spark.createDataFrame(rows, "row_id long, is_test boolean, label double, a double, b double")
    model = M.train_preset(enc, "random_forest", numTrees=3)
    out = M.score_batch(model, enc.select("row_id", "a", "b"))
    assert out.columns == ["row_id", "probability", "prediction"]
    assert out.where((F.col("row_id") % 2).cast("double") != F.col("prediction")).count() == 0


def test_row_ids_do_not_depend_on_partitions(spark, tmp_path):
    view = campaign(spark, SF001).orderBy("row_id").select(*S.CAMPAIGN_FILE_SCHEMA.names)
    both = view.repartitionByRange(2, "age")
    both.write.option("header", True).csv(str(tmp_path / "c.csv"))
    seen = []
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for limit in ("4k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
            got = load_campaign(spark, str(tmp_path / "c.csv"))
            seen.append(sorted(tuple(map(str, r)) for r in got.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert seen[0] == seen[1]
    files = sorted((tmp_path / "c.csv").glob("part-*.csv"))
    ages = [line.split(",")[0] for f in files for line in f.read_text().splitlines()[1:]]
    by_id = {int(r[0]): r[1:] for r in seen[0]}
    col = S.CAMPAIGN_COLUMNS.index("age")
    assert len(files) == 2 and [by_id[i][col] for i in range(len(ages))] == ages


def test_a_key_column_names_the_rows(spark, tmp_path):
    campaign(spark, SF001).drop("row_id").withColumn("contact_key", F.col("age").cast("long")).write.parquet(str(tmp_path / "p"))
    assert load_campaign(spark, str(tmp_path / "p"), key="contact_key").where("row_id <> age").count() == 0
