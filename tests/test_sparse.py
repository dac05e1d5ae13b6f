"""Sparse one-hot vectors: equal to the dense columns, with a million categories, hot and null values."""

import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from conftest import SF001
from contactlens.operators import features as FE
from contactlens.operators import sparse as SP
from contactlens.plans import preprocess as PP
from contactlens.sources import schema as S
from contactlens.sources.campaign import campaign


def test_equal_to_the_dense_form(spark):
    prep = PP.preprocess(campaign(spark, SF001))
    train = prep.where("not is_test and job <> 'building'")  # one category is unseen
    categories = SP.fit_all(train, S.ONEHOT_FEATURES)
    lists = {c: sorted(r[0] for r in train.select(c).distinct().collect()) for c in S.ONEHOT_FEATURES}
    assert {c: [r["value"] for r in t.orderBy("index").collect()] for c, t in categories.items()} == lists
    dense = {r[0]: list(r[1:]) for r in prep.select("row_id", *FE.encode_onehot(lists)).collect()}
    got = {r["row_id"]: r["onehot"] for r in SP.onehot_vectors(prep, categories).collect()}
    assert len(got) == len(dense) and all(got[k].toArray().tolist() == v for k, v in dense.items())


def test_a_million_categories(spark):
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select(F.col("id").alias("row_id"), F.format_string("c%07d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("c"))
    table = SP.fit_categories(df, "c")
    assert table.count() == n
    assert table.where(F.col("index") != F.substring("value", 2, 7).cast("long")).count() == 0
    out = SP.onehot_indices(df, {"c": table})
    assert out.where((F.col("size") != n) | (F.size("indices") != 1) | (F.col("indices")[0] != F.pmod(F.col("row_id") * 7919, F.lit(n)))).count() == 0


@pytest.mark.parametrize("hot", [2048, 3])
def test_hot_unseen_and_null_values(spark, monkeypatch, hot):
    monkeypatch.setattr(SP, "HOT", hot)
    rng = random.Random(1)
    values = ["hot"] * 400 + ["unseen"] * 300 + [None] * 300 + [rng.choice(["a", "é", "", "Z", "日"]) for _ in range(200)]
    df = spark.createDataFrame([(i, v, v if i % 2 else "q", "x") for i, v in enumerate(values)], "row_id long, `a b` string, other string, value string")
    train = df.where("`a b` <> 'unseen'")
    categories = SP.fit_all(train, ["a b", "other"])
    first = sorted({v for v in values if v not in (None, "unseen")}, key=lambda v: v.encode())
    second = sorted({(v if i % 2 else "q") for i, v in enumerate(values) if v not in (None, "unseen")}, key=lambda v: v.encode())
    got = {r["row_id"]: (r["size"], r["indices"]) for r in SP.onehot_indices(df, categories).collect()}
    assert len(got) == len(values)
    for i, v in enumerate(values):
        o = v if i % 2 else "q"
        want = ([first.index(v)] if v in first else []) + ([len(first) + second.index(o)] if o in second else [])
        assert got[i] == (len(first) + len(second), want)


def test_vectors_train_a_model_and_empty_tables(spark):
    df = spark.createDataFrame([(i, f"c{i % 50}", float(i % 50 < 20)) for i in range(500)], "row_id long, c string, label double")
    v = SP.onehot_vectors(df, {"c": SP.fit_categories(df, "c")}, name="features").join(df, "row_id")
    model = LogisticRegression(maxIter=50).fit(v)
    assert model.transform(v).where("prediction = label").count() == 500
    none = SP.fit_categories(df.where("false"), "c")
    assert none.count() == 0 and SP.onehot_indices(df, {"c": none}).where("size(indices) > 0").count() == 0
    assert SP.onehot_indices(df.where("false"), {"c": none}).count() == 0
