"""The search over all families, its folds and samples, and the split of an exact size."""

import math
import random

import pytest
from pyspark.sql import functions as F

from contactlens.operators import features as FE
from contactlens.operators import models as M
from contactlens.plans import registry


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        x, y = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, i % 4 == 0, float(x * y + rng.gauss(0, 0.3) > 0), x, y))
    return spark.createDataFrame(rows, "row_id long, is_test boolean, label double, x double, y double").cache()


POINTS = [("random_forest", {"numTrees": 2, "maxDepth": 1}), ("gbt_leafwise", {"trees": 6, "max_leaves": 15, "rate": 0.3}),
          ("gbt_leafwise", {"trees": 1, "max_leaves": 2, "rate": 0.3}), ("gbt_depthwise", {"trees": 1, "max_depth": 1}),
          ("gbt_depthwise", {"trees": 3, "max_depth": 1}), ("random_forest", {"numTrees": 3, "maxDepth": 2})]


def test_halving_keeps_the_winner_of_the_full_search(table):
    full_model, full = M.search(table, POINTS, folds=2, shares=(1.0,))
    model, halved = M.search(table, POINTS, folds=2, shares=(0.3, 0.6, 1.0))
    best = lambda t: t.where("is_best").collect()
    [a], [b] = best(full), best(halved)
    assert (a["family"], a["params"], a["mean_accuracy"]) == (b["family"], b["params"], b["mean_accuracy"])
    per_round = {r["round"]: r["count"] for r in halved.groupBy("round").count().collect()}
    assert per_round == {0: 6, 1: 3, 2: 2} and full.count() == 6
    assert M.score_batch(model, table).exceptAll(M.score_batch(full_model, table)).count() == 0
    # a shorter fit is the beginning of a longer one
    alone = M.search(table, [POINTS[3]], folds=2, shares=(1.0,))[1].first()["mean_accuracy"]
    assert alone == full.where("params like '%max_depth=1, trees=1'").first()["mean_accuracy"]


def test_folds_and_samples_do_not_depend_on_partitions(table):
    folds = lambda df: {r["row_id"]: (r["f"], r["s"], r["t"]) for r in df.select(
        "row_id", M.fold_column(3).alias("f"), M._in_sample(0.2, 42).alias("s"), M._in_sample(0.5, 42).alias("t")).collect()}
    a = folds(table)
    assert a == folds(table.repartition(9)) and {f for f, _, _ in a.values()} == {0, 1, 2}
    assert all(t or not s for _, s, t in a.values())
    with pytest.raises(ValueError):
        M.search(table, POINTS, shares=(0.5, 0.2))


def test_winners_are_among_the_points():
    assert ("random_forest", {"numTrees": 100, "maxDepth": 10}) in registry.SEARCH_POINTS
    assert ("gbt_depthwise", {"trees": 300, "max_depth": 7}) in registry.SEARCH_POINTS
    assert ("gbt_leafwise", {"trees": 200, "max_leaves": 31}) in registry.SEARCH_POINTS


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 4097])
def test_exact_split(spark, n, monkeypatch):
    df = spark.range(n).select((F.col("id") * 7919).alias("row_id"))
    for bits in (12, 5):
        monkeypatch.setattr(FE, "SPLIT_BITS", bits)
        for share in (0.0, 0.25, 0.5, 1.0):
            got = FE.train_test_split(df.repartition(5), share, exact=True).where("is_test")
            want = df.orderBy(FE.split_hash("row_id"), "row_id").limit(math.ceil(n * share))
            assert got.count() == math.ceil(n * share) and got.select("row_id").exceptAll(want).count() == 0


def test_exact_split_breaks_ties_by_row_id(spark, monkeypatch):
    monkeypatch.setattr(FE, "split_hash", lambda c, seed=42: F.pmod(F.col("row_id"), F.lit(3)) * 1000)
    got = FE.train_test_split(spark.range(100).withColumnRenamed("id", "row_id"), 0.5, exact=True).where("is_test")
    want = sorted(range(100), key=lambda i: (i % 3, i))[:50]
    assert sorted(r["row_id"] for r in got.collect()) == sorted(want)


def test_exact_split_of_text_ids(spark):
    df = spark.range(50).select(F.concat(F.lit("c-"), "id").alias("row_id"))
    assert FE.train_test_split(df, exact=True).where("is_test").count() == 13


def test_registered_search_scores_every_point_on_all_rows(spark, table, monkeypatch):
    """No point goes by its place on a sample: one row a point, of the whole table."""
    points = [("gbt_leafwise", {"trees": 1, "max_leaves": 2}), ("gbt_leafwise", {"trees": 2, "max_leaves": 2})]
    monkeypatch.setattr(registry, "SEARCH_POINTS", points)
    monkeypatch.setattr(registry, "encoded_table", lambda spark, sf: table)
    got = registry.QUERIES["grid_search"](spark, "").collect()
    assert len(got) == len(points) and {r["share"] for r in got} == {1.0} and sum(r["is_best"] for r in got) == 1
