"""Invariants of the reports and encoders on the sf0.01 contact table."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from contactlens.functions import expressions as X
from contactlens.operators import features as FE
from contactlens.operators import reshape as R
from contactlens.operators import stats
from contactlens.plans.preprocess import preprocess_and_transform
from contactlens.sources import schema as S
from contactlens.sources.campaign import campaign


@pytest.fixture(scope="module")
def contacts(spark):
    return campaign(spark, SF001)


def test_fixture_facts(contacts):
    assert contacts.count() == 15000
    dep = {r["deposit"]: r["count"] for r in stats.target_distribution(contacts).collect()}
    assert dep == {"yes": 7943, "no": 7057}
    assert stats.pdays_implies_no_previous(contacts).first()["holds"] is True


def test_crosstab_percents_sum_to_100(contacts):
    ct = stats.crosstab_rate(contacts.withColumn("age_cat", X.age_category(right=True)), S.CROSSTAB_DIMENSIONS)
    sums = ct.groupBy("variable", "value").agg(F.sum("percent").alias("p"), F.sum("count").alias("n")).collect()
    assert all(abs(r["p"] - 100.0) < 0.011 for r in sums)
    per_dim = {}
    for r in sums:
        per_dim[r["variable"]] = per_dim.get(r["variable"], 0) + r["n"]
    # every dimension covers the table, except age bins that leave out age 18 (right-closed)
    assert all(v == 15000 for k, v in per_dim.items() if k != "age_cat")


def test_categorical_counts_sum_to_table(contacts):
    d = stats.categorical_distribution(contacts).groupBy("variable").agg(F.sum("count").alias("n")).collect()
    assert {r["n"] for r in d} == {15000}


def test_split_disjoint_complete_and_stable(contacts):
    a = FE.train_test_split(contacts).select("row_id", "is_test")
    b = FE.train_test_split(contacts.repartition(13)).select("row_id", F.col("is_test").alias("t2"))
    j = a.join(b, "row_id")
    assert j.count() == 15000
    assert j.where("is_test <> t2").count() == 0
    n_test = a.where("is_test").count()
    assert 0.22 < n_test / 15000 < 0.28


def test_onehot_rows_sum_to_one(spark, contacts):
    enc, fit = preprocess_and_transform(contacts)
    for c in S.ONEHOT_FEATURES:
        cols = [F.col(f"`{FE.onehot_name(c, v)}`") for v in fit.categories[c]]
        assert enc.select(sum(cols).alias("s")).where("s <> 1").count() == 0
    assert len(fit.feature_names) == 30
    assert enc.columns[:3] == ["row_id", "is_test", "label"]


def test_cyclic_unit_circle(contacts):
    s, c = X.cyclic("day", 31)
    bad = contacts.select((s * s + c * c).alias("r")).where(F.abs(F.col("r") - 1) > 1e-12).count()
    assert bad == 0


def test_unpivot_of_pivot_is_identity(contacts):
    long = stats.count_by(contacts, "job", "deposit")
    back = R.unpivot_counts(R.pivot_counts(contacts, "job", fill=0), "job")
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, back.where("count > 0").collect()))


def test_correlation_symmetric_unit_diagonal(contacts):
    rows = {(r["var_x"], r["var_y"]): r["corr"] for r in stats.correlation_matrix(contacts).collect()}
    for (a, b), v in rows.items():
        assert rows[(b, a)] == v
        if a == b:
            assert math.isclose(v, 1.0)


def test_box_whiskers_inside_range(contacts):
    for r in stats.box_summary(contacts).collect():
        assert r["min"] <= r["whisker_lo"] <= r["q1"] <= r["median"] <= r["q3"] <= r["whisker_hi"] <= r["max"]
