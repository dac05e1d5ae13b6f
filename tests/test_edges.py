"""Hand-made edge rows for every semantic trap (FIXTURES.md section 3)."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from contactlens.functions import expressions as X
from contactlens.operators import evaluate as EV
from contactlens.operators import features as FE
from contactlens.operators import profile as P
from contactlens.operators import stats
from contactlens.operators import transform as T

AGES = [17, 18, 28, 29, 60, 96, 97]


def test_bins_left_closed(spark, rows):
    df = rows([(a,) for a in AGES], "age int")
    got = [r[0] for r in df.select(X.age_category("age", right=False)).collect()]
    assert got == [None, "18-29ans", "18-29ans", "30-40ans", "Plus de 60 ans", "Plus de 60 ans", "Plus de 60 ans"]


def test_bins_right_closed(spark, rows):
    df = rows([(a,) for a in AGES], "age int")
    got = [r[0] for r in df.select(X.age_category("age", right=True)).collect()]
    assert got == [None, None, "18-29ans", "18-29ans", "50-60ans", "Plus de 60 ans", None]


def test_onehot_unseen_is_all_zero(spark, rows):
    test = rows([("zz",), ("a",), (None,)], "c string")
    out = test.select(*FE.encode_onehot({"c": ["a", "b", "c"]})).collect()
    assert [tuple(r) for r in out] == [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_ordinal_unseen_raises(spark, rows):
    df = rows([("phd",)], "education string")
    with pytest.raises(PySparkException):
        df.select(FE.encode_ordinal("education", ["primary", "secondary", "tertiary"])).collect()
    nulls = df.select(FE.encode_ordinal("education", ["primary"], handle_invalid="null")).collect()
    assert nulls[0][0] is None


def _fit_robust(spark, rows, values):
    df = rows([(i, v) for i, v in enumerate(values)], "row_id long, balance int")
    g = FE.feature_groups(FE.Options())
    stub = df.select("row_id", *[F.lit(1).alias(c) for c in g["numeric"] if c != "balance"], "balance",
                     *[F.lit("x").alias(c) for c in ["education", *g["onehot"], "deposit"]])
    return FE.fit_encoding(stub)


def test_robust_scale_linear_quantiles(spark, rows):
    enc = _fit_robust(spark, rows, [1, 2, 3, 4, 5, 6, 7, 100])
    center, spread = enc.numeric["balance"]
    assert center == 4.5 and spread == 3.5


def test_robust_scale_zero_iqr(spark, rows):
    enc = _fit_robust(spark, rows, [1] * 7 + [9])
    center, spread = enc.numeric["balance"]
    assert (center, spread) == (1.0, 0.0)
    df = rows([(1,), (9,)], "balance int")
    assert [r[0] for r in df.select(FE.scale("balance", center, spread)).collect()] == [0.0, 8.0]


def test_mode_tie_takes_smallest(spark, rows):
    df = rows([("a",), ("a",), ("b",), ("b",)], "education string")
    assert df.select(T.most_frequent(df, "education")).first()[0] == "a"


def test_mode_excludes_unknown(spark, rows):
    df = rows([(i, e) for i, e in enumerate(["unknown"] * 3 + ["primary"] * 2)], "row_id long, education string")
    out = T.replace_unknown_with_mode(df, "education").select("education").distinct().collect()
    assert [r[0] for r in out] == ["primary"]
    same = T.replace_unknown_with_mode(df, "education", exclude_unknown=False)
    assert same.where("education = 'unknown'").count() == 3


def test_implication_empty_is_true(spark, rows):
    df = rows([(5, 1), (7, 0)], "pdays int, previous int")
    assert stats.pdays_implies_no_previous(df).first()["holds"] is True


def test_implication_null_is_false(spark, rows):
    df = rows([(-1, None)], "pdays int, previous int")
    assert stats.pdays_implies_no_previous(df).first()["holds"] is False


def test_crosstab_missing_cell(spark, rows):
    df = rows([("y", "yes")], "dim string, deposit string")
    got = {(r["deposit"]): (r["count"], r["percent"]) for r in stats.crosstab_rate(df, ["dim"]).collect()}
    assert got == {"yes": (1, 100.0), "no": (0, 0.0)}
    nul = {(r["deposit"]): (r["count"], r["percent"])
           for r in stats.crosstab_rate(df, ["dim"], fill_missing=False).collect()}
    assert nul["no"] == (None, None)


def test_crosstab_empty_bin_listed(spark, rows):
    df = rows([("a", "yes")], "dim string, deposit string")
    out = stats.crosstab_rate(df, ["dim"], levels={"dim": ["a", "b"]}).where("value = 'b'").collect()
    assert {(r["count"], r["percent"]) for r in out} == {(0, None)}


def test_month_unmapped(spark, rows):
    df = rows([("jan",), ("dec",), ("xyz",)], "month string")
    assert [r[0] for r in df.select(X.map_month("month")).collect()] == [1, 12, None]


def test_duplicates_keep_first(spark, rows):
    df = rows([(1, "r"), (2, "r"), (3, "r"), (4, "s")], "row_id long, v string")
    out = sorted(r["row_id"] for r in P.profile_duplicates(df).collect())
    assert out == [2, 3]


def test_duplicates_null_safe(spark, rows):
    df = rows([(1, None), (2, None)], "row_id long, v string")
    assert [r["row_id"] for r in P.profile_duplicates(df).collect()] == [2]


def test_metrics_no_positive_prediction(spark, rows):
    df = rows([(1.0, 0.0), (0.0, 0.0)], "label double, prediction double")
    m = EV.binary_metrics(df).first()
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_half_even_rounding(spark, rows):
    import pandas as pd
    xs = [3.125, 0.575, 2.675, 45.675, 0.285, 1.005]
    df = rows([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(X.round_half_even("x", 2)).collect()] == pd.Series(xs).round(2).tolist()


def test_format_percent(spark, rows):
    df = rows([(45.0,), (3.14159,)], "x double")
    assert [r[0] for r in df.select(X.format_percent("x")).collect()] == ["45.00%", "3.14%"]
    assert [r[0] for r in df.select(X.format_percent("x", None)).collect()] == ["45.0%", "3.14159%"]


def test_filter_ne_keeps_null(spark, rows):
    df = rows([("unknown",), (None,), ("primary",)], "education string")
    assert T.filter_ne(df, "education", "unknown").count() == 2


def test_duplicates_with_hot_group_of_copies(spark, rows):
    """A third of the rows are one group of copies; the split join gives the brute-force answer."""
    import random

    from pyspark.sql import Window
    rnd = random.Random(3)
    data = []
    for i in range(3000):
        if i % 3 == 0:
            data.append((i, "hot", 1, None))
        else:
            data.append((i, rnd.choice("abcde"), rnd.randint(0, 30), rnd.choice([None, "x", "y"])))
    df = rows(data, "row_id long, a string, b int, c string")
    got = P.profile_duplicates(df, ["a", "b", "c"], max_hot_groups=16)
    w = Window.partitionBy("a", "b", "c").orderBy("row_id")
    want = df.withColumn("rn", F.row_number().over(w)).where("rn > 1").drop("rn")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.where("a = 'hot'").count() == 999
