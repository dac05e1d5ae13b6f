"""Registered queries: ``(spark, sf_dir) -> DataFrame`` and their DuckDB texts.

Each query starts from the contact table derived from the warehouse tables
(``contactlens.sources.campaign.campaign``), so its work grows with them.
"""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlens.functions import expressions as X
from contactlens.functions.selection import select_quantiles
from contactlens.operators import stats
from contactlens.plans.oracle import with_campaign
from contactlens.sources import schema as S
from contactlens.sources.campaign import _key, campaign, load_campaign
from contactlens.sources.storage import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def q(name: str) -> str:
    """DuckDB identifier quoting (``default`` is a keyword)."""
    return f'"{name}"'


# DuckDB forms of shared expressions -------------------------------------------------
AGE_CAT_RIGHT_SQL = ("CASE WHEN age > 18 AND age <= 29 THEN '18-29ans' WHEN age > 29 AND age <= 40 THEN '30-40ans' "
                     "WHEN age > 40 AND age <= 50 THEN '40-50ans' WHEN age > 50 AND age <= 60 THEN '50-60ans' "
                     "WHEN age > 60 AND age <= 96 THEN 'Plus de 60 ans' END")
AGE_CAT_LEFT_SQL = ("CASE WHEN age >= 18 AND age < 29 THEN '18-29ans' WHEN age >= 29 AND age < 40 THEN '30-40ans' "
                    "WHEN age >= 40 AND age < 50 THEN '40-50ans' WHEN age >= 50 AND age < 60 THEN '50-60ans' "
                    "WHEN age >= 60 THEN 'Plus de 60 ans' END")
MONTH_NUM_SQL = ("CASE month " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(S.MONTHS))
                 + " END")


def pct_sql(part: str, whole: str) -> str:
    """pandas ``(part / whole * 100).round(2)``; same IEEE steps as ``expressions.percent``."""
    return f"round_even(CAST({part} AS DOUBLE) / NULLIF({whole}, 0) * 100e0 * 100e0, 0) / 100e0"


@register("continuous_quantiles", "SELECT l_returnflag, " + ", ".join(
    f"round(quantile_cont(l_extendedprice, {p}), 6) AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75)) + " FROM lineitem GROUP BY l_returnflag")
def _continuous_quantiles(spark, sf):
    """Quartiles of a column of nearly distinct doubles, by narrowing (rounded: engines interpolate in different orders)."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    found = select_quantiles(lines, "l_extendedprice", [0.25, 0.5, 0.75], ["l_returnflag"])
    return found.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")])


# -- 2.1 sources -----------------------------------------------------------------

@register("load_campaign_csv", with_campaign("SELECT * REPLACE (row_number() OVER (ORDER BY row_id) - 1 AS row_id) FROM campaign"))
def _load_campaign_csv(spark, sf):
    """The contact table written as CSV files with header, and read back: rows are numbered in file order."""
    path = f"{scratch_dir(spark)}/contactlens/campaign-{uuid.uuid4().hex}.csv"
    campaign(spark, sf).orderBy("row_id").drop("row_id").write.option("header", True).csv(path)
    return load_campaign(spark, path)


@register("load_campaign", with_campaign("SELECT * FROM campaign"))
def _load_campaign(spark, sf):
    return campaign(spark, sf)


# -- 2.4 aggregations --------------------------------------------------------------

def _rounded_sql(cols) -> str:
    return ", ".join(f"round_even({c} * 100e0, 0) / 100e0 AS {c}_rounded" for c in cols)


def _mean_sql(c: str) -> str:
    return with_campaign(
        f"SELECT *, {_rounded_sql(['mean_all', 'mean_yes', 'mean_no'])} FROM ("
        f"SELECT AVG({c}) AS mean_all, AVG(CASE WHEN deposit = 'yes' THEN {c} END) AS mean_yes, "
        f"AVG(CASE WHEN deposit = 'no' THEN {c} END) AS mean_no FROM campaign)")


@register("mean_balance_by_target", _mean_sql("balance"))
def _mean_balance(spark, sf):
    return stats.mean_by_target(campaign(spark, sf), "balance")


@register("mean_previous_by_target", _mean_sql("previous"))
def _mean_previous(spark, sf):
    return stats.mean_by_target(campaign(spark, sf), "previous")


@register("median_duration_by_target", with_campaign(
    f"SELECT *, {_rounded_sql(['median_all', 'median_yes', 'median_no'])} FROM ("
    "SELECT CAST(MEDIAN(m) AS DOUBLE) AS median_all, CAST(MEDIAN(CASE WHEN deposit = 'yes' THEN m END) AS DOUBLE) AS median_yes, "
    "CAST(MEDIAN(CASE WHEN deposit = 'no' THEN m END) AS DOUBLE) AS median_no "
    "FROM (SELECT deposit, round_even(CAST(duration AS DOUBLE) / 60e0 * 100e0, 0) / 100e0 AS m FROM campaign))"))
def _median_duration(spark, sf):
    return stats.median_duration_by_target(campaign(spark, sf))


@register("check_implication", with_campaign(
    "SELECT COALESCE(BOOL_AND(COALESCE(previous = 0, false)), true) AS holds FROM campaign WHERE pdays = -1"))
def _check_implication(spark, sf):
    return stats.pdays_implies_no_previous(campaign(spark, sf))


@register("target_distribution", with_campaign(
    "SELECT deposit, COUNT(*) AS count, COUNT(*) / SUM(COUNT(*)) OVER () AS share FROM campaign GROUP BY deposit"))
def _target_distribution(spark, sf):
    return stats.target_distribution(campaign(spark, sf))


def _union_sql(cols, select_fn) -> str:
    return " UNION ALL ".join(select_fn(c) for c in cols)


@register("categorical_distribution", with_campaign(_union_sql(
    S.CATEGORICAL_COLUMNS,
    lambda c: f"SELECT '{c}' AS variable, CAST({q(c)} AS VARCHAR) AS value, COUNT(*) AS count "
              f"FROM campaign WHERE {q(c)} IS NOT NULL GROUP BY 2")))
def _categorical_distribution(spark, sf):
    return stats.categorical_distribution(campaign(spark, sf))


def _hist_sql(n_bins: int = 20) -> str:
    long = _union_sql(S.HISTOGRAM_COLUMNS, lambda c: f"SELECT '{c}' AS variable, CAST({c} AS BIGINT) AS value FROM campaign")
    return with_campaign(
        f"SELECT variable, bin, lo + bin * w AS bin_lo, lo + (bin + 1) * w AS bin_hi, COUNT(*) AS count FROM ("
        f" SELECT l.variable, r.lo, CAST(r.hi - r.lo AS DOUBLE) / {n_bins}e0 AS w,"
        f" CAST(COALESCE(LEAST(FLOOR(CAST(l.value - r.lo AS DOUBLE) / NULLIF(CAST(r.hi - r.lo AS DOUBLE) / {n_bins}e0, 0)), {n_bins - 1}), 0) AS INT) AS bin"
        f" FROM long l JOIN (SELECT variable, MIN(value) AS lo, MAX(value) AS hi FROM long GROUP BY variable) r USING (variable)"
        f" WHERE l.value IS NOT NULL) GROUP BY variable, bin, lo, w",
        f"long AS ({long})")


@register("numeric_histogram", _hist_sql())
def _numeric_histogram(spark, sf):
    return stats.numeric_histogram(campaign(spark, sf))


def _corr_sql() -> str:
    cols = S.CORRELATION_COLUMNS
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            expr = f"ROUND(CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6)"
            parts.append(f"SELECT '{a}' AS var_x, '{b}' AS var_y, {expr} AS corr FROM c")
            if a != b:
                parts.append(f"SELECT '{b}' AS var_x, '{a}' AS var_y, {expr} AS corr FROM c")
    return with_campaign(" UNION ALL ".join(parts),
                         "c AS (SELECT *, CASE WHEN deposit = 'yes' THEN 1 ELSE 0 END AS deposit_num FROM campaign)")


@register("correlation_matrix", _corr_sql())
def _correlation_matrix(spark, sf):
    return stats.correlation_matrix(campaign(spark, sf), digits=6)


@register("count_by_age_target", with_campaign(
    "SELECT age, deposit, COUNT(*) AS count FROM campaign GROUP BY age, deposit"))
def _count_by_age_target(spark, sf):
    return stats.count_by(campaign(spark, sf), "age", "deposit")


def _crosstab_sql(dims, src="c") -> str:
    def one(d):
        return (f"SELECT '{d}' AS variable, CAST({q(d)} AS VARCHAR) AS value, "
                f"COUNT(*) FILTER (WHERE deposit = 'yes') AS n0, COUNT(*) FILTER (WHERE deposit = 'no') AS n1 "
                f"FROM {src} WHERE {q(d)} IS NOT NULL GROUP BY 2")
    return (f"SELECT variable, value, deposit, count, n0 + n1 AS total, {pct_sql('count', 'n0 + n1')} AS percent FROM ("
            f" SELECT variable, value, n0, n1, 'yes' AS deposit, n0 AS count FROM ({_union_sql(dims, one)})"
            f" UNION ALL SELECT variable, value, n0, n1, 'no' AS deposit, n1 AS count FROM ({_union_sql(dims, one)}))")


@register("crosstab_rate", with_campaign(
    _crosstab_sql(S.CROSSTAB_DIMENSIONS),
    f"c AS (SELECT *, {AGE_CAT_RIGHT_SQL} AS age_cat FROM campaign)"))
def _crosstab_rate(spark, sf):
    df = campaign(spark, sf).withColumn("age_cat", X.age_category(right=True))
    # age bins are a categorical in the source: an empty bin is listed with count 0
    return stats.crosstab_rate(df, S.CROSSTAB_DIMENSIONS, levels={"age_cat": S.AGE_LABELS})


@register("category_order", with_campaign(
    "SELECT variable, value, count, CAST(ROW_NUMBER() OVER (PARTITION BY variable ORDER BY count DESC, value) AS INTEGER) AS rank FROM ("
    + _union_sql(["job", "education", "month"],
                 lambda c: f"SELECT '{c}' AS variable, {c} AS value, COUNT(*) AS count FROM campaign GROUP BY 2")
    + ")"))
def _category_order(spark, sf):
    return stats.category_order(campaign(spark, sf), ["job", "education", "month"])


@register("count_by_month_target", with_campaign(
    "SELECT c.month, c.deposit, c.count, r.month_rank FROM "
    "(SELECT month, deposit, COUNT(*) AS count FROM campaign GROUP BY month, deposit) c LEFT JOIN "
    "(SELECT month, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, month) AS INTEGER) AS month_rank FROM campaign GROUP BY month) r "
    "USING (month)"))
def _count_by_month_target(spark, sf):
    return stats.count_by_month_target(campaign(spark, sf))


@register("monthly_campaign", with_campaign(
    "SELECT month, CAST(SUM(campaign) AS BIGINT) AS campaign_count, COUNT(*) FILTER (WHERE deposit = 'yes') AS deposit_yes_count, "
    f"COUNT(*) FILTER (WHERE deposit = 'no') AS deposit_no_count, {MONTH_NUM_SQL} AS month_num FROM campaign GROUP BY month"))
def _monthly_campaign(spark, sf):
    return stats.monthly_campaign(campaign(spark, sf))


def _box_cte() -> str:
    long = _union_sql(stats.BOX_COLUMNS,
                      lambda c: f"SELECT row_id, deposit, '{c}' AS variable, CAST({c} AS BIGINT) AS value FROM campaign"
                                + (" WHERE pdays <> -1" if c == "pdays" else ""))
    return (f"bl AS ({long}), bs AS (SELECT variable, deposit, COUNT(*) AS n, CAST(MIN(value) AS DOUBLE) AS min, "
            "quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, "
            "CAST(MAX(value) AS DOUBLE) AS max FROM bl GROUP BY variable, deposit), "
            "bf AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM bs)")


@register("box_summary", with_campaign(
    "SELECT bf.*, w.whisker_lo, w.whisker_hi, w.n_outliers FROM bf JOIN ("
    " SELECT bl.variable, bl.deposit,"
    " CAST(MIN(CASE WHEN value >= lower_fence AND value <= upper_fence THEN value END) AS DOUBLE) AS whisker_lo,"
    " CAST(MAX(CASE WHEN value >= lower_fence AND value <= upper_fence THEN value END) AS DOUBLE) AS whisker_hi,"
    " CAST(COUNT(*) FILTER (WHERE NOT (value >= lower_fence AND value <= upper_fence)) AS BIGINT) AS n_outliers"
    " FROM bl JOIN bf USING (variable, deposit) GROUP BY bl.variable, bl.deposit) w USING (variable, deposit)",
    _box_cte()))
def _box_summary(spark, sf):
    return stats.box_summary(campaign(spark, sf))


@register("outlier_rows", with_campaign(
    "SELECT bl.row_id, bl.deposit, bl.variable, bl.value FROM bl JOIN bf USING (variable, deposit) "
    "WHERE bl.value < bf.lower_fence OR bl.value > bf.upper_fence", _box_cte()))
def _outlier_rows(spark, sf):
    return stats.outlier_rows(campaign(spark, sf)).withColumn("value", F.col("value").cast("bigint"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cross table of the previous outcome against the target (first slice)."""
    return stats.crosstab_rate(campaign(spark, sf_dir), ["poutcome"])



# =====================================================================================
# 2.2 profile
# =====================================================================================
from contactlens.operators import evaluate as EV  # noqa: E402
from contactlens.operators import features as FE  # noqa: E402
from contactlens.operators import sparse as SP  # noqa: E402
from contactlens.operators import profile as P  # noqa: E402
from contactlens.operators import reshape as R  # noqa: E402
from contactlens.operators import transform as T  # noqa: E402
from contactlens.plans import preprocess as PP  # noqa: E402

BUSINESS = S.CAMPAIGN_COLUMNS
BUSINESS_SQL = ", ".join(q(c) for c in BUSINESS)


@register("profile_head", with_campaign("SELECT * FROM campaign ORDER BY row_id LIMIT 10"))
def _profile_head(spark, sf):
    return P.profile_head(campaign(spark, sf))


@register("profile_shape", with_campaign(f"SELECT COUNT(*) AS n_rows, {len(BUSINESS)} AS n_cols FROM campaign"))
def _profile_shape(spark, sf):
    return P.profile_shape(campaign(spark, sf))


@register("profile_describe", with_campaign(_union_sql(
    S.DESCRIBE_COLUMNS,
    lambda c: (f"SELECT '{c}' AS variable, COUNT({c}) AS count, AVG({c}) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std, "
               f"CAST(MIN({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, "
               f"quantile_cont({c}, 0.75) AS p75, CAST(MAX({c}) AS DOUBLE) AS max FROM campaign"))))
def _profile_describe(spark, sf):
    return P.profile_describe(campaign(spark, sf), std_digits=6)


@register("profile_missing", with_campaign(_union_sql(
    list(enumerate(BUSINESS)),
    lambda ic: (f"SELECT {ic[0]} AS position, '{ic[1]}' AS column, "
                f"'{S.CAMPAIGN_SCHEMA[ic[1]].dataType.simpleString()}' AS dtype, "
                f"COUNT(*) - COUNT({q(ic[1])}) AS n_missing FROM campaign"))))
def _profile_missing(spark, sf):
    return P.profile_missing(campaign(spark, sf))


@register("profile_duplicates", with_campaign(
    f"SELECT row_id, {BUSINESS_SQL} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {BUSINESS_SQL} ORDER BY row_id) AS rn "
    "FROM campaign) WHERE rn > 1"))
def _profile_duplicates(spark, sf):
    return P.profile_duplicates(campaign(spark, sf))


DUP_SUBSET = ["job", "marital", "education", "housing", "loan", "contact", "poutcome", "deposit"]
DUP_SUBSET_SQL = ", ".join(DUP_SUBSET)


@register("profile_duplicates_subset", with_campaign(
    f"SELECT row_id, {DUP_SUBSET_SQL} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {DUP_SUBSET_SQL} ORDER BY row_id) AS rn "
    "FROM campaign) WHERE rn > 1"))
def _profile_duplicates_subset(spark, sf):
    return P.profile_duplicates(campaign(spark, sf).select("row_id", *DUP_SUBSET))


@register("distinct_values", with_campaign("SELECT job, MIN(row_id) AS first_row FROM campaign GROUP BY job"))
def _distinct_values(spark, sf):
    return P.distinct_values(campaign(spark, sf), "job")


# =====================================================================================
# 2.3 filters, projections, scalar expressions
# =====================================================================================

@register("filter_eq", with_campaign("SELECT * FROM campaign WHERE deposit = 'yes'"))
def _filter_eq(spark, sf):
    return T.filter_eq(campaign(spark, sf), "deposit", "yes")


@register("filter_ne", with_campaign("SELECT * FROM campaign WHERE education IS DISTINCT FROM 'unknown'"))
def _filter_ne(spark, sf):
    return T.filter_ne(campaign(spark, sf), "education", "unknown")


@register("drop_columns", with_campaign("SELECT * EXCLUDE (deposit, age, pdays) FROM campaign"))
def _drop_columns(spark, sf):
    return T.drop_columns(campaign(spark, sf), ["deposit", "age", "pdays", "not_a_column"])


MINUTES_SQL = "round_even(CAST(duration AS DOUBLE) / 60e0 * 100e0, 0) / 100e0"


@register("duration_minutes", with_campaign(f"SELECT row_id, duration, {MINUTES_SQL} AS duration_minutes FROM campaign"))
def _duration_minutes(spark, sf):
    return T.with_duration_minutes(campaign(spark, sf)).select("row_id", "duration", "duration_minutes")


@register("target_flag", with_campaign(
    "SELECT row_id, deposit, CASE WHEN deposit = 'yes' THEN 1 ELSE 0 END AS deposit_num FROM campaign"))
def _target_flag(spark, sf):
    return T.with_target_flag(campaign(spark, sf)).select("row_id", "deposit", "deposit_num")


@register("bucketize", with_campaign(
    f"SELECT row_id, age, {AGE_CAT_LEFT_SQL} AS age_cat, {AGE_CAT_RIGHT_SQL} AS age_cat_right FROM campaign"))
def _bucketize(spark, sf):
    return T.with_age_categories(campaign(spark, sf)).select("row_id", "age", "age_cat", "age_cat_right")


@register("replace_unknown_with_mode", with_campaign(
    "SELECT row_id, CASE WHEN education = 'unknown' THEN (SELECT education FROM campaign WHERE education <> 'unknown' "
    "GROUP BY education ORDER BY COUNT(*) DESC, education LIMIT 1) ELSE education END AS education FROM campaign"))
def _replace_unknown(spark, sf):
    return T.replace_unknown_with_mode(campaign(spark, sf), "education").select("row_id", "education")


@register("split_sentinel", with_campaign(
    "SELECT row_id, CASE WHEN pdays = -1 THEN 'no' ELSE 'yes' END AS pdays_contact, "
    "CASE WHEN pdays = -1 THEN 0 ELSE pdays END AS pdays_days FROM campaign"))
def _split_sentinel(spark, sf):
    return T.split_sentinel(campaign(spark, sf)).select("row_id", "pdays_contact", "pdays_days")


@register("map_month", with_campaign(f"SELECT row_id, month, {MONTH_NUM_SQL} AS month_num FROM campaign"))
def _map_month(spark, sf):
    return T.with_month_number(campaign(spark, sf), name="month_num").select("row_id", "month", "month_num")


@register("contact_segment", with_campaign(
    "SELECT row_id, previous, CASE WHEN previous = 0 THEN 'non contactés' ELSE 'contactés' END AS \"group\" FROM campaign"))
def _contact_segment(spark, sf):
    return T.with_contact_segment(campaign(spark, sf)).select("row_id", "previous", "group")


@register("format_percent", with_campaign(
    f"SELECT variable, value, deposit, printf('%.2f%%', percent) AS percent_label FROM ({_crosstab_sql(['job', 'marital', 'poutcome'], 'campaign')})"))
def _format_percent(spark, sf):
    ct = stats.crosstab_rate(campaign(spark, sf), ["job", "marital", "poutcome"])
    return ct.select("variable", "value", "deposit", X.format_percent("percent").alias("percent_label"))


# =====================================================================================
# 2.5 window, reshape, sort
# =====================================================================================

SEGMENT_SQL = ("SELECT \"group\", deposit, count, round_even(CAST(count AS DOUBLE) / SUM(count) OVER (PARTITION BY \"group\") "
               "* 100e0 * 100e0, 0) / 100e0 AS percentage FROM (SELECT CASE WHEN previous = 0 THEN 'non contactés' "
               "ELSE 'contactés' END AS \"group\", deposit, COUNT(*) AS count FROM campaign GROUP BY 1, 2)")


@register("segment_share", with_campaign(
    f"SELECT *, CAST(percentage AS VARCHAR) || '%' AS label FROM ({SEGMENT_SQL})"))
def _segment_share(spark, sf):
    return R.segment_share(T.with_contact_segment(campaign(spark, sf)))


@register("pivot_counts", with_campaign(
    "SELECT job, COUNT(*) FILTER (WHERE deposit = 'yes') AS yes, COUNT(*) FILTER (WHERE deposit = 'no') AS no "
    "FROM campaign GROUP BY job"))
def _pivot_counts(spark, sf):
    return R.pivot_counts(campaign(spark, sf), "job", fill=0)


@register("pivot_counts_unfilled", with_campaign(
    "SELECT age, NULLIF(COUNT(*) FILTER (WHERE deposit = 'yes'), 0) AS yes, NULLIF(COUNT(*) FILTER (WHERE deposit = 'no'), 0) AS no "
    "FROM campaign WHERE duration > 3000 GROUP BY age"))
def _pivot_counts_unfilled(spark, sf):
    """A combination that does not occur stays missing."""
    return R.pivot_counts(campaign(spark, sf).where("duration > 3000"), "age")


@register("unpivot_counts", with_campaign(
    "SELECT job, deposit, COUNT(*) AS count FROM campaign GROUP BY job, deposit"))
def _unpivot_counts(spark, sf):
    return R.unpivot_counts(R.pivot_counts(campaign(spark, sf), "job", fill=0), "job")


@register("sort_by", with_campaign("SELECT * FROM campaign ORDER BY balance DESC, row_id"))
def _sort_by(spark, sf):
    return R.sort_by(campaign(spark, sf), ["balance"], ascending=False)


# =====================================================================================
# 2.6 feature engineering
# =====================================================================================

SPLIT_SQL = "(('0x' || substr(md5(CAST(row_id AS VARCHAR) || ':42'), 1, 8))::BIGINT < 1073741824)"

PREP_CTE = (
    f"p AS (SELECT row_id, job, marital, education, \"default\", balance, housing, loan, contact, day, "
    f"{MONTH_NUM_SQL} AS month, duration, campaign, previous, poutcome, deposit, {AGE_CAT_LEFT_SQL} AS age_cat, "
    f"CASE WHEN pdays = -1 THEN 'no' ELSE 'yes' END AS pdays_contact, CASE WHEN pdays = -1 THEN 0 ELSE pdays END AS pdays_days, "
    f"{SPLIT_SQL} AS is_test FROM campaign), "
    "tr AS (SELECT * FROM p WHERE NOT is_test), "
    "md AS (SELECT education AS m FROM tr WHERE education <> 'unknown' GROUP BY education ORDER BY COUNT(*) DESC, education LIMIT 1)")

# categories of the fixture (one per value of the warehouse columns it derives from)
FIXTURE_CATEGORIES = {
    "job": ["automobile", "building", "furniture", "household", "machinery"],
    "marital": ["divorced", "married", "single"],
    "contact": ["cellular", "telephone", "unknown"],
    "poutcome": ["failure", "other", "success", "unknown"],
}
ROBUST_COLS = list(S.NUMERIC_FEATURES)


def _robust_cte(cols=ROBUST_COLS, src="tr") -> str:
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.5) AS {c}_b, quantile_cont({c}, 0.75) AS {c}_c"
                   for c in cols)
    return f"rq AS (SELECT {qs} FROM {src})"


def _robust_sql(c: str) -> str:
    return (f"CASE WHEN {c}_c - {c}_a = 0 THEN CAST({c} AS DOUBLE) - {c}_b "
            f"ELSE (CAST({c} AS DOUBLE) - {c}_b) / ({c}_c - {c}_a) END AS {c}")


def _standard_cte(cols, src="tr") -> str:
    parts = ", ".join(
        f"CAST(SUM({c}) AS DOUBLE) / CAST(COUNT({c}) AS DOUBLE) AS {c}_m, "
        f"SQRT(CAST(COUNT({c}) * SUM(CAST({c} AS HUGEINT) * {c}) - SUM({c}) * SUM({c}) AS DOUBLE) "
        f"/ (CAST(COUNT({c}) AS DOUBLE) * CAST(COUNT({c}) AS DOUBLE))) AS {c}_s" for c in cols)
    return f"sq AS (SELECT {parts} FROM {src})"


def _standard_sql(c: str) -> str:
    return (f"CASE WHEN {c}_s = 0 THEN CAST({c} AS DOUBLE) - {c}_m "
            f"ELSE (CAST({c} AS DOUBLE) - {c}_m) / {c}_s END AS {c}")


BINARY_SQL = [f"CASE {q(c)} WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 END AS {q(c)}" for c in S.BINARY_FEATURES]
ONEHOT_SQL = [f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END AS {c}_{v}" for c, vs in FIXTURE_CATEGORIES.items() for v in vs]
EDU_SQL = ("CAST(CASE COALESCE(CASE WHEN education = 'unknown' THEN md.m ELSE education END, '') "
           "WHEN 'primary' THEN 0 WHEN 'secondary' THEN 1 WHEN 'tertiary' THEN 2 END AS DOUBLE) AS education")
AGECAT_ORD_SQL = ("CAST(CASE age_cat " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(S.AGE_LABELS))
                  + " END AS DOUBLE) AS age_cat")
TWO_PI = "(2 * PI())"
CYCLIC_SQL = [f"SIN({TWO_PI} * day / 31e0) AS day_sin", f"COS({TWO_PI} * day / 31e0) AS day_cos",
              f"SIN({TWO_PI} * month / 12e0) AS month_sin", f"COS({TWO_PI} * month / 12e0) AS month_cos"]
LABEL_SQL = "CASE deposit WHEN 'no' THEN 0.0 WHEN 'yes' THEN 1.0 END AS label"


def _prepared(spark, sf, options=None):
    return PP.preprocess(campaign(spark, sf), options)


def _state_key(spark, sf) -> tuple:
    """Names fitted state by application and by the input files as they are now."""
    return spark.sparkContext.applicationId, _key(sf)


_ENCODINGS: dict[tuple, FE.Encoding] = {}
_ENC_LOCK = threading.RLock()


def _encoding(spark, sf, preset: int = 2) -> FE.Encoding:
    """The fitted state of a preset, fitted once per session and input."""
    key = (*_state_key(spark, sf), preset)
    with _ENC_LOCK:
        if key not in _ENCODINGS:
            prep = _prepared(spark, sf, FE.PRESETS[preset])
            _ENCODINGS[key] = FE.fit_encoding(prep.where(~F.col("is_test")), FE.PRESETS[preset])
        return _ENCODINGS[key]


@register("train_test_split", with_campaign(f"SELECT row_id, {SPLIT_SQL} AS is_test FROM campaign"))
def _train_test_split(spark, sf):
    return FE.train_test_split(campaign(spark, sf)).select("row_id", "is_test")


@register("train_test_split_exact", with_campaign(
    "SELECT row_id, row_number() OVER (ORDER BY ('0x' || substr(md5(CAST(row_id AS VARCHAR) || ':42'), 1, 8))::BIGINT, row_id) "
    "<= (SELECT ceil(count(*) * 0.25) FROM campaign) AS is_test FROM campaign"))
def _train_test_split_exact(spark, sf):
    """Exactly a quarter of the rows, rounded up."""
    return FE.train_test_split(campaign(spark, sf), exact=True).select("row_id", "is_test")


@register("encode_binary", with_campaign(f"SELECT row_id, {', '.join(BINARY_SQL)} FROM p", PREP_CTE))
def _encode_binary(spark, sf):
    return _prepared(spark, sf).select("row_id", *FE.encode_binary())


@register("encode_onehot", with_campaign(f"SELECT row_id, {', '.join(ONEHOT_SQL)} FROM p", PREP_CTE))
def _encode_onehot(spark, sf):
    prep = _prepared(spark, sf)
    return prep.select("row_id", *FE.encode_onehot(_encoding(spark, sf).categories))


@register("encode_onehot_sparse", with_campaign(
    "SELECT row_id, ((SELECT count(*) FROM cat_job) + (SELECT count(*) FROM cat_balance))::INT AS size, "
    "concat_ws(',', j.i, b.i + (SELECT count(*) FROM cat_job)) AS indices "
    "FROM campaign c LEFT JOIN cat_job j ON j.v = c.job LEFT JOIN cat_balance b ON b.v = c.balance::VARCHAR",
    *[f"cat_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM campaign WHERE NOT {SPLIT_SQL}))"
      for c in ("job", "balance")]))
def _encode_onehot_sparse(spark, sf):
    """Two columns' categories in one sparse vector, the balance taken as a category of thousands of values."""
    contacts = FE.train_test_split(campaign(spark, sf))
    found = SP.onehot_indices(contacts, SP.fit_all(contacts.where(~F.col("is_test")), ["job", "balance"]))
    return found.select("row_id", "size", F.concat_ws(",", F.col("indices").cast("array<string>")).alias("indices"))


@register("encode_ordinal", with_campaign(f"SELECT row_id, {EDU_SQL}, {AGECAT_ORD_SQL} FROM p, md", PREP_CTE))
def _encode_ordinal(spark, sf):
    prep = _prepared(spark, sf)
    prep = T.replace_unknown_with_mode(prep, "education", fit=prep.where(~F.col("is_test")))
    return prep.select("row_id", FE.encode_ordinal("education", S.EDUCATION_ORDER),
                       FE.encode_ordinal("age_cat", S.AGE_LABELS))


@register("encode_cyclic", with_campaign(f"SELECT row_id, {', '.join(CYCLIC_SQL)} FROM p", PREP_CTE))
def _encode_cyclic(spark, sf):
    return _prepared(spark, sf).select("row_id", *FE.encode_cyclic("day", 31), *FE.encode_cyclic("month", 12))


@register("scale_robust", with_campaign(
    f"SELECT row_id, {', '.join(_robust_sql(c) for c in ROBUST_COLS)} FROM p, rq", PREP_CTE, _robust_cte()))
def _scale_robust(spark, sf):
    enc = _encoding(spark, sf)
    return _prepared(spark, sf).select("row_id", *[FE.scale(c, *enc.numeric[c]) for c in ROBUST_COLS])


@register("scale_standard", with_campaign(
    f"SELECT row_id, {', '.join(_standard_sql(c) for c in ROBUST_COLS)} FROM p, sq", PREP_CTE, _standard_cte(ROBUST_COLS)))
def _scale_standard(spark, sf):
    enc = _encoding(spark, sf, 3)
    return _prepared(spark, sf).select("row_id", *[FE.scale(c, *enc.numeric[c]) for c in ROBUST_COLS])


@register("encode_label", with_campaign(f"SELECT row_id, {LABEL_SQL} FROM p", PREP_CTE))
def _encode_label(spark, sf):
    return _prepared(spark, sf).select("row_id", FE.encode_label("deposit", _encoding(spark, sf).label_classes))


@register("preprocess", with_campaign("SELECT * FROM p", PREP_CTE))
def _preprocess(spark, sf):
    return _prepared(spark, sf)


ENCODED_SQL = with_campaign(
    f"SELECT row_id, is_test, {LABEL_SQL}, {', '.join(BINARY_SQL)}, {', '.join(ONEHOT_SQL)}, {EDU_SQL}, {AGECAT_ORD_SQL}, "
    f"{', '.join(CYCLIC_SQL)}, {', '.join(_robust_sql(c) for c in ROBUST_COLS)} FROM p, md, rq",
    PREP_CTE, _robust_cte())


@register("preprocess_and_transform", ENCODED_SQL)
def _preprocess_and_transform(spark, sf):
    return PP.preprocess_and_transform(campaign(spark, sf))[0]


def _variant_sql(v: int) -> str:
    o = FE.PRESETS[v]
    g = FE.feature_groups(o)
    binary = [b for c, b in zip(S.BINARY_FEATURES, BINARY_SQL) if c in g["binary"]]
    ordinal = [EDU_SQL] + ([AGECAT_ORD_SQL] if o.bin_age else [])
    num = g["numeric"]
    if o.scaler == "robust":
        scaled, cte = [_robust_sql(c) for c in num], _robust_cte(num)
        src = "p, md, rq"
    else:
        scaled, cte = [_standard_sql(c) for c in num], _standard_cte(num)
        src = "p, md, sq"
    prep = PREP_CTE.replace(" pdays_days, ", " pdays_days, pdays, age, ")
    return with_campaign(
        f"SELECT row_id, is_test, {LABEL_SQL}, {', '.join(binary)}, {', '.join(ONEHOT_SQL)}, {', '.join(ordinal)}, "
        f"{', '.join(CYCLIC_SQL)}, {', '.join(scaled)} FROM {src}", prep, cte)


@register("pipeline_variants", _variant_sql(1))
def _pipeline_variant_1(spark, sf):
    return PP.preprocess_and_transform(campaign(spark, sf), FE.PRESETS[1])[0]


@register("pipeline_variant_3", _variant_sql(3))
def _pipeline_variant_3(spark, sf):
    return PP.preprocess_and_transform(campaign(spark, sf), FE.PRESETS[3])[0]


@register("pipeline_variant_4", _variant_sql(4))
def _pipeline_variant_4(spark, sf):
    return PP.preprocess_and_transform(campaign(spark, sf), FE.PRESETS[4])[0]


# =====================================================================================
# 2.7 evaluation with a fixed-rule predictor (exact in SQL)
# =====================================================================================

RULES = {"long_call": "duration > 1900", "long_or_success": "duration > 1500 OR poutcome = 'success'",
         "no_housing": "housing = 'no'"}


def _rule_pred(spark, sf, rule: str = "long_call"):
    df = FE.train_test_split(campaign(spark, sf)).where(F.col("is_test"))
    return EV.rule_predictions(df, F.expr(RULES[rule]), F.col("deposit") == "yes")


def _pred_cte(rule: str = "long_call", name: str = "pr") -> str:
    return (f"{name} AS (SELECT row_id, CASE WHEN deposit = 'yes' THEN 1.0 ELSE 0.0 END AS label, "
            f"CASE WHEN COALESCE({RULES[rule]}, false) THEN 1.0 ELSE 0.0 END AS prediction "
            f"FROM campaign WHERE {SPLIT_SQL})")


def _metrics_sql(src: str = "pr") -> str:
    r = "COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"
    return (f"SELECT tp, fp, fn, tn, {r.format(a='tp + tn', b='tp + fp + fn + tn')} AS accuracy, "
            f"{r.format(a='tp', b='tp + fp')} AS precision, {r.format(a='tp', b='tp + fn')} AS recall, "
            f"{r.format(a='2 * tp', b='2 * tp + fp + fn')} AS f1 FROM ("
            f"SELECT COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, "
            f"COUNT(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp, "
            f"COUNT(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn, "
            f"COUNT(*) FILTER (WHERE label <> 1 AND prediction <> 1) AS tn FROM {src})")


@register("binary_metrics", with_campaign(_metrics_sql(), _pred_cte()))
def _binary_metrics(spark, sf):
    return EV.binary_metrics(_rule_pred(spark, sf))


@register("confusion_matrix", with_campaign(
    "SELECT g.actual, g.predicted, COALESCE(c.count, 0) AS count FROM "
    "(SELECT a.v AS actual, b.v AS predicted FROM (VALUES (0.0), (1.0)) a(v), (VALUES (0.0), (1.0)) b(v)) g "
    "LEFT JOIN (SELECT label AS actual, prediction AS predicted, COUNT(*) AS count FROM pr GROUP BY 1, 2) c "
    "USING (actual, predicted)", _pred_cte()))
def _confusion_matrix(spark, sf):
    return EV.confusion_matrix(_rule_pred(spark, sf))


def _report_sql() -> str:
    r = "COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"
    per = []
    for i, c in enumerate(("0", "1")):
        pr_, rc_ = r.format(a=f"tp{i}", b=f"pp{i}"), r.format(a=f"tp{i}", b=f"sup{i}")
        per.append((c, pr_, rc_, r.format(a=f"2 * {pr_} * {rc_}", b=f"{pr_} + {rc_}"), f"sup{i}"))
    rows = [f"SELECT '{c}' AS class, {p_} AS precision, {r_} AS recall, {f_} AS f1_score, {s_} AS support FROM cells"
            for c, p_, r_, f_, s_ in per]
    rows.append(f"SELECT 'accuracy', NULL::DOUBLE, NULL::DOUBLE, {r.format(a='hits', b='n')}, n FROM cells")
    rows.append(f"SELECT 'macro avg', (0.0 + {per[0][1]} + {per[1][1]}) / 2e0, (0.0 + {per[0][2]} + {per[1][2]}) / 2e0, "
                f"(0.0 + {per[0][3]} + {per[1][3]}) / 2e0, n FROM cells")
    rows.append(f"SELECT 'weighted avg', (0.0 + {per[0][1]} * sup0 + {per[1][1]} * sup1) / CAST(n AS DOUBLE), "
                f"(0.0 + {per[0][2]} * sup0 + {per[1][2]} * sup1) / CAST(n AS DOUBLE), "
                f"(0.0 + {per[0][3]} * sup0 + {per[1][3]} * sup1) / CAST(n AS DOUBLE), n FROM cells")
    cells = ("cells AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE label = prediction) AS hits, "
             + ", ".join(f"COUNT(*) FILTER (WHERE label = {c} AND prediction = {c}) AS tp{i}, "
                         f"COUNT(*) FILTER (WHERE prediction = {c}) AS pp{i}, COUNT(*) FILTER (WHERE label = {c}) AS sup{i}"
                         for i, c in enumerate(("0.0", "1.0"))) + " FROM pr)")
    return with_campaign(" UNION ALL ".join(rows), _pred_cte(), cells)


@register("classification_report", _report_sql())
def _classification_report(spark, sf):
    return EV.classification_report(_rule_pred(spark, sf))


def _compare_sql() -> str:
    ctes = [_pred_cte(r, f"pr_{r}") for r in RULES]
    parts = []
    for r in RULES:
        for m in ("accuracy", "precision", "recall", "f1"):
            parts.append(f"SELECT '{r}' AS model, '{m}' AS metric, round_even({m} * 1000e0, 0) / 1000e0 AS value "
                         f"FROM ({_metrics_sql(f'pr_{r}')})")
    return with_campaign(" UNION ALL ".join(parts), *ctes)


@register("compare_models", _compare_sql())
def _compare_models(spark, sf):
    df = FE.train_test_split(campaign(spark, sf)).where(F.col("is_test"))
    preds = EV.rules_predictions(df, {r: F.expr(e) for r, e in RULES.items()}, F.col("deposit") == "yes")
    return EV.compare_models(EV.binary_metrics(preds, by=["model"]))


# =====================================================================================
# 2.1 persistence and 2.7 models (rows-only checks: trained models have no SQL form)
# =====================================================================================

from contactlens.operators import models as M  # noqa: E402

_FIT_LOCK = threading.RLock()

_FITTED: dict[tuple, object] = {}
_FITTING: dict[tuple, threading.RLock] = {}


_ENCODED: dict[tuple, object] = {}
_ENCODED_STATE: dict[tuple, FE.Encoding] = {}


def encoded_table(spark, sf, with_duration: bool = False):
    """Encoded contacts (preset 2); the final models leave ``duration`` out.

    The fit (one small Spark job) runs once per session and input; the
    result is a lazy plan over the written contact table with literal
    parameters, so reusing it reuses no data.
    """
    key = _state_key(spark, sf)
    with _FIT_LOCK:
        if key not in _ENCODED:
            _ENCODED[key], _ENCODED_STATE[key] = PP.preprocess_and_transform(campaign(spark, sf))
    enc = _ENCODED[key]
    return enc if with_duration else PP.remove_duration(enc)


def fitted(spark, sf, preset: str, with_duration: bool = False):
    """One fit per (session, input, preset) in this process; later queries reuse it."""
    return _fitted_once((*_state_key(spark, sf), preset, with_duration), lambda: encoded_table(spark, sf, with_duration))


def _fitted_once(key: tuple, encoded: Callable[[], DataFrame]):
    with _FIT_LOCK:
        own = _FITTING.setdefault(key, threading.RLock())
    with own:
        if key not in _FITTED:
            _FITTED[key] = M.train_preset(encoded(), key[-2])
        return _FITTED[key]


def fitted_all(spark, sf) -> dict[str, object]:
    """The three presets' models, fitted at the same time: one fit alone leaves cores idle (few blocks, the driver's work between jobs)."""
    state, encoded = _state_key(spark, sf), encoded_table(spark, sf)
    with ThreadPoolExecutor(max_workers=len(PRESET_MODELS)) as pool:
        models = pool.map(lambda m: _fitted_once((*state, m, False), lambda: encoded), PRESET_MODELS)
        return dict(zip(PRESET_MODELS, models, strict=True))


def _metrics_of(spark, sf, preset: str, with_duration: bool = False):
    m = fitted(spark, sf, preset, with_duration)
    return M.evaluate_model(m, encoded_table(spark, sf, with_duration)).select(F.lit(preset).alias("model"), "*")


@register("train_random_forest")
def _train_random_forest(spark, sf):
    return _metrics_of(spark, sf, "random_forest")


@register("train_gbt_depthwise")
def _train_gbt_depthwise(spark, sf):
    return _metrics_of(spark, sf, "gbt_depthwise")


@register("train_gbt_leafwise")
def _train_gbt_leafwise(spark, sf):
    return _metrics_of(spark, sf, "gbt_leafwise")


PRESET_MODELS = ("random_forest", "gbt_depthwise", "gbt_leafwise")


def contact_model(spark, sf, preset: str = "random_forest"):
    """The preset's classifier behind the fitted encoding: from raw contacts to scores."""
    model = fitted(spark, sf, preset)
    return M.contact_model(_ENCODED_STATE[_state_key(spark, sf)], model)


@register("score_batch")
def _score_batch(spark, sf):
    return M.score_batch(contact_model(spark, sf), _test_contacts(spark, sf))


def _test_contacts(spark, sf):
    """The raw contacts of the test part."""
    return FE.train_test_split(campaign(spark, sf)).where(F.col("is_test")).drop("is_test")


@register("score_raw_contacts", with_campaign(f"SELECT row_id, true AS same FROM campaign WHERE {SPLIT_SQL}"))
def _score_raw_contacts(spark, sf):
    """A raw contact's score equals that of its encoded row."""
    encoded = M.score_batch(fitted(spark, sf, "random_forest"), encoded_table(spark, sf).where(F.col("is_test")))
    return _same_scores(M.score_batch(contact_model(spark, sf), _test_contacts(spark, sf)), encoded)


def _same_scores(a, b):
    b = b.select("row_id", F.col("probability").alias("p2"), F.col("prediction").alias("c2"))
    same = F.col("probability").eqNullSafe(F.col("p2")) & F.col("prediction").eqNullSafe(F.col("c2"))
    return a.join(b, "row_id").select("row_id", same.alias("same"))


@register("feature_importances")
def _feature_importances(spark, sf):
    """Three definitions for each of the three models."""
    models = fitted_all(spark, sf)
    nodes = {m: M.model_nodes(model) for m, model in models.items()}
    parts = [M.feature_importances(models[m], kind, table).select(F.lit(m).alias("model"), F.lit(kind).alias("kind"), "*")
             for m, table in nodes.items() for kind in M.IMPORTANCES]
    return functools.reduce(lambda x, y: x.unionByName(y), parts)


@register("compare_trained_models")
def _compare_trained_models(spark, sf):
    """The comparison table of the three trained models."""
    return EV.compare_models({m: M.evaluate_model(model, encoded_table(spark, sf)) for m, model in fitted_all(spark, sf).items()})


@register("feature_ablation")
def _feature_ablation(spark, sf):
    return (_metrics_of(spark, sf, "random_forest", True).withColumn("features", F.lit("with duration"))
            .unionByName(_metrics_of(spark, sf, "random_forest", False).withColumn("features", F.lit("without duration"))))


def _model_path(spark, sf, preset: str) -> str:
    return f"{scratch_dir(spark)}/contactlens/models/{preset}-{_key(sf)}"


@register("save_model")
def _save_model(spark, sf):
    path = M.save_model(contact_model(spark, sf), _model_path(spark, sf, "random_forest"))
    # the saved stage metadata, read back from the written folder
    return (spark.read.json(f"{path}/stages/*/metadata")
            .select(F.col("class").alias("stage_class"), F.col("uid").alias("stage_uid"), "sparkVersion"))


@register("load_model", with_campaign(f"SELECT row_id, true AS same FROM campaign WHERE {SPLIT_SQL}"))
def _load_model(spark, sf):
    """A loaded model scores raw contacts as written down before it was saved."""
    missing = M.load_model(f"{scratch_dir(spark)}/contactlens/models/does-not-exist")
    if missing is not None:
        raise AssertionError("a missing model must load as None")
    path = f"{_model_path(spark, sf, 'random_forest')}-{uuid.uuid4().hex[:12]}"
    test = _test_contacts(spark, sf)
    M.score_batch(contact_model(spark, sf), test).write.parquet(f"{path}-scores")
    model = M.load_model(M.save_model(contact_model(spark, sf), path))
    return _same_scores(M.score_batch(model, test), spark.read.parquet(f"{path}-scores"))


@register("model_bakeoff")
def _model_bakeoff(spark, sf):
    return M.model_bakeoff(encoded_table(spark, sf)).drop("fit_seconds")


#: the points of the search: the source's winner of each family, and a smaller neighbour
SEARCH_POINTS = [
    ("random_forest", {"numTrees": 100, "maxDepth": 10}), ("random_forest", {"numTrees": 50, "maxDepth": 5}),
    ("gbt_depthwise", {"trees": 300, "max_depth": 7}), ("gbt_depthwise", {"trees": 100, "max_depth": 7}),
    ("gbt_leafwise", {"trees": 200, "max_leaves": 31}), ("gbt_leafwise", {"trees": 100, "max_leaves": 31}),
]


@register("grid_search")
def _grid_search(spark, sf):
    """Every point is cross-validated on all training rows; none goes by a sample."""
    return M.search(encoded_table(spark, sf), SEARCH_POINTS, folds=2, shares=(1.0,), parallelism=4)[1]
