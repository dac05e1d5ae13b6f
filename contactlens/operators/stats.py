"""Aggregations over the contact table (how attributes relate to the outcome).

Every report is one scan: multi-column reports ``unpivot`` first (an Expand,
no shuffle) and aggregate once with partial (map-side) aggregation, so the
shuffle carries one row per (variable, value) per task. Quantiles go through
value counts (``contactlens.functions.quantiles``). Shares use one more
aggregate over the already aggregated rows, never an
un-partitioned window over raw rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlens.functions import expressions as X
from contactlens.functions.quantiles import continuous, value_counts
from contactlens.functions.selection import select_quantiles
from contactlens.sources import schema as S


def _long(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (),
          cast: str | None = None) -> DataFrame:
    """``(ids..., variable, value)`` for the listed columns (one Expand, no shuffle)."""
    cols = [X.col(c).cast(cast).alias(c) if cast else X.col(c) for c in columns]
    return df.select(*[X.col(i) for i in ids], *cols).unpivot(
        list(ids), list(columns), "variable", "value")


# -- conditional aggregates -------------------------------------------------

def with_rounded(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Adds ``<c>_rounded`` (pandas half-even rounding, as the values are displayed)."""
    return df.select("*", *[X.round_half_even(c, digits).alias(f"{c}_rounded") for c in columns])


def mean_by_target(df: DataFrame, column: str, target: str = S.TARGET) -> DataFrame:
    """Mean of ``column`` over all rows, the positive rows and the negative rows (+ rounded)."""
    t, x = X.col(target), X.col(column)
    out = df.agg(
        F.avg(x).alias("mean_all"),
        F.avg(F.when(t == S.POSITIVE, x)).alias("mean_yes"),
        F.avg(F.when(t == S.NEGATIVE, x)).alias("mean_no"),
    )
    return with_rounded(out, ["mean_all", "mean_yes", "mean_no"])


def median_by_target(df: DataFrame, value, target: str = S.TARGET, exact: bool = True,
                     accuracy: int = 10000) -> DataFrame:
    """Medians (all / yes / no): exact from the (target, value) count table, or sketches."""
    if not exact:
        v = F.col(value) if isinstance(value, str) else value
        t = X.col(target)
        return df.agg(
            F.percentile_approx(v, 0.5, accuracy).cast("double").alias("median_all"),
            F.percentile_approx(F.when(t == S.POSITIVE, v), 0.5, accuracy).cast("double").alias("median_yes"),
            F.percentile_approx(F.when(t == S.NEGATIVE, v), 0.5, accuracy).cast("double").alias("median_no"))
    v = F.col(value) if isinstance(value, str) else value
    pairs = df.select(X.col(target).alias(target), v.alias("value"))
    if continuous(pairs, ["value"], [target]):
        own = F.when(F.col(target).isin(S.POSITIVE, S.NEGATIVE), F.array(F.lit("all"), F.col(target))).otherwise(F.array(F.lit("all")))
        found = select_quantiles(pairs.select(F.explode(own).alias("part"), "value"), "value", [0.5], ["part"], ["m"])
        one = lambda part, name: F.max(F.when(F.col("part") == part, F.col("m"))).alias(name)
        return found.agg(one("all", "median_all"), one(S.POSITIVE, "median_yes"), one(S.NEGATIVE, "median_no"))
    vc = value_counts(df, value, [target])
    t = F.col(target)
    med = lambda v: F.percentile(v, F.lit(0.5), F.col("cnt")).cast("double")
    return vc.agg(
        med(F.col("value")).alias("median_all"),
        med(F.when(t == S.POSITIVE, F.col("value"))).alias("median_yes"),
        med(F.when(t == S.NEGATIVE, F.col("value"))).alias("median_no"),
    )


def median_duration_by_target(df: DataFrame, target: str = S.TARGET, exact: bool = True) -> DataFrame:
    out = median_by_target(df, X.duration_minutes("duration"), target, exact)
    return with_rounded(out, ["median_all", "median_yes", "median_no"])


def check_implication(df: DataFrame, premise, conclusion) -> DataFrame:
    """Does ``premise`` imply ``conclusion`` on every row? True on an empty premise set."""
    return (df.where(premise)
            .agg(F.coalesce(F.bool_and(F.coalesce(conclusion, F.lit(False))), F.lit(True))
                 .alias("holds")))


def pdays_implies_no_previous(df: DataFrame) -> DataFrame:
    return check_implication(df, F.col("pdays") == -1, F.col("previous") == 0)


# -- distributions ------------------------------------------------------------

def target_distribution(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Count and share of each target value (the pie)."""
    counts = df.groupBy(X.col(target).alias(target)).agg(F.count(F.lit(1)).alias("count"))
    # one row per target value: gather them with their total, then spread out again
    cells = counts.agg(F.collect_list(F.struct(target, "count")).alias("cells"), F.sum("count").alias("total"))
    return (cells.select(F.explode("cells").alias("c"), "total")
            .select(F.col(f"c.{target}").alias(target), F.col("c.count").alias("count"),
                    (F.col("c.count") / F.col("total")).alias("share")))


def categorical_distribution(df: DataFrame, columns: Sequence[str] = S.CATEGORICAL_COLUMNS) -> DataFrame:
    """Value counts of several columns in one scan: ``(variable, value, count)``."""
    return (_long(df, columns, cast="string").where(F.col("value").isNotNull())
            .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("count")))


def numeric_histogram(df: DataFrame, columns: Sequence[str] = S.HISTOGRAM_COLUMNS,
                      n_bins: int = 20) -> DataFrame:
    """Equal-width histogram per column: ``(variable, bin, bin_lo, bin_hi, count)``.

    Bin ``i`` covers ``[min + i*w, min + (i+1)*w)`` with ``w = (max-min)/n_bins``;
    the maximum falls in the last bin. One scan: rows are counted per
    (column, value) first, so later steps see distinct values only.
    """
    vc = (_long(df, columns, cast="double").where(F.col("value").isNotNull())
          .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("cnt")))
    # range per column as window aggregates over its distinct values (one scan in all)
    wv = Window.partitionBy("variable")
    vc = vc.withColumn("lo", F.min("value").over(wv)).withColumn("hi", F.max("value").over(wv))
    w = (F.col("hi") - F.col("lo")).cast("double") / F.lit(float(n_bins))
    b = F.coalesce(F.least(F.floor(F.try_divide((F.col("value") - F.col("lo")).cast("double"), w)),
                           F.lit(n_bins - 1)), F.lit(0)).cast("int")
    binned = vc.select("variable", b.alias("bin"), "lo", w.alias("w"), "cnt")
    return (binned.groupBy("variable", "bin").agg(F.sum("cnt").alias("count"),
                                                  F.first("lo").alias("lo"), F.first("w").alias("w"))
            .select("variable", "bin",
                    (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_hi"),
                    "count"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] = S.CORRELATION_COLUMNS,
                       digits: int | None = None) -> DataFrame:
    """Pearson correlations in long form ``(var_x, var_y, corr)``, pairwise NULL skipping.

    One aggregate computes the upper triangle (fixed-size buffers, partial
    aggregation); the lower triangle is its mirror.
    """
    if "deposit_num" in columns and "deposit_num" not in df.columns:
        df = df.withColumn("deposit_num", X.target_flag())
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    aggs = [F.corr(X.col(a).cast("double"), X.col(b).cast("double")).alias(f"c{i}")
            for i, (a, b) in enumerate(pairs)]
    row = df.agg(*aggs)
    entries = []
    for i, (a, b) in enumerate(pairs):
        entries.append(F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), F.col(f"c{i}").alias("corr")))
        if a != b:
            entries.append(F.struct(F.lit(b).alias("var_x"), F.lit(a).alias("var_y"), F.col(f"c{i}").alias("corr")))
    out = row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    if digits is not None:
        out = out.withColumn("corr", F.round("corr", digits))
    return out


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Row count per key combination."""
    return df.groupBy(*[X.col(k).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"))


# -- cross tables -------------------------------------------------------------

def crosstab_rate(df: DataFrame, dims: Sequence[str], target: str = S.TARGET,
                  values: Sequence[str] = tuple(S.TARGET_VALUES),
                  levels: Mapping[str, Sequence[str]] | None = None,
                  fill_missing: bool = True) -> DataFrame:
    """Per dimension value: count of each target value, total and percent, long form.

    Output ``(variable, value, deposit, count, total, percent)`` (the target
    column keeps its name). All dimensions share one scan. Missing
    (value, target) cells count 0 (percent 0); with ``fill_missing=False``
    they are NULL, as an unfilled pandas ``unstack``. ``levels`` lists the
    categories of a binned dimension so empty bins appear with count 0 and
    NULL percent. Rows whose dimension value is NULL are left out.
    """
    long = _long(df, dims, ids=[target], cast="string").where(F.col("value").isNotNull())
    counts = long.groupBy("variable", "value").agg(
        *[F.count_if(F.col(target) == F.lit(v)).alias(f"n{i}") for i, v in enumerate(values)])
    if levels:
        # one outer join with the listed levels (a small literal table): empty bins appear
        lv = df.sparkSession.createDataFrame([(d, v) for d, vs in levels.items() for v in vs],
                                             "variable string, value string")
        counts = (counts.join(lv, ["variable", "value"], "full_outer")
                  .fillna(0, [f"n{i}" for i in range(len(values))]))
    total = sum((F.col(f"n{i}") for i in range(1, len(values))), F.col("n0"))
    cells = F.array(*[F.struct(F.lit(v).alias(target), F.col(f"n{i}").alias("count"))
                      for i, v in enumerate(values)])
    out = counts.select("variable", "value", total.alias("total"), F.explode(cells).alias("c")) \
        .select("variable", "value", F.col(f"c.{target}").alias(target), F.col("c.count").alias("count"),
                "total")
    if not fill_missing:
        out = out.withColumn("count", F.when(F.col("count") > 0, F.col("count")))
    return out.withColumn("percent", X.percent(F.col("count"), F.col("total")))


def category_order(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Categories by descending row count (ties by value): ``(variable, value, count, rank)``."""
    counts = categorical_distribution(df, dims)
    w = Window.partitionBy("variable").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w))


def count_by_month_target(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Count per (month, target) with the month's frequency rank for display order.

    One scan: the (month, target) counts carry their month total (a window
    partitioned by month over aggregated rows); the rank comes from sorting
    the at most 12 (total, month) pairs gathered in one more aggregate.
    """
    counts = (count_by(df, "month", target)
              .withColumn("mt", F.sum("count").over(Window.partitionBy("month"))))
    key = F.struct((-F.col("mt")).alias("neg_total"), F.col("month").alias("month"))
    g = counts.agg(F.collect_list(F.struct("month", target, "count", key.alias("k"))).alias("cells"),
                   F.array_sort(F.collect_set(key)).alias("order"))
    c = F.col("c")
    return (g.select(F.explode("cells").alias("c"), "order")
            .select(c["month"].alias("month"), c[target].alias(target), c["count"].alias("count"),
                    F.array_position("order", c["k"]).cast("int").alias("month_rank")))


def monthly_campaign(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Per month: total contacts (sum of ``campaign``), yes count, no count; calendar number."""
    t = X.col(target)
    return (df.groupBy("month").agg(
        F.sum("campaign").cast("bigint").alias("campaign_count"),
        F.count_if(t == S.POSITIVE).alias("deposit_yes_count"),
        F.count_if(t == S.NEGATIVE).alias("deposit_no_count"))
        .withColumn("month_num", X.map_month("month")))


# -- box plots ---------------------------------------------------------------

BOX_COLUMNS = ["age", "balance", "duration", "pdays"]


def _box_long(df: DataFrame, columns: Sequence[str], target: str, ids: Sequence[str] = ()) -> DataFrame:
    long = _long(df, columns, ids=[*ids, target], cast="double").where(F.col("value").isNotNull())
    # the pdays box leaves out the "never contacted" sentinel
    return long.where(~((F.col("variable") == "pdays") & (F.col("value") == -1)))


def box_summary(df: DataFrame, columns: Sequence[str] = BOX_COLUMNS,
                target: str = S.TARGET, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Five-number summary, 1.5 IQR fences, whiskers and outlier count per (variable, target).

    One scan: the rows become a (variable, target, value) count table; the
    quartiles are window aggregates over that table partitioned by
    (variable, target), so every count row sees its group's fences, and one
    grouped aggregate finishes whiskers and outlier counts. No step holds
    more than the distinct values of one column for one target value.
    ``exact=False`` takes the quartiles from ``percentile_approx`` sketches
    over the rows (one row per (variable, target), joined back by broadcast).
    """
    long = _box_long(df, columns, target)
    if exact and continuous(df, columns, [target]):
        quartiles = select_quantiles(long, "value", [0.25, 0.5, 0.75], ["variable", target], ["_a", "_b", "_c"])
        qs = quartiles.select(F.col("variable").alias("_v"), F.col(target).alias("_t"), F.array("_a", "_b", "_c").alias("q"))
        vcq = (long.select("variable", target, "value", F.lit(1).alias("cnt"))
               .join(qs, (F.col("variable") == F.col("_v")) & F.col(target).eqNullSafe(F.col("_t"))).drop("_v", "_t"))
        return _boxes(vcq, target)
    vc = long.groupBy("variable", target, "value").agg(F.count(F.lit(1)).alias("cnt"))
    if exact:
        w = Window.partitionBy("variable", target)
        q = F.percentile(F.col("value"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("cnt")).over(w)
        vcq = vc.withColumn("q", q)
    else:
        qs = long.groupBy("variable", target).agg(
            F.percentile_approx("value", [0.25, 0.5, 0.75], accuracy).cast("array<double>").alias("q"))
        vcq = vc.join(F.broadcast(qs), ["variable", target])
    return _boxes(vcq, target)


def _boxes(vcq: DataFrame, target: str) -> DataFrame:
    """The boxes from rows ``(variable, target, value, cnt, q)``."""
    fenced = (vcq
              .withColumn("lower_fence", F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0]))
              .withColumn("upper_fence", F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])))
    inside = (F.col("value") >= F.col("lower_fence")) & (F.col("value") <= F.col("upper_fence"))
    return (fenced.groupBy("variable", target).agg(
        F.sum("cnt").alias("n"), F.min("value").cast("double").alias("min"),
        F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("median"),
        F.first(F.col("q")[2]).alias("q3"), F.max("value").cast("double").alias("max"),
        F.first("lower_fence").alias("lower_fence"), F.first("upper_fence").alias("upper_fence"),
        F.min(F.when(inside, F.col("value"))).cast("double").alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).cast("double").alias("whisker_hi"),
        F.coalesce(F.sum(F.when(~inside, F.col("cnt"))), F.lit(0)).cast("bigint").alias("n_outliers")))


def outlier_rows(df: DataFrame, columns: Sequence[str] = BOX_COLUMNS, target: str = S.TARGET) -> DataFrame:
    """Rows outside the 1.5 IQR fences of their (variable, target) box: ``(row_id, variable, target, value)``.

    The fence table has one row per (variable, target value): broadcast is
    bounded by the column list times the number of target values.
    """
    fences = box_summary(df, columns, target).select("variable", target, "lower_fence", "upper_fence")
    long = _box_long(df, columns, target, ["row_id"])
    return (long.join(F.broadcast(fences), ["variable", target])
            .where((F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence")))
            .drop("lower_fence", "upper_fence"))
