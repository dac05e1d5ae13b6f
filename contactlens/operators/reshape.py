"""Shares inside groups, pivot / unpivot and total orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlens.functions import expressions as X
from contactlens.sources import schema as S


def segment_share(df: DataFrame, group: str = "group", target: str = S.TARGET) -> DataFrame:
    """Count per (group, target) and its percent inside the group.

    The window runs over the aggregated rows, partitioned by group: it holds
    at most one row per target value per group.
    """
    counts = df.groupBy(X.col(group).alias(group), X.col(target).alias(target)) \
        .agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(group))
    return (counts.withColumn("percentage", X.percent(F.col("count"), total))
            .withColumn("label", X.format_percent("percentage", digits=None)))


def pivot_counts(df: DataFrame, index: str, columns: str = S.TARGET,
                 values: Sequence[str] = tuple(S.TARGET_VALUES), fill: int | None = None) -> DataFrame:
    """Long -> wide counts, one column per listed value (listing them avoids a distinct job).

    A missing combination is NULL (pandas ``unstack``) or ``fill``.
    """
    wide = df.groupBy(X.col(index).alias(index)).pivot(columns, list(values)).count()
    return wide.fillna(fill, list(values)) if fill is not None else wide


def unpivot_counts(wide: DataFrame, index: str, values: Sequence[str] = tuple(S.TARGET_VALUES),
                   var_name: str = S.TARGET, value_name: str = "count") -> DataFrame:
    """Wide -> long (``pd.melt``): one row per (index, listed column)."""
    return wide.unpivot([index], list(values), var_name, value_name)


def sort_by(df: DataFrame, keys: Sequence[str], ascending: Sequence[bool] | bool = True,
            tie_break: str = "row_id") -> DataFrame:
    """Total order: the keys, then ``tie_break`` so equal keys sort the same every run."""
    asc = [ascending] * len(keys) if isinstance(ascending, bool) else list(ascending)
    order = [X.col(k).asc() if a else X.col(k).desc() for k, a in zip(keys, asc)]
    if tie_break in df.columns and tie_break not in keys:
        order.append(F.col(tie_break).asc())
    return df.orderBy(*order)
