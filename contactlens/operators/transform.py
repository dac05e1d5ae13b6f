"""Row filters, projections and derived columns (all narrow: no shuffle).

The only fitted value here, the most frequent category, is a scalar
subquery over a ``groupBy`` count: the distinct categories are counted in
parallel and one value comes back, without a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlens.functions import expressions as X


def filter_eq(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(X.col(column) == F.lit(value))


def filter_ne(df: DataFrame, column: str, value) -> DataFrame:
    """``column != value`` as pandas: a NULL cell is "not equal" and is kept."""
    return df.where(~X.col(column).eqNullSafe(F.lit(value)))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the listed columns; absent names are ignored."""
    return df.drop(*columns)


def with_duration_minutes(df: DataFrame) -> DataFrame:
    return df.withColumn("duration_minutes", X.duration_minutes("duration"))


def with_target_flag(df: DataFrame, target: str = "deposit") -> DataFrame:
    return df.withColumn(f"{target}_num", X.target_flag(target))


def with_age_categories(df: DataFrame) -> DataFrame:
    """Both binnings of age: left-closed (pre-processing) and right-closed (charts)."""
    return (df.withColumn("age_cat", X.age_category("age", right=False))
            .withColumn("age_cat_right", X.age_category("age", right=True)))


def most_frequent(df: DataFrame, column: str, exclude: Sequence[str] = ()) -> Column:
    """The mode of ``column`` as a scalar subquery; ties go to the smallest value."""
    c = X.col(column)
    src = df.where(c.isNotNull())
    if exclude:
        src = src.where(~c.isin(*exclude))
    counts = src.groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("v")).limit(1).select("v").scalar()


def replace_unknown_with_mode(df: DataFrame, column: str = "education", unknown: str = "unknown",
                              fit: DataFrame | None = None, exclude_unknown: bool = True) -> DataFrame:
    """Replace ``unknown`` by the most frequent value of ``fit`` (default: ``df``).

    ``exclude_unknown=False`` is the other rule of the source (mode taken with
    'unknown' included, which can then replace 'unknown' by itself).
    """
    mode = most_frequent(fit if fit is not None else df, column, [unknown] if exclude_unknown else [])
    c = X.col(column)
    return df.withColumn(column, F.when(c == F.lit(unknown), mode).otherwise(c))


def split_sentinel(df: DataFrame, column: str = "pdays", sentinel: int = -1,
                   drop: bool = True) -> DataFrame:
    """``pdays`` -> ``pdays_contact`` (no/yes) and ``pdays_days`` (0 for the sentinel)."""
    out = (df.withColumn(f"{column}_contact", X.pdays_contact(column, sentinel))
           .withColumn(f"{column}_days", X.pdays_days(column, sentinel)))
    return out.drop(column) if drop else out


def with_month_number(df: DataFrame, column: str = "month", name: str | None = None) -> DataFrame:
    return df.withColumn(name or column, X.map_month(column))


def with_contact_segment(df: DataFrame) -> DataFrame:
    return df.withColumn("group", X.contact_segment("previous"))
