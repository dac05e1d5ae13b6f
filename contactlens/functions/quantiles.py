"""Exact, linearly interpolated quantiles that scale with distinct values, not rows.

``percentile`` over raw rows keeps a value->count map per group in every
partial buffer and merges all of them in the task that owns the group: with
no grouping key that is one task for the whole table. Counting
``(group, value)`` first spreads that work over the cluster (a normal
partially-aggregated shuffle); the quantile is then taken over the
value-count table with ``percentile(value, p, frequency)``, whose input is
bounded by the number of distinct values per group. Results equal
``percentile`` / DuckDB ``quantile_cont`` on the raw rows. Columns with very
many distinct values (measured) are narrowed instead, see ``selection``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlens.functions.selection import many_values, select_quantiles


def value_counts(df: DataFrame, value: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., value, cnt)``; NULL values are dropped (quantiles skip them)."""
    v = F.col(value) if isinstance(value, str) else value
    return (df.select(*by, v.alias("value")).where(F.col("value").isNotNull())
            .groupBy(*by, "value").agg(F.count(F.lit(1)).alias("cnt")))


def quantile_exprs(probs: Sequence[float], value: str = "value", weight: str = "cnt",
                   exact: bool = True, accuracy: int = 10000) -> Column:
    """Array of quantiles over a value-count table (or approximate over it)."""
    if exact:
        return F.percentile(F.col(value), F.array(*[F.lit(float(p)) for p in probs]), F.col(weight))
    # percentile_approx has no weights; the caller passes raw rows with weight 1
    return F.percentile_approx(F.col(value), [float(p) for p in probs], accuracy)


def grouped_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float],
                      by: Sequence[str] = (), exact: bool = True,
                      names: Sequence[str] | None = None) -> DataFrame:
    """One row per group with one column per probability (``q<p>`` by default)."""
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    v = F.col(value) if isinstance(value, str) else value
    if not exact:
        arr = (df.select(*by, v.alias("value")).groupBy(*by)
               .agg(quantile_exprs(probs, exact=False).alias("_q")))
    elif continuous(df.select(*by, v.alias("value")), ["value"], by):
        return select_quantiles(df.select(*by, v.alias("value")), "value", probs, by, names)
    else:
        vc = value_counts(df, value, by)
        arr = vc.groupBy(*by).agg(quantile_exprs(probs).alias("_q"))
    return arr.select(*by, *[F.col("_q")[i].cast("double").alias(n) for i, n in enumerate(names)])


def continuous(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> bool:
    """Whether one of the columns has too many distinct values for value counts in one task per group.

    Ints and shorter types are taken as countable without a look; other
    columns are measured in one pass of sketches. Both ways give the same quantiles.
    """
    types = dict(df.dtypes)
    wide = [c for c in columns if types[c] not in ("tinyint", "smallint", "int", "date", "boolean")]
    if not wide:
        return False
    long = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(c) for c in wide]).unpivot(list(by), wide, "_variable", "_value")
    return many_values(long, "_value", [*by, "_variable"])
