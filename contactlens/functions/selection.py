"""Exact quantiles of columns with very many distinct values, by narrowing.

No step holds a column's values in one task. A round draws borders around the
wanted ranks from a mergeable sketch, counts exactly how many values lie in
each cell between two borders, and keeps only the cells in which a rank falls,
for all groups and ranks at once. The first round keeps some 1 / 1,000 of the
rows around each rank, the next ones less, until a cell holds ``LIMIT`` values
at most or one value alone. The sketch only decides how fast this goes; the
counts decide the result, so it does not depend on partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactlens.sources.storage import materialize

#: values of a cell that may meet in one task
LIMIT = 50_000
#: accuracy of the sketches, borders left and right of a rank in the first round, and cells in later rounds
ACCURACY, NEAR, CELLS = 10_000, 5e-4, 32
#: distinct values per group up to which a table of value counts is used instead (see ``many_values``)
FEW_VALUES = 1_000_000


def _written(df: DataFrame, name: str) -> DataFrame:
    return materialize(df.sparkSession, df, f"selection-{name}", uuid.uuid4().hex)


def many_values(df: DataFrame, value: str, by: Sequence[str] = ()) -> bool:
    """Whether a group holds more than about ``FEW_VALUES`` distinct values (one pass with fixed-size sketches)."""
    counts = df.groupBy(*by).agg(F.approx_count_distinct(value).alias("n"))
    return (counts.agg(F.max("n")).first()[0] or 0) > FEW_VALUES


def select_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float], by: Sequence[str] = (),
                     names: Sequence[str] | None = None) -> DataFrame:
    """One row per group with the exact, linearly interpolated quantiles, as ``percentile`` and ``quantile_cont`` give them.

    Nulls are left out; a group of nulls alone has no row (without ``by``: one row of nulls).
    NaN counts as larger than any number. Columns ``q<p>`` by default.
    """
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    by = list(by)
    keys = [f"g{i}" for i in range(len(by))]
    v = F.col(f"`{value}`") if isinstance(value, str) else value
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], v.cast("double").alias("value")).where("value is not null")
    # groups may be null: rows meet on a struct of them, which compares null with null
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("g"))
    rows = rows.select(F.to_json(group, {"ignoreNullFields": "false"}).alias("group"), *keys, "value") if keys else rows.select(
        F.lit("").alias("group"), "value")
    sizes = _written(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.first(k).alias(k) for k in keys]), "sizes")

    wanted = F.array(*[x for i, p in enumerate(probs) for x in _ranks(i, p)])
    ranks = sizes.select("group", F.lit(0).cast("long").alias("cell"), F.explode(wanted).alias("r")).select("group", "cell", "r.*")
    data = rows.select("group", F.lit(0).cast("long").alias("cell"), "value")
    grid = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-NEAR, NEAR)})
    done = []
    for _ in range(40):
        borders = _written(data.groupBy("group", "cell").agg(F.array_sort(F.array_distinct(F.percentile_approx("value", grid, ACCURACY))).alias("b")),
                           "borders")
        # cell 2i lies before border i, cell 2i + 1 is the border itself
        before = F.size(F.filter("b", lambda b: b < F.col("value")))
        placed = data.join(borders, ["group", "cell"]).select(
            "group", "cell", "value", (before * 2 + F.array_contains("b", F.col("value")).cast("int")).alias("part"))
        counts = placed.groupBy("group", "cell", "part").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("group", "cell").orderBy("part"))
        counts = counts.withColumn("start", upto - F.col("n"))
        found = _written(ranks.join(counts, ["group", "cell"]).where((F.col("k") >= F.col("start")) & (F.col("k") < F.col("start") + F.col("n")))
                         .select("group", "i", "side", (F.col("k") - F.col("start")).alias("k"), "cell", "part", "n", "lo", "hi"), "ranks")
        one = (F.col("lo") == F.col("hi")) | (F.isnan("lo") & F.isnan("hi"))
        done.append(found.where(one).select("group", "i", "side", F.col("lo").alias("value")))
        left = found.where(~one)
        most = left.agg(F.max("n")).first()[0]
        if most is None:
            break
        inner = (F.col("cell") * (4 * CELLS) + F.col("part")).alias("cell")
        open_cells = left.select("group", "cell", "part").distinct()
        data = _written(placed.join(open_cells, ["group", "cell", "part"], "left_semi").select("group", inner, "value"), "rows")
        ranks = left.select("group", inner, "i", "side", "k")
        if most <= LIMIT:
            done.append(_in_order(data, ranks))
            break
        grid = [j / CELLS for j in range(1, CELLS)]
    else:
        raise RuntimeError("quantiles did not settle")
    return _interpolated(done, sizes, probs, names, by, keys)


def _ranks(i: int, p: float) -> list[Column]:
    """The two order statistics that quantile ``i`` lies between, counted from 0."""
    if not 0 <= p <= 1:
        raise ValueError("probabilities must be between 0 and 1")
    at = F.lit(float(p)) * (F.col("n") - 1)
    return [F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), f(at).cast("long").alias("k")) for side, f in enumerate((F.floor, F.ceil))]


def _in_order(data: DataFrame, ranks: DataFrame) -> DataFrame:
    """The values at the ranks ``k`` of cells that hold ``LIMIT`` values at most."""
    counts = data.groupBy("group", "cell", "value").agg(F.count(F.lit(1)).alias("n"))
    end = F.sum("n").over(Window.partitionBy("group", "cell").orderBy("value"))
    return (ranks.join(counts.withColumn("end", end), ["group", "cell"]).where((F.col("k") < F.col("end")) & (F.col("k") >= F.col("end") - F.col("n")))
            .select("group", "i", "side", "value"))


def _interpolated(done: list[DataFrame], sizes: DataFrame, probs: Sequence[float], names: list[str], by: list[str], keys: list[str]) -> DataFrame:
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    at = lambda i, side: F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col("value")))
    ends = found.groupBy("group").agg(*[at(i, s).alias(f"v{i}_{s}") for i in range(len(probs)) for s in (0, 1)])
    both = ends.join(sizes, "group")
    out = []
    for i, (p, name) in enumerate(zip(probs, names, strict=True)):
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"v{i}_0"), F.col(f"v{i}_1")
        between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        out.append(F.when((F.floor(place) == F.ceil(place)) | (low == high), low).otherwise(between).alias(name))
    result = both.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *out)
    if by:
        return result
    # without groups there is one row, of nulls if there are no values
    return result.agg(*[F.max(n).alias(n) for n in names])

