"""Scalar column expressions (all built-in Spark functions, no Python UDF).

Each helper returns a ``Column`` so it composes inside one ``select`` and
stays inside whole-stage code generation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactlens.sources import schema as S


def col(name: str | Column) -> Column:
    """Column by exact name (names may hold dots or dashes)."""
    if isinstance(name, Column):
        return name
    return F.col(f"`{name}`")


def target_flag(c: str | Column = S.TARGET, positive: str = S.POSITIVE) -> Column:
    """1 when the value equals ``positive``, else 0 (NULL stays 0, like ``x == 'yes'``)."""
    return F.coalesce((col(c) == F.lit(positive)).cast("int"), F.lit(0))


def duration_minutes(c: str | Column = "duration", digits: int = 2) -> Column:
    """``round(duration / 60.0, digits)`` with pandas' half-even rounding."""
    return round_half_even(col(c) / F.lit(60.0), digits)


def bucketize(c: str | Column, edges: Sequence[float], labels: Sequence[str],
              right: bool = False) -> Column:
    """Label of the bin holding the value, NULL outside all bins.

    ``right=False``: bins ``[e0, e1), [e1, e2), ...``; ``right=True``: ``(e0, e1], ...``.
    ``edges`` has ``len(labels) + 1`` entries; ``inf`` is allowed as the last.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    x = col(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        if right:
            cond = (x > F.lit(lo)) & (F.lit(True) if math.isinf(hi) else x <= F.lit(hi))
        else:
            cond = (x >= F.lit(lo)) & (F.lit(True) if math.isinf(hi) else x < F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def age_category(c: str | Column = "age", right: bool = False) -> Column:
    """The two age binnings of the source: left-closed to infinity, or right-closed to 96."""
    top = S.AGE_TOP_RIGHT if right else S.AGE_TOP_LEFT
    return bucketize(c, [*S.AGE_EDGES, top], S.AGE_LABELS, right=right)


def map_month(c: str | Column = "month") -> Column:
    """'jan'..'dec' -> 1..12, anything else -> NULL."""
    pos = F.array_position(F.array(*[F.lit(m) for m in S.MONTHS]), col(c))
    return F.when(pos > 0, pos.cast("int"))


def pdays_contact(c: str | Column = "pdays", sentinel: int = -1) -> Column:
    return F.when(col(c) == F.lit(sentinel), F.lit("no")).otherwise(F.lit("yes"))


def pdays_days(c: str | Column = "pdays", sentinel: int = -1) -> Column:
    return F.when(col(c) == F.lit(sentinel), F.lit(0)).otherwise(col(c))


def contact_segment(c: str | Column = "previous") -> Column:
    return F.when(col(c) == 0, F.lit("non contactés")).otherwise(F.lit("contactés"))


def format_percent(c: str | Column, digits: int | None = 2) -> Column:
    """``"{x:.2f}%"`` with ``digits``; plain ``str(x) + '%'`` when ``digits`` is None."""
    if digits is None:
        return F.concat(col(c).cast("string"), F.lit("%"))
    return F.format_string(f"%.{digits}f%%", col(c))


def binary_flag(c: str | Column, yes: str = "yes", no: str = "no") -> Column:
    """yes -> 1, no -> 0, other -> NULL."""
    return F.when(col(c) == F.lit(yes), F.lit(1)).when(col(c) == F.lit(no), F.lit(0))


def cyclic(c: str | Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of ``2*pi*x/period``."""
    angle = F.lit(2 * math.pi) * col(c) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def round_half_even(c: str | Column, digits: int = 2) -> Column:
    """pandas/numpy rounding: ``rint(x * 10**d) / 10**d`` (3.125 -> 3.12, 0.575 -> 0.57)."""
    scale = F.lit(float(10 ** digits))
    return F.rint(col(c) * scale) / scale


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``(part / whole * 100).round(digits)`` as pandas does it; NULL when ``whole`` is 0."""
    return round_half_even(F.try_divide(part, whole) * F.lit(100.0), digits)
