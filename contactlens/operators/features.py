"""Feature preparation: fit on the training rows, apply the same expressions to all rows.

Fitting is one job over the training rows: category counts (for the mode,
the one-hot columns and the label classes) and the numeric statistics come
back together as a small table (bounded by the distinct categories, which is
checked, and by the number of numeric columns). Applying the fit is a single
``select`` of literal-driven expressions: no join, no UDF, so the encoded
table stays inside whole-stage code generation and is as parallel as its
input.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlens.functions import expressions as X
from contactlens.functions.quantiles import continuous
from contactlens.functions.selection import select_quantiles
from contactlens.sources import schema as S

MAX_CATEGORIES = 10_000  # per one-hot column; more is not a categorical feature


# -- split ----------------------------------------------------------------------------

def split_hash(row_id: str | Column = "row_id", seed: int = 42) -> Column:
    """32-bit hash of ``row_id:seed`` from md5: stable under any partitioning."""
    key = F.concat(X.col(row_id).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def test_flag(row_id: str | Column = "row_id", test_size: float = 0.25, seed: int = 42) -> Column:
    return split_hash(row_id, seed) < F.lit(int(2 ** 32 * test_size))


def train_test_split(df: DataFrame, test_size: float = 0.25, seed: int = 42, exact: bool = False) -> DataFrame:
    """Adds ``is_test``: a seeded random 25% (not stratified), same rows on every run.

    The number of test rows is binomial; with ``exact`` it is the share of the
    rows rounded up, those of the smallest hashes (ties by ``row_id``, which must
    be unique). Finding the border takes a few counts over the hashes, no sort.
    """
    if not exact:
        return df.withColumn("is_test", test_flag("row_id", test_size, seed))
    last = _last_test_row(df.select("row_id", split_hash("row_id", seed).alias("h")), test_size)
    if last is None:
        return df.withColumn("is_test", F.lit(False))
    h, top, row = split_hash("row_id", seed), F.lit(last[0]), F.lit(last[1]).cast(df.schema["row_id"].dataType)
    return df.withColumn("is_test", (h < top) | ((h == top) & (X.col("row_id") <= row)))


#: ranges that the border is looked for in at a time, as bits of the hash
SPLIT_BITS = 12


def _last_test_row(rows: DataFrame, test_size: float) -> tuple[int, object] | None:
    """(hash, row_id) of the last test row in their order: counts by ranges of hashes, each pass within the range found before."""
    lo, width, rank = 0, 32, None
    while width > 0:
        width = max(0, width - SPLIT_BITS)
        ranges = (rows.where(F.col("h").between(lo, lo + (1 << min(32, width + SPLIT_BITS)) - 1))
                  .groupBy(F.shiftright("h", width).alias("range")).agg(F.count(F.lit(1)).alias("n")).collect())
        if rank is None:
            rank = math.ceil(sum(r["n"] for r in ranges) * test_size)
            if rank == 0:
                return None
        for r in sorted(ranges, key=lambda r: r["range"]):
            if rank <= r["n"]:
                lo = r["range"] << width
                break
            rank -= r["n"]
    # rows of one 32-bit hash: n / 2**32 on average
    ties = rows.where(F.col("h") == lo).select("row_id").orderBy("row_id").limit(rank)
    return lo, ties.agg(F.max("row_id")).first()[0]


# -- single encoders -------------------------------------------------------------------

def encode_binary(columns: Sequence[str] = S.BINARY_FEATURES) -> list[Column]:
    return [X.binary_flag(c).cast("double").alias(c) for c in columns]


def onehot_name(column: str, value: str) -> str:
    return f"{column}_{value}"


def encode_onehot(categories: dict[str, Sequence[str]]) -> list[Column]:
    """One 0/1 column per fitted category; an unseen or NULL value gives all zeros."""
    out = []
    for c, values in categories.items():
        for v in values:
            out.append(F.coalesce((X.col(c) == F.lit(v)).cast("double"), F.lit(0.0)).alias(onehot_name(c, v)))
    return out


def encode_ordinal(column: str, order: Sequence[str], handle_invalid: str = "error") -> Column:
    """Position in ``order`` (0-based); any other value raises, or is NULL with ``"null"``."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), X.col(column))
    bad = F.lit(None) if handle_invalid == "null" else F.raise_error(
        F.concat(F.lit(f"unknown category in {column}: "), F.coalesce(X.col(column).cast("string"), F.lit("NULL"))))
    return F.when(pos > 0, (pos - 1).cast("double")).otherwise(bad.cast("double")).alias(column)


def encode_cyclic(column: str, period: float) -> list[Column]:
    s, c = X.cyclic(column, period)
    return [s.alias(f"{column}_sin"), c.alias(f"{column}_cos")]


def scale(column: str, center: float, spread: float) -> Column:
    """``(x - center) / spread``; a zero spread divides by 1, as scikit-learn does."""
    x = X.col(column).cast("double") - F.lit(float(center))
    return (x / F.lit(float(spread)) if spread else x).alias(column)


def encode_label(column: str, classes: Sequence[str], handle_invalid: str = "error") -> Column:
    """Position in the sorted classes; any other value raises, or is NULL with ``"null"``."""
    return encode_ordinal(column, classes, handle_invalid).alias("label")


# -- fitted state -----------------------------------------------------------------------

@dataclass
class Options:
    """The pre-processing presets of the source (``pipeline_variants``)."""
    split_pdays: bool = True
    bin_age: bool = True
    scaler: str = "robust"          # or "standard"
    mode_excludes_unknown: bool = True
    exact_quantiles: bool = True    # False: percentile_approx sketches for the robust scaler


PRESETS = {
    1: Options(split_pdays=False, bin_age=True, scaler="robust"),
    2: Options(split_pdays=True, bin_age=True, scaler="robust"),
    3: Options(split_pdays=True, bin_age=True, scaler="standard"),
    4: Options(split_pdays=True, bin_age=False, scaler="standard"),
}


@dataclass
class Encoding:
    options: Options
    education_mode: str | None
    categories: dict[str, list[str]]
    numeric: dict[str, tuple[float, float]]          # column -> (center, spread)
    label_classes: list[str]
    feature_names: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Encoding:
        d = json.loads(text)
        d["options"] = Options(**d["options"])
        d["numeric"] = {k: tuple(v) for k, v in d["numeric"].items()}
        return Encoding(**d)


def feature_groups(o: Options) -> dict[str, list[str]]:
    binary = [c for c in S.BINARY_FEATURES if o.split_pdays or c != "pdays_contact"]
    ordinal = ["education", "age_cat"] if o.bin_age else ["education"]
    numeric = [c if o.split_pdays or c != "pdays_days" else "pdays" for c in S.NUMERIC_FEATURES]
    if not o.bin_age:
        numeric = ["age", *numeric]
    return {"binary": binary, "onehot": list(S.ONEHOT_FEATURES), "ordinal": ordinal, "numeric": numeric}


def fit_encoding(train: DataFrame, options: Options | None = None,
                 target: str = S.TARGET) -> Encoding:
    """Everything the encoding learns from the training rows.

    One small job counts the categories per column, a second one brings them
    and the numeric statistics. More than ``MAX_CATEGORIES`` distinct non-NULL
    values in a categorical column raise.
    """
    o = options or Options()
    g = feature_groups(o)
    cat_cols = ["education", *g["onehot"], target]
    cats = (train.select(*[X.col(c).cast("string").alias(c) for c in cat_cols])
            .unpivot([], cat_cols, "variable", "value").where(F.col("value").isNotNull())
            .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")))
    # one row per column; no category reaches the driver before their number is known to be small
    for r in cats.groupBy("variable").agg(F.count(F.lit(1)).alias("n_categories")).collect():
        if r["n_categories"] > MAX_CATEGORIES:
            raise ValueError(f"{r['variable']} has {r['n_categories']} categories (limit {MAX_CATEGORIES})")
    cats = cats.select("variable", "value", "n", *[F.lit(None).cast("double").alias(k) for k in ("a", "b", "c")])
    num = (train.select(*[X.col(c).cast("double").alias(c) for c in g["numeric"]])
           .unpivot([], g["numeric"], "variable", "value").where(F.col("value").isNotNull()))
    if o.scaler == "robust":
        if o.exact_quantiles and continuous(train, g["numeric"]):
            qtab = (select_quantiles(num, "value", [0.25, 0.5, 0.75], ["variable"], ["a", "b", "c"])
                    .select("variable", F.array("a", "b", "c").alias("q")))
        elif o.exact_quantiles:
            q = F.percentile(F.col("value"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("cnt"))
            qtab = (num.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("cnt"))
                    .groupBy("variable").agg(q.alias("q")))
        else:
            qtab = num.groupBy("variable").agg(
                F.percentile_approx("value", [0.25, 0.5, 0.75], 10000).cast("array<double>").alias("q"))
        stats = (qtab
                 .select("variable", F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("n"),
                         F.col("q")[0].alias("a"), F.col("q")[1].alias("b"), F.col("q")[2].alias("c")))
    else:
        stats = _moments(train, g["numeric"])
    rows = cats.unionByName(stats).collect()

    counts: dict[str, dict[str, int]] = {}
    numeric: dict[str, tuple[float, float]] = {}
    for r in rows:
        if r["n"] is not None:
            counts.setdefault(r["variable"], {})[r["value"]] = r["n"]
        elif o.scaler == "robust":
            numeric[r["variable"]] = (r["b"], r["c"] - r["a"])
        else:
            numeric[r["variable"]] = (r["b"], r["c"] or 0.0)
    edu = {k: v for k, v in counts.get("education", {}).items()
           if not (o.mode_excludes_unknown and k == "unknown")}
    mode = min(edu.items(), key=lambda kv: (-kv[1], kv[0]))[0] if edu else None
    enc = Encoding(
        options=o, education_mode=mode,
        categories={c: sorted(counts.get(c, {})) for c in g["onehot"]},
        numeric={c: numeric.get(c, (0.0, 0.0)) for c in g["numeric"]},
        label_classes=sorted(counts.get(target, {})),
    )
    enc.feature_names = [c for c in transform_columns(enc)]
    return enc


def _moments(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per column.

    Integer columns use exact sums (decimal(38,0): no overflow, no rounding
    before the last division), so the result does not depend on how rows are
    spread over tasks; other columns use ``stddev_pop``.
    """
    types = dict(train.dtypes)
    integral = all(types[c] in ("tinyint", "smallint", "int", "bigint") for c in columns)
    out = F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("n")
    if not integral:
        num = (train.select(*[X.col(c).cast("double").alias(c) for c in columns])
               .unpivot([], list(columns), "variable", "value").where(F.col("value").isNotNull()))
        return (num.groupBy("variable").agg(F.avg("value").alias("b"), F.stddev_pop("value").alias("c"))
                .select("variable", *out, F.lit(None).cast("double").alias("a"), "b", "c"))
    dec = "decimal(38,0)"
    num = (train.select(*[X.col(c).cast(dec).alias(c) for c in columns])
           .unpivot([], list(columns), "variable", "value").where(F.col("value").isNotNull()))
    m = num.groupBy("variable").agg(F.count(F.lit(1)).cast(dec).alias("k"), F.sum("value").alias("s1"),
                                    F.sum(F.col("value") * F.col("value")).alias("s2"))
    k = F.col("k").cast("double")
    var = (F.col("k") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double") / (k * k)
    return m.select("variable", *out, F.lit(None).cast("double").alias("a"),
                    (F.col("s1").cast("double") / k).alias("b"), F.sqrt(var).alias("c"))


def transform_columns(enc: Encoding) -> list[str]:
    g = feature_groups(enc.options)
    onehot = [onehot_name(c, v) for c in g["onehot"] for v in enc.categories[c]]
    return [*g["binary"], *onehot, *g["ordinal"], *S.CYCLIC_FEATURES, *g["numeric"]]


def _sql_number(x: float) -> str:
    return f"({float(x)!r}D)"


def _sql_text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_position(column: str, order: Sequence[str]) -> str:
    cases = " ".join(f"WHEN {column} = {_sql_text(v)} THEN {i}D" for i, v in enumerate(order))
    return f"CASE {cases} END"


def contact_sql(enc: Encoding) -> dict[str, str]:
    """Every encoded feature as a SQL expression over the raw contact columns, in the encoding's order.

    The same values as preparing and encoding the contact. What has no place
    in the encoding (an education that is not in the order, an age under 18, a month or a
    yes/no value of another kind, a null number) is NULL; an unseen or NULL
    one-hot category is 0 in all its columns.
    """
    g = feature_groups(enc.options)
    out: dict[str, str] = {}
    for c in g["binary"]:
        out[c] = ("CASE WHEN `pdays` = -1 THEN 0D ELSE 1D END" if c == "pdays_contact"
                  else f"CASE WHEN `{c}` = 'yes' THEN 1D WHEN `{c}` = 'no' THEN 0D END")
    for c in g["onehot"]:
        for v in enc.categories[c]:
            out[onehot_name(c, v)] = f"COALESCE(CAST(`{c}` = {_sql_text(v)} AS DOUBLE), 0D)"
    education = "`education`"
    if enc.education_mode is not None:
        education = f"CASE WHEN `education` = 'unknown' THEN {_sql_text(enc.education_mode)} ELSE `education` END"
    out["education"] = _sql_position(f"({education})", S.EDUCATION_ORDER)
    if enc.options.bin_age:
        edges = [*S.AGE_EDGES, None]
        bins = " ".join(f"WHEN `age` >= {lo}" + (f" AND `age` < {hi}" if hi is not None else "") + f" THEN {i}D"
                        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)))
        out["age_cat"] = f"CASE {bins} END"
    month = "CASE " + " ".join(f"WHEN `month` = '{m}' THEN {i + 1}" for i, m in enumerate(S.MONTHS)) + " END"
    for c, x, period in (("day", "`day`", 31), ("month", f"({month})", 12)):
        angle = f"{_sql_number(2 * math.pi)} * {x} / {period}D"
        out[f"{c}_sin"], out[f"{c}_cos"] = f"SIN({angle})", f"COS({angle})"
    for c in g["numeric"]:
        center, spread = enc.numeric[c]
        x = "(CASE WHEN `pdays` = -1 THEN 0 ELSE `pdays` END)" if c == "pdays_days" else f"`{c}`"
        x = f"(CAST({x} AS DOUBLE) - {_sql_number(center)})"
        out[c] = f"{x} / {_sql_number(spread)}" if spread else x
    return {c: out[c] for c in transform_columns(enc)}


def apply_encoding(df: DataFrame, enc: Encoding, target: str = S.TARGET,
                   keep: Sequence[str] = ("row_id", "is_test"), handle_invalid: str = "error") -> DataFrame:
    """``keep`` columns, ``label`` and the feature columns, in the source's column order."""
    g = feature_groups(enc.options)
    edu = X.col("education")
    if enc.education_mode is not None:
        df = df.withColumn("education", F.when(edu == "unknown", F.lit(enc.education_mode)).otherwise(edu))
    cols: list[Column] = [X.col(k) for k in keep if k in df.columns]
    if target in df.columns:
        cols.append(encode_label(target, enc.label_classes, handle_invalid))
    cols += encode_binary(g["binary"])
    cols += encode_onehot({c: enc.categories[c] for c in g["onehot"]})
    cols.append(encode_ordinal("education", S.EDUCATION_ORDER, handle_invalid))
    if enc.options.bin_age:
        cols.append(encode_ordinal("age_cat", S.AGE_LABELS, handle_invalid))
    cols += encode_cyclic("day", 31) + encode_cyclic("month", 12)
    cols += [scale(c, *enc.numeric[c]) for c in g["numeric"]]
    return df.select(*cols)
