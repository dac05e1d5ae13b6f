"""The two pre-processing compositions: raw contacts -> split table -> encoded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlens.functions import expressions as X
from contactlens.operators import features as FE
from contactlens.operators import transform as T


def preprocess(df: DataFrame, options: FE.Options | None = None,
               test_size: float = 0.25, seed: int = 42) -> DataFrame:
    """Month number, age bins (left-closed), pdays split, drop, train/test flag.

    One narrow ``select`` chain over the input; the target column stays in
    the same DataFrame (no features/target split to re-join later).
    """
    o = options or FE.Options()
    out = df.withColumn("month", X.map_month("month"))
    if o.bin_age:
        out = out.withColumn("age_cat", X.age_category("age", right=False)).drop("age")
    if o.split_pdays:
        out = T.split_sentinel(out, "pdays")
    return FE.train_test_split(out, test_size, seed)


def preprocess_and_transform(df: DataFrame, options: FE.Options | None = None,
                             handle_invalid: str = "error") -> tuple[DataFrame, FE.Encoding]:
    """Fit the encoding on the training rows, apply it to all rows.

    Returns the encoded table (``row_id, is_test, label`` and the features)
    and the fitted state (JSON-serialisable).
    """
    prepared = preprocess(df, options)
    enc = FE.fit_encoding(prepared.where(~F.col("is_test")), options)
    return FE.apply_encoding(prepared, enc, handle_invalid=handle_invalid), enc


def remove_duration(encoded: DataFrame) -> DataFrame:
    """Feature ablation: ``duration`` is only known after the call."""
    return T.drop_columns(encoded, ["duration"])
