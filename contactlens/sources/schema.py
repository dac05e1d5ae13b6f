"""Contact-table schema and the fixed vocabularies the operators rely on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the source application's for equal results:
# column lists, category orders, bin edges/labels and the month lookup.
# ---------------------------------------------------------------------------
TARGET = "deposit"
POSITIVE = "yes"
NEGATIVE = "no"
TARGET_VALUES = ["yes", "no"]

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

AGE_EDGES = [18, 29, 40, 50, 60]
AGE_LABELS = ["18-29ans", "30-40ans", "40-50ans", "50-60ans", "Plus de 60 ans"]
AGE_TOP_LEFT = float("inf")  # left-closed binning: last bin is [60, inf)
AGE_TOP_RIGHT = 96  # right-closed binning: last bin is (60, 96]

EDUCATION_ORDER = ["primary", "secondary", "tertiary"]
MARITAL_ORDER = ["married", "single", "divorced"]

BINARY_FEATURES = ["default", "housing", "loan", "pdays_contact"]
ONEHOT_FEATURES = ["job", "marital", "contact", "poutcome"]
ORDINAL_FEATURES = ["education", "age_cat"]
CYCLIC_FEATURES = ["day_sin", "day_cos", "month_sin", "month_cos"]
NUMERIC_FEATURES = ["balance", "campaign", "duration", "previous", "pdays_days"]

# texts that count as missing in a CSV file (the defaults of pandas.read_csv)
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
               "NaN", "None", "n/a", "nan", "null"]

CATEGORICAL_COLUMNS = ["job", "marital", "education", "default", "housing", "loan",
                       "contact", "month", "poutcome"]
HISTOGRAM_COLUMNS = ["balance", "day", "duration", "campaign", "pdays", "previous"]
CORRELATION_COLUMNS = ["age", "balance", "duration", "campaign", "pdays", "previous", "deposit_num"]
DESCRIBE_COLUMNS = ["age", "balance", "day", "duration", "campaign", "pdays", "previous"]
CROSSTAB_DIMENSIONS = ["age_cat", "job", "marital", "education", "default", "loan",
                       "housing", "contact", "poutcome"]
# ---------------------------------------------------------------------------

CAMPAIGN_COLUMNS = ["age", "job", "marital", "education", "default", "balance", "housing",
                    "loan", "contact", "day", "month", "duration", "campaign", "pdays",
                    "previous", "poutcome", "deposit"]

_TYPES = {
    "age": T.IntegerType(), "balance": T.IntegerType(), "day": T.IntegerType(),
    "duration": T.IntegerType(), "campaign": T.IntegerType(), "pdays": T.IntegerType(),
    "previous": T.IntegerType(),
}

CAMPAIGN_SCHEMA = T.StructType(
    [T.StructField("row_id", T.LongType(), False)]
    + [T.StructField(c, _TYPES.get(c, T.StringType()), True) for c in CAMPAIGN_COLUMNS]
)
# The source file has no row id; the reader adds one.
CAMPAIGN_FILE_SCHEMA = T.StructType([f for f in CAMPAIGN_SCHEMA.fields if f.name != "row_id"])

BUSINESS_COLUMNS = list(CAMPAIGN_COLUMNS)
