"""Published data facts, checked only when the original contact file is supplied.

Set CONTACTLENS_GOLDEN_CSV to the 11,162-row contact CSV (header, 17 columns).
Without it these tests are skipped: no such file ships with the source.
"""

import os

import pytest
from pyspark.sql import functions as F

from contactlens.operators import profile as P
from contactlens.operators import stats
from contactlens.sources.campaign import load_campaign

PATH = os.environ.get("CONTACTLENS_GOLDEN_CSV")
pytestmark = pytest.mark.skipif(not PATH, reason="CONTACTLENS_GOLDEN_CSV not set")

SHAPE = (11162, 17)
QUARTILES = {  # column: (Q1, Q3, max)
    "age": (32, 49, 95), "balance": (122, 1708, 81204), "duration": (138, 496, 3881),
    "campaign": (1, 3, 63), "pdays": (-1, 20, 854), "previous": (0, 1, 58),
}
BALANCE_MIN = -6847
NO_SHARE, YES_SHARE = 0.526, 0.474


@pytest.fixture(scope="module")
def golden(spark):
    return load_campaign(spark, PATH, "csv")


def test_shape_missing_duplicates(golden):
    r = P.profile_shape(golden).first()
    assert (r["n_rows"], r["n_cols"]) == SHAPE
    assert sum(r["n_missing"] for r in P.profile_missing(golden).collect()) == 0
    assert P.profile_duplicates(golden).count() == 0


def test_quartiles(golden):
    d = {r["variable"]: r for r in P.profile_describe(golden).collect()}
    for c, (q1, q3, mx) in QUARTILES.items():
        assert (d[c]["p25"], d[c]["p75"], d[c]["max"]) == (q1, q3, mx)
    assert d["balance"]["min"] == BALANCE_MIN
    assert d["pdays"]["p50"] == -1


def test_target_share(golden):
    share = {r["deposit"]: r["share"] for r in stats.target_distribution(golden).collect()}
    assert round(share["no"], 3) == NO_SHARE and round(share["yes"], 3) == YES_SHARE

