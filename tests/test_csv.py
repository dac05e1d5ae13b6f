"""CSV contact files: null tokens, wrong numbers, and rows numbered in file order."""

import pytest

from contactlens.sources import schema as S
from contactlens.sources.campaign import load_campaign

ROW = ["30", "admin", "single", "primary", "no", "10", "no", "no", "cellular", "5", "may", "100", "1", "-1", "0", "unknown", "yes"]


def put(path, rows):
    path.write_text("\n".join(",".join(r) for r in [S.CAMPAIGN_COLUMNS, *rows]) + "\n")
    return str(path)


def test_null_tokens(spark, tmp_path):
    rows = [ROW] + [[*ROW[:1], token, *ROW[2:5], token, *ROW[6:]] for token in S.NULL_TOKENS] + [[*ROW[:1], "none", *ROW[2:]]]
    got = load_campaign(spark, put(tmp_path / "c.csv", rows)).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(len(rows)))
    assert (got[0]["job"], got[0]["balance"], got[-1]["job"]) == ("admin", 10, "none")
    assert all(r["job"] is None and r["balance"] is None for r in got[1:-1])
    assert all(r["poutcome"] == "unknown" and r["pdays"] == -1 for r in got)


def test_wrong_numbers_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed|FAILED"):
        load_campaign(spark, put(tmp_path / "c.csv", [[*ROW[:5], "ten", *ROW[6:]]])).collect()
