"""Streaming exact dedup against a plain dictionary, and its cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from contactlens.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, file string, digest string, _kept string, _metadata string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def expected(pairs):
    """Per text: the largest doc_id (None if there is no other) and the number of rows."""
    out = {}
    for i, t in pairs:
        k, n = out.get(lower(t), (None, 0))
        out[lower(t)] = (i if k is None or (i is not None and i > k) else k, n + 1)
    return out


def put(spark, path, pairs, files=3):
    rows = [(i, t, "f", "x", "k", "m") for i, t in pairs]
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(path)


PAIRS = [(1, "Same Text"), (2, "same text"), (7, "SAME TEXT"), (3, None), (4, ""), (5, "ÀB"), (6, "Àb"), (8, "àb"), (None, "only null ids"),
         (None, "only null ids"), (None, "same text"), (9, "x" * 300_000), (10, "X" * 300_000), (11, "  "), (12, " "), (13, "twice"),
         (13, "twice"), (-4, "negative"), (-5, "Negative")]


def check(rows, pairs):
    want = expected(pairs)
    assert len(rows) == len(pairs)
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == sorted(pairs, key=repr)
    kept = {}
    for r in rows:
        keep, size = want[lower(r["text"])]
        assert (r["_keep_id"], r["_group_size"]) == (keep, size)
        kept[lower(r["text"])] = kept.get(lower(r["text"]), 0) + bool(r["_kept"])
        assert not r["_kept"] or r["doc_id"] == keep
    assert set(kept.values()) == {1}


def test_against_a_dictionary(spark, tmp_path):
    rng = random.Random(5)
    pairs = PAIRS + [(100 + i, rng.choice("abcDEF") * rng.randrange(1, 30)) for i in range(400)] + [(1000 + i, "Hot line") for i in range(300)]
    put(spark, str(tmp_path / "docs"), pairs)
    rows = X.dedup(spark, str(tmp_path / "docs")).collect()
    check(rows, pairs)
    assert {r["_digest"] for r in rows if lower(r["text"]) == "same text"} == {hashlib.sha256(b"same text").hexdigest()}
    assert {(r["file"], r["digest"], r["_metadata"]) for r in rows} == {("f", "x", "m")}


@pytest.mark.parametrize("hexes", [0, 1])
def test_full_bytes_tell_equal_digests_apart(spark, tmp_path, hexes):
    """With a digest of one hex digit, or one for all, only the whole texts decide."""
    put(spark, str(tmp_path / "docs"), PAIRS)
    weak = lambda t: F.substring(F.sha2(t, 256), 1, hexes)
    check(X.dedup(spark, str(tmp_path / "docs"), digest=weak).collect(), PAIRS)


def test_state_outlives_the_query(spark, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    put(spark, path, PAIRS[:6])
    X.ingest(spark, path, state, files_per_batch=1)
    first = {r["digest"]: r["rows"] for r in X.held(spark, state).collect()}
    put(spark, path, PAIRS[6:])
    X.ingest(spark, path, state, files_per_batch=1)
    second = {r["digest"]: r["rows"] for r in X.held(spark, state).collect()}
    assert set(first) < set(second) and sum(first.values()) == 6 and sum(second.values()) == len(PAIRS)
    check(X.dedup(spark, path, state).collect(), PAIRS)  # nothing new: the state is read as it is


def test_a_single_file_and_an_empty_table(spark, tmp_path):
    put(spark, str(tmp_path / "one"), PAIRS, files=1)
    file = next(str(p) for p in (tmp_path / "one").glob("part-*"))
    check(X.dedup(spark, file).collect(), PAIRS)
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    assert X.dedup(spark, str(tmp_path / "none")).count() == 0


def test_settings_are_put_back(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in X._STREAM_CONF}
    put(spark, str(tmp_path / "docs"), PAIRS[:2])
    X.ingest(spark, str(tmp_path / "docs"), str(tmp_path / "state"))
    assert {k: spark.conf.get(k, None) for k in X._STREAM_CONF} == before
