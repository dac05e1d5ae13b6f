"""The divergence audit against plain Python on integers, the skyband against its definition, and the cases."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contactlens.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, p string, rank string"


def words(t):
    out, cur = [], ""
    for ch in (t or "") + " ":
        if ch.isascii() and not ch.isalpha():
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    return out


def plain(rows, least=10, k=10):
    """All rows of the audit from (text, lang, source) triples."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in rows:
        w = words(t)
        docs[lang].update(set(w))
        count[lang, source].update(w)
    out = set()
    for lang in {r[1] for r in rows}:
        kept = [w for w, n in docs[lang].items() if n >= least]
        groups = {s: c for (x, s), c in count.items() if x == lang}
        p = {}
        for s, c in [*groups.items(), (None, sum(groups.values(), Counter()))]:
            n = sum(c[w] for w in kept)
            p[s] = {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in groups if o != s]
            top = [(f(p[s][w], p[None][w]), w) for w in kept if c[w] and p[s][w] > p[None][w]]
            for part, got, most in (("pair", pairs, None), ("term", top, k)):
                got.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, r + 1) for r, (v, item) in enumerate(got[:most])}
    return out


def audit(spark, rows, **options):
    df = spark.createDataFrame([(i, t, lang, s, "x", 1, "y", "z") for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(3)
    got = D.audit(df, **options).collect()
    out = {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got}
    assert len(out) == len(got)
    return out


def sample(rng, n, vocabulary):
    weight = [1 / (i + 1) for i in range(len(vocabulary))]
    return " ".join(rng.choices(vocabulary, weight, k=n))


def test_against_plain_python(spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "abcdéüß" for b in ("", "x", "Yz", "日本", "ñ")] + ["don't", "x_y", "12ab34", "À"]
    rows = [(sample(rng, rng.randrange(0, 60), vocabulary), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "é"]))
            for _ in range(400)]
    rows += [("hot " * 40 + sample(rng, 30, vocabulary), "en", "s1") for _ in range(200)]  # a third of all rows in one group
    rows += [(None, "en", "s4"), ("", "fr", "only"), ("12 34", "fr", "empty"), ("a b c", "it", "s1"), ("a b c", "it", "s2")]
    rows += rows[:50]  # repeated rows
    rows.append(("long " * 50_000 + "ab " * 1000, "de", "s2"))
    got, want = audit(spark, rows), plain(rows)
    assert got == want
    assert {r[4] for r in got if r[0] in ("fr", "it")} == {0}  # no kept term: pairs of value 0


def test_kernels_pass_partial_sums_on(spark, monkeypatch):
    monkeypatch.setattr(D, "FLUSH", 7)
    rng = random.Random(2)
    vocabulary = [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(sample(rng, 40, vocabulary), "en", f"s{i % 3}") for i in range(60)]
    batch = spark.createDataFrame([(t, lang, s) for t, lang, s in rows], "text string, lang string, source string").toArrow().to_batches()
    total = Counter()
    parts = list(D._count(iter(batch)))
    for b in parts:
        for lang, s, w, n, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
            total[lang, s, w] += n
    assert len(parts) > 3 and total == Counter((lang, s, w) for t, lang, s in rows for w in words(t))


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_skyband(step, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 16)
    rng = random.Random(7)
    for size, k in ((1, 1), (200, 1), (200, 10), (300, 4)):
        items = [(rng.randrange(1, 30), rng.randrange(0, 30), f"é{i}") for i in rng.sample(range(1000), size)]
        want = {b for b in items if sum(a != b and a[0] >= b[0] and a[0] + a[1] <= b[0] + b[1] and a[2] < b[2] for a in items) < k}
        items.sort(key=lambda x: (-x[0], x[0] + x[1], x[2].encode()))
        table = pa.table({"n": [x[0] for x in items], "lang_n": [x[0] + x[1] for x in items], "term": [x[2] for x in items]})
        band = D.Skyband(k)
        for i in range(0, size, step):
            band.add(table.slice(i, step))
        got = [(n, lang - n, t) for n, lang, t in zip(*(c.to_pylist() for c in band.rows.columns), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_terms_of_very_many_sources(spark, monkeypatch):
    """Pairs of sources are passed on at once, or in several arrays, where they do not fit into one."""
    rng = random.Random(4)
    vocabulary = [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(sample(rng, 20, vocabulary), "en", f"s{i % 9}") for i in range(90)]
    want = plain(rows)
    for wide in (1, 5, 8):
        monkeypatch.setattr(D, "WIDE", wide)
        monkeypatch.setattr(D, "BROADCAST_GROUPS", 0)
        df = spark.createDataFrame(rows, "text string, lang string, source string")
        kept, groups = D.kept_counts(df)
        shared = list(D._both(iter(kept.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("g"))
                                   .select("lang", "g.source", "g.p", "g.p0").toArrow().to_batches())))
        total = Counter()
        for b in shared:
            for lang, x, y, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total[x, y] += v
        base = {(r["a"], r["b"]): r["value"] for r in D.pair_values(kept, groups).collect()}
        assert {(s, i): v for lang, s, part, i, v, r in want if part == "pair"} == base
        if wide == 1:
            first = total
        assert {k: v for k, v in total.items() if k[0] != k[1]} == {k: v for k, v in first.items() if k[0] != k[1]}


def test_large_counts_stay_exact(spark):
    cases = [(2, 3), (9_007_199_254_740_993, 9_007_199_254_740_995), (123_456_789_012_345, 9_000_000_000_000_000), (7, 9_000_000_000_000_000)]
    got = spark.createDataFrame(cases, "c long, n long").select("c", "n", D._p(F.col("c"), F.col("n")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * r["c"] // r["n"] for r in got)


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], SCHEMA)).count() == 0
