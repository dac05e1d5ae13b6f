"""Each operator against a brute-force form, and its cases: nulls, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contactlens.llm import (chat_format, chunk_dedup, common, cover_tree, embedding_dedup, lattice, license_scan, line_dedup,
                             mixing, ngram_join, quality)
from contactlens.llm.textkernel import mix, slices
from contactlens.llm.tokenizers import tokenizer_path

WORDS = [f"w{i}" for i in range(4000)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, both string, a string, node string"


@pytest.fixture
def docs(spark):
    """A frame of documents from (doc_id, text) pairs, with extra columns whose names clash with inner ones."""
    def make(pairs, source="s"):
        rows = [(i, t, "en", source if isinstance(source, str) else source[k % len(source)], len(t) if t is not None else None, "x", "y", "z")
                for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, DOCS)
    return make


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edit(rng, t, k):
    w = t.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 150)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges + [(None, 3), (7, 7)], "a long, b long")).collect()}
    exp = roots({x for e in edges for x in e}, edges)
    assert all(got.get(n, n) == c for n, c in exp.items())
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 ------------------------------------------------------------------------------

def test_embedding_links(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 20] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(60)]
    rows += [(200 + i, base[3].tolist()) for i in range(300)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (None, base[0].tolist()), (905, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rep int, key int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, block=64).collect()}
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and i < 900}
    links = [(a, b) for a, b in itertools.combinations(sorted(ok), 2) if ok[a] @ ok[b] >= 0.9]
    c = roots(ok, links)
    degree = {i: sum(i in p for p in links) for i in ok}
    assert len(got) == len({i for i, _ in rows})
    assert sum(got[i]["n_links"] == degree[i] and got[i]["component_id"] == c[i] for i in ok) == len(ok)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 906))
    assert got[None]["component_id"] is None and not got[None]["kept"]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_groups_grow_with_the_entries(spark, monkeypatch):
    """What meets in one worker is bounded, whatever the number of shuffle partitions; the rows stay the same."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    first = sorted(embedding_dedup.near_duplicates(df, block=16).collect())
    found, plain = [], embedding_dedup.groups
    monkeypatch.setattr(embedding_dedup, "GROUP", 2000)
    monkeypatch.setattr(embedding_dedup, "groups", lambda spark, numbers: found.append((numbers, plain(spark, numbers))) or found[-1][1])
    assert sorted(embedding_dedup.near_duplicates(df, block=16).collect()) == first
    [(numbers, parts)] = found
    assert numbers > 120 * 16 and parts * 2000 >= numbers and parts > 2 * common.partitions(spark)


# -- 2 ------------------------------------------------------------------------------

def test_cover_tree_top_k(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.standard_normal((400, 8)), np.repeat(rng.standard_normal((1, 8)), 100, 0)])
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(1000, None, 1), (1050, [float("nan")] * 8, 1), (1100, [None] * 8, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, db int")
    got = cover_tree.top_k(df, F.col("id") % 50 == 0, data_block=64, query_block=4, sample=32).collect()
    w = np.floor(256 * v).astype(np.int64)
    exp = set()
    for q in range(0, 500, 50):
        s = sorted(((-int(w[q] @ w[i]), i) for i in range(500) if i != q))[:5]
        exp |= {(q, k + 1, i, -x) for k, (x, i) in enumerate(s)}
    assert {tuple(r) for r in got} == exp
    assert cover_tree.top_k(df.where("vec_id in (0, 7)"), F.col("id") % 50 == 0).collect()[0]["vec_id"] == 7
    assert cover_tree.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def clustered(rng, n, dims, clusters, width):
    """Unit vectors around ``clusters`` centres; ``width`` is the noise's length against the centre's."""
    c = rng.standard_normal((clusters, dims))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    v = c[rng.integers(0, clusters, n)] + width * rng.standard_normal((n, dims)) / math.sqrt(dims)
    return np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)


@pytest.mark.parametrize("clusters", [1, 40, 3000])
def test_cover_tree_holds_its_levels(clusters):
    x = clustered(np.random.default_rng(clusters), 1500, 16, clusters, 0.2).astype(float)
    x[700:900] = x[3]
    root, levels = cover_tree.cover_tree(x)
    above = np.zeros(1, np.int64)
    for radius, net, parents in levels:
        between = np.sqrt(((x[net][:, None] - x[net][None]) ** 2).sum(2))
        np.fill_diagonal(between, np.inf)
        assert between.min() > radius and set(above) <= set(net)  # apart, nested
        assert np.sqrt(((x[:, None] - x[net][None]) ** 2).sum(2)).min(1).max() <= radius  # covering
        assert (np.sqrt(((x[net] - x[parents]) ** 2).sum(1)) <= 2 * radius).all() or len(above) == 1
        above = net
    nodes = [root]
    while nodes:
        n = nodes.pop()
        assert np.sqrt(((x[n.rows] - n.centre) ** 2).sum(1)).max() <= n.radius + 1e-9
        assert sorted(n.rows) == sorted([*n.solo, *(r for g in n.groups for r in g.rows)])
        nodes += n.groups
    assert sorted(root.rows) == list(range(1500)) and (root.groups or len(root.solo) > 1)


@pytest.mark.parametrize("dims, clusters, width, share", [(64, 40, 0.3, 0.2), (8, 200, 0.1, 0.1), (64, 4000, 0.1, 1.0)])
def test_cover_tree_prunes(dims, clusters, width, share):
    """Unit vectors of the tables' size: clusters are left out, vectors without clusters cannot be."""
    d = clustered(np.random.default_rng(8), 4000, dims, clusters, width)
    q, ids = d[::50], np.arange(4000)
    scores, found, work = cover_tree.dual_search(q, ids[::50], d, ids, 5)
    for i, own in enumerate(ids[::50]):
        s = sorted(((-int(x), j) for j, x in enumerate(d @ q[i]) if j != own))[:5]
        assert sorted(zip(-scores[i], found[i])) == s
    assert work <= share * len(q) * len(d)


def test_cover_tree_sends_no_cells_without_hits(spark):
    v = clustered(np.random.default_rng(9), 2000, 16, 10, 0.1)
    df = spark.createDataFrame([(i, (x / 256).tolist()) for i, x in enumerate(v)] + [(0, (v[0] / 256).tolist()), (5000, [1.0] * 3), (5050, [2.0] * 3)],
                               "vec_id long, embedding array<double>")
    data = cover_tree.integer_vectors(df).withColumn("ask", F.col("id") % 50 == 0)
    cells, centres = cover_tree._dealt(data, 5, 40, 400)
    pairs = [p for p in cover_tree._pairs(cells, centres, 64, 8) if p[0] == 16]
    seen = cells.where("dim = 16").groupBy("cell").agg(F.count(F.when(F.col("ask"), 1)).alias("n")).collect()
    assert len(pairs) < 0.5 * len(seen) * sum(r["n"] > 0 for r in seen)
    got = cover_tree.top_k(df, F.col("id") % 50 == 0, data_block=64, query_block=8, sample=400, pivots=40).collect()
    exp = set()
    rows = [*enumerate(v), (0, v[0])]
    for q in range(0, 2000, 50):
        s = sorted(((-int(v[q] @ x), i) for i, x in rows if i != q))[:5]
        exp |= {(q, k + 1, i, -x) for k, (x, i) in enumerate(s)}
    assert {tuple(r) for r in got} == exp | {(5000, 1, 5050, 6 * 256 ** 2), (5050, 1, 5000, 6 * 256 ** 2)}


# -- 3 ------------------------------------------------------------------------------

def word_sets(pairs):
    out = {}
    for i, t in pairs:
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", b)
        out[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def test_ngram_join(spark, docs):
    rng = random.Random(1)
    pairs, common_part = [], text(rng, 60)
    for i in range(40):
        pairs.append((i, text(rng, rng.randrange(1, 120))))
    base = text(rng, 100)
    pairs += [(100 + i, edit(rng, base, rng.randrange(0, 4))) for i in range(60)]         # a large group of near copies
    pairs += [(200 + i, common_part + " " + text(rng, rng.randrange(2, 30))) for i in range(40)]  # a shared passage
    pairs += [(300 + i, "same words here") for i in range(30)] + [(400, None), (401, ""), (402, " \n\t"), (403, "x " * 30000)]
    s = word_sets(pairs)
    links = [(a, b) for a, b in itertools.combinations(sorted(s), 2) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    exp = roots(s, links)
    df = docs(pairs)
    for often in (2, 16):  # few frequent tokens, and nearly all
        got = ngram_join.join_components(df, often=often).collect()
        assert len(got) == len(pairs)
        assert all(r["n_shingles"] == len(s[r["doc_id"]]) and r["component_id"] == exp[r["doc_id"]] for r in got)
    kept = ngram_join.stage(spark, df.unionByName(df.where("doc_id < 3")), "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(exp.values()))


def test_ngram_join_cases(docs):
    df = docs([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None)])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(df).collect()), key=repr)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 0, None)], key=repr)
    assert ngram_join.join_components(df.limit(0)).count() == 0


def test_ngram_join_links_through_null_ids(docs):
    """Texts without an id that alone join documents pass the link on."""
    rng = random.Random(13)
    pairs = []
    for k in range(12):
        w = [rng.choice(WORDS) for _ in range(120)]
        head = " ".join(w[:105])
        tail = " ".join(w[15:])
        pairs += [(100 * k + 1, head), (None, " ".join(w)), (100 * k + 2, tail)]
    s = word_sets([(i, t) for i, (_, t) in enumerate(pairs)])
    near = lambda a, b: 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])
    assert all(near(i, i + 1) and near(i + 1, i + 2) and not near(i, i + 2) for i in range(0, len(pairs), 3))
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.join_components(docs(pairs)).collect())
    assert got == sorted([(0, 100 * k + 1) for k in range(12)] + [(100 * k + e, 100 * k + 1) for k in range(12) for e in (1, 2)])


def test_join_rest_takes_a_pair_once(spark):
    """Two sets of different components meet in one of their common lists, however many these are."""
    nodes = spark.createDataFrame([(n, [0] * ngram_join.LONGS) for n in (1, 2, 3, 4)], "node long, bitmap array<long>")
    many = range(100, 100 + 3 * ngram_join.LOW)
    left = [(s, n, 50, n) for s in many for n in (1, 2)]
    left += [(s, 3, 50, 2) for s in many]                               # of 2's component
    left += [(s, 4, 50, 4) for s in range(ngram_join.LOW)] + [(s, 4, 50, 4) for s in list(many)[-2:]]  # only lists that no one takes along
    got = sorted(tuple(r) for r in ngram_join._rest(spark.createDataFrame(left, "sig long, node long, n int, component long"), nodes, 80).collect())
    assert [x for x in got if 4 not in x] == [(1, 2), (1, 3)]
    assert set(got) == {(1, 2), (1, 3), (1, 4), (2, 4), (3, 4)}


# -- 4 ------------------------------------------------------------------------------

def test_line_dedup(spark, docs):
    rng = random.Random(4)
    line = text(rng, 30)
    pairs = [(1, f"{line}\nshort\n{text(rng, 20)}"), (2, f"{text(rng, 15)}\n  {line.upper()} "), (3, edit(rng, line, 1)), (4, "short"),
             (5, None), (6, ""), (None, line), (7, "z" * 50000)] + [(10 + i, text(rng, 12)) for i in range(20)]
    df = docs(pairs)
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert out[1]["_gone"] == [] and out[2]["_gone"] == [1] and out[3]["_gone"] == [0]
    assert out[4]["_gone"] == [0] and out[4]["_rest"] == ""  # short lines take part
    assert out[2]["_rest"] == pairs[1][1].split("\n")[0] and out[5]["_rest"] is None and out[6]["_rest"] == ""
    assert out[7]["_rest"] == "z" * 50000 and out[None]["_gone"] == [] and all(out[10 + i]["_gone"] == [] for i in range(20))
    kept = line_dedup.stage(spark, df, "")
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in pairs} - {3, 4}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_reads_whole_lines(docs):
    """Lines that agree in the first characters of their words, or have no blanks, go only if they are alike throughout."""
    rng = random.Random(14)
    tail = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    cjk = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    tabs = lambda: "2024-01-01\t" + "\t".join(tail(7) for _ in range(8))
    words = lambda: " ".join(f"identifier{tail(25)}" for _ in range(4))
    makers = [lambda: f"https://www.{tail(60)}", lambda: "今天我们在这里讨论天气" + cjk(50), tabs, words, lambda: "https://www." + "é" + tail(60)]
    lines = [make() for make in makers for _ in range(8)]
    same = [(100 + i, t[:-2] + ("日" if i % 2 else "q") + t[-1:]) for i, t in enumerate(lines)]  # one character near the end: alike
    out = {r["doc_id"]: r["_gone"] for r in line_dedup.dedup_lines(docs([(i, t) for i, t in enumerate(lines)] + same)).collect()}
    assert all(out[i] == [] for i in range(len(lines)))
    assert all(out[i] == [0] for i, _ in same)


def test_line_dedup_of_short_lines(docs):
    """Short lines go as repeats like any others, blank ones never; one character more makes another line."""
    df = docs([(1, "ab\n\n  \nAB \nabc"), (2, "ab\n\n\t\nabcd"), (3, "\u3000\n\r\nabc\né"), (4, "e\nÉ\n日本\na  b"), (5, "日本\n日本語\na b")])
    out = {r["doc_id"]: (r["_gone"], r["_lines"]) for r in line_dedup.dedup_lines(df).collect()}
    assert out == {1: ([3], 5), 2: ([0], 4), 3: ([2], 4), 4: ([1], 4), 5: ([0, 2], 3)}


@pytest.mark.parametrize("groups, spread", [(1, 300), (30, 10)])
def test_line_dedup_groups_settle(spark, docs, groups, spread):
    """Many variants of a line, few of them like the one that bands compare first: all links are found, in star rounds or after them."""
    rng = random.Random(groups)
    base = [text(rng, 30) for _ in range(groups)]
    pairs = [(g * spread + k, edit(rng, t, rng.randrange(0, 3))) for g, t in enumerate(base) for k in range(spread)]
    s = {i: {t[k:k + 10] for k in range(len(t) - 9)} for i, t in pairs}
    links = [(a, b) for a, b in itertools.combinations(sorted(s), 2) if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    exp = {i for i, c in roots(s, links).items() if c != i}
    got = {r["doc_id"] for r in line_dedup.dedup_lines(docs(pairs)).collect() if r["_gone"]}
    assert got <= exp and len(got) >= 0.99 * len(exp)


def test_line_dedup_stage_keeps_short_lines(spark, docs):
    """A document goes only if nothing but blanks is left; short unique lines stay."""
    shared = text(random.Random(16), 20)
    poem = "\n".join(f"verse {i}" for i in range(100))
    df = docs([(1, shared), (2, f"{poem}\n{shared}"), (3, f" \n{shared}\n\t\u3000\n"), (4, f"{shared}\n五言絶句"), (5, shared.upper())])
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.stage(spark, df, "").collect()}
    assert kept == {1: (shared, len(shared)), 2: (poem, len(poem)), 4: ("五言絶句", 4)}


def test_line_dedup_brute_force(spark, docs):
    rng = random.Random(15)
    shingle = lambda t: {t[k:k + line_dedup.SHINGLE] for k in range(max(1, len(t) - line_dedup.SHINGLE + 1))}
    base = [text(rng, 40) for _ in range(10)] + ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(120)) for _ in range(5)] + ["=-" * 150, "日本" * 5 + "😀" * 9]
    pairs = [(17 * k + i, t if not k else t[:(p := rng.randrange(len(t)))] + rng.choice("xé日😀") * rng.randrange(1, 4) + t[p + k:]) for k in range(5) for i, t in enumerate(base)]
    s = {i: shingle(re.sub(" +", " ", t.strip(" ").lower())) for i, t in pairs}
    links = [(a, b) for a, b in itertools.combinations(sorted(s), 2) if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    exp = roots(s, links)
    out = {r["doc_id"]: r["_gone"] for r in line_dedup.dedup_lines(docs(pairs)).collect()}
    assert {i for i, gone in out.items() if gone} == {i for i, c in exp.items() if c != i}
    df = spark.createDataFrame([(t,) for t in ["a" * 500, "ab" * 300, text(rng, 200), "é日😀" * 4, "short"]], "t string")
    for r in df.select(line_dedup.sketch(line_dedup.shingles(F.col("t"))).alias("k"), line_dedup.shingles(F.col("t")).alias("h"), "t").collect():
        assert r["k"] == sorted(set(r["h"]))[:line_dedup.KEPT] and len(r["h"]) == max(1, len(r["t"]) - 9) and len(set(r["h"])) == len(shingle(r["t"]))


# -- 5 ------------------------------------------------------------------------------

def distance_within(s, notice):
    """Least edit distance of the notice to any part of ``s``."""
    row = [0] * (len(s) + 1)
    for i, x in enumerate(notice, 1):
        new = [i]
        for j, y in enumerate(s, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_license_scan(docs):
    rng = random.Random(5)
    pairs = [(1, "All rights-reserved. CC BY cc, by all RIGHTS reserved"), (2, None), (3, ""), (4, "ccby general  public\nlicense"), (5, "é cc by"), (6, "x " * 20000)]
    for i, (_, notice) in enumerate(license_scan.NOTICES):
        for e in range(6):
            t = list(notice)
            for _ in range(e):
                t[rng.randrange(len(t))] = rng.choice("abcdefgh")
            pairs.append((100 + 10 * i + e, text(rng, 10) + " " + "".join(t) + " " + text(rng, 10)))
    got = {r["doc_id"]: r for r in license_scan.scan(docs(pairs)).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (10, 4, 0, 7, "cc-by,reserved")
    assert got[2]["n_words"] == 0 and got[2]["first_word"] is None and got[2]["labels"] == "" and got[3]["score"] == 0.0
    assert got[4]["base_labels"] == "gpl" and got[4]["first_word"] == 1 and got[5]["first_word"] == 1 and got[6]["n_words"] == 20000
    for i, t in pairs:
        s, _ = license_scan.normalise(t)
        if len(s) < 1000:
            exp = {label for label, notice in license_scan.NOTICES if distance_within(s, notice) <= int(len(notice) * license_scan.ERRORS)}
            assert {x["label"] for x in got[i]["spans"]} == exp
    assert license_scan.scan(docs([(1, "a")]).limit(0)).count() == 0


# -- 6 ------------------------------------------------------------------------------

def test_quality(spark, docs):
    rng = random.Random(6)
    good = [(i, ". ".join(text(rng, 8).capitalize() for _ in range(6)) + ".") for i in range(120)]
    bad = [(1000 + i, " ".join(f"{w}$$$ %%%" for w in text(rng, 40).upper().split())) for i in range(60)]
    df = docs(good + bad + [(5000, None), (5001, ""), (None, good[0][1])])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:60]] + [(i, 0, 0) for i, _ in bad[:30]] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.resample(df, labels).collect()}
    assert {i for i, _ in good} <= kept and not kept & {i for i, _ in bad} and not kept & {5000, 5001}
    assert quality.stage(spark, df.limit(0), "/root/testdata/sf0.001").count() == 0
    scores = quality.resample(df, labels, k=10)
    assert scores.count() == 10
    cut = spark.range(30000).select((F.col("id") % 7000).cast("double").alias("v"))
    assert quality.kth_largest(cut, "v", 9) == sorted((i % 7000 for i in range(30000)), reverse=True)[8]


def plain_features(t):
    """Per kind the buckets of a text's n-grams, sign by sign and word by word."""
    sign = lambda b: 97 if b >= 128 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
    signs = [sign(b) for b in (t or "").encode()]
    shape = []
    for i in range(len(signs) - 4):
        g = 0
        for x in signs[i:i + 5]:
            g = (g * 257 + x) % 2 ** 64
        shape.append(int(mix(np.array([g], np.uint64))[0]) % quality.BUCKETS)
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    back = [next((k for k in range(1, quality.WINDOW + 1) if i >= k and w[i - k] == w[i]), 0) for i in range(len(w))]
    return shape, back


def test_quality_ratios_and_sample(spark, docs):
    rng = random.Random(66)
    texts = [(i, text(rng, rng.randint(1, 60)) + (" !! 77 XX" * rng.randint(0, 3) if i % 3 else ".")) for i in range(60)]
    texts += [(100, texts[0][1]), (101, texts[0][1] * 200), (102, "ab"), (103, None), (104, " ")]
    good = {i for i, _ in texts if i % 3 == 0 and i < 40}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    raw, target = [{}, {}], [{}, {}]
    found = {i: plain_features(t) for i, t in texts}
    for i, kinds in found.items():
        for kind, f in enumerate(kinds):
            for x in f:
                raw[kind][x] = raw[kind].get(x, 0) + 1
                if i in good:
                    target[kind][x] = target[kind].get(x, 0) + 1
    weight = [{}, {}]
    for kind in range(2):
        share = sum(target[kind].values()) / sum(raw[kind].values())
        a = {x: target[kind].get(x, 0) + 0.5 * min(1, n * share) for x, n in raw[kind].items()}
        b = {x: n * share + 0.5 * min(1, n * share) for x, n in raw[kind].items()}
        weight[kind] = {x: math.log(a[x] / sum(a.values())) - math.log(b[x] / sum(b.values())) for x in a}
    exp = {i: sum(weight[kind][x] for kind in range(2) for x in f[kind]) for i, f in found.items()}
    noise = {r["doc_id"]: r["g"] for r in docs(texts).select("doc_id", quality.gumbel(F.col("doc_id"), quality.SEED).alias("g")).collect()}
    able = [i for i in exp if any(found[i])]
    assert 103 not in able and 104 not in able and 102 in able  # "ab": one word, no shape
    for k in (1, 7, 30):
        rows = {r["doc_id"]: r for r in quality.resample(docs(texts), labels, k=k).collect()}
        best = sorted(able, key=lambda i: -(round(exp[i], 6) + noise[i]))[:k]
        assert set(rows) == set(best)
        assert all(abs(r["_ratio"] - exp[i]) < 1e-4 and abs(r["_key"] - exp[i] - noise[i]) < 1e-4 for i, r in rows.items())


def test_quality_draws_in_proportion(spark):
    """Of three documents the first place goes to each as often as its share of the ratios says."""
    ratio = F.col("id") % 3
    best = (spark.range(60000).select((F.col("id") / 3).cast("long").alias("trial"), ratio.alias("r"),
                                      (ratio + quality.gumbel(F.col("id"), quality.SEED)).alias("key"))
            .groupBy("trial").agg(F.max_by("r", "key").alias("r")).groupBy("r").count().collect())
    total = sum(math.exp(x) for x in range(3))
    for r in best:
        assert abs(r["count"] / 20000 - math.exp(r["r"]) / total) < 0.015


def test_quality_odd_tables(spark, docs):
    rng = random.Random(67)
    df = docs([(i, text(rng, 20)) for i in range(10)] * 2).withColumn("_key", F.lit("mine")).withColumn("_score", F.lit(5))
    out = quality.stage(spark, df, "/root/testdata/sf0.001")
    assert out.columns == df.columns and {(r["_key"], r["_score"]) for r in out.collect()} <= {("mine", 5)}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.resample(df, none).count() == 20  # no labels: all stay
    assert quality.resample(df, none, k=3).count() in (4, 6)  # rows of one id have one key and stay together


# -- 7 ------------------------------------------------------------------------------

def test_chat_format(spark):
    rng = random.Random(7)
    bits = ["<|im_end|>", "<|", "<\\|", "|>", "\n", " ", "é", "日本", "ok", "<|im_start|>assistant", "\\", "😀", "<"]
    rows = [(c, t, rng.choice(["user", "assistant", None, "<|im_sep|>"]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12))))
            for c in range(40) for t in range(rng.randrange(1, 6))] + [(50, 1, "assistant", None), (50, 1, "assistant", None), (None, 0, "assistant", "hi")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = chat_format.format_conversations(df, tokenizer_path("byte_bpe_50k.json"))
    got = {r["conv_id"]: r for r in chat_format.digests(out).collect()}
    assert len(got) == 42
    for c in got:
        own = [r for r in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode())) if r[0] == c]
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest() and got[c]["n_turns"] == len(own)
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[c]["loss_chars"] == len(loss)
    assert chat_format.format_conversations(df.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


# -- 8 ------------------------------------------------------------------------------

def all_segmentations(t, p):
    """Every piece sequence of a text of one or more words, with its probability."""
    data, off = next(slices(pa.array([t])))[1:]
    flat, border, _ = lattice.words_of(data, off)
    lat = lattice.Lattice(flat, border, p)
    out = {(): 0.0}
    for w in range(len(border) - 1):
        grown, todo = {}, [(border[w], (), 0.0)]
        while todo:
            at, ids, lp = todo.pop()
            if at == border[w + 1]:
                grown[ids] = lp
                continue
            for e in range(lat.first[at], lat.first[at + 1]):
                todo.append((lat.end[e], (*ids, int(lat.piece[e])), lp + lat.logp[e]))
        out = {(*a, *b): x + y for a, x in out.items() for b, y in grown.items()}
    return out


def test_lattice_edges():
    """Pieces are found by a table over their top bits, also where several share these; places keep long pieces first."""
    p = lattice.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    top = p.hashes >> np.uint64(44)
    assert p.most == np.unique(top, return_counts=True)[1].max() > 1
    whole = {bytes(p.data[p.begin[i]:p.begin[i + 1]]): int(i) for i in p.ids}
    crowded = p.ids[np.flatnonzero(np.concatenate([[False], top[1:] == top[:-1]]))]
    words = [bytes(p.data[p.begin[i]:p.begin[i + 1]]) for i in crowded] + [b"\xff", "é日😀".encode(), b"\xff" * 3 + b"the", b"x" * 400, b"", b"q"]
    data = np.frombuffer(b"".join(words), np.uint8)
    border = np.concatenate([[0], np.cumsum([len(w) for w in words if w])])
    lat = lattice.Lattice(data, border, p)
    longest = max(map(len, whole))
    for w, begin in zip([w for w in words if w], border):
        for i in range(len(w)):
            edges = [(begin + j, whole[w[i:j]]) for j in range(min(len(w), i + longest), i, -1) if w[i:j] in whole]
            edges += [(begin + i + 1, int(p.byte_id[w[i]]))] * (w[i] != lattice.BLANK)
            e = slice(lat.first[begin + i], lat.first[begin + i + 1])
            assert list(zip(lat.end[e].tolist(), lat.piece[e].tolist())) == edges and (lat.start[e] == begin + i).all()


def test_lattice_samples():
    p = lattice.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    every = all_segmentations("a cat", p)
    assert abs(sum(math.exp(v) for v in every.values()) - 1) < 1e-9
    n = 6000
    _, data, off = next(slices(pa.array(["a cat"] * n)))
    found = list(lattice.sample_texts(data, off, mix(np.arange(n).astype(np.uint64)), p, 3))[:-1]
    seqs = [[tuple(int(x) for x in ids[first[t]:first[t + 1]]) for t in range(n)] for ids, first, *_ in found]
    for (ids, first, lp, *_), s in zip(found, seqs):
        assert all(abs(every[x] - lp[t]) < 1e-6 for t, x in enumerate(s))
    assert all(len({s[t] for s in seqs}) == 3 for t in range(n))
    for a, b in itertools.permutations(sorted(every, key=every.get)[-3:], 2):
        exact = math.exp(every[a] + every[b]) / (1 - math.exp(every[a]))
        share = sum(x == a and y == b for x, y in zip(*seqs[:2])) / n
        assert abs(share - exact) < 5 * math.sqrt(exact / n) + 1e-3


def test_lattice_round_trip(docs):
    rng = random.Random(8)
    pairs = [(1, None), (2, ""), (3, " "), (4, "  two  blanks "), (5, "é▁日本\n\t😀"), (6, "x" * 3000), (7, "y"), (None, "n")] + [(10 + i, text(rng, 30)) for i in range(20)]
    rows = lattice.encode(docs(pairs + [(10, pairs[8][1])]), tokenizer_path("piece_bpe_32k.model")).collect()
    assert all(r["exact"] and 0 < r["inclusion"] <= 1 for r in rows)
    assert sorted(r["sample"] for r in rows if r["doc_id"] == 2) == [1] and {r["n_tokens"] for r in rows if r["doc_id"] == 1} == {0}
    same = [r["ids"] for r in rows if r["doc_id"] == 10 and r["sample"] == 1]
    assert len(same) == 2 and same[0] == same[1]
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert all(sp.decode(list(r["ids"])) == dict(pairs)[r["doc_id"]] for r in rows if r["doc_id"] and r["doc_id"] >= 10)
    assert lattice.encode(docs(pairs).limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0


# -- 9 ------------------------------------------------------------------------------

def test_chunk_dedup(docs):
    rng = random.Random(9)
    passage = text(rng, 60)
    pairs = [(i, f"{text(rng, rng.randrange(5, 90))} {passage} {text(rng, rng.randrange(0, 50))}") for i in range(30)]
    pairs += [(100 + i, text(rng, 100)) for i in range(40)] + [(200, None), (201, ""), (None, passage), (202, "é日" * 20000)]
    df = docs(pairs)
    got = chunk_dedup.passages(df).collect()
    assert {r["doc_id"] for r in got} - {202} == set(range(30))
    whole = dict(pairs)
    assert sum(r["n_later"] == 0 for r in got if r["doc_id"] < 100) == 1
    for r in got:
        if r["doc_id"] < 100:
            own = whole[r["doc_id"]].encode()[r["start"]:r["end"]].decode()
            assert len(set(own.split()) & set(passage.split())) >= 25
    out = {r["doc_id"]: r["text"] for r in chunk_dedup.dedup(df).collect()}
    assert out[0] == whole[0] and len(out[5]) < len(whole[5]) and all(out[i] == whole[i] for i in range(100, 140))
    assert out[200] is None and out[201] == "" and chunk_dedup.passages(df.limit(0)).count() == 0


def test_chunk_dedup_whole_passages(docs):
    """Passages of 51 words, in two documents each, are found to their true borders; so are ones without blanks."""
    rng = random.Random(19)
    planted = {k: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(150)) if k >= 200 else text(rng, 51) for k in range(220)}
    pairs = [(2 * k + side, f"{text(rng, rng.randrange(9, 40))} {side} {t} {side} {text(rng, rng.randrange(9, 40))}") for k, t in planted.items() for side in (0, 1)]
    df = docs(pairs)
    whole, got = dict(pairs), {}
    for x in chunk_dedup.passages(df).collect():
        got.setdefault(x["doc_id"], []).append(x)
    assert sum(i in got for i, _ in pairs) >= 0.995 * len(pairs)
    for i, found in got.items():
        assert whole[i].encode()[found[0]["start"]:found[0]["end"]].decode() == f" {planted[i // 2]} "
        assert found[0]["n_words"] == 51 or i >= 400
        assert found[0]["later_bytes"] == (found[0]["end"] - found[0]["start"] if i % 2 else 0)
    left = {x["doc_id"]: x["text"] for x in chunk_dedup.dedup(df).collect()}
    rows = chunk_dedup.with_text_left(df).collect()
    assert {x["doc_id"]: x["text"] for x in rows if x["text"] is not None} == {i: left[i] for i in got} and len(rows) == sum(map(len, got.values()))
    assert all(left[i] == (whole[i].replace(f" {planted[i // 2]} ", "") if i % 2 and i in got else whole[i]) for i in whole)


def test_chunks_resist_shifts():
    rng = random.Random(10)
    t = text(rng, 2000)
    for k in (1, 7, 100):
        _, data, off = next(slices(pa.array([t, "q" * k + t])))
        s, e = chunk_dedup.cuts(data, off)
        d = chunk_dedup.digests(data, s, e)
        a, b = set(d[s < off[1]]), set(d[s >= off[1]])
        assert len(a & b) > 0.9 * len(a)


# -- 10 -----------------------------------------------------------------------------

def test_mixing(spark, docs):
    df = docs([(i, "x" * 10) for i in range(4000)], source=["a", "a", "a", "b"])
    target = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    rate = {r["source"]: r["rate"] for r in mixing.rates(df, target).collect()}
    assert rate == {"a": pytest.approx(2 / 3), "b": pytest.approx(2.0)}
    n = {r["source"]: r["count"] for r in mixing.mix(df, target).groupBy("source").count().collect()}
    assert abs(n["a"] - 2000) < 5 * math.sqrt(2000) and abs(n["b"] - 2000) < 5 * math.sqrt(2000)
    out = mixing.mix(df, target, number="_c")
    assert out.columns == [*df.columns, "_c"] and out.exceptAll(mixing.mix(df.repartition(7), target, number="_c")).count() == 0
    odd = docs([(1, None), (None, "abc"), (2, "")], source=[None])
    assert mixing.mix(odd.withColumn("source", F.lit(None).cast("string")), size=3.0).select("doc_id").distinct().count() <= 3
    assert mixing.mix(df.limit(0)).count() == 0


def test_poisson_steps(spark):
    steps = spark.range(1).select(mixing.poisson_steps(F.lit(3.0)).alias("c")).first()["c"]
    assert steps[2] == pytest.approx(math.exp(-3) * (1 + 3 + 4.5)) and steps[-1] == pytest.approx(1.0)


@pytest.mark.parametrize("rate", [700.0, 701.0, 800.0, 6000.0])
def test_poisson_steps_of_large_rates(spark, rate):
    steps = np.array(spark.range(1).select(mixing.poisson_steps(F.col("id") + F.lit(rate)).alias("c")).first()["c"])
    k, p = np.arange(len(steps)), np.diff(steps, prepend=0.0)
    assert steps[-1] == pytest.approx(1.0) and (p >= 0).all()
    mean = (k * p).sum()
    assert mean == pytest.approx(rate, rel=1e-9) and ((k - mean) ** 2 * p).sum() == pytest.approx(rate, rel=1e-6)
    exact = [math.exp(x * math.log(rate) - rate - math.lgamma(x + 1)) for x in k]
    assert p == pytest.approx(exact, abs=1e-11)


def test_mixing_of_a_tiny_source(spark, docs):
    """A tiny source's documents are drawn, not all replicated by the same count."""
    df = docs([(i, "x") for i in range(200)], source="b").unionByName(docs([(1000, "x" * 200 * 799)], source="a"))
    target = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "source string, weight double")
    assert {r["source"]: r["rate"] for r in mixing.rates(df, target).collect()}["b"] == pytest.approx(800.0)
    n = np.array([r["count"] for r in mixing.mix(df, target).groupBy("doc_id").count().collect()])
    assert len(n) == 200 and abs(n.mean() - 800) < 5 * math.sqrt(800 / 200) and 0.6 * 800 < n.var() < 1.5 * 800
