"""Bit-sliced top-k, Merkle manifest and periodic runs against brute force; registered SQL against its queries."""

import hashlib
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given as generated, settings, strategies as st

from airtrace.llm import bitsliced, merkle, oracles, queries, runs

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
LONG = " ".join(f"word{i % 977} über" for i in range(30_000))
TEXTS = [
    (1, "a b " * 20), (2, None), (3, ""), (4, " \n\t "), (None, "x y z " * 9), (None, None), (5, LONG), (6, "one two\nthree\n"),
    (7, "q" * 200_000), (8, "w " * 50_000), (9, "a b c d e f a b c d e f"), (9, "a b c d e f a b c d e f"), (10, "u a a a a a a b a a a a a a b v"),
    *((i, f"line {i}\nx\n" * (i % 7)) for i in range(11, 60)),
]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.mark.parametrize("name", list(oracles.oracles()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {table} as select * from read_parquet('{FOLDER}/{table}.parquet')")
    got = queries.queries()[name](spark, FOLDER)
    want = con.execute(oracles.oracles()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.fetchall())


# ---------------------------------------------------------------- 11


def best(rows, every, k, scale):
    """Sorted (query, rank, id, score), in whole numbers."""
    width = max([len(v) for _, v in rows if v is not None], default=0)
    whole = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(scale * x) for x in v] + [0] * (width - len(v))))
    out = []
    for q, (i, v) in enumerate(whole):
        if i is not None and i % every == 0:
            near = [(-sum(a * b for a, b in zip(v, w)), j is None, j) for r, (j, w) in enumerate(whole) if r != q]
            out += [(i, n + 1, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, _, j) in enumerate(sorted(near, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], f"vec_id long, embedding array<{kind}>, score int, block string, `rank` double")


def test_top_k_of_odd_vectors(spark):
    deal = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in deal.normal(size=9)]) for i in range(60)]
    rows += [(60, None), (70, [1.0, None]), (80, [math.nan]), (90, [math.inf, 0.0]), (100, []), (110, [0.5]), (None, rows[0][1]), (10, rows[10][1]), (10, rows[10][1]),
             (7, rows[10][1]), (120, [1024.25] * 9), (130, [-3.0] * 9), (-20, rows[10][1])]
    got = bitsliced.top_k(vectors(spark, rows), 10, 5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == best(rows, 10, 5, 1024)
    assert bitsliced.top_k(vectors(spark, []), 10).count() == 0
    assert bitsliced.top_k(vectors(spark, [(0, [1.0])]), 10).count() == 0
    assert [tuple(r) for r in bitsliced.top_k(vectors(spark, [(0, []), (1, [])]), 10).collect()] == [(0, 1, 1, 0)]


def test_scores_of_very_large_components(spark):
    rows = [(i, [float(i) * 5e4, 3.0, -(2.0 ** (i % 5))]) for i in range(40)]
    got = bitsliced.top_k(vectors(spark, rows, "double"), 10, 4)
    assert sorted(map(tuple, got.collect()), key=repr) == best(rows, 10, 4, 1024)
    huge = [(i, [1e12 * (i % 3 - 1), 1.0]) for i in range(12)]  # beyond a long: equal scores, smaller id first
    got = {(r.query_id, r.vec_id): r.score for r in bitsliced.top_k(vectors(spark, huge, "double"), 10, 99).collect()}
    assert got[0, 3] == (1 << 63) - 1 and got[0, 2] == -(1 << 63) and got[0, 1] == 1 << 20


def test_top_k_in_many_small_blocks(spark, monkeypatch):
    deal = np.random.default_rng(4)
    centre = deal.normal(size=(5, 16))
    rows = [(i, (centre[i % 5] + 0.05 * deal.normal(size=16)).tolist()) for i in range(900)]  # groups of near copies
    want = best(rows, 100, 10, 1024)
    for most in (16_384, 37):
        monkeypatch.setattr(bitsliced, "BLOCK_ROWS", most)
        got = bitsliced.top_k(vectors(spark, rows, "double").repartition(3), 100)
        assert sorted(map(tuple, got.collect()), key=repr) == want


@settings(max_examples=60, deadline=None)
@generated(st.integers(1, 200), st.integers(1, 12), st.sampled_from([1, 5, 90, 700, 1e5]), st.integers(0, 10**6), st.integers(1, 12))
def test_boundary_holds_the_best_rows(n, width, spread, seed, k):
    deal = np.random.default_rng(seed)
    rows = np.floor(spread * deal.normal(size=(n, width)))
    rows[:: 3] = rows[0]
    block = bitsliced.Slices(rows)
    for q in (rows[-1], -rows[0], np.zeros(width)):
        score = rows @ q
        least = np.sort(score)[::-1][min(k, n) - 1]
        assert set(np.flatnonzero(score >= least)) <= set(block.boundary(q, k).tolist())


def test_slices_add_and_compare():
    deal = np.random.default_rng(5)
    rows = deal.integers(0, 128, (333, 7)).astype(float)
    block = bitsliced.Slices(rows)
    assert block.step == 1
    weight = np.array([3, -1, 0, 31, -17, 2, 1])
    low = rows - rows.min(axis=0)
    want = (np.where(weight < 0, 127 - low, low) * np.abs(weight)).sum(axis=1)
    slices = block.scores(weight)
    have = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:333].astype(int) << i for i, s in enumerate(slices))
    assert (have == want).all()
    for k in (1, 10, 333):
        assert block.kth(slices, k) == np.sort(want)[::-1][k - 1]
    for least in (0, int(np.median(want)), 10**9):
        assert (block.at_least(slices, least) == np.flatnonzero(want >= least)).all()


# ---------------------------------------------------------------- 12


def tree(leaves):
    paths, nodes = [[] for _ in leaves], [(d, [i]) for i, d in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for at in range(0, len(nodes), 3):
            part = nodes[at:at + 3]
            for j, (_, members) in enumerate(part):
                for m in members:
                    paths[m].append(("".join(d for d, _ in part[:j]), "".join(d for d, _ in part[j + 1:])))
            above.append((sha(*(d for d, _ in part)), sum((m for _, m in part), [])))
        nodes = above
    return nodes[0][0], paths


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        ordered = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (ordered, *tree([leaf(r) for r in ordered]))
    root, tops = tree([trees[s][1] for s in sources]) if sources else (None, [])
    out = Counter()
    for s, top in zip(sources, tops):
        ordered, subroot, paths = trees[s]
        for r, path in zip(ordered, paths):
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            up = leaf((*r[:4], r[4].replace("\n", ""))) if changed else leaf(r)
            for left, right in path + top:
                up = sha(left, up, right)
            out[r[0], leaf(r), subroot, root, sha(*(x for p in path + top for x in p)), up, up == root] += 1
    return out


def test_manifest_of_odd_rows(spark):
    rows = [(i, ["web", None, "", "código", "b", "ab"][n % 6] if n % 2 else "web", [None, "en"][n % 2], n if n % 3 else None, t) for n, (i, t) in enumerate(TEXTS)]
    rows += rows[:3] + [(900, "lone", "en", 5, "a\nb"), (2**63 - 1, "web", None, -4, "\n")]
    schema = "doc_id long, source string, lang string, n_chars long, text string, leaf int, place string, tree int, c0 int, digest string, path string"
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3, "y", "z") for r in rows], schema)
    got = merkle.verify_received(docs)
    assert Counter(map(tuple, got.collect())) == manifest(rows)
    assert merkle.verify_received(docs.limit(0)).count() == 0
    one = docs.where("doc_id = 900")
    assert Counter(map(tuple, merkle.verify_received(one).collect())) == manifest([r for r in rows if r[0] == 900])


def test_manifest_of_many_sources_and_of_pieces(spark, monkeypatch):
    rows = [(i, f"s{i % 40}" if i < 80 else "hot", "en", i, f"t{i}\n") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    monkeypatch.setattr(merkle, "PIECE", 7)
    assert Counter(map(tuple, merkle.verify_received(docs.repartition(5)).collect())) == manifest(rows)


def test_manifest_is_a_small_plan(spark):
    """A driver that plans a join per level and tree of sources runs out of memory."""
    sizes = [1, 2, 3, 4, 9, 10, 26, 27, 28, 81, 82, 244, 730]
    rows = [(i, f"s{size:03}", "en", i, f"t{i}\n") for size in sizes for i in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.verify_received(docs.repartition(3))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3 and plan.count("Relation ") <= 4
    assert Counter(map(tuple, got.collect())) == manifest(rows)


def test_manifest_of_given_tables(spark):
    rows = [tuple(r[c] for c in merkle.FIELDS) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = queries.queries()["op12_merkle_manifest"](spark, FOLDER)
    assert Counter(map(tuple, got.collect())) == manifest(rows)


# ---------------------------------------------------------------- 13


def found_runs(words, least=12):
    """All runs (start, period, end) by comparing at every distance."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at + q < len(words):
            start = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            if at + q - start >= max(least, 2 * q) and at > start:
                out.setdefault((start, at + q), q)
            at += at == start
    return sorted((s, q, e) for (s, e), q in out.items())


def digests(doc_id, text, plant):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = found_runs(words)
    dropped = set()
    for s, q, e in found:
        dropped.update(range(s + q, e))
    top = min(((-(e - s), s, q) for s, q, e in found), default=None)
    longest = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *longest, sha(*(f"{s},{e - s},{q}\n" for s, q, e in found)), hashlib.sha256(kept).hexdigest())


@settings(max_examples=300, deadline=None)
@generated(st.lists(st.lists(st.integers(0, 2), max_size=70), min_size=1, max_size=4), st.integers(0, 9), st.sampled_from([2, 12]))
def test_runs_of_generated_words(texts, times, least):
    texts = [[str(x).encode() for x in t * (1 + times % 3)] for t in texts]
    before, runs.LEAST_WORDS = runs.LEAST_WORDS, least
    try:
        for words, got in zip(texts, runs.runs_of(texts)):
            assert [(s, q, e) for s, e, q in got.tolist()] == found_runs(words, least)
    finally:
        runs.LEAST_WORDS = before


def test_runs_of_words_with_many_runs():
    a, b = ["a"], ["a", "b"]
    while len(b) < 300:
        a, b = b, b + a
    for words in (b, b[::-1], [*"abaab" * 9, *"abab" * 7, *"aab" * 11]):
        words = [w.encode() for w in words]
        assert [(s, q, e) for s, e, q in runs.runs_of([words])[0].tolist()] == found_runs(words)


@pytest.mark.parametrize("together", [250_000, 40])
def test_runs_of_odd_rows(spark, together, monkeypatch):
    monkeypatch.setattr(runs, "TOGETHER", together)
    rows = [(i, t) for i, t in TEXTS if t is None or len(t) < 10_000] + [(i, "v " * 30 + "c d " * 20) for i in range(100, 140)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n_runs int, runs string, start int")
    got = runs.run_digests(runs.collapse_runs(docs, runs.planted))
    assert Counter(map(tuple, got.collect())) == Counter(digests(i, t, True) for i, t in rows)
    assert runs.run_digests(runs.collapse_runs(docs.limit(0))).count() == 0


def test_runs_of_long_texts(spark):
    rows = [r for r in TEXTS if r[1] and len(r[1]) > 10_000]
    got = {r.doc_id: r for r in runs.collapse_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[5].runs] == [(0, 60_000, 1954)] and got[5].collapsed == " ".join(LONG.split()[:1954])
    assert [tuple(r) for r in got[8].runs] == [(0, 50_000, 1)] and got[8].collapsed == "w"
    assert got[7].n_words == 1 and got[7].runs == []


def test_runs_of_given_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = queries.queries()["op13_periodic_runs"](spark, FOLDER)
    want = Counter(digests(i, t, True) for i, t in rows)
    assert Counter(map(tuple, got.collect())) == want and sum(w[1] > 0 for w in want) > 10
