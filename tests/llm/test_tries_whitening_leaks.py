"""Conversation trie, whitening and decontamination against the slow way."""

import hashlib
import math
import os
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from snapforge.llm import conversation_trie, decontamination, queries, whitening  # noqa: E402
from tools.check import connect, oracle_rows, spark_rows  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, folder, name):
    _, _, got = spark_rows(queries.QUERIES[name](spark, folder))
    assert got == oracle_rows(connect(folder), queries.ORACLES[name])[2] and got


# Conversations


def trie(rows, rebuild=True):
    """rows: (conv_id, turn, role, text) -> {(conv_id, depth): other columns}."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, code, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        full = {c: own.get(c - int(math.fmod(c, 20)), [])[: h[c]] + own[c][h[c] :] for c in own}
    else:
        full = own
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}
    for p, ms in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in ms if len(full[c]) == len(p))))
        out[min(ms), len(p)] = (
            min(members[p[:-1]]) if p else None, len(ms), len(kids.get(p, [])), sum(q not in kids for q in under),
            sum((len(members[q]) - 1) * len(brute.SPACE.findall(q[-1][1])) for q in under if q), brute.sha(ends),
        )
    return out


def found(df):
    return {(r.conv_id, r.depth): tuple(r)[2:8] for r in df.collect()}


ODD_TURNS = [
    (20, 0, "user", "hello there"), (20, 1, "bot", "hi"), (20, 1, "bot", "hi"), (20, None, None, None), (21, 5, "user", "x y z"),
    (22, 0, "user", "hello there"), (22, 1, "bot", "hi"), (22, 2, "user", ""), (22, 3, None, "tail"), (22, 3, "user", "tail"), (-3, 0, "user", "a"),
    (45, 0, "user", "a"), (46, 0, "user", "a"), (46, 1, "bot", "b c"), (None, 0, "user", "nobody"), (47, 2**40, "user", "w " * 3000), (7, 0, "user", "hello there"),
]


def test_trie_of_the_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_conversation_trie(spark, folder)) == trie(rows)


@pytest.mark.parametrize("block", [1 << 14, 6])
def test_trie_odd(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    monkeypatch.setattr(conversation_trie, "SIBLINGS", min(block, 512))
    frame = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({c: F.lit(1) for c in ("id", "depth", "pos", "block", "words", "rank")})
    assert found(conversation_trie.rebuilt_trie(frame)) == trie(ODD_TURNS)
    assert found(conversation_trie.prefix_trie(frame)) == trie(ODD_TURNS, rebuild=False)
    assert conversation_trie.rebuilt_trie(frame.limit(0)).count() == 0


def test_a_long_and_a_common_conversation(spark, monkeypatch):
    """One conversation longer than a block, and one opening that most conversations share."""
    monkeypatch.setattr(conversation_trie, "BLOCK", 64)
    monkeypatch.setattr(conversation_trie, "SIBLINGS", 16)
    rows = [(1, i, "user", f"t{i}") for i in range(300)] + [(c, i, "user", f"t{i}" if i < 2 else f"own {c}") for c in range(100, 220) for i in range(4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes = conversation_trie.prefix_trie(frame)
    assert found(nodes) == trie(rows, rebuild=False)
    assert sorted(r.place for r in nodes.collect())[0] == 0


def test_list_ranking(spark, monkeypatch):
    """A list in random order needs many rounds; sums are those of a walk along it."""
    monkeypatch.setattr(conversation_trie, "BLOCK", 50)
    rng = np.random.default_rng(4)
    order = rng.permutation(700)
    following = np.full(700, -1)
    following[order[:-1]] = order[1:]
    weights = rng.integers(0, 9, (700, 2))
    rows = [(i, int(following[i]), 1, int(weights[i, 0]), int(weights[i, 1])) for i in range(700)]
    got = {r.id: tuple(r)[1:] for r in conversation_trie.rank_list(spark.createDataFrame(rows, "id long, next long, w0 long, w1 long, w2 long")).collect()}
    before = np.concatenate([[[0, 0]], np.cumsum(weights[order], axis=0)])
    assert got == {int(x): (n, int(before[n, 0]), int(before[n, 1])) for n, x in enumerate(order)}


# Whitening


def test_whitening_of_the_table(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    x = np.floor(1024 * np.array([r.embedding for r in vectors.orderBy("vec_id").collect()], float)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    covariance = np.cov(x.T, bias=True)
    values, axes = np.linalg.eigh(covariance)
    want = ((x - sums / n) @ axes / np.sqrt(values))[:, ::-1]
    rows = sorted(queries.op12_whitening(spark, folder).collect(), key=lambda r: (r.component, r.vec_id))
    assert len(rows) == 8 * n
    got = np.array([r.whitened for r in rows]).reshape(8, n).T
    signs = np.sign((got * want[:, :8]).sum(axis=0))
    assert np.allclose(got * signs, want[:, :8], atol=1e-9)
    assert [r.deviation for r in rows[:n]] == [int(d) for d in ((n * x - sums) ** 2).sum(axis=1)]
    assert all(r.explained == pytest.approx(values[-r.component] / np.trace(covariance), rel=1e-12) for r in rows)
    assert {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-12


def test_whitening_odd(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [math.nan] * 4), (104, [math.inf, 0.0, 0.0, 0.0]), (105, [1.0] * 3), (106, [1e30, 0.0, 0.0, 0.0])]
    same = [(7, rows[7][1]), (None, [0.5, 0.5, 0.5, 0.5])]
    frame = spark.createDataFrame(rows + bad + same, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("n", "component", "i", "row")})
    got = whitening.whiten(frame).collect()
    assert len(got) == 42 * 4 and {r.n for r in got} == {42} and {r.component for r in got} == {1, 2, 3, 4}
    assert max(r.identity_error for r in got) < 1e-12 and sum({r.component: r.explained for r in got}.values()) == pytest.approx(1)
    assert len([r for r in got if r.vec_id == 7]) == 8 and len([r for r in got if r.vec_id is None]) == 4
    assert whitening.whiten(frame.filter("vec_id > 99")).count() == 0  # one vector has no variance
    assert whitening.whiten(frame.limit(0)).count() == 0


def test_deviations_beyond_a_long_are_null():
    center = whitening.Center(10**9, (10**9 * 100_003, 7 * 10**9))
    x = np.array([[100_003, 7], [100_004, 9], [103_003 + 10**6, 7]], np.int64)
    assert center.deviations(x) == [0, 5 * 10**18, None]


def spectra():
    yield "spread", np.linspace(1, 40, 40)
    yield "clusters", np.array([5.0] * 9 + [5.0 + 1e-9] * 6 + [1.0] * 15)
    yield "steep", 10.0 ** -np.arange(0.0, 12, 0.4)
    yield "low rank", np.array([9.0, 9.0, 4.0] + [0.0] * 20)
    yield "one", np.array([3.0])


@pytest.mark.parametrize("name, values", list(spectra()))
def test_eigenpairs(spark, name, values):
    rng = np.random.default_rng(1)
    turn, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    matrix = turn * values @ turn.T
    matrix = (matrix + matrix.T) / 2
    inertia = whitening.Inertia(matrix)
    for shift in (-1.0, 0.55, 2.0, 4.5, 6.0, 100.0):
        assert inertia.below(shift) == (values < shift).sum()
    got, vectors = whitening.largest_eigenpairs(spark, matrix, 8)
    want = np.sort(values)[::-1][:8]
    want = want[want > 0]
    assert len(got) == len(want) and np.allclose(got, want, rtol=1e-12, atol=1e-13 * want[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-13)
    assert np.linalg.norm(matrix @ vectors - vectors * got, axis=0).max() < 1e-12 * want[0]


def test_contour_solves_do_the_work():
    """A slice of a large spectrum is found by a block that is far smaller than the matrix."""
    rng = np.random.default_rng(2)
    values = np.sort(rng.uniform(0, 100, 300))
    turn, _ = np.linalg.qr(rng.normal(size=(300, 300)))
    matrix = turn * values @ turn.T
    matrix = (matrix + matrix.T) / 2
    low, high = (values[199] + values[200]) / 2, (values[203] + values[204]) / 2
    got, vectors = whitening.feast(matrix, low, high, 4)
    assert np.allclose(np.sort(got), values[200:204], rtol=1e-13) and vectors.shape == (300, 4)


# Decontamination


def leaks(docs, items, size=10):
    """docs: [(doc_id, text)], items: [(item_id, text)] -> sorted rows of the contract."""
    windows = {}
    for i, t in items:
        w = brute.license_words(t)
        k = min(size, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, items_ = brute.license_words(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    hit |= set(range(s, s + k))
                    items_ |= windows[tuple(w[s : s + k])]
        names = sorted(str(x) for x in items_ if x is not None)
        out.append((i, len(w), len(hit), len(names), brute.sha(",".join(names)), bool(hit)))
    return sorted(out, key=str)


LONG_ITEM = " ".join(f"q{i}" for i in range(30))
ITEMS = [(1, LONG_ITEM), (2, "Short Item"), (3, None), (4, ""), (10, LONG_ITEM + " more"), (2, "Short Item"), (None, "no id at all"), (5, "a a a a a a a a a a a a"), (6, "Über-Straße 中文 ok?")]
LEAKY = [
    (1, "so " + LONG_ITEM.upper() + "!"), (2, None), (3, ""), (4, "a short\titem, twice: short item"), (5, " ".join(f"q{i}" for i in range(9))), (6, "a " * 5000),
    (7, "x " + " ".join(f"q{i}" for i in range(5, 16)) + " y"), (7, "x " + " ".join(f"q{i}" for i in range(5, 16)) + " y"), (None, "there is no id at all"), (8, "short"),
    (9, "item short"), (10, "über straße 中文 ok"), (11, "w" * 50_000 + " short item"), (12, "short | item"),
]


def test_leaks_of_the_table(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_decontamination(spark, folder).collect()), key=str)
    assert got == leaks(docs, items) and any(r[-1] for r in got)


@pytest.mark.parametrize("size", [4 << 20, 20])
def test_leaks_odd(spark, monkeypatch, size):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
    extra = {c: F.lit(5) for c in ("n_words", "n_hit", "items", "spans", "row", "a.b")}
    docs = spark.createDataFrame(LEAKY, "doc_id long, text string").withColumns(extra)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n_hit", F.lit(1))
    want = leaks(LEAKY, ITEMS)
    assert sorted((tuple(r) for r in decontamination.contamination_report(docs, bench).collect()), key=str) == want
    clean = decontamination.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(str(r[0]) for r in want if not r[-1])
    assert {r.n_hit for r in clean.collect()} == {5}
    assert decontamination.contamination_report(docs.limit(0), bench).count() == 0
    assert decontamination.contamination_report(docs, bench.limit(0)).filter("contaminated or n_items > 0").count() == 0
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in decontamination.find_overlaps(docs, bench).collect()}
    assert spans[1] == [(1, 31)] and spans[4] == [(1, 3), (4, 6)] and spans[7] == [(1, 12)] and spans[6] == [(0, 5000)]


def test_longest_matches(spark):
    docs = [(i, t) for i, t in LEAKY if i is not None]
    found_ = {(r.item_id, r.start): (r.length, r.doc_id, r.doc_start) for r in decontamination.longest_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    want = {}
    for item, text in ITEMS:
        w = brute.license_words(text)
        for s in range(len(w)):
            for i, t in docs:
                d = brute.license_words(t)
                for p in range(len(d)):
                    k = 0
                    while s + k < len(w) and p + k < len(d) and w[s + k] == d[p + k]:
                        k += 1
                    key = (None if item is None else str(item), s)
                    if k and (key not in want or (-k, i, p) < want[key]):
                        want[key] = (-k, i, p)
    assert found_ == {key: (-k, i, p) for key, (k, i, p) in want.items()}


def test_suffix_arrays_are_sorted():
    rng = np.random.default_rng(3)
    for high in (2, 3, 40, 5000):
        codes = rng.integers(0, high, 3000)
        codes[1000:1400] = codes[400:800]
        array = decontamination.SuffixArray(codes, 4000, int(high).bit_length())

        def suffix(i, codes=codes):
            end = np.flatnonzero(codes[i:] == 0)
            return tuple(codes[i : i + end[0]] if len(end) else codes[i:])

        order = [suffix(i) for i in array.order]
        assert order == sorted(order) and sorted(array.order) == np.flatnonzero(codes).tolist()


def test_small_shards_find_the_same():
    docs = [decontamination.words_of((t or "").encode()) for _, t in LEAKY]
    block = decontamination.Benchmark([(None if i is None else str(i), t) for i, t in ITEMS if t is not None])
    whole = decontamination._match(docs, [block])
    for n, d in enumerate(docs):
        items, edges = decontamination._match([d], [block])
        assert items[0] == whole[0][n] and decontamination.spans_of(edges[0]) == decontamination.spans_of(whole[1][n])
