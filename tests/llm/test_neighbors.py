"""Nearest vectors against brute force."""

import numpy as np

from codeweft.llm import neighbors as N

V = "id string, embedding array<float>"


def data(n=600, seed=0, near=0.25):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 64))
    for i in range(0, n, 10):
        for j in range(1, 4):
            x[i + j] = x[i] + near * r.normal(size=64)
    return [(f"n{i:04}", [float(v) for v in row * (1 + i % 3)]) for i, row in enumerate(x.astype(np.float32))]


def brute(rows, least):
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
    return {(min(rows[a][0], rows[b][0]), max(rows[a][0], rows[b][0])) for a, b in zip(i, j)}


def test_error_bound():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = N.quantise(x)
    approx = (q.astype(float) @ q.T.astype(float)) * np.outer(s, s)
    assert (np.abs(approx - x @ x.T) <= e[:, None] + e[None, :] * (1 + e[:, None])).all()


def test_similar_pairs(spark):
    rows = data()
    want = brute(rows, 0.9)
    got = {(r["id_a"], r["id_b"]) for r in N.similar_pairs(spark.createDataFrame(rows, V), 0.9).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and want
    small = {(r["id_a"], r["id_b"]) for r in N.similar_pairs(spark.createDataFrame(rows, V), 0.9, tile=16).collect()}
    assert small == got  # many small tiles find the same


def test_pairs_at_the_threshold(spark):
    rows = data(1500, 5, near=0.46)
    want = brute(rows, 0.9)
    got = {(r["id_a"], r["id_b"]) for r in N.similar_pairs(spark.createDataFrame(rows, V), 0.9).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 50


def test_copies_and_dirt(spark):
    base = data(40, 2)
    e = base[0][1]
    rows = [*base, *[(f"c{i:02}", [2 * v for v in e]) for i in range(5)], *[(f"d{i:02}", e) for i in range(5)], ("n0000", e), ("z0", [0.0] * 64), ("s", [1.0]), ("n", None), (None, e), ("nan", [float("nan")] + [1.0] * 63), ("inf", [float("inf")] + [1.0] * 63)]
    good = {r[0]: r for r in rows if r[0] and r[1] and len(r[1]) == 64 and np.isfinite(r[1]).all() and any(r[1])}
    got = {(r["id_a"], r["id_b"]) for r in N.similar_pairs(spark.createDataFrame(rows, V), 0.9).collect()}
    assert got == brute(list(good.values()), 0.9)
    assert ("d00", "d01") in got and ("c00", "d00") in got


def test_empty(spark):
    none = spark.createDataFrame([], V)
    assert N.similar_pairs(none).count() == 0 and N.top_k(none, none).count() == 0
    one = spark.createDataFrame([("a", [1.0] * 64)], V)
    assert N.similar_pairs(one).count() == 0 and N.top_k(one, one).count() == 0


def test_top_k(spark):
    rows = data(400, 3)
    v = spark.createDataFrame(rows, V)
    q = v.where("id like '%0'")
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    for shard in (50, 100_000):
        got = {}
        for r in N.top_k(q, v, 5, query_block=16, shard_rows=shard).collect():
            got.setdefault(r["query_id"], {})[r["place"]] = r["id"]
        assert len(got) == 40
        for i in range(0, 400, 10):
            assert [got[f"n{i:04}"][p] for p in range(1, 6)] == [f"n{j:04}" for j in np.argsort(-s[i])[:5]]
