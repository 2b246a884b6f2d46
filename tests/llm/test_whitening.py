import math
import random

import numpy as np
import pytest
from conftest import SF001
from parlance.llm.common import read
from parlance.llm.whitening import add_rows, fit_whitening, merge, rank_one, secular_roots, start, to_integers, whiten

VECTORS = "vec_id bigint, embedding array<float>, label int"


def matrices():
    rng = np.random.default_rng(0)
    return {
        "spread": rng.normal(size=(150, 24)) * rng.uniform(0.1, 300, 24),
        "integers": np.floor(rng.normal(size=(120, 16)) * 100),
        "low rank": rng.normal(size=(80, 3)) @ rng.normal(size=(3, 20)),
        "copies": np.repeat(rng.normal(size=(9, 12)), 9, 0),
        "equal eigenvalues": np.vstack([np.eye(10)] * 4) * 7,
        "graded": np.diag(10.0 ** np.arange(0, -12, -1)),
        "two values": rng.integers(0, 2, size=(90, 18)).astype(float),
        "one dimension": rng.normal(size=(9, 1)),
        "zeros": np.zeros((4, 5)),
    }


@pytest.mark.parametrize("name", matrices())
def test_updates_and_merges_equal_a_whole_decomposition(name):
    x = matrices()[name]
    want = np.linalg.eigvalsh(x.T @ x)
    scale = max(want.max(), 1e-300)
    whole = add_rows(start(x.shape[1]), x, np.ones(len(x)))
    parts = [add_rows(start(x.shape[1]), x[k::3], np.ones(len(x[k::3]))) for k in range(3)]
    for d, q in (whole, merge(merge(parts[0], parts[1]), parts[2])):
        assert (np.diff(d) >= 0).all()
        assert np.abs(d - want).max() <= 1e-13 * scale
        assert np.abs(q.T @ q - np.eye(len(d))).max() < 1e-12
        assert np.abs((q * d) @ q.T - x.T @ x).max() <= 1e-13 * scale


def test_weights_are_copies():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(30, 8)), rng.integers(1, 9, 30)
    a, b = add_rows(start(8), x, w), add_rows(start(8), np.repeat(x, w, 0), np.ones(w.sum()))
    assert np.abs(a[0] - b[0]).max() < 1e-12 * a[0].max()


def test_secular_roots_lie_between_the_poles():
    rng = np.random.default_rng(2)
    for k in (1, 2, 3, 40):
        d = np.sort(rng.uniform(0, 1, k)) * 10.0 ** rng.integers(-6, 6)
        z2 = rng.uniform(1e-12, 1, k)
        z2 /= z2.sum()
        near, x = secular_roots(d, z2, 0.7)
        roots = d[near] + x
        assert (roots >= d).all() and (roots[:-1] <= d[1:]).all() and roots[-1] <= d[-1] + 0.7 * (1 + 1e-12)
        want = np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(np.sqrt(z2), np.sqrt(z2)))
        assert np.abs(roots - want).max() <= 1e-13 * max(want.max(), 1)


def test_an_update_along_an_eigenvector_moves_one_value():
    d, q = rank_one(np.array([1.0, 2.0, 3.0]), np.eye(3), np.array([0, 2.0, 0]), 1.0)
    assert np.allclose(d, [1, 3, 6], rtol=1e-14) and np.abs(np.abs(q).sum(0) - 1).max() < 1e-15


def brute(vectors):
    """(id, deviation, whitened) by numpy on the whole table, and e / trace."""
    good = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    good = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in good if len(v) == max(len(w) for _, w in good)]
    n, dim = len(good), len(good[0][1])
    sums = [sum(x[k] for _, x in good) for k in range(dim)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in good]
    y = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for _, x in good])
    e, u = np.linalg.eigh(y.T @ y / n)
    keep = [k for k in range(dim - 1, -1, -1) if e[k] > 1e-12 * e.sum()][:8]
    return [i for i, _ in good], dev, y @ u[:, keep] / np.sqrt(e[keep]), e[keep] / e.sum(), n


def check(got, vectors):
    ids, dev, white, share, n = brute(vectors)
    k = len(share)
    assert len(got) == len(ids) * k
    key = lambda r: (r["vec_id"] is not None, r["vec_id"] or 0, r["deviation"])
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, dev[i]))
    for c in range(k):
        rows = sorted((r for r in got if r["component"] == c + 1), key=key)
        assert [(r["vec_id"], r["deviation"], r["n"]) for r in rows] == [(ids[i], dev[i], n) for i in order]
        mine, want = np.array([r["whitened"] for r in rows]), white[order, c]
        assert abs(abs(mine @ want) / n - 1) < 1e-9  # the same but for the sign
        assert all(abs(r["explained"] / share[c] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in rows)


def test_given_embeddings(spark):
    rows = read(spark, SF001, "embeddings").select("vec_id", "embedding", "label")
    got = whiten(rows.repartition(5)).collect()
    check(got, [(r["vec_id"], r["embedding"]) for r in rows.collect()])


def test_many_partitions_merge_in_rounds(spark):
    rows = read(spark, SF001, "embeddings").selectExpr("vec_id", "slice(embedding, 1, 6) as embedding", "label")
    got = whiten(rows.repartition(40)).collect()
    check(got, [(r["vec_id"], r["embedding"]) for r in rows.collect()])


def test_hard_rows(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 1) * (k + 1) for k in range(10)]) for i in range(60)]
    vectors += [(70, [0.5] * 10)] * 40  # a repeated row with a large share
    vectors += [(None, [rng.gauss(0, 2) for _ in range(10)]), (3, [rng.gauss(0, 1) for _ in range(10)])]
    bad = [(80, None), (81, []), (82, [1.0] * 9 + [None]), (83, [float("nan")] * 10), (84, [float("inf")] + [0.0] * 9), (85, [1.0] * 4)]
    extra = VECTORS + ", id string, x int, component int, n string"
    frame = spark.createDataFrame([(i, v, None, "a", 1, 2, "b") for i, v in vectors + bad], extra)
    got = whiten(frame.repartition(4)).collect()
    check(got, vectors)
    assert len(got) == 8 * len(vectors)


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_spread_there_are_no_components(spark, vectors):
    frame = spark.createDataFrame([(i, v, 0) for i, v in vectors], VECTORS)
    assert whiten(frame).collect() == []


def test_fewer_components_than_eight(spark):
    vectors = [(i, [float(i), float(i % 3), 5.0]) for i in range(9)]
    got = whiten(spark.createDataFrame([(i, v, 0) for i, v in vectors], VECTORS)).collect()
    check(got, vectors)
    assert {r["component"] for r in got} == {1, 2}


def test_fit_is_the_same_for_any_partitions(spark):
    rows = read(spark, SF001, "embeddings")
    fits = [fit_whitening(to_integers(rows.repartition(p), "vec_id", "embedding")) for p in (1, 17)]
    assert np.abs(fits[0]["values"] / fits[1]["values"] - 1).max() < 1e-11
    assert np.abs(np.abs((fits[0]["basis"] * fits[1]["basis"]).sum(0)) - 1).max() < 1e-9
