import re
from collections import defaultdict

import pandas as pd
import pytest

from llm.cases import DOCS, empty_frame, hard_docs, hard_frame, prose
from parlance.llm import mix


def targets(sizes, weights=(5, 2, 1)):
    """Water-filling by rounds; sizes: {source: words}, null last."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        t = {s: 2 * sizes[s] if s in full else w[s] * left / sum(w[x] for x in rest) for s in names}
        over = {s for s in rest if t[s] > 2 * sizes[s]}
        if not over:
            return t
        full |= over


def check(spark, rows):
    frame = spark.createDataFrame(rows, DOCS)
    got = mix.mix_sources(frame).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["mix_size"] == n and 0 <= r["mix_copies"] <= 2
        sizes[r["source"]] += n
        taken[r["source"]] += n * r["mix_copies"]
    want = targets(sizes)
    least = {s: min([r["mix_size"] for r in got if r["source"] == s and r["mix_size"]], default=0) for s in sizes}
    for r in got:
        assert r["mix_source_size"] == sizes[r["source"]]
        assert r["mix_target"] == pytest.approx(want[r["source"]], rel=1e-12)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(least[s], 0.02 * want[s]), s
    return got


def test_targets_and_taken_words(spark):
    rows = []
    for s, (name, n) in enumerate([("b", 80), ("a", 300), (None, 40), ("é", 5), ("z", 120), ("Z", 1)]):
        rows += [(s * 1000 + i, prose(s * 1000 + i, 1 + (i * 7) % 60), None, name, 0) for i in range(n)]
    got = check(spark, rows)
    again = mix.mix_sources(spark.createDataFrame(rows[::-1], DOCS).repartition(5)).collect()
    key = lambda rs: sorted((r["doc_id"], r["mix_copies"], r["mix_target"]) for r in rs)
    assert key(got) == key(again)


def test_one_source_takes_half_as_much_again(spark):
    rows = [(i, prose(i, 10), None, "only", 0) for i in range(101)]
    got = check(spark, rows)
    assert {r["mix_copies"] for r in got} == {1, 2}


def test_rates_are_tilted_by_size(spark):
    """Below its own size a source loses its longest texts first, above it gains them."""
    rows = [(i, prose(i, 1 + i % 50), None, "a", 0) for i in range(200)]
    rows += [(1000 + i, prose(i, 1 + i % 50), None, "c", 0) for i in range(2000)]
    rows += [(9000 + i, prose(i, 1 + i % 50), None, "b", 0) for i in range(200)]
    got = [r for r in check(spark, rows) if r["source"] == "c" and r["mix_size"]]
    short = [r["mix_copies"] for r in got if r["mix_size"] <= 10]
    long = [r["mix_copies"] for r in got if r["mix_size"] > 40]
    mean = lambda x: sum(x) / len(x)
    below = got[0]["mix_target"] < got[0]["mix_source_size"]
    assert (mean(long) < mean(short)) == below


def test_hard_rows_and_empty_table(spark):
    got = mix.mix_sources(hard_frame(spark)).collect()
    assert len(got) == len(hard_docs())
    assert all(r["mix_copies"] == 1 for r in got if not r["mix_size"])
    assert {"rank", "shard", "key"} <= set(mix.mix_sources(hard_frame(spark)).columns)
    assert mix.mix_sources(empty_frame(spark)).collect() == []
    wordless = spark.createDataFrame([(1, None, None, "a", 0), (2, "", None, None, 0)], DOCS)
    assert [(r["mix_target"], r["mix_copies"]) for r in mix.mix_sources(wordless).collect()] == [(0.0, 1)] * 2


def test_rounding_ends_near_the_wanted_words():
    pdf = pd.DataFrame({"__sid": 0, "__size": [50, 7, 3, 1], "__n": [3, 9, 4, 20], "__rate": [0.4, 1.7, 0.2, 1.1], "__cap": 2})
    out = mix.round_copies(pdf)
    want = (pdf["__size"] * pdf["__n"] * pdf["__rate"]).sum()
    assert abs((out["__size"] * out["__k"]).sum() - want) <= 0.5
    assert (out["__k"] <= 2 * out["__n"]).all()


def test_multipliers_solve_the_dual(spark):
    """Against bisection on the sum of rates, source by source."""
    import math
    import random

    rng = random.Random(9)
    sizes = {0: [rng.randrange(1, 400) for _ in range(300)], 1: [7] * 50, 2: [1, 5000, 3, 3], 3: [0, 0]}
    wanted = {0: 0.4, 1: 1.3, 2: 1.9, 3: 2.0}  # of the source's words
    hist = [(s, z, xs.count(z)) for s, xs in sizes.items() for z in set(xs)]
    targets = [(s, float(sum(xs)) * wanted[s], sum(xs)) for s, xs in sizes.items()]
    got = mix.solve_dual(
        spark.createDataFrame(hist, "__sid long, __size long, __n long"),
        spark.createDataFrame(targets, "__sid long, __target double, __source_size long"),
    ).collect()
    found = {r["__sid"]: (r["__lam"], r["__mean"]) for r in got}
    assert found[3][0] is None
    for s, target, total in targets[:3]:
        lam, mean = found[s]
        words = lambda x: sum(z * 2 / (1 + math.exp(-x * z / mean)) for z in sizes[s])
        lo, hi = -150.0, 150.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if words(mid) < target else (lo, mid)
        assert abs(words(lam) - target) <= 1e-5 * target
        assert abs(lam - lo) <= 1e-3 * max(1, abs(lo))


def test_a_dual_that_does_not_settle_raises(spark, monkeypatch):
    monkeypatch.setattr(mix, "MAX_STEPS", 1)
    rows = [(i, prose(i, 5 + i), "en", "ab"[i % 2], 0) for i in range(20)]
    with pytest.raises(RuntimeError, match="did not settle"):
        mix.mix_sources(spark.createDataFrame(rows, DOCS))
