import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from llm.cases import DOCS, empty_frame, hard_docs, hard_frame, prose
from parlance.llm import jaccard_join as jj


def grams(t):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """(links, least reachable place) per text, by all pairs."""
    s = [grams(t) for t in texts]
    n = len(s)
    link = [[False] * n for _ in range(n)]
    for a in range(n):
        for b in range(a):
            if s[a] and s[b] and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]):
                link[a][b] = link[b][a] = True
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            low = min([comp[a], *(comp[b] for b in range(n) if link[a][b])])
            changed |= low < comp[a]
            comp[a] = low
    return [(sum(link[a]), comp[a]) for a in range(n)]


def edited(text, rng, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"n{rng.random()}"
    return " ".join(w)


def texts():
    rng = random.Random(3)
    out = []
    for g in range(12):
        base = prose(g, rng.randint(60, 200))
        out += [base, base.upper() + "!", *[edited(base, rng, rng.randint(1, 5)) for _ in range(4)]]
    shared = prose(77, 60)
    out += [shared + " " + prose(300 + i, 80) for i in range(20)]
    out += ["one two", "One, two.", "one two three", "", None, "...", "1 2 3 4 5", "1 2 3 4 5 6", prose(5, 3000)]
    return out


@pytest.mark.parametrize("block", [jj.BLOCK, 2])
def test_matches_brute_force(spark, monkeypatch, block):
    """Clusters whole, and dealt into pairs of blocks."""
    monkeypatch.setattr(jj, "BLOCK", block)
    ts = texts()
    frame = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(ts)], DOCS)
    got = {r["doc_id"]: r for r in jj.jaccard_classes(frame.repartition(4)).collect()}
    want = brute(ts)
    assert len(got) == len(ts) and sum(n for n, _ in want) > 50
    for i, (n, c) in enumerate(want):
        assert (got[i]["n_links"], got[i]["class_id"], got[i]["kept"]) == (n, c, c == i), ts[i]


def test_many_near_copies(spark):
    rng = random.Random(8)
    base = prose(1, 150)
    ts = [edited(base, rng, 1) for _ in range(300)] + [base] * 200
    frame = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(ts)], DOCS)
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jj.jaccard_classes(frame).collect()}
    assert got == dict(enumerate(brute(ts)))


def test_hard_rows_and_empty_table(spark):
    rows = hard_docs()
    got = jj.jaccard_classes(hard_frame(spark)).collect()
    assert Counter(str(r["doc_id"]) for r in got) == Counter(str(r[0]) for r in rows)
    want = Counter(n for n, _ in brute([r[1] for r in rows]))
    assert Counter(r["n_links"] for r in got) == want
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[2]["class_id"] == 1 and by[12]["class_id"] == 11 and by[8]["class_id"] == 7
    assert by[5]["n_links"] == 0 and by[3]["n_links"] == 1
    assert jj.jaccard_classes(empty_frame(spark)).collect() == []


def test_bands_reach_the_target_recall():
    for recall in (0.9, 0.99, 0.9999):
        b = jj.bands_for(recall)
        miss = lambda b: (1 - 0.8**jj.ROWS) ** b
        assert miss(b) <= 1 - recall < miss(b - 1)
    rng = np.random.default_rng(1)
    hasher, met = jj.MinHash(jj.bands_for(0.99)), 0
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 180, dtype=np.uint64)
        a, b = x[:162], x[18:]  # 144 of 180 shared: exactly 0.8
        met += bool((hasher(a)[0] == hasher(b)[0]).any())
    assert met >= 190


def test_shared_counts_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 500, n).astype(np.uint64)) for n in (0, 1, 50, 300, 400)]
    got = jj.shared_counts(sets, columns=16)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_similarity_is_a_fraction(spark):
    frame = spark.createDataFrame(
        [(1, "a b c d e f g h i j k l m n", None, None, 0), (2, "a b c d e f g h i j k l m n o", None, None, 0)], DOCS
    )
    assert [r["n_links"] for r in jj.jaccard_classes(frame, Fraction(10, 11)).collect()] == [1, 1]
    assert [r["n_links"] for r in jj.jaccard_classes(frame, Fraction(10, 11) + Fraction(1, 10**6)).collect()] == [0, 0]


def test_null_and_repeated_ids_fetch_one_text_a_class(spark, monkeypatch):
    verify = jj._verify

    def once(words, similarity):
        run = verify(words, similarity)

        def checked(batches):
            held = list(batches)
            seen = [x for b in held for x in zip(*(b.column(c).to_pylist() for c in ("cluster", "i", "j", "rep")))]
            assert len(seen) == len(set(seen))
            return run(iter(held))

        return checked

    monkeypatch.setattr(jj, "_verify", once)
    ts = texts()
    frame = spark.createDataFrame([((None, 7)[i % 2], t, None, None, 0) for i, t in enumerate(ts)], DOCS)
    got = jj.jaccard_classes(frame).collect()
    assert Counter(r["n_links"] for r in got) == Counter(n for n, _ in brute(ts))


def test_large_buckets_are_dealt_in_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "BUCKET", 20)
    links = jj.bucket_links

    def bounded(sketch, least):
        assert len(sketch) < 100  # two blocks of about 20 of the 400 rows
        return links(sketch, least)

    monkeypatch.setattr(jj, "bucket_links", bounded)
    rng = random.Random(9)
    base = prose(2, 120)
    ts = [edited(base, rng, 2) for _ in range(400)]
    frame = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(ts)], DOCS)
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jj.jaccard_classes(frame).collect()}
    assert got == dict(enumerate(brute(ts)))
