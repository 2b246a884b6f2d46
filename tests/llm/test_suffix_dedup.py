import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from llm.cases import DOCS, empty_frame, hard_docs, hard_frame, prose
from parlance.llm import suffix_dedup as sd

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def brute(texts, length):
    """(removed runs, digest of the rest) per text, by listing all windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cut = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cut[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8)))
        rest = bytes(b for b, c in zip(d, cut) if not c)
        out.append((edge.reshape(-1, 2).tolist(), hashlib.sha256(rest).hexdigest()))
    return out


def check(spark, texts, length, **kw):
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in sd.repeated_strings(frame.repartition(3), length, **kw).collect()}
    assert len(got) == len(texts)
    for i, (runs, digest) in enumerate(brute(texts, length)):
        assert got[i]["removed"] == runs, i
        assert got[i]["kept_sha256"] == digest
        assert got[i]["n_bytes"] == len((texts[i] or "").encode())
        assert got[i]["n_removed"] == sum(b - a for a, b in runs)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    shared = [prose(90, 40), prose(91, 15), "Ünï cödé " * 3 + prose(92, 20)]
    texts = []
    for i in range(60):
        t = prose(i, rng.randint(5, 80))
        if rng.random() < 0.6:
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            t = t[: rng.randint(0, len(t))] + s[a : a + rng.randint(20, len(s))] + t[rng.randint(0, len(t)) :]
        texts.append(t)
    texts += [texts[3], texts[3], texts[9], None, "", "short"]
    check(spark, texts, 48, gram=4, span=12)


def test_periodic_and_overlapping_strings(spark):
    texts = ["ab" * 60, "a" * 100, "x" + "a" * 39, "line one\n" * 12, "line one\n" * 3 + "end", "z" * 39 + "a" * 40]
    check(spark, texts, 40, gram=4, span=12)


def test_at_the_edge_of_the_length(spark):
    s = prose(7, 400)[:400]
    texts = ["left " + s + " right", "other" + s, s[:399] + "!", s[1:] + "?", "a" + s[:200]]
    check(spark, texts, 400)
    check(spark, ["q" + s[:399], "r" + s[:399]], 400)


def test_hot_blocks_are_counted_by_windows(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT_BLOCK", 3)
    s = prose(8, 30)
    check(spark, [prose(100 + i, 20) + s + prose(200 + i, 20) for i in range(8)], 48, gram=4, span=12)


def test_windows_are_judged_in_slices(spark, monkeypatch):
    monkeypatch.setattr(sd, "WINDOWS", 5)
    s = prose(8, 30)
    check(spark, [prose(100 + i, 20) + s + prose(200 + i, 20) for i in range(6)], 48, gram=4, span=12)
    monkeypatch.setattr(sd, "HOT_BLOCK", 3)
    check(spark, [prose(100 + i, 20) + s + prose(200 + i, 20) for i in range(6)], 48, gram=4, span=12)


def test_keys_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sd, "BROADCAST_KEYS", 0)
    s = prose(8, 30)
    texts = [prose(100 + i, 20) + s for i in range(4)]
    check(spark, [*texts, texts[0]], 48, gram=4, span=12)


def test_no_row_is_written_to_two_tables(spark, monkeypatch):
    """Members stay in the tables of their rounds, texts beside their members."""
    names, write = [], sd.materialize
    monkeypatch.setattr(sd, "materialize", lambda df, name: (names.append(name), write(df, name))[1])
    s = prose(8, 30)
    texts = [prose(100 + i, 20) + s + prose(200 + i, 20) for i in range(6)] + ["ab" * 60]
    check(spark, [*texts, texts[0]], 48, gram=4, span=12)
    rounds = [n for n in names if n.startswith("bwt-step-")]
    assert len(rounds) > 1 and len(rounds) == len(set(rounds))
    once = ["bwt-signatures", "bwt-texts", "bwt-copies", "bwt-phrases", "bwt-shards", "bwt-near"]
    assert [n for n in names if n not in rounds] == once


def test_hard_rows_and_empty_table(spark):
    rows = hard_docs()
    got = sd.repeated_strings(hard_frame(spark)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for r, (runs, digest) in zip(rows, brute([r[1] for r in rows], 400)):
        want[(r[0], str(runs), digest)] += 1
    assert Counter((r["doc_id"], str(r["removed"]), r["kept_sha256"]) for r in got) == want
    assert sd.repeated_strings(empty_frame(spark)).collect() == []


def test_suffix_array_and_rounds():
    rng = np.random.default_rng(3)
    seq = rng.integers(0, 3, 60)
    seq[-1] = -1
    order = sd.suffix_array(seq, 64)
    assert list(order) == sorted(range(60), key=lambda i: list(seq[i:]))
    for longest in (1, 2, 7, 40, 131):
        rounds = sd.levels_of(longest)
        covered = [x for level, steps in rounds for x in range(level, level + steps)]
        assert covered == list(range(1, len(covered) + 1)) and covered[-1] >= longest


@pytest.mark.parametrize("bad", [(400, 16, 256), (20, 16, 10)])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        sd.Cutter(*bad)


def test_a_text_is_cut_the_same_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 101, n).astype(np.uint8) for n in (399, 400, 401, 5000, 20_000)]
    texts += [np.frombuffer(b"abc" * 3000, np.uint8), np.zeros(4000, np.uint8)]
    whole = [sd.Cutter().cut(t) for t in texts]
    for piece in (300, 1000, 4096):
        monkeypatch.setattr(sd, "PIECE", piece)
        for t, (phrases, places) in zip(texts, whole):
            got = sd.Cutter().cut(t)
            assert (got[0] == phrases).all() and (got[1] == places).all() and len(got[0]) == len(phrases)


def test_windows_hash_the_same_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    around = [rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in (60, 0, 45, 90, 39, 60)]
    around[5] = around[0]
    n = len(around)
    table = pa.table({
        "first": pa.array([0] * n, pa.int64()), "anchor": pa.array([70] * n, pa.int64()),
        "core": pa.array([10] * n, pa.int64()), "around": pa.array(around, pa.binary()),
    })

    def told(t):
        row, start, h = sd._Windows(t, 50).hashes(0, 80)
        return list(zip(row.tolist(), start.tolist(), h.tolist()))

    whole = told(table)
    assert len(whole) == sum(max(0, len(a) - 39) for a in around)
    by = {r: [h for x, _, h in whole if x == r] for r in range(n)}
    assert by[0] == by[5] and by[0] != by[3][:21]
    monkeypatch.setattr(sd, "PIECE", 32)
    assert told(table) == whole
    assert told(pa.concat_tables([table.slice(0, 2), table.slice(2)])) == whole


def test_a_very_long_text_takes_bounded_memory():
    """50 MB in a process of its own: at most 300 MB above what the libraries take."""
    import subprocess
    import sys

    code = (
        "import resource, numpy as np\n"
        "from parlance.llm import suffix_dedup as sd\n"
        "sd.Cutter().cut(np.zeros(5000, np.uint8))\n"
        "rss = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024\n"
        "before = rss()\n"
        "data = np.random.default_rng(1).integers(97, 123, 50_000_000).astype(np.uint8)\n"
        "made = rss()\n"
        "phrases, places = sd.Cutter().cut(data)\n"
        "print(len(phrases), made - before, rss() - made)\n"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout
    phrases, _, more = out.split()
    assert int(phrases) > 500_000 and float(more) < 300
