import zlib
from collections import Counter, defaultdict

import pytest

from llm.cases import DOCS, empty_frame, hard_docs, hard_frame, prose
from parlance.llm.shard import assign_shards, plan_moves


def run(spark, rows, **kw):
    return assign_shards(spark.createDataFrame(rows, DOCS), **kw).collect()


def check_law(got, rows, shards=8):
    assert len(got) == len(rows)
    assert Counter(str(r["doc_id"]) for r in got) == Counter(str(r[0]) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_groups_stay_together(spark):
    rows = [(i, prose(i if i % 3 else i // 30, 8), None, None, 0) for i in range(600)]
    got = run(spark, rows)
    check_law(got, rows)
    text = {r[0]: r[1] for r in rows}
    where = defaultdict(Counter)
    for r in got:
        where[text[r["doc_id"]]][r["shard"]] += 1
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1
        assert r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    groups = [c for c in where.values() if sum(c.values()) > 1]
    assert len(groups) == 20 and all(len(c) == 1 for c in groups)


@pytest.mark.parametrize("share", [3, 1])
def test_a_group_larger_than_a_shard(spark, share):
    """A third of all rows, or all of them, in one group: the counts still hold."""
    rows = [(i, "same" if i % share == 0 else prose(i, 5), None, None, 0) for i in range(400)]
    got = run(spark, rows)
    check_law(got, rows)
    if share == 3:
        ids = {r[0] for r in rows if r[1] == "same"}
        most = Counter(r["shard"] for r in got if r["doc_id"] in ids).most_common(1)[0][1]
        assert most == 50  # one shard is full of the group


def test_runs_agree_and_do_not_depend_on_partitions(spark):
    rows = [(i, prose(i // 3, 6), None, None, 0) for i in range(200)]
    a = {r["doc_id"]: (r["shard"], r["slot"]) for r in run(spark, rows)}
    frame = spark.createDataFrame(rows[::-1], DOCS).repartition(7)
    b = {r["doc_id"]: (r["shard"], r["slot"]) for r in assign_shards(frame).collect()}
    assert a == b


def test_hard_rows_and_empty_table(spark):
    got = assign_shards(hard_frame(spark)).collect()
    check_law(got, hard_docs())
    null = [r for r in got if r["doc_id"] == 4][0]
    assert (null["size"], null["text_crc32"]) == (1, 0)
    assert assign_shards(empty_frame(spark)).collect() == []
    check_law(run(spark, hard_docs()[:3]), hard_docs()[:3])


@pytest.mark.parametrize("seed", range(20))
def test_planned_moves_fill_every_quota(seed):
    import random

    rng = random.Random(seed)
    k = rng.randint(2, 8)
    ask = [[rng.choice([0, 0, rng.randint(0, 40)]) for _ in range(k)] for _ in range(k)]
    loose = [rng.choice([0, rng.randint(0, 60)]) for _ in range(k)]
    total = sum(map(sum, ask)) + sum(loose)
    quota = [total // k + (s < total % k) for s in range(k)]
    grant, push, move = plan_moves(ask, loose, quota)
    for s in range(k):
        size = sum(ask[s]) + loose[s]
        size += sum(grant[a][s] + move[a][s] for a in range(k)) - sum(grant[s]) - sum(move[s])
        assert size == quota[s]
        assert sum(move[s]) <= loose[s] and sum(grant[s]) <= sum(ask[s])
    for a in range(k):
        for b in range(k):
            assert 0 <= grant[a][b] - push[a][b] <= (ask[a][b] if a != b else 0)


@pytest.mark.parametrize("rounds", [0, 4])
@pytest.mark.parametrize("single", [0, 200])
def test_hot_group_is_packed_and_pairs_beside_it_stay_whole(spark, single, rounds):
    """A group of a third of all rows fills shards; no pair is cut for it."""
    rows = [(i, "same", None, None, 0) for i in range(400)]
    rows += [(1000 + i, f"pair {i // 2}", None, None, 0) for i in range(800 - single)]
    rows += [(5000 + i, f"single {i}", None, None, 0) for i in range(single)]
    got = run(spark, rows, rounds=rounds)
    check_law(got, rows)
    text = {r[0]: r[1] for r in rows}
    where = defaultdict(Counter)
    for r in got:
        where[text[r["doc_id"]]][r["shard"]] += 1
    assert sorted(where["same"].values()) == [100, 150, 150]
    assert all(len(c) == 1 for t, c in where.items() if t != "same")


def test_a_group_that_fits_nowhere_whole_is_cut_least(spark):
    """Nine groups for eight shards: eight stay whole."""
    rows = [(i, f"group {i % 9}", None, None, 0) for i in range(720)]
    got = run(spark, rows)
    check_law(got, rows)
    where = defaultdict(set)
    for r in got:
        where[r["doc_id"] % 9].add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) == 1
