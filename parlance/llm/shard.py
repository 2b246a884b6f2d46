"""Operator 7: sharding by balanced label propagation.

Documents are linked through groups (equal texts unless the caller gives
another key). Labels start from a hash; in every round each group asks for the
shard that most of its members are in, among those with room for it, and shards
admit whole groups up to their quotas. Unlinked documents fill what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm.common import buckets_for, join_aggregate, materialize, rank_in_groups

SHARDS = 8
ROUNDS = 4


def _quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan_moves(ask: list[list[int]], loose: list[int], quota: list[int]):
    """(granted linked moves, loose moves) between shards, as matrices.

    ``ask[a][b]``: linked rows now in a that want b (a == b: that stay).
    ``loose[a]``: unlinked rows in a. Afterwards every shard holds its quota
    exactly. Requests into a shard beyond its quota are refused; rows a shard
    cannot hold are pushed to shards with room.
    """
    k = len(quota)
    grant = [[ask[a][b] if a != b else 0 for b in range(k)] for a in range(k)]
    here = [sum(ask[a]) for a in range(k)]

    def linked(s: int) -> int:
        return here[s] - sum(grant[s]) + sum(grant[a][s] for a in range(k))

    changed = True
    while changed:
        changed = False
        for b in range(k):
            over = linked(b) - quota[b]
            for a in sorted(range(k), key=lambda a: grant[a][b]):
                if over <= 0:
                    break
                cut = min(over, grant[a][b])
                grant[a][b] -= cut
                over -= cut
                changed |= cut > 0
    push = [[0] * k for _ in range(k)]
    for a in range(k):  # a shard that is over even without arrivals
        for b in range(k):
            over = linked(a) - quota[a]
            if over > 0 and b != a and linked(b) < quota[b]:
                n = min(over, quota[b] - linked(b))
                grant[a][b] += n
                push[a][b] += n
    move = [[0] * k for _ in range(k)]
    want = [quota[s] - linked(s) for s in range(k)]
    spare = [loose[s] - want[s] for s in range(k)]
    for a in range(k):
        for b in range(k):
            if spare[a] > 0 > spare[b]:
                n = min(spare[a], -spare[b])
                move[a][b] += n
                spare[a] -= n
                spare[b] += n
    return grant, push, move


def _by_rank(limits: list[list[int]], shard: Column, rank: Column) -> Column:
    """Destination of a row of ``shard`` with ``rank``: limits[a] in turn, then null."""
    out = F.lit(None).cast("int")
    for a, row in enumerate(limits):
        upto, within = 0, F.lit(None).cast("int")
        for b, n in enumerate(row):
            if n:
                within = F.when((rank >= upto) & (rank < upto + n), F.lit(b)).otherwise(within)
                upto += n
        if upto:
            out = F.when(shard == a, within).otherwise(out)
    return out


def _running(groups: DataFrame, within: list[str], buckets: int) -> DataFrame:
    """Add ``upto``: the members of a group and of those before it, per ``within``.

    Larger size classes (powers of two) come first, then the order of hashes.
    Sums run inside (size class, hash bucket) and are moved up by the earlier
    buckets' sums, so that no task sorts all groups.
    """
    b, n, off = "__bucket", "__n", "__off"
    smaller = F.lit(64) - F.length(F.bin("members"))
    at = smaller.cast("long") * buckets + F.pmod(F.col("order"), F.lit(buckets))
    groups = groups.withColumn(b, at)
    before = W.orderBy(b) if not within else W.partitionBy(*within).orderBy(b)
    sums = groups.groupBy(*within, b).agg(F.sum("members").alias(n))
    sums = sums.withColumn(
        off, F.coalesce(F.sum(n).over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop(n)
    inside = W.partitionBy(*within, b).orderBy("order", "link").rowsBetween(W.unboundedPreceding, 0)
    summed = groups.withColumn("upto", F.sum("members").over(inside)).join(sums, [*within, b])
    return summed.withColumn("upto", F.col("upto") + F.col(off)).drop(b, off)


def _wish(room: list[int]) -> Column:
    """The shard with most members among those with room for the whole group, or
    null. Ties go by hash, in proportion to the room."""
    asks = []
    for s, free in enumerate(room):
        if free:
            u = (F.pmod(F.xxhash64("link", F.lit(s)), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
            ask = F.struct(F.col("votes")[s].alias("n"), (F.log(u) / F.lit(float(free))).alias("tie"), F.lit(s).alias("s"))
            asks.append(F.when(F.col("members") <= free, ask))
    return F.array_max(F.array(*asks))["s"] if asks else F.lit(None).cast("int")


def place_pieces(members: int, votes: list[int], room: list[int]) -> list[tuple[int, int]]:
    """(shard, rows) for one group, taken off ``room``: whole where it fits, else
    the roomiest shards are filled until the rest fits."""
    pieces = []
    while members:
        fits = [s for s in range(len(room)) if room[s] >= members]
        best = max(fits or range(len(room)), key=lambda s: ((0 if fits else room[s]), votes[s], room[s], -s))
        n = min(members, room[best])
        pieces.append((best, n))
        room[best] -= n
        members -= n
    return pieces


def _place_groups(groups: DataFrame, room: list[int], rounds: int, buckets: int):
    """(frame of link and shard, or None; {link: pieces}) for all groups; ``room``
    becomes what is left for unlinked rows."""
    shards, whole, pieces = len(room), [], {}
    largest = max(room)

    def by_driver(few: DataFrame) -> None:
        # fewer than ``shards`` rows: see the callers
        for r in sorted(few.collect(), key=lambda r: (-r["members"], r["order"], r["link"])):
            pieces[r["link"]] = place_pieces(r["members"], r["votes"], room)

    # the groups that no shard holds fill whole shards, before others settle there
    by_driver(groups.where(F.col("members") > largest))
    todo = groups.where(F.col("members") <= largest)
    for k in range(rounds + 1):
        if k < rounds:
            # -1: no shard has room for the whole group now
            asked = todo.withColumn("to", F.coalesce(_wish(room), F.lit(-1)))
            asked = _running(asked, ["to"], buckets)
            to = F.lit(None).cast("int")
            for s, n in enumerate(room):
                to = F.when((F.col("to") == s) & (F.col("upto") <= n), F.lit(s)).otherwise(to)
        else:
            # rooms end to end, groups end to end: fewer than ``shards`` lie across an edge
            asked, to, edge = _running(todo, [], buckets), F.lit(None).cast("int"), 0
            for s, n in enumerate(room):
                inside = (F.col("upto") - F.col("members") >= edge) & (F.col("upto") <= edge + n)
                edge += n
                to = F.when(inside, F.lit(s)).otherwise(to)
        asked = materialize(
            asked.withColumn("at", to).select("link", "members", "votes", "order", "at"), "shard-groups"
        )
        whole.append(asked.where("at is not null").select("link", F.col("at").alias("to")))
        todo = asked.where("at is null")
        left = 0
        for r in asked.groupBy("at").agg(F.count("*").alias("c"), F.sum("members").alias("n")).collect():
            if r["at"] is None:
                left = r["c"]
            else:
                room[r["at"]] -= r["n"]
        if left < shards:
            break
    if left:
        by_driver(todo)
    out = whole[0]
    for w in whole[1:]:
        out = out.union(w)
    return out, pieces


def assign_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` with row counts at most one apart.

    Size is the text's UTF-8 bytes plus 1. Equal non-null texts are linked; a
    null text counts as no bytes (size 1, crc32 0) and is linked to nothing,
    while empty texts are equal texts. Repeated rows and repeated or null ids
    are rows of their own. ``slot`` numbers a shard's rows from 0 without gaps.
    Shards and slots follow from ids and texts alone, whatever the partitions.
    Other columns, whatever their names, are not read. No rows in, no rows out.

    Links are star-shaped (row - group), so a group is one row with a count per
    shard, and labels spread in rounds over that table; the rows are moved once.
    After ``rounds`` rounds the groups still without a shard are laid end to end
    over the room that is left. So fewer than ``shards`` groups that a shard
    could hold are cut, and only if no shard has room for them whole. A group
    larger than a shard fills whole shards, and its rest goes to one more where
    that has room. What reaches the driver is counts between shards, and fewer
    than ``shards`` groups at a time (counts and hash).
    """
    text = F.col(text_col)
    v = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
        F.sha2(text.cast("binary"), 256).alias("link"),
    )
    v = materialize(
        v.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "id", "crc"), F.lit(shards)).cast("int")),
        "shard-rows",
    )
    rows = v.count()
    quota, buckets = _quotas(rows, shards), buckets_for(rows)
    if not rows:
        return v.select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
            F.lit(0).cast("long").alias("slot"),
        )
    votes = F.array(*[F.count(F.when(F.col("shard") == s, 1)) for s in range(shards)])
    groups = materialize(
        v.where(F.col("link").isNotNull()).groupBy("link")
        .agg(F.count("*").alias("members"), votes.alias("votes"))
        .where(F.col("members") > 1).withColumn("order", F.xxhash64("link")),
        "shard-groups",
    )
    room = list(quota)
    whole, pieces = _place_groups(groups, room, rounds, buckets)
    w = join_aggregate(v, whole, ["link"], "left")
    cut = F.coalesce(F.col("link").isin(*pieces), F.lit(False)) if pieces else F.lit(False)
    kind = F.when(F.col("to").isNotNull(), "whole").when(cut, "cut").otherwise("loose")
    w = materialize(
        w.withColumns({"kind": kind, "h": F.xxhash64(F.lit("move"), "id", "crc")}), "shard-wish"
    )
    loose = [0] * shards
    for r in w.where("kind = 'loose'").groupBy("shard").count().collect():
        loose[r["shard"]] = r["count"]
    _, _, move = plan_moves([[0] * shards for _ in range(shards)], loose, room)
    cols = ["id", "size", "crc", "row"]
    moved = w.where("kind = 'whole'").select(*cols, F.col("to").alias("shard"))
    if any(loose):
        free = w.where("kind = 'loose'")
        if any(map(any, move)):
            free = rank_in_groups(free, ["shard"], ["h", "id", "row"], "rank", buckets, spread=["h", "id"])
            dest = _by_rank(move, F.col("shard"), F.col("rank"))
            free = free.withColumn("shard", F.coalesce(dest, "shard"))
        moved = moved.union(free.select(*cols, "shard"))
    if pieces:
        split = rank_in_groups(
            w.where("kind = 'cut'"), ["link"], ["h", "id", "row"], "rank", buckets, spread=["h", "id"]
        )
        dest = F.lit(None).cast("int")
        for link, parts in pieces.items():
            upto, within = 0, F.lit(None).cast("int")
            for s, n in parts:
                inside = (F.col("rank") >= upto) & (F.col("rank") < upto + n)
                within = F.when(inside, F.lit(s)).otherwise(within)
                upto += n
            dest = F.when(F.col("link") == link, within).otherwise(dest)
        moved = moved.union(split.select(*cols, dest.alias("shard")))
    v = materialize(moved, "shard-rows")
    v = v.withColumn("h", F.xxhash64(F.lit("slot"), "id", "crc"))
    v = rank_in_groups(v, ["shard"], ["h", "id", "row"], "slot", buckets, spread=["h", "id"])
    return v.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot"
    )
