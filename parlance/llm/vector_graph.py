"""Operator 6: near-duplicate vectors through a robust-pruned flat graph.

Vectors of one label are dealt to overlapping cluster shards. Every shard
builds a flat neighbour graph and prunes it robustly; a vector's adjacency
lists of all its shards are united; range-expanding greedy searches from the
medoids then walk the graph, exact cosines decide each link, and the recall is
audited against brute force.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.batches import mix, whole_groups
from parlance.llm.common import connected_components, join_aggregate, materialize

THRESHOLD = 0.93
CELL = 1000  # vectors per cluster aimed at
SHARD = 4096  # a cluster beyond this is compared in blocks of about this size
CENTRES = 1024  # most clusters of a label; larger labels get larger clusters, in blocks
FIT_ROWS = 20_000  # vectors the clusters are fitted on, lowest id hashes
OVERLAP = 2  # clusters each vector goes to
DEGREE = 20
CANDIDATES = 40
FAR = 6  # random long edges a vector keeps besides
ALPHA = 1.2
BEAM = 16
QUERIES = 512  # searched in lockstep
EXPANDED = 1 << 15  # finds whose neighbours are looked at together
AUDIT_ROWS = 200  # rows sampled for the audit at first
AUDIT_LINKED = 50  # sampled rows with links that are enough; the sample grows until then
AUDIT_MOST = 3200
AUDIT_TABLES = 6
RECALL = 0.9


def unit(vectors) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x.reshape(len(x), -1) / np.maximum(np.abs(x.reshape(len(x), -1)).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def robust_prune(x: np.ndarray, degree: int = DEGREE, width: int = CANDIDATES, alpha: float = ALPHA,
                 far: int = FAR) -> list[np.ndarray]:
    """Adjacency lists: the nearest candidates thinned so that none is much
    nearer to a kept neighbour than to the vector, random far edges, and all
    edges reversed (the nearest ``2 * degree`` of a list stay)."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    width = min(width, n - 1)
    rng = np.random.default_rng(n)
    heads, tails = [], []
    for lo in range(0, n, 256):
        rows = np.arange(lo, min(n, lo + 256))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        cand = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        order = np.argsort(-np.take_along_axis(sims, cand, 1), axis=1, kind="stable")
        cand = np.take_along_axis(cand, order, 1)
        own = 1.0 - np.take_along_axis(sims, cand, 1)
        y = x[cand]
        between = 1.0 - y @ y.transpose(0, 2, 1)
        alive = np.ones(cand.shape, bool)
        for _ in range(min(degree, width)):
            some = np.flatnonzero(alive.any(axis=1))
            if not len(some):
                break
            pick = alive[some].argmax(axis=1)
            heads.append(rows[some])
            tails.append(cand[some, pick])
            alive[some] &= ~(alpha * between[some, pick] <= own[some])
            alive[some, pick] = False
        heads.append(np.repeat(rows, far))
        tails.append(rng.integers(0, n, far * len(rows)))
    h, t = np.concatenate(heads), np.concatenate(tails)
    pairs = np.unique(np.concatenate([h * n + t, t * n + h]))
    pairs = pairs[pairs // n != pairs % n]
    h, t = pairs // n, pairs % n
    near = np.einsum("ij,ij->i", x[h], x[t])
    order = np.lexsort((-near, h))
    h, t = h[order], t[order]
    cuts = np.searchsorted(h, np.arange(n + 1))
    # nearest first up to the bound; the last of a full list are swapped for far ones
    return [
        np.concatenate([t[a:b][: 2 * degree - far], t[a:b][-far:]]) if b - a > 2 * degree else t[a:b]
        for a, b in zip(cuts[:-1], cuts[1:])
    ]


def range_search(x: np.ndarray, adj: list[np.ndarray], threshold: float, starts: np.ndarray,
                 beam: int = BEAM, queries: int = QUERIES):
    """(query, hit) index arrays, blockwise: every vector queries the graph.

    A best-first beam runs from the medoids and the query's own place; all
    vectors in range that it meets are then expanded until no new one appears.
    """
    n = len(x)
    width = max((len(a) for a in adj), default=0)
    if n < 2 or not width:
        return
    nbr = np.full((n, width), -1, dtype=np.int64)
    for i, a in enumerate(adj):
        nbr[i, : len(a)] = a
    for lo in range(0, n, queries):
        q = np.arange(lo, min(n, lo + queries))
        k = len(q)
        seen = np.zeros((k, n), bool)
        first = np.concatenate([np.tile(starts, (k, 1)), q[:, None]], axis=1)
        sim = np.einsum("qd,qbd->qb", x[q], x[first])
        seen[np.arange(k)[:, None], first] = True
        ids, open_ = first, np.ones(first.shape, bool)
        found_q, found_t = [], []

        def note(rows, targets, sims):
            hit = sims >= threshold
            found_q.append(rows[hit])
            found_t.append(targets[hit])

        note(np.repeat(np.arange(k), first.shape[1]), first.ravel(), sim.ravel())
        while True:
            best = np.where(open_, sim, -np.inf)
            at = best.argmax(axis=1)
            live = np.flatnonzero(best[np.arange(k), at] > -np.inf)
            if not len(live):
                break
            open_[live, at[live]] = False
            step = nbr[ids[live, at[live]]]
            fresh = (step >= 0) & ~seen[live[:, None], step]
            r, c = np.nonzero(fresh)
            rows, targets = live[r], step[r, c]
            seen[rows, targets] = True
            s = np.einsum("ij,ij->i", x[q[rows]], x[targets])
            note(rows, targets, s)
            new_sim = np.full((k, width), -np.inf)
            new_ids = np.zeros((k, width), np.int64)
            new_sim[rows, c], new_ids[rows, c] = s, targets
            sim = np.concatenate([sim, new_sim], axis=1)
            ids = np.concatenate([ids, new_ids], axis=1)
            open_ = np.concatenate([open_, new_sim > -np.inf], axis=1)
            if sim.shape[1] > beam:
                top = np.argpartition(-sim, beam - 1, axis=1)[:, :beam]
                sim, ids, open_ = (np.take_along_axis(v, top, 1) for v in (sim, ids, open_))
        rows, targets = np.concatenate(found_q), np.concatenate(found_t)
        all_q, all_t = [rows], [targets]
        while len(rows):  # the range expands through what is in it
            fresh = []
            for a in range(0, len(rows), EXPANDED):
                step = nbr[targets[a : a + EXPANDED]]
                r, c = np.nonzero(step >= 0)
                flat = rows[a : a + EXPANDED][r] * n + step[r, c]
                flat = np.unique(flat[~seen.ravel()[flat]])
                seen.ravel()[flat] = True
                fresh.append(flat)
            flat = np.concatenate(fresh)
            rows, targets = flat // n, flat % n
            hit = np.concatenate(
                [
                    np.einsum("ij,ij->i", x[q[rows[a : a + 65536]]], x[targets[a : a + 65536]])
                    for a in range(0, len(rows), 65536)
                ]
                or [np.zeros(0)]
            ) >= threshold
            rows, targets = rows[hit], targets[hit]
            all_q.append(rows)
            all_t.append(targets)
        a, b = q[np.concatenate(all_q)], np.concatenate(all_t)
        yield a[a != b], b[a != b]


def medoids(x: np.ndarray, count: int = 2) -> np.ndarray:
    """The vectors nearest to the shard's mean and to its opposite half's mean."""
    mean = x.mean(axis=0)
    toward = x @ mean
    half = x[toward <= np.median(toward)].mean(axis=0)
    return np.unique([int(toward.argmax()), int((x @ half).argmax())][:count])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable through the pairs, by repeated minima."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _centres(sample: pd.DataFrame, totals: dict) -> dict:
    """Cluster centres per label: k-means of the sample, a few rounds."""
    out = {}
    for label, g in sample.groupby("label", sort=True):
        x = unit(g["v"])
        k = min(len(x), CENTRES, -(-totals[label] // CELL))
        rng = np.random.default_rng(k)
        c = x[np.sort(rng.choice(len(x), k, replace=False))]
        for _ in range(6):
            own = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
        out[label] = c
    return out


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per input row: ``id_col, n_links, component_id, kept``.

    Two rows are linked if their labels are equal and not null and the cosine in
    double precision is at least ``threshold``. Vectors that are null, empty,
    zero or hold a null or non-finite component link with nothing, as do
    vectors of different lengths. Identical vectors of one label are compared
    once and counted as often as they occur; repeated rows are rows of their
    own. ``component_id`` is the least id reachable, the row itself included
    (null ids are left out of that minimum), ``kept`` whether it is the row's
    own; a null id is kept. Other columns are not read. No rows in, no rows out.

    The clusters are fitted on a bounded sample (``FIT_ROWS``); all rows are
    indexed. A cluster beyond ``SHARD`` vectors is dealt into blocks, and every
    pair of blocks is a shard, so no task holds more than two blocks and no pair
    is lost. The search stays in its shard: two vectors that share no cluster
    are never compared. A pair met from either side, in any cluster, counts once
    for both: pairs that share several clusters leave their shards as lists per
    vector, in parts, and are united over the clusters. Recall is the mean, over
    sampled rows with links, of the share of a row's own links that was found,
    by brute force against all rows. The sample grows from ``AUDIT_ROWS`` until
    ``AUDIT_LINKED`` of its rows have links, to ``AUDIT_MOST`` at most; then it is taken
    among rows with a near neighbour by random planes, so that few linked rows
    among many are met too. A warning says so if it ends with fewer, or with none,
    when recall is not measured. Below ``RECALL`` the search is repeated with more
    overlap, and fails at last.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    good = F.coalesce(
        F.col(label_col).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    base = materialize(
        vectors.select(
            F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
            F.when(good, F.concat_ws("/", F.col(label_col).cast("string"), F.size(v))).alias("label"),
            F.when(good, F.col(vector_col)).alias("v"),
        ),
        "vec-rows",
    )
    reps = materialize(
        base.where("label is not null").groupBy("label", "v").agg(
            F.min("rid").alias("rep"), F.count("*").alias("copies"), F.min("id").alias("low")
        ),
        "vec-reps",
    )
    totals = {r["label"]: r["count"] for r in reps.groupBy("label").count().collect()}
    share = min(1.0, FIT_ROWS / max(1, sum(totals.values())))
    picked = reps.where(
        F.pmod(F.xxhash64(F.lit("fit"), "v"), F.lit(1 << 40)) < int(share * (1 << 40))
    ).select("label", "v")
    centres = _centres(picked.orderBy("label", "v").toPandas(), totals) if totals else {}

    while True:
        links, edges = _search(spark, reps, centres, threshold, overlap)
        recall = _audit(spark, reps, links, threshold)
        if recall is None or recall >= RECALL:
            break
        overlap += 1
        if overlap > 4:
            raise RuntimeError(f"audited recall {recall:.3f} is below {RECALL}")
    comp = connected_components(edges)
    comp = reps.select("rep", "copies", "low").join(
        comp, F.col("rep") == F.col("id"), "left"
    ).select("rep", "copies", "low", F.coalesce("component", "rep").alias("component"))
    lowest = comp.groupBy("component").agg(F.min("low").alias("component_id"))
    comp = comp.join(lowest, "component").join(links, "rep", "left").select(
        "rep", "component_id",
        (F.coalesce(F.col("n"), F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )
    member = reps.select("rep", F.col("label").alias("l"), F.col("v").alias("w")).join(comp, "rep")
    # not null-safe on purpose: rows that link with nothing have a null label
    out = base.join(member, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    cid = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        cid.alias("component_id"), F.coalesce(cid == F.col("id"), F.lit(True)).alias("kept"),
    )


def _search(spark, reps: DataFrame, centres: dict, threshold: float, overlap: int):
    """(rep -> links found, component edges) through shards, graphs and searches."""
    shared = spark.sparkContext.broadcast(centres)

    def assign(frames):
        for f in frames:
            cells = np.empty(len(f), dtype=object)
            for label, at in f.groupby("label").indices.items():
                c = shared.value.get(label)
                if c is None:
                    near = np.zeros((len(at), 1), int)
                else:
                    sims = unit(f["v"].iloc[at]) @ c.T
                    near = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
                for i, row in zip(at, near):
                    cells[i] = [int(j) for j in row]
            yield f.assign(cells=cells)

    placed = reps.select("rep", "label", "v", "copies").mapInPandas(
        assign, "rep long, label string, v array<float>, copies long, cells array<int>"
    )
    placed = materialize(placed.withColumn("cell", F.explode("cells")), "vec-cells")
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("k"))
    own = F.pmod(F.xxhash64(F.lit("block"), "rep"), F.col("k")).cast("int")
    dealt = (
        placed.join(sizes, ["label", "cell"])
        .withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .select("rep", "label", "v", "copies", "cells", "cell", "i", "j", "block")
    )
    shard = ["label", "cell", "i", "j"]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        ids = pdf["rep"].to_numpy()
        adj = [ids[a] for a in robust_prune(unit(pdf["v"]))]
        return pd.DataFrame({"rep": ids, "adj": adj})

    lists = materialize(
        dealt.groupBy(*shard).applyInPandas(build, "rep long, adj array<long>"), "vec-adjacency"
    )
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("adj"))).alias("adj"))

    # one vector's list is dealt into parts, so that a hot one never lies in one row
    parts = 16 * (sizes.agg(F.max("k")).first()[0] or 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pdf = pa.Table.from_batches(list(batches)).to_pandas()
        pdf = pdf.sort_values("rep").reset_index(drop=True)
        ids, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        x = unit(pdf["v"])
        split = int(pdf["i"][0]) != int(pdf["j"][0])
        width = max(map(len, pdf["cells"]))
        table = np.full((len(ids), width), -1)
        for r, c in enumerate(pdf["cells"]):
            table[r, : len(c)] = c
        block = pdf["block"].to_numpy()
        adj = []
        for a in pdf["adj"]:  # neighbours that are in this shard
            a = np.asarray(a, dtype=np.int64)
            at = np.minimum(np.searchsorted(ids, a), len(ids) - 1)
            adj.append(at[ids[at] == a])
        met = np.zeros((len(ids), len(ids)), bool)
        for a, b in range_search(x, adj, threshold, medoids(x)):
            if split:  # pairs inside one block belong to that block's own shard
                across = block[a] != block[b]
                a, b = a[across], b[across]
            met[a, b] = True
            met[b, a] = True
        n_links = np.zeros(len(ids), dtype=np.int64)
        root = np.arange(len(ids))
        for lo in range(0, len(ids), QUERIES):
            a, b = np.nonzero(met[lo : lo + QUERIES])
            a += lo
            root = _roots(
                len(ids), np.concatenate([np.arange(len(ids)), a]), np.concatenate([root, b])
            )
            common = np.zeros(len(a), np.int64)
            for c in range(width):
                common += ((table[b] == table[a, c][:, None]) & (table[b] >= 0)).any(axis=1)
            np.add.at(n_links, a[common == 1], copies[b[common == 1]])
            # the other clusters of these pairs may have met them too
            a, b = a[common > 1], b[common > 1]
            if not len(a):
                continue
            part = (mix(ids[b].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((part, a))
            a, b, part = a[order], b[order], part[order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])))
            cuts = pa.array(np.append(first, len(a)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[a[first]]), pa.nulls(len(first), pa.int64()),
                    pa.nulls(len(first), pa.int64()), pa.array(part[first]),
                    pa.ListArray.from_arrays(cuts, pa.array(ids[b])),
                    pa.ListArray.from_arrays(cuts, pa.array(copies[b])),
                ],
                names,
            )
        none = pa.nulls(len(ids), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(n_links), pa.array(ids[root]), pa.nulls(len(ids), pa.int64()), none, none],
            names,
        )

    names = ["rep", "n", "root", "part", "others", "times"]
    found = materialize(
        dealt.join(united, "rep").groupBy(*shard).applyInArrow(
            search,
            "rep long, n long, root long, part long, others array<long>, times array<long>",
        ),
        "vec-found",
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared_pairs = (
        found.where("others is not null").select("rep", "part", "others", "times")
        .repartition(tasks, "rep", "part").sortWithinPartitions("rep", "part")
        .mapInArrow(_unite, "rep long, n long")
    )
    own_pairs = found.where("others is null").select("rep", "n")
    links = materialize(
        own_pairs.union(shared_pairs).groupBy("rep").agg(F.sum("n").alias("n")), "vec-links"
    )
    edges = found.where("root is not null").select(F.col("rep").alias("src"), F.col("root").alias("dst"))
    return links, edges


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (rep, part, others, times) -> links of each rep, every other counted once."""
    for t in whole_groups(batches, ["rep", "part"]):
        others = t.column("others").combine_chunks()
        rep = np.repeat(t.column("rep").to_numpy(), others.value_lengths().to_numpy())
        other = others.flatten().to_numpy()
        times = t.column("times").combine_chunks().flatten().to_numpy()
        order = np.lexsort((other, rep))
        rep, other, times = rep[order], other[order], times[order]
        new = np.append(True, (rep[1:] != rep[:-1]) | (other[1:] != other[:-1]))
        rep, times = rep[new], times[new]
        first = np.flatnonzero(np.append(True, rep[1:] != rep[:-1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rep[first]), pa.array(np.add.reduceat(times, first))], ["rep", "n"]
        )


def _audit(spark, reps: DataFrame, links: DataFrame, threshold: float) -> float | None:
    """Mean share of its links that a row with links got, by brute force over all
    rows for a bounded sample; None if no sampled row has a link, though some
    row may. A table sampled whole without a link has recall 1.

    Where a sample of all rows meets too few rows with links, one of rows that have a
    near neighbour by another criterion follows (:func:`_near_others`).
    """
    rows = AUDIT_ROWS
    while True:
        recall, linked, sampled = _audited(spark, reps, reps, links, threshold, rows)
        if linked >= AUDIT_LINKED:
            return recall
        if sampled < rows:
            return recall if linked else 1.0
        if rows >= AUDIT_MOST:
            break
        rows = min(AUDIT_MOST, 4 * rows)
    recall2, linked2, sampled2 = _audited(spark, _near_others(reps), reps, links, threshold, AUDIT_MOST)
    if linked2 > linked:
        recall, linked, sampled = recall2, linked2, sampled2
    if linked < AUDIT_LINKED:
        warnings.warn(
            f"recall audited on {linked} rows with links, in samples of {rows} rows and of {sampled2} with a near neighbour",
            stacklevel=2,
        )
    return recall if linked else None


def _near_others(reps: DataFrame) -> DataFrame:
    """Rows that lie on the same sides as another of their label of all random planes
    in one of ``AUDIT_TABLES`` sets. A set has ten planes more than it takes to number the
    rows, so that few rows are there by chance; rows at the threshold often enough
    are. Neither clusters nor graphs have a part in it.
    """
    bits = min(62, reps.count().bit_length() + 10)

    def signed(frames):
        weight = 1 << np.arange(bits, dtype=np.int64)
        for f in frames:
            for _, g in f.groupby("label"):  # vectors of a label are of one length
                x = unit(g["v"])
                rng = np.random.default_rng(x.shape[1])
                signs = [(x @ rng.normal(size=(x.shape[1], bits)) > 0) @ weight for _ in range(AUDIT_TABLES)]
                yield g[["rep", "label"]].assign(signs=list(np.stack(signs, axis=1)))

    signs = reps.select("rep", "label", "v").mapInPandas(signed, "rep long, label string, signs array<long>")
    signs = materialize(signs.select("rep", "label", F.posexplode("signs").alias("t", "sign")), "vec-signs")
    key = ["label", "t", "sign"]
    several = signs.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1").select(key)
    return reps.join(join_aggregate(signs, several, key).select("rep").distinct(), "rep", "left_semi")


def _audited(spark, pool: DataFrame, reps: DataFrame, links: DataFrame, threshold: float, rows: int):
    """(mean recall of the rows with links in a sample of ``pool``, their number, rows sampled)."""
    sample = (
        pool.orderBy(F.xxhash64(F.lit("audit"), "rep")).limit(rows)
        .select("rep", "label", "v").toPandas()
    )
    if sample.empty:
        return 1.0, 0, 0
    by_label = {k: (g["rep"].to_numpy(), unit(g["v"])) for k, g in sample.groupby("label")}
    shared = spark.sparkContext.broadcast(by_label)

    def count(frames):
        for f in frames:
            for label, g in f.groupby("label"):
                if label in shared.value:
                    ids, q = shared.value[label]
                    hit = (q @ unit(g["v"]).T) >= threshold
                    hit &= ids[:, None] != g["rep"].to_numpy()[None, :]
                    true_n = hit @ g["copies"].to_numpy()
                    some = true_n > 0
                    yield pd.DataFrame({"rep": ids[some], "true_n": true_n[some]})

    true = (
        reps.select("rep", "label", "v", "copies").mapInPandas(count, "rep long, true_n long")
        .groupBy("rep").agg(F.sum("true_n").alias("true_n"))
    )
    got = true.join(links, "rep", "left").agg(
        F.avg(F.least("true_n", F.coalesce("n", F.lit(0))) / F.col("true_n")), F.count("*")
    ).first()
    return got[0], got[1], len(sample)
