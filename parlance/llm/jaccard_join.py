"""Operator 10: n-gram Jaccard join by MinHash banding.

Texts become sets of five-word shingles. Bands of MinHash rows, sized for a
target recall, are shuffled on their hashes; sketches drop buckets' chance
pairs; and every remaining pair is verified on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm.batches import bounds, mix, powers, whole_groups
from parlance.llm.common import connected_components, materialize

WORDS = 5
SIMILARITY = Fraction(4, 5)
RECALL = 0.9999  # of a pair exactly at the similarity; pairs above it do better
ROWS = 5  # MinHash rows a band
MARGIN = 0.16  # sketches this far below the similarity are not verified
BLOCK = 256  # texts per block of a large cluster
BUCKET = 8192  # rows per block of a large band bucket

# Word bytes: digits, lower-case letters and everything beyond ASCII; A-Z fold to a-z.
_FOLD = np.array(
    [
        c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 0
        for c in range(256)
    ],
    dtype=np.uint8,
)


def bands_for(recall: float, similarity: Fraction = SIMILARITY, rows: int = ROWS) -> int:
    """Fewest bands with 1 - (1 - s^rows)^bands >= recall at the similarity."""
    return math.ceil(math.log(1 - recall) / math.log(1 - float(similarity) ** rows))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash per word, from prefix sums of a polynomial over the bytes."""
    if not text:
        return np.zeros(0, np.uint64)
    b = _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    inside = b != 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b.astype(np.uint64) * power[: len(b)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; a shorter text that
    has words is one run."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    s = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        s = s * np.uint64(0xD6E8FEB86659FD93) + w[i : i + len(s)]
    return np.unique(mix(s + np.uint64(k)))


def set_key(grams: np.ndarray) -> bytes:
    """128 bits that stand for a shingle set."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


class MinHash:
    """Band hashes and a sketch of one byte per row."""

    def __init__(self, bands: int, rows: int = ROWS) -> None:
        rng = np.random.default_rng(7)
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, bytes]:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), 2048):
            x = (grams[at : at + 2048, None] ^ self.b) * self.a
            np.minimum(low, x.min(axis=0), out=low)
        band = np.arange(self.bands, dtype=np.uint64)
        for r in low.reshape(self.bands, self.rows).T:
            band = mix(band * np.uint64(0xD6E8FEB86659FD93) + r)
        return band.view(np.int64), (mix(low) >> np.uint64(56)).astype(np.uint8).tobytes()


_SIGNATURE = pa.struct(
    [("n", pa.int32()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())]
)


def _signer(hasher: MinHash):
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            g = shingles(t.as_py())
            if len(g):
                bands, sketch = hasher(g)
                out.append({"n": len(g), "key": set_key(g), "bands": bands.tolist(), "sketch": sketch})
            else:
                out.append(None)
        return pa.array(out, _SIGNATURE)

    return F.arrow_udf(run, "struct<n:int,key:binary,bands:array<bigint>,sketch:binary>")


def bucket_links(sketch: np.ndarray, least: float) -> np.ndarray:
    """Per row, a row of its component where at least ``least`` of the sketch agrees.

    A breadth-first walk that compares each reached row with the rows not yet
    reached, so a bucket of near copies costs little more than its size.
    """
    n = len(sketch)
    root = np.arange(n)
    rest = np.arange(n)
    need = least * sketch.shape[1]
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        frontier = [seed]
        while frontier and len(rest):
            x = frontier.pop()
            near = (sketch[rest] == sketch[x]).sum(axis=1) >= need
            if near.any():
                got = rest[near]
                root[got] = seed
                frontier.extend(got)
                rest = rest[~near]
    return root


def _candidates(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["band", "i", "j"]):
            rep = t.column("rep").to_numpy()
            cuts = bounds([t.column(c).to_numpy() for c in ("band", "i", "j")])
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(rep), -1)
            root = np.arange(len(rep))
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]
            if len(two):
                near = (sketch[two] == sketch[two + 1]).mean(axis=1) >= least
                root[two[near] + 1] = two[near]
            for k in np.flatnonzero(size > 2):
                a, b = cuts[k], cuts[k + 1]
                root[a:b] = a + bucket_links(sketch[a:b], least)
            far = root != np.arange(len(rep))
            yield pa.RecordBatch.from_arrays([pa.array(rep[far]), pa.array(rep[root[far]])], ["src", "dst"])

    return run


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of presence blocks."""
    n = len(sets)
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.append(True, value[1:] != value[:-1])
    column = np.cumsum(new) - 1
    both = np.bincount(column)[column] > 1
    owner, column = owner[both], np.unique(column[both], return_inverse=True)[1]
    out = np.diag([len(s) for s in sets]).astype(np.float64)
    np.fill_diagonal(out, 0)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + columns, columns))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            m = np.zeros((n, columns), np.float32)
            m[owner[a:b], column[a:b] - column[a]] = 1
            out += m @ m.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out.astype(np.int64)


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index of each row's component in a symmetric boolean matrix."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(root)).min(axis=1)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(words: int, similarity: Fraction):
    p, q = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["cluster", "i", "j"]):
            cuts = bounds([t.column(c).to_numpy() for c in ("cluster", "i", "j")])
            reps, links, roots = [], [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                g = t.slice(a, b - a)
                rows: dict[int, tuple] = {}
                for rep, copies, block, text in zip(
                    *(g.column(c).to_pylist() for c in ("rep", "copies", "block", "text"))
                ):
                    rows[rep] = (copies, block, shingles(text, words))
                if len(rows) < 2:
                    continue
                ids = np.array(sorted(rows))
                copies = np.array([rows[r][0] for r in ids])
                block = np.array([rows[r][1] for r in ids])
                sets = [rows[r][2] for r in ids]
                size = np.array([len(s) for s in sets])
                common = shared_counts(sets)
                linked = (p + q) * common >= p * (size[:, None] + size[None, :])
                np.fill_diagonal(linked, False)
                if g.column("i")[0] != g.column("j")[0]:
                    linked &= block[:, None] != block[None, :]
                reps.append(ids)
                links.append(linked @ copies)
                roots.append(ids[_roots(linked)])
            if reps:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in (reps, links, roots)],
                    ["rep", "n", "root"],
                )

    return run


def jaccard_classes(
    docs: DataFrame,
    similarity: Fraction = SIMILARITY,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``id_col, class_id, n_links, kept``.

    Two rows are linked if the Jaccard similarity of their sets of five-word
    shingles (lower-cased words; a shorter text is one shingle) is at least
    ``similarity``. ``n_links`` counts the other rows linked directly, equal
    texts included. ``class_id`` is the least id reachable by links, ``kept``
    whether it is the row's own. Rows without words (null or empty text too)
    link with nothing. Repeated rows count as rows and share their class; a null
    id takes part, is left out of the least id, and counts as kept only if its
    class has no id. Other columns are not read. No rows in, no rows out.

    Texts with equal shingle sets are one representative with a count. Bands
    come from ``bands_for``: a pair at the similarity is met with probability
    ``recall``. Rows of a bucket whose sketches agree too little are not
    candidates (the margin is four standard deviations of the sketch); the rest
    form clusters. A bucket beyond ``BUCKET`` rows is dealt into blocks, and each
    pair of blocks is searched in one task. Large clusters are dealt into blocks, and each pair of blocks
    is verified on full sets in one task, which returns counts and component
    roots, never pairs. Texts are written once beside their signatures, by row, so
    that each class fetches one text whatever the ids are.
    """
    hasher = MinHash(bands_for(recall, similarity))
    spark = docs.sparkSession
    signed = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
        _signer(hasher)(F.col(text_col)).alias("s"), F.col(text_col).alias("text"),
    ).select("rid", "id", "s.key", "s.bands", "s.sketch", "text")
    signed = materialize(signed, "join-signatures")
    classes = materialize(
        signed.where("key is not null").groupBy("key").agg(
            F.min("rid").alias("rep"), F.count("*").alias("copies"), F.min("id").alias("low")
        ),
        "join-classes",
    )
    reps = signed.select(F.col("rid").alias("rep"), "bands", "sketch").join(
        classes.select("rep"), "rep", "left_semi"
    )
    reps = materialize(reps, "join-reps")
    buckets = (
        reps.select("rep", F.explode("bands").alias("band"))
        .withColumn("members", F.count("*").over(W.partitionBy("band")))
        .where("members > 1")
        .withColumn("k", F.ceil(F.col("members") / BUCKET).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64(F.lit("bucket"), "rep"), F.col("k")).cast("int"))
        # a pair of blocks holds the pairs inside each of the two as well
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .where("k = 1 or other <> block")
        .select("band", "rep", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    least = float(similarity) - MARGIN
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = (
        buckets.join(reps.select("rep", "sketch"), "rep")
        .repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")
        .mapInArrow(_candidates(least), "src long, dst long")
    )
    cluster = materialize(connected_components(near), "join-clusters")
    sizes = cluster.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    member = (
        cluster.join(sizes, "component").join(classes, F.col("id") == F.col("rep"))
        .select(
            F.col("component").alias("cluster"), "rep", "copies", "k",
            F.pmod(F.xxhash64(F.lit("block"), "rep"), F.col("k")).cast("int").alias("block"),
        )
    )
    texts = signed.where("key is not null").select(F.col("rid").alias("rep"), "text")
    dealt = (
        texts.join(member, "rep")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .select("cluster", "i", "j", "rep", "copies", "block", "text")
    )
    found = materialize(
        dealt.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        .mapInArrow(_verify(WORDS, similarity), "rep long, n long, root long"),
        "join-found",
    )
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    info = (
        classes.join(links, "rep", "left")
        .join(comp, F.col("rep") == F.col("id"), "left")
        .select(
            "key", "low", F.coalesce("component", "rep").alias("component"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        )
    )
    lowest = info.groupBy("component").agg(F.min("low").alias("class_id"))
    info = info.join(lowest, "component").select(F.col("key").alias("k"), "class_id", "n_links")
    out = signed.select("id", "key").join(info, F.col("key") == F.col("k"), "left")
    cid = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return out.select(
        F.col("id").alias(id_col), cid.alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        cid.eqNullSafe(F.col("id")).alias("kept"),
    )
