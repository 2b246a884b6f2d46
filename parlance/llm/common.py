"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.session import fresh_path

BUCKET_ROWS = 50_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to a new folder under ``spark.checkpoint.dir`` and read back.

    Cuts the lineage with a table every executor can read, so a lost executor
    costs a reread and not a recomputation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rank_in_groups(
    df: DataFrame,
    group: list[str],
    order: list[str],
    out: str,
    buckets: int,
    per_group: DataFrame | None = None,
    spread: list[str] | None = None,
) -> DataFrame:
    """Add ``out``: a gapless 0-based rank inside each group (non-null columns).

    A group may hold any share of the rows, so it is never sorted in one task:
    rows are dealt to ``buckets`` hash buckets of ``spread`` (by default
    ``order``), ranked inside (group, bucket), and moved up by the rows of the
    group's earlier buckets (one row per group and bucket). The rank follows
    (bucket, order), so it is the same in every run as far as these columns
    are. Rows equal in all of ``spread`` share a bucket.
    ``per_group`` (the group columns and more) is joined on, also by bucket, so
    a large group does not meet in one task for that either.
    """
    b, n, off = "__bucket", "__n", "__off"
    df = df.withColumn(b, F.pmod(F.xxhash64(*(spread or order)), F.lit(buckets)).cast("int"))
    before = W.partitionBy(*group).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    counts = df.groupBy(*group, b).agg(F.count("*").alias(n))
    counts = counts.withColumn(off, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    if per_group is not None:
        counts = counts.join(per_group, group)
    ranked = df.withColumn(
        out, F.row_number().over(W.partitionBy(*group, b).orderBy(*order)) - 1
    )
    ranked = ranked.join(counts, [*group, b])
    return ranked.withColumn(out, (F.col(out) + F.col(off)).cast("long")).drop(b, off)


def join_aggregate(rows: DataFrame, agg: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to a table that is already grouped by the join keys.

    AQE splits the partition of a hot key only where plain shuffles feed both
    sides, and an aggregate on the same keys is not shuffled again. A hash of
    the keys as one more key makes Spark do that, for the price of one more
    shuffle of the smaller side.
    """
    h = "__join_hash"
    return (
        rows.withColumn(h, F.xxhash64(*on)).join(agg.withColumn(h, F.xxhash64(*on)), [*on, h], how)
        .drop(h)
    )


def buckets_for(rows: int) -> int:
    """Hash buckets so that one holds about ``BUCKET_ROWS`` rows."""
    return max(8, -(-rows // BUCKET_ROWS))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) long pairs -> (id, component), the smallest id reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every
    vertex links its larger neighbours, then its smaller ones, to the smallest
    one it knows. Rounds are written to the shared folder, and stop when the
    edge set no longer changes; the number of rounds is logarithmic in
    practice. A hub's list is never gathered: its minimum is an aggregate, and
    AQE splits the join that hands it back.
    """
    e = edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")
    ).distinct()
    e = materialize(e, "cc")
    last = None
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            join_aggregate(both.where(F.col("b") > F.col("a")), least, ["a"])
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = large.where(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = join_aggregate(large, least, ["a"])
        small = (
            pairs.select(F.col("b").alias("x"), "m")
            .union(pairs.select(F.col("a").alias("x"), "m"))
            .where(F.col("x") != F.col("m"))
            .select(F.col("x").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        e = materialize(small, "cc")
        now = e.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
