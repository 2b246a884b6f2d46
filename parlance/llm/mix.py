"""Operator 8: mixing sources to target weights by entropy balancing.

Every source has a token target. Document rates are the least-information
change of the uniform rate 1, within [0, cap], that meets it: an exponential
tilt in the document's size, whose one multiplier per source is the root of the
convex dual's gradient. Newton steps find the multipliers of all sources at
once over a histogram of sizes; the rates are then rounded into whole copies.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import buckets_for, materialize, rank_in_groups

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # of all sizes, as a fraction
CAP = 2
TOLERANCE = 1e-6
MAX_STEPS = 60


def token_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    n = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(n, F.lit(0)).cast("long")


def _indexed(sources: DataFrame) -> DataFrame:
    """Sources numbered in code point order, null last."""
    sources = sources.orderBy(F.col("__source").asc_nulls_last())
    schema = "__source string, __source_size bigint, __sid bigint"
    return sources.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(schema)


def source_targets(
    sources: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP
) -> DataFrame:
    """``__sid, __source, __source_size, __target`` per source.

    Weights repeat over the sources in code point order. The pool is ``share``
    of all sizes; a target above ``cap`` times its source's size stops there and
    the excess is shared again by weight, until none is above. All sums are
    exact integers, so reruns agree to the last bit.
    """
    s = materialize(_indexed(sources), "mix-sources")
    k = F.pmod(F.col("__sid"), F.lit(len(weights))) + 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), k.cast("int")).cast("decimal(38,0)")
    room = (cap * F.col("__source_size")).cast("decimal(38,0)")
    s = s.select("*", w.alias("__w"), room.alias("__room"))
    total = int(s.agg(F.sum("__source_size")).first()[0] or 0)
    num, den, above = None, 1, F.lit(False)
    while True:
        got = s.agg(
            F.sum(F.when(above, F.col("__room"))), F.sum(F.when(~above, F.col("__w")))
        ).first()
        full, rest = int(got[0] or 0), int(got[1] or 0)
        new = (share[0] * total - share[1] * full, share[1] * rest)
        if not rest or (num is not None and new[0] * den == num * new[1]):
            break
        num, den = new
        above = F.col("__w").cast("double") * num > F.col("__room").cast("double") * den
    target = F.when(above, F.col("__room").cast("double")).otherwise(
        F.col("__w").cast("double") * F.lit(float(num or 0)) / F.lit(float(den))
    )
    target = F.least(target, F.col("__room").cast("double"))
    return s.select("__sid", "__source", "__source_size", target.alias("__target"))


def _rate(lam: Column, z: Column, cap: int) -> Column:
    return cap / (1 + (cap - 1) * F.exp(-lam * z))


def solve_dual(hist: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """The multiplier ``__lam`` of each source; null where the target is the cap itself.

    ``hist`` has (__sid, __size, __n). The tilt variable is the size over the
    source's mean size. Each step is one aggregation of the dual's gradient and
    curvature over the histogram for every source; a step that leaves the
    bracket halves it instead, so it always converges; ``MAX_STEPS`` steps that do
    not get there raise. Sums are of decimals, so the result does not depend on
    the order of rows.
    """
    means = hist.groupBy("__sid").agg(F.sum("__n").alias("__docs"))
    state = targets.join(means, "__sid").select(
        "__sid", "__target",
        (F.col("__source_size") / F.col("__docs")).alias("__mean"),
        F.lit(0.0).alias("__lam"),
        F.lit(None).cast("double").alias("__lo"), F.lit(None).cast("double").alias("__hi"),
        ((F.col("__target") >= cap * F.col("__source_size")) | (F.col("__source_size") == 0))
        .alias("__fixed"),
    )
    state = materialize(state, "mix-dual")
    for _ in range(MAX_STEPS):
        z = F.col("__size") / F.col("__mean")
        tokens = F.col("__n") * F.col("__size")
        rate = _rate(F.col("__lam"), z, cap)
        exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")
        sums = (
            hist.join(state.where(~F.col("__fixed")), "__sid")
            .groupBy("__sid")
            .agg(
                exact(tokens * rate).alias("__got"),
                exact(tokens * z * rate * (1 - rate / cap)).alias("__slope"),
            )
        )
        g = F.coalesce(F.col("__got") - F.col("__target"), F.lit(0.0))
        lo = F.when(g < 0, F.col("__lam")).otherwise(F.col("__lo"))
        hi = F.when(g > 0, F.col("__lam")).otherwise(F.col("__hi"))
        near = F.abs(g) <= F.lit(TOLERANCE) * F.col("__target")
        newton = F.col("__lam") - F.try_divide(g, F.col("__slope"))
        state = state.join(sums, "__sid", "left").select(
            "__sid", "__target", "__mean", "__lam", lo.alias("__lo"), hi.alias("__hi"), "__fixed",
            (F.col("__fixed") | near).alias("__done"), newton.alias("__newton"),
        )
        inside = (
            F.col("__newton").isNotNull()
            & (F.col("__lo").isNull() | (F.col("__newton") > F.col("__lo")))
            & (F.col("__hi").isNull() | (F.col("__newton") < F.col("__hi")))
            & (F.abs(F.col("__newton")) <= 2 * F.abs(F.col("__lam")) + 4)
        )
        away = F.when(F.col("__hi").isNull(), 2 * F.abs(F.col("__lam")) + 1).when(
            F.col("__lo").isNull(), -2 * F.abs(F.col("__lam")) - 1
        )
        half = F.coalesce(away, (F.col("__lo") + F.col("__hi")) / 2)
        step = F.when(inside, F.col("__newton")).otherwise(half)
        state = state.withColumn(
            "__lam", F.when(F.col("__done"), F.col("__lam")).otherwise(step)
        ).drop("__newton")
        state = materialize(state, "mix-dual")
        if not state.where(~F.col("__done")).limit(1).collect():
            break
        state = state.drop("__done")
    else:
        raise RuntimeError(f"the dual of the mixture did not settle in {MAX_STEPS} steps")
    return state.select(
        "__sid", "__mean", F.when(~F.col("__fixed"), F.col("__lam")).alias("__lam")
    )


def round_copies(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies per size of one source, largest size first.

    The running difference between wanted and taken words is carried to the
    next size, so a source ends within about half of its smallest size, as far
    as [0, cap] copies of a document allow.
    """
    pdf = pdf.sort_values("__size", ascending=False)
    debt, out = 0.0, []
    for size, n, rate, cap in zip(pdf["__size"], pdf["__n"], pdf["__rate"], pdf["__cap"]):
        if size == 0:
            out.append(int(n))
            continue
        k = int((n * rate * size + debt) / size + 0.5)
        k = max(0, min(int(cap) * int(n), k))
        debt += (n * rate - k) * size
        out.append(k)
    return pd.DataFrame(
        {"__sid": pdf["__sid"], "__size": pdf["__size"], "__n": pdf["__n"], "__k": out}
    )


def mix_sources(
    docs: DataFrame,
    weights=WEIGHTS,
    share=SHARE,
    cap: int = CAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies``.

    Each row's size is its number of words (null or empty text: 0). A source's
    copies times sizes sum to near its target: the rounding is exact per size
    class, and inside a class the rows with the lowest hash of their id take
    the odd copies. A null source is one source, last in order. Rows without
    words keep one copy and take no words. Equal rows are separate rows, told
    apart only by order, which does not change the rows that come out. Columns
    of other names pass through; names starting with ``__`` or ``mix_`` are
    reserved. An empty table gives no rows.

    A source may hold any share of the rows: sums and Newton steps run over the
    (source, size) histogram, whose rows per source are bounded by the longest
    text in words, not by rows; the ranking inside a class is bucketed.
    """
    spark = docs.sparkSession
    sized = docs.withColumn("mix_size", token_count(F.col(text_col)))
    hist = sized.groupBy(
        F.col(source_col).cast("string").alias("__source"), F.col("mix_size").alias("__size")
    ).agg(F.count("*").alias("__n"))
    hist = materialize(hist, "mix-hist")
    sources = hist.groupBy("__source").agg(
        F.sum(F.col("__n") * F.col("__size")).alias("__source_size")
    )
    targets = materialize(source_targets(sources, weights, share, cap), "mix-targets")
    same = hist["__source"].eqNullSafe(targets["__source"])
    hist = materialize(
        hist.join(targets, same).select("__sid", "__size", "__n"), "mix-hist"
    )
    lam = solve_dual(hist, targets, cap)
    rate = F.when(F.col("__lam").isNull(), F.lit(float(cap))).otherwise(
        _rate(F.col("__lam"), F.col("__size") / F.col("__mean"), cap)
    )
    copies = (
        hist.join(lam, "__sid")
        .select("__sid", "__size", "__n", rate.alias("__rate"), F.lit(cap).alias("__cap"))
        .groupBy("__sid")
        .applyInPandas(round_copies, "__sid long, __size long, __n long, __k long")
    )
    copies = materialize(
        copies.join(targets, "__sid").select(
            F.coalesce("__source", F.lit("")).alias("__src"),
            F.col("__source").isNull().alias("__none"),
            F.col("__size").alias("mix_size"),
            F.col("__n").alias("__class"), "__k", F.col("__source_size").alias("mix_source_size"),
            F.col("__target").alias("mix_target"),
        ),
        "mix-copies",
    )
    rows = hist.agg(F.sum("__n")).first()[0] or 0
    keyed = sized.withColumns(
        {
            "__src": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
            "__none": F.col(source_col).isNull(),
            "__h": F.xxhash64(F.lit("mix"), F.col(id_col)),
            "__id": F.col(id_col),
        }
    )
    ranked = rank_in_groups(
        keyed, ["__src", "__none", "mix_size"], ["__h", "__id"], "__rank", buckets_for(rows), copies
    )
    n, k = F.col("__class"), F.col("__k")
    each = F.floor(k / n) + F.when(F.col("__rank") < k % n, 1).otherwise(0)
    return ranked.withColumn("mix_copies", each.cast("long")).drop(
        "__src", "__none", "__h", "__id", "__rank", "__class", "__k"
    )
