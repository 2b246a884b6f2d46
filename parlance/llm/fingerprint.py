"""Operator 13: document fingerprints by one-permutation MinHash, in built-in functions.

Every shingle is hashed once, to 64 bits. The highest eight bits name one of 256
bins, and the least hash of a bin is its minimum. A bin without shingles takes
the minimum of another bin by optimal densification: it has a fixed random walk
over all bins, and the first bin on it that is not empty lends its minimum. Of
each minimum the lowest four bits are kept, one hex digit a bin, so a
fingerprint is 256 digits. Two digits agree by chance once in 16 times, which
``likeness`` takes out.

A text is a projection: no shuffle, no join and no Python. It is held in its
task with its words and one hash a shingle, about 100 bytes a word, so a text
of 100 MB asks for some 2 GB.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm.common import materialize

WIDTH = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 4
# Walks are (step * t + start) mod 257: each visits all bins once, and 256 is no bin.
PRIME = 257
# Steps of a walk that are looked up; bins still empty then search all that are not.
TRIES = 24
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
RANGES_MOST = 65_536


def walk(b: int) -> tuple[int, int]:
    """(step, start) of the walk of bin ``b``, from a hash of its number."""
    x = int.from_bytes(hashlib.md5(f"bin {b}".encode()).digest()[:8], "big")
    return 1 + x % (PRIME - 1), x // PRIME % PRIME


STEPS = [walk(b)[0] for b in range(BINS)]
STARTS = [walk(b)[1] for b in range(BINS)]


def _numbers(values, kind: str) -> Column:
    """A literal array, told to Spark as one text, which the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def with_fingerprint(df: DataFrame, text_col: str, out: str, width: int = WIDTH) -> DataFrame:
    """Add ``out``: the fingerprint of ``text_col`` over shingles of ``width`` words.

    Words are runs of other than the six ASCII space characters, as they stand. A
    text of fewer words is one shingle; a text without words, empty or null, has
    the empty fingerprint. Equal texts have equal fingerprints, and repeated
    rows stay as they are. ``out`` replaces a column of its name; five names
    beginning with ``out`` and two underscores are used inside.
    """
    words, hashes, least, low, held = (f"{out}__{x}" for x in ("words", "hashes", "least", "low", "held"))
    text = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACES))
    df = df.withColumn(words, F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, SPACE)))
    # slice() and sequence() once a text: inside the lambda they would cost its length every time
    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1)))
    made = F.transform(
        heads, lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + k) for k in range(1, width)])
    )
    # one more entry ends every bin, so that each has one
    inside = 64 - BIN_BITS
    end = (1 << inside) - 1
    ends = _numbers((((b - BINS // 2) << inside) | end for b in range(BINS)), "bigint")
    df = df.withColumn(hashes, F.sort_array(F.concat(made, ends))).drop(words)
    df = df.withColumn(
        least,
        F.filter(
            hashes,
            lambda h, i: (i == 0) | (F.shiftright(F.get(F.col(hashes), i - 1), inside) < F.shiftright(h, inside)),
        ),
    ).drop(hashes)
    bits = lambda h: h.bitwiseAND(F.lit((1 << BITS) - 1))
    df = df.withColumn(
        low, F.transform(least, lambda h: F.when(h.bitwiseAND(F.lit(end)) != F.lit(end), bits(h)))
    ).drop(least)
    df = df.withColumn(
        held,
        F.filter(F.transform(low, lambda d, j: j.cast("long") * (1 << BITS) + d), lambda x: x.isNotNull()),
    )
    # the place t of bin j on the walk of bin i is (j - start) / step
    inverse = _numbers((pow(s, -1, PRIME) for s in STEPS), "int")
    starts = _numbers(STARTS, "int")
    tries = [_numbers(((s * t + a) % PRIME for s, a in zip(STEPS, STARTS)), "int") for t in range(TRIES)]

    def rest(i: Column) -> Column:
        place = lambda x: (
            (F.shiftright(x, BITS) - F.get(starts, i) + PRIME) * F.get(inverse, i) % PRIME
        )
        return bits(F.array_min(F.transform(held, lambda x: place(x) * (1 << BITS) + bits(x))))

    full = F.transform(
        low, lambda d, i: F.coalesce(d, *[F.get(F.col(low), F.get(t, i)) for t in tries], rest(i))
    )
    hex_digits = _numbers((f"{d:x}" for d in range(1 << BITS)), "string")
    digits = F.array_join(F.transform(full, lambda d: F.get(hex_digits, d.cast("int"))), "")
    return df.withColumn(out, F.when(F.size(held) > 0, digits).otherwise("")).drop(low, held)


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """The estimated share of common shingles (Jaccard) of two fingerprints, 0 to 1.

    The share of agreeing digits less what agrees by chance. Two empty
    fingerprints are alike (1), an empty and another one are not (0).
    """
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda s: s))
    chance = 1.0 / (1 << bits)
    share = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    return (
        F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(F.greatest(share, F.lit(0.0)))
    )


def _range_of(key: Column, bounds: list, kinds: list[str]) -> Column:
    """How many of the sorted ``bounds`` (structs as ``key``) are not above ``key``."""
    if not bounds:
        return F.lit(0)
    cols = [F.lit([b[j] for b in bounds]).cast(f"array<{t}>").alias(f"k{j}") for j, t in enumerate(kinds)]
    table = F.arrays_zip(*cols)
    step = int(len(bounds) ** 0.5) + 1
    heads = F.arrays_zip(
        *[F.lit([b[j] for b in bounds[::step]]).cast(f"array<{t}>").alias(f"k{j}") for j, t in enumerate(kinds)]
    )
    upto = lambda a: F.size(F.filter(a, lambda b: b <= key))
    part = F.greatest(upto(heads) - 1, F.lit(0)) * step
    return part + upto(F.slice(table, part + 1, F.lit(step)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text, fp, next_text, next_fp``: each row, the one after it in
    ascending order of ids (null first; after the last: the first), and their
    fingerprints.

    Rows of equal id follow a hash of their texts, and repeated rows stand next to
    each other. A null text counts as empty. The only row of a table is its own
    next. Other columns, whatever their names, are not read. No rows in, no
    rows out.

    The order is cut into ranges at exact (id, hash, salt) bounds taken from
    Spark's own range partitioner, so a repeated id or row, whatever its share of
    the rows, is cut like any other. The texts are shuffled once, by range; the
    next row comes from a window inside the range, and the last row of a range
    takes the first of the next one, of which there is one row a range. At most
    65,536 bounds of three numbers reach the driver.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    key = ["id", "h", "salt"]
    ranges = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), RANGES_MOST)
    least = (
        rows.select(key).repartitionByRange(ranges, *key)
        .groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*key)).alias("least"))
    )
    bounds = [r["least"] for r in sorted(least.collect(), key=lambda r: r["p"])][1:]
    rows = rows.withColumn("key", F.struct(*[F.col(c).alias(f"k{j}") for j, c in enumerate(key)]))
    rows = rows.withColumn("range", _range_of(F.col("key"), bounds, [kind, "bigint", "bigint"])).drop("key")
    inside = W.partitionBy("range").orderBy(F.col("id").asc_nulls_first(), "h", "salt")
    first = rows.withColumn("at", F.row_number().over(inside)).where("at = 1").select("range", "text")
    first = materialize(with_fingerprint(first, "text", "fp"), "range-heads")
    # the range before each, by number alone: one integer a range
    order = W.orderBy("range")
    shift = first.select("range").select(
        F.col("range").alias("head"), F.lag("range").over(order).alias("before"),
        F.max("range").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("last"),
    )
    shift = shift.select("head", F.coalesce("before", "last").alias("range"))
    heads = first.withColumnRenamed("range", "head").join(shift, "head").select(
        "range", F.col("text").alias("head_text"), F.col("fp").alias("head_fp")
    )
    rows = with_fingerprint(rows.repartition("range"), "text", "fp")
    rows = rows.select(
        "range", "id", "text", "fp",
        F.lead("text").over(inside).alias("in_text"), F.lead("fp").over(inside).alias("in_fp"),
    )
    return rows.join(heads, "range", "left").select(
        F.col("id").alias(id_col), "text", "fp",
        F.coalesce("in_text", "head_text").alias("next_text"),
        F.coalesce("in_fp", "head_fp").alias("next_fp"),
    )


def edited_text(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by as many first
    ones of ``other`` (or all, if it has fewer)."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: fingerprints of the text and of its edited text, and the likeness
    of the first to the second and to the next row's."""
    rows = with_next(docs, id_col, text_col)
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        id_col, F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
