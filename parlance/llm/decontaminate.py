"""Operator 9: benchmark decontamination by Wu-Manber search over words.

The patterns are the benchmark's windows of ``WINDOW`` words (a shorter item is
one window). Per pattern length there is a table that shifts the search past
every block of two words that cannot end a window, buckets keyed by a window's
last block, and a direct comparison of the words.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
BLOCK_BYTES = 2_000_000  # benchmark text broadcast and searched in one pass

# Word bytes: digits, lower-case letters and everything beyond ASCII; A-Z fold to a-z.
_WORD = bytes.maketrans(
    bytes(range(128)),
    bytes(
        c if 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
        for c in range(128)
    ),
)


def words(text: str | None) -> list[bytes]:
    """The text's words as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


class WuManber:
    """Shift tables and buckets for windows that all have ``m`` words."""

    def __init__(self, m: int, windows: dict[tuple, list]) -> None:
        self.m, self.block = m, min(2, m)
        self.default = m - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, list]] = {}
        for w, items in windows.items():
            for end in range(self.block, m + 1):
                key = w[end - self.block : end]
                if m - end < self.shift.get(key, self.default):
                    self.shift[key] = m - end
            self.bucket.setdefault(w[m - self.block :], {})[w] = items

    def search(self, text: list[bytes]):
        """(start, items) of every occurrence, in order of start."""
        m, block, default, shift = self.m, self.block, self.default, self.shift.get
        end, n = m, len(text)
        if block == 2:
            while end <= n:
                key = (text[end - 2], text[end - 1])
                s = shift(key, default)
                if s:
                    end += s
                    continue
                hit = self.bucket[key].get(tuple(text[end - m : end]))
                if hit is not None:
                    yield end - m, hit
                end += 1
        else:
            for at, w in enumerate(text):
                hit = self.bucket.get((w,))
                if hit is not None:
                    yield at, hit[(w,)]


def build_tables(items: list[tuple[str, str]], window: int = WINDOW) -> list[WuManber]:
    """One searcher per pattern length from (item id, text) pairs."""
    by_length: dict[int, dict[tuple, list]] = {}
    for item, text in items:
        ws = words(text)
        m = min(window, len(ws))
        if m:
            found = by_length.setdefault(m, {})
            for i in range(len(ws) - m + 1):
                ids = found.setdefault(tuple(ws[i : i + m]), [])
                if not ids or ids[-1] != item:
                    ids.append(item)
    return [WuManber(m, found) for m, found in sorted(by_length.items())]


def find_hits(text: str | None, tables: list[WuManber]) -> tuple[int, list, list]:
    """(number of words, merged word spans inside a window, sorted item ids)."""
    ws = words(text)
    marks, items = [], set()
    for t in tables:
        for start, ids in t.search(ws):
            marks.append((start, start + t.m))
            items.update(ids)
    spans: list[list[int]] = []
    for a, b in sorted(marks):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return len(ws), spans, sorted(items)


_HITS = pa.struct(
    [("n", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))]
)
_HITS_DDL = "struct<n:bigint,spans:array<array<bigint>>,items:array<string>>"


def _searcher(tables) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        t = tables.value
        rows = [dict(zip(("n", "spans", "items"), find_hits(x.as_py(), t))) for x in texts]
        return pa.array(rows, _HITS)

    return F.arrow_udf(run, _HITS_DDL)


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    out: str = "hits",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``out``: struct of ``n`` words, the disjoint word ``spans``
    [start, end) that lie in occurrences of benchmark windows, and the sorted
    distinct ``items`` (ids as strings; a null id reads ``null``) found.

    Null or wordless texts have no words and no hits; wordless items no
    windows. Ties, repeated rows and repeated items count once per row and once
    per id. Other columns of ``docs`` pass through; ``out`` must be a new name.

    The benchmark is measured, dealt into blocks of about ``block_bytes`` of
    text by a hash of its text, and each block's tables are broadcast for one
    search in the same narrow stage. Documents are never shuffled.
    """
    spark = docs.sparkSession
    b = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"),
        F.col(item_text_col).alias("t"),
    ).where(F.col("t").isNotNull())
    total = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    cols = []
    for k in range(blocks):
        part = b.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k) if blocks > 1 else b
        items = [(r["i"], r["t"]) for r in part.orderBy("i").toLocalIterator()]
        tables = spark.sparkContext.broadcast(build_tables(items, window))
        cols.append(_searcher(tables)(F.col(text_col)))
    if blocks == 1:
        return docs.withColumn(out, cols[0])
    # several blocks: join the spans of all, then merge the touching ones
    names = [f"__hits{k}" for k in range(blocks)]
    df = docs.withColumns(dict(zip(names, cols)))
    spans = F.array_sort(F.flatten(F.array(*[F.col(f"{x}.spans") for x in names])))
    empty = F.array().cast("array<array<bigint>>")
    start = F.struct(empty.alias("done"), F.lit(None).cast("array<bigint>").alias("open"))

    def step(acc, x):
        done, now = acc["done"], acc["open"]
        joined = F.array(now[0], F.greatest(now[1], x[1]))
        return (
            F.when(now.isNull(), F.struct(done.alias("done"), x.alias("open")))
            .when(x[0] <= now[1], F.struct(done.alias("done"), joined.alias("open")))
            .otherwise(
                F.struct(F.concat(done, F.array(now)).alias("done"), x.alias("open"))
            )
        )

    merged = F.aggregate(
        spans, start, step,
        lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(
            F.concat(a["done"], F.array(a["open"]))
        ),
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{x}.items") for x in names]))))
    return df.withColumn(
        out, F.struct(F.col(f"{names[0]}.n").alias("n"), merged.alias("spans"), items.alias("items"))
    ).drop(*names)


def hit_words(out: str = "hits") -> Column:
    """Number of words inside hits."""
    return F.aggregate(
        F.transform(F.col(f"{out}.spans"), lambda s: s[1] - s[0]),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )


def is_contaminated(out: str = "hits") -> Column:
    """At least one hit word, and at least a twentieth of the words hit."""
    n = hit_words(out)
    return (n > 0) & (20 * n >= F.col(f"{out}.n"))
