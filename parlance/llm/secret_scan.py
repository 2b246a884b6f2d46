"""Operator 3: secret scan with multipart credential linking, in built-in functions.

Strong parts (assignments, access ids, hex keys) are always reported. Weak
parts (account names, long opaque strings, endpoints) are reported only when
the parts that complete a credential lie in the same scope: intervals with at
most ``scope`` code points between them, in the same document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parlance.llm.common import materialize

SCOPE = 200

# kind -> (pattern, group whose length counts, least length). Kinds in report order.
# The hex and access quantifiers fold the least length in: their runs are maximal.
KINDS = {
    "assign": (
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
        r"([A-Za-z0-9+/_.=-]+)",
        2, 6,
    ),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "ident": (
        r"(?i)(username|user|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?"
        r"([A-Za-z0-9._@+-]+)",
        2, 3,
    ),
    "key": (r"[A-Za-z0-9/+]{32,}={0,2}", 0, 32),
    "endpoint": (
        r"(https?|ftp|postgres|postgresql|mysql|mongodb|redis)://[^\x20\x09-\x0D\"'<>]+", 0, 8,
    ),
}
BASE = ("assign", "access", "hex")
IDENTIFIERS = ("access", "ident")
SECRETS = ("assign", "hex", "key")


def _matches(text: Column, kind: str) -> Column:
    """Every match of a kind: its number, the gap before it, its length, and
    whether it is long enough. Gaps come from splitting on the same pattern."""
    pattern, group, least = KINDS[kind]
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.transform(
        F.arrays_zip(whole.alias("w"), counted.alias("c"), F.slice(gaps, 1, F.size(whole)).alias("g")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.cast("long").alias("pos"),
            F.length(x["g"]).cast("long").alias("gap"), F.length(x["w"]).cast("long").alias("len"),
            (F.length(x["c"]) >= least).alias("ok"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,pos:bigint,gap:bigint,len:bigint,ok:boolean>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE
) -> DataFrame:
    """One row per reported span: ``row_id, id_col, kind, start, end``.

    Offsets are code points, end exclusive. A document without spans has one
    row with null ``kind``; null text counts as empty. ``row_id`` numbers the
    input rows, so repeated rows and repeated or null ids stay apart. Other
    columns, whatever their names, are not read. No rows in, no rows out.

    The texts are read once: the matches go to a table in the shared folder,
    and all linking runs on that. The interval join is a merge over the parts of a
    row in order of their starts: of a role's parts that begin no later, the
    greatest end is nearest (or lies inside), of those that begin no earlier, the
    least start. That decides it, however long the parts, without listing pairs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), text.alias("t")
    )
    raw = raw.select(
        "row_id", "id", F.explode_outer(F.concat(*[_matches(F.col("t"), k) for k in KINDS])).alias("m")
    ).select("row_id", "id", "m.*")
    raw = materialize(raw, "secret-parts")

    upto = W.partitionBy("row_id", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    part = (
        raw.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto))
        .withColumn("start", F.col("end") - F.col("len"))
        .where(F.col("kind").isNull() | F.col("ok"))
        .select("row_id", "id", "kind", "start", "end")
    )
    parts = part.where(F.col("kind").isNotNull())
    before = W.partitionBy("row_id").orderBy("start").rangeBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy("row_id").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, W.currentRow)

    def near(role: Column) -> Column:
        gap_before = F.col("start") - F.max(F.when(role, F.col("end"))).over(before)
        gap_after = F.min(F.when(role, F.col("start"))).over(after) - F.col("end")
        return F.coalesce(gap_before <= scope, F.lit(False)) | F.coalesce(gap_after <= scope, F.lit(False))

    has_id, has_secret = near(F.col("kind").isin(*IDENTIFIERS)), near(F.col("kind").isin(*SECRETS))
    linked = (
        parts.select("*", has_id.alias("has_id"), has_secret.alias("has_se"))
        .where(~F.col("kind").isin(*BASE))
        .where(
            F.when(F.col("kind") == "ident", F.col("has_se"))
            .when(F.col("kind") == "key", F.col("has_id"))
            .otherwise(F.col("has_id") & F.col("has_se"))
        )
        .select("row_id", "id", "kind", "start", "end")
    )
    strong = part.where(F.col("kind").isin(*BASE)).select("row_id", "id", "kind", "start", "end")
    rows = raw.select("row_id", "id").distinct()
    spans = strong.unionByName(linked)
    return spans.unionByName(
        rows.join(spans.select("row_id").distinct(), "row_id", "left_anti").select(
            "row_id", "id", F.lit(None).cast("string").alias("kind"),
            F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"),
        )
    ).withColumnRenamed("id", id_col)


def secret_digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: counts of base kinds, digest of base spans, all spans as text."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    item = F.struct(
        F.col("start"), F.element_at(order, F.col("kind")).alias("o"), F.col("kind"), F.col("end")
    )
    listed = F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), item)))
    told = lambda a: F.array_join(
        F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}")
    per = spans.groupBy("row_id", id_col).agg(*[count(k) for k in BASE], listed.alias("a"))
    base = F.filter(F.col("a"), lambda x: x["kind"].isin(*BASE))
    return per.select(
        id_col, *[f"n_{k}" for k in BASE], F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("a")).alias("spans"),
        (F.size("a") - F.size(base)).cast("long").alias("n_linked"),
    )
