"""Operator 4: URL filtering by hashed host-suffix and path-prefix expressions.

A URL is expanded into every (host suffix, path prefix) a rule could have; each
expression is hashed, joined to the rules on a short hash prefix, and confirmed
on the full digest. Among the confirmed rules the longest decides.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8  # 4 bytes of the digest
BROADCAST_RULES = 200_000  # rules of at most MAX_RULE characters: about 100 MB
MAX_RULE = 300
SALTS = 64


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://``, ASCII lower-cased; path up to ? or #."""
    pat = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    host = F.translate(
        F.regexp_extract(u, pat, 1), string.ascii_uppercase, string.ascii_lowercase
    )
    return host, F.regexp_extract(u, pat, 2)


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    prefix_hex: int = PREFIX_HEX,
) -> DataFrame:
    """One row per input row: ``id_col, host, path, rule, verdict``.

    ``rules`` has (host, path, action). A rule fits its host and all subdomains
    when the URL's path starts with the rule's (any character prefix). Of the
    rules that fit, the longest host + path wins; at equal length the longer
    host, then ``block``. ``rule`` is host + path of the winner, else null with
    the ``default`` verdict. A null URL, or one without ``://``, has an empty
    host and path and fits no rule. Repeated rows are judged each; other
    columns, whatever their names, are not read. An empty table gives no rows.

    Rules of up to ``BROADCAST_RULES`` (counted, and measured in length) are
    broadcast; more are joined by a shuffle whose hot prefixes are salted.
    """
    digest = lambda c: F.sha2(c, 256)
    r = rules.select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_act")
    ).where(F.length("r_host") > 0)
    shape = r.agg(
        F.count("*").alias("n"),
        F.max(F.length("r_host") + F.length("r_path")).alias("longest"),
        F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.collect_set(F.length("r_path")).alias("lengths"),
    ).first()
    labels = sorted(shape["labels"]) or [1]
    lengths = sorted(shape["lengths"]) or [0]
    r = r.withColumn("r_expr", F.concat("r_host", "r_path"))
    r = r.select(
        "r_expr", "r_act", F.length("r_host").alias("r_hl"),
        digest(F.col("r_expr")).alias("r_digest"),
    ).withColumn("r_prefix", F.substring("r_digest", 1, prefix_hex))

    host, path = split_url(F.col(url_col))
    base = pages.select(
        F.monotonically_increasing_id().alias("u_row"), F.col(id_col).alias("u_id"),
        host.alias("u_host"), path.alias("u_path"),
    )
    parts = F.split("u_host", r"\.")
    n = F.size(parts)
    hosts = F.filter(
        F.transform(
            F.array(*[F.lit(k) for k in labels]),
            lambda k: F.when(
                (n >= k) & (F.col("u_host") != ""), F.array_join(F.slice(parts, n - k + 1, k), ".")
            ),
        ),
        lambda h: h.isNotNull(),
    )
    paths = F.transform(
        F.filter(F.array(*[F.lit(k) for k in lengths]), lambda k: k <= F.length("u_path")),
        lambda k: F.substring(F.col("u_path"), F.lit(1), k),
    )
    exprs = F.flatten(
        F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))
    )
    exp = (
        base.select("*", F.explode_outer(exprs).alias("u_expr"))
        .withColumn("u_digest", digest(F.col("u_expr")))
        .withColumn("u_prefix", F.substring("u_digest", 1, prefix_hex))
    )
    # joined on the short prefix alone; the full digest is confirmed on what meets
    near = F.col("u_prefix") == F.col("r_prefix")
    if shape["n"] <= BROADCAST_RULES and (shape["longest"] or 0) <= MAX_RULE:
        hit = exp.join(F.broadcast(r), near, "left")
    else:
        exp = exp.withColumn("u_salt", F.pmod(F.col("u_row"), F.lit(SALTS)).cast("int"))
        r = r.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = exp.join(r, near & (F.col("u_salt") == F.col("r_salt")), "left")
    best = F.max(
        F.when(
            F.col("u_digest") == F.col("r_digest"),
            F.struct(
                F.length("r_expr").alias("len"), F.col("r_hl").alias("hl"),
                (F.col("r_act") == "block").alias("block"), F.col("r_expr").alias("rule"),
                F.col("r_act").alias("act"),
            ),
        )
    )
    return hit.groupBy("u_row", "u_id", "u_host", "u_path").agg(best.alias("best")).select(
        F.col("u_id").alias(id_col), F.col("u_host").alias("host"), F.col("u_path").alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.act"), F.lit(default)).alias("verdict"),
    )
