"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.chat_template import format_conversations, read_back
from parlance.llm.common import read
from parlance.llm.decontaminate import hit_words, is_contaminated, with_hits
from parlance.llm.fingerprint import edit_report
from parlance.llm.jaccard_join import jaccard_classes
from parlance.llm.langid import language
from parlance.llm.mix import mix_sources
from parlance.llm.secret_scan import KINDS, SCOPE, scan_secrets, secret_digest
from parlance.llm.shard import assign_shards
from parlance.llm.suffix_dedup import repeated_strings
from parlance.llm.turn_repair import damage, repair_report
from parlance.llm.url_filter import filter_urls
from parlance.llm.vector_graph import near_duplicates
from parlance.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its oracle if SQL can express it."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


# ---------------------------------------------------------------- operator 1
@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that start in two places."""
    return repeated_strings(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
        "kept_sha256",
    )


# ---------------------------------------------------------------- operator 2
# The conversation the contract adds.
EXTRA_TURN = "\\### Assistant: </turn> ok"


@query("op2_chat_format")
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, then read back from the output."""
    conv = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", EXTRA_TURN), (-7, 1, "assistant", EXTRA_TURN)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return read_back(format_conversations(conv.unionByName(extra)))


# ---------------------------------------------------------------- operator 3
def _sql_spans(kind: str) -> str:
    pattern, group, least = KINDS[kind]
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {list(KINDS).index(kind)} AS ko,
         CAST(list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[:i-1], lambda x: length(x))), 0) AS BIGINT) AS s,
         CAST(length(w[i]) AS BIGINT) AS len
  FROM (SELECT doc_id, w, c, g, unnest(range(1, len(w) + 1)) AS i FROM (
          SELECT doc_id, regexp_extract_all(t, '{pattern}') AS w,
                 regexp_extract_all(t, '{pattern}', {group}) AS c,
                 string_split_regex(t, '{pattern}') AS g FROM docs))
  WHERE length(c[i]) >= {least}"""


SQL_OP3 = f"""
WITH docs AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS MATERIALIZED (SELECT doc_id, kind, ko, s, s + len AS e FROM ({" UNION ALL ".join(_sql_spans(k) for k in KINDS)})),
ids AS (SELECT DISTINCT doc_id, s, e FROM found WHERE kind IN ('access', 'ident')),
secrets AS (SELECT DISTINCT doc_id, s, e FROM found WHERE kind IN ('assign', 'hex', 'key')),
judged AS (
  SELECT f.*,
         EXISTS (SELECT 1 FROM ids x WHERE x.doc_id = f.doc_id AND greatest(x.s - f.e, f.s - x.e) <= {SCOPE}) AS has_id,
         EXISTS (SELECT 1 FROM secrets x WHERE x.doc_id = f.doc_id AND greatest(x.s - f.e, f.s - x.e) <= {SCOPE}) AS has_se
  FROM found f),
kept AS (
  SELECT * FROM judged
  WHERE kind IN ('assign', 'access', 'hex') OR (kind = 'ident' AND has_se)
     OR (kind = 'key' AND has_id) OR (kind = 'endpoint' AND has_id AND has_se)),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ko) FILTER (ko < 3), '') AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ko) AS spans,
         count(*) FILTER (ko >= 3) AS n_linked
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM docs d LEFT JOIN per p ON d.doc_id = p.doc_id
"""


@query("op3_secret_scan", SQL_OP3)
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents, with linked weak candidates."""
    return secret_digest(scan_secrets(read(spark, sf_dir, "documents")))


# ---------------------------------------------------------------- operator 4
# The rules the contract gives.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

SQL_OP4 = f"""
WITH rules(host, path, act) AS (VALUES {", ".join(map(str, URL_RULES))}),
u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages)
SELECT page_id, host, path,
       (SELECT r.host || r.path FROM rules r
        WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
        ORDER BY length(r.host || r.path) DESC, length(r.host) DESC LIMIT 1) AS rule,
       coalesce((SELECT r.act FROM rules r
        WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
        ORDER BY length(r.host || r.path) DESC, length(r.host) DESC LIMIT 1), 'allow') AS verdict
FROM u
"""


@query("op4_url_filter", SQL_OP4)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return filter_urls(read(spark, sf_dir, "pages"), rules)


# ---------------------------------------------------------------- operator 5
@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents, learned from three quarters of the ids."""
    return language(read(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


# ---------------------------------------------------------------- operator 6
@query("op6_vector_dedup")
def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of equal label at cosine 0.93 or more."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- operator 7
@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards, row counts at most one apart, equal texts together."""
    return assign_shards(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# ---------------------------------------------------------------- operator 8
@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' target words."""
    return mix_sources(read(spark, sf_dir, "documents")).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"), F.col("mix_copies").alias("copies"),
    )


# ---------------------------------------------------------------- operator 9
_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

SQL_OP9 = f"""
WITH dw AS MATERIALIZED (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
bw AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
bwin AS MATERIALIZED (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
        FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM bwin),
dwin AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)),
occ AS MATERIALIZED (SELECT d.doc_id, d.i, d.m, b.item FROM dwin d JOIN bwin b ON d.m = b.m AND d.win = b.win),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""


@query("op9_decontaminate", SQL_OP9)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark windows found in every whole text of documents."""
    hits = with_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", F.col("hits.n").alias("n_words"), hit_words().alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


# ---------------------------------------------------------------- operator 10
@query("op10_jaccard_join")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and link counts of all documents at Jaccard 0.8 over five-word shingles."""
    return jaccard_classes(read(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- operator 11
# crc32 bit by bit over the ASCII key, its reversed polynomial in decimal
_CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(1, length(k) + 1), lambda p: ord(substring(k, p, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20"""

SQL_OP11 = f"""
WITH RECURSIVE
keyed AS (
  SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
numbered AS (SELECT *, {_CRC_SQL} AS n FROM keyed),
damaged AS (
  SELECT c, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN n = 1 THEN '' WHEN n = 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt,
         unnest(CASE WHEN n = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM numbered WHERE n <> 0),
ids AS (SELECT c, row_number() OVER (ORDER BY c) AS g FROM (SELECT DISTINCT conv_id AS c FROM conversations)),
placed AS (
  SELECT i.g, d.turn, d.role, d.txt,
         row_number() OVER (PARTITION BY i.g ORDER BY turn NULLS FIRST, role, sha256(txt), copy) AS i,
         regexp_replace(txt, '[\x20\x09-\x0D]+$', '') AS said
  FROM damaged d JOIN ids i ON d.c IS NOT DISTINCT FROM i.c),
judged AS MATERIALIZED (
  SELECT *, CASE WHEN said = '' THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, txt ORDER BY i) > 1 THEN 'd'
                 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         coalesce(lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS odd
  FROM placed),
figures AS (
  SELECT g, count(*) AS turns, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (odd) AS illegal
  FROM judged GROUP BY g),
walk(g, i, a, b, c, d) AS (
  SELECT g, turns, {{'cost': 0, 'audit': ''}}, {{'cost': 6, 'audit': 'II'}}, {{'cost': 3, 'audit': 'I'}}, {{'cost': 0, 'audit': ''}}
  FROM figures
  UNION ALL
  SELECT g, i, list_min([a, {{'cost': 3 + c2.cost, 'audit': 'I' || c2.audit}}]),
         list_min([b, {{'cost': 3 + c2.cost, 'audit': 'I' || c2.audit}}]), c2,
         list_min([d, {{'cost': 3 + c.cost, 'audit': 'I' || c.audit}}])
  FROM (
    SELECT g, i, a, b, c, d, list_min([c, {{'cost': 3 + d.cost, 'audit': 'I' || d.audit}}]) AS c2
    FROM (
      SELECT w.g, w.i - 1 AS i, {", ".join(f"""
        list_min([{{'cost': 4 + w.{s}.cost, 'audit': 'D' || w.{s}.audit}},
          {"".join(f"CASE WHEN j.fault NOT IN ('b', 'd') AND left(j.role, 1) = '{r}' THEN {{'cost': m + w.{t}.cost, 'audit': 'K' || w.{t}.audit}} END, " for r, t in goes.items())}
          CASE WHEN j.fault NOT IN ('b', 'd') THEN {{'cost': m + 3 + w.{w}.cost, 'audit': 'R' || w.{w}.audit}} END]) AS {s}"""
        for s, goes, w in (("a", {"s": "b", "u": "c"}, "c"), ("b", {"u": "c"}, "c"), ("c", {"a": "d"}, "d"), ("d", {"u": "c"}, "c")))}
      FROM walk w JOIN (SELECT *, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS m FROM judged) j ON j.g = w.g AND j.i = w.i))),
best AS (SELECT g, a.cost AS cost, a.audit AS audit FROM walk WHERE i = 0),
edits AS (
  SELECT g, p, substring(audit, p, 1) AS e, length(replace(substring(audit, 1, p), 'I', '')) AS at,
         length(replace(audit, 'D', '')) - length(replace(substring(audit, 1, p), 'D', '')) AS behind
  FROM (SELECT g, audit, unnest(range(1, length(audit) + 1)) AS p FROM best)),
repaired AS (
  SELECT e.g, string_agg(
    CASE WHEN e.e = 'K' THEN j.role WHEN behind % 2 = 0 THEN 'assistant' ELSE 'user' END
      || ':' || CASE WHEN e.e = 'I' THEN '' ELSE j.txt END, chr(10) ORDER BY p) AS lines
  FROM edits e LEFT JOIN judged j ON j.g = e.g AND j.i = e.at WHERE e.e <> 'D' GROUP BY e.g)
SELECT ids.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM ids LEFT JOIN figures f ON f.g = ids.g LEFT JOIN best b ON b.g = ids.g LEFT JOIN repaired r ON r.g = ids.g
"""


@query("op11_turn_repair", SQL_OP11)
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged as the contract says, and their cheapest repairs."""
    conv = read(spark, sf_dir, "conversations")
    return repair_report(damage(conv), conv)


# ---------------------------------------------------------------- operator 12
@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the first eight whitened components of their covariance."""
    return whiten(read(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- operator 13
@query("op13_fingerprint")
def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness."""
    return edit_report(read(spark, sf_dir, "documents"))
