"""A corpus pipeline over the documents table, in five written stages.

Each stage reads what the one before it kept, as Parquet, and its decisions
take effect there: language ID drops, near-duplicate classes keep one row,
contaminated documents go, mixing repeats or leaves out rows, and sharding ends
it. All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import materialize, read
from parlance.llm.decontaminate import is_contaminated, with_hits
from parlance.llm.jaccard_join import jaccard_classes
from parlance.llm.langid import language
from parlance.llm.mix import mix_sources
from parlance.llm.shard import assign_shards

# No stage's rows can be had from SQL: the language model is trained here.
ORACLE_SQL = None


def _wrapped(docs: DataFrame, *cols: str) -> DataFrame:
    """The rows whole in ``__doc``, and beside them the columns an operator uses,
    so that no other column can clash with those it adds."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")
    return docs.select(whole, *cols)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rows it cannot place (``und``: null text or no letter) go."""
    named = language(_wrapped(docs, "doc_id", "text", "lang"))
    return named.where("lang_pred <> 'und'").select("__doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each class stays, that with the least id.

    If ids repeat or are null, rows are told apart by their place instead (a
    copy of the rows is written with it), and the first row of a class stays.
    """
    unclear = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if not unclear.limit(1).count():
        kept = jaccard_classes(docs).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    rows = _wrapped(docs, "text").withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows, "pipeline-rows")
    kept = jaccard_classes(rows, id_col="__row").where("kept").select("__row")
    return rows.join(kept, "__row", "left_semi").select("__doc.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a twentieth of their words in hits go."""
    hits = with_hits(_wrapped(docs, "text"), read(spark, sf_dir, "benchmark"), out="__hits")
    return hits.where(~is_contaminated("__hits")).select("__doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each row as often as its rate, rounded to copies, says (0 to 2 times)."""
    mixed = mix_sources(_wrapped(docs, "doc_id", "text", "source"))
    copies = F.array_repeat(F.lit(0), F.col("mix_copies").cast("int"))
    return mixed.select("__doc", F.explode(copies)).select("__doc.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: eight shards of row counts at most one apart, equal texts together."""
    return assign_shards(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
