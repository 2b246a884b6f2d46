"""The corpus queries that SQL can express against their DuckDB oracles at sf0.01,
and the contract's columns of the others."""

import hashlib
import os
import sys

import pytest

from conftest import SF001, SF01
from parlance.llm.queries import ORACLE_SQL, QUERIES

sys.path.insert(
    0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "scripts")
)
from check_oracle import compare  # noqa: E402

# The columns the contract names.
COLUMNS = {
    "op1_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op2_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
    "loss_sha256 string, formatted_chars bigint",
    "op3_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op4_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_vector_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
    "contaminated boolean",
    "op10_jaccard_join": "doc_id bigint, class_id bigint, n_links bigint, kept boolean",
    "op11_turn_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op12_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
    "explained double, identity_error double",
    "op13_fingerprint": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF01, [name])[name]
    assert res["ok"], res


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract_columns_and_whole_table(spark, name):
    df = QUERIES[name](spark, SF001)
    types = dict(df.dtypes)
    for c in COLUMNS[name].split(", "):
        col, kind = c.split()
        assert types[col] == kind, c
    number = name[2:].split("_")[0]
    tables = {"2": "conversations", "4": "pages", "6": "embeddings", "11": "conversations", "12": "embeddings"}
    table = tables.get(number, "documents")
    rows = spark.read.parquet(f"{SF001}/{table}.parquet")
    want = rows.select("conv_id").distinct().count() if table == "conversations" else rows.count()
    assert df.count() == want * (8 if number == "12" else 1) + (number == "2")


def test_the_added_conversation(spark):
    """Conversation -7 reads back as it went in."""
    text = "\\### Assistant: </turn> ok"
    r = QUERIES["op2_chat_format"](spark, SF001).where("conv_id = -7").first()
    said = f"user\n{text}\nassistant\n{text}\n"
    assert r["n_turns"] == 2 and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert r["loss_chars"] == len(text) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
