"""Registered queries of the subpackage: SQL where there is some, else rows and plans."""

from __future__ import annotations

import os

import pytest

from compare import compare, sql_connection
from fleetlens.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return sql_connection(SF_DIR)


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, connection, name):
    rows = QUERIES[name](spark, SF_DIR)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name != "op11_conversation_trie":  # whose lists of ids are hashed in Python
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert compare(rows, connection, name, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, name):
    rows = QUERIES[name](spark, SF_DIR)
    table, key = ("embeddings", "vec_id") if name.startswith("op4_") else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in rows.select(key).collect()} == ids


def test_contract_columns(spark):
    wanted = {
        "op2_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
        "op4_hnsw_near_dedup": "vec_id n_links component_id kept",
        "op5_exact_dedup": "doc_id keep_id group_size kept text_sha256",
        "op6_ppm_language": "doc_id held_out lang_pred score",
        "op7_bpe_round_trip": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op8_noisy_or_toxicity": "doc_id held_out score predicted",
        "op9_minhash_near_dedup": "doc_id n_shingles component_id kept",
        "op11_conversation_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
        "op12_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
        "op13_entropy_mix": "doc_id size source_size target taken",
        "op10_minimax_shards": "doc_id size text_crc32 law shard slot grown_shard",
    }
    for name, columns in wanted.items():
        assert set(columns.split()) <= set(QUERIES[name](spark, SF_DIR).columns), name
