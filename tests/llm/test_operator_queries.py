"""The query of each operator next to its SQL, and the columns that its contract names."""

import pytest
from check import compare, connect
from conftest import SF

import __spark_entry__ as entry
from pagesift.llm.queries import ORACLE, QUERIES

COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op3_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op4_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op5_licenses": ["doc_id", "license_id", "start", "end", "containment"],
    "op6_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op8_token_counts": ["length", "docs", "docs_from", "tokens_from", "truncated_tokens"],
    "op9_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op10_pieces": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op11_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op12_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op13_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, con, name):
    line = compare(spark, con, SF, name, QUERIES[name], ORACLE[name])
    assert line.startswith("ok"), line


def test_all_are_registered(spark):
    assert set(COLUMNS) == set(QUERIES) and {*QUERIES, "pipeline"} <= set(entry.queries())
    for name in sorted(COLUMNS):
        assert set(COLUMNS[name]) <= set(QUERIES[name](spark, SF).columns)
