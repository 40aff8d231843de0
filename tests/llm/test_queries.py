"""Registered queries over the smallest tables, against SQL where it can express them."""

import pytest

from factlake.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2": "doc_id fingerprint component_id",
    "op3": "vec_id n_links component_id kept",
    "op4": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op5": "doc_id held_out lang_pred score",
    "op6": "doc_id n_dropped",
    "op7": "page_id payload_bytes payload_digest record_type refers_to",
    "op8": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9": "doc_id size source_size target taken",
    "op10": "query_id rank vec_id score",
    "op11": "doc_id held_out score predicted",
    "op12": "lang rank phrase a l r n score",
    "op13": "lang source part item value rank",
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    if name in ORACLES:
        assert compare(df, connect(FOLDER), ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry_has_them():
    from __spark_entry__ import oracle_sql, queries

    assert {*QUERIES, "pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())
