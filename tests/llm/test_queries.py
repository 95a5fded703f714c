"""The registered queries: those with SQL against it, all against their promised columns."""

from types import SimpleNamespace

import pytest
from compare import connect, difference

from veinstone.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id size source_size target taken", "op2": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op4": "query_id rank vec_id score",
    "op5": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op6": "doc_id n_shingles component_id", "op7": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8": "page_id host path rule verdict", "op9": "page_id url text n_chars", "op10": "doc_id score keep",
    "op11": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256", "op12": "doc_id n_bytes n_tokens over_limit",
    "op13": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    query = SimpleNamespace(run=QUERIES[name], sql=SQL[name])
    assert difference(spark, connect(SF), query, SF)[0] is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_its_columns(spark, name):
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(QUERIES[name](spark, SF).columns)
