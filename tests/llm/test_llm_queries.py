"""The registered queries: SQL twins on the smallest tables, and the columns that each must have."""

import os

import duckdb
import pytest

from paperloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    "op1_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2_telephony": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op3_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op4_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op5_substrings": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op11_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op12_spelling": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op13_tokens": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
}


def test_thirteen_operators():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    kinds = dict(QUERIES[name](spark, SF).dtypes)
    assert all(kinds[c.split()[0]] == c.split()[1] for c in COLUMNS[name].split(", "))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)
