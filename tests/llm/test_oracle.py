"""Every corpus query against its SQL at sf0.001; the others must run."""

import duckdb
import pytest

import __spark_entry__ as E
from tessera.llm import queries as corpus
from tessera.sources.tables import TABLES

from tests.conftest import SF001
from tests.test_oracle import _norm

QUERIES = E.queries()
ORACLE = corpus.oracle_sql()
COLUMNS = {
    "op1": "doc_id n_bytes n_removed n_spans kept_sha256 repeated", "op2": "doc_id n_shingles component_id",
    "op3": "doc_id keep_id group_size kept text_sha256", "op4": "page_id host path rule verdict",
    "op5": "doc_id held_out lang_pred score",
    "op6": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op7": "doc_id n_assign n_access n_hex base_sha256 spans n_example",
    "op8": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9": "page_id payload_bytes payload_digest record_type refers_to",
    "op10": "doc_id held_out score predicted",
    "op11": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op12": "query_id rank vec_id score",
    "op13": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256"}


@pytest.mark.parametrize("name", sorted(corpus.queries()))
def test_query(spark, name):
    df = QUERIES[name](spark, SF001)
    if name != "pipeline":
        assert df.columns == COLUMNS[name.split("_")[0]].split()
    rows, cols = df.collect(), df.columns
    if name not in ORACLE:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    cur = con.execute(ORACLE[name])
    ocols, orows = [d[0] for d in cur.description], cur.fetchall()
    order = sorted(cols)
    assert order == sorted(ocols)
    a = sorted(tuple(_norm(r[cols.index(c)]) for c in order) for r in rows)
    b = sorted(tuple(_norm(r[ocols.index(c)]) for c in order) for r in orows)
    assert a == b
