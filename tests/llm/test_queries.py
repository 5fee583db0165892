import os

import duckdb
import pytest

from attestra.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLE_SQL[name])
    there = [d[0] for d in cursor.description]
    assert sorted(there) == columns
    want = sorted((tuple(r[there.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


CONTRACT = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op6": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op10": "doc_id held_out score predicted",
    "op11": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op13": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("op", sorted(CONTRACT))
def test_query_returns_a_row_for_each_document(spark, sf_dir, op):
    query = next(f for name, f in QUERIES.items() if name.startswith(f"{op}_"))
    got = query(spark, sf_dir)
    assert got.columns[: len(CONTRACT[op].split())] == CONTRACT[op].split()
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
