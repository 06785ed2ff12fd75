import duckdb
import pytest

import corpus_pipeline
from vendorscope.llm.common import read_table
from vendorscope.llm.queries import llm_oracles, llm_queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op2": ["doc_id", "held_out", "lang_pred", "score"],
    "op3": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4": ["doc_id", "n_shingles", "component_id"],
    "op5": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op8": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9": ["vec_id", "n_links", "component_id", "kept"],
    "op10": ["page_id", "host", "path", "rule", "verdict"],
    "op11": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op12": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op13": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}
TABLES = {8: "pages", 9: "embeddings", 10: "pages"}


def test_one_query_for_each_operator():
    assert sorted(k.split("_")[0] for k in llm_queries()) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(llm_queries()))
def test_every_row_of_the_table(spark, name):
    op = name.split("_")[0]
    table = TABLES.get(int(op[2:]), "documents")
    got = llm_queries()[name](spark, SF)
    assert got.columns[:len(COLUMNS[op])] == COLUMNS[op]
    key = COLUMNS[op][0]
    if op == "op12":                               # a report a language, not a row a document
        assert {r[0] for r in got.collect()} <= {r[0] for r in read_table(spark, SF, table).select(key).collect()}
        return
    want = sorted(r[0] for r in read_table(spark, SF, table).select(key).collect())
    found = [r[0] for r in got.select(key).collect()]
    assert sorted(set(found)) == want if op == "op7" else sorted(found) == want


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = llm_queries()[name](spark, SF)
    want = con.execute(llm_oracles()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(columns).collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)


def test_pipeline(spark):
    docs = read_table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    kept = {r.doc_id for r in docs.collect()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == kept and len({r.text for r in docs.collect()}) == len(kept)
