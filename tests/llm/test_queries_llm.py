"""The thin queries: their columns, and SQL where there is one."""

import duckdb
import pytest

from granary.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op4_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6_simhash": ["doc_id", "fingerprint", "component_id"],
    "op7_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op12_target_resampling": ["doc_id", "n_features", "weight", "score", "rank"],
    "op13_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert set(COLUMNS.get(name, [])) <= set(df.columns)
    rows = df.count()
    if name not in ("op2_token_counts", "op5_decontaminate", "op13_spelling_variants"):
        assert rows == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert rows > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for name_of in ("documents", "benchmark"):
        con.sql(f"create view {name_of} as select * from '{sf_dir}/{name_of}.parquet'")
    got, want = QUERIES[name](spark, sf_dir), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
