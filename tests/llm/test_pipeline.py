"""The pipeline's stages on the smallest tables, and the SQL of the operators that have one."""

import os

import duckdb
import pytest

import corpus_pipeline
from sextant.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages_narrow_the_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DIR)
        assert kept.columns == first.columns, name
        assert kept.join(docs, "doc_id", "left_anti").count() == 0
        docs = kept
    done = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert done.count() == docs.count() > 0


def test_stages_take_odd_documents(spark):
    text = "the word of a clean text that has some length, twice over.\nA second line of this text is here."
    rows = [(1, text, "x"), (1, text, "x"), (2, None, "y"), (3, "", None), (None, text + " more", "z"), (4, "w " * 30_000, "v"), (5, "\n\n", "u")]
    docs = spark.createDataFrame([(*r, 7, 0.5, [1], "s") for r in rows], "doc_id long, text string, lang string, n_lines int, score double, _x array<int>, own string")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, frame, DIR)
            assert set(kept.columns) >= {"doc_id", "text", "lang", "score", "_x", "own"} and kept.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, DIR).count() == frame.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df, other = queries.QUERIES[name](spark, DIR), c.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    assert sorted(map(tuple, df.select(columns).collect()), key=repr) == sorted(other.select(*columns).fetchall(), key=repr)


CONTRACT = {
    "op1_pu_quality": "doc_id held_out score predicted", "op3_site_style_tree": "page_id url text n_chars",
    "op5_media_fingerprints": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op8_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op9_rendezvous_shards": "doc_id size text_crc32 law shard slot grown_shard", "op10_pii_pseudonyms": "doc_id text",
    "op12_pu_toxicity": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_and_rows_of_the_contract(spark, name):
    found = queries.QUERIES[name](spark, DIR)
    assert set(CONTRACT[name].split()) <= set(found.columns)
    table = "pages" if "page_id" in found.columns else "documents"
    assert found.count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()
