"""The registered corpus queries: names and types of the columns that they have to give, one row a document where that is asked for."""

import pytest

from ashlar.llm import registry

SF = "/root/testdata/sf0.001"
SCORES = {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
COLUMNS = {
    "op1_attention_mil": SCORES,
    "op2_mpeg_audio": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op3_overlap_resync": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op4_trigram_index": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op5_bayes_jaccard": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op6_nnls_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_paragraph_minhash": {"doc_id": "bigint", "start": "bigint", "end": "bigint", "cluster": "bigint", "removed": "boolean"},
    "op8_spann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op9_pareto_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op10_boosted_toxicity": SCORES,
}


def test_every_query_is_here():
    assert set(COLUMNS) == set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    got = registry.QUERIES[name](spark, SF)
    assert {k: v for k, v in got.dtypes if k in COLUMNS[name]} == COLUMNS[name]


def test_pipeline_drops_what_its_stages_reject(spark):
    """Toxic documents and all but one of each class of near duplicates leave; the others stay."""
    import corpus_pipeline
    from ashlar.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = stored(corpus_pipeline.STAGES[0][1](spark, docs, SF), "test")
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    left = stored(corpus_pipeline.STAGES[1][1](spark, clean, SF), "test")
    assert left.columns == docs.columns
    classes = registry.QUERIES["op5_bayes_jaccard"](spark, SF).select("doc_id", "class_id")
    kept = left.join(classes, "doc_id").groupBy("class_id").count().collect()
    assert left.count() < docs.count() and max(r["count"] for r in kept) == 1
