import hashlib

import corpus_pipeline
import public_tokenizers
from cases import documents
from test_byte_pairs import library
from test_near_copies import kept_ids

from tidemark.llm import contamination, pseudonyms, quality_rules


def test_stages_against_their_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.result(docs).collect() if r.kept}
    # All pairs of what the first stage keeps are compared.
    first = set(kept_ids([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    dirty = {r.doc_id for r in contamination.result(docs, bench).collect() if r.contaminated}
    final = first - dirty
    texts = {r.doc_id: r.text for r in pseudonyms.result(docs).collect() if r.doc_id in final}
    coder = library()
    want = {(i, len(coder.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and final


def test_stages_keep_columns_and_take_empty_tables(spark, sf_dir):
    for docs in (documents(spark), documents(spark, [])):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
    assert public_tokenizers.PATTERN
