import corpus_pipeline
from gridloom.llm.common import table
from gridloom.llm.near_dedup import near_dedup
from gridloom.llm.exact_dedup import exact_dedup


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "packing"]
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() > 0.95 * docs.count()
    one = corpus_pipeline.exact(spark, kept, "")
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in exact_dedup(kept).collect() if r.kept}
    near = corpus_pipeline.near(spark, one, "")
    assert {r.doc_id for r in near.collect()} == {r.doc_id for r in near_dedup(one).collect() if r.kept}
    mixed = corpus_pipeline.mixed(spark, near, "")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in near.collect()}
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in mixed.collect()}
