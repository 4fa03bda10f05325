import corpus_pipeline
from stowage.llm.common import read


def test_pipeline(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, step, sf_dir)
        assert out.columns == docs.columns, name
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= ids and (now == ids or name in ("toxicity", "minhash_near_dedup"))
        ids, step = now, out
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == ids and len(got) == len(ids)


def test_pipeline_on_odd_rows(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        step = docs
        for _, stage in corpus_pipeline.STAGES:
            step = stage(spark, step, sf_dir)
        step.collect()
