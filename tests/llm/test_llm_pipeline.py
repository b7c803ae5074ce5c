"""The stages of the pipeline: columns, decisions, awkward rows."""

import corpus_pipeline
from samples import SMALL, awkward, frame

from weblode.llm import line_dedup, near_dedup, quality_rules


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 5
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, SMALL), "stage")
        assert out.schema.names == docs.schema.names, name
        ids.append({r.doc_id for r in out.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
        docs = out
    packed = corpus_pipeline.packed(spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == ids[-1]
    share = [sum(i in ids[1] for i in own) / len(own) for own in ([i for i in labels if labels[i].quality == q] for q in (0, 1))]
    assert share[0] < share[1] / 2  # 200 documents train a weak model


def test_stages_take_awkward_rows(spark):
    docs = frame(spark, awkward())
    for stage in (quality_rules.keep_good, line_dedup.drop_repeated_lines, near_dedup.keep_one):
        out = stage(docs)
        assert out.schema.names == docs.schema.names and out.count() <= docs.count()
        assert stage(docs.limit(0)).isEmpty()
