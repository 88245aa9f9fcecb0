"""Queries and the pipeline on the small tables, where they are there."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no small tables")
def test_stages_on_their_own_input(spark):
    import corpus_pipeline as C
    from aeonframe.llm import decontamination, jaccard_join, pii

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for n, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, FOLDER).cache()
        ids, before = {r.doc_id for r in out.select("doc_id").collect()}, {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before and ids, name
        if n < len(C.STAGES) - 1:
            assert out.columns == columns, name
        if n == 0:
            clean = [i for i, q in truth.items() if q]
            assert sum(i in ids for i in clean) >= 0.97 * len(clean)
        if n == 1:
            found = jaccard_join.near_copies(docs).collect()
            assert ids == {r.component_id for r in found}
        if n == 2:
            held = {r.doc_id for r in decontamination.contaminated(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
            assert ids == before - held
        if n == 3:
            assert ids == before
            assert pii.personal_data(out).filter("size(base) > 0").count() == 0
        if n == 4:
            assert {"taken", "copies", "target"} <= set(out.columns)
        docs = out
    rows = lambda df: sorted((r.doc_id, r.text, r.taken) for r in df.collect())
    assert rows(C.run(spark, FOLDER)) == rows(docs)


def test_every_operator_has_a_query():
    from aeonframe.llm.queries import QUERIES

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
