"""The pipeline's stages one after another on the smallest tables, each held against what its predecessor kept."""

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def test_stages(spark, tmp_path):
    import corpus_pipeline as c

    docs, sf = spark.read.parquet(f"{DATA}/documents.parquet"), str(DATA)
    names, kept = docs.columns, {}
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == names
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if k < 3:
            assert out.count() <= docs.count() and kept[name] <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "jaccard_join":
            from touchline.llm.jaccard_join import jaccard_components

            assert kept[name] == {r.component_id for r in jaccard_components(docs).collect()}
        if name == "sharding":
            assert out.count() == docs.count()
        docs = out
    assert [n for n, _ in c.STAGES] == ["toxicity", "jaccard_join", "decontamination", "mixing", "sharding"]
