import collections

import corpus_pipeline
from tarnfold.llm.neardup import classes
from tarnfold.llm.quality import op8_host_quality_rules


def test_stages_on_odd_rows(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, odd)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    ids = lambda name: collections.Counter(r.doc_id for r in kept[name])
    assert ids("quality_rules") == collections.Counter(r.doc_id for r in op8_host_quality_rules(spark, odd).where("kept").collect())
    after = spark.read.parquet(f"{tmp_path}/quality_rules").select("doc_id", "text")
    assert len(kept["near_duplicates"]) == classes(after).select("class_id").distinct().count()
    assert ids("personal_data") == ids("near_duplicates") and not any("a.b@c.de" in (r.text or "") for r in kept["personal_data"])
    assert set(ids("mixing")) <= set(ids("personal_data")) and max(ids("mixing").values()) <= 2
    assert collections.Counter(r.doc_id for r in kept["packing"] if r.piece == 0) == ids("mixing")


def test_empty(spark, bare):
    assert corpus_pipeline.run(spark, bare).collect() == []


def test_run_is_repeatable(spark, sf):
    rows = [sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]
