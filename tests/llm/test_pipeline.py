"""The pipeline on a small table, stage by stage, and the driver's contract."""

import struct

import __spark_entry__ as entry
import corpus_pipeline
from folium.llm import bpe

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == before.columns, name
        docs.write.mode("overwrite").parquet(f"/tmp/folium-test/{name}")
        docs = spark.read.parquet(f"/tmp/folium-test/{name}")
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] == counts[3]
    b = bpe.load(bpe.tokenizer_path())
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    for r in docs.limit(20).collect():
        assert last[r.doc_id].ids == b"".join(b.encode(r.text)[0]) and last[r.doc_id].n_tokens == len(last[r.doc_id].ids) // struct.calcsize("I")


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
