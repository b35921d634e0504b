"""The registered queries and the pipeline on the smallest test tables."""

import re

import corpus_pipeline
from marginalia.llm import queries

D = "/root/testdata/sf0.001"


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in (*range(1, 11), 11, 12, 13)] + ["pipeline"]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "pseudonyms", "mixture", "packing"]


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, held = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], D).write.parquet(f"{tmp_path}/{i}")
        held.append(spark.read.parquet(f"{tmp_path}/{i}"))
    ids = [{r["doc_id"] for r in h.select("doc_id").collect()} for h in held]
    assert all(a >= b for a, b in zip(ids, ids[1:])) and all(h.columns == columns for h in held[:-1])
    assert len(ids[1]) < len(ids[0]) and len(ids[2]) < len(ids[1]) and ids[3] == ids[2] and len(ids[4]) < len(ids[3]) and ids[5] == ids[4]
    clean = spark.read.parquet(f"{D}/labels.parquet").where("quality = 1").select("doc_id").intersect(docs.select("doc_id"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = [r["doc_id"] for r in clean.collect() if len(texts[r["doc_id"]].split()) >= 60]
    assert sum(i in ids[1] for i in good) >= 0.97 * len(good)
    before, after = ({r["doc_id"]: r["text"] for r in h.collect()} for h in (held[2], held[3]))
    for i, t in before.items():
        for email in re.findall(r"[a-z]+\.\d+@mail\d\.example\.com", t):
            assert email not in after[i]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, D).select("doc_id").collect()} == ids[5]
