"""Stages of the pipeline against plain versions of their decisions."""

import re

import corpus_pipeline
from cadenza.llm import pieces, quality, runtime

DIR = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept, rows = {}, {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        before = list(rows)[-1]
        rows[name] = runtime.table(stage(spark, rows[before], DIR))
        kept[name] = {r.doc_id for r in rows[name].select("doc_id").collect()}
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    model = quality.train(docs, quality.grades_of(labels))
    assert kept["quality"] == {r.doc_id for r in quality.score(docs, model).where("kept").collect()}
    texts = [words(r.text) for r in rows["near_dedup"].collect()]
    assert len({tuple(t) for t in texts}) == len(texts)
    assert kept["near_dedup"] == kept["substring_dedup"]
    items = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect() for w in [words(r.text)] for i in range(len(w) - 9)}
    leak = {r.doc_id for r in rows["substring_dedup"].collect() for w in [words(r.text)] if any(tuple(w[i : i + 10]) in items for i in range(len(w) - 9))}
    assert kept["decontamination"] == kept["substring_dedup"] - leak
    final = {r.doc_id: r.text for r in pieces.decode(rows["tokens"], pieces.load()).collect()}
    assert final == {r.doc_id: r.text for r in rows["decontamination"].collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()} == kept["tokens"]
