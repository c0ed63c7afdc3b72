"""The pipeline's stages against plain versions of what each must drop or change."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_text_operators import brute_components

import corpus_pipeline
from lagweave.llm import decontaminate, toxicity


@pytest.fixture(scope="module")
def planted(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    word = [f"w{i}" for i in range(60)]
    more = [
        (900001, " ".join(word), "en", "s", 5), (900002, " ".join([*word[:59], "new"]), "en", "s", 5), (900003, f"Before it. {item} After it.", "en", "s", 5), (900004, None, "en", "s", None),
        (900005, "", None, None, 0), (900006, "call +1 (310) 555-4510 or mail a.b@c.example now please", "en", "s", 5), (900007, "twice the same row", "en", "s", 5), (900007, "twice the same row", "en", "s", 5),
        (None, "a text without an id", "en", "s", 5), (900008, " ".join(word), "en", "s", 5), (900008, "a wholly different text of the same id", "en", "s", 5),
    ]
    return docs.union(spark.createDataFrame(more, docs.schema))


def test_stages_in_order(spark, planted):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "sentencepiece"]
    docs = planted
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SMALL).cache()
        assert docs.columns == planted.columns, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            labels = spark.read.parquet(f"{SMALL}/labels.parquet")
            clean = toxicity.train_and_score(before, labels).where("score < 0.5")
            assert sorted(map(str, ids)) == sorted({str(r["doc_id"]) for r in clean.collect()})
        if name == "ngram_jaccard_join":
            assert 900001 in ids and 900002 not in ids and None in ids and docs.where("doc_id = 900007").count() == 1
            assert docs.where("doc_id = 900008").select("text").collect() == [("a wholly different text of the same id",)]
            rows = [(r["doc_id"], r["text"]) for r in before.where("doc_id <> 900008").collect()]
            assert {c for _, _, c in brute_components(rows, 5, 80)} == ids - {None, 900008}
        if name == "benchmark_decontamination":
            assert 900003 not in ids and {900001, 900004, 900005, 900006, 900007, None} <= ids
        if name == "pii":
            row = docs.where("doc_id = 900006").first()
            assert row["text"] == "call [PHONE] or mail [EMAIL] now please" and row["n_chars"] == len(row["text"])
            assert docs.count() == before.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert out.count() == docs.count() and out.where("not exact").count() == 0


def test_run_on_an_empty_table(spark, planted):
    empty = planted.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_run_keeps_what_its_stages_keep(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    clean = {r["doc_id"] for r in toxicity.train_and_score(docs, labels).where("score < 0.5").collect()}
    groups = brute_components([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in clean], 5, 80)
    leaked = {r["doc_id"] for r in decontaminate.tile_matches(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).where(F.size("benchmark_matches") > 0).collect()}
    out = corpus_pipeline.run(spark, SMALL)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for _, _, c in groups} - leaked)
    assert out.where("not exact or n_pieces <> size(pieces)").count() == 0
