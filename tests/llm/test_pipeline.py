"""The stages one after another, each against its operator's own decisions."""
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.conftest import SF_SMALL


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination",
                                         "mixing sources"]
    counts = [docs.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        before, docs = docs, stage(spark, docs, SF_SMALL)
        docs = docs.cache()
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == before.columns
        if k == 1:
            old = before.select("doc_id", F.col("text").alias("old"), F.col("n_chars").alias("old_n"))
            both = docs.join(old, "doc_id")
            assert both.where("text <> old").count() > 0
            assert both.where("text <> old AND n_chars <> length(text) OR text = old AND n_chars <> old_n").count() == 0
    assert counts[0] > counts[1] and counts[1] == counts[2] and counts[2] > counts[3] >= counts[4] == counts[5]
    assert {"size", "source_size", "target", "repeats", "taken"} <= set(docs.columns)


def test_run_hands_each_result_on(spark, monkeypatch):
    seen = []

    def stage(name, keep):
        def f(spark, docs, sf_dir):
            seen.append((name, docs.count(), sf_dir, docs.columns))
            return docs.where(keep)
        return name, f
    monkeypatch.setattr(cp, "STAGES", [stage("even", "doc_id % 2 = 0"), stage("third", "doc_id % 3 = 0")])
    out = cp.run(spark, SF_SMALL)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen == [("even", 200, SF_SMALL, columns), ("third", 100, SF_SMALL, columns)]
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == list(range(0, 200, 6))


def test_line_dedup_leaves_columns_of_its_own_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 7, "mine"), (2, text, 7, "mine"), (3, None, None, None)],
                                 "doc_id long, text string, deleted_words int, deleted_spans string")
    got = {r["doc_id"]: r for r in cp.delete_repeated_lines(spark, docs, SF_SMALL).collect()}
    assert cp.delete_repeated_lines(spark, docs, SF_SMALL).schema.simpleString() == docs.schema.simpleString()
    assert got[2]["text"] == "" and got[1]["text"] == text and got[3]["text"] is None
    assert [(got[i]["deleted_words"], got[i]["deleted_spans"]) for i in (1, 2, 3)] == [(7, "mine"), (7, "mine"), (None, None)]
