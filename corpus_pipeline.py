"""The corpus pipeline: documents in, training mix out.

STAGES are functions (spark, docs, sf_dir) -> DataFrame over all rows that the stage before kept. All but the last return
the columns of ``documents``; run() writes each result to the shared scratch folder and goes on from there.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import decontaminate, linededup, mix, simhash, toxicity
from shelfwise.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that score 0.7 or more go."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: later documents lose the blocks that earlier ones have; n_chars follows the text. Every row stays, a
    document without anything of its own with an empty text. Columns of ``docs`` with the name of a result of the operator
    stay as they are."""
    aside = {c: f"__own_{c}" for c in ("deleted_spans", "deleted_words") if c in docs.columns}
    out = linededup.delete_repeats(docs.withColumnsRenamed(aside))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("deleted_spans") > 0, F.length("text").cast("long"))
                             .otherwise(F.col("n_chars")))
    out = out.drop("deleted_spans", "deleted_words").withColumnsRenamed({own: c for c, own in aside.items()})
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of documents within 4 bits over 4-word shingles the first one stays."""
    return simhash.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents with ten consecutive words of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the mix as one row per document, with the number of times it is read (repeats) and the words that
    the mix takes from it."""
    return mix.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", delete_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: SQL can express neither the trained network nor patience diff.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
