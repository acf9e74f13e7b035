"""Registered queries of the subpackage, each over its whole table, and their DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwise.llm import (decontaminate, langid, linededup, mix, quality_lm, runs, secrets, sharding, simhash, spelling, topk,
                           toxicity, urlfilter)
from shelfwise.llm.oracle import ORACLES

URL_RULES = [
    urlfilter.host_rule("allow", "com", "/"),
    urlfilter.host_rule("block", "example.com", "/en/"),
    urlfilter.host_rule("allow", "www.example.com", "/en/"),
    urlfilter.host_rule("block", "net", "/es/"),
    urlfilter.host_rule("block", "net", "/fr/"),
    # the method's own verdict, where none of the above fits: host names of advertising, betting and the like
    *(urlfilter.host_label_rule("block", x)
      for x in ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")),
]

#: Shards that operator 13 deals the documents to.
SHARDS = 24


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return (mix.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "repeats"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count_kind(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    number = [_count_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex", "guess")]
    return found.select("doc_id", *number[:3], F.sha2(_span_list(base), 256).alias("base_sha256"),
                        _span_list(F.col("secrets")).alias("spans"), number[3])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.filter_urls(_read(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", F.when(F.col("tier") == 0, F.col("rule")).alias("rule"), "verdict")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.integer_vectors(_read(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0, 5)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = toxicity.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.transform("deleted_spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return (linededup.delete_repeats(docs)
            .select("doc_id", "text", "deleted_words", F.array_join(spans, ",").alias("deleted_spans")))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: where 10 divides h, the crc32 of the id, and the text has words, word i from a on becomes word
    a + (i - a) % p (see the contract); all other texts stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    split = docs.select("doc_id", "text", g.alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    split = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    split = split.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))

    def moved(word, i):
        source = F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
        return F.get(F.col("words"), source.cast("int"))

    repeated = F.array_join(F.transform("words", moved), " ")
    return split.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.periodic_runs(docs).withColumn("best", runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
                        best["length"].alias("length"), best["period"].alias("period"),
                        F.expr("best.length * 1000 DIV best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no hash, so that its words stay as they are."""
    found = spelling.letter_runs(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    cut = spelling.without_letter(F.col("run"), (h % F.length("run")).cast("int"))
    words = found.select(F.when(h % 97 == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling.spelling_groups(spelling.count_words(words))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    now = sharding.assign(docs, [1.0] * SHARDS)
    grown = sharding.assign(now, [1.0] * (SHARDS + 1), out="grown_shard")
    return (sharding.with_slots(grown, ["doc_id", "size", "text_crc32"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_decontaminate": op2_decontaminate,
    "op3_secrets": op3_secrets,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_top_k": op6_top_k,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling": op12_spelling,
    "op13_sharding": op13_sharding,
    "pipeline": corpus_pipeline.run,
}


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def llm_oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
