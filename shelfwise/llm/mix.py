"""Operator 1, mixing sources to target weights by capped water-filling.

Sources share the total by weight; a source that would be read more than ``max_epochs`` times is clamped
there and its excess goes to the others in proportion to their weights, until none is above. Every document
is then taken a whole number of times, and a seeded part of each source once more.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.positions import dense_position
from shelfwise.session import materialize

#: Seeded order of the documents of a source: a bucket of 2 ^ (2 * DIGIT_BITS), found digit by digit.
DIGIT_BITS = 10
BUCKETS = 1 << (2 * DIGIT_BITS)

#: A plan of up to this number of sources is broadcast (a row is about 100 bytes); a longer one is joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than \\x20 and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def bucket(doc_id: Column, seed: int) -> Column:
    """The document's place, 0 to BUCKETS - 1, in the seeded order; a function of its id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 5), 16, 10).cast("long")


def source_sizes(rows: DataFrame) -> DataFrame:
    """source, source_size, position (0-based, by code point, null last) from rows with source and size."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return dense_position(sizes, [F.col("source").asc_nulls_last()], out="position")


def water_fill(sizes: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Adds target (double) to rows with source_size and weight.

    The targets sum to the sum of the sizes, no target is above max_epochs times its size, and the unclamped
    ones are in proportion to their weights. Each round is one aggregate over the source table that brings
    two sums to the driver; a round clamps at least one more source, and most tables need a few rounds.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > cap
        n, held, free = sizes.agg(F.count_if(over), F.sum(F.when(over, cap).otherwise(0.0)),
                                  F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if n == clamped or not free:
            break
        level, clamped = (total - held) / free, n
    return sizes.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _boundary(histogram: DataFrame, digit: str) -> DataFrame:
    """Of rows (source, need, digit, words): per source, the first digit at which the running sum of words passes
    need. At most 2 ^ DIGIT_BITS rows of a source, so the window of a source is bounded."""
    w = Window.partitionBy("source").orderBy(digit)
    running = histogram.withColumn("upto", F.sum("words").over(w))
    return (running.where(F.col("upto") > F.col("need"))
            .groupBy("source")
            .agg(F.min(F.struct(F.col(digit), "words", (F.col("upto") - F.col("words")).alias("before"))).alias("at")))


def repetition_plan(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, whole, cut: a document of the source is taken ``whole`` times, and once more if its
    bucket is below ``cut``.

    The cut is where the words below it come nearest to what whole repetitions leave of the target. It is found
    from two histograms (of the first and then the second digit of the bucket), so that no task sees more than
    2 ^ DIGIT_BITS rows of a source however many documents it has.
    """
    plan = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                              .otherwise(0).cast("long"))
    plan = plan.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    slim = rows.select("source", "size", F.shiftright("bucket", DIGIT_BITS).alias("high"),
                       F.col("bucket").bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).alias("low"))
    needs = plan.select(F.col("source").alias("s"), "need")
    same = F.col("source").eqNullSafe(F.col("s"))
    first = slim.groupBy("source", "high").agg(F.sum("size").alias("words"))
    first = _boundary(first.join(needs, same).drop("s"), "high")
    first = first.select(F.col("source").alias("s"), F.col("at.high").alias("h"), F.col("at.before").alias("before"))
    left = (first.join(plan.select(F.col("source").alias("s2"), "need"), F.col("s").eqNullSafe(F.col("s2")))
            .select("s", "h", (F.col("need") - F.col("before")).alias("need"), "before"))
    sums = slim.groupBy("source", "high", "low").agg(F.sum("size").alias("words"))
    second = sums.join(left, same & (F.col("high") == F.col("h"))).select("source", "low", "words", "need")
    second = _boundary(second, "low").select(F.col("source").alias("s3"), "at")
    cuts = (left.join(second, F.col("s").eqNullSafe(F.col("s3")))
            .select("s", (F.col("h") * (1 << DIGIT_BITS) + F.col("at.low")
                          + F.when(F.col("need") - F.col("at.before") >= F.col("at.words") / 2, 1).otherwise(0))
                    .cast("long").alias("cut")))
    return (plan.join(cuts, same, "left")
            .select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).cast("long").alias("cut")))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, source at least), then size, source_size, target, repeats, taken.

    ``weights``: source, weight; a source that is not listed weighs 0. Without it, sources by code point, null
    last, weigh 1, 2, 3, repeating. size is the number of words, 0 for a null or empty text. taken = repeats *
    size, where repeats is at most max_epochs; 0 repeats mean that the mix leaves the document out, and the row
    says so. Null sources form one source. A repeated row is taken as often as its twin. An empty table gives an
    empty table. Reruns agree, as the choice depends on doc_id and seed only. Columns of ``docs`` that have the
    name of a result column are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "repeats", "taken")
    slim = materialize(docs.select("source", word_count(F.col("text")).alias("size"),
                                   bucket(F.col("doc_id"), seed).alias("bucket")))
    sizes = source_sizes(slim)
    if weights is None:
        sizes = sizes.withColumn("weight", (F.col("position") % 3 + 1).cast("long"))
    else:
        named = weights.select(F.col("source").alias("s"), F.col("weight").cast("double").alias("weight"))
        sizes = (sizes.join(named, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
                 .withColumn("weight", F.coalesce("weight", F.lit(0.0))))
    sizes = materialize(sizes.select("source", "source_size", "weight"))
    plan = materialize(repetition_plan(slim, water_fill(sizes, max_epochs)))
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in ("source", "source_size", "target", "whole", "cut")])
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    out = docs.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("__source")))
    repeats = F.col("__whole") + F.when(bucket(F.col("doc_id"), seed) < F.col("__cut"), 1).otherwise(0)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = out.select(*columns, word_count(F.col("text")).alias("size"), F.col("__source_size").alias("source_size"),
                     F.col("__target").alias("target"), repeats.cast("long").alias("repeats"))
    return out.withColumn("taken", F.col("repeats") * F.col("size"))
