"""Operator 12, spelling variants by permuterm rotations.

Every word is marked with a terminator and rotated. Cutting the word ``a x b`` behind x and turning it gives ``b $ a x``: all
words that differ from it in x alone share the prefix ``b $ a``, and the word without x has ``b $ a`` as a whole rotation. So
replaced, inserted and deleted letters are all found among the rotations with one common prefix that skips the edited letter.
Rotations are sorted by that prefix, and each group is scanned once. The terminator fixes the place of the edit, so a group has
at most one row per letter of the alphabet and one more; each row hands on how many neighbours it has there and the best one,
never all pairs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import materialize

#: Marks the end of a word; no word may contain it.
TERMINATOR = "\u0000"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def letter_runs(docs: DataFrame, pattern: str = "[A-Za-zÀ-ÿ]+") -> DataFrame:
    """doc_id, run: every maximal run of letters of every text, A-Z lower-cased, one row per occurrence. Null and empty
    texts have none."""
    found = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(pattern), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


def without_letter(word: Column, at: Column) -> Column:
    """The word without its code point number ``at`` (from 0)."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def count_words(occurrences: DataFrame, min_letters: int = 5, min_count: int = 3) -> DataFrame:
    """word, n: from one row per occurrence (word), those of at least ``min_letters`` code points that occur ``min_count``
    times. Counts are added up before the shuffle, so a very common word is one row per task."""
    return (occurrences.where(F.length("word") >= min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def rotations(words: DataFrame) -> DataFrame:
    """prefix, word, n, edited, leads: per word and letter the rotation that ends with it, without it (edited), and every
    whole rotation (not edited).

    leads: the letter differs from the one before. Taking out any letter of a repetition gives the same word, so a word and
    the one with a letter more meet once for each of them; only the first counts.
    """
    at, word = F.col("at"), F.col("word")
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    before = F.substr(word, F.lit(1), at)
    whole = places.select(F.concat(F.substr(word, at + 1), F.lit(TERMINATOR), before).alias("prefix"), "word", "n",
                          F.lit(False).alias("edited"), F.lit(False).alias("leads"))
    letter, last = F.substr(word, at + 1, F.lit(1)), F.substr(word, at, F.lit(1))
    cut = places.where(at < F.length("word")).select(
        F.concat(F.substr(word, at + 2), F.lit(TERMINATOR), before).alias("prefix"), "word", "n",
        F.lit(True).alias("edited"), ((at == 0) | (letter != last)).alias("leads"))
    return whole.unionByName(cut)


def neighbours(words: DataFrame) -> DataFrame:
    """word, n, n_near, best (struct of minus n and word of the nearest-best neighbour, null if there is none): ``words`` has
    distinct words with their n. Words are near if one inserted, deleted or replaced code point makes them equal; the best
    neighbour has the largest n, of equal ones the smallest word in code-point order."""
    group = Window.partitionBy("prefix")
    me = F.struct((-F.col("n")).alias("minus_n"), F.col("word").alias("word"))
    scanned = rotations(words).withColumn("me", me)
    edited, leads = F.col("edited"), F.col("leads")
    scanned = scanned.withColumns({
        "all_edited": F.count_if(edited).over(group), "all_leads": F.count_if(leads).over(group),
        "shorter": F.min(F.when(~edited, F.col("me"))).over(group),
        "first": F.min(F.when(edited, F.col("me"))).over(group),
        "first_lead": F.min(F.when(leads, F.col("me"))).over(group)})
    scanned = scanned.withColumn("second", F.min(F.when(edited & (F.col("me") != F.col("first")), F.col("me"))).over(group))
    other = F.when(F.col("me") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    shorter = F.when(leads, F.col("shorter"))
    near = F.when(edited, F.col("all_edited") - 1 + shorter.isNotNull().cast("long")).otherwise(F.col("all_leads"))
    best = F.when(edited, F.least(other, shorter)).otherwise(F.col("first_lead"))
    return (scanned.select("word", "n", near.alias("near"), best.alias("best"))
            .groupBy("word").agg(F.first("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form (never null): forms followed to the last. Each round halves the way (the form of the form
    takes its place); the count at least doubles from word to form, so that a way has as many steps as its last count has
    binary digits, and few rounds do. Rounds are written to the shared folder."""
    ways = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = materialize(ways.select("word", "root").join(onward, "root", "left")
                           .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not ways.where("moved").limit(1).count():
            return ways.select("word", "root")


def spelling_groups(words: DataFrame, ratio: float = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root from word, n (distinct words; others columns are not looked at).

    form: the best neighbour if its n is at least ``ratio`` (above 1) times the word's n, else null, as is form_n. root: the
    word that following the forms ends at, the word itself if it has no form. Null words are left out. Words of one letter
    have the neighbours that differ by their one letter. An empty table gives an empty one.
    """
    if not ratio > 1:
        raise ValueError("a ratio of 1 or less may lead in circles")
    words = materialize(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")))
    best = neighbours(words)
    best_n = -F.col("best.minus_n")
    variant = best_n >= F.col("n") * ratio
    formed = materialize(best.select("word", "n", "n_near", F.when(variant, F.col("best.word")).alias("form"),
                                     F.when(variant, best_n).alias("form_n")))
    ways = roots(formed.where(F.col("form").isNotNull()))
    return (formed.join(ways, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
