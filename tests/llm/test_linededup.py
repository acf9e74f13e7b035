"""Operator 10: blocks against a brute-force search for common words, and whole tables."""
import random

import pytest

from shelfwise.llm import linededup as ld


def sentences(rng, n, tag):
    return [" ".join(f"{tag}{rng.randint(0, 10**6)}" for _ in range(rng.randint(9, 14))).capitalize() + "." for _ in range(n)]


def make(seed=5):
    rng = random.Random(seed)
    passage = " ".join(sentences(rng, 5, "p"))
    common = " ".join(sentences(rng, 4, "q"))  # in every document
    short = "This line has nine words and says nothing at all."
    docs = {}
    for i in range(40):
        body = sentences(rng, 12, f"d{i}x")
        if i % 4 == 0:
            body[5] = body[5][:-1] + " " + passage  # glued to what is before, and in the middle of a line
        body[8] = common + ("\n" if i % 2 else " ") + body[8]
        body.insert(2, short)
        docs[i] = (" " if i % 3 else "\n").join(body)
    docs[50] = docs[0]
    docs[51] = docs[3].replace("d3x", "D3x", 1)
    docs[52], docs[53], docs[54] = None, "", "A few words."
    return docs, passage, common, short


def run(spark, docs, **options):
    rows = [(i, t, "x", 7) for i, t in docs.items()]
    table = spark.createDataFrame(rows, "doc_id long, text string, deleted_words string, place int")
    out = ld.delete_repeats(table, **options)
    assert out.columns == ["doc_id", "text", "place", "deleted_spans", "deleted_words"]
    return {r["doc_id"]: r for r in out.collect()}


@pytest.mark.parametrize("rare", [50, 2])
def test_passages_copies_and_clean_text(spark, rare):
    docs, passage, common, short = make()
    got = run(spark, docs, rare=rare)  # with rare=2 every line of the passages counts as common
    assert set(got) == set(docs)
    for i in range(40):
        text = got[i]["text"]
        assert (passage in text) == (i == 0)
        assert (common.split(". ")[1] in text) == (i == 0)
        assert short in text  # too short by itself
        own = docs[i].replace(passage, "").replace(common, "")
        assert text.split() == (docs[i] if i == 0 else own).split()
    assert got[50]["text"] == "" and got[50]["deleted_words"] == len(docs[0].split())
    assert len(got[51]["text"].split()) <= 2
    assert got[52]["text"] is None and got[53]["text"] == "" and got[54]["text"] == docs[54]
    for i, r in got.items():
        spans = [(s["start"], s["end"]) for s in r["deleted_spans"]]
        assert spans == sorted(spans)
        assert sum(len(docs[i][a:b].split()) for a, b in spans) == r["deleted_words"]


def test_repeated_and_null_ids(spark):
    rng = random.Random(1)
    text, other = " ".join(sentences(rng, 6, "a")), " ".join(sentences(rng, 6, "b"))
    rows = [(2, text), (2, text), (1, other), (1, text + " " + other), (None, other), (None, other)]
    out = ld.delete_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 99, len(r["text"].split())) for r in out)
    n, m = len(text.split()), len(other.split())
    assert got == [(1, m), (1, n + m), (2, 0), (2, 0), (99, 0), (99, 0)]
    assert ld.delete_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(2)
    long = " ".join(sentences(rng, 40_000, "l"))
    part = " ".join(sentences(rng, 4, "z"))
    got = run(spark, {1: long + " " + part, 2: "Before it. " + part + " After it."})
    assert got[1]["deleted_words"] == 0 and got[2]["text"] == "Before it. After it."


def longest_common(a, b):
    """All maximal runs of equal words, as (start in a, length)."""
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                out.add((i, n))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_blocks_are_maximal_common_runs(seed):
    rng = random.Random(seed)
    shared = [" ".join(sentences(rng, rng.randint(2, 5), f"s{k}")) for k in range(3)]
    a = " ".join(x for s in shared for x in (" ".join(sentences(rng, 2, "a"))[:-1], s))
    b = "\n".join(x for s in shared for x in (s, " ".join(sentences(rng, 3, "b"))))
    blocks = ld.common_blocks(ld._Lines(a.encode()), ld._Lines(b.encode()))
    runs = longest_common(a.split(), b.split())
    got = {(len(a.encode()[:s].split()), n) for s, _, n in blocks}
    assert {r for r in runs if r[1] >= 30} <= got <= runs


def words(rng, n, tag="w"):
    return [f"{tag}{rng.randint(0, 10**6)}" for _ in range(n)]


@pytest.mark.parametrize("ends", [(4, 7), (10**6, 10**6)])
def test_passages_of_short_sentences_and_without_ends_at_all_offsets(spark, ends):
    rng = random.Random(8)

    def stream(n):
        out, left = words(rng, n), rng.randint(*ends)
        for i in range(n):
            left -= 1
            if not left:
                out[i] += "."
                left = rng.randint(*ends)
        return out

    docs, passages = {}, {}
    for i in range(150):
        passage = passages[i] = stream(25 + i % 6)
        for doc in (i, 1000 + i):
            docs[doc] = " ".join(stream(rng.randint(0, 40)) + passage + stream(rng.randint(0, 40)))
    got = run(spark, docs)
    for i, passage in passages.items():
        assert got[i]["deleted_words"] == 0
        assert got[1000 + i]["deleted_words"] == len(passage)


def test_blocks_whose_lines_have_different_first_holders(spark):
    rng = random.Random(4)
    s1, s2, s3, s4 = (" ".join(words(rng, 10)) + "." for _ in range(4))
    docs = {1: f"{s1} {s2}", 2: f"{s3} {s4}", 3: f"{s1} {s2} {s3} {s4}", 4: f"{s1} {s2} {s3} {s4}",
            5: " ".join([*words(rng, 30), s1, s2, s3, s4, *words(rng, 7)])}
    got = run(spark, docs)
    assert [got[i]["deleted_words"] for i in docs] == [0, 0, 0, 40, 40] and got[4]["text"] == ""


def repeated(docs, n=25):
    """Per document, the number of words in runs of n words that an earlier one has, by all pairs."""
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        w = text.split()
        runs = [tuple(w[k:k + n]) for k in range(len(w) - n + 1)]
        out[i] = len({k + d for k, r in enumerate(runs) if r in seen for d in range(n)})
        seen.update(runs)
    return out


def test_documents_put_together_from_boilerplate_against_all_pairs(spark):
    rng = random.Random(6)
    parts = [words(rng, rng.randint(3, 30)) for _ in range(25)]
    docs = {}
    for i in range(120):
        docs[i] = " ".join(x for p in rng.sample(parts, 6) for x in [*p[rng.randint(0, 2):], *words(rng, rng.choice([0, 0, 0, 9]))])
        if i > 20 and i % 3 == 0:
            old = docs[rng.randint(0, i - 1)].split()
            at = rng.randint(0, 20)
            docs[i] += " " + " ".join(old[at:at + rng.randint(20, 60)])
    got = run(spark, docs)
    assert {i: r["deleted_words"] for i, r in got.items()} == repeated(docs)


def test_passages_twice_in_either_text_and_in_another_order(spark):
    rng = random.Random(7)
    p, q, x = (" ".join(words(rng, 60)) for _ in range(3))
    table = " ".join(["a b c d e f g h"] * 10)
    for docs, left in (({1: p, 2: f"{p} {x} {p}"}, x), ({1: f"{p} {x} {p}", 2: p}, ""), ({1: f"{p} {q}", 2: f"{q} {p}"}, ""),
                       ({1: p, 2: f"{p} {p}"}, ""), ({1: f"{x} {table}", 2: f"{q} {table}"}, q)):
        assert run(spark, docs)[2]["text"].split() == left.split()
