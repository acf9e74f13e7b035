"""Operators 1 and 5 against plain Python."""
import re

import pytest

from shelfwise.llm import mix, urlfilter
from shelfwise.llm.catalog import URL_RULES

DOCS = "doc_id long, text string, source string, size string, whole int"


def _words(n):
    return " ".join(["w"] * n)


def _fill(sizes, weights, most):
    """Capped water-filling, one clamped source at a time."""
    total, clamped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in clamped]
        if not free:
            return [most * s for s in sizes]
        level = (total - sum(most * sizes[i] for i in clamped)) / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * level > most * sizes[i]]
        if not over:
            return [most * sizes[i] if i in clamped else weights[i] * level for i in range(len(sizes))]
        clamped.add(over[0])


def test_targets_are_the_water_filling_and_taken_words_come_near(spark):
    rows, doc = [], 0
    plan = {"b": (400, 9), "a": (30, 4), "c": (20, 3), "Z": (200, 11), None: (60, 5), "é": (10, 8), "e": (1, 1)}
    for source, (n, words) in plan.items():
        for k in range(n):
            rows.append((doc, _words(words + k % 3), source, "clash", 1))
            doc += 1
    got = mix.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    names = sorted((s for s in plan if s is not None), key=lambda s: s.encode()) + [None]
    sizes = [sum(len(r[1].split()) for r in rows if r[2] == s) for s in names]
    want = dict(zip(names, _fill(sizes, [i % 3 + 1 for i in range(len(names))], 3.0), strict=True))
    assert sum(want.values()) == pytest.approx(sum(sizes))
    for s, size in zip(names, sizes, strict=True):
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {size}
        assert all(r["target"] == pytest.approx(want[s]) for r in mine)
        taken = sum(r["taken"] for r in mine)
        assert abs(taken - want[s]) <= max(r["size"] for r in mine)
        assert all(r["taken"] == r["repeats"] * r["size"] and 0 <= r["repeats"] <= 3 for r in mine)
        assert len({r["repeats"] for r in mine}) <= 2
    again = mix.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "a", "x", 1), (2, "", "a", "x", 1), (3, " \t\n", None, None, None), (None, "one two", "b", "x", 1),
            (4, "u v w", "b", "x", 1), (4, "u v w", "b", "x", 1)]
    got = mix.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 6
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["size"] for i in (1, 2, 3, None, 4)] == [0, 0, 0, 2, 2]  # a no-break space is no separator
    assert by[3]["target"] == 0 and by[3]["taken"] == 0
    twins = [tuple(r) for r in got if r["doc_id"] == 4]
    assert twins[0] == twins[1]
    assert by[1]["whole"] == 1  # another column of the input stays
    empty = mix.mix(spark.createDataFrame([], DOCS))
    assert empty.collect() == [] and {"target", "taken"} <= set(empty.columns)


def test_mix_by_given_weights(spark):
    rows = [(i, "a b c d", s, "x", 1) for i, s in enumerate("pq" * 50)]
    weights = spark.createDataFrame([("p", 3.0), ("q", 1.0)], "source string, weight double")
    got = mix.mix(spark.createDataFrame(rows, DOCS), weights).groupBy("source").sum("taken").collect()
    assert dict(map(tuple, got)) == {"p": 300, "q": 100}
    only = spark.createDataFrame([("p", 1.0)], "source string, weight double")
    got = mix.mix(spark.createDataFrame(rows, DOCS), only).groupBy("source").sum("taken").collect()
    assert dict(map(tuple, got)) == {"p": 400, "q": 0}


URLS = ["http://example.com/en/1", "https://WWW.Example.COM/en/2?x=/en/", "http://a.b.example.com/en", "http://example.com",
        "http://badexample.com/en/", "ftp://x.net/es/", "ftp://x.net/fr/y#z", "http://x.net/de/", "http://net/es/a", "no scheme",
        "", None, "://", "http:///path", "http://spam-farm.example.org/", "http://spam.farm.org/", "http://x-spam-farm.org/",
        "http://casino-win?q=1", "http://casino-win.net/es/1", "http://x.com/en/://y.net/es/", "http://x.com\n.net/es/",
        "http://user@example.com:80/en/", "http://www.www.example.com/en/", "http://xnet/es/"]


def _judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in [("com", "/", "allow"), ("example.com", "/en/", "block"),
                                                   ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
                                                   ("net", "/fr/", "block")]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    bad = {"ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets"} & set(host.split("."))
    rule = max(fits, default=(0, None, "block" if bad else "allow"))
    return host, path, rule[1], rule[2]


@pytest.mark.parametrize("broadcast", [True, False])
def test_url_verdicts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 20_000 if broadcast else 0)
    pages = spark.createDataFrame([(i, u, "x", 0) for i, u in enumerate(URLS)] + [(None, URLS[0], "x", 0), (0, URLS[0], "x", 0)],
                                  "page_id long, url string, host string, verdict int")
    got = urlfilter.filter_urls(pages, URL_RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[r["page_id"]] if r["page_id"] is not None else URLS[0]
        rule = r["rule"] if r["tier"] == 0 else None
        assert (r["host"], r["path"], rule, r["verdict"]) == _judge(url), url
    assert urlfilter.filter_urls(pages.limit(0), URL_RULES).collect() == []


def test_rules_without_tokens_and_open_ends(spark):
    rules = [urlfilter.host_rule("block", "x.org", "/en"), urlfilter.Rule("digits", r"\d{4}", "block", ())]
    pages = spark.createDataFrame([(1, "http://x.org/english"), (2, "http://y.org/a1234"), (3, "http://y.org/a123")],
                                  "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, rules).collect()}
    assert got == {1: ("x.org/en", "block"), 2: ("digits", "block"), 3: (None, "allow")}


def test_url_filter_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    plan = urlfilter.filter_urls(pages, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!Eval)|MapIn", plan)
