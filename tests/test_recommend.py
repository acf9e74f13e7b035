"""Recommendation: several visitors at a time, ties, empty lists; metrics and searches against plain Python or NumPy."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import recommend as rec

RECS = "visitor_id string, rank int, item_id string"
WEIGHTS = "visitor_id string, item_id string, weight double"


def lists(spark, by_visitor):
    rows = [(v, k + 1, i) for v, items in by_visitor.items() for k, i in enumerate(items)]
    return spark.createDataFrame(rows, RECS)


def random_log(seed=9, visitors=14, items=12, n=160):
    rng = random.Random(seed)
    return [(f"v{rng.randrange(visitors):02d}", f"i{rng.randrange(items):02d}", float(rng.choice([1, 3, 5]))) for _ in range(n)]


def test_cutoff_is_the_interpolated_quantile_even_with_ties(spark):
    rng = random.Random(1)
    start = dt.datetime(2023, 5, 1)
    hours = [rng.randrange(40) for _ in range(97)] + [17] * 30  # many events in the same hour
    rows = [(f"v{k % 7}", f"i{k % 5}", start + dt.timedelta(hours=h), 1.0) for k, h in enumerate(hours)]
    df = spark.createDataFrame(rows, "visitor_id string, item_id string, event_time timestamp, weight double")
    for fraction in (0.1, 0.25, 0.6):
        cut = np.quantile(hours, 1 - fraction)
        train, test = rec.train_test(df, fraction)
        assert train.count() == sum(h < cut for h in hours)
        assert test.count() == sum(h >= cut for h in hours)


def plain_metrics(recs, relevant, visitors, k):
    p = r = m = 0.0
    for v in visitors:
        rel, hits, precision_sum = relevant.get(v, set()), 0, 0.0
        for place, item in enumerate(recs.get(v, [])[:k], 1):
            if item in rel:
                hits += 1
                precision_sum += hits / place
        p += hits / k
        r += hits / len(rel) if rel else 0
        m += precision_sum / min(len(rel), k) if rel else 0
    return [x / len(visitors) for x in (p, r, m)]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_metrics_of_many_visitors(spark, k):
    rng = random.Random(k)
    items = [f"i{x}" for x in range(15)]
    visitors = [f"v{x}" for x in range(9)]
    recs = {v: rng.sample(items, rng.randrange(1, 12)) for v in visitors[:7]}  # two have no list
    relevant = {v: set(rng.sample(items, rng.randrange(1, 14))) for v in visitors[1:]}  # one has nothing relevant
    test = spark.createDataFrame([(v, i) for v, s in relevant.items() for i in s for _ in range(2)], "visitor_id string, item_id string")
    who = spark.createDataFrame([(v,) for v in visitors], "visitor_id string")
    got = rec.ranking_metrics(lists(spark, recs), test, who, k=k).first()
    want = plain_metrics(recs, relevant, visitors, k)
    assert [got[f"{n}_at_{k}"] for n in ("precision", "recall", "map")] == pytest.approx(want)
    assert got["n_visitors_evaluated"] == len(visitors)


def test_popularity_and_unseen_lists(spark):
    log = random_log()
    train = spark.createDataFrame(log, WEIGHTS)
    score = {}
    for _, i, w in log:
        score[i] = score.get(i, 0) + w
    order = sorted(score, key=lambda i: (-score[i], i))
    top = rec.most_popular(train, 6)
    assert [r["item_id"] for r in top.orderBy("rank").collect()] == order[:6]
    visitors = sorted({v for v, _, _ in log}) + ["newcomer"]
    got = rec.recommend_popular(spark.createDataFrame([(v,) for v in visitors], "visitor_id string"), train, top, k=4)
    have = {}
    for r in got.orderBy("visitor_id", "rank").collect():
        have.setdefault(r["visitor_id"], []).append(r["item_id"])
    seen = {v: {i for w, i, _ in log if w == v} for v in visitors}
    assert have == {v: x for v in visitors if (x := [i for i in order[:6] if i not in seen[v]][:4])}


def test_content_lists_follow_their_definition(spark):
    log = random_log(seed=3, n=70)
    category = {f"i{x:02d}": f"c{x % 3}" for x in range(12)} | {"new1": "c0", "new2": "c2"}
    cats = spark.createDataFrame(list(category.items()), "item_id string, category_id string")
    got = {}
    for r in rec.recommend_content(spark.createDataFrame(log, WEIGHTS), cats, k=5, top_n=4).orderBy("visitor_id", "rank").collect():
        got.setdefault(r["visitor_id"], []).append(r["item_id"])
    weight = {i: sum(w for _, j, w in log if j == i) or 0.01 for i in category}
    tops = {c: sorted((i for i in category if category[i] == c), key=lambda i: (-weight[i], i))[:4] for c in ("c0", "c1", "c2")}
    want = {}
    for v in {v for v, _, _ in log}:
        affinity, seen = {}, {i for w, i, _ in log if w == v}
        for w, i, x in log:
            if w == v:
                affinity[category[i]] = affinity.get(category[i], 0) + x
        scored = {i: a * weight[i] for c, a in affinity.items() for i in tops[c] if i not in seen}
        if scored:
            want[v] = sorted(scored, key=lambda i: (-scored[i], i))[:5]
    assert got == want


def test_matrix_sums_cells_and_codes_ids_in_order(spark):
    log = random_log(seed=5)
    cells = {}
    for v, i, w in log:
        cells[v, i] = cells.get((v, i), 0) + w
    code_v = {v: k for k, v in enumerate(sorted({v for v, _ in cells}))}
    code_i = {i: k for k, i in enumerate(sorted({i for _, i in cells}))}
    got = rec.interaction_matrix(spark.createDataFrame(log, WEIGHTS)).collect()
    assert {(r["visitor_ix"], r["item_ix"]): r["weight"] for r in got} == \
        {(code_v[v], code_i[i]): w for (v, i), w in cells.items()}


def test_fusion_of_three_lists(spark):
    a = {"x": ["p", "q", "r"], "y": ["q"], "w": []}
    b = {"x": ["r", "s"], "y": ["p", "q", "t"]}
    c = {"z": ["t", "p"], "x": ["s"]}
    got = {}
    for r in rec.reciprocal_rank_fusion([lists(spark, x) for x in (a, b, c)], k=3, rrf_k=10).orderBy("visitor_id", "rank").collect():
        got.setdefault(r["visitor_id"], []).append((r["item_id"], r["rrf_score"]))
    for v in ("x", "y", "z"):
        score, first = {}, {}
        for no, part in enumerate((a, b, c)):
            for place, item in enumerate(part.get(v, []), 1):
                score[item] = score.get(item, 0) + 1 / (10 + place)
                first.setdefault(item, (no, place))
        want = sorted(score, key=lambda i: (-score[i], first[i]))[:3]
        assert [i for i, _ in got[v]] == want
        assert [s for _, s in got[v]] == pytest.approx([score[i] for i in want])
    assert set(got) == {"x", "y", "z"}


def test_collaborative_cuts_before_it_drops_what_was_seen(spark):
    log = [("v", "a", 1.0), ("v", "b", 1.0), ("u", "c", 1.0), ("u", "d", 1.0), ("u", "e", 1.0)]
    train = spark.createDataFrame(log, WEIGHTS)
    matrix = rec.interaction_matrix(train)
    # candidates of v (code 1): a, c, b, d by rank; a and b are seen
    cands = spark.createDataFrame([(1, 1, 0, .9), (1, 2, 2, .8), (1, 3, 1, .7), (1, 4, 3, .6)],
                                  "visitor_ix long, rank int, item_ix long, score double")
    got = rec.recommend_collaborative(cands, matrix, train, k=10).orderBy("rank").collect()
    assert [(r["visitor_id"], r["rank"], r["item_id"]) for r in got] == [("v", 1, "c"), ("v", 2, "d")]


def test_serving_known_unknown_and_repeated_requests(spark):
    lookup = rec.visitor_lookup(lists(spark, {"known": ["b", "a", "c"], "short": ["z"]}))
    popular = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "item_id string, rank int")
    asked = spark.createDataFrame([("known",), ("stranger",), ("short",), ("known",)], "visitor_id string")
    got = rec.serve_recommendations(asked, lookup, popular, k=2).orderBy("visitor_id", "score_rank").collect()
    assert [(r["visitor_id"], r["score_rank"], r["item_id"], r["is_cold_start_fallback"]) for r in got] == [
        ("known", 1, "b", False), ("known", 2, "a", False), ("short", 1, "z", False),
        ("stranger", 1, "p", True), ("stranger", 2, "q", True)]
    assert {r["reason"] for r in got if r["visitor_id"] == "stranger"} == {rec.REASON_FALLBACK}


@pytest.mark.parametrize("partitions, block", [(1, 7), (5, 64)])
def test_inner_product_search_with_ties(spark, partitions, block):
    rng = np.random.default_rng(partitions)
    items = rng.integers(-2, 3, (90, 4)).astype(float)  # few values, so many equal scores
    queries = rng.integers(-2, 3, (25, 4)).astype(float)
    it = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_ix long, vec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "visitor_ix long, vec array<double>")
    got = rec.exact_top_k_inner_product(q.repartition(partitions), it, k=8, block_rows=block).collect()
    scores = queries @ items.T
    want = {(k, r + 1): (int(i), scores[k, i]) for k in range(25)
            for r, i in enumerate(sorted(range(90), key=lambda i: (-scores[k, i], i))[:8])}
    assert {(r["visitor_ix"], r["rank"]): (r["item_ix"], r["score"]) for r in got} == want


@pytest.mark.parametrize("m, n, k", [(30, 12, 5), (9, 25, 4), (6, 6, 50)])
def test_svd_is_that_of_numpy(spark, m, n, k):
    rng = np.random.default_rng(m)
    dense = np.where(rng.random((m, n)) < 0.5, rng.integers(1, 9, (m, n)), 0).astype(float)
    dense[0, :] += 1
    dense[:, 0] += 1
    cells = [(f"v{i}", f"i{j}", i, j, float(dense[i, j])) for i in range(m) for j in range(n) if dense[i, j]]
    matrix = spark.createDataFrame(cells, "visitor_id string, item_id string, visitor_ix long, item_ix long, weight double")
    vf, itf = rec.truncated_svd(matrix, n_components=k)
    u = np.array([r["vec"] for r in vf.orderBy("visitor_ix").collect()])
    v = np.array([r["vec"] for r in itf.orderBy("item_ix").collect()])
    rank = min(k, min(m, n) - 1)
    left, s, right = np.linalg.svd(dense, full_matrices=False)
    assert u.shape == (m, rank) and v.shape == (n, rank)
    assert np.linalg.norm(u, axis=0) == pytest.approx(s[:rank], rel=1e-6)
    assert np.abs(u @ v.T - (left[:, :rank] * s[:rank]) @ right[:rank]).max() < 1e-6 * s[0]
    assert np.abs(v.T @ v - np.eye(rank)).max() < 1e-8
    assert (np.abs(v).max(0) == v.max(0)).all()  # the largest entry of each column is positive


def test_svd_beyond_the_width_of_its_block(spark):
    """Shapes in which the iteration has to converge: the values, and what the factors multiply to, against NumPy."""
    rng = np.random.default_rng(4)
    a = (rng.random((90, 60)) < 0.15) * rng.integers(1, 6, (90, 60)).astype(float)
    cells = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    matrix = spark.createDataFrame(cells, "visitor_ix long, item_ix long, weight double")
    u, v = rec.truncated_svd(matrix, n_components=4, tolerance=1e-4)
    left = np.zeros((90, 4))
    for r in u.collect():
        left[r["visitor_ix"]] = r["vec"]
    right = np.zeros((60, 4))
    for r in v.collect():
        right[r["item_ix"]] = r["vec"]
    sigma = np.linalg.svd(a, compute_uv=False)
    assert np.sqrt((left ** 2).sum(0)) == pytest.approx(sigma[:4], rel=1e-4)
    assert right.T @ right == pytest.approx(np.eye(4), abs=1e-9)
    best = np.linalg.norm(a) ** 2 - (sigma[:4] ** 2).sum()
    assert np.linalg.norm(a - left @ right.T) ** 2 == pytest.approx(best, rel=1e-4)
    with pytest.raises(RuntimeError, match="not found"):
        rec.truncated_svd(matrix, n_components=4, tolerance=1e-9, max_rounds=1)


def test_search_looks_at_long_vectors_first(spark):
    """Norms that fall off: most pairs of blocks are never scored, and the lists are those of all scores; ties by id."""
    rng = np.random.default_rng(8)
    items = rng.normal(size=(400, 6)) * (0.97 ** np.arange(400))[:, None]
    items[200] = items[3]  # equal vectors
    items[399] = 0.0
    asked = rng.normal(size=(120, 6))
    asked[5] = 0.0  # every score is 0: all items must be looked at
    it = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_ix long, vec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "visitor_ix long, vec array<double>")
    skipped = []
    got = rec.exact_top_k_inner_product(q, it, k=7, block_rows=50, skipped=skipped).collect()
    scores = asked @ items.T
    for i in range(120):
        want = sorted(range(400), key=lambda j: (-scores[i, j], j))[:7]
        mine = sorted((r for r in got if r["visitor_ix"] == i), key=lambda r: r["rank"])
        assert [r["score"] for r in mine] == pytest.approx([scores[i, j] for j in want])
        if i != 5:
            assert [r["item_ix"] for r in mine] == want
        else:
            assert [r["item_ix"] for r in mine] == list(range(7))
    pairs, left_out = skipped[0]
    assert pairs == 3 * 8 and left_out > 6  # the block with the zero vector needs all


def test_search_shuffles_no_pairs(spark, monkeypatch):
    """Blocks of queries meet blocks of items in a product of partitions; the lists that leave it have k rows a query."""
    import numpy as np

    from shelfwise.operators import recommend as rec
    monkeypatch.setattr(rec, "ITEM_BLOCKS", 2)
    rng = np.random.default_rng(4)
    q, x = rng.integers(-4, 5, (90, 3)).astype(float), rng.integers(-4, 5, (130, 3)).astype(float)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "visitor_ix long, vec array<double>")
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_ix long, vec array<double>")
    out = rec.exact_top_k_inner_product(queries, items, k=6, block_rows=20)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "vecs" not in "".join(
        line for line in plan.splitlines() if "Exchange" in line)
    got = sorted((r["visitor_ix"], r["rank"], r["item_ix"], r["score"]) for r in out.collect())
    want = [(i, n + 1, int(j), float(s[j])) for i, s in enumerate(q @ x.T)
            for n, j in enumerate(sorted(range(130), key=lambda j: (-s[j], j))[:6])]
    assert got == want
    assert out.count() == 540


def test_svd_rounds_hand_on_no_estimates(spark):
    """The planner's estimate of the factors' size stays that of small files, however many rounds there were; a checkpoint hands
    on the product over the joins of all rounds."""
    rng = np.random.default_rng(4)
    a = (rng.random((90, 60)) < 0.15) * rng.integers(1, 6, (90, 60)).astype(float)
    cells = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    matrix = spark.createDataFrame(cells, "visitor_ix long, item_ix long, weight double")
    for factors in rec.truncated_svd(matrix, n_components=4, tolerance=1e-6):
        assert factors._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 40


@pytest.mark.parametrize("block_cells", [5, 60, 10_000])
def test_products_by_blocks_are_those_of_the_matrix(spark, monkeypatch, block_cells):
    """Blocks of few cells, also fewer than one visitor has; products with vectors, and with A'A."""
    monkeypatch.setattr(rec, "BLOCK_CELLS", block_cells)
    rng = np.random.default_rng(block_cells)
    a = (rng.random((40, 25)) < 0.2) * rng.integers(1, 6, (40, 25)).astype(float)
    a[7] = 1.0  # a visitor of every item, so that no row of the result is missing
    cells = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    matrix = spark.createDataFrame(cells, "visitor_ix long, item_ix long, weight double")
    x = rng.normal(size=(25, 3))
    vectors = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(x)], "ix long, vec array<double>")
    blocks = rec._visitor_blocks(matrix, len(cells))
    assert blocks[0].select("block").distinct().count() == blocks[0].count()
    for back, want in ((False, a @ x), (True, a.T @ (a @ x))):
        got = rec._times_cells(blocks, vectors, 3, back).collect()
        there = [k for k in range(len(want)) if back or a[k].any()]
        assert sorted(r["ix"] for r in got) == there
        for r in got:
            assert r["vec"] == pytest.approx(want[r["ix"]].tolist())


def test_sums_of_a_key_that_spans_pieces():
    rng = np.random.default_rng(2)
    at = np.sort(np.concatenate([np.zeros(40_000, int), rng.integers(1, 50, 9_000), np.full(20_000, 50)]))
    along, w, x = rng.integers(0, 30, len(at)), rng.normal(size=len(at)), rng.normal(size=(30, 4))
    keys, sums = rec._sums(at, w, along, x)
    want = np.zeros((51, 4))
    np.add.at(want, at, x[along] * w[:, None])
    assert keys.tolist() == list(range(51))
    assert np.abs(sums - want).max() < 1e-9
