"""Forecasting: several products at once, gaps and single days; every feature against plain Python."""
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import forecast as fc

PANEL = "product_id string, ds date, y double"
DAY = dt.date(2022, 11, 7)


def day(n):
    return DAY + dt.timedelta(days=n)


def series(seed, length, name="p"):
    rng = random.Random(seed)
    return [(name, day(i), float(rng.randrange(0, 30))) for i in range(length)]


@pytest.mark.parametrize("length, test_days", [(41, 10), (9, 3), (30, 1)])
def test_split_takes_the_last_days_of_the_calendar(spark, length, test_days):
    rows = series(1, length, "long") + [("short", day(k), 1.0) for k in (0, 2, length - 1)]
    split = fc.temporal_split(spark.createDataFrame(rows, PANEL), test_days).collect()
    first = day(length - test_days)
    assert len(split) == len(rows)
    assert all(r["is_test"] == (r["ds"] >= first) for r in split)


def test_error_measures_follow_their_formulas(spark):
    rng = random.Random(6)
    pairs = [(float(rng.randrange(1, 50)), rng.random() * 60) for _ in range(64)]
    got = fc.forecast_metrics(spark.createDataFrame(pairs, "y double, yhat double")).first()
    errors = [a - b for a, b in pairs]
    assert got["mae"] == pytest.approx(sum(map(abs, errors)) / 64)
    assert got["rmse"] == pytest.approx(math.sqrt(sum(e * e for e in errors) / 64))
    assert got["mape"] == pytest.approx(100 * sum(abs(e) / (a + 1) for e, (a, _) in zip(errors, pairs, strict=True)) / 64)
    zero = fc.forecast_metrics(spark.createDataFrame([(0.0, 4.0), (8.0, 8.0)], "y double, yhat double")).first()
    assert math.isfinite(zero["mape"]) and zero["mae"] == 2.0


@pytest.mark.parametrize("window", [1, 4, 100])
def test_moving_average_is_the_mean_of_the_last_days(spark, window):
    rows = [(d, y) for _, d, y in series(2, 23)]
    out = fc.moving_average_forecast(spark.createDataFrame(rows, "ds date, y double"),
                                     spark.createDataFrame([(day(23 + i),) for i in range(5)], "ds date"), window=window)
    want = np.mean([y for _, y in rows[-window:]])
    assert [r["yhat"] for r in out.collect()] == pytest.approx([want] * 5)


def test_every_feature_of_interleaved_products(spark):
    rows = series(3, 40, "a") + series(4, 33, "b") + [("c", day(0), 5.0)]
    random.Random(0).shuffle(rows)
    got = {(r["product_id"], r["ds"]): r for r in fc.add_time_series_features(spark.createDataFrame(rows, PANEL)).collect()}
    assert len(got) == len(rows)
    for name in "abc":
        own = [y for _, y in sorted((d, y) for p, d, y in rows if p == name)]
        for i in range(len(own)):
            r = got[name, day(i)]
            for column in [c for c in r.asDict() if c.startswith("lag_")]:
                back = int(column.split("_")[1])
                assert r[column] == (own[i - back] if i >= back else None), (name, i, column)
            for column in [c for c in r.asDict() if c.startswith("rolling_mean_")]:
                size = int(column.split("_")[2])
                want = np.mean(own[i - size:i]) if i >= size else None
                assert r[column] == (pytest.approx(want) if want is not None else None), (name, i, column)


def test_gaps_are_filled_within_each_product_only(spark):
    rows = [("a", day(0), 1.0), ("a", day(6), 2.0), ("b", day(3), 5.0), ("b", day(4), 6.0), ("once", day(9), 7.0)]
    out = fc.fill_missing_dates(spark.createDataFrame(rows, PANEL), group_col="product_id").collect()
    got = {}
    for r in sorted(out, key=lambda r: r["ds"]):
        got.setdefault(r["product_id"], []).append((r["ds"], r["y"]))
    assert got == {"a": [(day(i), {0: 1.0, 6: 2.0}.get(i, 0.0)) for i in range(7)],
                   "b": [(day(3), 5.0), (day(4), 6.0)], "once": [(day(9), 7.0)]}


@pytest.mark.parametrize("n", [3, 6, 12])
def test_tail_of_the_history(spark, n):
    sales = {1: 4, 2: 1, 5: 9}
    daily = spark.createDataFrame([("a", day(k), v) for k, v in sales.items()] + [("b", day(7), 2)],
                                  "product_id string, ds date, y long")
    got = {r["product_id"]: list(r["hist"]) for r in fc._history_tail(daily, n=n).collect()}
    last = {"a": 5, "b": 7}
    for name, values in got.items():
        own = sales if name == "a" else {7: 2}
        assert values == [float(own.get(last[name] - n + 1 + i, 0)) for i in range(n)]


def test_trend_model_follows_a_line_with_a_weekly_wave(spark):
    def y(i):
        return 200 + 0.8 * i + 25 * math.sin(2 * math.pi * i / 7)
    rows = [(day(i), y(i)) for i in range(420)]
    train, test = (spark.createDataFrame(r, "ds date, y double") for r in (rows[:390], rows[390:]))
    got = {r["ds"]: r["yhat"] for r in fc.fit_trend_seasonal(train, test).collect()}
    error = np.mean([abs(got[d] - v) for d, v in rows[390:]])
    flat = np.mean([abs(np.mean([v for _, v in rows[383:390]]) - v) for d, v in rows[390:]])
    assert error < 0.5 * flat


def test_recursion_feeds_on_its_own_output(spark):
    rows = [(p, d, int(v)) for p, d, v in series(8, 45, "long") + series(9, 12, "short")]
    daily = spark.createDataFrame(rows + [("fresh", day(3), 6)], "product_id string, ds date, y long")
    level = spark.createDataFrame([("long", 1.0), ("short", 1.0)], "product_id string, product_level double")
    out = fc.recursive_forecast(daily, fc.RollingMeanModel(), level, horizon=9).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["step"]):
        got.setdefault(r["product_id"], []).append((r["ds"], r["predicted_demand"], r["model_used"]))
    values = [v for p, _, v in rows if p == "long"]
    for _ in range(9):
        values.append(sum(values[-7:]) / 7)
    assert [p for _, p, _ in got["long"]] == pytest.approx(values[45:], abs=0.0051)
    assert [d for d, _, _ in got["long"]] == [day(45 + k) for k in range(9)]
    mean = sum(v for p, _, v in rows[45:][-7:]) / 7
    assert [p for _, p, _ in got["short"]] == pytest.approx([mean] * 9, abs=0.0051)
    assert {(p, m) for _, p, m in got["fresh"]} == {(6.0, "baseline_moving_average")}
    asked = spark.createDataFrame([("fresh",), ("nobody",)], "product_id string")
    answers = fc.forecast_lookup(fc.recursive_forecast(daily, fc.RollingMeanModel(), level, horizon=2), asked).collect()
    assert sorted((r["product_id"], r["found"], r["step"]) for r in answers if r["found"]) == [("fresh", True, 1), ("fresh", True, 2)]
    assert [(r["product_id"], r["step"]) for r in answers if not r["found"]] == [("nobody", None)]


def test_saved_model_predicts_the_same_and_beats_the_baseline(spark, tmp_path):
    rows = [(p, day(i), 20.0 + 15 * ((i + k) % 7 == 0) + 5 * ((i + k) % 7 == 3)) for k, p in enumerate("abcd") for i in range(120)]
    features = fc.drop_incomplete(fc.add_time_series_features(spark.createDataFrame(rows, PANEL)))
    model, level = fc.fit_global_model(features, max_iter=15)
    fc.save_global_model(model, level, str(tmp_path / "gbt"))
    again, level_again = fc.load_global_model(spark, str(tmp_path / "gbt"))

    def predict(m, enc):
        return {(r["product_id"], r["ds"]): r["prediction"] for r in m.transform(features.join(enc, "product_id")).collect()}
    assert predict(model, level) == predict(again, level_again)
    mae = fc.evaluate_global_model(features, test_days=20, max_iter=15).first()["mae"]
    flat = 20 + 20 / 7
    base = np.mean([abs(y - flat) for _, d, y in rows if d >= day(100)])
    assert mae < 0.5 * base


def test_keyed_trend_fits_are_ridge_regressions(spark, monkeypatch):
    """Every series against NumPy on the columns of the single-series design, a long one split over parts."""
    monkeypatch.setattr(fc, "DAYS_PER_PART", 50)
    rows = series(21, 170, "a") + series(22, 400, "b")[::3] + [("one", day(7), 4.0)]
    train = spark.createDataFrame(rows, PANEL)
    models = {r["product_id"]: r for r in fc.fit_trend_seasonal_by_key(train).collect()}
    assert set(models) == {"a", "b", "one"} and models["a"]["n"] == 170
    design = fc.TrendDesign()
    for name, r in models.items():
        own = sorted((d, y) for p, d, y in rows if p == name)
        span = (own[-1][0] - own[0][0]).days
        assert (r["first_ds"], r["span"]) == (own[0][0], span)
        one = spark.createDataFrame(own, "ds date, y double")
        wide = fc.trend_seasonal_design(one, F.lit(own[0][0]), F.lit(span)).orderBy("ds").drop("ds", "y").collect()
        x = np.array([[1.0, *w] for w in wide])
        assert design.matrix([(d - own[0][0]).days for d, _ in own], span) == pytest.approx(x)
        penalty = np.diag([0.0] + [0.01 * len(own)] * (design.width - 1))
        want = np.linalg.solve(x.T @ x + penalty, x.T @ np.array([y for _, y in own]))
        assert r["coefficients"] == pytest.approx(want, abs=1e-6)
    days = spark.createDataFrame([("a", day(171), "x"), ("nobody", day(1), "x")], "product_id string, ds date, note string")
    got = fc.forecast_trend_seasonal_by_key(fc.fit_trend_seasonal_by_key(train), days).collect()
    assert [(r["product_id"], r["note"]) for r in got] == [("a", "x")]
    assert got[0]["yhat"] == pytest.approx(max(0.0, design.matrix([171], 169)[0] @ np.array(models["a"]["coefficients"])))


def _tree_by_definition(bins, residual, s):
    """Best-first growth over plain index sets."""
    from shelfwise.operators import boosting as bo

    leaves, out = [(0, 0, np.arange(len(residual)))], []

    def split_of(rows):
        return bo.best_split(bo.histogram(bins, rows, residual, s.bins), s)
    while len(out) < s.leaves - 1:
        able = [(*split_of(rows), no, depth, rows) for no, depth, rows in leaves if depth < s.max_depth]
        able = [a for a in able if a[1] is not None]
        if not able:
            break
        top = max(a[0] for a in able)
        gain, (f, b), no, depth, rows = next(a for a in able if a[0] >= top * (1 - bo.TIE))
        left = bins[f][rows] <= b
        k = len(out)
        out.append((no, f, b))
        leaves = [x for x in leaves if x[0] != no] + [(2 * k + 1, depth + 1, rows[left]), (2 * k + 2, depth + 1, rows[~left])]
    return out


def test_boosted_trees_by_definition(spark):
    """Exact trees grown over several blocks against growth over index sets, tree by tree, with the category among the columns."""
    from shelfwise.operators import boosting as bo

    rng = np.random.default_rng(3)
    n = 1500
    a, b, product = rng.integers(0, 40, n), rng.integers(0, 3, n) * 1.5, rng.integers(0, 30, n)
    y = (a > 20) * 5.0 + b * (product % 3) + rng.integers(0, 3, n)
    rows = spark.createDataFrame([(f"p{p}", float(i), float(j), float(v)) for p, i, j, v in zip(product, a, b, y, strict=True)],
                                 "product string, a double, b double, y double")
    s = bo.exact(trees=4, leaves=9, bins=16, block_rows=200)
    model = bo.fit(rows, ["a", "b"], "product", "y", s)
    residual, prediction = y - y.mean(), np.full(n, y.mean())
    numeric = [np.searchsorted(e, x, "left") for e, x in zip(model.edges, (a, b), strict=True)]
    assert len(model.trees) == 4 and len(model.edges[1]) == 2 and 10 < len(model.edges[0]) < 16
    steps = {r["category"]: np.frombuffer(r["steps"], np.int16) for r in model.steps.collect()}
    for k, tree in enumerate(model.trees):
        sums = np.bincount(product, residual) / (np.bincount(product) + s.smooth)
        step = bo.fine_step(sums)
        assert all(steps[f"p{p}"][k] == step[p] for p in range(30))
        bins = np.vstack([*numeric, np.searchsorted(tree.cuts, step, "left")[product]]).astype(np.uint8)
        want = _tree_by_definition(bins, residual, s)
        got = [(i, tree.feature[i], tree.bin[i]) for i in range(len(tree.feature)) if tree.feature[i] >= 0]
        assert sorted(got) == sorted(want)
        prediction = prediction + tree.predict(bins)
        residual = y - prediction
    out = {(r["product"], r["a"], r["b"]): r["prediction"] for r in model.transform(rows).collect()}
    assert all(out[f"p{p}", float(i), float(j)] == pytest.approx(v) for p, i, j, v in zip(product, a, b, prediction, strict=True))
    odd = spark.createDataFrame([("never seen", 3.0, 0.0), (None, None, None)], "product string, a double, b double")
    assert all(math.isfinite(r["prediction"]) for r in model.transform(odd).collect())


def test_proposed_trees_come_as_near(spark):
    """With a few rounds a tree the error falls about as with exact trees."""
    from shelfwise.operators import boosting as bo

    rng = np.random.default_rng(9)
    a, b, p = rng.random(2000) * 10, rng.random(2000), rng.integers(0, 8, 2000)
    y = np.sin(a) * 4 + (b > 0.7) * 3 + p
    rows = spark.createDataFrame([(str(k), float(i), float(j), float(v)) for k, i, j, v in zip(p, a, b, y, strict=True)],
                                 "product string, a double, b double, y double")

    def error(s):
        return bo.fit(rows, ["a", "b"], "product", "y", s).transform(rows).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    quick, slow, none = error(bo.Settings(trees=30)), error(bo.exact(trees=30)), np.abs(y - y.mean()).mean()
    assert none - quick > 0.9 * (none - slow)


def test_days_are_filled_without_a_join(spark):
    """One window finds the missing days; a day that is there twice stays twice, a null day adds none."""
    rows = [("a", day(4), 3.0), ("a", day(1), None), ("a", day(4), 5.0), ("a", None, 9.0), ("b", day(2), 1.0)]
    out = fc.fill_missing_dates(spark.createDataFrame(rows, PANEL), group_col="product_id")
    got = sorted((r["product_id"], r["ds"], r["y"]) for r in out.collect())
    assert got == [("a", day(1), 0.0), ("a", day(2), 0.0), ("a", day(3), 0.0), ("a", day(4), 3.0), ("a", day(4), 5.0), ("b", day(2), 1.0)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    total = fc.fill_missing_dates(spark.createDataFrame([(day(0), 2), (day(2), 4)], "ds date, y long"))
    assert sorted((r["ds"], r["y"]) for r in total.collect()) == [(day(0), 2.0), (day(1), 0.0), (day(2), 4.0)]


def test_joint_counts_and_rounds_over_uncounted_leaves_only(spark, monkeypatch):
    """Features counted together give the sums of each, and no node is counted in two rounds."""
    from shelfwise.operators import boosting as bo

    rng = np.random.default_rng(5)
    widths = [7, 3, 16, 2, 9]
    bins = np.vstack([rng.integers(0, w, 9000) for w in widths]).astype(np.uint8)
    residual, rows = rng.normal(size=9000), np.arange(0, 9000, 2)
    assert bo.joint_features(widths) == [[0, 1, 2, 3, 4]] and bo.joint_features([64, 64, 64]) == [[0, 1], [2]]
    for some in (None, rows, rows[:30]):
        n = 9000 if some is None else len(some)
        joint, single = (bo.histogram(bins, some, residual, 16, w) for w in (widths, None))
        assert joint == pytest.approx(single, abs=1e-9) and (joint[1] == single[1]).all() and joint[1, 4].sum() == n
    counted = []

    def add_up(blocks, per_block, n_tasks, whole=bo.add_up):
        out = whole(blocks, per_block, n_tasks)
        counted.append(len(out) // (2 * 3 * 16))
        return out
    monkeypatch.setattr(bo, "add_up", add_up)
    a, b, p = rng.random(1500), rng.random(1500), rng.integers(0, 6, 1500)
    y = np.floor(a * 8) * (b > 0.5) + p
    table = spark.createDataFrame([(str(k), float(i), float(j), float(v)) for k, i, j, v in zip(p, a, b, y, strict=True)],
                                  "product string, a double, b double, y double")
    model = bo.fit(table, ["a", "b"], "product", "y", bo.exact(trees=1, leaves=9, bins=16, block_rows=300))
    rounds = counted[2:]  # after the counts of the scale and the root, which come with the steps of the scale
    assert len(model.trees[0].feature) == 17 and len(rounds) > 2
    assert sum(rounds) <= 2 * (len(rounds) * 8) and max(rounds) <= 16
    assert sum(rounds) <= 32  # the 16 nodes below the root and the halves that were looked at but not split


def _table_of(spark, seed, n, categories):
    rng = np.random.default_rng(seed)
    a, b, p = rng.integers(0, 50, n), rng.integers(0, 4, n), rng.integers(0, categories, n)
    y = np.floor(a / 7) * (b > 1) + p % 5 + rng.integers(0, 3, n)
    return spark.createDataFrame([(f"p{k}", float(i), float(j), float(v)) for k, i, j, v in zip(p, a, b, y, strict=True)],
                                 "product string, a double, b double, y double")


def test_sums_by_leaf_follow_the_paths_of_rows(spark):
    """Leaves found by tables and sums read off combinations are those of rows that go down the tree one split after the other."""
    from shelfwise.operators import boosting as bo

    rng = np.random.default_rng(8)
    widths, sizes = [40, 40, 40, 7, 3], np.array([700, 1, 2400, 899])
    numeric = np.vstack([rng.integers(0, w, sizes.sum()) * (rng.random(sizes.sum()) < 0.3) for w in widths]).astype(np.uint8)
    block = bo.Block(list("abcd"), sizes, bo.grouped(numeric, widths), rng.normal(size=sizes.sum()))
    assert sorted(f for g in block.groups for f in g.features) == list(range(5)) and len(block.groups) < 5
    for g in block.groups:
        assert (g.bins[:, g.code] == numeric[g.features]).all()
    for leaves in (31, 150):  # with 150, more than one mask holds
        tree, s = bo.Tree(cuts=[500, 512, 530]), bo.Settings(leaves=leaves)
        while sum(f < 0 for f in tree.feature) < leaves:
            node = int(rng.choice([i for i, f in enumerate(tree.feature) if f < 0]))
            tree.feature[node] = int(rng.integers(0, 6))
            tree.bin[node] = int(rng.integers(0, (*widths, 4)[tree.feature[node]]))
            tree.left[node], tree.right[node] = tree.add(), tree.add()
        category = np.searchsorted(tree.cuts, block.steps(s.smooth), "left")
        bins = np.vstack([numeric, np.repeat(category, sizes)]).astype(np.uint8)
        rows = dict(tree.places(bins))
        wanted = [i for i, f in enumerate(tree.feature) if f < 0]
        for some in (wanted, wanted[::3], wanted[:1]):
            got = bo.leaf_histograms(block, tree, s, some)
            want = np.array([bo.histogram(bins, rows[i], block.residual, s.bins) for i in some])
            assert got == pytest.approx(want, abs=1e-9) and (got[:, 1] == want[:, 1]).all()
        tree.value = list(rng.normal(size=len(tree.feature)))
        after = block.after(tree, s.smooth, s.bins)
        assert after.residual == pytest.approx(block.residual - tree.predict(bins)) and len(after.past) == 1


def test_blocks_as_files_or_cached_give_the_same_trees(spark, monkeypatch, tmp_path):
    """Many blocks make as many tasks as there are cores, however they are kept; a repeated task changes nothing."""
    from shelfwise.operators import boosting as bo

    table, tasks, cores = _table_of(spark, 4, 4000, 300), [], spark.sparkContext.defaultParallelism

    def add_up(blocks, per_block, n_tasks, whole=bo.add_up):
        tasks.append(n_tasks)
        assert blocks.getNumPartitions() == n_tasks
        assert whole(blocks, per_block, n_tasks) == pytest.approx(first := whole(blocks, per_block, n_tasks), abs=1e-9)
        return first
    monkeypatch.setattr(bo, "add_up", add_up)
    s = bo.Settings(trees=6, leaves=9, bins=16, block_rows=4)
    assert -(-4000 // (16 * s.block_rows)) > 2 * cores  # several blocks in a task
    files = bo.fit(table, ["a", "b"], "product", "y", s)
    n_files = len(tasks)
    monkeypatch.setattr(bo, "open_folder", lambda uri: None)
    cached = bo.fit(table, ["a", "b"], "product", "y", s, cut_lineage=2)
    assert set(tasks) == {cores} and len(tasks) == 2 * n_files
    for one, other in zip(files.trees, cached.trees, strict=True):
        assert (one.feature, one.bin, one.rows, one.cuts) == (other.feature, other.bin, other.rows, other.cuts)
        assert one.value == pytest.approx(other.value)
    steps = [sorted((r["category"], bytes(r["steps"])) for r in m.steps.collect()) for m in (files, cached)]
    assert steps[0] == steps[1] and len(steps[0]) == 300 and len(steps[0][0][1]) == 2 * 6


def test_folders_that_python_can_open():
    from shelfwise.operators import boosting as bo

    assert bo.open_folder("file:/a/b%20c") == "/a/b c" and bo.open_folder("/a/b") == "/a/b" and bo.open_folder("file:///a") == "/a"
    assert bo.open_folder("hdfs://host/a") is None and bo.open_folder("s3a://bucket/a") is None
