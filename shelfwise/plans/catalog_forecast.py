"""Registered forecasting queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions.numeric import round_half_up
from shelfwise.operators import boosting
from shelfwise.operators import forecast as fc
from shelfwise.plans.catalog import register
from shelfwise.plans.warehouse import Warehouse
from shelfwise.session import materialize, written


def _r6(df, *cols):
    return df.withColumns({c: round_half_up(c, 6) for c in cols})


def _panel(wh):
    return fc.fill_missing_dates(fc.daily_demand_by_product(wh.fact_sales, wh.dim_date), group_col="product_id")


def _aggregate(wh):
    return fc.fill_missing_dates(fc.daily_demand(wh.fact_sales, wh.dim_date))


@register("f1_daily_demand")
def q_daily(spark, sf_dir):
    wh = Warehouse(spark, sf_dir, reuse=True)
    return fc.daily_demand(wh.fact_sales, wh.dim_date)


@register("f2_product_daily_demand")
def q_daily_product(spark, sf_dir):
    wh = Warehouse(spark, sf_dir, reuse=True)
    return fc.daily_demand_by_product(wh.fact_sales, wh.dim_date)


@register("f3_filled_panel")
def q_filled(spark, sf_dir):
    return _panel(Warehouse(spark, sf_dir, reuse=True))


@register("f3_filled_aggregate")
def q_filled_total(spark, sf_dir):
    return _aggregate(Warehouse(spark, sf_dir, reuse=True))


@register("f6_features")
def q_features(spark, sf_dir):
    f = fc.add_time_series_features(_panel(Warehouse(spark, sf_dir, reuse=True)))
    return _r6(f, *[f"rolling_mean_{w}" for w in fc.ROLLING_WINDOWS])


@register("f8_split_summary")
def q_split(spark, sf_dir):
    f = fc.drop_incomplete(fc.add_time_series_features(_panel(Warehouse(spark, sf_dir, reuse=True))))
    s = fc.temporal_split(written(f.select("product_id", "ds", "y")))  # read twice: the last day, then every row
    return s.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.min("ds").alias("first_ds"),
                                    F.max("ds").alias("last_ds"))


def _baseline_aggregate(wh):
    s = fc.temporal_split(_aggregate(wh))
    train, test = s.where(~F.col("is_test")), s.where(F.col("is_test"))
    return fc.moving_average_forecast(train, test.select("ds", "y"))


@register("f9_baseline_aggregate")
def q_baseline(spark, sf_dir):
    return _r6(_baseline_aggregate(Warehouse(spark, sf_dir, reuse=True)), "yhat")


@register("f10_baseline_metrics")
def q_baseline_metrics(spark, sf_dir):
    return _r6(fc.forecast_metrics(_baseline_aggregate(Warehouse(spark, sf_dir, reuse=True))), "mae", "rmse", "mape")


@register("f10_baseline_metrics_by_product")
def q_baseline_metrics_product(spark, sf_dir):
    s = fc.temporal_split(_panel(Warehouse(spark, sf_dir, reuse=True)))
    train, test = s.where(~F.col("is_test")), s.where(F.col("is_test"))
    pred = fc.moving_average_forecast(train, test.select("product_id", "ds", "y"), keys=("product_id",))
    return _r6(fc.forecast_metrics(pred, keys=("product_id",)), "mae", "rmse", "mape")


@register("f11_trend_seasonal_forecast")
def q_trend_seasonal(spark, sf_dir):
    s = materialize(fc.temporal_split(materialize(_aggregate(Warehouse(spark, sf_dir, reuse=True)))))
    pred = fc.fit_trend_seasonal(s.where(~F.col("is_test")), s.where(F.col("is_test")))
    return pred


@register("f11_trend_seasonal_metrics")
def q_trend_seasonal_metrics(spark, sf_dir):
    return fc.forecast_metrics(q_trend_seasonal(spark, sf_dir))


@register("f11_by_product")
def q_trend_by_product(spark, sf_dir):
    """The keyed fit with a trend and one weekly wave, whose four coefficients SQL can solve for."""
    panel = written(_panel(Warehouse(spark, sf_dir, reuse=True)))
    models = fc.fit_trend_seasonal_by_key(panel, design=fc.TrendDesign(n_changepoints=0, weekly_order=1, yearly_order=0))
    models = models.select("product_id", "first_ds", "span", "n", *[F.col("coefficients")[i].alias(f"b{i}") for i in range(4)])
    return _r6(models, *[f"b{i}" for i in range(4)])


@register("f11_by_product_metrics")
def q_trend_by_product_metrics(spark, sf_dir):
    """The full design for every product: fitted before the test days, errors on them."""
    split = fc.temporal_split(written(_panel(Warehouse(spark, sf_dir, reuse=True))))
    models = fc.fit_trend_seasonal_by_key(split.where(~F.col("is_test")))
    pred = fc.forecast_trend_seasonal_by_key(models, split.where("is_test").select("product_id", "ds", "y"))
    return fc.forecast_metrics(pred, keys=("product_id",))


@register("f12_first_tree")
def q_first_tree(spark, sf_dir):
    """The nodes of the first boosted tree over all complete rows: splits, values and numbers of rows."""
    features = fc.drop_incomplete(fc.add_time_series_features(_panel(Warehouse(spark, sf_dir, reuse=True))))
    tree = boosting.fit(features, fc.GBT_FEATURES, "product_id", "y", boosting.exact(trees=1)).trees[0]
    rows = [(i, *(x if tree.feature[i] >= 0 else None for x in (tree.feature[i], tree.bin[i], tree.left[i], tree.right[i])),
             float(tree.value[i]), tree.rows[i]) for i in range(len(tree.feature))]
    schema = "node int, feature int, bin int, left_node int, right_node int, value double, n_rows long"
    return _r6(spark.createDataFrame(rows, schema), "value")


@register("f12_gbt_metrics")
def q_gbt_metrics(spark, sf_dir):
    f = fc.drop_incomplete(fc.add_time_series_features(_panel(Warehouse(spark, sf_dir, reuse=True))))
    return fc.evaluate_global_model(f)


@register("f14_recursive_forecast")
def q_recursive(spark, sf_dir):
    """F13 + F14: refit on every complete-feature row, then 7 recursive steps
    for every product of the warehouse (baseline for short/unknown ones)."""
    wh = Warehouse(spark, sf_dir, reuse=True)
    features = written(fc.drop_incomplete(fc.add_time_series_features(_panel(wh))))
    model, enc = fc.fit_global_model(features)
    all_daily = fc.daily_demand_by_product(wh.fact_sales, wh.dim_date, min_days_with_sales=1)
    return fc.recursive_forecast(all_daily, model, enc)


def _recursive_mean(spark, sf_dir):
    """F14's recursion with the seven-day mean as step model for the products of the panel, the baseline for the others."""
    wh = Warehouse(spark, sf_dir, reuse=True)
    daily = materialize(fc.daily_demand_by_product(wh.fact_sales, wh.dim_date, min_days_with_sales=1))
    regular = daily.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fc.MIN_DAYS_WITH_SALES)
    level = regular.select("product_id", F.lit(0.0).alias("product_level"))
    return fc.recursive_forecast(daily, fc.RollingMeanModel(), level)


@register("f14_recursive_mean")
def q_recursive_mean(spark, sf_dir):
    return _recursive_mean(spark, sf_dir).select("product_id", "step", "ds", "predicted_demand", "model_used")


@register("f15_forecast_lookup")
def q_forecast_lookup(spark, sf_dir):
    """Answers for every part of the catalogue and for an id that does not exist."""
    asked = Warehouse(spark, sf_dir).table("part").select(F.col("p_partkey").cast("string").alias("product_id"))
    asked = asked.unionByName(spark.createDataFrame([("no such product",)], "product_id string"))
    found = fc.forecast_lookup(_recursive_mean(spark, sf_dir), asked)
    return found.select("product_id", "found", F.coalesce("step", F.lit(0)).alias("step"), "predicted_demand")
