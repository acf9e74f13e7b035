"""Demand forecasting.

Series are long tables ``(product_id, ds, y)``; every window is partitioned
by product and ordered by day, so its size is bounded by the calendar span of
one product. Gap filling explodes each product's own [first, last] range --
never a cross join with a global calendar.
"""
from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import ensure_checkpoint_dir, materialize, written

# Fixed values from the reference.
LAGS = (1, 7, 14)
ROLLING_WINDOWS = (7, 14, 28)
MIN_DAYS_WITH_SALES = 30
TEST_DAYS = 30
MA_WINDOW = 7
MAPE_EPSILON = 1.0
HORIZON = 7
# Days of history that a product needs for the model (F14); with fewer it gets the baseline.
MIN_HISTORY_DAYS = 29
CALENDAR_FEATURES = ["day_of_week", "day_of_month", "month", "is_weekend"]
LAG_FEATURES = [f"lag_{k}" for k in LAGS] + [f"rolling_mean_{w}" for w in ROLLING_WINDOWS]

P = "product_id"


# ---------------------------------------------------------------- F1-F3
def sales_by_day(fact_sales: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Facts with their calendar date (dim_date: one row per day of the span,
    bounded by time -> broadcast)."""
    return fact_sales.select(P, "date_id", "quantity").join(
        F.broadcast(dim_date.select("date_id", F.col("date").alias("ds"))), "date_id")


def daily_demand(fact_sales: DataFrame, dim_date: DataFrame) -> DataFrame:
    """total units per day."""
    return (sales_by_day(fact_sales, dim_date).groupBy("ds")
            .agg(F.sum("quantity").cast("long").alias("y")))


def daily_demand_by_product(fact_sales: DataFrame, dim_date: DataFrame,
                            min_days_with_sales: int = MIN_DAYS_WITH_SALES) -> DataFrame:
    """units per product and day, products with >= N sale days only
    (HAVING on a per-product count window)."""
    d = (sales_by_day(fact_sales, dim_date).groupBy(P, "ds")
         .agg(F.sum("quantity").cast("long").alias("y")))
    return (d.withColumn("_days", F.count(F.lit(1)).over(Window.partitionBy(P)))
            .where(F.col("_days") >= min_days_with_sales).drop("_days"))


def fill_missing_dates(df: DataFrame, date_col: str = "ds", value_col: str = "y",
                       group_col: str | None = None) -> DataFrame:
    """gapless days from each series' own first to last day, y = 0 on
    the missing ones. A day brings the days up to the next one of its series,
    so one window finds them; ``df`` is read once and joined with nothing."""
    keys = [group_col] if group_col else []
    after = F.lead(date_col).over(Window.partitionBy(*keys).orderBy(date_col))
    last = F.greatest(F.col(date_col), F.date_sub(after, 1))  # the day itself where there is no next one
    ends = df.select(*keys, F.col(date_col).alias("_own"), value_col, last.alias("_last"))
    days = ends.select(*keys, "_own", value_col, F.explode(F.sequence("_own", "_last")).alias(date_col))
    value = F.when(F.col(date_col) == F.col("_own"), F.coalesce(F.col(value_col), F.lit(0))).otherwise(F.lit(0))
    return days.select(*keys, date_col, value.cast("double").alias(value_col))


# ---------------------------------------------------------------- F4-F8
def calendar_features(ds: Column) -> dict[str, Column]:
    """Monday = 0 weekday, day of month, month, weekend 0/1."""
    wd = F.weekday(ds)
    return {"day_of_week": wd, "day_of_month": F.dayofmonth(ds), "month": F.month(ds),
            "is_weekend": (wd >= 5).cast("int")}


def add_time_series_features(panel: DataFrame) -> DataFrame:
    """Lags 1/7/14 rows and means of the previous 7/14/28 rows (NULL
    until the window is full), by product in day order; calendar columns."""
    w = Window.partitionBy(P).orderBy("ds")
    out = panel.withColumn("_rn", F.row_number().over(w))
    cols = {f"lag_{k}": F.lag("y", k).over(w) for k in LAGS}
    for k in ROLLING_WINDOWS:
        cols[f"rolling_mean_{k}"] = F.when(F.col("_rn") > k, F.avg("y").over(w.rowsBetween(-k, -1)))
    cols.update(calendar_features(F.col("ds")))
    return out.withColumns(cols).drop("_rn")


def drop_incomplete(features: DataFrame) -> DataFrame:
    """rows with every lag/rolling feature present."""
    return features.dropna(subset=LAG_FEATURES)


def temporal_split(df: DataFrame, test_days: int = TEST_DAYS, date_col: str = "ds") -> DataFrame:
    """F8: ``is_test`` = ds >= max(ds) - (test_days - 1) days (scalar max)."""
    cutoff = F.date_sub(df.select(F.max(date_col)).scalar(), test_days - 1)
    return df.withColumn("is_test", F.col(date_col) >= cutoff)


# ---------------------------------------------------------------- F9 / F10
def moving_average_forecast(train: DataFrame, horizon_days: DataFrame, window: int = MA_WINDOW,
                            keys: tuple = ()) -> DataFrame:
    """constant forecast = mean of the last ``window`` train rows of each
    series (0.0 when empty), attached to the requested (keys, ds) rows."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ds")) if keys else Window.orderBy(F.desc("ds"))
    tail = train.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= window)
    level = tail.groupBy(*keys).agg(F.avg("y").alias("yhat"))
    if keys:
        return (horizon_days.join(level, list(keys), "left")
                .withColumn("yhat", F.coalesce("yhat", F.lit(0.0))))
    return horizon_days.withColumn("yhat", F.coalesce(level.select("yhat").scalar(), F.lit(0.0)))


def forecast_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", keys: tuple = (),
                     epsilon: float = MAPE_EPSILON) -> DataFrame:
    """MAE, RMSE and MAPE (denominator |y| + 1, in %), optionally by key."""
    err = F.col(y) - F.col(yhat)
    aggs = [F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
            (F.avg(F.abs(err) / (F.abs(F.col(y)) + F.lit(epsilon))) * 100).alias("mape"),
            F.count(F.lit(1)).alias("n")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


# ---------------------------------------------------------------- F11
def trend_seasonal_design(df: DataFrame, origin, span_days, n_changepoints: int = 25,
                          changepoint_range: float = 0.8, weekly_order: int = 3,
                          yearly_order: int = 10) -> DataFrame:
    """Feature columns of an additive trend + seasonality model: scaled time,
    hinge terms max(0, t - s_j) at evenly spaced changepoints over the first
    80 % of the training span, weekly and yearly Fourier terms
    (Taylor & Letham, 2018). ``origin``/``span_days`` are scalar columns."""
    days = F.datediff(F.col("ds"), origin).cast("double")
    t = days / F.greatest(span_days.cast("double"), F.lit(1.0))
    cols = {"t": t}
    for j in range(n_changepoints):
        s = changepoint_range * (j + 1) / (n_changepoints + 1)
        cols[f"cp_{j}"] = F.greatest(t - F.lit(s), F.lit(0.0))
    for k in range(1, weekly_order + 1):
        cols[f"w_sin_{k}"] = F.sin(days * (2 * math.pi * k / 7.0))
        cols[f"w_cos_{k}"] = F.cos(days * (2 * math.pi * k / 7.0))
    for k in range(1, yearly_order + 1):
        cols[f"y_sin_{k}"] = F.sin(days * (2 * math.pi * k / 365.25))
        cols[f"y_cos_{k}"] = F.cos(days * (2 * math.pi * k / 365.25))
    return df.withColumns(cols)


def fit_trend_seasonal(train: DataFrame, test: DataFrame, reg_param: float = 0.01) -> DataFrame:
    """fit the additive model on train (MLlib LinearRegression, L2) and
    forecast the test days; predictions clipped at 0. Output ds, y, yhat."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    origin = train.select(F.min("ds")).scalar()
    span = train.select(F.datediff(F.max("ds"), F.min("ds"))).scalar()
    tr = materialize(trend_seasonal_design(train, origin, span))
    te = trend_seasonal_design(test, origin, span)
    feats = [c for c in tr.columns if c not in train.columns]
    asm = VectorAssembler(inputCols=feats, outputCol="features")
    model = LinearRegression(featuresCol="features", labelCol="y", regParam=reg_param,
                             elasticNetParam=0.0, maxIter=100).fit(asm.transform(tr))
    pred = model.transform(asm.transform(te))
    return pred.select("ds", "y", F.greatest(F.col("prediction"), F.lit(0.0)).alias("yhat"))


#: Days of a series whose sums one task makes; longer series are split.
DAYS_PER_PART = 4096


@dataclasses.dataclass(frozen=True)
class TrendDesign:
    """The columns of :func:`trend_seasonal_design` as a matrix, an intercept first."""
    n_changepoints: int = 25
    changepoint_range: float = 0.8
    weekly_order: int = 3
    yearly_order: int = 10

    @property
    def width(self) -> int:
        return 2 + self.n_changepoints + 2 * self.weekly_order + 2 * self.yearly_order

    def matrix(self, days, span):
        """Rows for days since the first training day; ``span``: days from the first to the last training day."""
        import numpy as np
        days = np.asarray(days, dtype=np.float64)
        t = days / np.maximum(np.asarray(span, dtype=np.float64), 1.0)
        columns = [np.ones_like(t), t]
        columns += [np.maximum(t - self.changepoint_range * (j + 1) / (self.n_changepoints + 1), 0.0)
                    for j in range(self.n_changepoints)]
        for order, length in ((self.weekly_order, 7.0), (self.yearly_order, 365.25)):
            for k in range(1, order + 1):
                angle = days * (2 * math.pi * k / length)
                columns += [np.sin(angle), np.cos(angle)]
        return np.stack(columns, 1)


def fit_trend_seasonal_by_key(train: DataFrame, key: str = P, design: TrendDesign | None = None,
                              reg_param: float = 0.01) -> DataFrame:
    """F11 for every series at once: key, first_ds, span, n, coefficients (intercept first) of a ridge regression with design
    matrix X: (X'X / n + reg_param I) b = X'y / n, the intercept without a penalty.

    X'X and X'y are sums over rows. They are made for parts of a series of at most DAYS_PER_PART days and added up by key,
    so no series has to be in one task; a key then has one matrix of a fixed size, which is solved by Cholesky.
    """
    import numpy as np
    import pyarrow as pa

    design = design or TrendDesign()
    width = design.width
    series = train.groupBy(key).agg(F.min("ds").alias("first_ds"), F.datediff(F.max("ds"), F.min("ds")).alias("span"))
    days = (train.select(key, "ds", F.col("y").cast("double").alias("y")).join(series, key)
            .select(key, F.datediff("ds", "first_ds").alias("day"), "span", "y"))
    parts = days.withColumn("part", F.floor(F.col("day") / F.lit(DAYS_PER_PART)))
    schema_of_key = train.schema[key].dataType.simpleString()
    packed = f"`{key}` {schema_of_key}, n long, sums binary"

    def sums(table: pa.Table) -> pa.Table:
        x = design.matrix(table.column("day").to_numpy(), table.column("span").to_numpy())
        both = np.append(x.T @ x, (x.T @ table.column("y").to_numpy())[:, None], axis=1)
        return pa.Table.from_arrays([table.column(key).slice(0, 1), pa.array([len(x)], pa.int64()),
                                     pa.array([both.tobytes()], pa.binary())], names=[key, "n", "sums"])

    def solve(table: pa.Table) -> pa.Table:
        n = sum(table.column("n").to_pylist())
        both = sum(np.frombuffer(b) for b in table.column("sums").to_pylist()).reshape(width, width + 1) / n
        penalty = np.full(width, reg_param)
        penalty[0] = 0.0
        low = np.linalg.cholesky(both[:, :-1] + np.diag(penalty))
        b = np.linalg.solve(low.T, np.linalg.solve(low, both[:, -1]))
        return pa.Table.from_arrays([table.column(key).slice(0, 1), pa.array([n], pa.int64()),
                                     pa.array([b.tolist()], pa.list_(pa.float64()))], names=[key, "n", "coefficients"])

    summed = parts.groupBy(key, "part").applyInArrow(sums, packed)
    solved = summed.groupBy(key).applyInArrow(solve, f"`{key}` {schema_of_key}, n long, coefficients array<double>")
    return series.join(solved, key)


def forecast_trend_seasonal_by_key(models: DataFrame, days: DataFrame, key: str = P,
                                   design: TrendDesign | None = None) -> DataFrame:
    """The rows of ``days`` (key, ds and more) whose key has a model, and yhat (at least 0)."""
    import numpy as np
    import pyarrow as pa

    design = design or TrendDesign()
    kept = days.columns
    data = days.join(models.select(key, "first_ds", "span", "coefficients"), key).select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.datediff("ds", "first_ds").alias("day"), "span", "coefficients")

    def run(batches):
        for batch in batches:
            x = design.matrix(batch.column("day").to_numpy(), batch.column("span").to_numpy())
            b = np.asarray(batch.column("coefficients").flatten()).reshape(x.shape)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.maximum((x * b).sum(1), 0.0))], names=["row", "yhat"])

    return data.mapInArrow(run, data.select("row").withColumn("yhat", F.lit(0.0)).schema).select("row.*", "yhat")


# ---------------------------------------------------------------- F12-F14
def product_encoding(train: DataFrame) -> DataFrame:
    """The products that a model knows, with the mean of y."""
    return train.groupBy(P).agg(F.avg("y").alias("product_level"))


GBT_FEATURES = LAG_FEATURES + CALENDAR_FEATURES


def fit_global_model(features: DataFrame, max_iter: int = 300):
    """boosted trees (300 trees of 31 leaves, learning rate 0.05) on complete-feature rows, the product as a
    category. Returns (pipeline model, known products); the order of the products is part of the model."""
    from pyspark.ml import Pipeline

    from shelfwise.operators.boosting_ml import LeafwiseBooster

    features = features.select(P, "y", *GBT_FEATURES)  # the fit writes its own copy
    booster = LeafwiseBooster(trees=max_iter, featureColumns=GBT_FEATURES, categoryColumn=P, labelColumn="y")
    return Pipeline(stages=[booster]).fit(features), materialize(product_encoding(features))


def evaluate_global_model(features: DataFrame, test_days: int = TEST_DAYS, max_iter: int = 300) -> DataFrame:
    """F12 evaluation: train before the cutoff, one-step-ahead predictions on
    the test days (clipped at 0), metrics. A product that the training days do not have counts as an average one."""
    split = temporal_split(written(drop_incomplete(features), "features"), test_days)
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    model, _ = fit_global_model(train, max_iter)
    pred = model.transform(test)
    pred = pred.withColumn("yhat", F.greatest(F.col("prediction"), F.lit(0.0)))
    return forecast_metrics(pred)


def _history_tail(daily: DataFrame, n: int = max(ROLLING_WINDOWS)) -> DataFrame:
    """Per product: last sale day, filled history length and the last n
    filled daily values as an array (0 on days without sales). Only the
    rows of the last n days of each product are touched."""
    last = daily.groupBy(P).agg(F.max("ds").alias("last_ds"), F.min("ds").alias("first_ds"))
    recent = (daily.join(last, P).where(F.col("ds") > F.date_sub("last_ds", n))
              .groupBy(P).agg(F.map_from_entries(F.collect_list(F.struct("ds", "y"))).alias("_m")))
    tail = last.join(recent, P).withColumn(
        "hist", F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)),
                            lambda i: F.coalesce(F.col("_m")[F.date_sub("last_ds", i)], F.lit(0.0)).cast("double")))
    return tail.select(P, "last_ds", (F.datediff("last_ds", "first_ds") + 1).alias("n_days"), "hist")


def _features_from_history(hist: Column, target: Column) -> dict[str, Column]:
    n = F.size(hist)
    cols = {f"lag_{k}": F.element_at(hist, n - k + 1) for k in LAGS}
    for w in ROLLING_WINDOWS:
        window = F.slice(hist, n - w + 1, w)
        cols[f"rolling_mean_{w}"] = F.aggregate(window, F.lit(0.0), lambda a, x: a + x) / F.lit(float(w))
    cols.update(calendar_features(target))
    return cols


def recursive_forecast(daily_by_product: DataFrame, model, encoding: DataFrame, horizon: int = HORIZON,
                       window: int = MA_WINDOW) -> DataFrame:
    """F14 for every product at once: products with >= 29 filled days and a
    known encoding run ``horizon`` model steps, each prediction (>= 0) feeding
    the next step's lags; the others get the moving-average baseline. Day 1 is
    the day after the product's own last sale. Each step's table is
    checkpointed, so the plan does not grow with the horizon."""
    ensure_checkpoint_dir(daily_by_product.sparkSession)
    tail = materialize(_history_tail(daily_by_product).join(encoding, P, "left"))
    use_model = (F.col("n_days") >= MIN_HISTORY_DAYS) & F.col("product_level").isNotNull()
    # baseline: mean of the last min(7, n_days) filled values
    base_vals = F.slice("hist", F.size("hist") - F.least(F.col("n_days"), F.lit(window)) + 1,
                        F.least(F.col("n_days"), F.lit(window)))
    baseline = (tail.where(~use_model)
                .withColumn("_lvl", F.aggregate(base_vals, F.lit(0.0), lambda a, x: a + x) / F.size(base_vals))
                .select(P, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "last_ds", "_lvl")
                .select(P, "step", F.date_add("last_ds", F.col("step")).alias("ds"),
                        F.col("_lvl").alias("yhat"), F.lit("baseline_moving_average").alias("model_used")))
    state = tail.where(use_model).select(P, "last_ds", "product_level", "hist",
                                         F.array().cast("array<double>").alias("preds"))
    for step in range(1, horizon + 1):
        target = F.date_add("last_ds", step)
        feats = state.withColumns(_features_from_history(F.col("hist"), target))
        scored = model.transform(feats).withColumn("_p", F.greatest(F.col("prediction"), F.lit(0.0)))
        state = (scored.select(P, "last_ds", "product_level",
                               F.concat("hist", F.array("_p")).alias("hist"),
                               F.concat("preds", F.array("_p")).alias("preds"))
                 .checkpoint(eager=True))
    modelled = (state.select(P, "last_ds", F.posexplode("preds").alias("_i", "yhat"))
                .select(P, (F.col("_i") + 1).alias("step"), F.date_add("last_ds", F.col("_i") + 1).alias("ds"),
                        "yhat", F.lit(getattr(model, "name", "gbt_global")).alias("model_used")))
    out = modelled.unionByName(baseline)
    return out.withColumn("predicted_demand", F.floor(F.col("yhat") * 100 + 0.5) / 100).drop("yhat")


def forecast_lookup(forecasts: DataFrame, requests: DataFrame) -> DataFrame:
    """the forecast rows of the requested products, ``found`` true; a
    product without a forecast answers one row with ``found`` false."""
    asked = requests.select(P).distinct()
    return (asked.join(forecasts.withColumn("found", F.lit(True)), P, "left")
            .withColumn("found", F.coalesce("found", F.lit(False))))


class RollingMeanModel:
    """A step model for F14 with the interface of a fitted one: the mean of the last seven days, its own predictions
    included. It needs no fit, so its recursion can be checked exactly."""

    name = "rolling_mean_7"

    def transform(self, features: DataFrame) -> DataFrame:
        return features.withColumn("prediction", F.col("rolling_mean_7"))


def save_global_model(model, encoding: DataFrame, path: str) -> None:
    """The refitted model and the products it knows."""
    model.write().overwrite().save(f"{path}/model")
    encoding.write.mode("overwrite").parquet(f"{path}/product_level")


def load_global_model(spark, path: str):
    """(model, encoding) as :func:`save_global_model` wrote them."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/product_level")
