"""Oracle SQL for the forecasting data side."""
from shelfwise.plans.oracle import R, cte, oracle

cte("sales_days", "SELECT fs.product_id, d.date AS ds, fs.quantity FROM fact_sales fs JOIN dim_date d USING (date_id)")
cte("daily_total", "SELECT ds, CAST(sum(quantity) AS BIGINT) AS y FROM sales_days GROUP BY ds")
cte("daily_product", """
SELECT product_id, ds, y FROM (
  SELECT product_id, ds, CAST(sum(quantity) AS BIGINT) AS y, count(*) OVER (PARTITION BY product_id) AS n_days
  FROM sales_days GROUP BY product_id, ds)
WHERE n_days >= 30""")
cte("filled_panel", """
SELECT g.product_id, g.ds, CAST(coalesce(d.y, 0) AS DOUBLE) AS y
FROM (SELECT product_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds
      FROM daily_product GROUP BY product_id) g
LEFT JOIN daily_product d ON d.product_id = g.product_id AND d.ds = g.ds""")
cte("filled_total", """
SELECT g.ds, CAST(coalesce(d.y, 0) AS DOUBLE) AS y
FROM (SELECT CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM daily_total) g
LEFT JOIN daily_total d ON d.ds = g.ds""")


def _roll(k: int) -> str:
    return (f"CASE WHEN row_number() OVER (PARTITION BY product_id ORDER BY ds) > {k} THEN "
            f"avg(y) OVER (PARTITION BY product_id ORDER BY ds ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END")


cte("ts_features", f"""
SELECT product_id, ds, y,
       lag(y, 1) OVER (PARTITION BY product_id ORDER BY ds) AS lag_1,
       lag(y, 7) OVER (PARTITION BY product_id ORDER BY ds) AS lag_7,
       lag(y, 14) OVER (PARTITION BY product_id ORDER BY ds) AS lag_14,
       {_roll(7)} AS rolling_mean_7, {_roll(14)} AS rolling_mean_14, {_roll(28)} AS rolling_mean_28,
       CAST(isodow(ds) - 1 AS INTEGER) AS day_of_week, CAST(day(ds) AS INTEGER) AS day_of_month,
       CAST(month(ds) AS INTEGER) AS month, CAST(isodow(ds) >= 6 AS INTEGER) AS is_weekend
FROM filled_panel""")
cte("agg_split", "SELECT *, ds >= (SELECT max(ds) FROM filled_total) - 29 AS is_test FROM filled_total")
cte("agg_baseline", """
SELECT ds, y, coalesce((SELECT avg(y) FROM (SELECT y FROM agg_split WHERE NOT is_test ORDER BY ds DESC LIMIT 7)), 0.0)
       AS yhat
FROM agg_split WHERE is_test""")
cte("panel_split", "SELECT *, ds >= (SELECT max(ds) FROM filled_panel) - 29 AS is_test FROM filled_panel")

oracle("f1_daily_demand", "SELECT * FROM daily_total")
oracle("f2_product_daily_demand", "SELECT * FROM daily_product")
oracle("f3_filled_panel", "SELECT * FROM filled_panel")
oracle("f3_filled_aggregate", "SELECT * FROM filled_total")
oracle("f6_features", f"""
SELECT product_id, ds, y, lag_1, lag_7, lag_14, {R('rolling_mean_7', 6)} AS rolling_mean_7,
       {R('rolling_mean_14', 6)} AS rolling_mean_14, {R('rolling_mean_28', 6)} AS rolling_mean_28,
       day_of_week, day_of_month, month, is_weekend
FROM ts_features""")
cte("complete_features", """
SELECT * FROM ts_features WHERE lag_1 IS NOT NULL AND lag_7 IS NOT NULL AND lag_14 IS NOT NULL
  AND rolling_mean_7 IS NOT NULL AND rolling_mean_14 IS NOT NULL AND rolling_mean_28 IS NOT NULL""")
oracle("f8_split_summary", """
SELECT is_test, count(*) AS n, min(ds) AS first_ds, max(ds) AS last_ds FROM (
  SELECT *, ds >= (SELECT max(ds) FROM complete_features) - 29 AS is_test FROM complete_features)
GROUP BY is_test""")
oracle("f9_baseline_aggregate", f"SELECT ds, y, {R('yhat', 6)} AS yhat FROM agg_baseline")
_METRICS = f"""{R('avg(abs(y - yhat))', 6)} AS mae, {R('sqrt(avg((y - yhat) * (y - yhat)))', 6)} AS rmse,
       {R('avg(abs(y - yhat) / (abs(y) + 1.0)) * 100', 6)} AS mape, count(*) AS n"""
oracle("f10_baseline_metrics", f"SELECT {_METRICS} FROM agg_baseline")
oracle("f10_baseline_metrics_by_product", f"""
SELECT product_id, {_METRICS} FROM (
  SELECT t.product_id, t.y, coalesce(l.yhat, 0.0) AS yhat
  FROM panel_split t
  LEFT JOIN (SELECT product_id, avg(y) AS yhat FROM (
               SELECT product_id, y, row_number() OVER (PARTITION BY product_id ORDER BY ds DESC) AS rn
               FROM panel_split WHERE NOT is_test) WHERE rn <= 7 GROUP BY product_id) l USING (product_id)
  WHERE t.is_test)
GROUP BY product_id""")

# ---- the recursion of F14 with the seven-day mean as step model, and the lookup of F15
cte("daily_any", "SELECT product_id, ds, CAST(sum(quantity) AS DOUBLE) AS y FROM sales_days GROUP BY product_id, ds")
cte("history", """
SELECT g.product_id, any_value(g.last_ds) AS last_ds, any_value(g.n_days) AS n_days,
       any_value(g.n_sale_days) AS n_sale_days, list(coalesce(d.y, 0.0) ORDER BY g.ds) AS hist
FROM (SELECT product_id, last_ds, n_days, n_sale_days,
             CAST(unnest(generate_series(last_ds - 27, last_ds, INTERVAL 1 DAY)) AS DATE) AS ds
      FROM (SELECT product_id, max(ds) AS last_ds, max(ds) - min(ds) + 1 AS n_days, count(*) AS n_sale_days
            FROM daily_any GROUP BY product_id)) g
LEFT JOIN daily_any d ON d.product_id = g.product_id AND d.ds = g.ds
GROUP BY g.product_id""")
cte("mean_forecast", f"""
SELECT product_id, CAST(step AS INTEGER) AS step, CAST(last_ds + CAST(step AS INTEGER) AS DATE) AS ds,
       {R('p')} AS predicted_demand, model_used
FROM (
  WITH RECURSIVE walk AS (
    SELECT product_id, last_ds, 0 AS step, hist, 0.0::DOUBLE AS p FROM history WHERE n_days >= 29 AND n_sale_days >= 30
    UNION ALL
    SELECT product_id, last_ds, step + 1, list_append(hist, list_sum(hist[-7:]) / 7.0), list_sum(hist[-7:]) / 7.0
    FROM walk WHERE step < 7)
  SELECT product_id, last_ds, step, p, 'rolling_mean_7' AS model_used FROM walk WHERE step > 0
  UNION ALL
  SELECT product_id, last_ds, unnest(range(1, 8)), list_sum(hist[-least(n_days, 7):]) / least(n_days, 7),
         'baseline_moving_average'
  FROM history WHERE NOT (n_days >= 29 AND n_sale_days >= 30))""")
oracle("f14_recursive_mean", "SELECT * FROM mean_forecast")
oracle("f15_forecast_lookup", """
SELECT a.product_id, f.product_id IS NOT NULL AS found, coalesce(f.step, 0) AS step, f.predicted_demand
FROM (SELECT CAST(p_partkey AS VARCHAR) AS product_id FROM part UNION ALL SELECT 'no such product') a
LEFT JOIN mean_forecast f USING (product_id)""")
