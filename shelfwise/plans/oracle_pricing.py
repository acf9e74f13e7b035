"""Oracle SQL for the pricing queries."""
from shelfwise.plans.oracle import RE, R, cte, dbl, oracle

cte("price_history", """
SELECT fs.product_id, d.date AS ds, fs.unit_price, fs.quantity
FROM fact_sales fs JOIN dim_date d ON d.date_id = fs.date_id""")

cte("product_day", """
SELECT product_id, ds, avg(unit_price) AS unit_price, CAST(sum(quantity) AS BIGINT) AS quantity
FROM price_history GROUP BY product_id, ds""")

cte("elasticity", """
SELECT product_id,
       CASE WHEN elig THEN least(greatest(slope, -10.0), 0.0) ELSE -1.5 END AS elasticity,
       CASE WHEN elig THEN CASE WHEN vy > 0 THEN r2 ELSE 0.0 END END AS r_squared,
       n AS n_observations, elig AS is_estimated
FROM (
  SELECT product_id, n, slope, r2, vy,
         n >= 20 AND nd >= 5 AND coalesce(sd / nullif(mu, 0), 0) > 0.05 AS elig
  FROM (
    SELECT product_id,
           count(*) FILTER (WHERE unit_price > 0) AS n,
           count(DISTINCT CASE WHEN unit_price > 0 THEN unit_price END) AS nd,
           avg(CASE WHEN unit_price > 0 THEN unit_price END) AS mu,
           stddev_samp(CASE WHEN unit_price > 0 THEN unit_price END) AS sd,
           regr_slope(CASE WHEN unit_price > 0 THEN ln(quantity + 1) END,
                      CASE WHEN unit_price > 0 THEN ln(unit_price) END) AS slope,
           regr_r2(CASE WHEN unit_price > 0 THEN ln(quantity + 1) END,
                   CASE WHEN unit_price > 0 THEN ln(unit_price) END) AS r2,
           var_pop(CASE WHEN unit_price > 0 THEN ln(quantity + 1) END) AS vy
    FROM product_day GROUP BY product_id))""")

cte("avg_demand", """
SELECT product_id, avg(q) AS avg_daily_demand
FROM (SELECT product_id, ds, sum(quantity) AS q FROM price_history GROUP BY product_id, ds)
GROUP BY product_id""")

cte("pricing_input", """
SELECT r.product_id, r.cost_price, r.current_price, e.elasticity, e.r_squared, e.is_estimated,
       coalesce(a.avg_daily_demand, 0.1) AS avg_daily_demand
FROM dim_product r LEFT JOIN elasticity e USING (product_id) LEFT JOIN avg_demand a USING (product_id)""")

_STEP = (0.3 - (-0.3)) / 12
cte("price_grid", f"""
SELECT product_id, cost_price, current_price, elasticity, r_squared, is_estimated, avg_daily_demand, i,
       price, demand, price * demand AS revenue, cost_price * demand AS cost,
       price * demand - cost_price * demand AS margin
FROM (
  SELECT *, CASE WHEN current_price > 0 AND avg_daily_demand > 0
                 THEN avg_daily_demand * pow(price / current_price, elasticity) ELSE 0.0 END AS demand
  FROM (
    SELECT p.*, g.i,
           p.current_price * (1.0 + CASE WHEN g.i = 12 THEN {dbl(0.3)} ELSE g.i * {dbl(_STEP)} + {dbl(-0.3)} END) AS price
    FROM pricing_input p, (SELECT unnest(range(0, 13)) AS i) g))""")

cte("pricing_table", f"""
SELECT product_id, {RE('current_price')} AS current_price,
       {RE('best.price')} AS recommended_price,
       {RE('best.price - current_price')} AS price_difference,
       {RE('best.demand')} AS estimated_demand_at_recommended_price,
       {RE('near_margin')} AS estimated_margin_at_current_price,
       {RE('best.margin')} AS estimated_margin_at_recommended_price,
       {RE('elasticity', 3)} AS elasticity, is_estimated, r_squared, cost_price, avg_daily_demand
FROM (
  SELECT product_id, current_price, elasticity, is_estimated, r_squared, cost_price, avg_daily_demand,
         arg_max({{'price': price, 'demand': demand, 'margin': margin}}, (margin, -i)) AS best,
         arg_min(margin, (abs(price - current_price), i)) AS near_margin
  FROM price_grid WHERE avg_daily_demand > 0
  GROUP BY product_id, current_price, elasticity, is_estimated, r_squared, cost_price, avg_daily_demand)""")

oracle("s8_price_history", "SELECT * FROM price_history")
oracle("p1_product_day_panel", f"SELECT product_id, ds, {R('unit_price', 6)} AS unit_price, quantity FROM product_day")
oracle("p3_elasticity", f"""
SELECT product_id, {R('elasticity', 6)} AS elasticity, {R('r_squared', 6)} AS r_squared, n_observations, is_estimated
FROM elasticity""")
oracle("p5_avg_daily_demand", f"SELECT product_id, {R('avg_daily_demand', 6)} AS avg_daily_demand FROM avg_demand")
oracle("p8_price_curves", f"""
SELECT product_id, CAST(i AS INTEGER) AS point, {R('price', 4)} AS price, {R('demand', 4)} AS estimated_demand,
       {R('revenue', 4)} AS estimated_revenue, {R('cost', 4)} AS estimated_cost, {R('margin', 4)} AS estimated_margin
FROM price_grid""")
oracle("p10_pricing_table", f"""
SELECT product_id, current_price, recommended_price, price_difference, estimated_demand_at_recommended_price,
       estimated_margin_at_current_price, estimated_margin_at_recommended_price, elasticity, is_estimated,
       {R('r_squared', 6)} AS r_squared, cost_price, {R('avg_daily_demand', 6)} AS avg_daily_demand
FROM pricing_table""")
oracle("p11_pricing_summary", f"""
SELECT count(*) AS n_products, count(*) FILTER (WHERE is_estimated) AS n_estimated,
       count(*) FILTER (WHERE NOT is_estimated) AS n_assumed,
       {R('CAST(avg(CAST(elasticity AS DECIMAL(12,3))) AS DOUBLE)', 6)} AS avg_elasticity,
       {R('avg(CASE WHEN price_difference <> 0 THEN 1.0 ELSE 0.0 END * 100)', 6)} AS pct_price_changed,
       {R('quantile_cont((estimated_margin_at_recommended_price - estimated_margin_at_current_price)'
          ' / nullif(abs(estimated_margin_at_current_price), 0) * 100, 0.5)', 6)} AS median_margin_uplift_pct
FROM pricing_table""")
cte("price_requests", f"""
SELECT product_id, {dbl(-0.2)} AS lo, {dbl(0.2)} AS hi, n FROM pricing_table, (VALUES (5), (2), (51)) AS sizes(n)
UNION ALL SELECT 'no such product', {dbl(-0.2)}, {dbl(0.2)}, 5
UNION ALL SELECT 'no such product', {dbl(-0.2)}, {dbl(0.2)}, 2""")
oracle("p12_custom_simulation", f"""
SELECT product_id, lo, hi, n, status, coalesce(CAST(point AS INTEGER), -1) AS point, {RE('price')} AS price,
       {RE('demand')} AS estimated_demand, {RE('price * demand')} AS estimated_revenue,
       {RE('cost_price * demand')} AS estimated_cost, {RE('price * demand - cost_price * demand')} AS estimated_margin
FROM (
  SELECT *, CASE WHEN status = 'ok' THEN CASE WHEN current_price > 0 AND avg_daily_demand > 0
                 THEN avg_daily_demand * pow(price / current_price, elasticity) ELSE 0.0 END END AS demand
  FROM (
    SELECT *, CASE WHEN status = 'ok' THEN
             current_price * (1.0 + CASE WHEN point = n - 1 THEN hi ELSE point * ((hi - lo) / (n - 1)) + lo END) END AS price
    FROM (
      SELECT r.*, t.current_price, t.avg_daily_demand, t.cost_price, t.elasticity,
             CASE WHEN n < 3 OR n > 50 THEN 'bad_grid' WHEN t.product_id IS NULL THEN 'unknown_product' ELSE 'ok' END AS status,
             unnest(CASE WHEN n < 3 OR n > 50 OR t.product_id IS NULL THEN [NULL] ELSE range(0, n) END) AS point
      FROM price_requests r LEFT JOIN pricing_table t USING (product_id))))""")
oracle("p10_pricing_lookup", f"""
SELECT r.product_id, t.product_id IS NOT NULL AS found, t.current_price, t.recommended_price, t.elasticity,
       coalesce(t.is_estimated, false) AS is_estimated
FROM (SELECT DISTINCT product_id FROM raw_sales UNION ALL SELECT 'no such product') r
LEFT JOIN pricing_table t USING (product_id)""")
