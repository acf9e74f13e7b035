"""Oracle SQL for the data-quality and extension queries."""
from shelfwise.plans.oracle import _K3_EXACT, R, RE, cte, oracle

def _report(t: dict[str, str]) -> str:
    """The quality report over tables of the given names. NOT coalesce(..., false): a NULL breaks a rule."""
    def key(name: str, table: str, *cols: str) -> str:
        whole = " AND ".join(f"{c} IS NOT NULL" for c in cols)
        one = f"CASE WHEN {whole} THEN ({', '.join(cols)}) END" if len(cols) > 1 else cols[0]
        return (f"SELECT '{name}' AS \"check\", CAST(count(*) FILTER (WHERE NOT ({whole})) + count({one})"
                f" - count(DISTINCT {one}) AS BIGINT) AS violations FROM {t[table]}")

    def rule(name: str, table: str, condition: str) -> str:
        return f"SELECT '{name}', count(*) FILTER (WHERE NOT coalesce({condition}, false)) FROM {t[table]}"

    def orphans(name: str, child: str, parent: str, col: str) -> str:
        return (f"SELECT '{name}', (SELECT count(*) FROM {t[child]} c"
                f" WHERE NOT EXISTS (SELECT 1 FROM {t[parent]} p WHERE p.{col} = c.{col}))")

    return "\nUNION ALL ".join([
        key("q1_customer_key", "dim_customer", "customer_id"),
        key("q1_product_key", "dim_product", "product_id"),
        key("q1_date_key", "dim_date", "date_id"),
        key("q1_inventory_key", "fact_inventory", "product_id", "date_id"),
        key("q1_promotion_key", "dim_promotion", "promotion_id"),
        key("q1_event_key", "fact_web_events", "event_id"),
        rule("q2_sales_ranges", "fact_sales",
             "quantity > 0 AND unit_price >= 0 AND revenue >= 0 AND discount BETWEEN 0 AND 1"),
        rule("q2_product_prices", "dim_product", "cost_price >= 0 AND base_price >= 0 AND current_price >= 0"),
        rule("q2_stock_ranges", "fact_inventory",
             "opening_stock >= 0 AND stock_in >= 0 AND quantity_sold >= 0 AND closing_stock >= 0"),
        rule("q3_revenue_margin", "fact_sales",
             f"abs(revenue - {RE('quantity * unit_price * (1 - discount)')}) <= 0.005"
             f" AND abs(margin - {RE('revenue - cost')}) <= 0.005"),
        rule("q4_closing_stock", "fact_inventory",
             "closing_stock = CASE WHEN opening_stock + stock_in - quantity_sold < 0 THEN 0"
             " ELSE opening_stock + stock_in - quantity_sold END"),
        orphans("q5_sales_customer_fk", "fact_sales", "dim_customer", "customer_id"),
        orphans("q5_sales_product_fk", "fact_sales", "dim_product", "product_id"),
        orphans("q5_sales_date_fk", "fact_sales", "dim_date", "date_id"),
        orphans("q5_inventory_product_fk", "fact_inventory", "dim_product", "product_id"),
        orphans("q5_promotion_product_fk", "dim_promotion", "dim_product", "product_id"),
        f"SELECT 'q6_calendar_gaps', count(*) FILTER (WHERE gap <> 1)"
        f" FROM (SELECT date - lag(date) OVER (ORDER BY date) AS gap FROM {t['dim_date']})",
        rule("q7_promotion_rules", "dim_promotion",
             "discount_percentage > 0 AND discount_percentage <= 0.30 AND start_date <= end_date"),
        rule("q8_event_types", "fact_web_events",
             "event_type IN ('view', 'add_to_cart', 'remove_from_cart', 'purchase') AND event_time IS NOT NULL")])


_TABLES = ("fact_sales", "fact_inventory", "dim_product", "dim_date", "dim_promotion", "dim_customer", "fact_web_events")
oracle("q1_q8_quality_report", _report({t: t for t in _TABLES}))

# the same tables with faults planted by rule, so that every check has something to count
for _t, _sql in {
    "fact_sales": """
SELECT * REPLACE (CASE WHEN date_id % 29 = 0 THEN NULL ELSE quantity END AS quantity,
                  CASE WHEN date_id % 31 = 0 THEN 1.5 ELSE discount END AS discount,
                  CASE WHEN date_id % 37 = 0 THEN revenue + 1 ELSE revenue END AS revenue,
                  CASE WHEN date_id % 41 = 0 THEN 'nobody' ELSE customer_id END AS customer_id,
                  CASE WHEN date_id % 43 = 0 THEN NULL ELSE product_id END AS product_id) FROM fact_sales""",
    "fact_inventory": """
SELECT * REPLACE (CASE WHEN product_id LIKE '%5' THEN closing_stock + 1 ELSE closing_stock END AS closing_stock,
                  CASE WHEN product_id LIKE '%9' THEN -1 ELSE stock_in END AS stock_in,
                  CASE WHEN product_id LIKE '%4' THEN NULL ELSE date_id END AS date_id,
                  CASE WHEN product_id LIKE '%2' THEN 'no product' ELSE product_id END AS product_id) FROM fact_inventory""",
    "dim_product": """
SELECT * REPLACE (CASE WHEN product_id LIKE '%3' THEN NULL ELSE cost_price END AS cost_price) FROM dim_product
UNION ALL SELECT * FROM dim_product WHERE product_id LIKE '%7'""",
    "dim_date": "SELECT * FROM dim_date WHERE day <> 13 UNION ALL SELECT * FROM dim_date WHERE day = 14",
    "dim_promotion": """
SELECT * REPLACE (CASE WHEN product_id LIKE '%1' THEN 0.31 ELSE discount_percentage END AS discount_percentage,
                  CASE WHEN product_id LIKE '%6' THEN NULL ELSE promotion_id END AS promotion_id,
                  CASE WHEN product_id LIKE '%8' THEN 'no product' ELSE product_id END AS product_id) FROM dim_promotion""",
    "dim_customer": """
SELECT * REPLACE (CASE WHEN customer_id LIKE '%8' THEN NULL ELSE customer_id END AS customer_id) FROM dim_customer""",
    "fact_web_events": """
SELECT * REPLACE (CASE WHEN event_id LIKE '%9' THEN 'hover' WHEN event_id LIKE '%3' THEN NULL ELSE event_type END AS event_type,
                  CASE WHEN event_id LIKE '%4' THEN NULL ELSE event_time END AS event_time,
                  CASE WHEN event_id LIKE '%0' THEN 'EVT_0' ELSE event_id END AS event_id) FROM fact_web_events"""}.items():
    cte(f"faulty_{_t}", _sql)
oracle("q1_q8_planted_faults", _report({t: f"faulty_{t}" for t in _TABLES}))

oracle("q9_leakage", """
SELECT 'q9_forecast_split' AS "check",
       CAST(CASE WHEN max(ds) FILTER (WHERE NOT is_test) >= min(ds) FILTER (WHERE is_test) THEN 1 ELSE 0 END AS BIGINT)
         AS violations FROM panel_split
UNION ALL
SELECT 'q9_recommendation_split',
       CAST(CASE WHEN (SELECT max(event_time) FROM train) >= (SELECT min(event_time) FROM test) THEN 1 ELSE 0 END AS BIGINT)""")

oracle("d1_dated_discount_sales", f"""
SELECT s.order_id, s.customer_id, s.product_id, s.date_id, s.quantity, s.unit_price,
       coalesce(pr.discount_percentage, 0.0) AS discount,
       {RE('s.quantity * s.unit_price * (1 - coalesce(pr.discount_percentage, 0.0))')} AS revenue,
       {RE('s.quantity * dp.cost_price')} AS cost,
       {RE(RE('s.quantity * s.unit_price * (1 - coalesce(pr.discount_percentage, 0.0))') + ' - ' + RE('s.quantity * dp.cost_price'))} AS margin
FROM sales s
LEFT JOIN dim_promotion pr ON s.product_id = pr.product_id AND s.invoice_date BETWEEN pr.start_date AND pr.end_date
LEFT JOIN dim_product dp ON s.product_id = dp.product_id""")

cte("rfm_base", """
SELECT f.customer_id, f.frequency, f.monetary,
       CAST(date_diff('day', CAST(l.last_order AS DATE), (SELECT CAST(max(invoice_date) AS DATE) FROM sales)) AS INTEGER)
         AS recency
FROM (SELECT customer_id, count(DISTINCT order_id) AS frequency,
             CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS monetary
      FROM fact_sales GROUP BY customer_id) f
JOIN (SELECT customer_id, max(invoice_date) AS last_order FROM sales GROUP BY customer_id) l USING (customer_id)""")


def _score(col: str) -> str:
    q = f"(SELECT quantile_cont({col}, [0.2, 0.4, 0.6, 0.8]) FROM rfm_base)"
    return " + ".join(["1"] + [f"CAST({col} > {q}[{i}] AS INTEGER)" for i in range(1, 5)])


oracle("d2_rfm_segments", f"""
SELECT customer_id, recency, frequency, monetary, r_score, f_score, m_score,
       CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS segment
FROM (SELECT *, CAST(6 - ({_score('recency')}) AS INTEGER) AS r_score,
             CAST({_score('frequency')} AS INTEGER) AS f_score, CAST({_score('monetary')} AS INTEGER) AS m_score
      FROM rfm_base)""")

cte("product_classes", r"""
SELECT product_id, product_name,
       CASE WHEN regexp_matches(product_name, '(?i)\b(bolt|rod|plate)\b') THEN 'hardware'
            WHEN regexp_matches(product_name, '(?i)\b(gear|anvil)\b') THEN 'tools'
            WHEN regexp_matches(product_name, '(?i)\b(widget|gizmo)\b') THEN 'gadgets'
            WHEN regexp_matches(product_name, '(?i)\b(ring)\b') THEN 'jewellery' ELSE 'unknown' END AS category,
       coalesce(nullif(regexp_extract(lower(product_name), '\b(bolt|rod|plate|gear|anvil|widget|gizmo|ring)\b', 1), ''),
                'unknown') AS subcategory,
       CASE WHEN regexp_matches(product_name, '(?i)\b(acme)\b') THEN 'Acme' ELSE 'unknown' END AS brand
FROM dim_product""")
oracle("d3_product_classes", "SELECT * FROM product_classes")

oracle("d4_product_kpis", f"""
SELECT p.product_id, p.revenue, p.margin,
       {R('CASE WHEN p.revenue <> 0 THEN p.margin / p.revenue END', 6)} AS margin_rate,
       p.units, i.closing_stock AS current_stock,
       {R('CASE WHEN i.closing_stock > 0 THEN p.units / i.closing_stock END', 6)} AS stock_rotation,
       i.closing_stock > p.units / greatest(1, (SELECT count(DISTINCT date_id) FROM fact_sales)) * 90 AS overstock_risk
FROM (SELECT product_id, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
             CAST(sum(CAST(margin AS DECIMAL(18,2))) AS DOUBLE) AS margin, CAST(sum(quantity) AS BIGINT) AS units
      FROM fact_sales GROUP BY product_id) p
LEFT JOIN fact_inventory i USING (product_id)""")

oracle("d4_conversion_rate", f"""
SELECT count(*) AS sessions, CAST(sum(p) AS BIGINT) AS purchasing_sessions, {R('sum(p) / count(*)', 6)} AS conversion_rate
FROM (SELECT session_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS p
      FROM fact_web_events GROUP BY session_id)""")

oracle("d5_category_rollup", """
SELECT c.category, c.subcategory, CAST(sum(CAST(f.revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
       CAST(sum(CAST(f.margin AS DECIMAL(18,2))) AS DOUBLE) AS margin,
       CAST(grouping(c.category, c.subcategory) AS INTEGER) AS level
FROM fact_sales f JOIN product_classes c USING (product_id)
GROUP BY ROLLUP (c.category, c.subcategory)""")

oracle("k4_risk_by_product", f"""
SELECT *, CASE WHEN days_of_stock_estimated IS NULL THEN 'good'
               WHEN days_of_stock_estimated < 3 THEN 'critical'
               WHEN days_of_stock_estimated < 7 THEN 'serious'
               WHEN days_of_stock_estimated < 14 THEN 'warning' ELSE 'good' END AS risk
FROM ({_K3_EXACT})""")

oracle("d1_overlapping_promotions", f"""
SELECT s.order_id, s.product_id, s.invoice_date, s.quantity, s.unit_price, max(w.d) AS promotion_discount,
       arg_min(w.name, (-w.d, w.name)) AS promotion
FROM (SELECT row_number() OVER () AS rid, * FROM sales) s
LEFT JOIN (
  SELECT product_id, start_date + to_days(v.days) AS lo, end_date + to_days(v.days) AS hi, product_id || ':' || v.name AS name,
         {R('discount_percentage * v.times', 4)} AS d
  FROM dim_promotion, (VALUES (0, 1.0::DOUBLE, 'a'), (3, 0.5::DOUBLE, 'b'), (6, 1.2::DOUBLE, 'c')) AS v(days, times, name)) w
ON s.product_id = w.product_id AND s.invoice_date BETWEEN w.lo AND w.hi
GROUP BY s.rid, s.order_id, s.product_id, s.invoice_date, s.quantity, s.unit_price""")

oracle("k1_monthly_from_daily_sketches", """
SELECT date_id // 100 AS year_month, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity, true AS order_id_within,
       true AS product_id_within
FROM fact_sales GROUP BY 1""")
