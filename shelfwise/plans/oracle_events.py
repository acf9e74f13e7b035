"""Oracle SQL for the clickstream queries."""
from shelfwise.plans.oracle import cte, oracle

cte("clicks", """
SELECT epoch_us(ts) // 1000 AS "timestamp", user_id AS visitorid,
       CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'addtocart'
                       WHEN 'purchase' THEN 'transaction' ELSE event_type END AS event,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemid,
       CASE WHEN event_type = 'purchase' THEN event_id END AS transactionid
FROM events""")

cte("mapped_events", """
SELECT CAST(visitorid AS VARCHAR) AS visitor_id, CAST(itemid AS VARCHAR) AS item_id,
       CASE event WHEN 'view' THEN 'view' WHEN 'addtocart' THEN 'add_to_cart' WHEN 'transaction' THEN 'purchase' END
         AS event_type,
       make_timestamp("timestamp" * 1000) AS event_time
FROM clicks WHERE event IN ('view', 'addtocart', 'transaction')""")

cte("fact_web_events", """
SELECT 'EVT_' || CAST(row_number() OVER (ORDER BY visitor_id, event_time, item_id, event_type) - 1 AS VARCHAR) AS event_id,
       visitor_id, item_id,
       visitor_id || '_S' || CAST(sum(brk) OVER (PARTITION BY visitor_id ORDER BY event_time, item_id, event_type
                                                 ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS session_id,
       event_type, event_time
FROM (SELECT *, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY visitor_id ORDER BY event_time, item_id, event_type)
                          > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk
      FROM mapped_events)""")

cte("interactions", """
SELECT visitor_id, item_id, event_type, event_time,
       CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'add_to_cart' THEN 3 WHEN 'purchase' THEN 5 END AS DOUBLE) AS weight
FROM fact_web_events
WHERE visitor_id IN (SELECT visitor_id FROM fact_web_events GROUP BY visitor_id HAVING count(*) >= 5)
  AND item_id IN (SELECT item_id FROM fact_web_events GROUP BY item_id HAVING count(*) >= 5)""")

cte("item_props", """
SELECT epoch_us(ts) // 1000 AS "timestamp", itemid,
       CASE WHEN event_id % 3 <> 0 THEN 'categoryid' ELSE 'available' END AS property,
       CAST(CASE WHEN event_id % 3 <> 0 THEN (itemid * 7 + weekofyear(ts)) % 20 ELSE event_id % 2 END AS VARCHAR) AS value
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemid FROM events)""")

cte("item_categories", """
SELECT CAST(itemid AS VARCHAR) AS item_id, arg_max(value, ("timestamp", value)) AS category_id
FROM item_props
WHERE property = 'categoryid' AND itemid IN (SELECT CAST(item_id AS BIGINT) FROM interactions)
GROUP BY itemid""")

oracle("c9_mapped_events", "SELECT * FROM mapped_events")
oracle("e4_fact_web_events", "SELECT * FROM fact_web_events")
oracle("e3_sessions", """
SELECT visitor_id, session_id, count(*) AS n_events, min(event_time) AS session_start, max(event_time) AS session_end
FROM fact_web_events GROUP BY visitor_id, session_id""")
oracle("e5_event_type_counts", "SELECT event_type, count(*) AS n FROM fact_web_events GROUP BY event_type")
oracle("e6_item_categories", "SELECT * FROM item_categories")
oracle("c11_interactions", "SELECT * FROM interactions")

oracle("e6_category_as_of", """
SELECT e.visitor_id, e.item_id, e.event_type, e.event_time, p.value AS category_id
FROM mapped_events e ASOF LEFT JOIN (
  SELECT CAST(itemid AS VARCHAR) AS item_id, make_timestamp("timestamp" * 1000) AS said_at, max(value) AS value
  FROM item_props WHERE property = 'categoryid' GROUP BY itemid, "timestamp") p
ON e.item_id = p.item_id AND e.event_time >= p.said_at""")

oracle("c11_interactions_strict", """
SELECT visitor_id, item_id, event_type, event_time,
       CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'add_to_cart' THEN 3 WHEN 'purchase' THEN 5 END AS DOUBLE) AS weight
FROM mapped_events
WHERE visitor_id IN (SELECT visitor_id FROM mapped_events GROUP BY visitor_id HAVING count(*) >= 40)
  AND item_id IN (SELECT item_id FROM mapped_events GROUP BY item_id HAVING count(*) >= 60)""")
