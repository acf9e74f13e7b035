"""Oracle SQL for the streaming queries: what the watermark, one hour behind the last event, has closed."""
from shelfwise.plans.oracle import oracle

oracle("t1_stream_sessions", """
SELECT visitor_id, min(event_time) AS session_start, max(event_time) + INTERVAL 30 MINUTE AS session_end,
       count(*) AS n_events
FROM (SELECT *, sum(brk) OVER (PARTITION BY visitor_id ORDER BY event_time, item_id, event_type
                               ROWS UNBOUNDED PRECEDING) AS s
      FROM (SELECT *, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY visitor_id
                                   ORDER BY event_time, item_id, event_type) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk
            FROM mapped_events))
GROUP BY visitor_id, s
HAVING max(event_time) + INTERVAL 30 MINUTE <= (SELECT max(event_time) - INTERVAL 1 HOUR FROM mapped_events)""")

oracle("t2_stream_hourly_counts", """
SELECT date_trunc('hour', event_time) AS hour, event_type, count(*) AS n FROM mapped_events
GROUP BY 1, 2
HAVING date_trunc('hour', any_value(event_time)) + INTERVAL 1 HOUR <= (SELECT max(event_time) - INTERVAL 1 HOUR FROM mapped_events)""")

oracle("t1_stream_session_numbers", """
SELECT visitor_id, visitor_id || '_S' || CAST(s AS VARCHAR) AS session_id, min(event_time) AS first_event,
       max(event_time) AS last_event, count(*) AS n_events
FROM (SELECT *, CAST(sum(brk) OVER (PARTITION BY visitor_id ORDER BY event_time, item_id, event_type
                                    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s
      FROM (SELECT *, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY visitor_id
                                   ORDER BY event_time, item_id, event_type) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk
            FROM mapped_events))
GROUP BY visitor_id, s
HAVING max(event_time) + INTERVAL 30 MINUTE < (SELECT max(event_time) - INTERVAL 1 HOUR FROM mapped_events)""")
