"""Oracle SQL for the recommendation queries (brute force is fine here)."""
from shelfwise.plans.oracle import R, cte, oracle

cte("split_cut", "SELECT quantile_cont(CAST(epoch_us(event_time) AS DOUBLE), 0.8) AS cut FROM interactions")
cte("train", "SELECT * FROM interactions WHERE epoch_us(event_time) < (SELECT cut FROM split_cut)")
cte("test", "SELECT * FROM interactions WHERE epoch_us(event_time) >= (SELECT cut FROM split_cut)")
cte("eval_visitors", "SELECT visitor_id FROM train INTERSECT SELECT visitor_id FROM test")
cte("popular", """
SELECT item_id, score, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INTEGER) AS rank
FROM (SELECT item_id, sum(weight) AS score FROM train GROUP BY item_id)
QUALIFY rank <= 200""")
cte("popular_recs", """
SELECT visitor_id, CAST(r AS INTEGER) AS rank, item_id FROM (
  SELECT v.visitor_id, p.item_id, row_number() OVER (PARTITION BY v.visitor_id ORDER BY p.rank) AS r
  FROM eval_visitors v, popular p
  WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.visitor_id = v.visitor_id AND t.item_id = p.item_id))
WHERE r <= 10""")
cte("cat_pop", """
SELECT c.item_id, c.category_id, coalesce(w.w, 0.01) AS weight
FROM item_categories c LEFT JOIN (SELECT item_id, sum(weight) AS w FROM train GROUP BY item_id) w USING (item_id)""")
cte("cat_top", """
SELECT item_id, category_id, weight,
       CAST(row_number() OVER (PARTITION BY category_id ORDER BY weight DESC, item_id) AS INTEGER) AS rank
FROM cat_pop QUALIFY rank <= 50""")
cte("affinity", """
SELECT t.visitor_id, c.category_id, sum(t.weight) AS affinity
FROM train t JOIN item_categories c USING (item_id) GROUP BY t.visitor_id, c.category_id""")
cte("content_recs", """
SELECT visitor_id, item_id, score,
       CAST(row_number() OVER (PARTITION BY visitor_id ORDER BY score DESC, item_id) AS INTEGER) AS rank
FROM (SELECT a.visitor_id, ct.item_id, sum(a.affinity * ct.weight) AS score
      FROM affinity a JOIN cat_top ct USING (category_id)
      WHERE a.visitor_id IN (SELECT visitor_id FROM eval_visitors)
        AND NOT EXISTS (SELECT 1 FROM train t WHERE t.visitor_id = a.visitor_id AND t.item_id = ct.item_id)
      GROUP BY a.visitor_id, ct.item_id)
QUALIFY rank <= 10""")


def _metrics(recs: str) -> str:
    return f"""
SELECT {R('avg(coalesce(h, 0) / 10.0)', 6)} AS precision_at_10,
       {R('avg(CASE WHEN nrel > 0 THEN coalesce(h, 0) / nrel ELSE 0.0 END)', 6)} AS recall_at_10,
       {R('avg(CASE WHEN nrel > 0 THEN coalesce(apn, 0.0) / least(nrel, 10) ELSE 0.0 END)', 6)} AS map_at_10,
       count(*) AS n_visitors_evaluated
FROM eval_visitors e
LEFT JOIN (SELECT visitor_id, count(*) AS nrel FROM (SELECT DISTINCT visitor_id, item_id FROM test) GROUP BY visitor_id) r
  USING (visitor_id)
LEFT JOIN (
  SELECT visitor_id, sum(hit) AS h, sum(CASE WHEN hit = 1 THEN cum / rank END) AS apn
  FROM (SELECT *, sum(hit) OVER (PARTITION BY visitor_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum
        FROM (SELECT x.visitor_id, x.rank,
                     CASE WHEN EXISTS (SELECT 1 FROM test t WHERE t.visitor_id = x.visitor_id AND t.item_id = x.item_id)
                          THEN 1 ELSE 0 END AS hit
              FROM {recs} x WHERE x.rank <= 10))
  GROUP BY visitor_id) p USING (visitor_id)"""


oracle("r1_split_summary", """
SELECT epoch_us(event_time) >= (SELECT cut FROM split_cut) AS is_test, count(*) AS n,
       min(event_time) AS first_time, max(event_time) AS last_time
FROM interactions GROUP BY 1""")
oracle("r2_most_popular", "SELECT * FROM popular")
oracle("r3_popular_recs", "SELECT * FROM popular_recs")
oracle("r4_category_popularity", "SELECT * FROM cat_pop")
oracle("r5_category_top_items", "SELECT * FROM cat_top")
oracle("r6_visitor_category_affinity", "SELECT * FROM affinity")
oracle("r7_content_recs", f"SELECT visitor_id, rank, item_id, {R('score', 6)} AS score FROM content_recs")
oracle("r8_interaction_matrix", """
SELECT visitor_id, item_id, CAST(dense_rank() OVER (ORDER BY visitor_id) - 1 AS BIGINT) AS visitor_ix,
       CAST(dense_rank() OVER (ORDER BY item_id) - 1 AS BIGINT) AS item_ix, sum(weight) AS weight
FROM train GROUP BY visitor_id, item_id""")
oracle("r10_embedding_search", f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, {R('score', 6)} AS score FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
         list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score,
         row_number() OVER (PARTITION BY a.vec_id
                            ORDER BY list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC,
                                     b.vec_id) AS rank
  FROM embeddings a, embeddings b)
WHERE rank <= 50""")
oracle("r13_eval_popular", _metrics("popular_recs"))
oracle("r13_eval_content", _metrics("content_recs"))
oracle("r14_eval_visitors", "SELECT * FROM eval_visitors")

# ---- fusion, lookup and serving on the lists that need no factors
cte("fused_recs", """
SELECT visitor_id, item_id, rrf_score,
       CAST(row_number() OVER (PARTITION BY visitor_id ORDER BY rrf_score DESC, first_list, first_rank) AS INTEGER) AS rank
FROM (SELECT visitor_id, item_id, sum(1.0 / (60 + rank)) AS rrf_score, min(list) AS first_list,
             arg_min(rank, list) AS first_rank
      FROM (SELECT visitor_id, item_id, rank, 0 AS list FROM content_recs
            UNION ALL SELECT visitor_id, item_id, rank, 1 FROM popular_recs)
      GROUP BY visitor_id, item_id)
QUALIFY rank <= 10""")
oracle("r12_fused_content_popular", f"SELECT visitor_id, rank, item_id, {R('rrf_score', 6)} AS rrf_score FROM fused_recs")
oracle("r13_eval_fused", _metrics("fused_recs"))
oracle("r15_fused_lookup", """
SELECT visitor_id, string_agg(item_id, ',' ORDER BY rank) AS items FROM fused_recs GROUP BY visitor_id""")
oracle("r16_serve_fused", """
SELECT a.visitor_id, f.visitor_id IS NULL AS is_cold_start_fallback,
       coalesce(f.rank, p.rank) AS score_rank, coalesce(f.item_id, p.item_id) AS item_id,
       CASE WHEN f.visitor_id IS NULL THEN 'unknown visitor: most-popular fallback'
            ELSE 'hybrid recommendation (content-based + collaborative filtering)' END AS reason
FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS visitor_id FROM events UNION ALL SELECT 'stranger') a
LEFT JOIN fused_recs f USING (visitor_id)
LEFT JOIN (SELECT * FROM popular WHERE rank <= 10) p ON f.visitor_id IS NULL""")
oracle("k7_sample_visitors", "SELECT DISTINCT visitor_id FROM fused_recs ORDER BY visitor_id LIMIT 10")
