"""Registered recommendation queries (R1-R16). Evaluation runs over every
visitor present in train and test (no sampling)."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from shelfwise.functions.numeric import round_half_up
from shelfwise.operators import events, kpi
from shelfwise.operators import recommend as rec
from shelfwise.plans.catalog import register
from shelfwise.plans.warehouse import Warehouse
from shelfwise.session import materialize


class Recsys:
    """The recommendation plan of one data folder; the split, the matrix and the lists are each written once."""

    def __init__(self, spark, sf_dir):
        self.wh = Warehouse(spark, sf_dir, reuse=True)

    @cached_property
    def interactions(self):
        return materialize(self.wh.interactions)

    @cached_property
    def split(self):
        # written once: every branch starts from it
        marked = materialize(rec.temporal_split(self.interactions))
        return marked.where(~F.col("is_test")).drop("is_test"), marked.where(F.col("is_test")).drop("is_test")

    @property
    def train(self):
        return self.split[0]

    @property
    def test(self):
        return self.split[1]

    @cached_property
    def visitors(self):
        return rec.evaluation_visitors(self.train, self.test)

    @cached_property
    def popular(self):
        return rec.most_popular(self.train)

    @cached_property
    def popular_recs(self):
        return rec.recommend_popular(self.visitors, self.train, self.popular)

    @cached_property
    def content_recs(self):
        return materialize(rec.recommend_content(self.train, self.item_categories, self.visitors))

    @cached_property
    def item_categories(self):
        wanted = self.interactions.select("item_id").distinct()
        return materialize(events.latest_item_property(self.wh.item_properties, wanted))

    @cached_property
    def fused_recs(self):
        """R12 on the two lists that need no factors: content and popular."""
        return materialize(rec.reciprocal_rank_fusion([self.content_recs, self.popular_recs]))

    @cached_property
    def matrix(self):
        return materialize(rec.interaction_matrix(self.train))

    @cached_property
    def factors(self):
        return rec.truncated_svd(self.matrix)

    @cached_property
    def collab_recs(self):
        vf, itf = self.factors
        eval_ix = vf.join(self.matrix.select("visitor_id", "visitor_ix").distinct()
                          .join(self.visitors, "visitor_id", "left_semi"), "visitor_ix", "left_semi")
        cands = rec.exact_top_k_inner_product(eval_ix, itf, k=rec.CANDIDATE_POOL)
        return materialize(rec.recommend_collaborative(cands, self.matrix, self.train))

    @cached_property
    def hybrid_recs(self):
        return rec.reciprocal_rank_fusion([self.content_recs, self.collab_recs])


def _r6(df, *cols):
    return df.withColumns({c: round_half_up(c, 6) for c in cols})


@register("r1_split_summary")
def q_split(spark, sf_dir):
    marked = rec.temporal_split(Warehouse(spark, sf_dir).interactions)
    return marked.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.min("event_time").alias("first_time"),
                                         F.max("event_time").alias("last_time"))


@register("r2_most_popular")
def q_popular(spark, sf_dir):
    return Recsys(spark, sf_dir).popular


@register("r3_popular_recs")
def q_popular_recs(spark, sf_dir):
    return Recsys(spark, sf_dir).popular_recs


@register("r4_category_popularity")
def q_cat_pop(spark, sf_dir):
    r = Recsys(spark, sf_dir)
    return rec.category_item_popularity(r.train, r.item_categories)


@register("r5_category_top_items")
def q_cat_top(spark, sf_dir):
    r = Recsys(spark, sf_dir)
    return rec.top_items_per_category(rec.category_item_popularity(r.train, r.item_categories))


@register("r6_visitor_category_affinity")
def q_affinity(spark, sf_dir):
    r = Recsys(spark, sf_dir)
    return rec.visitor_category_affinity(r.train, r.item_categories)


@register("r7_content_recs")
def q_content(spark, sf_dir):
    return _r6(Recsys(spark, sf_dir).content_recs, "score")


@register("r8_interaction_matrix")
def q_matrix(spark, sf_dir):
    return Recsys(spark, sf_dir).matrix


@register("r9_svd_visitor_factors")
def q_svd(spark, sf_dir):
    """Rows of U·Σ by visitor."""
    r = Recsys(spark, sf_dir)
    vf, _ = r.factors
    return vf.join(r.matrix.select("visitor_id", "visitor_ix").distinct(), "visitor_ix").select("visitor_id", "vec")


@register("r10_embedding_search")
def q_embedding_search(spark, sf_dir):
    """Exact top-50 inner-product neighbours of every vector of the supplied
    embeddings table (the flat-index search of R10 on its own)."""
    emb = Warehouse(spark, sf_dir).table("embeddings").select("vec_id", "embedding")
    q = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    it = emb.select(F.col("vec_id").alias("neighbor_id"), F.col("embedding").alias("vec"))
    out = rec.exact_top_k_inner_product(q, it, k=50, qid="query_id", iid="neighbor_id")
    return _r6(out, "score")


@register("r11_collab_recs")
def q_collab(spark, sf_dir):
    return _r6(Recsys(spark, sf_dir).collab_recs, "score")


@register("r12_hybrid_recs")
def q_hybrid(spark, sf_dir):
    return _r6(Recsys(spark, sf_dir).hybrid_recs, "rrf_score")


def _metrics(spark, sf_dir, which):
    r = Recsys(spark, sf_dir)
    recs = getattr(r, f"{which}_recs")
    m = rec.ranking_metrics(recs, r.test, r.visitors)
    return _r6(m, "precision_at_10", "recall_at_10", "map_at_10")


@register("r13_eval_popular")
def q_eval_pop(spark, sf_dir):
    return _metrics(spark, sf_dir, "popular")


@register("r13_eval_content")
def q_eval_content(spark, sf_dir):
    return _metrics(spark, sf_dir, "content")


@register("r13_eval_collab")
def q_eval_collab(spark, sf_dir):
    return _metrics(spark, sf_dir, "collab")


@register("r13_eval_hybrid")
def q_eval_hybrid(spark, sf_dir):
    return _metrics(spark, sf_dir, "hybrid")


@register("r14_eval_visitors")
def q_eval_visitors(spark, sf_dir):
    return Recsys(spark, sf_dir).visitors


@register("r15_visitor_lookup")
def q_lookup(spark, sf_dir):
    return rec.visitor_lookup(Recsys(spark, sf_dir).hybrid_recs)


@register("r16_serve_recommendations")
def q_serve(spark, sf_dir):
    """Answers for every visitor of the raw clickstream (visitors filtered out
    by the activity rule get the popular fallback)."""
    r = Recsys(spark, sf_dir)
    requests = r.wh.clicks.select(F.col("visitorid").cast("string").alias("visitor_id"))
    return rec.serve_recommendations(requests, rec.visitor_lookup(r.hybrid_recs), r.popular)


@register("r12_fused_content_popular")
def q_fused(spark, sf_dir):
    """R12 on the content and the popular list."""
    return _r6(Recsys(spark, sf_dir).fused_recs, "rrf_score")


@register("r13_eval_fused")
def q_eval_fused(spark, sf_dir):
    return _metrics(spark, sf_dir, "fused")


@register("r15_fused_lookup")
def q_fused_lookup(spark, sf_dir):
    """R15 on the fused lists, one row per place (the lists in order)."""
    lookup = rec.visitor_lookup(Recsys(spark, sf_dir).fused_recs)
    return lookup.select("visitor_id", F.array_join("recommended_items", ",").alias("items"))


@register("r16_serve_fused")
def q_serve_fused(spark, sf_dir):
    """R16 on the fused lists, for every visitor of the raw clickstream and one that does not exist."""
    r = Recsys(spark, sf_dir)
    asked = r.wh.clicks.select(F.col("visitorid").cast("string").alias("visitor_id")).distinct()
    asked = asked.unionByName(spark.createDataFrame([("stranger",)], "visitor_id string"))
    return rec.serve_recommendations(asked, rec.visitor_lookup(r.fused_recs), r.popular)


@register("k7_sample_visitors")
def q_sample_visitors(spark, sf_dir):
    """K7: the first ten visitors that have a stored list."""
    return kpi.sample_visitor_ids(rec.visitor_lookup(Recsys(spark, sf_dir).fused_recs), n=10)
