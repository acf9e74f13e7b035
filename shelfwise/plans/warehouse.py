"""Inputs and intermediate tables of one data folder, each built once.

Every table is a property of its own: asking for one builds that one and what
it needs, and no other. With ``reuse=False`` nothing but the promotion ids (B4)
and event ids (E4) runs a job while the plan is built. With ``reuse=True``, for
queries that read an intermediate several times, the cleaned sales, the
products, the product side of the sales and the mapped events are written once
to the shared checkpoint folder (as Parquet) and read from there.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import clean, events, star
from shelfwise.session import apply_base_conf, ensure_checkpoint_dir, written
from shelfwise.sources import adapters


class Warehouse:
    def __init__(self, spark: SparkSession, sf_dir: str, reuse: bool = False):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.reuse = reuse
        apply_base_conf(spark)
        ensure_checkpoint_dir(spark)

    def _shared(self, df: DataFrame) -> DataFrame:
        return written(df, "warehouse") if self.reuse else df

    def table(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf_dir, name)

    # ---- sales side -------------------------------------------------------
    @cached_property
    def raw_sales(self) -> DataFrame:
        return adapters.raw_sales(self.spark, self.sf_dir)

    @cached_property
    def sales(self) -> DataFrame:
        return self._shared(clean.clean_sales(self.raw_sales))

    @cached_property
    def dim_customer(self) -> DataFrame:
        return star.build_dim_customer(self.sales)

    @cached_property
    def dim_product(self) -> DataFrame:
        return self._shared(star.build_dim_product(self.sales))

    @cached_property
    def dim_date(self) -> DataFrame:
        return star.build_dim_date(self.sales)

    @cached_property
    def dim_promotion(self) -> DataFrame:
        return star.build_dim_promotion(self.dim_product, self.sales)

    @cached_property
    def product_side(self) -> DataFrame:
        draws = star.promotion_draws(self.dim_product.select("product_id"), self.sales)
        return self._shared(star.product_side(self.dim_product, draws))

    @cached_property
    def fact_sales(self) -> DataFrame:
        return star.build_fact_sales(self.sales, self.product_side)

    @cached_property
    def fact_inventory(self) -> DataFrame:
        return star.build_fact_inventory(self.sales, self.dim_product)

    @cached_property
    def star(self) -> dict[str, DataFrame]:
        """All six tables."""
        return {name: getattr(self, name) for name in ("dim_customer", "dim_product", "dim_date", "dim_promotion",
                                                       "fact_sales", "fact_inventory")}

    # ---- clickstream side -------------------------------------------------
    @cached_property
    def clicks(self) -> DataFrame:
        """Raw clickstream with ``event_time`` (S2 applied to the adapter)."""
        return adapters.raw_events(self.spark, self.sf_dir).withColumn("event_time", F.timestamp_millis("timestamp"))

    @cached_property
    def item_properties(self) -> DataFrame:
        return adapters.raw_item_properties(self.spark, self.sf_dir)

    @cached_property
    def mapped_events(self) -> DataFrame:
        """What needs no session and no event id reads this; the activity rule reads it three times."""
        return self._shared(events.map_event_types(self.clicks))

    @cached_property
    def web_events(self) -> DataFrame:
        return events.build_fact_web_events(self.clicks)

    @cached_property
    def interactions(self) -> DataFrame:
        return events.load_interactions(self.mapped_events)

    @cached_property
    def item_categories(self) -> DataFrame:
        wanted = self.interactions.select("item_id").distinct()
        return events.latest_item_property(self.item_properties, wanted)
