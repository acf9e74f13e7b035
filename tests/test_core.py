"""Core helpers, cleaning, sessions, warehouse quality and the driver
contract on the smallest supplied data."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_round_half_up(spark):
    from shelfwise.functions.numeric import round_half_up
    r = spark.createDataFrame([(2.5,), (0.125,), (-1.5,)], "x double").select(
        round_half_up("x", 0).alias("a"), round_half_up("x", 2).alias("b")).collect()
    assert [x["a"] for x in r] == [3.0, 0.0, -1.0]


def test_hash_draws_are_reproducible_and_bounded(spark):
    from shelfwise.functions.numeric import hash_uniform, round_half_up
    df = spark.range(500).select(hash_uniform("id", tag="cost").alias("u"))
    a = [r["u"] for r in df.collect()]
    b = [r["u"] for r in df.repartition(7).orderBy(F.rand(1)).collect()]
    assert sorted(a) == sorted(b)
    assert all(0 <= u < 1 for u in a)
    cost = spark.range(200).select(round_half_up(F.lit(50.0) * (1 - (0.15 + 0.3 * hash_uniform("id", tag="c"))), 2)
                                   .alias("c"))
    assert all(0 < r["c"] < 50.0 for r in cost.collect())


def test_dense_position_equals_row_number(spark):
    from shelfwise.functions.positions import dense_position
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).cast("string").alias("k"))
    got = dense_position(df, ["k"], num_partitions=5).select("k", "position")
    want = df.select("k", (F.row_number().over(Window.orderBy("k")) - 1).alias("position"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_exact_quantiles_match_numpy(spark):
    from shelfwise.functions.positions import exact_quantiles
    vals = np.random.default_rng(3).normal(size=101).tolist() + [5.0, 5.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = exact_quantiles(df, "v", [0.2, 0.5, 0.8]).first()
    for i, q in enumerate([0.2, 0.5, 0.8]):
        assert r[f"q{i}"] == pytest.approx(np.quantile(vals, q))


def test_cleaning_rules(spark):
    from shelfwise.operators.clean import clean_sales, cleaning_report
    ts = dt.datetime(2024, 1, 2, 10)
    rows = [("1", "P1", "x", 2, ts, 1.0, 7.0, "FR"), ("1", "P1", "x", 2, ts, 1.0, 7.0, "FR"),
            ("C2", "P1", "x", 1, ts, 1.0, 7.0, "FR"), ("3", "P1", "x", 0, ts, 1.0, 7.0, "FR"),
            ("4", "P1", "x", 1, ts, -1.0, 7.0, "FR"), ("5", "P1", "x", 1, ts, 1.0, None, "FR")]
    raw = spark.createDataFrame(rows, "InvoiceNo string, StockCode string, Description string, Quantity int, "
                                      "InvoiceDate timestamp, UnitPrice double, CustomerID double, Country string")
    out = clean_sales(raw).collect()
    assert len(out) == 1 and out[0]["customer_id"] == "CUST_7" and out[0]["date_id"] == 20240102
    rep = cleaning_report(raw).first()
    assert (rep["cancelled"], rep["bad_quantity"], rep["bad_price"], rep["null_customer"], rep["duplicates"],
            rep["rows_kept"]) == (1, 1, 1, 1, 1, 1)


def test_sessions_gap_is_strict_and_crosses_buckets(spark):
    from shelfwise.operators.events import sessionize
    t0 = dt.datetime(2024, 1, 1, 23, 50)
    times = [t0, t0 + dt.timedelta(minutes=20), t0 + dt.timedelta(minutes=50),   # crosses midnight, same session
             t0 + dt.timedelta(minutes=81), t0 + dt.timedelta(minutes=111, seconds=1)]
    rows = [("V", f"I{i}", "view", t) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "visitor_id string, item_id string, event_type string, event_time timestamp")
    out = [r["session_seq"] for r in sessionize(df, bucket_hours=1).orderBy("event_time").collect()]
    assert out == [0, 0, 0, 1, 2]


def test_latest_property_wins(spark):
    from shelfwise.operators.events import latest_item_property
    props = spark.createDataFrame([(1, 10, "categoryid", "a"), (2, 10, "categoryid", "b"),
                                   (3, 10, "available", "1"), (1, 11, "categoryid", "c")],
                                  "timestamp long, itemid long, property string, value string")
    wanted = spark.createDataFrame([("10",)], "item_id string")
    assert [tuple(r) for r in latest_item_property(props, wanted).collect()] == [("10", "b")]


def test_warehouse_quality_is_clean(spark):
    from shelfwise.operators.quality import quality_report
    from shelfwise.plans.warehouse import Warehouse
    wh = Warehouse(spark, SF_SMALL, reuse=True)
    bad = quality_report(wh.star, wh.web_events).where("violations <> 0").collect()
    assert bad == []


def test_entry_and_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "recommended_price" in df.columns
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 84


def test_planted_faults_stop_the_load(spark, tmp_path):
    from shelfwise.operators.quality import quality_report
    from shelfwise.plans.warehouse import Warehouse
    from shelfwise.sources import sinks
    tables = dict(Warehouse(spark, SF_SMALL, reuse=True).star)
    tables["fact_sales"] = tables["fact_sales"].withColumn("quantity", F.when(F.col("date_id") % 2 == 0, F.col("quantity")))
    report = quality_report(tables)
    broken = {r["check"] for r in report.where("violations > 0").collect()}
    assert broken == {"q2_sales_ranges", "q3_revenue_margin"}  # a NULL is a broken rule
    with pytest.raises(ValueError, match="q2_sales_ranges"):
        sinks.load_warehouse(tables, str(tmp_path / "lake"), report)
    with pytest.raises(RuntimeError):
        sinks.check_lake(spark, str(tmp_path))


def test_building_a_lazy_table_runs_no_job(spark, monkeypatch):
    from shelfwise.plans.catalog import queries
    from shelfwise.sources import adapters
    # opening a Parquet file runs a job for its schema, so the tables are opened before
    tables = {name: adapters.table(spark, SF_SMALL, name) for name in adapters.TABLES}
    monkeypatch.setattr(adapters, "table", lambda spark, sf_dir, name: tables[name])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "building only")
    try:
        for name in ("b1_dim_customer", "b3_dim_date", "c12_product_search", "k2_catalogue_counts", "d3_product_classes",
                     "c11_interactions", "b2_dim_product"):
            queries()[name](spark, SF_SMALL)
        assert not tracker.getJobIdsForGroup("lazy")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_quantiles_of_a_column_that_is_nearly_constant(spark):
    from shelfwise.functions.positions import exact_quantiles_of, value_ranks
    values = [7.0] * 9000 + [float(i) for i in range(1000)] + [None] * 10
    df = spark.createDataFrame([(v, -v if v is not None else None) for v in values], "a double, b double").repartition(6)
    got = exact_quantiles_of(df, ["a", "b"], [0.0, 0.05, 0.5, 0.97, 1.0]).first()
    clean = [v for v in values if v is not None]
    assert list(got["a"]) == pytest.approx(list(np.quantile(clean, [0, .05, .5, .97, 1])))
    assert list(got["b"]) == pytest.approx(list(np.quantile([-v for v in clean], [0, .05, .5, .97, 1])))
    assert value_ranks(df, ["a"]).count() == 1000  # a row per distinct value, however many share it


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from shelfwise import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return spark.sparkContext.getConf()

    class Session:
        sparkContext = Context()
        conf = spark.conf
    if spark.conf.get("spark.checkpoint.dir", None):
        pytest.skip("a folder is configured")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_readers_join_header_spellings_and_files(spark, tmp_path):
    from shelfwise.operators.clean import clean_sales
    from shelfwise.sources import readers
    (tmp_path / "new.csv").write_text("Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
                                      "9,K1,kettle,2,2024-02-03 10:00:00,4.5,17,France\n")
    (tmp_path / "old.csv").write_text("InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
                                      "8,K1,kettle,1,2024-02-01 09:00:00,4.0,17,France\nC8,K1,kettle,1,2024-02-01 09:00:00,4.0,17,France\n")
    kinds = "{} string, StockCode string, Description string, Quantity int, InvoiceDate timestamp, {} double, {} double, Country string"
    schemas = [spark.createDataFrame([], kinds.format(*names)).schema
               for names in (("Invoice", "Price", "`Customer ID`"), ("InvoiceNo", "UnitPrice", "CustomerID"))]
    raw = readers.read_raw_sales(spark, [str(tmp_path / "new.csv"), str(tmp_path / "old.csv")], schema=schemas)
    assert sorted(r["order_id"] for r in clean_sales(raw).collect()) == ["8", "9"]
    with pytest.raises(ValueError):
        readers.read_raw_sales(spark, [str(tmp_path / "new.csv")])
    for k, line in enumerate(("1,5,categoryid,a", "2,5,categoryid,b\n3,5,available,1")):
        (tmp_path / f"props{k}.csv").write_text(f"timestamp,itemid,property,value\n{line}\n")
    props = readers.read_item_properties(spark, [str(tmp_path / f"props{k}.csv") for k in (0, 1)])
    assert sorted(r["value"] for r in props.collect()) == ["a", "b"]
    (tmp_path / "clicks.csv").write_text("timestamp,visitorid,event,itemid,transactionid\n1500,3,view,4,\n")
    row = readers.read_clickstream(spark, str(tmp_path / "clicks.csv")).first()
    assert (row["visitorid"], row["transactionid"], row["event_time"].microsecond) == (3, None, 500000)


def test_streams_drop_late_rows_and_close_with_the_watermark(spark, tmp_path):
    from shelfwise.streaming import sessions as st
    schema = "visitor_id string, item_id string, event_type string, event_time timestamp"
    t0 = dt.datetime(2024, 3, 1, 8)

    def write(no, rows):
        table = spark.createDataFrame([(v, "i", "view", t0 + dt.timedelta(minutes=m)) for v, m in rows], schema)
        table.coalesce(1).write.parquet(str(tmp_path / f"in/{no}"))
    write(1, [("a", 0), ("a", 20), ("b", 5), ("z", 400)])  # the watermark goes to minute 340
    write(2, [("z", 401)])                                 # and holds for late rows from the next file on
    write(3, [("a", 30), ("c", 350), ("z", 900)])          # a is late by now; c is not
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true") \
        .parquet(str(tmp_path / "in"))
    got = {(r["visitor_id"], r["n_events"]) for r in st.run_to_files(st.stream_sessions(events), "late").collect()}
    assert got == {("a", 2), ("b", 1), ("c", 1), ("z", 2)}  # the last session of z is still open


def test_sinks_roundtrip(spark, tmp_path):
    from shelfwise.plans.warehouse import Warehouse
    from shelfwise.sources import sinks
    wh = Warehouse(spark, SF_SMALL)
    base = str(tmp_path / "lake")
    sinks.write_table(sinks.raw_layer(wh.raw_sales), base, "raw", "orders")
    paths = sinks.load_warehouse({"dim_product": wh.dim_product, "fact_sales": wh.fact_sales}, base, None)
    assert spark.read.parquet(paths["fact_sales"]).count() == wh.fact_sales.count()
    assert dict(spark.read.parquet(paths["dim_product"]).dtypes)["cost_price"] == "decimal(12,2)"
    assert sinks.check_lake(spark, base).first()["objects"] > 0


def _executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_products_read_the_lines_once(spark):
    """First names, last prices and medians share one shuffled set of lines, also where no table is small enough to be sent."""
    from shelfwise.plans.catalog import queries
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _executed(queries()["b2_dim_product"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("lineitem.parquet" in line for line in plan.splitlines()) == 1


def test_products_without_a_price_or_an_id(spark):
    from shelfwise.operators.star import build_dim_product, grouped_median
    at = dt.datetime(2022, 1, 1)
    rows = [("a", "n", None, at, "1"), (None, "x", 2.0, at, "1"), (None, "x", 3.0, at, "2"), ("b", "m", 4.0, at, "1")]
    sales = spark.createDataFrame(rows, "product_id string, product_name string, unit_price double, invoice_date timestamp, order_id string")
    got = {r["product_id"]: r["base_price"] for r in build_dim_product(sales).collect()}
    assert got == {"a": None, None: 2.5, "b": 4.0}
    assert {r["product_id"]: r["m"] for r in grouped_median(sales, "product_id", "unit_price", "m").collect()} == got


def test_shared_tables_are_columns_on_disk(spark):
    """A table that is read several times is written as files whose columns can be taken singly, with the same rows."""
    from shelfwise.plans.warehouse import Warehouse
    sales = Warehouse(spark, SF_SMALL, reuse=True).sales
    assert sales.inputFiles() and all(f.endswith(".parquet") for f in sales.inputFiles())
    plain = Warehouse(spark, SF_SMALL).sales
    assert sales.columns == plain.columns and sales.count() == plain.count() and not sales.exceptAll(plain).count()
