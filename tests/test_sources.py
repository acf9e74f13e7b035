"""Rejected lines, warehouses published whole, joins on time, positions of equal rows."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.positions import dense_position
from shelfwise.operators import temporal
from shelfwise.sources import readers, sinks

T0 = dt.datetime(2024, 1, 1)


def test_no_line_is_lost_unseen(spark, tmp_path):
    lines = ["timestamp,visitorid,event,itemid,transactionid", "1000,1,view,5,", "oops,2,view,6,", "2000,3,view", "3000,4,view,7,8,9",
             "4000,5,addtocart,x,", "5000,6,transaction,8,77"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    rows, rejects = readers.read_clickstream_with_rejects(spark, str(tmp_path / "a.csv"))
    assert sorted(r["visitorid"] for r in rows.collect()) == [1, 6]
    assert rows.select("event").count() == rows.where("visitorid > 0").select("itemid").count() == 2  # whatever is read of them
    assert sorted(r["line"] for r in rejects.collect()) == sorted([lines[2], lines[3], lines[4], lines[5]])
    assert [r["rejected_lines"] for r in readers.reject_report(rejects).collect()] == [4]
    assert rows.first()["event_time"] == dt.datetime(1970, 1, 1, 0, 0, 1)


def test_order_lines_of_files_with_other_headers(spark, tmp_path):
    (tmp_path / "old.csv").write_text("Invoice,StockCode,Quantity,Price\n1,A,3,2.5\n2,B,three,1.0\n")
    (tmp_path / "new.csv").write_text("InvoiceNo,StockCode,Quantity,UnitPrice\n7,C,1,4.0\n8,D\n")
    types = [T.StringType(), T.StringType(), T.IntegerType(), T.DoubleType()]
    schemas = [T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])
               for names in (["Invoice", "StockCode", "Quantity", "Price"], ["InvoiceNo", "StockCode", "Quantity", "UnitPrice"])]
    rows, rejects = readers.read_raw_sales_with_rejects(spark, [str(tmp_path / "old.csv"), str(tmp_path / "new.csv")], schemas)
    assert rows.count() == 2 and sorted(r["line"] for r in rejects.collect()) == ["2,B,three,1.0", "8,D"]


def _tables(spark, n):
    product = spark.createDataFrame([(f"p{i}", f"name {i}", "cat", None, "brand", 1.0, 2.0, 3.0) for i in range(n)],
                                    "product_id string, product_name string, category string, subcategory string, brand string, "
                                    "cost_price double, base_price double, current_price double")
    customer = spark.createDataFrame([(f"c{i}", 30, "F", "Rome", T0) for i in range(n)],
                                     "customer_id string, age int, gender string, city string, registration_date timestamp")
    return {"dim_customer": customer, "dim_product": product}


def test_a_failed_load_leaves_the_version_before(spark, tmp_path):
    base = str(tmp_path / "lake")
    with pytest.raises(FileNotFoundError):
        sinks.read_warehouse(spark, base, "dim_product")
    first = sinks.publish_warehouse(_tables(spark, 3), base, None)
    assert sinks.current_version(spark, base) == first
    got = sinks.read_warehouse(spark, base, "dim_product")
    assert dict(got.dtypes)["cost_price"] == "decimal(12,2)" and {(r["category"], r["brand"]) for r in got.collect()} == {("cat", "brand")}
    broken = _tables(spark, 5)
    broken["dim_product"] = broken["dim_product"].withColumn("base_price", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sinks.publish_warehouse(broken, base, None)
    assert sinks.current_version(spark, base) == first
    assert {n: sinks.read_warehouse(spark, base, n).count() for n in _tables(spark, 1)} == {"dim_customer": 3, "dim_product": 3}
    only = {"dim_product": _tables(spark, 4)["dim_product"].drop("category", "subcategory", "brand")}
    second = sinks.publish_warehouse(only, base, None)
    assert second != first and sinks.read_warehouse(spark, base, "dim_customer").count() == 3
    assert {r["brand"] for r in sinks.read_warehouse(spark, base, "dim_product").collect()} == {None}


def test_best_window_of_a_hot_key(spark):
    rng = random.Random(4)

    def at(hours):
        return T0 + dt.timedelta(hours=hours)
    windows = [(rng.choice("ab"), at(s), at(s + rng.randrange(0, 200)), rng.choice([0.1, 0.2, 0.3]), f"w{i}")
               for i, s in enumerate(rng.randrange(0, 400) for _ in range(40))]
    rows = [(rng.choice("aaaaaaaaabc"), at(rng.randrange(0, 700)), i % 5) for i in range(500)] + [(None, at(1), 0), ("a", None, 0)]
    got = temporal.best_window(
        spark.createDataFrame(rows, "k string, t timestamp, n int"),
        spark.createDataFrame(windows, "k string, start_date timestamp, end_date timestamp, d double, w string"), "k", "t", "d", "w")
    want = []
    for k, t, n in rows:
        held = [(-d, w, d) for key, lo, hi, d, w in windows if k == key and t is not None and lo <= t <= hi]
        want.append((k, t, n, *((min(held)[2], min(held)[1]) if held else (None, None))))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_as_of_a_hot_key(spark):
    rng = random.Random(9)
    log = [(rng.choice("aaaab"), rng.randrange(0, 10_000), rng.choice("xyz")) for _ in range(300)] + [("c", 5, None), (None, 1, "n")]
    rows = [(rng.choice("aaaaaaaabc"), rng.randrange(-50, 11_000), i) for i in range(600)] + [(None, 7, -1), ("a", None, -2)]
    hour = 3_600_000_000
    got = temporal.as_of(spark.createDataFrame(rows, "k string, t long, n int"), spark.createDataFrame(log, "k string, s long, v string"),
                         "k", F.col("t") * hour, F.col("s") * hour, "v", "value", bucket_hours=500).collect()
    assert len(got) == len(rows)
    for k, t, n, value in got:
        said = [(s, v) for key, s, v in log if key == k and v is not None and t is not None and s <= t] if k else []
        assert value == (max(said)[1] if said else None), (k, t, n)


def test_rows_equal_in_all_keys_are_spread(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("k")).repartition(5)
    placed = dense_position(df, ["k"], num_partitions=8, split_ties=True)
    got = [tuple(r) for r in placed.collect()]
    assert sorted(p for _, p in got) == list(range(20_000))
    assert [k for k, _ in sorted(got, key=lambda r: r[1])] == sorted(k for k, _ in got)
    sizes = [r["n"] for r in placed.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 2 * 20_000 / 8


def test_sketches_of_days_give_those_of_longer_spans(spark):
    from shelfwise.operators import sketches

    rows = [(d, (d * 700 + i) % 5000, 1) for d in range(20) for i in range(1000)] + [(3, None, 1)]
    df = spark.createDataFrame(rows, "d int, k long, v int")
    days = sketches.daily(df, F.col("d"), ["v"], ["k"])
    assert days.count() == 20
    got = {r["part"]: r for r in sketches.rolled_up(days, F.floor(F.col("day") / 10), "part", ["v"], ["k"]).collect()}
    for part in (0, 1):
        exact = len({k for d, k, _ in rows if d // 10 == part and k is not None})
        assert abs(got[part]["k_distinct"] - exact) <= 3 * sketches.STANDARD_ERROR * exact
    assert got[0]["n"] == got[0]["v"] == 10_001 and got[1]["n"] == 10_000
