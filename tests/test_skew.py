from collections import Counter

from latticework.operators import skew
from pyspark.sql import functions as F

SCHEMA = "id string, source_id string, target_id string, layer int, created_at timestamp_ntz, attributes struct<description:string>"


def relation(spark, keys):
    return spark.createDataFrame([(str(i), k, f"t{i % 7}", i % 3, None, (None if i % 5 else "d",)) for i, k in enumerate(keys)], SCHEMA)


def test_layout_is_balanced_although_one_key_holds_a_third(spark):
    keys = ["hot"] * 3000 + [f"k{i % 500}" for i in range(6000)] + [None] * 100
    layout = skew.plan_layout(relation(spark, keys), "source_id", 8)
    assert layout.total == 9000 and set(layout.heavy) == {"hot"} and len(set(layout.heavy["hot"])) >= 6
    assert max(layout.loads) <= 1.35 * sum(layout.loads) / 8


def test_rows_land_where_the_layout_says(spark):
    df = relation(spark, ["hot"] * 900 + [f"k{i}" for i in range(300)])
    layout = skew.plan_layout(df, "source_id", 6)
    sizes = [r.n for r in skew.lay_out(df, "source_id", None, None, layout).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 6 and max(sizes) <= 1.5 * 1200 / 6


def test_profile_equals_plain_counts(spark):
    keys = ["hot"] * 400 + [f"k{i % 50}" for i in range(600)] + [None] * 37
    nodes = spark.createDataFrame([("hot", "H", 1), ("k1", "K", None)], "id string, name string, level int")
    got = {r.source_id: r for r in skew.balanced_profile(relation(spark, keys), nodes).collect()}
    assert {k: r.n_rows for k, r in got.items()} == Counter(k for k in keys if k)
    assert got["hot"].name == "H" and got["hot"].shards > 1 and got["k1"].name == "K" and got["k2"].name is None
    assert abs(got["hot"].share - 400 / 1037) < 1e-12


def test_join_keeps_every_row_once(spark):
    df = relation(spark, ["hot"] * 300 + ["b"] * 5 + ["alone", None]).withColumn("_k", F.lit("clash"))
    nodes = spark.createDataFrame([("hot", "H"), ("b", "B"), ("unused", "U")], "id string, name string")
    rows = skew.balanced_join(df, "source_id", nodes, "id").collect()
    assert Counter((r._k, r._m.name if r._m else None) for r in rows) == {("hot", "H"): 300, ("b", "B"): 5, ("alone", None): 1}
    assert len({r._l.id for r in rows}) == 306


def test_empty_relation(spark):
    nodes = spark.createDataFrame([], "id string, name string, level int")
    assert skew.balanced_profile(relation(spark, []), nodes).count() == 0
    assert skew.overloaded_keys(skew.balanced_profile(relation(spark, [None]), nodes)).count() == 0
