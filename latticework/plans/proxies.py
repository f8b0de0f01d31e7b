"""Frames that stand for responses, tokens, turns and nodes on the test tables, with the same frames in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.sources.tables import table

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE = ", ".join(LINE)


def r(x: str, digits: int = 4) -> str:
    """``vec.rnd`` in SQL."""
    return f"floor(({x}) * 1e{digits}::DOUBLE + 0.5) / 1e{digits}::DOUBLE"


def responses(spark: SparkSession, d: str) -> DataFrame:
    """(g, ord, s, len, t): a response per line item, grouped by order."""
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("g"), rn.alias("ord"), F.col("l_quantity").alias("s"), (F.col("l_partkey") % 50 + 1).alias("len"),
        F.col("l_discount").alias("t"), F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("flag"),
    )


RESPONSES = f"""sc AS (SELECT l_orderkey AS g, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS INTEGER) AS ord,
    l_quantity AS s, l_partkey % 50 + 1 AS len, l_discount AS t, l_suppkey AS k, l_returnflag AS flag FROM lineitem)"""


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """(g, pos, m, r, v, old, new, ref, adv): a token per line item of an order, ``m`` its mask."""
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE)) - 1
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("g"), rn.alias("pos"), F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("m"),
        (F.col("l_extendedprice") / 10000).alias("r"), (F.col("l_quantity") / 10).alias("v"),
        (-F.col("l_discount") * 10).alias("old"), (-F.col("l_tax") * 10).alias("new"), (-(F.col("l_quantity") % 7) / 10).alias("ref"),
        ((F.col("l_partkey") % 11 - 5) / 5).alias("adv"),
    )


TOKENS = f"""tk AS (SELECT l_orderkey AS g, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) - 1 AS INTEGER) AS pos,
    CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS m, l_extendedprice / 10000 AS r, l_quantity / 10 AS v, -l_discount * 10 AS old, -l_tax * 10 AS new,
    -(l_quantity % 7) / 10 AS ref, (l_partkey % 11 - 5) / 5 AS adv FROM lineitem)"""


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """(g, r, v, m): the tokens of each order as arrays in order."""
    packed = tokens(spark, d).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("pos", "r", "v", "m"))).alias("x"))
    return packed.select("g", *[F.col("x")[c].alias(c) for c in ("r", "v", "m")])


def turns(spark: SparkSession, d: str) -> DataFrame:
    """(g, traj, turn, scores, vals, mask): a turn per event, a trajectory per user and weekday."""
    e = table(spark, d, "events", "event_id", "user_id", "ts", "value")
    rows = e.select(F.col("user_id").alias("g"), (F.col("event_id") % 7).alias("traj"), "event_id", "value")
    turn = F.row_number().over(Window.partitionBy("g", "traj").orderBy("event_id"))
    v = F.col("value") / 100
    return rows.select("g", "traj", turn.alias("turn"), F.array(v, v / 2, v / 4).alias("scores"), F.array(v / 3, v / 5, v / 7).alias("vals"),
                       F.array(F.lit(1), (F.col("event_id") % 2).cast("int"), F.lit(0)).alias("mask"))
