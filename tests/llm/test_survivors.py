import math
from datetime import datetime

import pytest
from latticework.llm import survivors
from pyspark.sql import functions as F

SCHEMA = "record_id bigint, name string, attributes struct<description:string,confidence:double>, source array<string>, updated_at timestamp_ntz, key string"


@pytest.mark.parametrize("name,key", [("Zehírehe", "zehirehe"), ("  ＺＥＨＩＲＥＨＥ;", "zehirehe"), ("Ze​hi­rehe", "zehirehe"), ("Wave 1", "wave1"), ("Wave-１", "wave1"), (None, None), (" - ", None), ("Straße", "strasse")])
def test_name_key(name, key):
    assert survivors.name_key(name) == key


@pytest.mark.parametrize("text,fine", [("It covers drivers.", True), ("“It covers drivers.”", True), ("It covers drivers!", True), ("It covers dri", False), ("It covers…", False), ("It covers...", False), ("It covers -", False), ("n/a", False), ("Unknown.", False), (" ", False), (None, False), ("Nothing is said about X in this chunk.", False), ("X: description pending", False), ("X (no details extracted)", False), ("No description is given for X.", False), ("The source text does not describe this entity.", False), ("It rose to 84.5", False)])
def test_finished_text(spark, text, fine):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(survivors.finished_text(F.col("t"))).first()[0] is fine


def rows():
    day = lambda n: datetime(2024, 1, n)
    return [
        (5, "Foo Bar", ("A text.", 0.5), ["a", " a", None, ""], day(3), "k"),
        (5, "Foo Bar", ("A text.", 0.5), ["a", " a", None, ""], day(3), "k"),
        (2, "foo-bar", ("Latest but cut", math.nan), ["a", "b"], day(9), "k"),
        (7, "FOO BÁR", ("Another.", 7.0), None, None, "k"),
        (9, "Solo", (None, None), [], day(1), "k"),
        (10, None, ("T.", 1.0), ["z"], day(1), "k"),
        (11, "Bare", None, [" "], None, "k"),
        (12, "bare", ("", math.inf), None, None, "k"),
    ]


def test_winners(spark):
    got = {tuple(r) for r in survivors.winners_long(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert got == {(2, "description", 5), (2, "confidence", 5), (2, "source", 2)}
    assert survivors.winners(spark.createDataFrame(rows(), SCHEMA)).count() == 3


def test_survivors_take_the_winning_values(spark):
    got = {r.group_id: r for r in survivors.survivors(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert got[2].description == "A text." and got[2].confidence == 0.5 and got[2].chunk_ids == ["a", "b"] and got[2].name == "foo-bar"
    assert got[11].description is None and got[11].chunk_ids is None


def test_empty_table_and_hot_group(spark):
    assert survivors.winners_long(spark.createDataFrame([], SCHEMA)).count() == 0
    many = spark.range(2000).select(
        F.col("id").alias("record_id"), F.lit("Same").alias("name"), F.struct(F.lit("T.").alias("description"), (F.col("id") / 4000).alias("confidence")).alias("attributes"),
        F.array(F.lit("c")).alias("source"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
    assert {tuple(r) for r in survivors.winners_long(many).collect()} == {(0, "description", 0), (0, "confidence", 1999), (0, "source", 0)}
