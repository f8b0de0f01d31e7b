"""Goldens of reply formats, question kinds and file texts, written down from the formats themselves."""

import pytest
from latticework.functions import text as T
from latticework.operators import environment as E
from latticework.operators import graph as G
from latticework.operators import retrieval as R
from latticework.sources import readers as S
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


REPLY = "hm <observation> a chart </observation>\n<think>go\nthere</think> <answer>MOVE Paris, Stop ,, x, y</answer>\n<prediction>it ends</prediction>"


def test_world_model(spark):
    r = one(spark, T.world_model(F.lit(REPLY)))
    assert r.asDict() == {"observation": "a chart", "think": "go\nthere", "answer": "move paris,stop,x", "prediction": "it ends", "actions": ["move paris", "stop", "x"], "format_correct": True}
    few = one(spark, T.world_model(F.lit(REPLY.replace(",, x, y", ""))))
    assert few.answer == "MOVE Paris, Stop" and few.actions == ["move paris", "stop"]


@pytest.mark.parametrize("text", [None, "", REPLY.replace("think>", "reasoning>"), REPLY.replace("<observation> a chart </observation>", ""), "<answer>x</answer>"])
def test_world_model_of_other_formats(spark, text):
    r = one(spark, T.world_model(F.lit(text).cast("string")))
    assert r.asDict() == {"observation": "", "think": "", "answer": "", "prediction": "", "actions": [], "format_correct": False}


@pytest.mark.parametrize("text,want", [("MOVE 2", ("MOVE", "2", 2)), ("Edge_Search  A  b ", ("Edge_Search", "A  b", None)), ("\tSTOP", ("STOP", None, None)), ("move(3)", ("move(3)", None, None)), ("MOVE 99999999999", ("MOVE", "99999999999", None)), ("  ", (None, None, None))])
def test_action_parts(spark, text, want):
    assert tuple(one(spark, T.action_parts(F.lit(text)))) == want


@pytest.mark.parametrize("kind,want", [("FactCheck", "FactCheck"), ("Manipulation", "Manipulation"), ("Comparison", "Comparison"), ("Trend", "Trend"), ("Analysis", "Analysis"), ("Causal", "Comparison"), ("Ranking", "Comparison"), (None, "Comparison")])
def test_kinds_of_questions(spark, kind, want):
    strings = lambda *xs: F.array(*map(F.lit, xs))
    index = F.create_map(F.lit("chart_1"), F.lit(1))
    r = one(spark, G.validated_answer(F.lit(kind).cast("string"), strings("b", "zz", "a", "b"), strings("a", "b"), strings("chart_1", "chart_2", None), index))
    assert r.kind == want and r.evidence == ["b", "a", "b"] and [tuple(x) for x in r.charts] == [("chart_1", 1)]
    assert one(spark, G.validated_answer(F.lit("Trend"), F.lit(None).cast("array<string>"), strings("a", "b"))).evidence == ["a", "b"]


@pytest.mark.parametrize("text,want", [('{"a": "one", "b": 2, "c": null, "d": "two", "e": ["x"]}', "one\ntwo"), ('[1, "x", {"y": "z"}, "w", null]', "x\nw"), ('"alone"', "alone"), ("{broken", "{broken"), ("plain", "plain"), ("{}", ""), (None, None)])
def test_json_text(spark, text, want):
    assert one(spark, S.json_text(F.lit(text).cast("string"))) == want


def test_file_kinds(spark):
    rows = spark.createDataFrame([("a.TXT",), ("b.md",), ("c.Png",), ("d.json",)], "p string").select(S.is_text(F.col("p")), S.is_image(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [(True, False), (False, False), (False, True), (False, False)]


def test_observation_lists_every_relation(spark):
    edges = spark.createDataFrame([("hub", f"n{i:03d}", f"k{i}", "c", "horizontal") for i in range(130)], "cur string, next string, key string, source string, move string")
    names = spark.createDataFrame([(f"n{i:03d}", f"name {i:03d}") for i in range(130)], "id string, name string")
    assert len(E.observation(edges, names).first().relations) == 130
    assert [x.neighbour for x in E.observation(edges, names, most=2).first().relations] == ["name 000", "name 001"]


def test_unknown_levels_stand_in_the_last_layer(spark):
    df = spark.createDataFrame([(0,), (3,), (4,), (-1,), (None,)], "level int")
    assert [r[0] for r in df.select(R.layer_of(F.col("level"), 3)).collect()] == [0, 3, 3, 3, 3]
