"""Goldens of the graders."""

import math

import pytest
from latticework.functions import grading as N
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [
    ("x = 5", "5"), ("1,234", "1234"), ("\\frac12", "\\frac{1}{2}"), ("\\sqrt5", "\\sqrt{5}"), ("$\\text{east}$", "east"), ("12 \\text{ cm}", "12"), ("90^\\circ", "90"),
    ("a big dog", "bigdog"), ("\\boxed{7}", "7"), ("5 dollars", "5"), ("", ""), (None, None), ("2,3", "23"), ("(2,3)", "(2,3)"),
])
def test_final_answer_normal(spark, text, want):
    assert one(spark, N.final_answer_normal(F.lit(text).cast("string"))) == want


def test_final_answer_score(spark):
    score = lambda t, g, **kw: tuple(one(spark, N.final_answer_score(F.lit(t).cast("string"), F.lit(g), **kw)))
    assert score("Answer: 3\nfinal answer:  x=4 cm\n", "4") == (1.0, True, "4")
    assert score("Answer: 4" + "\n" * 300, "4") == (-1.0, False, "[INVALID]")
    assert score(None, "4")[:2] == (-1.0, False)
    assert score("so \\boxed{4}", "4", strict=True) == (1.0, True, "4")
    assert score("so \\boxed{4 }", "4", strict=True) == (-1.0, False, "4 ")
    assert score("\\boxed{4}" + "." * 100, "4", strict=True) == (-1.0, False, None)
    assert score(None, "4", strict=True) == (-1.0, False, None)


@pytest.mark.parametrize("a,b,same", [
    ("(1, 2)", "(1,2)", True), ("[1,2)", "(1,2)", False), ("(1,2,3)", "(1,2)", False), ("1,000", "1000", True), ("2 million", "2000000", False), ("2.5 million", "2.5*10^6", True),
    ("7 3/4", "7.75", True), ("\\frac{1}{2}", "1/2", True), ("2/4", "1/2", False), ("0.50", "0.5", True), ("5", "5.0", True), ("5", "5.1", False), ("\\text{North}", "north", True),
    ("12 inches", "12", True), ("(-\\infty, 3]", "(-\\infty,3]", True), (None, "1", False), ("1", None, False), ("", "", False), ("(1.0, 2.50)", "(1, 2.5)", True),
])
def test_tuples_intervals_and_numbers(a, b, same):
    assert N.same_answer(a, b) is same


@pytest.mark.parametrize("reply,want", [
    ('<think>t</think> [{"point_2d": [5, 5]}]', (2.0, 1.0, 1.0, 1, 1, 1, 1, 0)),
    ('<think>t</think> [{"point_2d": [50, 5]}, {"point_2d": [5, 5]}]', (1 + 0.5, 1.0, 0.5, 2, 1, 0, 0, 0)),
    ('<think>t</think> [{"point_2d": [50, 5]}, {"point_2d": [51, 9]}]', (0.5, 1.0, -0.5, 2, 0, 0, 0, 0)),
    ('<think>t</think> [{"point_2d": [1, 1]}, {"point_2d": [2, 2]}, {"point_2d": [3, 3]}]', (-1.0, 0.0, -1.0, 0, 0, 0, 0, 1)),
    ('<think>t</think> []', (0.0, 1.0, -1.0, 0, 0, 0, 0, 0)),
    ('[{"point_2d": [5, 5]}]', (-1.0, 0.0, -1.0, 0, 0, 0, 0, 0)), ("<think>t</think>", (-1.0, 0.0, -1.0, 0, 0, 0, 0, 0)), ('<think>t</think> [{"p": 1}]', (-1.0, 0.0, -1.0, 0, 0, 0, 0, 0)),
    ('<think> </think> [{"point_2d": [5, 5]}]', (-1.0, 0.0, -1.0, 0, 0, 0, 0, 0)), (None, (-1.0, 0.0, -1.0, 0, 0, 0, 0, 0)),
])
def test_pointing(spark, reply, want):
    got = one(spark, N.pointing_reward(F.lit(reply).cast("string"), F.array(*map(F.lit, (0.0, 0.0, 10.0, 10.0)))))
    assert all(math.isclose(x, y) for x, y in zip(got, want, strict=True))


def test_open_math_knows_its_sources(spark):
    assert one(spark, N.open_math_score(F.lit("aime24"), F.lit("\\boxed{7}"), F.lit("7"))) == 1.0
    with pytest.raises(Exception, match="no rule"):
        one(spark, N.open_math_score(F.lit("other"), F.lit("\\boxed{7}"), F.lit("7")))
