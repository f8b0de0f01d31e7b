"""Moves by number and at random, judged answers and turn records."""

from latticework.operators import environment as E

EDGES = [("a", "b", "s1"), ("a", "c", None), ("b", "d", "s2"), ("c", "d", "s3")]


def replay(spark, actions, gold, answer=None, steps=4):
    rows = [("e", k, *x) for k, x in enumerate(actions)]
    acts = spark.createDataFrame(rows, "episode string, step int, action string, arg string, number int")
    tasks = spark.createDataFrame([("e", ["A"], gold, answer)], "episode string, candidates array<string>, gold array<string>, answer string")
    edges = spark.createDataFrame(EDGES, "cur string, next string, source string")
    names = spark.createDataFrame([(x, x.upper()) for x in "abcd"], "id string, name string")
    return [r.asDict() for r in E.replay(acts, tasks, edges, names, steps).orderBy("step").collect()]


def test_moves_by_number_and_at_random(spark):
    log = replay(spark, [("START", "A", None), ("MOVE", None, 3), ("MOVE", None, None), ("MOVE", None, 5)], ["s9"])
    assert [r["current"] for r in log] == ["a", "c", "d", "d"]  # 3 modulo two neighbours is the second; from c there is one
    assert [r["executed"] for r in log] == [True, True, True, False] and log[3]["reward"] == E.ILLEGAL


def test_answers_are_judged_once_all_is_revealed(spark):
    right = replay(spark, [("START", "A", None), ("MOVE", "B", None), ("STOP", "the Answer!", None), ("MOVE", "D", None)], ["s1"], "answer")
    assert [r["answered"] for r in right] == [False, False, True, False]
    assert right[2]["reward"] == E.STEP + 2 * E.SUCCESS and not right[3]["executed"]
    early = replay(spark, [("START", "A", None), ("STOP", "answer", None)], ["s1"], "answer", 2)
    assert not early[1]["answered"] and early[1]["reward"] == E.STEP
    assert not replay(spark, [("START", "A", None), ("STOP", None, None)], ["s1"], "answer", 2)[1]["executed"]


def test_turn_record(spark):
    whole = "<observation>o</observation><think>t</think><answer>START A</answer><prediction>p</prediction>"
    replies = spark.createDataFrame([("e", 0, whole), ("e", 1, "MOVE B"), ("e", 2, whole.replace("START A", "STOP x")), ("f", 0, whole)], "episode string, step int, reply string")
    log = spark.createDataFrame([("e", 0, "START", True, 0.0), ("e", 1, "MOVE", False, -1.0), ("e", 2, "STOP", True, 5.0)], "episode string, step int, action string, executed boolean, reward double")
    got = {(r.episode, r.step): tuple(r)[2:] for r in E.turn_record(replies, log, 9, 1000).collect()}
    assert got == {
        ("e", 0): (True, True, True, 0.5, False, False), ("e", 1): (False, False, False, -1.0, False, False),
        ("e", 2): (True, True, True, 5.5, True, True), ("f", 0): (False, False, False, 0.0, True, True),
    }
    assert {r.last for r in E.turn_record(replies, log, 1, 1000).collect()} == {True}
