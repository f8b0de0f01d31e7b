import pytest
from latticework.operators import environment as E
from latticework.operators import plugins as P


def test_rewards_by_name_file_and_failure(spark, tmp_path):
    df = spark.createDataFrame([("A", " a "), ("b", "c"), (None, "x")], "answer string, gold string")
    assert sorted(r.reward for r in P.rewarded(df, "exact", "answer", "gold").collect()) == [0.0, 0.0, 1.0]
    (tmp_path / "r.py").write_text("def score(answers, golds):\n    return [len(a) / 2 for a in answers]\n")
    got = {r.answer: r.reward for r in P.rewarded(df, P.function_from_file(str(tmp_path / "r.py"), "score"), "answer", "gold").collect()}
    assert got == {"A": 0.5, "b": 0.5, None: 0.0}
    with pytest.raises(AttributeError):
        P.function_from_file(str(tmp_path / "r.py"), "nope")
    with pytest.raises(ValueError):
        P.rewarded(df, "nope", "answer", "gold")
    with pytest.raises(ValueError):
        P.register_reward("exact")(lambda a, g: a)


def test_generation_asks_again_until_verified(spark):
    df = spark.createDataFrame([("easy",), ("hard",), ("never",)], "prompt string")
    model = lambda ps: [p.upper() for p in ps]
    verify = lambda ts: ["EASY" in t or t.startswith("1: HARD") for t in ts]
    got = {r.prompt: (r.text, r.verified) for r in P.generated(df, model, verify, "prompt").collect()}
    assert got == {"easy": ("0: EASY", True), "hard": ("1: HARD", True), "never": ("2: NEVER", False)}


def test_chunker_and_task_draw(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k int, t string")
    assert [tuple(r) for r in P.chunked(df, "k", "t", str.split).orderBy("chunk").collect()] == [(1, 0, "a"), (1, 1, "b")]
    drawn = E.task_draw(df, spark.createDataFrame([(5,), (6,), (5,)], "seed int"), 2, "k")
    assert drawn.count() == 3 and len({(r.seed, r.k) for r in drawn.collect()}) == 2
