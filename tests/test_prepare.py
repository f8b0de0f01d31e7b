"""Preparers, rollouts, templates, limits and growing data sets."""

import json
import time

import pytest
from latticework.operators import plugins as P
from latticework.operators import prepare as R
from latticework.sources import readers as S
from latticework.sources import sinks as K
from pyspark.sql import functions as F


def test_word_and_boxed_problems(spark):
    df = spark.createDataFrame([(2, "How many?", "so #### 1,200"), (1, "Why?", "none"), (3, None, None)], "k int, q string, a string")
    rows = {r.k: r for r in R.word_problems(df, "k", "q", "a", "src", "train").collect()}
    assert rows[2].prompt[0].content == "How many? " + R.AFTER_HASHES and rows[2].reward_model.ground_truth == "1200"
    assert rows[2].extra_info.asDict() == {"split": "train", "index": 1, "answer": "so #### 1,200", "question": "How many?"}
    assert rows[1].reward_model.ground_truth is None and rows[3].prompt[0].content == R.AFTER_HASHES
    box = R.boxed_problems(spark.createDataFrame([(1, "Q", "x \\boxed{\\frac{1}{2}}")], "k int, q string, a string"), "k", "q", "a", "m", "test").first()
    assert box.reward_model.ground_truth == "\\frac{1}{2}" and box.ability == "math"
    assert R.plain_problems(df.limit(0), "k", "q", "a", "s", "test").count() == 0
    pic = R.pictured_problems(spark.createDataFrame([(1, "Q", "4", ["i.png"])], "k int, q string, a string, i array<string>"), "k", "q", "a", "i", "g", "test", "Think.").first()
    assert pic.images == ["i.png"] and pic.prompt[0].content == "Q Think." and "images" not in pic.extra_info.asDict()


def test_choices_and_endings(spark):
    df = spark.createDataFrame([(i, f"q{i}", "yes", ["a", "b", "c"]) for i in range(40)], "k int, q string, r string, w array<string>")
    rows = R.choices_of_four(df, "k", "q", "r", F.col("w"), "g", "test").collect()
    for r in rows:
        assert f"{r.reward_model.ground_truth}) yes" in r.prompt[0].content and r.prompt[0].content.endswith(r.prompt[0].content.split("\nD) ")[1])
    assert {r.reward_model.ground_truth for r in rows} == set("ABCD")
    e = spark.createDataFrame([(1, "Cooking", "A man. Then", ["x [step] y", "z [title] w"], "1")], "k int, l string, s string, c array<string>, g string")
    r = R.endings(e, "k", "l", F.col("s"), F.col("c"), F.col("g"), "h", "train").first()
    assert r.prompt[0].content == "Cooking: A man. Then" and r.reward_model.choices == ["x y", "z. w"] and r.reward_model.ground_truth == 1


def test_search_and_preferences(spark):
    df = spark.createDataFrame([(1, "who?", ["me"], "nq")], "k int, q string, a array<string>, s string")
    r = R.search_questions(df, "k", "q", "a", "s", "train", "sys", "Ask: \n").first()
    assert r.data_source == "searchR1_nq" and [m.content for m in r.prompt] == ["sys", "Ask: who?"] and r.extra_info.tools_kwargs.search.create_kwargs.ground_truth == ["me"]
    p = spark.createDataFrame([(i, f"p{i}", f"c{i}", f"r{i}") for i in range(8)], "k int, prompt string, chosen string, rejected string")
    assert R.preferred_replies(p, "k").count() == 16
    assert {x.k: x.split for x in R.preference_splits(p, "k").collect()} == {i: "train" if i < 6 else "test" for i in range(8)}
    assert R.preference_prompts(p, "k", "s", "train").orderBy("k").first().reward_model.ground_truth == "c0"


def test_rollouts_mask_strings(spark, tmp_path):
    (tmp_path / "12.jsonl").write_text("\n".join([json.dumps({"a": "x<|pad|><|pad|>y", "n": [1, {"b": 2}]}), "", "broken", json.dumps({"a": "z"})]))
    (tmp_path / "3.jsonl").write_text(json.dumps({"a": "<|pad|>"}))
    rows = sorted((r.step, r["index"], r.fields) for r in S.rollouts(spark, str(tmp_path), r"<\|pad\|>").collect())
    assert rows == [(3, 0, {"a": "*"}), (12, 0, {"a": "x**y", "n": '[1,{"b":2}]'}), (12, 1, {"a": "z"})]


def test_templates(spark):
    t = S.prompt_templates("a:\n  b: 'Say {x} to {{you}}, {y}.'\nc: plain")
    assert t == {"a.b": "Say {x} to {{you}}, {y}.", "c": "plain"}
    df = spark.createDataFrame([("hi", None)], "x string, y int")
    assert df.select(S.filled(t["a.b"], x=F.col("x"), y=F.col("y")).alias("t")).first().t == "Say hi to {you}, ."
    with pytest.raises(KeyError):
        S.filled(t["a.b"], x=F.col("x"))


def slow(answer, gold):
    if answer == "slow":
        time.sleep(30)
    return 1.0 if answer == gold else float(gold)


def test_rewards_with_a_time_limit(spark):
    df = spark.createDataFrame([("a<end>", "a"), ("slow", "b"), ("c", "not a number"), (None, "2")], "answer string, gold string").coalesce(1)
    began = time.time()
    assert [r.reward for r in P.managed_rewards(df, slow, "answer", "gold", 0.5, "<end>").collect()] == [1.0, 0.0, 0.0, 2.0]
    assert time.time() - began < 25


def test_models_by_name():
    P.register_model("tiny")(lambda prompts: ["t"] * len(prompts))
    P.register_model("tiny-large")(lambda prompts: ["l"] * len(prompts))
    assert P.model_named("Tiny-7b")(["x"]) == ["t"] and P.model_named("tiny-large-2")(["x"]) == ["l"]
    with pytest.raises(ValueError):
        P.model_named("other")


def test_growing_data_set(spark, tmp_path):
    base, folder = spark.createDataFrame([(1, "a")], "k int, t string"), str(tmp_path / "more")
    assert K.grown_dataset(spark, base, folder).count() == 1
    K.append_batch(spark.createDataFrame([(2,)], "k int"), folder, 1)
    K.append_batch(spark.createDataFrame([(3,), (4,)], "k int"), folder, 2)
    K.append_batch(spark.createDataFrame([(3,)], "k int"), folder, 2)
    assert sorted(r.k for r in K.grown_dataset(spark, base, folder).collect()) == [1, 2, 3]
    assert sorted(r.k for r in K.grown_dataset(spark, base, folder, before=2).collect()) == [1, 2]
