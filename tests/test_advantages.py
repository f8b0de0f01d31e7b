import math
import random

import pytest
from latticework.operators import advantages as A
from latticework.operators import losses as L
from latticework.operators import metrics as M
from pyspark.sql import functions as F


def groups(spark, seed=1, n=80):
    rng = random.Random(seed)
    rows = [(i, f"g{rng.randint(0, 12)}", rng.gauss(0, 1), rng.randint(1, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "ord int, g string, s double, len int")


def test_group_statistics_golden(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (0, 3.0)], "g int, s double")
    got = sorted((r.s, r.mean, r.std, r.n) for r in A.group_stats(df).collect())
    assert [x[1:] for x in got] == [(2.0, math.sqrt(2), 2), (0.0, 1.0, 1), (2.0, math.sqrt(2), 2)]
    assert A.group_stats(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_window_forms_equal_loops(spark, seed):
    rows, df = groups(spark, seed)
    by = {}
    for i, g, s, n in rows:
        by.setdefault(g, []).append((i, s, n))
    rloo, grpo, opo = {}, {}, {}
    for m in by.values():
        k = len(m)
        mean = sum(s for _, s, _ in m) / k
        sd = math.sqrt(sum((s - mean) ** 2 for _, s, _ in m) / (k - 1)) if k > 1 else 1.0
        base = sum(s * n for _, s, n in m) / sum(n for *_, n in m)
        for i, s, _ in m:
            rloo[i] = s * k / (k - 1) - mean * k / (k - 1) if k > 1 else s
            grpo[i] = (s - mean) / (sd + 1e-6) if k > 1 else s / (1 + 1e-6)
            opo[i] = s - base if k > 1 else s
    for f, want in ((A.rloo, rloo), (A.grpo, grpo), (A.opo, opo)):
        got = {r.ord: r.adv for r in f(df).collect()}
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_null_scores_do_not_enter_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0)], "g string, s double")
    assert sorted((r.adv for r in A.rloo(df).collect()), key=str) == [-2.0, 2.0, None]


def test_advantages_ignore_masked_values(spark):
    r, m = [0, 0, 0.1, 0.1, 0.1, 0, 0, 0.1, 1, 0, 0], [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    rng = random.Random(3)
    v1 = [rng.random() for _ in r]
    v2 = [a if k else rng.random() for a, k in zip(v1, m, strict=True)]
    df = spark.createDataFrame([(0, [float(x) for x in r], v1, m), (1, [float(x) for x in r], v2, m)], "k int, r array<double>, v array<double>, m array<int>")
    out = A.gae_tokens(df, "k", "r", "v", "m", 0.9, 0.8).where("m = 1").orderBy("k", "pos").collect()
    half = len(out) // 2
    assert all(abs(a.raw - b.raw) < 1e-12 and abs(a.ret - b.ret) < 1e-12 for a, b in zip(out[:half], out[half:], strict=True))


def test_first_eos_and_positions(spark):
    df = spark.createDataFrame([([5, 1, 7, 1], [0, 1, 1, 0]), ([5, 6], [1, 1]), ([], [])], "ids array<int>, m array<int>")
    assert [r.x for r in df.select(A.after_first(1, F.col("ids")).alias("x")).collect()] == [[1, 1, 0, 0], [1, 1], []]
    assert [r.x for r in df.select(A.position_ids(F.col("m")).alias("x")).collect()] == [[0, 0, 1, 1], [0, 1], []]


def test_padded_turns_are_taken_once(spark):
    rows = [("u", 0, 1, [1.0, 0.0], [0.5, 0.1], [1, 1]), ("u", 0, 1, [1.0, 0.0], [0.5, 0.1], [1, 1]), ("u", 0, 2, [2.0], [0.2], [1])]
    df = spark.createDataFrame(rows, "g string, traj int, turn int, s array<double>, v array<double>, m array<int>")
    out = A.turn_gae(df, "g", "traj", "turn", "s", "v", "m", gamma=1.0, lam=1.0).orderBy("turn", "pos").collect()
    assert [(r.turn, r.pos, r.ret) for r in out] == [(1, 0, -100.0), (1, 1, 3.0), (2, 0, 2.0)]


def test_concatenated_turns(spark):
    df = spark.createDataFrame([("a", 0, 2, ["p2"], ["r2"], 1.0), ("a", 0, 1, ["p1"], ["r1", "e"], 0.0)], "g string, t int, n int, p array<string>, q array<string>, i double")
    r = A.concat_turns(df, "g", "t", "n", "p", "q", "i").first()
    assert (r.prompt, r.response, r["mask"], r["info"]) == (["p1"], ["r1", "e", "p2", "r2"], [1, 1, 0, 1], 1.0)


def test_resampling_follows_the_weights(spark):
    df = spark.createDataFrame([(0, "g", 0.0), (1, "g", 9.0), (2, "g", 1.0)], "ord int, g string, s double")
    out = A.resample(A.resample_weights(df, method="pow"), "ord", "g", draws=600).groupBy("ord").count().collect()
    n = {r.ord: r["count"] for r in out}
    assert sum(n.values()) == 600 and n[1] > 560 and n.get(0, 0) == 0


def test_registry():
    assert A.ESTIMATORS["rloo"] is A.rloo
    with pytest.raises(ValueError):
        A.register("rloo")(A.grpo)
    with pytest.raises(ValueError):
        A.estimate("nope", None)
    assert set(L.LOSSES) >= {"ppo", "gspo", "geometric"}


def test_masked_mean_goldens(spark):
    nan = float("nan")
    for values, mask, want in ([[1.0, 2.0, 3.0, 4.0], [1, 0, 0, 1], 2.5], [[1.0, nan, 2.0, 4.0], [1, 0, 0, 1], 2.5]):
        df = spark.createDataFrame([("a", v, m) for v, m in zip(values, mask, strict=True)], "g string, x double, m int")
        assert abs(df.agg(L.masked_mean(F.col("x")).alias("y")).first().y - want) < 1e-6
    df = spark.createDataFrame([("a", nan, 1), ("a", 1.0, 1)], "g string, x double, m int")
    assert math.isnan(df.agg(L.masked_mean(F.col("x")).alias("y")).first().y)


def test_loss_modes(spark):
    df = spark.createDataFrame([(0, 1.0, 1), (0, 3.0, 1), (1, 5.0, 1), (1, 9.0, 0)], "g int, x double, m int")
    got = {m: L.aggregate_loss(df, F.col("x"), m, width=2).first().loss for m in L.LOSS_MODES}
    assert got == {"token-mean": 3.0, "seq-mean-token-sum": 4.5, "seq-mean-token-mean": 3.5, "seq-mean-token-sum-norm": 4.5}


def test_expected_best_closed_form(spark):
    df = spark.createDataFrame([("u", float(x)) for x in range(1, 6)], "u string, x double")
    got = {r.n: r for r in M.best_of(df, "u", "x").collect()}
    assert set(got) == {2, 4, 5} and abs(got[2].best + got[2].worst - 6) < 1e-9
    three = M.bootstrap(df, "u", "x", 3, 2000).first().best
    assert abs(three - sum(v * ((v / 5) ** 3 - ((v - 1) / 5) ** 3) for v in range(1, 6))) < 0.15


def test_majority_and_reduction(spark):
    df = spark.createDataFrame([("u", "A", 0.9, 0), ("u", "B", 0.8, 1), ("u", "A", 0.7, 2)], "u string, v string, x double, o int")
    assert tuple(M.majority(df, "u", "v", "x", "o").first()) == ("u", "A", 0.9)
    m = spark.createDataFrame([("loss", 1.0), ("loss", 2.0), ("loss", 3.0), ("max_reward", 5.0), ("max_reward", 8.0), ("min_error", 0.1), ("min_error", 0.05)], "metric string, value double")
    assert {r.metric: r.value for r in M.reduce_metrics(m).collect()} == {"loss": 2.0, "max_reward": 8.0, "min_error": 0.05}
    v = spark.createDataFrame([("s1", "p1", 0.8), ("s1", "p1", 0.9)], "src string, u string, x double")
    assert abs(M.validation(v, "src", "u", "x").first()["mean"] - 0.85) < 1e-12
