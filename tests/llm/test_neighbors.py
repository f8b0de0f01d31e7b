import numpy as np
from latticework.llm import neighbors
from pyspark.sql import functions as F


def brute(ids, x, k, floor=-1.0):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, a in enumerate(ids):
        s = np.round(x @ x[i], 7)
        best = sorted((-s[j], b) for j, b in enumerate(ids) if b != a and s[j] >= floor)[:k]
        out[a] = [b for _, b in best]
    return out


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "record_id bigint, vector array<float>")


def test_factor_one_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 64)).astype(np.float32)
    x[300:330] = x[:30] + rng.normal(size=(30, 64)) * 0.1
    ids = rng.permutation(5000)[:900]
    got = {}
    for r in neighbors.nearest(table(spark, ids, x), queries=F.col("record_id") % 3 == 0).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.other)
    want = brute(ids, x.astype(np.float64), 5)
    assert got == {q: want[q] for q in want if q % 3 == 0}


def test_relaxed_pairs_have_high_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 64))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.25, base[:200] * 3 + rng.normal(size=(200, 64)) * 0.3]).astype(np.float32)
    ids = np.arange(len(x))
    want = {(min(a, b), max(a, b)) for a, n in brute(ids, x.astype(np.float64), 5, 0.9).items() for b in n}
    got = {tuple(r) for r in neighbors.close_pairs(table(spark, ids, x)).collect()}
    assert len(want & got) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)


def test_unusable_vectors_repeats_and_ties(spark):
    e = [0.0] * 64
    one, two, bad, inf = e[:], e[:], e[:], e[:]
    one[0], two[0], bad[1], inf[1] = 1.0, 2.5, float("nan"), float("inf")
    rows = [(4, one), (4, one), (3, two), (9, one), (5, None), (6, e), (7, bad), (8, one[:5]), (10, inf)]
    df = spark.createDataFrame(rows, "record_id bigint, vector array<float>").withColumn("cell", F.lit("clash"))
    got = sorted(tuple(r)[:2] + (r["rank"],) for r in neighbors.nearest(df, k=1).collect())
    assert got == [(3, 4, 1), (4, 3, 1), (9, 3, 1)]
    assert neighbors.nearest(df.limit(0)).count() == 0
    assert neighbors.close_pairs(df).count() == 3


def test_very_many_equal_vectors(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 64)), 300, axis=0), rng.normal(size=(100, 64))]).astype(np.float32)
    got = {}
    for r in neighbors.nearest(table(spark, np.arange(400), x), floor=0.9).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.other)
    assert got[299] == [0, 1, 2, 3, 4] and got[2] == [0, 1, 3, 4, 5] and len(got) == 300
