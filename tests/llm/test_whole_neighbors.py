import numpy as np
from latticework.llm import neighbors
from pyspark.sql import functions as F

from tests.llm.test_neighbors import brute, table


def test_scaled_copies_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(1, 64)) * np.arange(1, 201)[:, None] * 0.37, rng.normal(size=(100, 64))]).astype(np.float32)
    ids = rng.permutation(300)
    got = {}
    for r in neighbors.nearest(table(spark, ids, x)).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.other)
    assert got == brute(ids, x.astype(np.float64), 5)


def test_equal_and_scaled_groups_mix(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(1, 64)).astype(np.float32)
    x = np.concatenate([np.repeat(v, 90, axis=0), np.repeat(v * 2, 90, axis=0), rng.normal(size=(40, 64)).astype(np.float32)])
    ids = np.concatenate([np.arange(90) + 100, np.arange(90), np.arange(40) + 500])
    got = {}
    for r in neighbors.nearest(table(spark, ids, x), queries=F.col("record_id") % 3 == 0).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.other)
    want = brute(ids, x.astype(np.float64), 5)
    assert got == {q: want[q] for q in want if q % 3 == 0}


def lists(df):
    got = {}
    for r in df.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.other)
    return got


def test_groups_of_every_size_whoever_asks(spark):
    """Equal and scaled groups of 2 to 150, a subset asking, against brute force."""
    rng = np.random.default_rng(12)
    blocks = [rng.normal(size=(300, 64))]
    for size in (2, 5, 6, 7, 30, 40, 64, 65, 150):
        v = rng.normal(size=(1, 64))
        blocks += [np.repeat(v, size, axis=0), v * rng.uniform(0.1, 9, size=(size, 1))]
    x = np.concatenate(blocks).astype(np.float32)
    ids = rng.permutation(3000)[: len(x)]
    want = brute(ids, x.astype(np.float64), 5)
    got = lists(neighbors.nearest(table(spark, ids, x), queries=F.col("record_id") % 4 == 0))
    assert got == {q: want[q] for q in want if q % 4 == 0}


def test_overfull_shards_are_split_by_id(spark):
    rng = np.random.default_rng(13)
    dense = rng.normal(size=(1, 64)) + rng.normal(size=(700, 64)) * 1e-3  # no border of the top separates these well
    x = np.concatenate([dense, rng.normal(size=(300, 64))]).astype(np.float32)
    ids = rng.permutation(5000)[: len(x)]
    want = brute(ids, x.astype(np.float64), 5)
    assert lists(neighbors.nearest(table(spark, ids, x), shard_rows=60)) == want


def test_direction_is_of_no_length(spark):
    rng = np.random.default_rng(14)
    v = rng.normal(size=64)
    x = np.stack([v * s for s in (1e-30, 1.0, 3.7, 1e30)] + [-v]).astype(np.float32)
    keys = [r[0] for r in table(spark, range(5), x).orderBy("record_id").select(neighbors.direction(F.col("vector"))).collect()]
    assert len(set(keys[:4])) == 1 and keys[4] != keys[0]
