import pytest
from latticework.operators import batch as B
from latticework.operators import filters as P
from pyspark.sql import functions as F


def frame(spark, values, extra="abcdefgh"):
    return spark.createDataFrame([(i, v, extra[i]) for i, v in enumerate(values)], "pos bigint, v int, l string")


def values(df, c="v"):
    return [r[c] for r in df.orderBy("pos").collect()]


def test_reorder(spark):
    out = B.reorder(frame(spark, [1, 2, 3, 4, 5, 6]), [3, 4, 2, 0, 1, 5])
    assert values(out) == [4, 5, 3, 1, 2, 6] and values(out, "l") == list("decabf")
    with pytest.raises(ValueError):
        B.reorder(frame(spark, [1, 2]), [0, 0])


def test_chunk_and_concat(spark):
    df = B.chunk(frame(spark, [1, 2, 3, 4, 5, 6]), 2)
    parts = [df.where(F.col("chunk") == i).withColumn("pos", F.col("pos") % 3) for i in range(2)]
    assert [values(p) for p in parts] == [[1, 2, 3], [4, 5, 6]]
    assert values(B.concat(*parts)) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        B.chunk(df, 4)


def test_repeat(spark):
    df = frame(spark, [1, 2, 3])
    assert values(B.repeat(df, 2), "l") == list("aabbcc")
    assert values(B.repeat(df, 2, False), "l") == list("abcabc")
    assert B.repeat(df, 0).count() == 0


@pytest.mark.parametrize("divisor,want", [(2, "abca"), (3, "abc"), (7, "abcabca")])
def test_pad_and_unpad(spark, divisor, want):
    padded = B.pad_to_divisor(frame(spark, [1, 2, 3]), divisor)
    assert values(padded, "l") == list(want)
    assert values(B.unpad(padded), "l") == list("abc")


@pytest.mark.parametrize("times,want", [([3, 1, 2], "aaabcc"), ([1, 2, 3], "abbccc"), ([0, None, 1], "c")])
def test_repeat_each(spark, times, want):
    df = spark.createDataFrame([(i, t, "abc"[i]) for i, t in enumerate(times)], "pos bigint, t int, l string")
    assert "".join(r.l for r in B.repeat_each(df, "t").orderBy("pos", "rep").collect()) == want


def test_unfold_chunks(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4], "a"), (1, [5, 6, 7, 8], "b"), (2, [9, 10, 11, 12], "c")], "pos bigint, x array<int>, l string")
    out = B.unfold_chunks(df, ["x"], 2)
    assert values(out, "x") == [[1, 2], [3, 4], [5, 6], [7, 8], [9, 10], [11, 12]] and values(out, "l") == list("aabbcc")
    with pytest.raises(Exception, match="cannot be cut"):
        B.unfold_chunks(df, ["x"], 3).collect()


def test_fold_reorder_unfold(spark):
    df = B.repeat(frame(spark, [1, 2, 3]), 2)
    folded = B.gather(B.fold(df, 2), [1, 2, 0])
    assert values(B.unfold(folded), "l") == list("bbccaa")


def test_union_of_columns_must_agree(spark):
    a = spark.createDataFrame([(0, 1, float("nan")), (1, None, 2.0)], "pos bigint, x int, y double")
    assert B.union_columns(a, a.withColumn("z", F.lit(3))).count() == 2
    with pytest.raises(Exception, match="disagree"):
        B.union_columns(a, a.withColumn("x", F.lit(9))).collect()
    assert {r.column: r.rows for r in B.conflicts(a, a.withColumn("x", F.lit(9))).collect()} == {"x": 2, "y": 0}


def test_align_repeats_prompts_and_rejects_strangers(spark):
    p = spark.createDataFrame([("C", 0), ("B", 1), ("A", 2)], "uid string, at int")
    g = spark.createDataFrame([(u, i) for i, u in enumerate("AAABBCCCC")], "uid string, at int")
    assert [r.prompt.at for r in B.align(p, g).orderBy("generated.at").collect()] == [2, 2, 2, 1, 1, 0, 0, 0, 0]
    with pytest.raises(Exception, match="no prompt"):
        B.align(p, g.withColumn("uid", F.lit("X"))).collect()


def test_positions_over_ranges_equal_one_sort(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 613).alias("a"), "id")
    plain = {r.id: r.pos for r in B.with_position(df, "a", "id").collect()}
    assert {r.id: r.pos for r in B.with_position(df, "a", "id", rows_per_range=300).collect()} == plain
    assert sorted(plain.values()) == list(range(5000))


def test_slices_and_splits(spark):
    df = frame(spark, [1, 2, 3, 4, 5, 6])
    assert values(B.slice_rows(df, -4, None, 2)) == [3, 5] and values(B.slice_rows(df, 1, -1)) == [2, 3, 4, 5]
    assert B.share_of(df, 0.5, 1.0, "v").count() == 3 and B.share_of(df, -0.5, 1.0, "v").count() == 3


def test_meta_pop_rename(spark):
    df = frame(spark, [1])
    assert B.merge_meta({"a": 1}, {"b": 2, "a": 1}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        B.merge_meta({"a": 1}, {"a": 2})
    with pytest.raises(KeyError):
        B.pop(df, ["nope"])
    with pytest.raises(ValueError):
        B.rename(df, ["v"], ["a", "b"])


def test_filters_on_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, " ", "a b c"), (3, "x", "a")], "id int, name string, t string")
    assert [r.id for r in P.named(df).collect()] == [3]
    assert sorted(r.id for r in P.within_length(df, "t", 2).collect()) == [3]
    g = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", 1.0), ("c", 3.0)], "g string, s double")
    assert sorted({r.g for r in P.varied_groups(g, "g", "s").collect()}) == ["a", "c"]
    assert P.varied_groups(g.limit(0), "g", "s").count() == 0
