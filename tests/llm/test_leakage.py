import pytest
from latticework.llm import leakage

ITEM = "Does the share reported for the pie chart in Zeza rank above 42 percent of small-business owners, relative to 2013?"
DOCS = "doc_id bigint, text string, item_id string"


def found(spark, docs, items=((1, ITEM),), **kw):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], DOCS)
    e = spark.createDataFrame(list(items), "item_id bigint, text string")
    return {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, e, **kw).collect()}


CASES = [
    (1, "intro " + ITEM + " outro"),
    (2, ITEM.upper()),
    (3, "> Does the share re­ported for the\n> **pie** chart in _Zeza_ rank above 42 — percent"),
    (4, "Does the share reported for the pie chart in Zeza rank"),  # eleven words
    (5, "Does the share reported for the other pie chart in Zeza rank above 42 percent"),
    (6, None), (7, ""), (8, "​"),
    (9, "rank above 42 percent of smallbusiness owners relative to 2013 Zeza in Zeza rank above 42 percent of smallbusiness owners relative to 2013"),
    (10, "x " * 60_000 + ITEM),
    (11, "Ｄｏｅｓ ｔｈｅ share reported for the <b>pie</b> chart&nbsp;in Zeza rank above"),
]


@pytest.mark.parametrize("most", [leakage.BROADCAST_NGRAMS, 0])
def test_writings_and_near_misses(spark, most):
    assert found(spark, CASES, most=most) == {(1, 1), (2, 1), (3, 1), (9, 1), (10, 1), (11, 1)}


def test_empty_sides_repeats_and_items_alike(spark):
    assert found(spark, CASES, items=[(1, None), (2, "too short")]) == set()
    assert found(spark, []) == set()
    assert found(spark, [(1, ITEM), (1, ITEM)], items=[(1, ITEM), (1, ITEM), (2, ITEM)]) == {(1, 1), (1, 2)}


def test_clean(spark):
    d = spark.createDataFrame([(1, ITEM), (2, "fine")], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert [r.doc_id for r in leakage.clean(d, leakage.find_leaks(d, e)).collect()] == [2]


def rows(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    e = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted(map(tuple, leakage.find_leaks(d, e, **kw).collect()), key=str)


def test_both_ways_give_the_same_rows(spark):
    docs = [(i, t) for i, t in CASES] + [(1, CASES[0][1]), (None, ITEM), (20, ITEM + " " + ITEM), (21, "short items too, it-is one"), (22, "shortitems here itis one")]
    items = [(1, ITEM), (1, ITEM), (2, ITEM + " and one more"), (3, "too short"), (4, None), (None, ITEM), (5, "it-is one")]
    for short in (False, True):
        wide = rows(spark, docs, items, whole_short=short)
        assert wide == rows(spark, docs, items, most=0, whole_short=short)
        assert sum(r[:2] == (1, 1) for r in wide) == 2  # a repeated document repeats
        assert {r[0] for r in wide if r[1] == 5} == ({21, 22} if short else set())
        assert not [r for r in wide if r[1] == 3 or r[1] is None]
        assert {r[3] for r in wide if r[:2] == (20, 1)} == {2 * {r[3] for r in wide if r[:2] == (2, 1)}.pop()}


def test_the_bound_counts_ngrams(spark):
    items = spark.createDataFrame([(1, " ".join("abcdefghijklmnopqrst"))], "item_id bigint, text string")
    assert leakage._fitting(items, 12, 9, False)[1] is not None
    assert leakage._fitting(items, 12, 8, False)[1] is None
