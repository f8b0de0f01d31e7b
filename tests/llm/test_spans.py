import random

import pytest
from latticework.llm import spans
from pyspark.sql import functions as F


def brute(docs, least):
    seen = {}
    for i, t in docs:
        for k in range(len(t or "") - least + 1):
            seen.setdefault(t[k : k + least], set()).add(i)
    pairs = {(a, b) for v in seen.values() for a in v for b in v if a < b}
    cover = {}
    for i, t in docs:
        mark = bytearray(len(t or ""))
        for k in range(len(t or "") - least + 1):
            if len(seen[t[k : k + least]]) > 1:
                mark[k : k + least] = b"\1" * least
        if sum(mark):
            cover[i] = sum(mark)
    return pairs, cover


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefgh 世é\n") for _ in range(n))
    shared, exact, short = word(90), word(60), word(59)
    docs = [(i, word(rng.randint(0, 200))) for i in range(20)]
    docs += [(20, word(30) + shared + word(10)), (21, shared[5:80]), (22, word(3) + exact), (23, exact + word(9)), (24, word(7) + short), (25, short + "x" * 40)]
    docs += [(26, "z" * 150), (27, word(20) + "z" * 70), (28, "ab" * 90), (29, "ab" * 45), (30, shared), (31, shared), (32, None), (33, ""), (34, word(5) + shared[:45] + "#" + shared[46:])]
    return docs


@pytest.mark.parametrize("hot", [64, 3, 0])
def test_pairs_equal_brute_force(spark, hot):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id bigint, text string, rep string")
        got = [tuple(r) for r in spans.sharing_pairs(spans.find_shared(df, 60, 35, hot=hot)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, 60)[0]


def test_report_covers_what_is_shared(spark):
    docs = corpus(3)
    got = {r.doc_id: r for r in spans.shared_report(spark.createDataFrame(docs, "doc_id bigint, text string"), 60, 35).collect()}
    pairs, cover = brute(docs, 60)
    assert {k: r.shared_chars for k, r in got.items()} == cover
    assert all(sum(s.length for s in r.spans) == r.shared_chars for r in got.values())
    assert {k: r.n_partners for k, r in got.items()} == {k: sum(k in p for p in pairs) for k in cover}
    assert {k: r.first_partner for k, r in got.items()} == {k: min(a + b - k for a, b in pairs if k in (a, b)) for k in cover}


def test_later_occurrences_are_cut(spark):
    docs = corpus(4)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = {r.doc_id: r for r in spans.without_later_occurrences(df, 60, 35).collect()}
    assert len(rows) == len(docs) and rows[30].text == "" and rows[31].text == "" and rows[32].text is None
    kept = [(k, r.text) for k, r in rows.items()]
    assert brute(kept, 60)[0] == set()


def test_empty_table_and_bad_unit(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.sharing_pairs(spans.find_shared(df)).count() == 0
    with pytest.raises(ValueError):
        spans.find_shared(df, 10, 11)


def test_report_of_frequent_stretches_makes_no_pairs(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh 世é\n") for _ in range(n))
    common = word(70)
    docs = [(i, word(20) + common + word(20)) for i in range(12)] + [(20, "x" + common), (21, "x" + common), (22, common), (30, word(90))]
    got = {r.doc_id: r for r in spans.shared_report(spark.createDataFrame(docs, "doc_id bigint, text string"), 60, 35, hot=3).collect()}
    pairs, cover = brute(docs, 60)
    assert {k: r.shared_chars for k, r in got.items()} == cover and 30 not in got
    assert {k: r.n_common for k, r in got.items()} == {k: 13 if k in (20, 21) else 14 for k in cover}
    assert all(r.n_partners <= sum(k in p for p in pairs) for k, r in got.items())
    assert {k: r.first_partner for k, r in got.items()} == {k: min(a + b - k for a, b in pairs if k in (a, b)) for k in cover}


def test_very_many_copies_are_counted(spark):
    text = "".join(map(chr, range(300, 760)))
    df = spark.range(20_000).selectExpr("id AS doc_id").withColumn("text", F.lit(text))
    r = spans.shared_report(df).groupBy("n_partners", "n_common", "shared_chars").count().collect()
    assert [tuple(x) for x in r] == [(19_999, 0, 460, 20_000)]
