import random

from latticework.llm import pairs


def test_a_late_refusal_is_found(spark):
    answer = "You name Fupavu, Jibaco, Redeno, Zorira, Bomipe, Nisifi, Junoco, Lamina, Torepo, Kavile. I cannot answer this question."
    df = spark.createDataFrame([(1, "What does the chart say of them?", answer)], "task_id bigint, query string, answer string")
    assert [tuple(r) for r in pairs.defective_pairs(df).collect()] == [(1, "refusal")]


def test_every_similar_pair_shares_a_cluster(spark):
    rng = random.Random(4)
    texts = {"".join(rng.choices("abcdefghij ", k=rng.randint(3, 60))) for _ in range(60)}
    texts |= {t[:i] + "z" + t[i + 1 :] for t in list(texts) for i in rng.sample(range(len(t)), 3)}
    got = {r.opening: r.cluster for r in pairs.cluster_openings(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
    assert set(got) == texts
    assert not [(a, b) for a in texts for b in texts if pairs.similar(a, b) and got[a] != got[b]]


def test_recurring_alone_shows_refusals_of_any_wording(spark):
    """With no known openings at all, in a language without a word list."""
    rows = [(i, f"What share of group {i} in place {i} expects topic {i}?", "Valitettavasti en voi vastata tähän kysymykseen lainkaan.") for i in range(6)]
    rows += [(20 + i, f"Who leads in place {i}, and by how much?", f"The column chart shows that leaders changed in place {i} by {40 + i}%.") for i in range(6)]
    rows += [(40 + i, f"Does place {i} follow the pattern?", "No, the two of them follow opposite directions.") for i in range(6)]
    rows += [(60 + i, f"Is place {i} above?", "No.") for i in range(6)]
    df = spark.createDataFrame(rows, "task_id bigint, query string, answer string")
    kinds = {r.task_id: r.defect for r in pairs.defective_pairs(df, known=()).collect()}
    assert kinds == dict.fromkeys(range(6), "refusal")


def test_a_bucket_misses_no_pair_and_links_sparsely():
    rng = random.Random(7)
    texts = []
    for _ in range(20):
        base = "".join(rng.choices("abcdef ", k=40))
        texts += ["".join(rng.choice("xyz") if rng.random() < 0.03 else c for c in base) for _ in range(15)]
    texts = sorted(set(texts))
    bucket, links = pairs.Bucket(), []
    for t in texts:
        links += [(t, o) for o in bucket.add(t)]
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in links:
        assert pairs.similar(a, b)
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a in texts for b in texts if pairs.similar(a, b))


def test_rows_of_one_task_with_other_contents(spark):
    df = spark.createDataFrame([(1, "Why is it so?", "Yes"), (1, "Why is it so?", " "), (None, "Why?", None), (None, "Why?", "12")], "task_id bigint, query string, answer string")
    assert {tuple(r) for r in pairs.defective_pairs(df).collect()} == {(1, "empty"), (None, "empty")}
