import numpy as np
import pytest
from latticework.functions import jsonfix as J
from latticework.functions import text as T
from latticework.operators import environment as E
from latticework.operators import graph as G
from latticework.operators import partition as X
from latticework.operators import retrieval as R
from pyspark.sql import functions as F


def test_metrics_of_one_query(spark):
    found = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("axb")], "qid string, id string, rank int")
    gold = spark.createDataFrame([("q", d) for d in "abc"] + [("none", "z")], "qid string, id string")
    got = {r.qid: r for r in R.query_metrics(R.ranks(found, gold), (5,)).collect()}
    assert (got["q"].p5, got["q"].r5, got["q"].mrr) == (2 / 5, 2 / 3, 1.0) and abs(got["q"].map - (1 + 2 / 3) / 3) < 1e-12
    assert tuple(got["none"])[1:] == (0.0,) * 5


@pytest.mark.parametrize("most", [R.BROADCAST_QUERIES, 0])
def test_top_k_equals_brute_force(spark, most):
    x = np.random.default_rng(1).normal(size=(300, 64))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None), (998, [1.0])], "id int, vector array<double>")
    got = {}
    for r in R.top_k(df.where("id < 20").withColumnRenamed("id", "qid"), df, 4, most=most).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {i: list(np.argsort(-(u @ u[i]), kind="stable")[:4]) for i in range(20)}
    assert R.top_k(df.limit(0).withColumnRenamed("id", "qid"), df, 3).count() == 0


def test_bm25_ways_agree(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 3 + i % 9))) for i in range(60)] + [(90, None), (91, "")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "w1 w2 W2"), (2, "w16"), (3, "zz"), (4, None)], "qid bigint, text string")
    a, b = ({tuple(r) for r in R.bm25(docs, asked, 4, most=m).collect()} for m in (R.BROADCAST_TERMS, 0))
    assert a == b and {r[0] for r in a} == {1, 2}


def test_token_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    sets = [[f"t{v}" for v in rng.integers(0, 14, rng.integers(1, 12))] for _ in range(120)] + [[], ["t1", "t2"], ["t2", "t1", "t1"]]
    df = spark.createDataFrame(list(enumerate(sets)), "id int, tokens array<string>")
    first = {}
    for i, s in enumerate(sets):
        if s:
            first.setdefault(frozenset(s), i)
    want = {(min(i, j), max(i, j)) for a, i in first.items() for b, j in first.items() if i != j and len(a & b) >= 0.6 * len(a | b)}
    assert {tuple(r) for r in R.token_links(df, 0.6).collect()} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(200, k) for k in range(201, 260)] + [(300, 300), (None, 5)]
    got = {r.node: r.component for r in G.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert {got[i] for i in range(71)} == {0} and {got[k] for k in range(200, 260)} == {200} and got[300] == 300
    assert G.components(spark.createDataFrame([], "a int, b int")).count() == 0


def graph(spark):
    nodes = spark.createDataFrame([("a", "A", 0), ("b", "B", 1), ("c", "C", 1), ("d", "D", 2)], "id string, name string, level int")
    rel = spark.createDataFrame(
        [("1", "a", "b", "x", " same ", ["k"], "chart_1", 0, None), ("2", "b", "a", "y", "same", None, "chart_1", 1, None), ("3", "b", "c", "x", None, [], None, 0, None), ("4", "b", "d", "x", "v", None, "par_2", 0, None), ("5", "d", "zz", "x", "v", None, "par_2", 0, None)],
        "id string, source_id string, target_id string, type string, description string, keywords array<string>, chunk_id string, layer int, created_at timestamp_ntz",
    )
    return nodes, rel


def test_signature_is_undirected_and_ignores_type(spark):
    _, rel = graph(spark)
    assert sorted(r.id for r in G.first_statements(rel, ["id"]).collect()) == ["1", "3", "4", "5"]
    assert sorted(r.id for r in G.first_statements(rel, ["id"], True).collect()) == ["1", "2", "3", "4", "5"]


def test_edges_traversal_and_walks(spark):
    nodes, rel = graph(spark)
    e = G.out_edges(rel, nodes)
    assert {(r.cur, r.next, r.move) for r in e.collect()} == {("a", "b", "vertical_down"), ("b", "a", "vertical_up"), ("b", "c", "horizontal"), ("b", "d", "vertical_down")}
    assert {(r.id, r.hop) for r in G.breadth_first(e, nodes.where("id = 'a'"), 2).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}
    assert {r.id: r.degree for r in G.degrees(e, nodes).collect()} == {"a": 1, "b": 3, "c": 0, "d": 0}
    w = G.weighted_edges(e)
    rank = {r.id: r.score for r in G.page_rank(w, nodes).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank["b"] == max(rank.values())
    walk = {r.id: r.score for r in G.random_walks(w, nodes, 40, 8).collect()}
    assert abs(sum(walk.values()) - 1) < 1e-9
    for b in G.sample_branches(w, nodes, 4, 3).collect():
        places = [b.center, *[x.next for x in b.path]]
        used = [x.source for x in b.path if x.source]
        assert len(set(places)) == len(places) and len(set(used)) == len(used)


def test_merge_and_remap(spark):
    nodes, rel = graph(spark)
    labels = G.components(spark.createDataFrame([("c", "b"), ("b", "a")], "a string, b string"))
    id_map = G.merge_components(nodes, labels)
    assert {tuple(r) for r in id_map.collect()} == {("b", "a"), ("c", "a")}
    moved = {r.id: (r.source_id, r.target_id) for r in G.remap(rel, id_map).collect()}
    assert moved["4"] == ("a", "d") and moved["3"] == ("a", "a")


def test_names_resolved_by_source(spark):
    ents = spark.createDataFrame([(1, "e1", "n", ["c1"]), (2, "e2", "n", ["c2"]), (3, "e3", "m", None)], "ord int, id string, name string, source array<string>")
    asked = spark.createDataFrame([("r1", "n", "c2"), ("r2", "n", "c9"), ("r3", "m", None), ("r4", "?", "c1")], "id string, name string, chunk_id string")
    assert {r.id: r.entity_id for r in G.resolve_by_name(asked, ents).collect()} == {"r1": "e2", "r2": None, "r3": "e3", "r4": None}


def test_replayed_rewards(spark):
    edges = spark.createDataFrame([("a", "b", "chart_1"), ("b", "c", None)], "cur string, next string, source string")
    names = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, name string")
    tasks = spark.createDataFrame([("e", ["A"], ["chart_1"])], "episode string, candidates array<string>, gold array<string>")
    script = ["START:?", "EDGE_SEARCH:nope", "EDGE_SEARCH:B", "EDGE_SEARCH:B", "MOVE:B", "EDGE_SEARCH:C", "BACKWARD:A", "STOP:x", "MOVE:B"]
    acts = spark.createDataFrame([("e", i, *s.split(":")) for i, s in enumerate(script)], "episode string, step int, action string, arg string")
    got = [(r.executed, r.reward) for r in E.replay(acts, tasks, edges, names, len(script)).orderBy("step").collect()]
    assert got == [(True, 0.0), (False, -2.0), (True, 7.0), (True, 4.0), (True, 7.0), (False, 3.0), (True, 5.0), (True, 5.0), (False, 4.0)]


@pytest.mark.parametrize("text,want", [('{"a": [1, 2', '{"a": [1, 2]}'), ('{"a": "x', '{"a": "x"}'), ('{"a": 1,', '{"a": 1}'), ('{"a": 1, "b', '{"a": 1}'), ('{"a": 1, "b":', '{"a": 1, "b": null}'), ('<think>{"no": 1}</think> {"a": 1}', '{"a": 1}'), ('Sure\n```json\n{"a": 1}\n```', '{"a": 1}'), ("nothing", None), (None, None), ("", None)])
def test_json_repair(text, want):
    assert J.parsed(text) == want


def test_salvage_of_entities():
    assert '"entity_name": "A"' in J.parsed('x {"entities": [{"entity_name": "A"}, {"entity_name": "B" oops')


@pytest.mark.parametrize("text,want", [(r"so \boxed{1} and \boxed{\frac{1}{2}}.", r"\frac{1}{2}"), (r"\fbox{3}", "3"), (r"\boxed{1", None), ("none", None), (None, None)])
def test_boxed(text, want):
    assert T.boxed_content(text) == want


@pytest.mark.parametrize("a,b,same", [("1/2", "\\frac{1}{2}", True), ("0.5", "\\dfrac12", True), ("x = 3", "3.0", True), ("1,000", "1000", True), ("5\\text{ cm}", "5", True), ("4", "5", False), (None, "1", False)])
def test_math_equal(a, b, same):
    assert T.math_equal(a, b) is same


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    s = F.lit
    assert one(T.names_alike(s("panel wave 1"), s("panel wave 2"))) is False
    assert one(T.names_alike(s("survey of adults"), s("survey of adult"))) is True
    assert one(T.answer_normal(s("The  Quick, a fox!"))) == "quick fox"
    assert one(T.final_number(s("a 1,000 then 5."), False)) == "5." and one(T.final_number(s("#### 1,234"))) == "1234"
    assert one(T.any_three_in_line(F.array(*[F.struct(s(float(x)).alias("x"), s(float(x * 2)).alias("y")) for x in range(3)]))) is True
    assert tuple(one(T.action_parts(s("  MOVE  New York \n")))) == ("MOVE", "New York", None)
    assert tuple(one(T.action_parts(s("Move 3")))) == ("Move", "3", 3) and tuple(one(T.action_parts(s(" STOP ")))) == ("STOP", None, None)
    assert one(T.step_score(s(3), s(1), s(4))) == 0.5
    with pytest.raises(Exception, match="no rule"):
        one(T.scored(s("zz"), {"a": s(1.0)}))


@pytest.mark.parametrize("equal", [False, True])
def test_balanced_partitions(equal):
    loads = np.random.default_rng(3).integers(1, 500, 64).tolist()
    parts = X.largest_differencing(loads, 8, equal)
    sums = [sum(x for x, p in zip(loads, parts, strict=True) if p == k) for k in range(8)]
    plain = [sum(loads[k * 8 : k * 8 + 8]) for k in range(8)]
    assert max(sums) - min(sums) <= max(plain) - min(plain) and sorted(set(parts)) == list(range(8))
    if equal:
        assert all(parts.count(k) == 8 for k in range(8))
    assert sum(X.greedy(loads, 8, equal).count(k) for k in range(8)) == 64


def test_token_chunks_cover_everything(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, ""), (3, None), (4, "a")], "k int, t string")
    got = [(r.k, r.start, r.content.split()) for r in X.token_chunks(df, "k", "t", 10, 2).orderBy("k", "start").collect()]
    assert [g[1] for g in got if g[0] == 1] == [0, 8, 16] and got[2][2][-1] == "24" and got[-1] == (4, 0, ["a"])
