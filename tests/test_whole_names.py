from latticework.operators import graph as G
from latticework.plans import graph_queries as Q
from latticework.plans import retrieval_queries as RQ


def test_resolution_keeps_every_copy_and_judges_every_spelling(spark):
    # 3 is near the spelling of 6 and 10 only, which is not that of their token set's smallest id 2; 7 stands alone
    rows = [(1, "zabodajo election"), (4, "zabodajo election"), (5, "zabodajo election"), (7, "nothing like it"), (8, "???"), (9, "???")]
    rows += [(2, "alpha beta gamma"), (6, "gamma beta alpha"), (10, "gamma beta alpha"), (3, "gamma beta alpha fkwn")]
    names = spark.createDataFrame(rows, "id bigint, name string")
    got = {r.node: r.component for r in G.components(Q.resolved(names)).collect()}
    assert got == {1: 1, 4: 1, 5: 1, 8: 8, 9: 8, 2: 2, 3: 2, 6: 2, 10: 2}


def test_classes_have_one_row_for_each_record(spark):
    sets = [(1, "a b c d e"), (2, "e d c b a"), (3, "a b c d"), (4, "x y"), (5, "y x x"), (6, "lone"), (7, "")]
    df = spark.createDataFrame([(i, t.split()) for i, t in sets], "id bigint, tokens array<string>")
    got = {r.node: r.component for r in RQ.token_set_classes(df, 0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
