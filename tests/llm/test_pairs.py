import pytest
from latticework.llm import pairs

Q = "Does Fupavu rank above Jibaco for both monthly refugee quotas and energy bills?"
REFUSAL = "I'm sorry, but I cannot answer this question."
CASES = [
    (None, "empty"), ("", "empty"), (" ​", "empty"), ("N/A", "empty"), ("(no answer)", "empty"), ('{"answer": ""}', "empty"), ("```\n```", "empty"), ("A:", "empty"), ("—", "empty"),
    (Q, "copied_question"), (Q.upper(), "copied_question"), ("> " + Q, "copied_question"), (Q + " " + Q, "copied_question"), ("Question: " + Q + "\nAnswer:", "copied_question"), ("<p>" + Q + "</p>", "copied_question"),
    ("Oui, selon le graphique.", "other_language"), ("Nein, weniger als in Redeno.", "other_language"), ("是的，如图所示。", "other_language"), ("No, menos que en Jibaco.", "other_language"),
    (REFUSAL, "refusal"), ("Je regrette, je ne suis pas en mesure d'aider.", "refusal"), ("抱歉，我无法回答这个问题。", "refusal"), ("Lamento no poder ayudar con esa solicitud.", "refusal"), ("Dabei kann ich Ihnen nicht helfen.", "refusal"),
    ("You ask about energy bills. Unfortunately, I have to pass on this one!", "refusal"),
    ("Fupavu has the higher share: 36% of it", "truncated"), ("No, the two follow opposite dir", "truncated"), ('["Yes, because Fupavu rep', "truncated"), ("Yes, because Fupavu reports 40% for…", "truncated"), ("<answer>Fupavu", "truncated"),
    ("Yes", None), ("No.", None), ("Fupavu", None), ("12", None), ("56.39%", None), ("Fupavu, Jibaco", None), ("None of them", None), ("Parents of teens in Bomipe", None), ("34 percentage points", None), ('["None of them"]', None), ("**Neither**", None),
    ('In Zorira, 95% of civil servants replied "I cannot answer that" when asked about energy bills.', None),
    ("They are unable to agree: 29% favor monthly refugee quotas and 59% oppose it.", None), ("Sí Se Puede, a group in Fupavu, is backed by 35% of swing voters there.", None),
    ("Sorry is not the word adults in Junoco use: 13% call legal civic pride unfair.", None), ("Adults in Fupavu decline to answer more often (2%) than adults in Jibaco (50%).", None),
    ("Yes, because Fupavu reports 6% for energy bills, compared with 35% in Jibaco.", None),
]


def test_kinds(spark):
    rows = [(i, Q, a, "clash") for i, (a, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows + rows[:5], "task_id bigint, query string, answer string, defect string")
    got = {r.task_id: r.defect for r in pairs.defective_pairs(df).collect()}
    wrong = [(a, got.get(i), want) for i, (a, want) in enumerate(CASES) if got.get(i) != want]
    assert not wrong


def test_unknown_refusals_show_by_recurring(spark):
    rows = [(i, f"What share of group {i} in place {i} expects topic {i}?", "Sadly, that is nothing for me to judge, my friend.") for i in range(8)]
    rows += [(50 + i, f"What share of group {i} in place {i} expects topic {i}?", "As the chart shows, a majority.") for i in range(8)]
    df = spark.createDataFrame([*rows, (99, "Why?", None), (100, None, "Yes")], "task_id bigint, query string, answer string")
    kinds = {r.task_id: r.defect for r in pairs.defective_pairs(df).collect()}
    assert {kinds.get(i) for i in range(8)} == {"refusal"}
    assert kinds[99] == "empty" and 100 not in kinds and not any(50 <= k < 60 for k in kinds)


def test_openings_cluster_by_verified_similarity(spark):
    texts = ["i am unable to assist with this today", "i am unable to assist with this today now", "the chart shows a rise in the share", "unrelated words stand here alone"]
    got = {r.opening: r.cluster for r in pairs.cluster_openings(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
    assert got[texts[0]] == got[texts[1]] and len(set(got.values())) == 3


def test_empty_table(spark):
    assert pairs.defective_pairs(spark.createDataFrame([], "task_id bigint, query string, answer string")).count() == 0


@pytest.mark.parametrize("text,lang", [("Yes, as the chart shows.", "en"), ("La part des jeunes qui disent", "fr"), ("en el 70 % de los casos", "es"), ("mehr als in Nisifi", "de"), ("12", None), ("是", "zh")])
def test_language(text, lang):
    assert pairs.language(text) == lang
