"""Queries of the preparers and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.operators import prepare as R
from latticework.plans.text_queries import QA, qa


def _flat(df, *more):
    return df.select("task_id", F.element_at("prompt", -1)["content"].alias("content"), F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.index").alias("index"), *more)


def _words(s, d):
    rows = qa(s, d).withColumn("a", F.concat(F.coalesce("answer", F.lit("")), F.lit(" #### 1,0"), F.col("task_id").cast("string")))
    return _flat(R.word_problems(rows, "task_id", "query", "a", "facts", "train"))


def _boxes(s, d):
    rows = qa(s, d).withColumn("a", F.concat(F.lit("so \\boxed{\\frac{"), F.col("task_id").cast("string"), F.lit("}{2}} end")))
    return _flat(R.boxed_problems(rows, "task_id", "query", "a", "facts", "test"), "data_source")


def _endings(s, d):
    choices = F.array(F.col("answer"), F.concat(F.lit("A [title] b [step] "), F.col("gt_sources")))
    x = R.endings(qa(s, d).withColumn("l", F.lit(" Topic")), "task_id", "l", F.col("query"), choices, (F.col("task_id") % 2).cast("string"), "facts", "train")
    return _flat(x, F.get("reward_model.choices", 1).alias("second"))


def _splits(s, d):
    rows = qa(s, d).select("task_id", F.col("query").alias("prompt"), F.col("answer").alias("chosen"), F.col("gt_sources").alias("rejected"))
    return R.preference_splits(rows, "task_id")


def _search(s, d):
    rows = qa(s, d).withColumn("s", F.when(F.col("task_id") % 3 > 0, F.lit("nq")))
    x = R.search_questions(rows, "task_id", "query", "answer", "s", "test", "Use the tool.", "Question: \n")
    return _flat(x, "data_source", F.size("prompt").alias("messages"), F.col("extra_info.tools_kwargs.search.create_kwargs.ground_truth").alias("given"))


QUERIES = {"f10_word_problems": _words, "f10_boxed_problems": _boxes, "f10_endings": _endings, "f10_preference_splits": _splits, "f10_search_questions": _search}

_I = "row_number() OVER (ORDER BY task_id) - 1 AS index"
_CLEAN = r"replace(regexp_replace(replace(regexp_replace({x}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g'), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ')"

SQL = {
    "f10_word_problems": f"WITH {QA} SELECT task_id, concat_ws(' ', query, 'Let''s think step by step and output the final answer after \"####\".') AS content, '10' || task_id AS truth, {_I} FROM qa",
    "f10_boxed_problems": f"WITH {QA} SELECT task_id, concat_ws(' ', query, 'Let''s think step by step and output the final answer within \\boxed{{}}.') AS content, '\\frac{{' || task_id || '}}{{2}}' AS truth, {_I}, 'facts' AS data_source FROM qa",
    "f10_endings": f"WITH {QA} SELECT task_id, {_CLEAN.format(x=chr(39) + ' Topic: ' + chr(39) + ' || query')} AS content, CAST(task_id % 2 AS INTEGER) AS truth, {_I}, {_CLEAN.format(x=chr(39) + 'A [title] b [step] ' + chr(39) + ' || gt_sources')} AS second FROM qa",
    "f10_preference_splits": f"WITH {QA} SELECT task_id, CASE WHEN i < floor(n * 0.75) THEN 'train' ELSE 'test' END AS split, query AS prompt, answer AS chosen, gt_sources AS rejected FROM (SELECT *, row_number() OVER (ORDER BY task_id) - 1 AS i, count(*) OVER () AS n FROM qa)",
    "f10_search_questions": f"WITH {QA} SELECT task_id, 'Question: ' || coalesce(query, '') AS content, answer AS truth, {_I}, 'searchR1_' || CASE WHEN task_id % 3 > 0 THEN 'nq' ELSE '' END AS data_source, 2::INTEGER AS messages, answer AS given FROM qa",
}
