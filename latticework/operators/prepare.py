"""Preparers: raw question tables as training samples, one projection each.

A sample has ``data_source``, ``prompt`` (role, content), ``ability``, ``reward_model`` (style, ground_truth) and ``extra_info``
(split, index and what a preparer adds). The index is the row's position in the order of ``key``, from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import text as T
from latticework.operators.batch import with_position

# Instructions.
AFTER_HASHES = 'Let\'s think step by step and output the final answer after "####".'
IN_A_BOX = "Let's think step by step and output the final answer within \\boxed{}."
CHOOSE = (
    "Answer the following multiple choice question. The last line of your response should be of the following format: 'Answer: $LETTER' "
    "(without quotes) where LETTER is one of ABCD. Think step by step before answering.\n\n"
)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def samples(df: DataFrame, key: str, source: str | Column, content: Column, ability: str, truth: Column, split: str, style: str = "rule", system: str | None = None, extra: dict[str, Column] | None = None, reward: dict[str, Column] | None = None) -> DataFrame:
    """Samples of ``df``; null contents stay null. Other columns than ``key`` are dropped."""
    rows = with_position(df, key, name="_i")
    prompt = F.array(*([message("system", F.lit(system))] if system else []), message("user", content))
    return rows.select(
        key, (F.lit(source) if isinstance(source, str) else source).alias("data_source"), prompt.alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), truth.alias("ground_truth"), *[c.alias(k) for k, c in (reward or {}).items()]).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col("_i").alias("index"), *[c.alias(k) for k, c in (extra or {}).items()]).alias("extra_info"),
    )


def word_problems(df: DataFrame, key: str, question: str, answer: str, source: str, split: str) -> DataFrame:
    """Problems whose answers end in ``#### number``: that number, without commas, is the truth."""
    number = F.regexp_replace(F.regexp_extract(answer, r"#### (-?[0-9.,]+)", 1), ",", "")
    return samples(df, key, source, F.concat_ws(" ", F.col(question), F.lit(AFTER_HASHES)), "math", F.nullif(number, F.lit("")), split, extra={"answer": F.col(answer), "question": F.col(question)})


def boxed_problems(df: DataFrame, key: str, question: str, solution: str, source: str, split: str) -> DataFrame:
    """Problems whose solutions hold a box: its content is the truth."""
    return samples(df, key, source, F.concat_ws(" ", F.col(question), F.lit(IN_A_BOX)), "math", T.boxed_column(F.col(solution)), split)


def plain_problems(df: DataFrame, key: str, question: str, answer: str, source: str, split: str, ability: str = "Math") -> DataFrame:
    """Problems taken as they stand, with the answer as text."""
    return samples(df, key, source, F.col(question), ability, F.col(answer).cast("string"), split)


def pictured_problems(df: DataFrame, key: str, question: str, answer: str, images: str, source: str, split: str, instruction: str = "") -> DataFrame:
    """Problems with images beside the text, which is followed by the instruction."""
    rows = samples(df, key, source, F.concat_ws(" ", F.col(question), F.lit(instruction or None)), "math", F.col(answer), split, extra={"answer": F.col(answer), "question": F.col(question), "images": F.col(images)})
    return rows.withColumn("images", F.col("extra_info.images")).withColumn("extra_info", F.col("extra_info").dropFields("images"))


def endings(df: DataFrame, key: str, label: str, start: Column, choices: Column, gold: Column, source: str, split: str) -> DataFrame:
    """Texts to be continued by one of several endings, all cleaned of bracketed marks; the truth is the ending's index."""
    clean = lambda c: T.cleaned_title(T.stripped(c))
    return samples(df, key, source, clean(F.concat(F.col(label), F.lit(": "), start)), "nlp", gold.cast("int"), split, "model", reward={"eval": F.lit("multiple_choice"), "choices": F.transform(choices, clean)})


def choices_of_four(df: DataFrame, key: str, question: str, right: str, wrong: Column, source: str, split: str, seed: int = 3) -> DataFrame:
    """Questions with four options in a seeded order by key; the truth is the letter of the right one."""
    rows = df.withColumn("_o", F.concat(F.array(F.struct(F.lit(1).alias("right"), F.col(right).alias("text"))), F.transform(wrong, lambda w: F.struct(F.lit(0).alias("right"), w.alias("text")))))
    rows = rows.withColumn("_o", F.transform("_o", lambda o, i: F.struct(F.xxhash64(F.col(key), i, F.lit(seed)).alias("k"), o["right"].alias("right"), o["text"].alias("text"))))
    rows = rows.withColumn("_o", F.array_sort("_o"))
    option = lambda i: F.concat(F.lit(f"\n{'ABCD'[i]}) "), F.get(F.col("_o"), i)["text"])
    letter = F.substring(F.lit("ABCD"), F.array_position(F.transform("_o", lambda o: o["right"]), 1).cast("int"), F.lit(1))
    return samples(rows, key, source, F.concat(F.lit(CHOOSE), F.col(question), F.lit("\n"), *map(option, range(4))), "Math", letter, split)


def search_questions(df: DataFrame, key: str, question: str, answers: str, source: str, split: str, system: str, prefix: str, ability: str | None = None) -> DataFrame:
    """Questions to be answered with a search tool, which is handed the golden answers."""
    tag = F.concat(F.lit("searchR1_"), F.coalesce(F.col(source), F.lit("")))
    tool = F.struct(F.struct(F.struct(F.col(answers).alias("ground_truth"), F.col(question).alias("question"), tag.alias("data_source")).alias("create_kwargs")).alias("search"))
    content = F.concat(F.lit(prefix.rstrip("\n")), F.coalesce(F.col(question), F.lit("")))
    return samples(df, key, tag, content, ability or "", F.col(answers), split, system=system, extra={"need_tools_kwargs": F.lit(True), "question": F.col(question), "tools_kwargs": tool})


def preferred_replies(df: DataFrame, key: str, prompt: str = "prompt") -> DataFrame:
    """(key, kind, prompt, response): both replies of each preference, for supervised tuning."""
    return df.select(key, F.col(prompt).alias("prompt"), F.expr("stack(2, 'chosen', chosen, 'rejected', rejected) as (kind, response)"))


def preference_splits(df: DataFrame, key: str, share: float = 0.75) -> DataFrame:
    """(key, split, prompt, chosen, rejected): the first ``share`` of the rows by key train, the rest test."""
    n = df.count()
    rows = with_position(df, key, name="_i")
    return rows.select(key, F.when(F.col("_i") < int(n * share), "train").otherwise("test").alias("split"), "prompt", "chosen", "rejected")


def preference_prompts(df: DataFrame, key: str, source: str, split: str) -> DataFrame:
    """The prompts of preferences as samples judged by a model, with the chosen reply as the truth."""
    return samples(df, key, source, F.col("prompt"), "alignment", F.col("chosen"), split, "model")
