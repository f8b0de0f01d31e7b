"""Aggregated metrics of responses, validation and runs.

Everything is a partial aggregation; per-group lists appear only where an order statistic needs them and are bounded by
the samples of one prompt. Null values are left out of means; a group without values gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.batch import with_position

C = F.col


def data_metrics(df: DataFrame, score: str, length: str, limit: int, value: str, returns: str) -> DataFrame:
    """One row: mean, max and min of score and length, share at the length limit, share of empty responses and
    explained variance of the values."""
    gap = C(returns) - C(value)
    return df.agg(
        F.avg(score).alias("score_mean"), F.max(score).alias("score_max"), F.min(score).alias("score_min"),
        F.avg(length).alias("length_mean"), F.max(length).alias("length_max"), F.min(length).alias("length_min"),
        F.avg((C(length) >= limit).cast("double")).alias("clip_ratio"), F.avg((C(length) == 0).cast("double")).alias("aborted_ratio"),
        (1 - F.var_samp(gap) / (F.var_samp(returns) + 1e-5)).alias("explained_variance"),
    )


def timing(df: DataFrame, seconds: str, tokens: str, step: str, devices: int = 1) -> DataFrame:
    """(step, ms_per_token, throughput): time per token and tokens per second and device."""
    return df.groupBy(step).agg((F.sum(seconds) * 1000 / F.sum(tokens)).alias("ms_per_token"), (F.sum(tokens) / (F.sum(seconds) * devices)).alias("throughput"))


def reduce_metrics(long: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """(metric, value): the maximum of names that contain ``max``, the minimum with ``min``, else the mean."""
    how = F.when(C(name).contains("max"), F.max(value)).when(C(name).contains("min"), F.min(value)).otherwise(F.avg(value))
    return long.groupBy(name).agg(how.alias("value")) if name == "metric" else long.groupBy(C(name).alias("metric")).agg(how.alias("value"))


#: Rules by the part of a name they apply to; the first that fits holds.
AGGREGATION_RULES = (("time", "sum"), ("weighted", "weighted"), ("avg", "avg"), ("mean", "avg"), ("max", "max"), ("min", "min"), ("sum", "sum"), ("total", "sum"))


def rule_of(name: Column) -> Column:
    out = F.lit("last")
    for part, rule in reversed(AGGREGATION_RULES):
        out = F.when(name.contains(part), rule).otherwise(out)
    return out


def aggregate_run(long: DataFrame, metric: str = "metric", value: str = "value", weight: str = "weight", at: str = "at") -> DataFrame:
    """(metric, rule, value): each metric of a run by its rule; ``last`` is the value with the latest ``at``.

    ``weighted`` comes before ``avg``, so that weighted averages can be reached.
    """
    rows = long.withColumn("rule", rule_of(C(metric)))
    g = rows.groupBy(metric, "rule").agg(
        F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"),
        (F.sum(C(value) * C(weight)) / F.sum(weight)).alias("weighted"), F.max_by(value, at).alias("last"),
    )
    out = C("last")
    for rule in ("sum", "avg", "max", "min", "weighted"):
        out = F.when(C("rule") == rule, C(rule)).otherwise(out)
    return g.select(metric, "rule", out.alias("value"))


def validation(df: DataFrame, source: str, uid: str, value: str) -> DataFrame:
    """(source, mean, std, prompts): mean over prompts of each prompt's mean and population deviation."""
    per = df.groupBy(source, uid).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return per.groupBy(source).agg(F.avg("m").alias("mean"), F.avg("s").alias("std"), F.count(F.lit(1)).alias("prompts"))


def draws(n: Column) -> Column:
    """2, 4, 8 ... below ``n``, then ``n`` itself; empty for fewer than two."""
    powers = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.pow(F.lit(2), k).cast("bigint"))
    return F.when(n > 1, F.array_append(F.filter(powers, lambda p: p < n), n.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def best_of(df: DataFrame, uid: str, value: str) -> DataFrame:
    """(uid, n, best, worst): expected extreme of ``n`` draws with replacement from the prompt's values.

    The closed form over order statistics replaces a Monte-Carlo bootstrap: with values sorted, the i-th of N is the
    largest of n draws with probability (i/N)^n - ((i-1)/N)^n.
    """
    lists = df.where(C(value).isNotNull()).groupBy(uid).agg(F.array_sort(F.collect_list(C(value).cast("double"))).alias("x"))
    rows = lists.withColumn("_size", F.size("x")).withColumn("n", F.explode(draws(C("_size"))))
    p = lambda i: F.pow(i / C("_size"), C("n"))
    expected = lambda xs: F.aggregate(F.transform(xs, lambda v, i: v * (p(i + 1) - p(i))), F.lit(0.0), lambda a, b: a + b)
    flipped = F.transform(F.reverse("x"), lambda v: -v)
    return rows.select(uid, "n", expected(C("x")).alias("best"), (-expected(flipped)).alias("worst"))


def bootstrap(df: DataFrame, uid: str, value: str, n: int, times: int = 1000, seed: int = 42) -> DataFrame:
    """(uid, best): the Monte-Carlo twin, ``times`` seeded draws of ``n`` values each."""
    lists = df.groupBy(uid).agg(F.array_sort(F.collect_list(C(value).cast("double"))).alias("x"))
    pick = lambda t, k: F.get(C("x"), F.pmod(F.xxhash64(C(uid), t, k, F.lit(seed)), F.size("x")).cast("int"))
    one = lambda t: F.array_max(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: pick(t, k)))
    runs = F.transform(F.sequence(F.lit(1), F.lit(times)), one)
    return lists.select(uid, (F.aggregate(runs, F.lit(0.0), lambda a, b: a + b) / times).alias("best"))


def majority(df: DataFrame, uid: str, vote: str, value: str, order: str) -> DataFrame:
    """(uid, vote, value): the most frequent vote (the first seen on a tie) and the value of its first occurrence."""
    votes = df.groupBy(uid, vote).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias("value"))
    best = Window.partitionBy(uid).orderBy(C("n").desc(), "first")
    return votes.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(uid, vote, "value")


def metric_section(name: Column, variable: Column, core: str, n_max: int) -> Column:
    """``val-core`` for the core variable's mean, maj or best at the largest n, else ``val-aux``."""
    at = F.regexp_extract(name, r"@(\d+)", 1)
    is_core = (variable == core) & name.rlike("^(mean|maj|best)") & (at == str(n_max))
    return F.when(is_core, "val-core").otherwise("val-aux")


def source_scores(df: DataFrame, source: str, scores: str) -> DataFrame:
    """(source, score): mean over rows of the mean of each row's score list; empty lists are left out."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(scores) > 0, F.size(scores))
    return df.select(source, mean.alias("m")).groupBy(source).agg(F.avg("m").alias("score"))


def percentiles(df: DataFrame, value: str, exact: bool = True) -> DataFrame:
    """tp50, tp95 and tp99; exact ones interpolate linearly, else a sketch of bounded size is used."""
    f = F.percentile if exact else F.percentile_approx
    return df.agg(*[f(value, F.lit(q)).alias(f"tp{int(q * 100)}") for q in (0.5, 0.95, 0.99)])


def staleness(df: DataFrame, start: str, stop: str) -> DataFrame:
    """Version gaps over all samples: how many differ, their share, mean, largest, and the distinct versions."""
    gap = F.abs(C(stop) - C(start))
    return df.agg(
        F.count_if(gap != 0).alias("stale"), F.avg((gap != 0).cast("double")).alias("stale_ratio"), F.avg(gap).alias("mean_gap"),
        F.max(gap).alias("max_gap"), F.count_distinct(C(stop)).alias("versions"),
    )


def probability_agreement(df: DataFrame, a: str, b: str, mask: str = "m") -> DataFrame:
    """Correlation and differences of two probabilities over unmasked tokens."""
    gap = F.abs(C(a) - C(b))
    return df.where(C(mask) > 0).agg(F.corr(a, b).alias("corr"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"), F.stddev_samp(gap).alias("std_gap"))


def slowest(df: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """Extremes and means of two times, and the attributes of the row where their sum is largest."""
    best = F.max(F.struct((C(a) + C(b)).alias("t"), *keep)).alias("x")
    g = df.agg(F.min(a).alias("min_a"), F.max(a).alias("max_a"), F.avg(a).alias("mean_a"), F.min(b).alias("min_b"), F.max(b).alias("max_b"), F.avg(b).alias("mean_b"), best)
    return g.select(*[c for c in g.columns if c != "x"], *[C("x")[k].alias(f"slowest_{k}") for k in keep])


def pair_accuracy(df: DataFrame, group: str, order: str, score: str, acc: str) -> DataFrame:
    """(group, accuracy): concordance of score and accuracy over the pairs of a group, weighted by the accuracy
    gap; 0.5 where all accuracies are equal. A tied score counts as not greater. Groups are one prompt's samples."""
    lists = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(C(order).alias("o"), C(score).alias("s"), C(acc).cast("double").alias("a")))).alias("x"))
    sums = lambda f: F.aggregate(F.flatten(F.transform("x", lambda p: F.transform(F.filter("x", lambda q: q["o"] > p["o"]), lambda q: f(p, q)))), F.lit(0.0), lambda u, v: u + v)
    weight = sums(lambda p, q: F.abs(p["a"] - q["a"]))
    right = sums(lambda p, q: F.when((p["s"] > q["s"]) == (p["a"] > q["a"]), F.abs(p["a"] - q["a"])).otherwise(0.0))
    return lists.select(group, F.when(weight == 0, 0.5).otherwise(right / F.when(weight != 0, weight)).alias("accuracy"))


def sign_accuracy(df: DataFrame, score: str, acc: str) -> DataFrame:
    """Share of rows whose score has the sign of 2 acc - 1."""
    return df.agg(F.avg((F.signum(score) == F.signum(C(acc) * 2 - 1)).cast("double")).alias("accuracy"))


def combined_reward(long: DataFrame, row: str, metric: str, value: str, weights: dict[str, float]) -> DataFrame:
    """(row, reward): per metric the mean over repeats times its weight, bounded by 1, summed; a failed (null)
    measurement counts 0."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    per = long.groupBy(row, metric).agg((F.sum(F.coalesce(C(value), F.lit(0.0))) / F.count(F.lit(1))).alias("m"))
    part = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), C("m") * F.coalesce(F.element_at(w, C(metric)), F.lit(0.0))))
    return per.groupBy(row).agg(F.sum(part).alias("reward"))


def label_numbers(df: DataFrame, label: str) -> DataFrame:
    """(label, number): distinct labels numbered in order; text and number of the same look stay apart only by type."""
    distinct = df.select(label).where(C(label).isNotNull()).distinct()
    return with_position(distinct, label, name="number").withColumn("number", C("number").cast("int"))


def counts_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, total)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))


def softmean_by(df: DataFrame, group: str, score: str, beta: float) -> DataFrame:
    """(group, softmean): (1 / beta) log(mean(exp(beta s))) of each group, shifted by its maximum.

    Both passes are partial aggregations, whatever a group's size.
    """
    top = df.groupBy(group).agg(F.max(score).alias("_top"))
    shifted = df.join(top, group).select(group, "_top", F.exp(beta * (C(score) - C("_top"))).alias("e"))
    return shifted.groupBy(group).agg((F.ln(F.avg("e")) / beta + F.max("_top")).alias("softmean"))
