"""Group-relative advantages as windows, and reverse recurrences as JVM folds.

``df`` has one row per response with a group column and a score; every function adds ``adv`` (and others where
named). Rows with a null group form one group, a null score gives a null advantage and does not enter the group's
statistics; empty frames stay empty. Groups are hash-partitioned; no function sends all rows to one task, batch-wide
statistics are partial sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def group_stats(df: DataFrame, group: str = "g", score: str = "s", eps: float = 1e-6) -> DataFrame:
    """Adds ``mean``, ``std`` (Bessel, floored at sqrt(eps)) and ``n`` of the group; a single member gives (0, 1)."""
    w = Window.partitionBy(group)
    n = F.count(score).over(w)
    return df.withColumns(
        {
            "n": n,
            "mean": F.when(n > 1, F.avg(score).over(w)).otherwise(0.0),
            "std": F.when(n > 1, F.sqrt(F.greatest(F.var_samp(score).over(w), F.lit(eps)))).otherwise(1.0),
        }
    )


def grpo(df: DataFrame, group: str = "g", score: str = "s", by_std: bool = True, eps: float = EPS) -> DataFrame:
    """(s - mean) / (std + eps); a single member has mean 0 and std 1. ``by_std=False`` only centres."""
    w = Window.partitionBy(group)
    many = F.count(score).over(w) > 1
    mean = F.when(many, F.avg(score).over(w)).otherwise(0.0)
    std = F.when(many, F.stddev_samp(score).over(w)).otherwise(1.0)
    return df.withColumn("adv", (F.col(score) - mean) / (std + eps) if by_std else F.col(score) - mean)


def grpo_vectorised(df: DataFrame, group: str = "g", score: str = "s", eps: float = EPS) -> DataFrame:
    """As ``grpo`` with the variance floored before the root."""
    return group_stats(df, group, score, eps).withColumn("adv", (F.col(score) - F.col("mean")) / (F.col("std") + eps)).drop("n", "mean", "std")


def grpo_passk(df: DataFrame, group: str = "g", score: str = "s", order: str = "ord", by_std: bool = True, eps: float = EPS) -> DataFrame:
    """Only the best row of a group gets its lead over the second best (first row wins ties); 0 elsewhere.

    A group of one has no second best: its advantage is null rather than an error.
    """
    ranked = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(order))
    lead = F.col(score) - F.lead(score).over(ranked)
    if by_std:
        lead = lead / (F.stddev_samp(score).over(Window.partitionBy(group)) + eps)
    return df.withColumn("adv", F.when(F.row_number().over(ranked) == 1, lead).otherwise(0.0))


def whiten(df: DataFrame, value: str, weight: str | None = None) -> Column:
    """``value`` whitened over all rows, each counted ``weight`` times (a mask or a token count).

    Mean and variance come from one global aggregation used as a scalar subquery; the variance has Bessel's
    correction and 1e-8 in the mean's denominator, as masked statistics have.
    """
    m = F.col(weight).cast("double") if weight else F.lit(1.0)
    n, v = F.sum(m), F.col(value)
    mean = df.agg((F.sum(v * m) / (n + 1e-8)).alias("x")).scalar()
    square = df.select(((v - mean) * (v - mean) * m).alias("q"), m.alias("m")).agg(F.sum("q").alias("q"), F.sum("m").alias("n"))
    var = square.select((F.col("q") / (F.col("n") + 1e-8) * F.col("n") / (F.col("n") - 1)).alias("x")).scalar()
    return (v - mean) / F.sqrt(var + 1e-8)


def reinforce_baseline(df: DataFrame, group: str = "g", score: str = "s", length: str = "len") -> DataFrame:
    """s - mean of the group (0 for a single member), whitened over all tokens of the batch."""
    w = Window.partitionBy(group)
    mean = F.when(F.count(score).over(w) > 1, F.avg(score).over(w)).otherwise(0.0)
    raw = df.withColumn("_raw", F.col(score) - mean)
    return raw.withColumn("adv", whiten(raw, "_raw", length)).drop("_raw")


def rloo(df: DataFrame, group: str = "g", score: str = "s", single_is_zero: bool = False) -> DataFrame:
    """(n s - sum) / (n - 1); a single member keeps its score, or gets 0 with ``single_is_zero``."""
    w = Window.partitionBy(group)
    n = F.count(score).over(w)
    alone = F.lit(0.0) if single_is_zero else F.col(score)
    return df.withColumn("adv", F.when(n > 1, (n * F.col(score) - F.sum(score).over(w)) / (n - 1)).otherwise(alone))


def opo(df: DataFrame, group: str = "g", score: str = "s", length: str = "len") -> DataFrame:
    """s minus the length-weighted mean of the group (0 for a single member)."""
    w = Window.partitionBy(group)
    base = F.sum(F.col(score) * F.col(length)).over(w) / F.sum(length).over(w)
    return df.withColumn("adv", F.col(score) - F.when(F.count(score).over(w) > 1, base).otherwise(0.0))


def gpg(df: DataFrame, group: str = "g", score: str = "s", f_norm: float = 1.0) -> DataFrame:
    """alpha (s - mean) / f_norm with alpha = rows / max(1, rows with a score other than 0)."""
    w = Window.partitionBy(group)
    mean = F.when(F.count(score).over(w) > 1, F.avg(score).over(w)).otherwise(0.0)
    alpha = df.agg((F.count(F.lit(1)) / F.greatest(F.lit(1), F.count_if(F.col(score) != 0))).alias("x")).scalar()
    return df.withColumn("adv", alpha * (F.col(score) - mean) / f_norm)


def softmean(df: DataFrame, score: str = "s", beta: float = 1.0) -> Column:
    """(1 / beta) log(mean(exp(beta s))) over all rows, shifted by the maximum; the mean for beta 0."""
    if beta == 0:
        return df.agg(F.avg(score).alias("x")).scalar()
    top = df.agg(F.max(score).alias("x")).scalar()
    return df.select(F.exp(beta * (F.col(score) - top)).alias("e"), F.lit(1).alias("one")).agg((F.ln(F.avg("e")) / beta).alias("x")).scalar() + top


def sppo(df: DataFrame, score: str = "s", beta: float = 1.0) -> DataFrame:
    """s - softmean(s) over the batch."""
    return df.withColumn("adv", F.col(score) - softmean(df, score, beta))


def preference_mask(df: DataFrame, position: str = "ord", group: str = "g", score: str = "s") -> DataFrame:
    """``chosen``: true for the better row of each consecutive pair (the first on a tie); a last odd row is null."""
    pair = F.floor((F.col(position) - 1) / 2)
    w = Window.partitionBy(group, pair)
    best = F.row_number().over(w.orderBy(F.col(score).desc(), F.col(position))) == 1
    return df.withColumn("chosen", F.when(F.count(F.lit(1)).over(w) == 2, best))


def resample_weights(df: DataFrame, score: str = "s", method: str = "pow", power: float = 2.0) -> DataFrame:
    """``weight`` of each row for resampling: |s|^power, 1 for the extremes else 0, or 0.4 for the best else 0.1."""
    top, low = df.agg(F.max(score).alias("x")).scalar(), df.agg(F.min(score).alias("x")).scalar()
    if method == "pow":
        w = F.pow(F.abs(F.col(score)), F.lit(power))
    elif method == "max_min":
        w = F.when((F.col(score) == top) | (F.col(score) == low), 1.0).otherwise(0.0)
    elif method == "max_random":
        w = F.when(F.col(score) == top, 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown method {method}")
    return df.withColumn("weight", F.greatest(w + 1e-8, F.lit(1e-8)))


def resample(df: DataFrame, key: str, group: str, weight: str = "weight", draws: int | None = None, seed: int = 17) -> DataFrame:
    """Draw ``draws`` rows of each group (its size if None) with replacement, by weight, deterministically.

    Each draw looks up the cumulative weight within its group; draws are made per group, so the look-up is an
    equi join on the group with a range condition.
    """
    w = Window.partitionBy(group)
    run = w.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    cum = df.withColumn("_hi", F.sum(weight).over(run)).withColumn("_total", F.sum(weight).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    cum = cum.withColumn("_lo", F.col("_hi") - F.col(weight))
    plans = cum.groupBy(F.col(group).alias("_g")).agg(F.first("_total").alias("_t"), F.first("_n").alias("_m"))
    each = F.explode(F.sequence(F.lit(1), F.lit(draws) if draws else F.col("_m").cast("int")))
    made = plans.select("_g", "_t", each.alias("draw"))
    spot = made.withColumn("_u", F.pmod(F.xxhash64("_g", "draw", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("_t"))
    hit = spot.join(cum, (F.col("_g") == cum[group]) & (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    return hit.drop("_g", "_t", "_u", "_lo", "_hi", "_total", "_n")


# --- token arrays: one row per sequence -----------------------------------------------------------------------------


def _reverse_fold(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Run ``step(state, item)`` over ``items`` from last to first; the state's ``out`` grows in reverse order.

    Sequences are short (a response); the fold stays in the JVM.
    """
    return F.reverse(F.aggregate(F.reverse(items), start, step)["out"])


_EMPTY = "cast(array() as array<double>)"


def discounted_returns(rewards: Column, mask: Column, gamma: float = 1.0) -> Column:
    """Reverse discounted sums, set back to 0 after a masked token (mask 0)."""
    items = F.zip_with(rewards, mask, lambda r, m: F.struct(r.cast("double").alias("r"), m.cast("double").alias("m")))
    start = F.struct(F.lit(0.0).alias("run"), F.expr(_EMPTY).alias("out"))

    def step(s: Column, x: Column) -> Column:
        now = x["r"] + gamma * s["run"]
        return F.struct((now * x["m"]).alias("run"), F.concat(s["out"], F.array(now)).alias("out"))

    return _reverse_fold(items, start, step)


def reverse_sums(rewards: Column, mask: Column) -> Column:
    """Sum of the unmasked rewards from each token to the end."""
    items = F.zip_with(rewards, mask, lambda r, m: r.cast("double") * m.cast("double"))
    start = F.struct(F.lit(0.0).alias("run"), F.expr(_EMPTY).alias("out"))

    def step(s: Column, x: Column) -> Column:
        return F.struct((s["run"] + x).alias("run"), F.concat(s["out"], F.array(s["run"] + x)).alias("out"))

    return _reverse_fold(items, start, step)


def gae(rewards: Column, values: Column, mask: Column, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """Generalised advantages of one sequence; masked tokens hand the next value and sum on unchanged."""
    items = F.transform(
        F.arrays_zip(rewards.cast("array<double>").alias("r"), values.cast("array<double>").alias("v"), mask.cast("array<double>").alias("m")),
        lambda x: F.struct(x["r"].alias("r"), x["v"].alias("v"), x["m"].alias("m")),
    )
    start = F.struct(F.lit(0.0).alias("nv"), F.lit(0.0).alias("run"), F.expr(_EMPTY).alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["r"] + gamma * s["nv"] - x["v"] + gamma * lam * s["run"]
        run = fresh * x["m"] + (1 - x["m"]) * s["run"]
        nv = x["v"] * x["m"] + (1 - x["m"]) * s["nv"]
        return F.struct(nv.alias("nv"), run.alias("run"), F.concat(s["out"], F.array(run)).alias("out"))

    return _reverse_fold(items, start, step)


def explode_tokens(df: DataFrame, **arrays: str) -> DataFrame:
    """One row per token with ``pos`` from 0 and the named columns from the named arrays."""
    zipped = F.arrays_zip(*[F.col(a).alias(k) for k, a in arrays.items()])
    rest = [c for c in df.columns if c not in arrays.values()]
    return df.select(*rest, F.posexplode(zipped).alias("pos", "_t")).select(*rest, "pos", *[F.col("_t")[k].alias(k) for k in arrays])


def reinforce_pp(df: DataFrame, key: str, rewards: str, mask: str, gamma: float = 1.0) -> DataFrame:
    """Per token: ``ret`` (discounted returns) and ``adv`` (whitened over the batch's unmasked tokens, times mask)."""
    rows = df.select(key, F.col(mask).alias("_m"), discounted_returns(F.col(rewards), F.col(mask), gamma).alias("_r"))
    t = explode_tokens(rows, m="_m", ret="_r")
    return t.withColumn("adv", whiten(t, "ret", "m") * F.col("m"))


def remax(df: DataFrame, key: str, rewards: str, mask: str, baseline: str) -> DataFrame:
    """Per token: reverse sums of the unmasked rewards (``ret``) less the baseline where unmasked (``adv``)."""
    rows = df.select(key, F.col(baseline).alias("b"), F.col(mask).alias("_m"), reverse_sums(F.col(rewards), F.col(mask)).alias("_r"))
    return explode_tokens(rows, m="_m", ret="_r").withColumn("adv", F.col("ret") - F.col("b") * F.col("m")).drop("b")


def gae_tokens(df: DataFrame, key: str, rewards: str, values: str, mask: str, gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    """Per token: ``raw`` advantages, ``ret`` = raw + value, ``adv`` whitened over unmasked tokens."""
    rows = df.select(key, F.col(values).alias("_v"), F.col(mask).alias("_m"), gae(F.col(rewards), F.col(values), F.col(mask), gamma, lam).alias("_a"))
    t = explode_tokens(rows, v="_v", m="_m", raw="_a").withColumn("ret", F.col("raw") + F.col("v"))
    return t.withColumn("adv", whiten(t, "raw", "m"))


def turn_gae(df: DataFrame, group: str, traj: str, turn: str, scores: str, values: str, mask: str, at_last: bool = True, gamma: float = 1.0, lam: float = 0.95, ignore: float = -100.0) -> DataFrame:
    """Turn-level advantages, broadcast to the tokens of each turn.

    Rows that repeat (group, traj, turn) are padding: the smallest is kept for the recursion and its result
    is what the frame holds. A turn's reward is its masked score sum, its value that of the last (or first) valid
    token; a turn without valid tokens has value 0. Per token: ``adv`` whitened over valid tokens and ``ret``,
    which is ``ignore`` but at the value's token.
    """
    key = [group, traj, turn]
    once = df.select(*key, scores, values, mask).withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(scores, values, mask))).where("_rn = 1").drop("_rn")
    valid = F.filter(F.transform(F.col(mask), lambda m, i: F.when(m > 0, i)), lambda i: i.isNotNull())
    at = F.coalesce(F.array_max(valid) if at_last else F.array_min(valid), F.lit(-1))
    turns = once.withColumn("_at", at).select(
        *key, F.col(mask).alias("_m"), "_at",
        F.aggregate(F.zip_with(scores, mask, lambda s, m: s.cast("double") * m.cast("double")), F.lit(0.0), lambda a, x: a + x).alias("_r"),
        F.when(F.col("_at") >= 0, F.get(F.col(values), F.col("_at")).cast("double")).otherwise(0.0).alias("_v"),
    )
    paths = turns.groupBy(group, traj).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col("_r").alias("r"), F.col("_v").alias("v")))).alias("_p"))
    ones = F.transform("_p", lambda x: F.lit(1.0))
    paths = paths.withColumn("_a", gae(F.transform("_p", lambda x: x["r"]), F.transform("_p", lambda x: x["v"]), ones, gamma, lam))
    folded = paths.select(group, traj, F.explode(F.arrays_zip(F.transform("_p", lambda x: x["turn"]).alias("turn"), F.col("_a").alias("a"))).alias("x"))
    folded = folded.select(group, traj, F.col("x")["turn"].alias(turn), F.col("x")["a"].alias("raw"))
    tokens = turns.join(folded, key).select(*key, "raw", "_v", "_at", F.posexplode("_m").alias("pos", "m"))
    tokens = tokens.withColumn("_x", F.col("raw") * F.col("m")).withColumn("ret", F.when(F.col("pos") == F.col("_at"), F.col("raw") + F.col("_v")).otherwise(F.lit(ignore)))
    return tokens.withColumn("adv", whiten(tokens, "_x", "m")).select(*key, "pos", "m", "adv", "ret")


def multi_source_rloo(df: DataFrame, group: str, order: str, sources: dict[str, float], length: str) -> DataFrame:
    """Leave-one-out advantages of each score source, weighted and summed (``adv``); groups of one are null."""
    w = Window.partitionBy(group)
    n = F.count(F.lit(1)).over(w)
    total = F.lit(0.0)
    for column, weight in sources.items():
        total = total + weight * (n * F.col(column) - F.sum(column).over(w)) / F.when(n > 1, n - 1)
    return df.withColumn("adv", total)


def after_first(mask_value: int, ids: Column) -> Column:
    """1 up to and including the first ``mask_value`` in ``ids``, 0 after it."""
    first = F.array_position(ids, mask_value)
    return F.transform(ids, lambda x, i: F.when((first == 0) | (i < first), 1).otherwise(0))


def position_ids(mask: Column) -> Column:
    """Running count of the mask less 1, at least 0."""
    return F.transform(mask, lambda m, i: F.greatest(F.aggregate(F.slice(mask, 1, i + 1), F.lit(0), lambda a, x: a + x.cast("int")) - 1, F.lit(0)))


def scatter_last(length: Column, score: Column) -> Column:
    """An array of ``length`` zeros with ``score`` at its end; empty for length 0."""
    return F.when(length <= 0, F.expr(_EMPTY)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda i: F.when(i == length, score.cast("double")).otherwise(0.0)))


def concat_turns(df: DataFrame, group: str, traj: str, turn: str, prompt: str, response: str, info: str) -> DataFrame:
    """One row per trajectory: the first prompt, then responses (mask 1) with the next prompts between them (mask 0);
    ``info`` is that of the last turn."""
    order = Window.partitionBy(group, traj).orderBy(turn)
    rows = df.withColumn("_next", F.lead(prompt).over(order))
    part = F.struct(F.col(turn).alias("t"), F.col(response).alias("r"), F.coalesce(F.col("_next"), F.array().cast("array<string>")).alias("p"))
    packed = rows.groupBy(group, traj).agg(F.array_sort(F.collect_list(part)).alias("_x"), F.min_by(prompt, turn).alias("prompt"), F.max_by(info, turn).alias("info"))
    return packed.select(
        group, traj, "prompt", "info",
        F.flatten(F.transform("_x", lambda x: F.concat(x["r"], x["p"]))).alias("response"),
        F.flatten(F.transform("_x", lambda x: F.concat(F.transform(x["r"], lambda _: F.lit(1)), F.transform(x["p"], lambda _: F.lit(0))))).alias("mask"),
    )


ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register an estimator; a name may be registered again only with the same function."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if ESTIMATORS.get(name, f) is not f:
            raise ValueError(f"estimator {name} is registered already")
        ESTIMATORS[name] = f
        return f

    return add


for _name, _f in {"grpo": grpo, "grpo_vectorised": grpo_vectorised, "grpo_passk": grpo_passk, "reinforce_baseline": reinforce_baseline, "rloo": rloo, "opo": opo, "gpg": gpg, "sppo": sppo}.items():
    register(_name)(_f)


def estimate(name: str, df: DataFrame, **options: object) -> DataFrame:
    """Dispatch to a registered estimator; unknown names raise."""
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[name](df, **options)
