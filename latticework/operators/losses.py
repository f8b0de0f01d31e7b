"""Token-level objectives and off-policy diagnostics as two-level aggregates over an exploded token frame.

A token frame has a sequence key ``g``, a mask ``m`` (1 counts) and per-token columns. Masked tokens never change a
result. All results are partial sums, so a batch of any size is combined map-side; batch-wide scalars are subqueries.
Empty frames give one row of nulls (or no row where the result is per sequence).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.batch import with_position
from latticework.functions.vec import clip

M = F.col


def masked_sum(x: Column, m: str = "m") -> Column:
    return F.sum(F.when(M(m) > 0, x).otherwise(0.0))


def masked_mean(x: Column, m: str = "m") -> Column:
    """Mean over unmasked tokens with 1e-8 in the denominator."""
    return masked_sum(x, m) / (F.sum(m) + 1e-8)


def masked_statistics(df: DataFrame, value: str, m: str = "m") -> DataFrame:
    """One row: masked ``sum``, ``mean``, ``var`` (with Bessel's correction; null for one token or none)."""
    mean = df.agg(masked_mean(M(value), m).alias("x")).scalar()
    rows = df.select(M(value).alias("v"), M(m).alias("m"), F.when(M(m) > 0, (M(value) - mean) * (M(value) - mean)).otherwise(0.0).alias("q"))
    n = F.sum("m")
    return rows.agg(masked_sum(M("v")).alias("sum"), masked_mean(M("v")).alias("mean"), F.when(n > 1, F.sum("q") / (n + 1e-8) * n / (n - 1)).alias("var"))


LOSS_MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def aggregate_loss(df: DataFrame, loss: Column, mode: str = "token-mean", g: str = "g", m: str = "m", width: int | None = None) -> DataFrame:
    """One row ``loss`` by one of ``LOSS_MODES``; ``width`` is the padded length the last one divides by."""
    if mode not in LOSS_MODES:
        raise ValueError(f"unknown mode {mode}")
    rows = df.select(M(g).alias("g"), M(m).alias("m"), loss.alias("l"))
    if mode == "token-mean":
        return rows.agg((masked_sum(M("l")) / F.sum("m")).alias("loss"))
    per = rows.groupBy("g").agg(masked_sum(M("l")).alias("s"), F.sum("m").alias("n"))
    if mode == "seq-mean-token-mean":
        return per.agg(F.avg(M("s") / F.when(M("n") > 0, M("n"))).alias("loss"))
    if mode == "seq-mean-token-sum":
        return per.agg(F.avg("s").alias("loss"))
    if not width:
        raise ValueError("seq-mean-token-sum-norm needs the padded width")
    return per.agg((F.sum("s") / F.lit(float(width))).alias("loss"))


def kl(new: Column, ref: Column, kind: str = "k1") -> Column:
    """Per-token divergence estimate: k1, abs, k2 (half the square) or k3 (clamped)."""
    d = new - ref
    if kind == "k1":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "k2":
        return d * d / 2
    if kind == "k3":
        x = clip(ref - new, -20.0, 20.0)
        return clip(F.exp(x) - x - 1, -10.0, 10.0)
    raise ValueError(f"unknown estimator {kind}")


def ratio(new: Column, old: Column, bound: float = 20.0) -> Column:
    return F.exp(clip(new - old, -bound, bound))


def ppo_terms(new: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2, c: float = 3.0) -> dict[str, Column]:
    """Dual-clip objective: ``loss`` and the indicators ``clipped`` and ``clipped_low``, per token."""
    q = ratio(new, old)
    plain, bounded, floor = -adv * q, -adv * clip(q, 1 - low, 1 + high), -adv * c
    upper = F.greatest(plain, bounded)
    return {
        "loss": F.when(adv < 0, F.least(floor, upper)).otherwise(upper),
        "clipped": (bounded > plain).cast("double"),
        "clipped_low": F.when(adv < 0, (upper > floor).cast("double")).otherwise(0.0),
    }


def ppo(df: DataFrame, mode: str = "token-mean") -> DataFrame:
    """``loss``, ``clip_fraction``, ``clip_fraction_low`` and ``kl`` of a token frame with ``new``, ``old``, ``adv``."""
    t = ppo_terms(M("new"), M("old"), M("adv"))
    rows = df.select("g", "m", *[x.alias(k) for k, x in t.items()], clip(M("old") - M("new"), -20.0, 20.0).alias("kl"))
    side = rows.agg(masked_mean(M("clipped")).alias("clip_fraction"), masked_mean(M("clipped_low")).alias("clip_fraction_low"), masked_mean(M("kl")).alias("kl"))
    if mode == "token-mean":
        return rows.agg((masked_sum(M("loss")) / F.sum("m")).alias("loss"), *[masked_mean(M(a)).alias(b) for a, b in (("clipped", "clip_fraction"), ("clipped_low", "clip_fraction_low"), ("kl", "kl"))])
    return side.withColumn("loss", aggregate_loss(rows, M("loss"), mode).scalar())


def sequence_ratio(df: DataFrame) -> DataFrame:
    """Adds ``q``: the geometric mean of the token ratios of the sequence (log bounded above by 10)."""
    w = Window.partitionBy("g")
    mean = F.sum(F.when(M("m") > 0, M("new") - M("old")).otherwise(0.0)).over(w) / F.greatest(F.sum("m").over(w), F.lit(1))
    return df.withColumn("q", F.exp(F.least(mean, F.lit(10.0))))


def gspo(df: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Sequence-ratio objective, averaged per sequence, with its clip fraction."""
    q, a = M("q"), M("adv")
    rows = sequence_ratio(df).select("g", "m", (-a * q).alias("x"), (-a * clip(q, 1 - low, 1 + high)).alias("y"))
    per = rows.groupBy("g").agg(masked_sum(F.greatest("x", "y")).alias("s"), F.sum("m").alias("n"), masked_sum((M("y") > M("x")).cast("double")).alias("c"))
    return per.agg(F.avg(M("s") / F.when(M("n") > 0, M("n"))).alias("loss"), (F.sum("c") / (F.sum("n") + 1e-8)).alias("clip_fraction"))


def gpg(df: DataFrame, mode: str = "token-mean") -> DataFrame:
    """Plain policy gradient: -log-probability times advantage."""
    return aggregate_loss(df, -M("new") * M("adv"), mode)


def geometric(df: DataFrame, low: float = 0.4, high: float = 0.4) -> DataFrame:
    """Geometric-mean objective: token log ratios clipped on the advantage's side, averaged per sequence."""
    d, sign = M("new") - M("old"), F.signum("adv")
    near = sign * F.least(sign * d, sign * clip(d, -low, high))
    per = df.groupBy("g").agg(masked_sum(near).alias("d"), masked_sum(M("adv")).alias("a"), F.sum("m").alias("n"))
    n = M("n") + 1e-8
    return per.agg(F.avg(-M("a") / n * F.exp(M("d") / n)).alias("loss"))


def covariance(df: DataFrame) -> DataFrame:
    """Adds ``cov``: (adv - mean) (new - mean) over unmasked tokens, null elsewhere."""
    a, p = (df.agg(masked_mean(M(c)).alias("x")).scalar() for c in ("adv", "new"))
    return df.withColumn("cov", F.when(M("m") > 0, (M("adv") - a) * (M("new") - p)))


def top_covariance(df: DataFrame, share: float, order: list[str]) -> DataFrame:
    """Adds ``top``: whether a token is among the ``max(1, int(n share))`` of largest covariance.

    The cut is a position in the order of covariance, counted range by range; ties go by ``order``.
    """
    rows = covariance(df)
    n = df.agg(F.sum("m").alias("n")).first().n or 0
    k = max(1, int(n * share))
    best = rows.where("cov is not null").select(*order, (-M("cov")).alias("_less"))
    best = with_position(best, "_less", *order, name="_p").where(M("_p") < k).select(*order, F.lit(True).alias("_top"))
    return rows.join(best, order, "left").withColumn("top", F.coalesce("_top", F.lit(False))).drop("_top")


def kl_cov(df: DataFrame, order: list[str], share: float = 0.002, coefficient: float = 1.0) -> DataFrame:
    """Objective with a divergence penalty on the tokens of largest covariance."""
    plain = -M("adv") * F.exp(M("new") - M("old"))
    extra = F.when(M("top"), coefficient * F.abs(M("new") - M("old"))).otherwise(0.0)
    return aggregate_loss(top_covariance(df, share, order), plain + extra)


def clip_cov(df: DataFrame, order: list[str], share: float = 0.002, low: float = 0.2, high: float = 0.2, least: float = 0.1, most: float = 5.0, seed: int = 5) -> DataFrame:
    """Objective without the gradient of a pseudo-random share of tokens whose covariance lies in a band."""
    q = F.exp(M("new") - M("old"))
    rows = covariance(df).withColumns({"x": -M("adv") * q, "y": -M("adv") * clip(q, 1 - low, 1 + high)})
    n = df.agg(F.sum("m").alias("n")).first().n or 0
    band = rows.where((M("cov") > least) & (M("cov") < most) & ~(M("y") > M("x")))
    band = band.select(*order, F.xxhash64(*order, F.lit(seed)).alias("_h"))
    drawn = with_position(band, "_h", *order, name="_p").where(M("_p") < max(1, int(n * share))).select(*order, F.lit(0.0).alias("_c"))
    kept = rows.join(drawn, order, "left")
    return aggregate_loss(kept, F.greatest("x", "y") * F.coalesce("_c", F.lit(1.0)))


def value_loss(df: DataFrame, value: str, old_value: str, returns: str, bound: float = 0.2) -> DataFrame:
    """Clipped value loss (half the larger square) and how often the clipped one was larger."""
    near = F.greatest(F.least(M(value), M(old_value) + bound), M(old_value) - bound)
    a, b = (M(value) - M(returns)) * (M(value) - M(returns)), (near - M(returns)) * (near - M(returns))
    rows = df.select("m", F.greatest(a, b).alias("l"), (b > a).cast("double").alias("c"))
    return rows.agg((masked_sum(M("l")) / F.sum("m") * 0.5).alias("loss"), masked_mean(M("c")).alias("clip_fraction"))


def penalised_rewards(df: DataFrame, score: str, beta: float, kind: str = "k1") -> DataFrame:
    """Adds ``reward`` = score - beta * divergence of ``old`` from ``ref`` on unmasked tokens."""
    return df.withColumn("reward", M(score) - beta * F.when(M("m") > 0, kl(M("old"), M("ref"), kind)).otherwise(0.0))


def next_coefficient(current: float, observed: float, target: float, steps: int, horizon: float) -> float:
    """Adaptive penalty coefficient: proportional to the relative error, bounded by 0.2."""
    error = max(-0.2, min(0.2, observed / target - 1))
    return current * (1 + error * steps / horizon)


def kept_by_ratio(df: DataFrame, level: str = "token", low: float = 0.5, high: float = 2.0, bound: float = 20.0) -> DataFrame:
    """Adds ``w`` (importance ratio at ``level``: token, sequence or geometric) and ``kept`` (m where low <= w <= high)."""
    d = F.when(M("m") > 0, M("new") - M("old")).otherwise(0.0)
    win = Window.partitionBy("g")
    if level == "token":
        log = M("new") - M("old")
    elif level == "sequence":
        log = F.sum(d).over(win)
    elif level == "geometric":
        log = F.sum(d).over(win) / (F.sum("m").over(win) + 1e-8)
    else:
        raise ValueError(f"unknown level {level}")
    w = F.exp(clip(log, -bound, bound))
    return df.withColumn("w", w).withColumn("kept", F.when((M("w") >= low) & (M("w") <= high), M("m")).otherwise(0))


def importance_weights(df: DataFrame, level: str = "token", most: float = 2.0, normalise: bool = False) -> DataFrame:
    """Adds ``w``: the truncated ratio on unmasked tokens (0 elsewhere), optionally with batch mean 1."""
    rows = kept_by_ratio(df, level, 0.0, float("inf")).drop("kept")
    rows = rows.withColumn("w", F.when(M("m") > 0, F.least(M("w"), F.lit(most))).otherwise(0.0))
    return rows.withColumn("w", M("w") / rows.agg(masked_mean(M("w")).alias("x")).scalar()) if normalise else rows


def veto(df: DataFrame, least: float = 1e-4) -> DataFrame:
    """Adds ``kept``: 0 for every token of a sequence that holds one catastrophic ratio below ``least``."""
    bad = F.max(F.when((M("m") > 0) & (M("new") - M("old") < math.log(least)), 1).otherwise(0)).over(Window.partitionBy("g"))
    return df.withColumn("kept", F.when(bad == 1, 0).otherwise(M("m")))


def weight_metrics(df: DataFrame, level: str = "token", low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Mean, extremes, share above and below the band, and effective sample size of the ratios."""
    rows = kept_by_ratio(df, level, low, high).where("m > 0")
    mean = rows.agg(F.avg("w").alias("x")).scalar()
    rows = rows.withColumn("z", M("w") / mean)
    return rows.agg(
        F.avg("w").alias("mean"), F.min("w").alias("low"), F.max("w").alias("high"),
        F.avg((M("w") > high).cast("double")).alias("above"), F.avg((M("w") < low).cast("double")).alias("below"),
        (1 / F.avg(M("z") * M("z"))).alias("ess"),
    )


def off_policy(df: DataFrame) -> DataFrame:
    """Perplexities of both policies, their gap, divergences and chi-square, at token and sequence level."""
    d = M("new") - M("old")
    rows = df.where("m > 0").select("g", "new", "old", d.alias("d"), (F.exp(d) - d - 1).alias("k3"), F.exp(2 * clip(d, -20.0, 20.0)).alias("x"))
    seq = rows.groupBy("g").agg(F.avg("new").alias("n"), F.avg("old").alias("o"), F.sum("d").alias("sd"), F.sum("d").alias("s"), F.sum("k3").alias("k3"), F.sum("x").alias("x"), F.count(F.lit(1)).alias("c"))
    return seq.agg(
        F.avg(F.exp(-M("n"))).alias("ppl_new"), F.avg(F.exp(-M("o"))).alias("ppl_old"), F.avg(M("o") - M("n")).alias("log_ppl_gap"),
        (-F.sum("s") / F.sum("c")).alias("kl"), (F.sum("k3") / F.sum("c")).alias("k3_kl"),
        (F.sum("x") / F.sum("c") - 1).alias("chi2_token"), (F.avg(F.exp(2 * clip(M("sd"), -20.0, 20.0))) - 1).alias("chi2_seq"),
    )


def rollout_correction(df: DataFrame, level: str = "token", most: float = 2.0, low: float = 0.5, high: float = 2.0, least: float = 1e-4) -> DataFrame:
    """Weights, rejection and veto in one pass: adds ``w`` and ``kept``."""
    rows = kept_by_ratio(df, level, low, high).withColumnRenamed("kept", "_k")
    rows = veto(rows, least)
    return rows.withColumn("kept", F.least("kept", "_k")).drop("_k").withColumn("w", F.when(M("m") > 0, F.least(M("w"), F.lit(most))).otherwise(0.0))


def preference_loss(df: DataFrame, beta: float = 0.1) -> DataFrame:
    """Mean -log sigmoid of beta times the gap of log-ratios of chosen and rejected responses
    (``chosen``, ``rejected``, ``ref_chosen``, ``ref_rejected``)."""
    gap = beta * ((M("chosen") - M("rejected")) - (M("ref_chosen") - M("ref_rejected")))
    return df.agg(F.avg(F.ln(1 + F.exp(-gap))).alias("loss"), F.avg((gap > 0).cast("double")).alias("accuracy"))


def cross_entropy_preference(df: DataFrame, score: str, acc: str, beta: float = 0.05) -> DataFrame:
    """Binary cross entropy of sigmoid(beta * score) against the accuracy."""
    p = 1 / (1 + F.exp(-beta * M(score)))
    return df.agg(F.avg(-(M(acc) * F.ln(p) + (1 - M(acc)) * F.ln(1 - p))).alias("loss"))


LOSSES: dict[str, Callable[..., DataFrame]] = {"ppo": ppo, "gspo": gspo, "gpg": gpg, "geometric": geometric, "kl_cov": kl_cov, "clip_cov": clip_cov}


def register_loss(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register an objective by name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        LOSSES[name] = f
        return f

    return add
