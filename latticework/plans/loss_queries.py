"""M-10 to M-24, A-10, A-13: token objectives and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.functions.vec import rnd
from latticework.operators import losses as L
from latticework.plans.proxies import TOKENS, r, responses, RESPONSES, tokens


def _all(df, digits=4):
    return df.select(*[rnd(F.col(c), digits).alias(c) for c in df.columns])


def _m(f, **options):
    return lambda spark, d: _all(f(tokens(spark, d), **options))


def _kl(spark, d):
    t = tokens(spark, d)
    return t.select("g", "pos", *[rnd(L.kl(F.col("new"), F.col("ref"), k)).alias(k) for k in ("k1", "abs", "k2", "k3")])


def _m11(spark, d):
    return L.penalised_rewards(tokens(spark, d), "r", 0.05).select("g", "pos", rnd(F.col("reward")).alias("reward"))


def _m12(spark, d):
    return tokens(spark, d).select("g", "pos", rnd(F.col("r") - (F.col("old") - F.col("ref")) * 0.1).alias("reward"))


def _m16(spark, d):
    ret = F.when(F.col("m") > 0, F.col("v")).otherwise(-100.0)
    return tokens(spark, d).select("g", "pos", (F.abs(ret + 100) >= 1e-6).alias("valid"))


def _m17(spark, d):
    return tokens(spark, d).groupBy("g").agg(F.count_if((F.col("m") > 0) & (F.floor("v") != F.floor("r"))).alias("differing"))


def _m18(level):
    return lambda spark, d: L.kept_by_ratio(tokens(spark, d), level, 0.8, 1.25).select("g", "pos", rnd(F.col("w")).alias("w"), F.col("kept").cast("int").alias("kept"))


def _m19(spark, d):
    return L.importance_weights(tokens(spark, d), "token", 1.5, True).select("g", "pos", rnd(F.col("w")).alias("w"))


def _m21(spark, d):
    return L.veto(tokens(spark, d), 0.5).select("g", "pos", F.col("kept").cast("int").alias("kept"))


def _m23(spark, d):
    return L.rollout_correction(tokens(spark, d), "geometric", 1.2, 0.8, 1.25, 0.5).select("g", "pos", rnd(F.col("w")).alias("w"), F.col("kept").cast("int").alias("kept"))


def _m24(spark, d):
    t = responses(spark, d).where("ord <= 2").groupBy("g").agg(F.max("s").alias("chosen"), F.min("s").alias("rejected"), F.max("t").alias("ref_chosen"), F.min("t").alias("ref_rejected"))
    return _all(L.preference_loss(t))


def _m24b(spark, d):
    t = responses(spark, d).withColumn("acc", F.when(F.col("flag") == "A", 1.0).otherwise(0.0))
    return _all(L.cross_entropy_preference(t, "s", "acc"))


def _a13(mode):
    return lambda spark, d: _all(L.aggregate_loss(tokens(spark, d), F.col("v") * F.col("adv"), mode, width=17))


QUERIES = {
    "a10_masked_statistics": _m(L.masked_statistics, value="r"),
    "a13_token_mean": _a13("token-mean"),
    "a13_seq_mean_token_sum": _a13("seq-mean-token-sum"),
    "a13_seq_mean_token_mean": _a13("seq-mean-token-mean"),
    "a13_seq_mean_token_sum_norm": _a13("seq-mean-token-sum-norm"),
    "m10_kl_estimators": _kl,
    "m11_penalised_rewards": _m11,
    "m12_reward_difference": _m12,
    "m13_ppo": _m(L.ppo),
    "m14_gspo": _m(L.gspo),
    "m14_gpg": _m(L.gpg),
    "m14_geometric": _m(L.geometric),
    "m14_kl_cov": _m(L.kl_cov, order=["g", "pos"]),
    "m14_clip_cov": _m(L.clip_cov, order=["g", "pos"]),
    "m15_value_loss": lambda spark, d: _all(L.value_loss(tokens(spark, d), "v", "r", "adv")),
    "m16_value_mask": _m16,
    "m17_token_difference": _m17,
    "m18_rejection_token": _m18("token"),
    "m18_rejection_sequence": _m18("sequence"),
    "m18_rejection_geometric": _m18("geometric"),
    "m19_importance_weights": _m19,
    "m20_weight_metrics": _m(L.weight_metrics, level="geometric"),
    "m21_veto": _m21,
    "m22_off_policy": _m(L.off_policy),
    "m23_rollout_correction": _m23,
    "m24_preference_loss": _m24,
    "m24_cross_entropy_preference": _m24b,
    "o16_top_covariance": lambda spark, d: L.top_covariance(tokens(spark, d), 0.01, ["g", "pos"]).where("top").select("g", "pos", rnd(F.col("cov")).alias("cov")),
}

_D = "(new - old)"
_Q = f"exp(least(greatest({_D}, -20), 20))"
_CL = "least(greatest(q, 0.8), 1.2)"
_SEQD = "sum(CASE WHEN m > 0 THEN new - old ELSE 0 END) OVER (PARTITION BY g)"
_GEO = f"{_SEQD} / (sum(m) OVER (PARTITION BY g) + 1e-8)"


def _t(body: str) -> str:
    return f"WITH {TOKENS} {body}"


def _ms(x: str) -> str:
    return f"sum(CASE WHEN m > 0 THEN {x} ELSE 0 END)"


def _mm(x: str) -> str:
    return f"{_ms(x)} / (sum(m) + 1e-8)"


_COV = f"mu AS (SELECT {_mm('adv')} AS ma, {_mm('new')} AS mp, sum(m) AS n FROM tk), cv AS (SELECT tk.*, n, CASE WHEN m > 0 THEN (adv - ma) * (new - mp) END AS cov FROM tk, mu)"


def _kept(log: str) -> str:
    return _t(f", x AS (SELECT g, pos, m, exp(least(greatest({log}, -20), 20)) AS w FROM tk) SELECT g, pos, {r('w')} AS w, CASE WHEN w >= 0.8 AND w <= 1.25 THEN m ELSE 0 END AS kept FROM x")


SQL = {
    "a10_masked_statistics": _t(f""", z AS (SELECT {_mm('r')} AS mu FROM tk) SELECT {r(_ms('r'))} AS sum, {r(_mm('r'))} AS mean,
        {r(f"{_ms('(r - mu) * (r - mu)')} / (sum(m) + 1e-8) * sum(m) / (sum(m) - 1)")} AS var FROM tk, z"""),
    "a13_token_mean": _t(f"SELECT {r(_ms('v * adv') + ' / sum(m)')} AS loss FROM tk"),
    "a13_seq_mean_token_sum": _t(f", p AS (SELECT g, {_ms('v * adv')} AS s FROM tk GROUP BY g) SELECT {r('avg(s)')} AS loss FROM p"),
    "a13_seq_mean_token_mean": _t(f", p AS (SELECT g, {_ms('v * adv')} / nullif(sum(m), 0) AS s FROM tk GROUP BY g) SELECT {r('avg(s)')} AS loss FROM p"),
    "a13_seq_mean_token_sum_norm": _t(f", p AS (SELECT g, {_ms('v * adv')} AS s FROM tk GROUP BY g) SELECT {r('sum(s) / 17')} AS loss FROM p"),
    "m10_kl_estimators": _t(f"""SELECT g, pos, {r('new - ref')} AS k1, {r('abs(new - ref)')} AS abs, {r('(new - ref) * (new - ref) / 2')} AS k2,
        {r('least(greatest(exp(least(greatest(ref - new, -20), 20)) - least(greatest(ref - new, -20), 20) - 1, -10), 10)')} AS k3 FROM tk"""),
    "m11_penalised_rewards": _t(f"SELECT g, pos, {r('r - 0.05 * CASE WHEN m > 0 THEN old - ref ELSE 0 END')} AS reward FROM tk"),
    "m12_reward_difference": _t(f"SELECT g, pos, {r('r - (old - ref) * 0.1')} AS reward FROM tk"),
    "m13_ppo": _t(f""", q AS (SELECT *, {_Q} AS q FROM tk), x AS (SELECT m, adv, -adv * q AS p, -adv * {_CL} AS b, -adv * 3 AS f, old - new AS kl FROM q),
        y AS (SELECT m, CASE WHEN adv < 0 THEN least(f, greatest(p, b)) ELSE greatest(p, b) END AS l, CASE WHEN b > p THEN 1 ELSE 0 END AS c,
                     CASE WHEN adv < 0 AND greatest(p, b) > f THEN 1 ELSE 0 END AS cl, kl FROM x)
        SELECT {r(_ms('l') + ' / sum(m)')} AS loss, {r(_mm('c'))} AS clip_fraction, {r(_mm('cl'))} AS clip_fraction_low, {r(_mm('kl'))} AS kl FROM y"""),
    "m14_gspo": _t(f""", q AS (SELECT *, exp(least({_SEQD} / greatest(sum(m) OVER (PARTITION BY g), 1), 10)) AS q FROM tk), x AS (SELECT g, m, -adv * q AS p, -adv * {_CL} AS b FROM q),
        y AS (SELECT g, {_ms('greatest(p, b)')} AS s, sum(m) AS n, {_ms('CASE WHEN b > p THEN 1 ELSE 0 END')} AS c FROM x GROUP BY g)
        SELECT {r('avg(s / nullif(n, 0))')} AS loss, {r('sum(c) / (sum(n) + 1e-8)')} AS clip_fraction FROM y"""),
    "m14_gpg": _t(f"SELECT {r(_ms('-new * adv') + ' / sum(m)')} AS loss FROM tk"),
    "m14_geometric": _t(f""", x AS (SELECT g, m, adv, sign(adv) * least(sign(adv) * {_D}, sign(adv) * least(greatest({_D}, -0.4), 0.4)) AS d FROM tk),
        y AS (SELECT g, {_ms('d')} AS d, {_ms('adv')} AS a, sum(m) + 1e-8 AS n FROM x GROUP BY g) SELECT {r('avg(-a / n * exp(d / n))')} AS loss FROM y"""),
    "m14_kl_cov": _t(f""", {_COV}, k AS (SELECT *, CASE WHEN cov IS NOT NULL THEN row_number() OVER (ORDER BY cov DESC NULLS LAST, g, pos) END AS rn FROM cv)
        SELECT {r(_ms(f"-adv * exp({_D}) + CASE WHEN rn <= greatest(1, floor(n * 0.002)) THEN abs({_D}) ELSE 0 END") + ' / sum(m)')} AS loss FROM k"""),
    "m15_value_loss": _t(f""", x AS (SELECT m, (v - adv) * (v - adv) AS a, pow(greatest(least(v, r + 0.2), r - 0.2) - adv, 2) AS b FROM tk)
        SELECT {r(_ms('greatest(a, b)') + ' / sum(m) * 0.5')} AS loss, {r(_mm('CASE WHEN b > a THEN 1 ELSE 0 END'))} AS clip_fraction FROM x"""),
    "m16_value_mask": _t("SELECT g, pos, m > 0 AS valid FROM tk"),
    "m17_token_difference": _t("SELECT g, count(*) FILTER (m > 0 AND floor(v) <> floor(r)) AS differing FROM tk GROUP BY g"),
    "m18_rejection_token": _kept(_D),
    "m18_rejection_sequence": _kept(_SEQD),
    "m18_rejection_geometric": _kept(_GEO),
    "m19_importance_weights": _t(f", x AS (SELECT g, pos, m, CASE WHEN m > 0 THEN least({_Q}, 1.5) ELSE 0 END AS w FROM tk), z AS (SELECT {_mm('w')} AS mu FROM x) SELECT g, pos, {r('w / mu')} AS w FROM x, z"),
    "m20_weight_metrics": _t(f""", x AS (SELECT m, exp(least(greatest({_GEO}, -20), 20)) AS w FROM tk), z AS (SELECT avg(w) AS mu FROM x WHERE m > 0)
        SELECT {r('avg(w)')} AS mean, {r('min(w)')} AS low, {r('max(w)')} AS high, {r('avg(CASE WHEN w > 2 THEN 1 ELSE 0 END)')} AS above,
               {r('avg(CASE WHEN w < 0.5 THEN 1 ELSE 0 END)')} AS below, {r('1 / avg(w / mu * (w / mu))')} AS ess FROM x, z WHERE m > 0"""),
    "m21_veto": _t(f"SELECT g, pos, CASE WHEN max(CASE WHEN m > 0 AND {_D} < ln(0.5) THEN 1 ELSE 0 END) OVER (PARTITION BY g) = 1 THEN 0 ELSE m END AS kept FROM tk"),
    "m22_off_policy": _t(f""", s AS (SELECT g, avg(new) AS n, avg(old) AS o, sum({_D}) AS sd, sum(exp({_D}) - {_D} - 1) AS k3, sum(exp(2 * {_D})) AS x, count(*) AS c FROM tk WHERE m > 0 GROUP BY g)
        SELECT {r('avg(exp(-n))')} AS ppl_new, {r('avg(exp(-o))')} AS ppl_old, {r('avg(o - n)')} AS log_ppl_gap, {r('-sum(sd) / sum(c)')} AS kl, {r('sum(k3) / sum(c)')} AS k3_kl,
               {r('sum(x) / sum(c) - 1')} AS chi2_token, {r('avg(exp(2 * least(greatest(sd, -20), 20))) - 1')} AS chi2_seq FROM s"""),
    "m23_rollout_correction": _t(f""", x AS (SELECT g, pos, m, exp(least(greatest({_GEO}, -20), 20)) AS w, max(CASE WHEN m > 0 AND {_D} < ln(0.5) THEN 1 ELSE 0 END) OVER (PARTITION BY g) AS bad FROM tk)
        SELECT g, pos, {r('CASE WHEN m > 0 THEN least(w, 1.2) ELSE 0 END')} AS w, CASE WHEN bad = 1 OR w < 0.8 OR w > 1.25 THEN 0 ELSE m END AS kept FROM x"""),
    "m24_preference_loss": f"""WITH {RESPONSES}, x AS (SELECT g, 0.1 * ((max(s) - min(s)) - (max(t) - min(t))) AS gap FROM sc WHERE ord <= 2 GROUP BY g)
        SELECT {r('avg(ln(1 + exp(-gap)))')} AS loss, {r('avg(CASE WHEN gap > 0 THEN 1 ELSE 0 END)')} AS accuracy FROM x""",
    "m24_cross_entropy_preference": f"""WITH {RESPONSES}, x AS (SELECT CASE WHEN flag = 'A' THEN 1.0 ELSE 0.0 END AS acc, 1 / (1 + exp(-0.05 * s)) AS p FROM sc)
        SELECT {r('avg(-(acc * ln(p) + (1 - acc) * ln(1 - p)))')} AS loss FROM x""",
    "o16_top_covariance": _t(f""", {_COV} SELECT g, pos, {r('cov')} AS cov FROM (SELECT *, row_number() OVER (ORDER BY cov DESC NULLS LAST, g, pos) AS rn FROM cv) WHERE rn <= greatest(1, floor(n * 0.01))"""),
}
