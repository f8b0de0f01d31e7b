"""W-*: advantages and token recurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.vec import rnd
from latticework.operators import advantages as A
from latticework.plans.proxies import RESPONSES, TOKENS, r, responses, sequences, tokens, turns


def _out(df: DataFrame) -> DataFrame:
    return df.select("g", "ord", rnd(F.col("adv")).alias("adv"))


def _simple(f, **options):
    return lambda spark, d: _out(f(responses(spark, d), **options))


def _w08(spark, d):
    return A.reinforce_pp(sequences(spark, d), "g", "r", "m", 0.9).select("g", "pos", rnd(F.col("ret")).alias("ret"), rnd(F.col("adv")).alias("adv"))


def _w09(spark, d):
    rows = sequences(spark, d).withColumn("b", (F.col("g") % 10) / 2)
    return A.remax(rows, "g", "r", "m", "b").select("g", "pos", rnd(F.col("ret")).alias("ret"), rnd(F.col("adv")).alias("adv"))


def _w11(spark, d):
    return A.gae_tokens(sequences(spark, d), "g", "r", "v", "m", 0.99, 0.95).select("g", "pos", rnd(F.col("ret")).alias("ret"), rnd(F.col("adv")).alias("adv"))


def _turn(last):
    def run(spark, d):
        out = A.turn_gae(turns(spark, d), "g", "traj", "turn", "scores", "vals", "mask", last, 0.9, 0.95)
        return out.select("g", "traj", "turn", "pos", rnd(F.col("adv")).alias("adv"), rnd(F.col("ret")).alias("ret"))

    return run


def _w14(spark, d):
    return _out(A.multi_source_rloo(responses(spark, d), "g", "ord", {"s": 0.7, "t": 3.0}, "len"))


def _w16(spark, d):
    return A.preference_mask(responses(spark, d)).select("g", "ord", "chosen")


def _w18(spark, d):
    return A.resample_weights(responses(spark, d), method="pow").select("g", "ord", rnd(F.col("weight")).alias("weight"))


def _w18b(spark, d):
    rows = A.resample_weights(responses(spark, d), method="max_random")
    return A.resample(rows, "ord", "g").select("g", "draw", "ord")


def _w19(spark, d):
    ids = F.transform("r", lambda x: F.floor(x).cast("int") % 3)
    return sequences(spark, d).select("g", F.array_join(A.after_first(1, ids), "").alias("mask"))


def _w20(spark, d):
    return sequences(spark, d).select("g", F.array_join(A.position_ids(F.col("m")), ",").alias("pos_ids"))


def _w21(spark, d):
    return responses(spark, d).select("g", "ord", (F.col("ord") - 1).alias("traj_idx"))


def _w22(spark, d):
    t = turns(spark, d).select("g", "traj", "turn", F.array(F.concat(F.lit("p"), F.col("turn"))).alias("p"), F.array(F.concat(F.lit("r"), F.col("turn")), F.lit("e")).alias("q"), F.get("scores", 0).alias("info"))
    out = A.concat_turns(t, "g", "traj", "turn", "p", "q", "info")
    return out.select("g", "traj", F.array_join("prompt", " ").alias("prompt"), F.array_join("response", " ").alias("response"), F.array_join("mask", "").alias("mask"), rnd(F.col("info")).alias("info"))


def _w23(spark, d):
    return responses(spark, d).select("g", "ord", F.array_join(A.scatter_last(F.col("len").cast("int"), F.col("s")).cast("array<int>"), ",").alias("scores"))


QUERIES = {
    "w01_grpo": _simple(A.grpo),
    "w01b_grpo_centred": _simple(A.grpo, by_std=False),
    "w02_grpo_vectorised": _simple(A.grpo_vectorised),
    "w03_grpo_passk": _simple(A.grpo_passk),
    "w04_reinforce_baseline": _simple(A.reinforce_baseline),
    "w05_rloo": _simple(A.rloo),
    "w06_rloo_vectorised": _simple(A.rloo, single_is_zero=True),
    "w07_opo": _simple(A.opo),
    "w08_reinforce_pp": _w08,
    "w09_remax": _w09,
    "w10_gpg": _simple(A.gpg),
    "w11_gae": _w11,
    "w12_turn_gae_last": _turn(True),
    "w13_turn_gae_first": _turn(False),
    "w14_multi_source_rloo": _w14,
    "w15_sppo": _simple(A.sppo, beta=0.5),
    "w16_preference_mask": _w16,
    "w17_dispatch": lambda spark, d: _out(A.estimate("rloo", responses(spark, d))),
    "w18_resample_weights": _w18,
    "w18b_resample": _w18b,
    "w19_eos_mask": _w19,
    "w20_position_ids": _w20,
    "w21_trajectory_index": _w21,
    "w22_concat_turns": _w22,
    "w23_scatter_last": _w23,
    "a11_group_stats": lambda spark, d: A.group_stats(responses(spark, d)).select("g", "ord", "n", rnd(F.col("mean")).alias("mean"), rnd(F.col("std")).alias("std")),
}

_W = "OVER (PARTITION BY g)"
_MEAN = f"CASE WHEN count(s) {_W} > 1 THEN avg(s) {_W} ELSE 0 END"
_SEQ = "sq AS (SELECT g, list(r ORDER BY pos) AS r, list(v ORDER BY pos) AS v, list(m ORDER BY pos) AS m FROM tk GROUP BY g)"


def _whiten(x: str, m: str, frame: str) -> str:
    mean = f"(SELECT sum({x} * {m}) / (sum({m}) + 1e-8) FROM {frame})"
    var = f"(SELECT sum(({x} - mu) * ({x} - mu) * {m}) / (sum({m}) + 1e-8) * sum({m}) / (sum({m}) - 1) FROM {frame}, (SELECT sum({x} * {m}) / (sum({m}) + 1e-8) AS mu FROM {frame}))"
    return f"({x} - {mean}) / sqrt({var} + 1e-8)"


def _adv(x: str) -> str:
    return f"WITH {RESPONSES} SELECT g, ord, {r(x)} AS adv FROM sc"


# recurrences: returns by window sums over powers where there is no gap, else by a recursive walk from the last token
_REC = f"""WITH RECURSIVE {TOKENS}, n AS (SELECT g, max(pos) AS last FROM tk GROUP BY g),"""
_TURN_BASE = """e AS (SELECT user_id AS g, event_id % 7 AS traj, event_id, value, CAST(row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id) AS INTEGER) AS turn FROM events)"""


def _turn_sql(last: bool) -> str:
    at = "CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END" if last else "0"
    val = f"CASE WHEN {at} = 1 THEN value / 100 / 5 ELSE value / 100 / 3 END"
    return f"""WITH RECURSIVE {_TURN_BASE},
        t AS (SELECT *, value / 100 + (event_id % 2) * (value / 100 / 2) AS rw, {val} AS vl, {at} AS lp, max(turn) OVER (PARTITION BY g, traj) AS n FROM e),
        w AS (SELECT g, traj, turn, vl, rw - vl AS a FROM t WHERE turn = n
              UNION ALL SELECT t.g, t.traj, t.turn, t.vl, t.rw + 0.9 * w.vl - t.vl + 0.9 * 0.95 * w.a FROM w JOIN t ON t.g = w.g AND t.traj = w.traj AND t.turn = w.turn - 1),
        x AS (SELECT t.g, t.traj, t.turn, p.pos, CASE p.pos WHEN 0 THEN 1 WHEN 1 THEN event_id % 2 ELSE 0 END AS m, w.a, CASE WHEN p.pos = t.lp THEN w.a + t.vl ELSE -100 END AS ret
              FROM t JOIN w USING (g, traj, turn), (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS pos) p),
        y AS (SELECT *, a * m AS x FROM x)
        SELECT g, traj, turn, pos, {r(_whiten("x", "m", "y"))} AS adv, {r("ret")} AS ret FROM y"""


SQL = {
    "w01_grpo": _adv(f"(s - {_MEAN}) / (CASE WHEN count(s) {_W} > 1 THEN stddev_samp(s) {_W} ELSE 1 END + 1e-6)"),
    "w01b_grpo_centred": _adv(f"s - {_MEAN}"),
    "w02_grpo_vectorised": _adv(f"(s - {_MEAN}) / (CASE WHEN count(s) {_W} > 1 THEN sqrt(greatest(var_samp(s) {_W}, 1e-6)) ELSE 1 END + 1e-6)"),
    "w03_grpo_passk": f"""WITH {RESPONSES} SELECT g, ord, {r(f"CASE WHEN row_number() OVER w = 1 THEN (s - lead(s) OVER w) / (stddev_samp(s) {_W} + 1e-6) ELSE 0 END")} AS adv
        FROM sc WINDOW w AS (PARTITION BY g ORDER BY s DESC, ord)""",
    "w04_reinforce_baseline": f"WITH {RESPONSES}, b AS (SELECT *, s - {_MEAN} AS x FROM sc) SELECT g, ord, {r(_whiten('x', 'len', 'b'))} AS adv FROM b",
    "w05_rloo": _adv(f"CASE WHEN count(s) {_W} > 1 THEN (count(s) {_W} * s - sum(s) {_W}) / (count(s) {_W} - 1) ELSE s END"),
    "w06_rloo_vectorised": _adv(f"CASE WHEN count(s) {_W} > 1 THEN (count(s) {_W} * s - sum(s) {_W}) / (count(s) {_W} - 1) ELSE 0 END"),
    "w07_opo": _adv(f"s - CASE WHEN count(s) {_W} > 1 THEN sum(s * len) {_W} / sum(len) {_W} ELSE 0 END"),
    "w08_reinforce_pp": f"""{_REC} w AS (SELECT tk.g, tk.pos, tk.m, tk.r AS ret FROM tk JOIN n ON n.g = tk.g AND pos = last
        UNION ALL SELECT tk.g, tk.pos, tk.m, tk.r + 0.9 * w.ret * w.m FROM w JOIN tk ON tk.g = w.g AND tk.pos = w.pos - 1)
        SELECT g, pos, {r("ret")} AS ret, {r(_whiten("ret", "m", "w") + " * m")} AS adv FROM w""",
    "w09_remax": f"""WITH {TOKENS}, x AS (SELECT g, pos, m, sum(r * m) OVER (PARTITION BY g ORDER BY pos DESC) AS ret FROM tk)
        SELECT g, pos, {r("ret")} AS ret, {r("ret - (g % 10) / 2 * m")} AS adv FROM x""",
    "w10_gpg": f"WITH {RESPONSES}, a AS (SELECT count(*) / greatest(1, count(*) FILTER (s <> 0)) AS alpha FROM sc) SELECT g, ord, {r(f'alpha * (s - {_MEAN})')} AS adv FROM sc, a",
    "w11_gae": f"""{_REC} w AS (SELECT tk.g, tk.pos, tk.m, tk.v, (tk.r - tk.v) * tk.m AS a, tk.v * tk.m AS nv FROM tk JOIN n ON n.g = tk.g AND pos = last
        UNION ALL SELECT tk.g, tk.pos, tk.m, tk.v, (tk.r + 0.99 * w.nv - tk.v + 0.99 * 0.95 * w.a) * tk.m + (1 - tk.m) * w.a, tk.v * tk.m + (1 - tk.m) * w.nv
                  FROM w JOIN tk ON tk.g = w.g AND tk.pos = w.pos - 1)
        SELECT g, pos, {r("a + v")} AS ret, {r(_whiten("a", "m", "w"))} AS adv FROM w""",
    "w12_turn_gae_last": _turn_sql(True),
    "w13_turn_gae_first": _turn_sql(False),
    "w14_multi_source_rloo": _adv(f"CASE WHEN count(*) {_W} > 1 THEN 0.7 * (count(*) {_W} * s - sum(s) {_W}) / (count(*) {_W} - 1) + 3.0 * (count(*) {_W} * t - sum(t) {_W}) / (count(*) {_W} - 1) END"),
    "w15_sppo": f"WITH {RESPONSES}, z AS (SELECT max(s) AS top FROM sc), q AS (SELECT ln(avg(exp(0.5 * (s - top)))) / 0.5 + any_value(top) AS sm FROM sc, z) SELECT g, ord, {r('s - sm')} AS adv FROM sc, q",
    "w16_preference_mask": f"""WITH {RESPONSES} SELECT g, ord, CASE WHEN count(*) OVER (PARTITION BY g, (ord - 1) // 2) = 2
        THEN row_number() OVER (PARTITION BY g, (ord - 1) // 2 ORDER BY s DESC, ord) = 1 END AS chosen FROM sc""",
    "w17_dispatch": _adv(f"CASE WHEN count(s) {_W} > 1 THEN (count(s) {_W} * s - sum(s) {_W}) / (count(s) {_W} - 1) ELSE s END"),
    "w18_resample_weights": f"WITH {RESPONSES} SELECT g, ord, {r('greatest(pow(abs(s), 2) + 1e-8, 1e-8)')} AS weight FROM sc",
    "w19_eos_mask": f"""WITH {TOKENS}, {_SEQ}, i AS (SELECT g, list_transform(r, lambda x: CAST(floor(x) AS INTEGER) % 3) AS ids FROM sq)
        SELECT g, array_to_string(list_transform(ids, lambda x, i: CASE WHEN coalesce(list_position(ids, 1), 0) = 0 OR i <= list_position(ids, 1) THEN 1 ELSE 0 END), '') AS mask FROM i""",
    "w20_position_ids": f"WITH {TOKENS}, x AS (SELECT g, pos, greatest(sum(m) OVER (PARTITION BY g ORDER BY pos) - 1, 0) AS p FROM tk) SELECT g, string_agg(CAST(p AS VARCHAR), ',' ORDER BY pos) AS pos_ids FROM x GROUP BY g",
    "w21_trajectory_index": f"WITH {RESPONSES} SELECT g, ord, ord - 1 AS traj_idx FROM sc",
    "w22_concat_turns": f"""WITH {_TURN_BASE}, x AS (SELECT *, max(turn) OVER (PARTITION BY g, traj) AS n FROM e)
        SELECT g, traj, 'p1' AS prompt, string_agg('r' || turn || ' e' || CASE WHEN turn < n THEN ' p' || (turn + 1) ELSE '' END, ' ' ORDER BY turn) AS response,
               string_agg(CASE WHEN turn < n THEN '110' ELSE '11' END, '' ORDER BY turn) AS mask, {r("max_by(value / 100, turn)")} AS info FROM x GROUP BY g, traj""",
    "w23_scatter_last": f"WITH {RESPONSES} SELECT g, ord, array_to_string(list_transform(range(1, len + 1), lambda i: CASE WHEN i = len THEN CAST(s AS INTEGER) ELSE 0 END), ',') AS scores FROM sc",
    "a11_group_stats": f"WITH {RESPONSES} SELECT g, ord, count(s) {_W} AS n, {r(_MEAN)} AS mean, {r(f'CASE WHEN count(s) {_W} > 1 THEN sqrt(greatest(var_samp(s) {_W}, 1e-6)) ELSE 1 END')} AS std FROM sc",
}
