"""A-*: metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.functions.vec import rnd
from latticework.operators import metrics as M
from latticework.plans.proxies import RESPONSES, TOKENS, r, responses, tokens
from latticework.sources.tables import table


def _r(df, *plain):
    return df.select(*[F.col(c) if c in plain else rnd(F.col(c)).alias(c) for c in df.columns])


def _a14(spark, d):
    rows = responses(spark, d).withColumn("v", F.col("s") * 0.9 + F.col("t"))
    return _r(M.data_metrics(rows, "s", "len", 50, "v", "s"))


def _a15(spark, d):
    return _r(M.timing(responses(spark, d).withColumn("step", F.col("g") % 7), "s", "len", "step", 4), "step")


def _long(spark, d):
    """Events as a run log: a metric name, a value, a weight and an order."""
    e = table(spark, d, "events", "event_id", "event_type", "value", "user_id")
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("time", "max", "min", "avg", "weighted", "score")]), (F.col("event_id") % 6 + 1).cast("int")), F.lit("_"), F.col("event_type"))
    return e.select(name.alias("metric"), "value", F.col("user_id").alias("weight"), F.col("event_id").alias("at"))


LONG = "lg AS (SELECT ['time', 'max', 'min', 'avg', 'weighted', 'score'][event_id % 6 + 1] || '_' || event_type AS metric, value, user_id AS weight, event_id AS seq FROM events)"


def _a18(spark, d):
    return _r(M.validation(responses(spark, d), "flag", "g", "s"), "flag", "prompts")


def _a19(spark, d):
    return _r(M.best_of(responses(spark, d), "g", "s"), "g", "n")


def _a19b(spark, d):
    return _r(M.bootstrap(responses(spark, d), "g", "s", 2, times=100), "g")


def _a20(spark, d):
    return M.majority(responses(spark, d), "g", "flag", "s", "ord")


def _a21(spark, d):
    name = F.concat(F.element_at(F.array(F.lit("mean@"), F.lit("best@"), F.lit("std@")), (F.col("event_id") % 3 + 1).cast("int")), (F.col("event_id") % 2 * 2 + 2).cast("string"))
    e = table(spark, d, "events", "event_id", "event_type").withColumn("metric", name)
    return e.select("event_id", M.metric_section(F.col("metric"), F.col("event_type"), "click", 4).alias("section"))


def _a22(spark, d):
    lists = responses(spark, d).groupBy("g").agg(F.collect_list("s").alias("scores"), F.min("flag").alias("source"))
    return _r(M.source_scores(lists, "source", "scores"), "source")


def _a24(spark, d):
    docs = table(spark, d, "documents", "chunk_type", "n_chars")
    return _r(M.counts_by(docs, "chunk_type", "n_chars"), "chunk_type", "n", "total")


def _a25(spark, d):
    return _r(M.percentiles(table(spark, d, "events", "value"), "value"))


def _a26(spark, d):
    e = table(spark, d, "events", "event_id", "user_id").select((F.col("event_id") / 100).cast("bigint").alias("a"), ((F.col("event_id") + F.col("user_id")) / 100).cast("bigint").alias("b"))
    return _r(M.staleness(e, "a", "b"), "stale", "max_gap", "versions")


def _a27(spark, d):
    t = tokens(spark, d).select("m", F.exp("old").alias("a"), F.exp("new").alias("b"))
    return _r(M.probability_agreement(t, "a", "b"))


def _a29(spark, d):
    rows = responses(spark, d).select((F.col("s") + F.col("g") / 1000000).alias("a"), F.col("t").alias("b"), "g", "ord")
    return _r(M.slowest(rows, "a", "b", ["g", "ord"]), "slowest_g", "slowest_ord")


def _a30(spark, d):
    rows = responses(spark, d).withColumn("acc", F.when(F.col("flag") == "A", 1.0).when(F.col("flag") == "N", 0.5).otherwise(0.0))
    return _r(M.pair_accuracy(rows, "g", "ord", "s", "acc"), "g")


def _a30b(spark, d):
    rows = responses(spark, d).select((F.col("s") - 25).alias("s"), F.when(F.col("flag") == "A", 1.0).otherwise(0.0).alias("acc"))
    return _r(M.sign_accuracy(rows, "s", "acc"))


def _a33(spark, d):
    rows = responses(spark, d).select("g", "flag", F.when(F.col("ord") % 3 != 0, F.col("s") / 50).alias("x"))
    return _r(M.combined_reward(rows, "g", "flag", "x", {"A": 1.5, "N": 0.5, "R": -1.0}), "g")


QUERIES = {
    "a03_corpus_statistics": lambda s, d: _r(table(s, d, "chart_entry", "context", "image_paths", "qa_ids").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("context").isNotNull(), F.size("context"))).alias("texts"), F.avg(F.when(F.col("image_paths").isNotNull(), F.size("image_paths"))).alias("charts"), F.avg(F.when(F.col("qa_ids").isNotNull(), F.size("qa_ids"))).alias("qas")), "n"),
    "a12_label_numbers": lambda s, d: M.label_numbers(table(s, d, "events", "event_type"), "event_type"),
    "a14_data_metrics": _a14,
    "a15_timing": _a15,
    "a16_reduce_metrics": lambda s, d: _r(M.reduce_metrics(_long(s, d)), "metric"),
    "a17_aggregate_run": lambda s, d: _r(M.aggregate_run(_long(s, d)), "metric", "rule"),
    "a18_validation": _a18,
    "a19_best_of_n": _a19,
    "a19_bootstrap": _a19b,
    "a20_majority": _a20,
    "a21_metric_sections": _a21,
    "a22_source_scores": _a22,
    "a23_type_counts": lambda s, d: table(s, d, "relation", "type").groupBy("type").agg(F.count(F.lit(1)).alias("n")),
    "a24_counts_by_type": _a24,
    "a25_percentiles": _a25,
    "a25_percentiles_sketch": lambda s, d: M.percentiles(table(s, d, "events", "value"), "value", False),
    "a26_staleness": _a26,
    "a27_probability_agreement": _a27,
    "a28_partial_statistics": lambda s, d: _r(responses(s, d).agg(F.avg("s").alias("mean"), F.max("s").alias("max"), F.min("s").alias("min"), F.stddev_samp("s").alias("std"))),
    "a29_slowest": _a29,
    "a30_pair_accuracy": _a30,
    "a30_sign_accuracy": _a30b,
    "a31_softmean": lambda s, d: _r(M.softmean_by(responses(s, d), "flag", "s", 0.5), "flag"),
    "a33_combined_reward": _a33,
}

_SC = f"WITH {RESPONSES}"

SQL = {
    "a03_corpus_statistics": f"SELECT count(*) AS n, {r('avg(len(context))')} AS texts, {r('avg(len(image_paths))')} AS charts, {r('avg(len(qa_ids))')} AS qas FROM chart_entry",
    "a12_label_numbers": "SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS number FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)",
    "a14_data_metrics": f"""{_SC}, x AS (SELECT s, len, s - (s * 0.9 + t) AS gap FROM sc) SELECT {r('avg(s)')} AS score_mean, {r('max(s)')} AS score_max, {r('min(s)')} AS score_min,
        {r('avg(len)')} AS length_mean, {r('max(len)')} AS length_max, {r('min(len)')} AS length_min, {r('avg(CASE WHEN len >= 50 THEN 1 ELSE 0 END)')} AS clip_ratio,
        {r('avg(CASE WHEN len = 0 THEN 1 ELSE 0 END)')} AS aborted_ratio, {r('1 - var_samp(gap) / (var_samp(s) + 1e-5)')} AS explained_variance FROM x""",
    "a15_timing": f"{_SC} SELECT g % 7 AS step, {r('sum(s) * 1000 / sum(len)')} AS ms_per_token, {r('sum(len) / (sum(s) * 4)')} AS throughput FROM sc GROUP BY 1",
    "a16_reduce_metrics": f"WITH {LONG} SELECT metric, {r('''CASE WHEN contains(metric, 'max') THEN max(value) WHEN contains(metric, 'min') THEN min(value) ELSE avg(value) END''')} AS value FROM lg GROUP BY metric",
    "a17_aggregate_run": f"""WITH {LONG}, x AS (SELECT *, CASE WHEN contains(metric, 'time') THEN 'sum' WHEN contains(metric, 'weighted') THEN 'weighted' WHEN contains(metric, 'avg') OR contains(metric, 'mean') THEN 'avg'
        WHEN contains(metric, 'max') THEN 'max' WHEN contains(metric, 'min') THEN 'min' WHEN contains(metric, 'sum') OR contains(metric, 'total') THEN 'sum' ELSE 'last' END AS rule FROM lg)
        SELECT metric, rule, {r('''CASE rule WHEN 'sum' THEN sum(value) WHEN 'avg' THEN avg(value) WHEN 'max' THEN max(value) WHEN 'min' THEN min(value)
        WHEN 'weighted' THEN sum(value * weight) / sum(weight) ELSE max_by(value, seq) END''')} AS value FROM x GROUP BY metric, rule""",
    "a18_validation": f"{_SC}, p AS (SELECT flag, g, avg(s) AS m, stddev_pop(s) AS sd FROM sc GROUP BY flag, g) SELECT flag, {r('avg(m)')} AS mean, {r('avg(sd)')} AS std, count(*) AS prompts FROM p GROUP BY flag",
    "a19_best_of_n": f"""{_SC}, k AS (SELECT g, s, CAST(row_number() OVER (PARTITION BY g ORDER BY s) AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY g) AS DOUBLE) AS tot FROM sc),
        m AS (SELECT DISTINCT g, tot FROM k WHERE tot > 1), n AS (SELECT g, unnest(list_append(list_filter([2, 4, 8, 16, 32], lambda p: p < tot), CAST(tot AS BIGINT))) AS n FROM m)
        SELECT k.g, n.n, {r('sum(s * (pow(i / k.tot, n) - pow((i - 1) / k.tot, n)))')} AS best, {r('sum(s * (pow((k.tot - i + 1) / k.tot, n) - pow((k.tot - i) / k.tot, n)))')} AS worst
        FROM k JOIN n ON n.g = k.g GROUP BY k.g, n.n""",
    "a20_majority": f"""{_SC}, v AS (SELECT g, flag, count(*) AS n, min(ord) AS f, min_by(s, ord) AS value FROM sc GROUP BY g, flag)
        SELECT g, flag, value FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, f) AS k FROM v) WHERE k = 1""",
    "a21_metric_sections": "SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 3 < 2 AND event_id % 2 * 2 + 2 = 4 THEN 'val-core' ELSE 'val-aux' END AS section FROM events",
    "a22_source_scores": f"{_SC}, p AS (SELECT g, min(flag) AS source, avg(s) AS m FROM sc GROUP BY g) SELECT source, {r('avg(m)')} AS score FROM p GROUP BY source",
    "a23_type_counts": "SELECT type, count(*) AS n FROM relation GROUP BY type",
    "a24_counts_by_type": f"SELECT chunk_type, count(*) AS n, {r('avg(n_chars)')} AS mean, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY chunk_type",
    "a25_percentiles": f"SELECT {r('quantile_cont(value, 0.5)')} AS tp50, {r('quantile_cont(value, 0.95)')} AS tp95, {r('quantile_cont(value, 0.99)')} AS tp99 FROM events",
    "a26_staleness": f"""WITH x AS (SELECT event_id // 100 AS a, (event_id + user_id) // 100 AS b FROM events) SELECT count(*) FILTER (a <> b) AS stale, {r('avg(CASE WHEN a <> b THEN 1 ELSE 0 END)')} AS stale_ratio,
        {r('avg(abs(b - a))')} AS mean_gap, max(abs(b - a)) AS max_gap, count(DISTINCT b) AS versions FROM x""",
    "a27_probability_agreement": f"""WITH {TOKENS}, x AS (SELECT exp(old) AS a, exp(new) AS b FROM tk WHERE m > 0)
        SELECT {r('corr(a, b)')} AS corr, {r('max(abs(a - b))')} AS max_gap, {r('avg(abs(a - b))')} AS mean_gap, {r('stddev_samp(abs(a - b))')} AS std_gap FROM x""",
    "a28_partial_statistics": f"{_SC} SELECT {r('avg(s)')} AS mean, {r('max(s)')} AS max, {r('min(s)')} AS min, {r('stddev_samp(s)')} AS std FROM sc",
    "a29_slowest": f"""{_SC}, x AS (SELECT s + g / 1000000 AS a, t AS b, g, ord FROM sc), m AS (SELECT {', '.join(f'{r(f"{f}({c})")} AS {n}_{c}' for c in 'ab' for f, n in (('min', 'min'), ('max', 'max'), ('avg', 'mean')))} FROM x)
        SELECT m.*, g AS slowest_g, ord AS slowest_ord FROM m, (SELECT g, ord FROM x ORDER BY a + b DESC, g DESC, ord DESC LIMIT 1)""",
    "a30_pair_accuracy": f"""{_SC}, a AS (SELECT g, ord, s, CASE flag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.0 END AS acc FROM sc),
        p AS (SELECT x.g, CAST(abs(x.acc - y.acc) AS DOUBLE) AS w, (x.s > y.s) = (x.acc > y.acc) AS ok FROM a x JOIN a y ON x.g = y.g AND x.ord < y.ord),
        q AS (SELECT g, sum(w) AS w, sum(CASE WHEN ok THEN w ELSE 0 END) AS k FROM p GROUP BY g)
        SELECT a.g, {r('CASE WHEN coalesce(any_value(w), 0) = 0 THEN 0.5 ELSE any_value(k) / any_value(w) END')} AS accuracy FROM (SELECT DISTINCT g FROM a) a LEFT JOIN q USING (g) GROUP BY a.g""",
    "a30_sign_accuracy": f"{_SC} SELECT {r('''avg(CASE WHEN sign(s - 25) = sign(CASE WHEN flag = 'A' THEN 1 ELSE -1 END) THEN 1 ELSE 0 END)''')} AS accuracy FROM sc",
    "a31_softmean": f"{_SC}, t AS (SELECT flag, max(s) AS top FROM sc GROUP BY flag) SELECT flag, {r('ln(avg(exp(0.5 * (s - top)))) / 0.5 + any_value(top)')} AS softmean FROM sc JOIN t USING (flag) GROUP BY flag",
    "a33_combined_reward": f"""{_SC}, p AS (SELECT g, flag, sum(CASE WHEN ord % 3 <> 0 THEN s / 50 ELSE 0 END) / count(*) * CASE flag WHEN 'A' THEN 1.5 WHEN 'N' THEN 0.5 ELSE -1.0 END AS x FROM sc GROUP BY g, flag)
        SELECT g, {r('sum(greatest(-1.0, least(1.0, x)))')} AS reward FROM p GROUP BY g""",
}
