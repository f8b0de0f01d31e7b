"""Queries of the graders and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.functions import grading as N
from latticework.functions.vec import rnd
from latticework.plans import text_queries as TQ
from latticework.plans.proxies import r
from latticework.sources.tables import table

# pieces of answers that meet every rule of the normaliser, chosen by key
_FORMS = ("{n}", "x = {n} cm", "\\frac{n}7", "$\\text{{{n} units}}$", "1,{n},000", "\\boxed{{{n}}}", "an apple and {n}", "\\sqrt5 + {n}^\\circ", "\\dots {n}\\ \\$")
_GOLDS = ("{n}", "{n}", "\\frac{n}{7}", "{n}", "1{n}000", "{n}", "apple{n}", "\\sqrt{5}+{n}", "{n}")


def _filled(forms, k, n):
    out = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        text = f.replace("{{", "\0").replace("}}", "\1")
        parts = [p.replace("\0", "{").replace("\1", "}") for p in text.split("{n}")]
        made = F.concat(*[x for j, p in enumerate(parts) for x in ([F.lit(p)] if j == 0 else [n, F.lit(p)])])
        out = F.when(k == i, made).otherwise(out)
    return out


def _answers(s, d):
    o = table(s, d, "orders", "o_orderkey")
    k, n = F.col("o_orderkey") % 9, F.col("o_orderkey").cast("string")
    said = F.concat(F.lit("so\nAnswer: no\nANSWER :  "), _filled(_FORMS, k, n), F.lit("\nbye"))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.lit("none")).otherwise(said).alias("t"), _filled(_GOLDS, k, n).alias("g"))


def _t13(s, d):
    x = _answers(s, d).select("o_orderkey", N.final_answer_score(F.col("t"), F.col("g")).alias("x"))
    return x.select("o_orderkey", "x.score", "x.pred")


def _t13b(s, d):
    o = table(s, d, "orders", "o_orderkey")
    n = F.col("o_orderkey").cast("string")
    t = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("\\boxed{"), n, F.lit("}"), F.lit("x" * 101))).otherwise(F.concat(F.lit("\\boxed{1} \\boxed{\\frac{"), n, F.lit("}{2}}.")))
    return o.select("o_orderkey", N.final_answer_score(t, F.concat(F.lit("\\frac{"), n, F.lit("}{2}")), strict=True).alias("x")).select("o_orderkey", "x.score", "x.pred")


def _t14(s, d):
    o = table(s, d, "orders", "o_orderkey")
    n = F.col("o_orderkey").cast("string")
    k = F.col("o_orderkey") % 6
    given = F.when(k == 0, F.concat(F.lit("("), n, F.lit(", 2)"))).when(k == 1, F.concat(F.lit("["), n, F.lit(", 2)"))).when(k == 2, F.concat(n, F.lit(".50 meters"))).when(k == 3, F.concat(F.lit("\\frac{"), n, F.lit("}{7}"))).when(k == 4, F.concat(n, F.lit(" 1/2"))).otherwise(F.concat(F.lit("$"), n, F.lit(".0\\%$")))
    gold = F.when(k < 2, F.concat(F.lit("("), n, F.lit(",2.0)"))).when(k == 2, F.concat(n, F.lit(".5"))).when(k == 3, F.concat(n, F.lit("/7"))).when(k == 4, F.concat(n, F.lit(".5"))).otherwise(n)
    return o.select("o_orderkey", N.same_answer_column(given, gold).alias("same"))


def _t22(s, d):
    b = TQ._boxes(s, d)
    one = lambda p: F.concat(F.lit('{"point_2d": ['), p["x"].cast("int").cast("string"), F.lit(", "), p["y"].cast("int").cast("string"), F.lit("]}"))
    body = F.concat(F.lit("here: ["), F.array_join(F.transform("p", one), ", "), F.lit("] done"))
    k = F.col("o_orderkey") % 7
    reply = F.when(k == 0, body).when(k == 1, F.lit('<think>x</think> [{"point_2d": [1]}]')).otherwise(F.concat(F.lit("<think>look</think> "), body))
    x = b.select("o_orderkey", N.pointing_reward(reply, F.col("b")).alias("x"))
    return x.select("o_orderkey", rnd(F.col("x.score")).alias("score"), "x.num_pred", "x.first_correct", "x.is_collinear")


def _t34(s, d):
    o = table(s, d, "orders", "o_orderkey")
    n = F.col("o_orderkey").cast("string")
    source = F.when(F.col("o_orderkey") % 2 == 0, F.lit("aime24")).otherwise(F.lit("aime25"))
    gold = F.when(F.col("o_orderkey") % 3 == 0, F.lit("-1")).otherwise(n)
    return o.select("o_orderkey", N.open_math_score(source, F.concat(F.lit("so \\boxed{"), n, F.lit("}")), gold).alias("score"))


QUERIES = {"t13_final_answer_score": _t13, "t13_strict_box": _t13b, "t14_tuples_and_intervals": _t14, "t22_pointing_reward": _t22, "t34_open_math": _t34}


def _lit(s):
    return "'" + s.replace("'", "''") + "'"


def _sql_normal(x):
    out = f"list_last(string_split({x}, '='))"
    for old, new in N.REPLACED:
        out = f"replace({out}, {_lit(old)}, {_lit(new)})"
    for old in N.REMOVED:
        out = f"replace({out}, {_lit(old)}, '')"
    for pattern, new in ((r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$"), (r"(\\text\{)(.*?)(\})", r"\2"), (r"(\\textbf\{)(.*?)(\})", r"\2"), (r"(\\overline\{)(.*?)(\})", r"\2"), (r"(\\boxed\{)(.*)(\})", r"\2"), (r"(frac)([^{])(.)", r"frac{\2}{\3}"), (r"(sqrt)([^{])", r"sqrt{\2}")):
        out = f"regexp_replace({out}, {_lit(pattern)}, {_lit(new)}, 'g')"
    return f"replace({out}, '$', '')"


def _sql_filled(forms):
    out = "CASE o_orderkey % 9"
    for i, f in enumerate(forms):
        text = f.replace("{{", "\0").replace("}}", "\1")
        out += f" WHEN {i} THEN " + " || o_orderkey || ".join(_lit(p.replace("\0", "{").replace("\1", "}")) for p in text.split("{n}"))
    return out + " END"


_ANSWERS = f"""an AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '[INVALID]' ELSE {_sql_filled(_FORMS)} END AS t, {_sql_filled(_GOLDS)} AS g FROM orders),
    ab AS (SELECT o_orderkey, {_sql_normal('t')} AS t, {_sql_normal('g')} AS g FROM an),
    ac AS (SELECT o_orderkey, trim(CASE WHEN regexp_matches(replace(t, ',', ''), '^[0-9]+$') THEN replace(t, ',', '') ELSE t END) AS t, trim(CASE WHEN regexp_matches(replace(g, ',', ''), '^[0-9]+$') THEN replace(g, ',', '') ELSE g END) AS g FROM ab)"""

SQL = {
    "t13_final_answer_score": f"WITH {_ANSWERS} SELECT o_orderkey, CASE WHEN t = g THEN 1.0 ELSE -1.0 END::DOUBLE AS score, t AS pred FROM ac",
    "t13_strict_box": r"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS score, CASE WHEN o_orderkey % 3 > 0 THEN '\frac{' || o_orderkey || '}{2}' END AS pred FROM orders",
    "t14_tuples_and_intervals": "SELECT o_orderkey, o_orderkey % 6 <> 1 AS same FROM orders",
    "t22_pointing_reward": f"""WITH {TQ._PTS}, k AS (SELECT {TQ._K}, o_orderkey % 7 AS form, (px[2] - px[1]) * (py[3] - py[1]) - (py[2] - py[1]) * (px[3] - px[1]) = 0 AS l,
            coalesce(list_position(list_transform([1, 2, 3], lambda i: px[i] >= x1 AND px[i] <= x2 AND py[i] >= y1 AND py[i] <= y2), TRUE), 0) AS k FROM bx)
        SELECT {TQ._K}, {r('CASE WHEN form < 2 OR l THEN -1.0 WHEN k > 0 THEN 1 + 1 / sqrt(3 * k) ELSE 1 - 1.0 / 3 END')} AS score, CAST(CASE WHEN form < 2 OR l THEN 0 ELSE 3 END AS INTEGER) AS num_pred,
               CAST(form >= 2 AND NOT l AND k = 1 AS INTEGER) AS first_correct, CAST(form >= 2 AND l AS INTEGER) AS is_collinear FROM k""",
    "t34_open_math": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM orders",
}
