"""Graders of mathematical and pointing answers.

Normalisation that is a chain of replacements stays in JVM expressions; nesting and number reading run over Arrow batches.
"""

from __future__ import annotations

import json
import math
import re
from itertools import combinations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from latticework.functions import text as T

# Replacements and removals of final answers, in their order.
REPLACED = (("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"))
REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm",
    "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}",
    "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
#: Units that answers are stripped of, with their plurals and powers.
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter")
#: Patterns of LaTeX wrappers and shorthand with what stands for them.
WRAPPERS = (
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"), (r"(\\text\{)(.*?)(\})", "$2"), (r"(\\textbf\{)(.*?)(\})", "$2"), (r"(\\overline\{)(.*?)(\})", "$2"),
    (r"(\\boxed\{)(.*)(\})", "$2"), (r"(frac)([^{])(.)", "frac{$2}{$3}"), (r"(sqrt)([^{])", "sqrt{$2}"),
)
ANSWER_TAIL, BOX_TAIL = 300, 100


def final_answer_normal(s: Column) -> Column:
    """A final answer in one writing: what follows the last ``=``, without units, spacing and LaTeX wrappers. Null stays null."""
    out = F.substring_index(s, "=", -1)
    for old, new in REPLACED:
        out = F.replace(out, F.lit(old), F.lit(new))
    for old in REMOVED:
        out = F.replace(out, F.lit(old), F.lit(""))
    for pattern, new in WRAPPERS:
        out = F.regexp_replace(out, "(?d)" + pattern, new)
    out = F.replace(out, F.lit("$"), F.lit(""))
    bare = F.replace(out, F.lit(","), F.lit(""))
    return T.stripped(F.when(bare.rlike(r"^\p{Nd}+$"), bare).otherwise(out))


def final_answer_score(solution: Column, gold: Column, strict: bool = False) -> Column:
    """(score, acc, pred): 1 or -1 for the last ``Answer:`` line within the last 300 characters against the gold answer.

    With ``strict`` the content of the last box within the last 100 characters must be the gold answer itself. Without an answer
    ``pred`` is ``[INVALID]`` (null if strict) and the score -1, also for null.
    """
    end = F.right(F.coalesce(solution, F.lit("")), F.lit(BOX_TAIL if strict else ANSWER_TAIL))
    if strict:
        only = lambda t: T.boxed_content(t) if "\\boxed{" in t and t.rfind("\\boxed{") > t.rfind("\\fbox{") else None
        pred = F.pandas_udf(lambda x: x.map(only, na_action="ignore"), "string")(end)
        right = F.coalesce(pred == gold, F.lit(False))
    else:
        found = F.regexp_extract_all(end, F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), 1)
        pred = final_answer_normal(F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise("[INVALID]"))
        right = F.coalesce(pred == final_answer_normal(gold), F.lit(False))
    return F.struct(F.when(right, 1.0).otherwise(-1.0).alias("score"), right.alias("acc"), pred.alias("pred"))


def open_math_score(source: Column, response: Column, gold: Column) -> Column:
    """The boxed-answer score for the sources that have one; another source raises."""
    return T.scored(source, dict.fromkeys(("aime24", "aime25"), T.math_score(response, gold)))


# --- tuples and intervals -------------------------------------------------------------------------------------------


def graded_normal(s: str) -> str:
    """One writing of an answer: no currency, per cent and unit marks, numbers plain, in lower case."""
    if m := re.search(r"^\\text\{(.+?)\}$", s):
        s = m.group(1)
    for old, new in (("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")):
        s = s.replace(old, new)
    for unit in UNITS:
        s = re.sub(rf"{unit}(es)?(s)? *(\^[0-9]+)?", "", s)
    s = re.sub(r",\\! *", "", re.sub(r"\^ *\\circ", "", s))
    if s.startswith("{") and s.endswith("}"):
        s = s[1:-1]
    s = re.sub(r"\\[dt]?frac\{([^{}]+)\}\{([^{}]+)\}", r"(\1)/(\2)", s)
    s = re.sub(r"\\sqrt\{([^{}]+)\}", r"sqrt(\1)", s).replace("\\left", "").replace("\\right", "").replace("\\cdot", "*").replace("\\pi", "pi").replace("\\infty", "inf")
    s = re.sub(r"([0-9]) +([0-9])", r"\1+\2", re.sub("- *", "-", s)).lower()  # 7 3/4
    s = re.sub(r"\((-?[0-9.]+)\)", r"\1", s.replace(" ", ""))
    whole = re.fullmatch(r"(-?[0-9]{1,3}(?:,[0-9]{3})+|-?[0-9]+)(?:\.0*)?", s)
    return str(int(whole.group(1).replace(",", ""))) if whole else s


def elements(s: str) -> list[str]:
    """The parts of a tuple or an interval; any other answer is one part."""
    s = re.sub(r"(?<=\d),(?=\d{3}\b)(?![^()\[\]]*[)\]])", "", s)
    if len(s) > 2 and s[0] in "([" and s[-1] in ")]" and not re.search(r"[()\[\]]", s[1:-1]):
        return [x.strip() for x in s[1:-1].split(",")]
    return [s] if s else []


def value(s: str) -> float | None:
    """The value of a number, a fraction, a mixed number or a product with a power of ten."""
    if m := re.fullmatch(r"(-?)(?:([0-9]+)\+)?([0-9.]+)/([0-9.]+)", s):
        try:
            v = float(m.group(2) or 0) + float(m.group(3)) / float(m.group(4))
        except (ValueError, ZeroDivisionError):
            return None
        return -v if m.group(1) else v
    if m := re.fullmatch(r"(-?[0-9.]+)\*10\^([0-9]{1,3})", s):
        s = f"{m.group(1)}e{m.group(2)}"
    try:
        return float(s)
    except ValueError:
        return None


def same_answer(given: str | None, gold: str | None) -> bool:
    """Whether two answers are the same: as texts in one writing, or part by part of tuples and intervals of the same brackets.

    Parts are compared as texts, then as numbers; an integer is only met by an integer, a fraction only by the same fraction.
    Symbolic equality beyond that is not decided. Null and empty answers are wrong.
    """
    if not given or not gold:
        return False
    x, y = graded_normal(given), graded_normal(gold)
    if not x or x == y:
        return bool(x)
    a, b = elements(x), elements(y)
    if len(a) != len(b) or len(b) > 1 and (x[0], x[-1]) != (y[0], y[-1]):
        return False
    for p, q in zip(a, b, strict=True):
        p, q = graded_normal(p), graded_normal(q)
        if p == q:
            continue
        fraction, integer = re.compile(r"-?[0-9]+/0*[1-9][0-9]*").fullmatch, re.compile(r"-?[0-9]+").fullmatch
        if fraction(p) and fraction(q) or bool(integer(p)) != bool(integer(q)):
            return False
        v, w = value(p), value(q)
        if v is None or w is None or not math.isclose(v, w, rel_tol=1e-9, abs_tol=1e-12):
            return False
    return True


def same_answer_column(given: Column, gold: Column) -> Column:
    f = F.pandas_udf(lambda a, b: pd.Series([same_answer(x, y) for x, y in zip(a, b, strict=True)], dtype=bool), "boolean")
    return f(given, gold)


# --- pointing -------------------------------------------------------------------------------------------------------


def thought_and_rest(reply: str | None) -> tuple[str, str] | None:
    """What stands in the one ``<think>`` block, which opens the reply, and what follows; None for any other form."""
    if not reply or not reply.startswith("<think>") or reply.count("<think>") != 1 or reply.count("</think>") != 1:
        return None
    thought, _, rest = reply[len("<think>") :].partition("</think>")
    return (thought.strip(), rest.strip()) if thought.strip() and rest.strip() else None


def points_in(text: str) -> list[list[float]] | None:
    """The points of the first JSON list in a text, each ``{"point_2d": [x, y]}``; None if there is none or any is malformed."""
    start = text.find("[")
    if start < 0:
        return None
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "[") - (text[i] == "]")
        if depth == 0:
            break
    try:
        found = json.loads(text[start : i + 1]) if depth == 0 else None
        points = [p["point_2d"] for p in found] if isinstance(found, list) else None
        return points if points is not None and all(isinstance(p, list) and len(p) == 2 and all(isinstance(v, int | float) for v in p) for p in points) else None
    except (ValueError, TypeError, KeyError):
        return None


def in_line(points: list[list[float]]) -> bool:
    """Whether some three points lie on one line."""
    return any(math.isclose((b[1] - a[1]) * (c[0] - a[0]), (c[1] - a[1]) * (b[0] - a[0])) for a, b, c in combinations(points, 3))


_POINTING = ["score", "format", "accuracy", "num_pred", "has_correct", "first_correct", "only_correct", "is_collinear"]


def _pointed(reply: str | None, box: list[float], thinks: bool, fmt: float, acc: float) -> tuple:
    parts = thought_and_rest(reply) if thinks else ("", reply or "")
    points = points_in(parts[1]) if parts else None
    collinear = points is not None and in_line(points)
    if points is None or collinear:
        return -1.0, 0.0, -1.0, 0, 0, 0, 0, int(collinear)
    rank = next((i for i, (x, y) in enumerate(points, 1) if box[0] <= x <= box[2] and box[1] <= y <= box[3]), 0)
    n = len(points)
    accuracy = -1.0 if not n else 1 / math.sqrt(n * rank) if rank else -1 / n
    return fmt + acc * accuracy, 1.0, accuracy, n, int(rank > 0), int(rank == 1), int(rank > 0 and n == 1), 0


def pointing_reward(reply: Column, box: Column, thinks: bool = True, fmt: float = 1.0, acc: float = 1.0) -> Column:
    """(score, format, accuracy, num_pred, has_correct, first_correct, only_correct, is_collinear) of a reply that points into
    ``box`` [x1, y1, x2, y2]: 1 / sqrt(n k) if the k-th of n points is the first inside, else -1 / n; a reply without the think
    block (unless not ``thinks``), without valid points or with three points in a line scores -1. Null replies are malformed."""
    f = F.pandas_udf(
        lambda r, b: pd.DataFrame([_pointed(x, list(y), thinks, fmt, acc) for x, y in zip(r, b, strict=True)], columns=_POINTING),
        "score double, format double, accuracy double, num_pred int, has_correct int, first_correct int, only_correct int, is_collinear int",
    )
    return f(reply, box)
