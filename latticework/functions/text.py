"""Text rules as JVM expressions; a Python batch function only where nesting must be counted."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def bigrams(s: Column) -> Column:
    """Distinct pairs of neighbouring characters; none for texts shorter than two."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(2)))
    return F.when(F.length(s) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def digit_in_difference(a: Column, b: Column) -> Column:
    """Whether a character pair that only one text has holds a digit."""
    x, y = bigrams(a), bigrams(b)
    return F.exists(F.concat(F.array_except(x, y), F.array_except(y, x)), lambda p: p.rlike(r"\d"))


def characters(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))


def alike(a: Column, b: Column, x: Column, y: Column) -> Column:
    """An edit distance of at most half the shorter text, or enough common characters; ``x`` and ``y`` are the texts' characters."""
    most, common = F.greatest(F.size(x), F.size(y)), F.size(F.array_intersect(x, y))
    by_chars = F.when(most < 4, common > 1).otherwise(common / most >= 0.8)
    near = F.levenshtein(a, b) <= F.floor(F.least(F.length(a), F.length(b)) / 2)
    return near | by_chars


def names_alike(a: Column, b: Column) -> Column:
    """No digit in the difference, and either an edit distance of at most half the shorter text or enough common
    characters."""
    return ~digit_in_difference(a, b) & alike(a, b, characters(a), characters(b))


def answer_normal(s: Column) -> Column:
    """Lower case without ASCII punctuation, articles and extra white space."""
    t = F.regexp_replace(F.lower(s), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(prediction: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: answer_normal(g) == answer_normal(prediction))


def contained_match(prediction: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: F.contains(answer_normal(prediction), answer_normal(g)))


def last_tag(s: Column, tag: str = "answer") -> Column:
    """The content of the last tag, null if there is none."""
    found = F.regexp_extract_all(s, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), 1)
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def tag_score(prediction: Column, golds: Column, most_tags: int = 10) -> Column:
    """1 for an exact match of the last answer, 0.25 if more than ``most_tags`` tags were opened, else 0."""
    hit = F.coalesce(exact_match(last_tag(prediction), golds), F.lit(False))
    many = F.regexp_count(prediction, F.lit("<answer>")) > most_tags
    return F.when(hit, F.when(many, 0.25).otherwise(1.0)).otherwise(0.0)


def think_and_answer(s: Column) -> Column:
    """(thought, answer): the text before the first answer tag, and its content; empty strings if there is none."""
    pattern = r"(?s)^(.*?)\s*<answer>(.*?)</answer>"
    return F.struct(F.regexp_extract(s, pattern, 1).alias("thought"), F.trim(F.regexp_extract(s, pattern, 2)).alias("answer"))


def stripped(s: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def world_model(s: Column, separator: str = ",", most: int = 3) -> Column:
    """(observation, think, answer, prediction, actions, format_correct) of a reply in that format and order.

    ``actions`` are the parts of the answer, lower-cased, without blanks, at most ``most``; if there were more, the answer is
    made of those kept. A reply in another format, or null, gives empty texts and no actions.
    """
    pattern = r"(?s)<observation>(.*?)</observation>\s*<think>(.*?)</think>\s*<answer>(.*?)</answer>\s*<prediction>(.*?)</prediction>"
    s = F.coalesce(s, F.lit(""))
    part = lambda i: stripped(F.regexp_extract(s, pattern, i))
    actions = F.filter(F.transform(F.split(part(3), re.escape(separator)), lambda x: F.lower(stripped(x))), lambda x: x != "")
    answer = F.when(F.size(actions) > most, F.array_join(F.slice(actions, 1, most), separator)).otherwise(part(3))
    return F.struct(part(1).alias("observation"), part(2).alias("think"), answer.alias("answer"), part(4).alias("prediction"), F.slice(actions, 1, most).alias("actions"), s.rlike(pattern).alias("format_correct"))


def action_parts(s: Column) -> Column:
    """(verb, arg, number): an action such as ``MOVE Paris`` split once at white space, in its own case; ``arg`` is null if there is
    none, ``number`` unless it is an integer."""
    pattern = r"(?s)^\s*(\S+)(?:\s+(\S.*?))?\s*$"
    arg = F.nullif(F.regexp_extract(s, pattern, 2), F.lit(""))
    return F.struct(F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).alias("verb"), arg.alias("arg"), F.when(arg.rlike(r"^[+-]?\d+$"), arg.try_cast("int")).alias("number"))


def final_number(s: Column, strict: bool = True, tail: int = 300) -> Column:
    """The number after the last ``####`` (strict), or the last number, in the last ``tail`` characters; no commas and
    dollar signs. Null if there is none; if no match is a number, the first match."""
    end = F.right(s, F.lit(tail))
    if strict:
        found = F.regexp_extract_all(end, F.lit(r"#### (\-?[0-9\.\,]+)"), 1)
        return F.when(F.size(found) > 0, F.regexp_replace(F.element_at(found, -1), r"[,$]", ""))
    found = F.regexp_extract_all(end, F.lit(r"(\-?[0-9\.\,]+)"), 1)
    good = F.filter(found, lambda x: (x != "") & (x != "."))
    return F.when(F.size(good) > 0, F.element_at(good, -1)).when(F.size(found) > 0, F.get(found, 0))


def last_boxed(text: str | None) -> str | None:
    r"""The last ``\boxed{...}`` with balanced braces, or ``\fbox{...}``; null if there is none or it does not close."""
    if text is None:
        return None
    at = max(text.rfind("\\boxed{"), text.rfind("\\fbox{"))
    if at < 0:
        return None
    depth = 0
    for i in range(text.index("{", at), len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[at : i + 1]
    return None


def boxed_content(text: str | None) -> str | None:
    found = last_boxed(text)
    return None if found is None else found[found.index("{") + 1 : -1]


def boxed_column(s: Column) -> Column:
    """``boxed_content`` over Arrow batches: nesting cannot be counted by a regular expression."""
    return F.pandas_udf(lambda x: x.map(boxed_content, na_action="ignore"), "string")(s)


# What mathematical answers are stripped of.
_DROPPED = ("\\!", "\\ ", "\\left", "\\right", "^{\\circ}", "^\\circ", "\\$", "\\%", "%", "$")
_UNITS = ("degrees", "degree", "cm", "meters", "inches", "hours", "minutes", "dollars", "points")


def math_normal(s: str | None) -> str | None:
    """A mathematical answer in one writing: no spacing commands, units and trailing dots, fractions as \\frac{a}{b}."""
    if s is None:
        return None
    s = s.replace("\n", "").replace("tfrac", "frac").replace("dfrac", "frac")
    for d in _DROPPED:
        s = s.replace(d, "")
    s = re.sub(r"\\text\{\s*(?:" + "|".join(_UNITS) + r")[^}]*\}", "", s)
    s = re.sub(r"\s*(?:" + "|".join(_UNITS) + r")\.?$", "", s.strip())
    s = re.sub(r"^[A-Za-z]\s*=\s*", "", s)
    s = re.sub(r"\\sqrt\s*(\w)", r"\\sqrt{\1}", s)
    s = re.sub(r"\\frac\s*(\d)\s*(\d)", r"\\frac{\1}{\2}", s)
    s = re.sub(r"\\frac\s*(\d)\s*\{", r"\\frac{\1}{", s)
    s = re.sub(r"^(-?\d+)/(\d+)$", r"\\frac{\1}{\2}", s.replace(" ", ""))
    s = re.sub(r"^\.", "0.", s.rstrip("."))
    s = re.sub(r"(?<=\d),(?=\d{3})", "", s)
    return "\\frac{1}{2}" if s == "0.5" else s


def math_equal(a: str | None, b: str | None) -> bool:
    """Whether two answers agree after ``math_normal``, as text or as numbers."""
    x, y = math_normal(a), math_normal(b)
    if x is None or y is None:
        return False
    if x == y:
        return True
    try:
        return abs(float(x) - float(y)) < 1e-9
    except ValueError:
        return False


def math_score(answer: Column, gold: Column) -> Column:
    """1.0 where the boxed answer equals the gold one, else 0.0."""
    f = F.pandas_udf(lambda a, g: pd.Series([float(math_equal(boxed_content(x), y)) for x, y in zip(a, g, strict=True)]), "double")
    return f(answer, gold)


def choice_letter(s: Column) -> Column:
    """The letter after ``Answer:``, empty if there is none."""
    return F.upper(F.regexp_extract(s, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1))


def overlong_penalty(length: Column, limit: int, buffer: int, factor: float = 1.0) -> Column:
    """0 up to ``limit - buffer``, then falling linearly by ``factor`` over the buffer."""
    return F.least(-(length - (limit - buffer)) / buffer * factor, F.lit(0.0))


def tool_reward(score: Column, turns: Column) -> Column:
    """A negative score is eased for each pair of turns, to at most -0.6."""
    return F.when(score < 0, F.least(F.lit(-0.6), score + (turns - 2) / 2 * 0.1)).otherwise(score)


def character_count(s: Column, c: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))


def cleaned_title(s: Column) -> Column:
    """Bracketed marks removed: `` [title]`` ends a sentence, others vanish; double spaces become one."""
    t = F.replace(F.trim(s), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(t, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def passages(texts: Column) -> Column:
    """``Doc i (Title: first line) rest`` for each text, one per line."""
    one = lambda t, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.substring_index(t, "\n", 1), F.lit(") "), F.substring(t, F.length(F.substring_index(t, "\n", 1)) + 2, F.length(t)))
    return F.array_join(F.transform(texts, one), "\n")


def text_parts(content: Column) -> Column:
    """The text items of a message's content, joined."""
    return F.array_join(F.transform(F.filter(content, lambda x: x["type"] == "text"), lambda x: x["text"]), "")


def step_score(predicted: Column, gold: Column, steps: Column) -> Column:
    """Score of a predicted step index: 1 if right, less by distance within range, -1 for an invalid or missed one."""
    valid = predicted.isNotNull() & (predicted >= -1) & (predicted < steps)
    return F.when(~F.coalesce(valid, F.lit(False)), -1.0).when(predicted == gold, 1.0).when((predicted == -1) | (gold == -1), -1.0).otherwise(1 - F.abs(predicted - gold) / steps)


def in_box(x: Column, y: Column, box: Column) -> Column:
    """Whether a point lies in [x1, y1, x2, y2], edges included."""
    return (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])


def ranked_point_reward(points: Column, box: Column) -> Column:
    """1 / sqrt(n k) for the first of n points inside the box at rank k, -1 / n if none is, 0 without points."""
    n = F.size(points)
    k = F.array_position(F.transform(points, lambda p: in_box(p["x"], p["y"], box)), True)
    return F.when(n <= 0, 0.0).when(k > 0, 1 / F.sqrt(n * k)).otherwise(-1 / n)


def any_three_in_line(points: Column) -> Column:
    """Whether some three points lie on one line."""
    def cross(p: Column, q: Column, s: Column) -> Column:
        return (q["x"] - p["x"]) * (s["y"] - p["y"]) - (q["y"] - p["y"]) * (s["x"] - p["x"])

    tail = lambda a: F.slice(points, a + 2, F.size(points))
    pairs = lambda p, i: F.exists(F.sequence(i + 1, F.size(points) - 1), lambda j: F.exists(tail(j), lambda s: cross(p, F.get(points, j), s) == 0))
    idx = F.sequence(F.lit(0), F.greatest(F.size(points) - 3, F.lit(0)))
    return F.when(F.size(points) < 3, False).otherwise(F.exists(idx, lambda i: pairs(F.get(points, i), i)))


def sized_box(box: Column, width: int, height: int, least: int) -> Column:
    """A box bounded to the image and widened around its middle to at least ``least`` a side."""
    def side(a: Column, b: Column, most: int) -> tuple[Column, Column]:
        lo, hi = F.greatest(a, F.lit(0)), F.least(b, F.lit(most))
        grow = F.greatest(F.lit(0), F.lit(least) - (hi - lo))
        low = F.greatest(F.lit(0), F.least(lo - F.floor(grow / 2), F.lit(most - least)))
        return low, F.least(F.lit(most), F.greatest(hi, low + least))

    x1, x2 = side(box[0], box[2], width)
    y1, y2 = side(box[1], box[3], height)
    return F.array(x1.cast("int"), y1.cast("int"), x2.cast("int"), y2.cast("int"))


def transcript_parts(s: Column) -> Column:
    """Segments of a transcript in order: (kind, body) for code, interpreter and answer tags."""
    found = F.regexp_extract_all(s, F.lit(r"(?s)(<(?:code|interpreter|answer)>.*?</(?:code|interpreter|answer)>)"), 1)
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, "^<(\\w+)>", 1).alias("kind"), F.trim(F.regexp_extract(x, "(?s)^<\\w+>(.*)</\\w+>$", 1)).alias("body")))


def answer_cascade(s: Column) -> Column:
    """The answer tag's content, else what follows the last tool response, else the text without tags."""
    tail = F.regexp_extract(s, r"(?s)</tool_response>((?:(?!</tool_response>).)*)$", 1)
    bare = F.regexp_replace(s, r"<[^<>]+>", "")
    pick = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(last_tag(s), pick(F.regexp_replace(tail, r"<[^<>]+>", "")), pick(bare), s)


def balanced_tags(s: Column, tags: tuple[str, ...] = ("think", "answer")) -> Column:
    """Whether every tag is opened as often as it is closed."""
    out = F.lit(True)
    for t in tags:
        out = out & (F.regexp_count(s, F.lit(f"<{t}>")) == F.regexp_count(s, F.lit(f"</{t}>")))
    return out


def path_text(edges: Column) -> Column:
    """A path as ``a -> b [source] -> c``; empty for no edges."""
    steps = F.transform(edges, lambda e: F.concat(F.lit(" -> "), e["next"], F.coalesce(F.concat(F.lit(" ["), e["source"], F.lit("]")), F.lit(""))))
    return F.when(F.size(edges) > 0, F.concat(F.get(edges, 0)["cur"], F.array_join(steps, ""))).otherwise("")


def scored(source: Column, cases: dict[str, Column]) -> Column:
    """The score of the rule that belongs to a data source; an unknown one raises when run."""
    out = F.raise_error(F.concat(F.lit("no rule for "), F.coalesce(source, F.lit("null")))).cast("double")
    for name, score in cases.items():
        out = F.when(source == name, score).otherwise(out)
    return out
