"""Tolerant JSON: where an answer's JSON begins, how a truncated one is closed, and what can be saved of the rest."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def closed(text: str) -> str:
    """``text`` with its open string and brackets closed and a dangling comma or key removed."""
    stack, inside, escaped = [], False, False
    for c in text:
        if inside:
            inside, escaped = (escaped or c != '"'), (not escaped and c == "\\")
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    out = text + ('"' if inside else "")
    out = re.sub(r"[,\s]+$", "", out)
    if stack and stack[-1] == "}":
        out = re.sub(r'([{,])\s*"[^"]*"\s*$', r"\1", out) if re.search(r'[{,]\s*"[^"]*"\s*$', out) else out
        out = re.sub(r"[,\s]+$", "", re.sub(r':\s*$', ": null", out))
    return out + "".join(reversed(stack))


def _parsed(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return json.dumps(found, ensure_ascii=False) if isinstance(found, (dict, list)) else None


def parsed(text: str | None) -> str | None:
    """Valid JSON text of an answer, or None: the first of these that parses — what follows ``</think>``, a fenced
    block, the whole, what starts at the first brace, that with its end repaired, its entities alone."""
    if text is None:
        return None
    body = text.rsplit("</think>", 1)[-1].strip()
    fence = re.search(r"```(?:json)?\s*(.*?)```", body, re.S)
    tries = [fence.group(1) if fence else None, body]
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start >= 0:
        tail = re.sub(r"```\s*$", "", body[start:]).strip()
        tries += [tail, closed(tail)]
        end = max(tail.rfind("}"), tail.rfind("]"))
        if end > 0:
            tries.append(tail[: end + 1])
            tries.append(closed(tail[: end + 1]))
    for t in tries:
        if (found := _parsed(t)) is not None:
            return found
    items = [m for m in re.findall(r'\{[^{}]*"entity_name"[^{}]*\}', body) if _parsed(m)]
    return json.dumps({"entities": [json.loads(m) for m in items], "relationships": []}, ensure_ascii=False) if items else None


def parsed_column(text: Column) -> Column:
    """``parsed`` over Arrow batches; null where nothing can be saved."""
    return F.pandas_udf(lambda s: s.map(parsed, na_action="ignore"), "string")(text)


def listed(text: Column) -> Column:
    """A JSON array, or a comma list, as an array of stripped non-empty strings; null stays null."""
    items = F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, ","))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def wrapped(text: Column) -> Column:
    """A JSON array as an array; any other text as its only item; null as an empty array."""
    one = F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(F.trim(text)))
    return F.coalesce(one, F.array().cast("array<string>"))


def verdicts(text: Column, pairs: Column) -> Column:
    """Whether the verdict map says yes for ``Pair i``; false where it says nothing."""
    found = F.from_json(text, "map<string,string>")
    return F.coalesce(F.lower(F.trim(F.element_at(found, F.concat(F.lit("Pair "), pairs.cast("string"))))) == "yes", F.lit(False))
