"""Long spans that stand character for character in several records.

Texts are cut into content-defined units and the units' digests are grouped globally, offsets retained. Lines or
paragraphs alone cannot serve as units here: copied stretches start and end inside lines, and some texts have no
lines. A unit is therefore a window of ``unit`` characters chosen by its content: of every ``least - unit + 1``
consecutive windows the one with the smallest hash. Two texts with a common stretch of ``least`` characters
choose the same unit inside it, so no stretch is lost; hashes are exact modular polynomials over code points.

Units that several texts share are compared with their surroundings (``least - unit`` characters to each side
decide whether the common stretch is long enough). Exact copies are grouped by digest first and stand for one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.session import materialize

LEAST = 360
UNIT = 200

#: Units in more texts than this are grouped by whole windows of the least length instead of by pairs of units.
HOT = 64

#: Copies of one text that are paired with all the others in one task.
COPY_PART = 2000

_BASE = np.uint64(0x5851F42D4C957F2D)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 4096)
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            _INVERSES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(_inverse(int(_BASE))))]), dtype=np.uint64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` code points."""
    n = len(codes)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    _grow(n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _POWERS[:n], dtype=np.uint64)])
        h = (sums[width:] - sums[:-width]) * _INVERSES[: n - width + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _sliding(values: np.ndarray, span: int, best: np.ufunc) -> np.ndarray:
    """``best`` over every ``span`` consecutive values, by doubling."""
    out, width = values, 1
    while width * 2 <= span:
        out = best(out[:-width], out[width:])
        width *= 2
    rest = span - width
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def chosen_units(codes: np.ndarray, unit: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the units: windows whose hash is the smallest of some ``least - unit + 1`` in a row.

    Equal smallest hashes are all chosen, so the choice depends on the stretch alone.
    """
    h = window_hashes(codes, unit)
    span = least - unit + 1
    if len(h) < span:  # shorter than ``least``: no stretch of that length
        return np.zeros(0, dtype=np.int64), h[:0]
    low = _sliding(h, span, np.minimum)
    pad = np.zeros(span - 1, dtype=np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), span, np.maximum) == h)
    return at, h[at]


def _units(texts: DataFrame, unit: int, least: int) -> DataFrame:
    """(h, rep, at) of every unit of every text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ats, hs = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, h = chosen_units(code_points(text), unit, least)
                ids.append(np.full(len(at), key, dtype=np.int64))
                ats.append(at.astype(np.int32))
                hs.append(h.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(ats))], ["h", "rep", "at"])

    return texts.select("rep", "text").mapInArrow(cut, "h bigint, rep bigint, at int")


def copies(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, rep): every text of at least ``least`` characters and the smallest doc_id with the same text.

    Digests travel, texts do not; they are combined map-side.
    """
    long = docs.where(F.length("text") >= least).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    reps = long.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return long.join(reps, "digest", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))


@dataclass(frozen=True)
class Shared:
    """Tables of one run: ``members`` (doc_id, rep), ``pairs`` (a, b, start_a, start_b, length) of distinct texts
    and ``hot`` (rep, at, w): whole windows in units that very many texts share."""

    texts: DataFrame
    members: DataFrame
    pairs: DataFrame
    hot: DataFrame
    least: int


def _hot_windows(texts: DataFrame, hot: DataFrame, unit: int, least: int) -> DataFrame:
    """(w, rep, at): the windows of ``least`` characters around hot units, each once per text."""
    reach = least - unit

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rep, ats, text in zip(b["rep"], b["ats"], b["text"], strict=True):
                h = window_hashes(code_points(text), least).view(np.int64)
                near = np.unique((np.asarray(ats)[:, None] - np.arange(reach + 1)[None, :]).ravel())
                near = near[(near >= 0) & (near < len(h))]
                yield pd.DataFrame({"w": h[near], "rep": rep, "at": near.astype("int32")})

    at = hot.groupBy("rep").agg(F.collect_set("at").alias("ats"))
    return texts.join(at, "rep").select("rep", "ats", "text").mapInPandas(cut, "w bigint, rep bigint, at int")


def _chains(pairs: DataFrame, unit: int) -> DataFrame:
    """(a, b, start_a, start_b, sure): runs of units on one diagonal that overlap, which are common for certain."""
    by = Window.partitionBy("a", "b", "d").orderBy("at")
    fresh = F.when(F.col("at") - F.lag("at").over(by) <= unit, 0).otherwise(1)
    runs = pairs.withColumn("run", fresh).withColumn("run", F.sum("run").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("a", "b", "d", "run").agg(F.min("at").alias("start_a"), (F.max("at") - F.min("at") + unit).cast("int").alias("sure")).select(
        "a", "b", "start_a", (F.col("start_a") - F.col("d")).alias("start_b"), "sure"
    )


def _common(left: pd.Series, right: pd.Series, backwards: bool) -> list[int]:
    out = []
    for x, y in zip(left, right, strict=True):
        if backwards:
            x, y = x[::-1], y[::-1]
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            out.append(n)
        else:
            lo, hi = 0, n  # x[:lo] agrees, x[:hi] does not
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if x[:mid] == y[:mid] else (lo, mid)
            out.append(lo)
    return out


def _extended(chains: DataFrame, texts: DataFrame, reach: int) -> DataFrame:
    """Chains with their exact ends: a chain of units ends at most ``reach`` characters before its stretch."""

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rep, cuts, text in zip(b["rep"], b["cuts"], b["text"], strict=True):
                for c in cuts:
                    start, sure = c["start"], c["sure"]
                    rows.append((rep, start, sure, text[max(0, start - reach) : start], text[start + sure : start + sure + reach]))
            yield pd.DataFrame(rows, columns=["rep", "start", "sure", "before", "after"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            left = np.array(_common(b["before_a"], b["before_b"], True), dtype="int32")
            right = np.array(_common(b["after_a"], b["after_b"], False), dtype="int32")
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "start_a": b["start_a"] - left, "start_b": b["start_b"] - left, "length": b["sure"] + left + right})

    cut = F.struct(F.col("start"), F.col("sure"))
    wanted = (
        chains.select(F.col("a").alias("rep"), F.col("start_a").alias("start"), "sure")
        .unionByName(chains.select(F.col("b").alias("rep"), F.col("start_b").alias("start"), "sure"))
        .groupBy("rep").agg(F.collect_set(cut).alias("cuts"))
    )
    ends = texts.join(wanted, "rep").select("rep", "cuts", "text").mapInPandas(around, "rep bigint, start int, sure int, before string, after string")
    side = lambda s: ends.select(F.col("rep").alias(s), F.col("start").alias(f"start_{s}"), "sure", F.col("before").alias(f"before_{s}"), F.col("after").alias(f"after_{s}"))
    both = chains.join(side("a"), ["a", "start_a", "sure"]).join(side("b"), ["b", "start_b", "sure"])
    return both.mapInPandas(measure, "a bigint, b bigint, start_a int, start_b int, length int")


def find_shared(docs: DataFrame, least: int = LEAST, unit: int = UNIT, exact_ends: bool = False, hot: int = HOT) -> Shared:
    """Find every stretch of at least ``least`` characters that two texts of ``docs`` (doc_id, text) share.

    Null texts and texts shorter than ``least`` share nothing; characters are Unicode characters as stored. Without
    ``exact_ends`` the ends of stretches that are long enough for certain are not looked up. Units that stand in
    more than ``hot`` places go to ``Shared.hot`` and are grouped by whole windows, so a boilerplate that is too short
    never makes pairs. Repeated doc_ids are taken once.
    """
    if not 0 < unit <= least:
        raise ValueError("unit must be positive and at most least")
    docs = docs.where(F.length("text") >= least).select("doc_id", "text")
    members = materialize(copies(docs, least).distinct(), "members")
    firsts = members.where("doc_id = rep").select("rep").distinct()
    texts = docs.withColumnRenamed("doc_id", "rep")
    units = _units(texts, unit, least)
    units = materialize(units.join(firsts, "rep", "left_semi"), "all_units")
    # counted map-side, so that a unit of very many texts is no one task
    several = units.groupBy("h").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("h", "n")
    shared = materialize(units.join(several, "h").select("h", "rep", "at", "n"), "units")
    few = shared.where(F.col("n") <= hot)
    left = few.select("h", F.col("rep").alias("a"), F.col("at").alias("at"))
    right = few.select("h", F.col("rep").alias("b"), F.col("at").alias("at_b"))
    meets = left.join(right, "h").where("a < b").select("a", "b", (F.col("at") - F.col("at_b")).alias("d"), "at").distinct()
    chains = materialize(_chains(meets, unit), "chains")
    reach = least - unit
    open_ended = chains if exact_ends else chains.where(F.col("sure") < least)
    pairs = _extended(open_ended, texts, reach)
    if not exact_ends:
        pairs = pairs.unionByName(chains.where(F.col("sure") >= least).withColumnRenamed("sure", "length"))
    many = shared.where(F.col("n") > hot).select("rep", "at")
    hot_windows = _hot_windows(texts, many, unit, least) if not many.isEmpty() else docs.sparkSession.createDataFrame([], "w bigint, rep bigint, at int")
    return Shared(texts, members, pairs.where(F.col("length") >= least), hot_windows, least)


def text_pairs(found: Shared) -> DataFrame:
    """(a, b), a < b: every pair of distinct texts with a common stretch."""
    w = found.hot.select("w", "rep").distinct()
    hot = w.join(w.withColumnRenamed("rep", "other"), "w").where("rep < other").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    return found.pairs.select("a", "b").unionByName(hot).distinct()


def sharing_pairs(found: Shared) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: every pair of documents with a common stretch, exact copies included.

    Copies of one text are paired in parts of at most ``COPY_PART`` of them, so that a text of very many copies is no one task.
    """
    reps = text_pairs(found)
    first = found.members.select(F.col("rep").alias("a"), F.col("doc_id").alias("x"))
    second = found.members.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    across = reps.join(first, "a").join(second, "b").select("x", "y")
    parts = found.members.groupBy(F.col("rep").alias("a")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", F.ceil(F.col("n") / COPY_PART).alias("parts"))
    twins = first.join(parts, "a")
    left = twins.select("a", "x", F.pmod(F.xxhash64("x"), F.col("parts")).alias("part"))
    right = twins.select("a", F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    within = left.join(right, ["a", "part"]).where("x < y").select("x", "y")
    return across.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).unionByName(within.toDF("doc_a", "doc_b"))


def _merge(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _intervals(found: Shared, later_only: bool) -> DataFrame:
    """(rep, start, stop) of the shared stretches of each text; with ``later_only`` those a smaller rep has too."""
    p = found.pairs
    out = p.select(F.col("b").alias("rep"), F.col("start_b").alias("start"), (F.col("start_b") + F.col("length")).alias("stop"))
    if not later_only:
        out = out.unionByName(p.select(F.col("a").alias("rep"), F.col("start_a").alias("start"), (F.col("start_a") + F.col("length")).alias("stop")))
    seen = found.hot.groupBy("w").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    hot = found.hot.join(seen, "w").where(F.col("rep") > F.col("lo") if later_only else F.lit(True))
    return out.unionByName(hot.select("rep", F.col("at").alias("start"), (F.col("at") + found.least).alias("stop"))).distinct()


_SPANS = "rep bigint, shared_chars int, spans array<struct<start:int,length:int>>"


def _merged(intervals: DataFrame) -> DataFrame:
    """Intervals of each text merged; the intervals of one text are bounded by its length."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rep, cuts in zip(b["rep"], b["cuts"], strict=True):
                spans = _merge([(c["start"], c["stop"]) for c in cuts])
                rows.append((rep, sum(z - a for a, z in spans), [{"start": a, "length": z - a} for a, z in spans]))
            yield pd.DataFrame(rows, columns=["rep", "shared_chars", "spans"])

    return intervals.groupBy("rep").agg(F.collect_set(F.struct("start", "stop")).alias("cuts")).mapInPandas(merge, _SPANS)


def shared_report(docs: DataFrame, least: int = LEAST, unit: int = UNIT, hot: int = HOT) -> DataFrame:
    """For each document that shares a stretch: its length, the shared stretches (start, length; merged), how many
    characters and what share of the text they cover, the partner documents in number and the smallest one.

    ``n_partners`` counts exact copies and the documents that share a stretch which at most ``hot`` different texts hold;
    ``n_common`` is the number of other documents that hold the most frequent of the stretches in more texts, of which no pairs
    are made. Exact copies share their whole text. Documents that share nothing do not come out.
    """
    found = find_shared(docs, least, unit, exact_ends=True, hot=hot)
    found = Shared(found.texts, found.members, materialize(found.pairs, "pairs"), materialize(found.hot, "hot"), least)
    groups = found.members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"), F.min(F.when(F.col("doc_id") != F.col("rep"), F.col("doc_id"))).alias("second"))
    groups = materialize(groups, "groups")
    sizes = groups.select(F.col("rep").alias("o"), "copies")
    once = materialize(found.hot.select("w", "rep").distinct().join(groups.select("rep", "copies"), "rep"), "held")
    held = once.groupBy("w").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("holders"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    held = materialize(held, "windows")
    some = once.join(held.where(F.col("texts") <= hot).select("w"), "w").select("w", "rep")  # few texts, if in many places
    rare = some.join(some.withColumnRenamed("rep", "other"), "w").where("rep < other").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    held = held.where(F.col("texts") > hot)
    reps = found.pairs.select("a", "b").unionByName(rare).distinct()
    both = reps.select(F.col("a").alias("rep"), F.col("b").alias("o")).unionByName(reps.select(F.col("b").alias("rep"), F.col("a").alias("o")))
    near = both.join(sizes, "o").groupBy("rep").agg(F.sum("copies").alias("near"), F.min("o").alias("low"))  # copies are counted, not paired
    # the smallest other text of a window is the smallest, or for that one the second smallest, found among the rest
    runner = once.join(held.select("w", "lo"), "w").where(F.col("rep") > F.col("lo")).groupBy("w").agg(F.min("rep").alias("next"))
    in_hot = once.join(held.join(runner, "w"), "w").groupBy("rep").agg(
        F.max(F.col("holders") - F.col("copies")).alias("n_common"), F.min(F.when(F.col("rep") == F.col("lo"), F.col("next")).otherwise(F.col("lo"))).alias("low_common")
    )
    own = F.when(F.col("doc_id") == F.col("rep"), F.col("second")).otherwise(F.col("rep"))
    partners = found.members.join(groups, "rep").join(near, "rep", "left").join(in_hot, "rep", "left").select(
        "doc_id", "rep", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_partners"), F.coalesce("n_common", F.lit(0)).alias("n_common"), F.least(own, "low", "low_common").alias("first_partner")
    ).where("n_partners + n_common > 0")
    twins = groups.where("copies > 1").select("rep")
    lengths = docs.where(F.length("text") >= least).select("doc_id", F.length("text").alias("n_chars")).distinct()
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_chars").alias("length")))
    spans = _merged(_intervals(found, False))
    return (
        partners.join(lengths, "doc_id").join(spans, "rep", "left").join(twins.withColumn("twin", F.lit(True)), "rep", "left")
        .select(
            "doc_id", "n_chars",
            F.when(F.col("twin"), F.col("n_chars")).otherwise(F.col("shared_chars")).alias("shared_chars"),
            F.when(F.col("twin"), whole).otherwise(F.col("spans")).alias("spans"),
            "n_partners", "n_common", "first_partner",
        )
        .withColumn("share", F.col("shared_chars") / F.col("n_chars"))
    )


def without_later_occurrences(docs: DataFrame, least: int = LEAST, unit: int = UNIT) -> DataFrame:
    """(doc_id, text, removed): each shared stretch kept where the smallest doc_id holds it and cut from the rest.

    ``removed`` has the (start, length) of what was cut, by the original offsets. Exact copies of an earlier
    text become empty. Null and short texts stay as they are.
    """
    found = find_shared(docs, least, unit, exact_ends=True)
    cuts = _merged(_intervals(found, True)).select("rep", "spans")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, removed = [], []
            for doc, rep, text, spans in zip(b["doc_id"], b["rep"], b["text"], b["spans"], strict=True):
                if text is None or pd.isna(rep):
                    spans = []
                elif rep != doc:
                    spans = [{"start": 0, "length": len(text)}]
                elif spans is None:
                    spans = []
                kept, last = [], 0
                for s in spans:
                    kept.append(text[last : s["start"]])
                    last = s["start"] + s["length"]
                texts.append(text if text is None else "".join(kept) + text[last:])
                removed.append([{"start": s["start"], "length": s["length"]} for s in spans])
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts, "removed": removed})

    rows = docs.select("doc_id", "text").join(found.members, "doc_id", "left").join(cuts, "rep", "left")
    return rows.select("doc_id", "rep", "text", "spans").mapInPandas(cut, "doc_id bigint, text string, removed array<struct<start:int,length:int>>")
