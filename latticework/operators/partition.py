"""Balanced partitions, token budgets and chunking.

Number partitioning works within one batch, whose size the caller bounds; batches run in parallel.
"""

from __future__ import annotations

import heapq
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_differencing(loads: list[float], k: int, equal: bool = False) -> list[int]:
    """The part of each load by the differencing method: the two most uneven partial solutions are merged, heaviest
    part with lightest. With ``equal`` parts have equal numbers of items (``k`` must divide their number)."""
    if equal and len(loads) % k:
        raise ValueError("equal parts need a multiple of k items")
    order = sorted(range(len(loads)), key=lambda i: (loads[i], i))
    tick = count()
    heap: list[tuple[float, int, list[tuple[float, list[int]]]]] = []
    groups = [order[i : i + k] for i in range(0, len(order), k)] if equal else [[i] for i in order]
    for g in groups:
        parts = sorted(([(float(loads[i]), [i]) for i in g] + [(0.0, []) for _ in range(k - len(g))]), key=lambda p: p[0])
        heapq.heappush(heap, (parts[0][0] - parts[-1][0], next(tick), parts))
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda p: p[0])
        heapq.heappush(heap, (merged[0][0] - merged[-1][0], next(tick), merged))
    out = [0] * len(loads)
    if heap:
        final = sorted(heap[0][2], key=lambda p: min(p[1], default=len(loads)))
        for part, (_, items) in enumerate(final):
            for i in items:
                out[i] = part
    return out


def greedy(loads: list[float], k: int, equal: bool = False) -> list[int]:
    """Each load in input order to the lightest part; with ``equal`` full parts are left out."""
    total, size, out = [0.0] * k, [0] * k, []
    most = -(-len(loads) // k) if equal else len(loads)
    for x in loads:
        part = min((p for p in range(k) if size[p] < most), key=lambda p: (total[p], p))
        total[part] += x
        size[part] += 1
        out.append(part)
    return out


def partitioned(df: DataFrame, batch: str, order: str, load: str, k: int, method: str = "differencing", equal: bool = False) -> DataFrame:
    """Adds ``part`` (0..k-1) within each batch. A null load counts 0."""
    solve = {"differencing": largest_differencing, "greedy": greedy}[method]

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(order)
        return b.assign(part=solve(b[load].fillna(0).tolist(), k, equal))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(batch).applyInPandas(run, f"{schema}, part int")


def imbalance(df: DataFrame, batch: str, order: str, load: str, k: int) -> DataFrame:
    """(batch, kind, low, high, gap): load extremes of contiguous parts against the assigned ones in ``part``."""
    w = Window.partitionBy(batch)
    place = F.floor((F.row_number().over(w.orderBy(order)) - 1) * k / F.count(F.lit(1)).over(w))
    rows = df.withColumn("plain", place)
    out = None
    for kind, c in (("contiguous", "plain"), ("balanced", "part")):
        sums = rows.groupBy(batch, c).agg(F.sum(load).alias("x")).groupBy(batch).agg(F.min("x").alias("low"), F.max("x").alias("high"))
        sums = sums.select(batch, F.lit(kind).alias("kind"), "low", "high", (F.col("high") - F.col("low")).alias("gap"))
        out = sums if out is None else out.unionByName(sums)
    return out


def workload(length: Column) -> Column:
    """Cost of a sequence: linear plus quadratic in its length."""
    return 24576 * length + length * length


def micro_batches(df: DataFrame, batch: str, length: str, most: int) -> DataFrame:
    """(batch, n): how many micro-batches a token budget asks for."""
    return df.groupBy(batch).agg(F.ceil(F.sum(length) / most).cast("bigint").alias("n"))


def zigzag(df: DataFrame, batch: str, load: str, order: str) -> DataFrame:
    """Adds ``place``: sorted by load, every other one to the front in falling order, the rest to the back."""
    w = Window.partitionBy(batch)
    i = F.row_number().over(w.orderBy(load, order)) - 1
    n = F.count(F.lit(1)).over(w)
    evens = F.ceil(n / 2)
    return df.withColumn("place", F.when(i % 2 == 0, evens - 1 - i / 2).otherwise(evens + (i - 1) / 2).cast("int"))


def token_chunks(df: DataFrame, key: str, text: str, size: int = 1024, overlap: int = 128) -> DataFrame:
    """(key, chunk, start, content): windows of white-space tokens; the last may be shorter. No tokens, no rows."""
    tokens = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    rows = df.select(key, tokens.alias("t")).where(F.size("t") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("t") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    out = rows.select(key, "t", F.posexplode(starts).alias("chunk", "start"))
    return out.select(key, "chunk", "start", F.array_join(F.slice("t", F.col("start") + 1, F.lit(size)), " ").alias("content"))


def media_parts(content: Column) -> Column:
    """A message cut around ``<image>`` and ``<video>``: an array of (type, text), empty texts left out."""
    pieces = F.filter(F.split(content, r"(?<=<image>|<video>)|(?=<image>|<video>)"), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(F.when(x == "<image>", "image").when(x == "<video>", "video").otherwise("text").alias("type"), F.when(~x.isin("<image>", "<video>"), x).alias("text")))


def shuffled_options(options: Column, key: Column, seed: int = 3) -> Column:
    """Options in a pseudo-random order by an arithmetic hash of ``key`` and their place.

    The hash is the remainder by 2**32 of (key * 7919 + place * 104729 + seed) * 2654435761, with the sign of that product.
    Every factor is reduced first, so that no key of 64 bits overflows; 2654435761 is 40503 * 65536 + 31153.
    """
    n, whole = F.size(options), F.lit(4294967296)
    k = key.cast("bigint")

    def hashed(i: Column) -> Column:
        add = (i + 1).cast("bigint") * 104729 + seed
        x = F.pmod(F.pmod(k, whole) * 7919 + add, whole)
        rest = F.pmod(F.pmod(x * 40503, F.lit(65536)) * 65536 + x * 31153, whole)
        below = F.greatest(k, F.lit(-(2**40))) * 7919 < -add  # smaller keys are below 0 whatever is added
        return F.when((k < 0) & below & (rest > 0), rest - whole).otherwise(rest)

    keyed = F.transform(options, lambda o, i: F.struct(F.when(k.isNotNull(), hashed(i)).alias("k"), o.alias("o")))
    return F.when(n >= 0, F.transform(F.array_sort(keyed), lambda x: x["o"]))


def gold_letter(options: Column, gold: Column) -> Column:
    """A, B, C ... of the gold option; empty if it is not among them."""
    at = F.array_position(options, gold).cast("int")
    return F.when(at > 0, F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), at, F.lit(1))).otherwise("")
