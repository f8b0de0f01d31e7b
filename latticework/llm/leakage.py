"""Evaluation passages inside training text: a hash set of normalised test n-grams against token windows.

Words are compared without regard to case, width, punctuation, mark-up characters, spacing, line breaks and
invisible characters. The n-grams of the items are broadcast as sorted 64-bit hashes while their counted number is within a
bound; beyond it they are joined by hash instead, with the same result. Every hit is verified word by word.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.session import materialize

WINDOW = 12

#: Most n-grams of items that are broadcast, each a hash and its word numbers (about 150 bytes with the words themselves), and
#: most characters of the items for each of them; more are joined by hash.
BROADCAST_NGRAMS, CHARS_EACH = 500_000, 16

#: Parts into which the documents of one n-gram are split where n-grams are joined, so that a passage of very many is no one task.
SALTS = 8

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\ufe00-\\ufe0f\\ufeff]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|&(?:[A-Za-z]{2,8}|#\d{1,6}|#x[0-9A-Fa-f]{1,6});")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Words of a text in one writing; none for null."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _MARKS.sub("", text))
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.casefold())


def glued_words(text: str | None) -> list[str]:
    """As ``words``, with the parts of a hyphenated or apostrophised word as one word."""
    return words(re.sub(r"(?<=\w)[-'’‐‑](?=\w)", "", text)) if text else []


def item_grams(text: str | None, n: int, whole_short: bool = False) -> list[tuple[str, ...]]:
    """The n-grams of an item in both forms; with ``whole_short`` an item of fewer words is one gram of all its words."""
    out: dict[tuple[str, ...], None] = {}
    for w in {tuple(words(text)), tuple(glued_words(text))}:
        if whole_short and 0 < len(w) < n:
            out[w] = None
        for k in range(len(w) - n + 1):
            out[w[k : k + n]] = None
    return list(out)


class Index:
    """The grams of the items: word numbers, and for each length of gram the sorted hashes, words and items."""

    def __init__(self, items: list[tuple[int, str | None]], n: int = WINDOW, whole_short: bool = False):
        grams: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for item, text in items:
            for g in item_grams(text, n, whole_short):
                grams[g].add(item)
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for g in grams for w in g}))}
        self.tables = []
        for width in sorted({len(g) for g in grams}):
            some = [g for g in grams if len(g) == width]
            ids = np.array([[self.number[w] for w in g] for g in some], dtype=np.uint32)
            hashes = self._hash(ids.ravel(), width)[::width]
            order = np.argsort(hashes, kind="stable")
            self.tables.append((width, hashes[order], ids[order], [tuple(sorted(grams[some[i]])) for i in order]))

    @staticmethod
    def _hash(ids: np.ndarray, width: int) -> np.ndarray:
        out, power = np.zeros(len(ids) - width + 1, dtype=np.uint64), np.uint64(1)
        with np.errstate(over="ignore"):
            for i in range(width):
                out += ids[i : i + len(out)].astype(np.uint64) * power
                power = power * _BASE
        return out

    def positions(self, found: list[str]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(word position, width, items) of every gram in a text's words."""
        if not self.tables or len(found) < self.tables[0][0]:
            return
        get = self.number.get
        ids = np.fromiter((get(x, 0) for x in found), dtype=np.uint32, count=len(found))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for width, hashes, grams, items in self.tables:
            if len(ids) < width:
                break
            starts = np.flatnonzero(known[width:] - known[:-width] == width)
            if not len(starts):
                continue
            of = self._hash(ids, width)[starts]
            at = np.searchsorted(hashes, of)
            hit = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == of)
            for p, k in zip(starts[hit].tolist(), at[hit].tolist(), strict=True):
                h = hashes[k]
                while k < len(hashes) and hashes[k] == h:  # of equal hashes the gram of the same words
                    if (grams[k] == ids[p : p + width]).all():
                        yield p, width, items[k]
                        break
                    k += 1

    def find(self, text: str | None) -> dict[int, tuple[int, int]]:
        """item -> (first word position, number of matching windows)."""
        out: dict[int, tuple[int, int]] = {}
        for p, _, items in self.positions(words(text)):
            for item in items:
                first, count = out.get(item, (p, 0))
                out[item] = (min(first, p), count + 1)
        return out


SCHEMA = "doc_id bigint, item_id bigint, first_word int, windows int"


def _fitting(items: DataFrame, n: int, most: int, whole_short: bool) -> tuple[DataFrame, Index | None]:
    """The distinct texts of the items, and their index if their counted grams are few enough to be broadcast."""
    texts = items.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"grams": [len(item_grams(t, n, whole_short)) for t in b["text"]], "chars": b["text"].str.len()})

    size = texts.mapInPandas(count, "grams bigint, chars bigint").agg(F.sum("grams").alias("grams"), F.sum("chars").alias("chars")).first()
    if (size.grams or 0) > most or (size.chars or 0) > most * CHARS_EACH:
        return texts, None
    return texts, Index([(r.item_id, r.text) for r in texts.collect()], n, whole_short)


def find_leaks(docs: DataFrame, items: DataFrame, n: int = WINDOW, most: int = BROADCAST_NGRAMS, whole_short: bool = False) -> DataFrame:
    """(doc_id, item_id, first_word, windows) for each document that holds ``n`` consecutive words of an item.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not read. Null and empty texts match nothing,
    nor do items without an id; an item of fewer than ``n`` words matches nothing, with ``whole_short`` where all its words stand in
    a row. An empty side gives no rows. Every row of ``docs`` counts by itself, so repeated rows give repeated results; those of
    ``items`` do not. Whole texts are scanned, whatever their length. ``first_word`` counts from 0; ``windows`` are the
    word positions at which a gram of the item starts. More than ``most`` n-grams are joined instead of broadcast, with the same result.
    """
    texts, index = _fitting(items, n, most, whole_short)
    if index is None:
        return _joined(docs, texts, n, whole_short)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = shared.value.find
        for b in batches:
            rows = [(d, item, *hit) for d, t in zip(b["doc_id"], b["text"], strict=True) for item, hit in find(t).items()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "windows"])

    return docs.select("doc_id", "text").mapInPandas(scan, SCHEMA)


def _joined(docs: DataFrame, texts: DataFrame, n: int, whole_short: bool) -> DataFrame:
    """The same result without a broadcast: windows are joined by hash and compared word by word."""

    def cut_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, len(g), " ".join(g)) for k, t in zip(b["item_id"], b["text"], strict=True) for g in item_grams(t, n, whole_short)]
            yield pd.DataFrame(rows, columns=["item_id", "width", "gram"])

    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    grams = materialize(texts.mapInPandas(cut_items, "item_id bigint, width int, gram string").distinct().withColumn("h", F.xxhash64("gram")), "grams")
    widths = sorted(r.width for r in grams.select("width").distinct().collect())  # at most n

    def cut_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, k, t in zip(b["row"], b["doc_id"], b["text"], strict=True):
                w = words(t)
                rows = [(row, k, i, " ".join(w[i : i + width])) for width in widths for i in range(len(w) - width + 1)]
                if rows:
                    yield pd.DataFrame(rows, columns=["row", "doc_id", "at", "gram"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    windows = rows.mapInPandas(cut_docs, "row bigint, doc_id bigint, at int, gram string").withColumn("h", F.xxhash64("gram")).withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    hits = windows.join(grams.select("item_id", "gram", "h", salts), ["h", "gram", "salt"])
    return hits.groupBy("row", "doc_id", "item_id").agg(F.min("at").alias("first_word"), F.count(F.lit(1)).cast("int").alias("windows")).drop("row")


def clean(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """Documents without those that leak (left anti join on doc_id); documents without an id stay."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
