"""Splitting oversized items at natural boundaries, by balanced targets.

For an item the least number of pieces is computed from the limit, the overlap and the boundaries, targets of equal
length are placed, and each target is moved to the strongest boundary near it. Where equal lengths alone would need fewer
pieces than the boundaries allow, pieces are added. Only runs without a boundary that no piece can hold are cut inside, as
seldom as possible, and the text around them as if they were not there. Every piece but the first starts with the last ``overlap``
characters of the piece before it. The work is linear in the length of an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that make boundaries.
_END_MARKS, _WIDE_MARKS = ".!?", "。！？"
_CLOSERS, _WIDE_CLOSERS = "\"')]»”’", "”’」』）"

#: Strength of a boundary, from strongest: end of a paragraph, line, sentence, word; a cut inside a run.
PARAGRAPH, LINE, SENTENCE, WORD, INSIDE = range(5)

_TABLE = 0x10000


def _table(chars: str) -> np.ndarray:
    out = np.zeros(_TABLE + 1, dtype=bool)  # the last entry stands for all characters beyond
    out[[ord(c) for c in chars]] = True
    return out


_SPACE = _table("".join(c for c in map(chr, range(_TABLE)) if c.isspace()))
_END, _WIDE, _CLOSE, _WIDE_CLOSE, _BREAK = (_table(x) for x in (_END_MARKS, _WIDE_MARKS, _CLOSERS, _WIDE_CLOSERS, "\r\n"))


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, strengths, longest run): where a text can be cut, and the longest run without white space or end mark."""
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), _TABLE)
    n = len(codes)
    space, end, wide = _SPACE[codes], _END[codes], _WIDE[codes]
    mark = end | wide
    stops = np.flatnonzero(space | mark)
    longest = int(np.diff(np.concatenate([[-1], stops, [n]])).max()) - 1
    strength = np.full(n + 1, INSIDE, dtype=np.int8)
    strength[np.flatnonzero(mark) + 1] = WORD
    edge = np.flatnonzero(np.diff(np.concatenate([[False], space, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]  # of runs of white space
    if len(starts):
        at = np.arange(n, dtype=np.int64)
        last = np.maximum.accumulate(np.where(_CLOSE[codes], -1, at))  # the character before closing marks
        before = np.where(starts > 0, last[np.maximum(starts - 1, 0)], -1)
        sentence = (before >= 0) & end[np.maximum(before, 0)]
        lines = np.concatenate([[0], np.cumsum(_BREAK[codes])])
        feeds = np.concatenate([[0], np.cumsum(codes == 10)])
        kind = np.where(sentence, SENTENCE, WORD)
        kind = np.where(lines[ends] > lines[starts], LINE, kind)
        strength[ends] = np.where(feeds[ends] - feeds[starts] > 1, PARAGRAPH, kind)
    if wide.any():
        at = np.arange(n + 1, dtype=np.int64)
        beyond_closers = np.minimum.accumulate(np.where(np.append(_WIDE_CLOSE[codes], False), n, at)[::-1])[::-1]
        beyond_space = np.minimum.accumulate(np.where(np.append(space, False), n, at)[::-1])[::-1]
        after = np.flatnonzero(wide & ~np.append(wide[1:], False)) + 1
        after = beyond_space[beyond_closers[after]]
        strength[after] = np.minimum(strength[after], SENTENCE)
    strength[0] = strength[n] = INSIDE
    positions = np.flatnonzero(strength < INSIDE)
    return positions, strength[positions], longest


def has_solid_run(text: str, limit: int) -> bool:
    """Whether a run longer than ``limit`` holds neither white space nor a sentence-end mark."""
    return bool(text) and boundaries(text)[2] > limit


def _with_forced(positions: np.ndarray, strengths: np.ndarray, first: int, n: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries beyond ``first``, with as few points as will do inside each stretch longer than ``step`` that has none."""
    keep = positions > first
    positions, strengths = positions[keep], strengths[keep]
    ends = np.concatenate([[first], positions, [n]])
    more = [
        a + (b - a) * np.arange(1, k + 1) // (k + 1)
        for a, b in zip(ends[:-1][np.diff(ends) > step], ends[1:][np.diff(ends) > step], strict=True)
        for k in [-(-(b - a) // step) - 1]
    ]
    if more:
        extra = np.concatenate(more)
        positions, strengths = np.concatenate([positions, extra]), np.concatenate([strengths, np.full(len(extra), INSIDE, dtype=np.int8)])
        order = np.argsort(positions, kind="stable")
        positions, strengths = positions[order], strengths[order]
    return positions, strengths


def split_text(text: str, limit: int = 1200, overlap: int = 120, found: tuple[np.ndarray, np.ndarray, int] | None = None) -> list[tuple[int, int, bool]]:
    """(start, end, natural) of the pieces of ``text``; ``natural`` says whether ``end`` lies on a boundary.

    A text within the limit is one piece. Pieces cover the text without gaps, none is longer than ``limit``, and
    each starts ``overlap`` characters before the end of the one before it. A run longer than ``limit`` less ``overlap`` has to be
    cut inside, since a piece that holds it has no room for the overlap. ``found`` are the text's ``boundaries``, if known.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, True)]
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    step = limit - overlap
    positions, strengths, _ = found or boundaries(text)
    positions, strengths = _with_forced(positions, strengths, overlap, n, step)
    # from the end, the earliest cut after which the rest fits in one piece, in two pieces and so on
    earliest, at = [], n
    while at - step > overlap:
        at = int(positions[np.searchsorted(positions, at - step)])
        earliest.append(at)
    earliest.reverse()
    pieces = len(earliest) + 1
    equal = (n + (pieces - 1) * overlap) / pieces
    out, last, start = [], overlap, 0
    for i, low in enumerate(earliest, 1):
        a, z = np.searchsorted(positions, [max(low, last + 1), last + step + 1])
        target = i * (equal - overlap) + overlap
        off = np.abs(positions[a:z] - target)
        # the strongest within reach of the target, else the strongest at all; of equals the nearest
        k = a + int(np.lexsort((positions[a:z], off, strengths[a:z], (off > limit // 4) | (strengths[a:z] == INSIDE)))[0])
        cut = int(positions[k])
        out.append((start, cut, bool(strengths[k] < INSIDE)))
        start, last = cut - overlap, cut
    out.append((start, n, True))
    return out


def split_items(df: DataFrame, id_column: str = "ori_id", items: str = "context", limit: int = 1200, overlap: int = 120, keep_short: bool = False) -> DataFrame:
    """Pieces of every item of the array ``items`` that is longer than ``limit`` characters.

    Columns: id, ``item_no`` (from 0, null and blank items counted), ``piece_no`` (from 0), ``start`` and ``length``
    in the item, ``cut`` of the item (``forced`` if a run longer than the limit has no white space and no
    sentence-end mark, else ``natural``), ``on_boundary`` of the piece's end, and ``piece``. With ``keep_short`` items
    within the limit come out as one piece; null items never do. Null or empty arrays give no rows; repeated
    pages repeat; lengths count Unicode characters as stored. Other columns are not read. No shuffle.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, texts in zip(b[id_column], b[items], strict=True):
                if texts is None:
                    continue
                for no, text in enumerate(texts):
                    if text is None or (len(text) <= limit and not keep_short):
                        continue
                    found = boundaries(text) if text else None
                    cut = "forced" if found and found[2] > limit else "natural"
                    for k, (a, z, natural) in enumerate(split_text(text, limit, overlap, found)):
                        rows.append((key, no, k, a, z - a, cut, natural, text[a:z]))
            yield pd.DataFrame(rows, columns=[id_column, "item_no", "piece_no", "start", "length", "cut", "on_boundary", "piece"])

    schema = f"`{id_column}` {kind}, item_no bigint, piece_no int, start int, length int, cut string, on_boundary boolean, piece string"
    return df.select(id_column, items).mapInPandas(run, schema)


def oversized_items(pieces: DataFrame, id_column: str = "ori_id") -> DataFrame:
    """One row per oversized item, from its first piece; repeated pages count once."""
    return pieces.where("piece_no = 0").select(id_column, "item_no", "cut").distinct()


def once_per_page(df: DataFrame, id_column: str = "ori_id") -> DataFrame:
    """Pages without their repeated rows. The whole pages are shuffled only for ids that occur more than once."""
    twice = df.groupBy(id_column).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(id_column).alias("_k"))
    joined = df.join(twice, df[id_column].eqNullSafe(F.col("_k")), "left_semi").dropDuplicates([id_column])
    return df.join(twice, df[id_column].eqNullSafe(F.col("_k")), "left_anti").unionByName(joined)
