"""Most similar vectors for every vector: vantage-point trees per shard with relaxed triangle-inequality pruning.

Distances are angles, which obey the triangle inequality. The first levels of a tree, fitted on a bounded sample,
cut the space into shards; every vector is stored in one shard of each tree. Each shard grows its own
vantage-point tree over all of its vectors. A query with radius ``r`` leaves out the side of a node whose
border is at least ``relax * r`` away: with ``relax = 1`` nothing within the radius can be missed, smaller factors
visit far fewer nodes and miss few, since two vectors of a high dimension that are close to each other are nearly
equally far from a vantage point. Several trees with other vantage points find what one misses.
Every candidate's similarity is computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.session import materialize

DIM = 64

#: Rows of the sample on which the shards' borders are fitted: at least, for each shard, and at most (256 bytes each on the driver).
SAMPLE, SAMPLE_EACH, SAMPLE_MOST = 20_000, 16, 200_000

#: Vectors of one shard that the number of shards aims at; a shard is held in one task's memory. What no border can separate, and
#: what the largest sample can fit no borders for, is split by id instead, and asked part by part.
SHARD_ROWS = 24_000

LEAF = 192

#: More than single-precision similarities of unit rows, and rounding to 7 digits, are off.
SLACK = 1e-5

#: Groups of one direction larger than this don't ask one by one, and of equal vectors only the smallest ids are kept.
COPIES = 64

#: Vectors are of one direction if the components of their unit vectors are equal when rounded to this part: their similarity is
#: then 1 to 7 digits (64 components off by less than 1 / 30,000).
FINE = 3e4


def usable(vector: Column, dim: int = DIM) -> Column:
    """Whether a vector has ``dim`` finite values and is not all zero; false for null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(column: pd.Series, dim: int = DIM) -> np.ndarray:
    """Vectors as unit rows; computed in double precision, since any length may occur."""
    if not len(column):
        return np.zeros((0, dim), dtype=np.float32)
    return exact_units(np.stack(column.to_numpy())).astype(np.float32)


def exact_units(x: np.ndarray) -> np.ndarray:
    """Unit rows in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # lengths near the end of the range must not overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_ODD = np.random.default_rng(17).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


def direction(vector: Column) -> Column:
    """A 64-bit key of a usable vector's direction, the same for scaled copies but for a rounding at the border of a cell."""

    def key(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype="int64")
        cell = np.rint(exact_units(np.stack(column.to_numpy())) * FINE).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            return pd.Series((cell * np.resize(_ODD, cell.shape[1])).sum(axis=1, dtype=np.uint64).view(np.int64))

    return F.pandas_udf(key, "bigint")(vector)


def _angles(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ v, -1.0, 1.0))


@dataclass
class Node:
    """A vantage point with its median angle, or a leaf with a number (shards) or rows (within a shard)."""

    vantage: np.ndarray | None = None
    border: float = 0.0
    near: Node | None = None
    far: Node | None = None
    leaf: object = None


def _spread_vantage(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of a few rows the one whose angles to a few others spread the most."""
    some = x[rng.integers(0, len(x), min(len(x), 64))]
    tries = x[rng.integers(0, len(x), 8)]
    return tries[int(np.argmax(np.arccos(np.clip(tries @ some.T, -1, 1)).std(axis=1)))]


def grow_shards(sample: np.ndarray, depth: int, seed: int) -> Node:
    """The top of a tree, with 2 ** depth numbered shards."""
    rng, counter = np.random.default_rng(seed), iter(range(1 << depth))

    def grow(x: np.ndarray, left: int) -> Node:
        if not left:
            return Node(leaf=next(counter))
        if not len(x):
            x = rng.normal(size=(1, sample.shape[1])).astype(np.float32)
        v = _spread_vantage(x, rng)
        a = _angles(x, v)
        border = float(np.median(a))
        return Node(v, border, grow(x[a < border], left - 1), grow(x[a >= border], left - 1))

    return grow(sample, depth)


def grow_tree(x: np.ndarray, leaf: int, seed: int) -> Node:
    """A tree over all rows of ``x``; leaves hold row numbers. Equal rows that no border separates share a leaf."""
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray) -> Node:
        if len(rows) <= leaf:
            return Node(leaf=rows)
        part = x[rows]
        v = _spread_vantage(part, rng)
        a = _angles(part, v)
        border = float(np.median(a))
        near = a < border
        if near.all() or not near.any():
            return Node(leaf=rows)
        return Node(v, border, grow(rows[near]), grow(rows[~near]))

    return grow(np.arange(len(x)))


def reach(node: Node, q: np.ndarray, radius: np.ndarray, relax: float) -> Iterator[tuple[object, np.ndarray]]:
    """(leaf, query rows) for every leaf that the relaxed triangle inequality does not rule out."""
    todo = [(node, np.arange(len(q)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if at.vantage is None:
            yield at.leaf, rows
            continue
        gap = _angles(q[rows], at.vantage) - at.border
        slack = relax * radius[rows]
        todo.append((at.near, rows[gap < slack]))
        todo.append((at.far, rows[gap > -slack]))
        # a query on the border itself, with no slack, belongs to the far side like the rows stored there
        if (edge := (gap == 0) & (slack == 0)).any():
            todo.append((at.far, rows[edge]))


def home(node: Node, q: np.ndarray) -> Iterator[tuple[object, np.ndarray]]:
    """(leaf, query rows) of the one leaf that each query falls into."""
    todo = [(node, np.arange(len(q)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if at.vantage is None:
            yield at.leaf, rows
            continue
        near = _angles(q[rows], at.vantage) < at.border
        todo += [(at.near, rows[near]), (at.far, rows[~near])]


class _Best:
    """The ``k`` best rows found so far for each query: highest rounded similarity, then smallest id.

    Single precision only leaves out rows that cannot be among them; the rest are compared in double precision, so memory
    is bounded by the number of queries however many rows tie.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, floor: float):
        self.ids, self.x, self.qids, self.q, self.k, self.floor = ids, x, qids, q, k, floor
        self.x32, self.q32 = x.astype(np.float32), q.astype(np.float32)
        self.s = np.full((len(q), k), -2.0)
        self.sims = np.full((len(q), k), -2.0)
        self.others = np.full((len(q), k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, at: np.ndarray) -> None:
        for start in range(0, len(at), 1024):
            for first in range(0, len(rows), 2048):
                self._offer(rows[first : first + 2048], at[start : start + 1024])

    def _offer(self, rows: np.ndarray, at: np.ndarray) -> None:
        sims = self.q32[at] @ self.x32[rows].T
        least = np.maximum(self.kth()[at], self.floor)
        if len(rows) > self.k + 1:  # the query itself may be one of them
            least = np.maximum(least, np.partition(sims, len(rows) - self.k - 1, axis=1)[:, len(rows) - self.k - 1])
        i, j = np.nonzero(sims >= (least - SLACK)[:, None])
        i, j = at[i], rows[j]
        different = self.qids[i] != self.ids[j]
        i, j = i[different], j[different]
        if not len(i):
            return
        sim = np.concatenate([np.einsum("ij,ij->i", self.q[i[p : p + 50_000]], self.x[j[p : p + 50_000]]) for p in range(0, len(i), 50_000)])
        s = np.round(sim, 7)
        enough = s >= self.floor
        i, j, sim, s = i[enough], j[enough], sim[enough], s[enough]
        some = np.unique(i)
        who = np.concatenate([np.repeat(some, self.k), i])
        s = np.concatenate([self.s[some].ravel(), s])
        sim = np.concatenate([self.sims[some].ravel(), sim])
        other = np.concatenate([self.others[some].ravel(), self.ids[j]])
        order = np.lexsort((other, -s, who))
        first = np.searchsorted(who[order], some)
        best = order[first[:, None] + np.arange(self.k)]
        self.s[some], self.sims[some], self.others[some] = s[best], sim[best], other[best]

    def kth(self) -> np.ndarray:
        return self.s[:, -1]


def search_shard(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, floor: float, relax: float, seed: int) -> pd.DataFrame:
    """(query, other, sim, s) with the ``k`` best rows of ``x`` for each query, of at least ``floor``, itself left out.

    ``x`` and ``q`` are unit rows in double precision, ``s`` is ``sim`` rounded to 7 digits; ties go to the smaller ``other``.
    """
    if not len(ids) or not len(qids):
        return pd.DataFrame({"query": np.zeros(0, "int64"), "other": np.zeros(0, "int64"), "sim": np.zeros(0, "float64"), "s": np.zeros(0, "float64")})
    best, at_home = _Best(ids, x, qids, q, k, floor if floor > -1.0 else -1.5), np.zeros(len(q), dtype=np.int64)
    tree, q32 = grow_tree(best.x32, LEAF, seed), best.q32
    for rows, at in home(tree, q32):
        best.offer(rows, at)
        at_home[at] = id(rows)
    radius = np.arccos(np.clip(np.maximum(best.kth(), best.floor) - 1e-5, -1.0, 1.0))  # the k-th best so far bounds the search
    for rows, at in reach(tree, q32, radius, relax):
        best.offer(rows, at[at_home[at] != id(rows)])
    a, column = np.nonzero(best.s > -2.0)
    return pd.DataFrame({"query": qids[a], "other": best.others[a, column], "sim": best.sims[a, column], "s": best.s[a, column]})


def nearest(
    vectors: DataFrame, k: int = 5, floor: float = -1.0, relax: float = 1.0, shard_relax: float | None = None, trees: int = 1,
    queries: Column | None = None, dim: int = DIM, seed: int = 7, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query, other, sim, rank): for each query the ``k`` most similar other vectors, of at least ``floor``.

    ``vectors`` has ``record_id`` and ``vector``; unusable vectors take no part, nor do rows without an id; repeated ids are taken
    once, ties (of similarities rounded to 7 digits) go to the smaller ``other``. ``queries`` selects the rows that are queries
    (all by default); every row is in the index. ``relax`` is the pruning factor within the shards and ``shard_relax`` (the
    same by default) that between shards; with 1.0 the result is exact. An empty table gives no rows.

    Of very many vectors of one direction the ``k + 1`` smallest ids ask and the others have the answer of the smallest, whose neighbours
    are theirs: all of the direction are equally near. (A vector of another direction within 0.0003 of theirs counts as near as it is to
    the smallest.) They stay in the index, but of equal vectors only the ``k + 1`` smallest ids do.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col("vector"), dim) & F.col("record_id").isNotNull()).select("record_id", "vector")
    rows = rows.withColumn("asks", F.lit(True) if queries is None else F.coalesce(queries, F.lit(False)))
    keyed = rows.withColumn("same", F.xxhash64("vector")).withColumn("aim", direction(F.col("vector")))
    equal = keyed.groupBy("aim", "same").agg(F.count(F.lit(1)).alias("n"))
    sizes = equal.groupBy("aim").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    n, spare, asked = total.n or 0, None, None
    if n and total.most > COPIES:
        crowd = keyed.join(sizes.where(F.col("n") > COPIES).select("aim"), "aim", "left_semi").select("aim", "same", "record_id", "asks").distinct()
        crowd = materialize(crowd, "crowd")
        smallest = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("record_id"))
        firsts = materialize(crowd.select("aim", "record_id").distinct().withColumn("r", smallest("aim")).where(F.col("r") <= k + 1), "firsts")
        kept = crowd.select("same", "record_id").distinct().withColumn("r", smallest("same")).where(F.col("r") <= k + 1)
        left_out = materialize(crowd.select("record_id").distinct().join(kept, "record_id", "left_anti"), "copies")
        leads = firsts.where("r = 1").select("aim", F.col("record_id").alias("lead"))
        spare = crowd.where("asks").join(firsts, "record_id", "left_anti").join(leads, "aim").select(F.col("record_id").alias("query"), "lead").distinct()
        spare = materialize(spare, "spare")
        asked = rows.where("asks").select(F.col("record_id").alias("query")).distinct()
        changed = spare.select(F.col("query").alias("record_id"), F.lit(False).alias("now")).unionByName(leads.select(F.col("lead").alias("record_id"), F.lit(True).alias("now")))
        rows = rows.join(left_out, "record_id", "left_anti").join(changed, "record_id", "left").select("record_id", "vector", F.coalesce("now", "asks").alias("asks"))
        n = rows.count()
    depth = max(2, int(np.ceil(np.log2(max(1, n) / shard_rows)))) if n else 0
    wanted = min(SAMPLE_MOST, max(SAMPLE, SAMPLE_EACH << depth))
    fraction = min(1.0, wanted / max(1, n))
    sample = rows.select("vector") if fraction >= 1.0 else rows.sample(fraction * 0.9, seed).select("vector")
    sample = unit_rows(sample.limit(wanted).toPandas()["vector"], dim) if n else np.zeros((0, dim), np.float32)
    depth = min(depth, max(2, int(np.log2(max(4, len(sample) * 2 // SAMPLE_EACH)))))
    trees_at_top = [grow_shards(sample, depth, seed + t) if n else Node(leaf=0) for t in range(trees)]
    parts = np.ones((trees, 1 << depth), dtype=np.int64)  # of each shard, by its share of the sample
    for t, top in enumerate(trees_at_top):
        for leaf, at in home(top, sample):
            load = len(at) / max(1, len(sample)) * n
            if load > 2 * shard_rows:
                parts[t, leaf] = -(-int(load) // shard_rows)
    first_cell = np.concatenate([[0], np.cumsum(parts.ravel())])[:-1].reshape(parts.shape)
    tops = spark.sparkContext.broadcast((trees_at_top, parts, first_cell))
    between = relax if shard_relax is None else shard_relax
    radius = float(np.arccos(max(floor, -1.0)))
    kind = "float32" if rows.schema["vector"].dataType.elementType.typeName() == "float" else "float64"  # as given, so that nothing is lost

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown, parts, first_cell = tops.value
        for b in batches:
            x = unit_rows(b["vector"], dim)
            asks, ids = b["asks"].to_numpy(dtype=bool), b["record_id"].to_numpy()
            packed = [np.asarray(v, dtype=kind).tobytes() for v in b["vector"]]
            part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for t, top in enumerate(grown):
                stored = np.zeros(len(x), dtype=np.int64)
                for leaf, at in home(top, x):
                    stored[at] = leaf
                own = first_cell[t, stored] + part % parts[t, stored]
                cells, at, role = [own], [np.arange(len(x))], [np.where(asks, 3, 1)]
                who = np.flatnonzero(asks)
                visits = list(reach(top, x[who], np.full(len(who), radius), between))
                if (parts[t] > 1).any():  # the other parts of its own shard, whatever the pruning says of the shard
                    visits += [(leaf, np.flatnonzero(stored[who] == leaf)) for leaf in np.flatnonzero(parts[t] > 1)]
                for leaf, some in visits:
                    for p in range(parts[t, leaf]):
                        cell, asking = first_cell[t, leaf] + p, who[some]
                        asking = asking[own[asking] != cell]
                        cells.append(np.full(len(asking), cell))
                        at.append(asking)
                        role.append(np.full(len(asking), 2))
                cells, at, role = np.concatenate(cells), np.concatenate(at), np.concatenate(role)
                yield pd.DataFrame({"cell": cells, "role": role.astype("int8"), "record_id": ids[at], "v": [packed[i] for i in at]})

    def search(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = exact_units(np.frombuffer(b"".join(part["v"]), dtype=kind).reshape(len(part), -1)) if len(part) else np.zeros((0, dim))
        role, ids = part["role"].to_numpy(), part["record_id"].to_numpy()
        stored = np.flatnonzero(role & 1)
        stored = stored[np.unique(ids[stored], return_index=True)[1]]
        asking = np.flatnonzero(role & 2)
        asking = asking[np.unique(ids[asking], return_index=True)[1]]
        return search_shard(ids[stored], x[stored], ids[asking], x[asking], k, floor, relax, seed + int(key[0]))

    cells = rows.mapInPandas(route, "cell bigint, role tinyint, record_id bigint, v binary")
    found = cells.groupBy("cell").applyInPandas(search, "query bigint, other bigint, sim double, s double")
    best = Window.partitionBy("query").orderBy(F.col("s").desc(), "other")
    once = found.groupBy("query", "other").agg(F.max("sim").alias("sim"), F.max("s").alias("s"))
    if spare is not None:
        ranked = materialize(once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "ranked")
        one = F.lit(1.0)
        more = spare.join(ranked.withColumnRenamed("query", "lead"), "lead").select("query", "other", "sim", "s")
        more = more.unionByName(spare.select("query", F.col("lead").alias("other"), one.alias("sim"), one.alias("s")))
        once = ranked.join(asked, "query", "left_semi").unionByName(more)
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "other", "sim", "rank")


def close_pairs(vectors: DataFrame, k: int = 5, floor: float = 0.9, relax: float = 0.25, shard_relax: float = 0.16, trees: int = 2) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: pairs of at least ``floor`` of which one is among the ``k`` best of the other."""
    found = materialize(nearest(vectors, k, floor, relax, shard_relax, trees), "neighbors")
    return found.select(F.least("query", "other").alias("rec_a"), F.greatest("query", "other").alias("rec_b")).distinct()
