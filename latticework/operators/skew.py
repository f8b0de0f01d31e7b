"""Per-key work without hot tasks: fragment-replicate by estimated load.

A handful of keys may hold most rows. Rows are laid out in ``n_tasks`` cells of near-equal load:

1. loads are counted with map-side combine (one row per key and map task is shuffled);
2. keys above ``1 / (n_tasks * grain)`` of all rows are *heavy*; there can be at most ``n_tasks * grain``
   of them, so that list is bounded whatever the data. All other keys fall into ``buckets`` hash buckets;
3. heavy keys are cut into proportionate shards, and shards and buckets are packed on cells, largest
   first, always on the least loaded cell;
4. rows of the large side go to the cell of their shard, and a row of the matching side is copied only to
   the cells that hold a shard of its key. Both sides go through one exchange on the cell number.

Within a cell the matching row is one more row of its key's group, so join and aggregation need no
further exchange. The partial results of a sharded key (one row per shard) are merged at the end.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.session import parallelism


@dataclass(frozen=True)
class Layout:
    """Where the rows of each key go. ``heavy`` maps a key to the cells of its shards."""

    n_cells: int
    buckets: int
    total: int
    heavy: dict[str, list[int]]
    heavy_rows: dict[str, int]
    bucket_cell: list[int]
    loads: list[float]


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def plan_layout(df: DataFrame, key: str, n_cells: int | None = None, grain: int = 4, buckets: int | None = None) -> Layout:
    """Estimate loads and pack them. Rows with a null key are left out. An empty table gives an empty layout.

    The driver receives at most ``n_cells * grain`` heavy keys and ``buckets`` sums, whatever the table holds.
    """
    n = n_cells or parallelism(df.sparkSession)
    buckets = buckets or n * 16
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    total = keys.count()
    if not total:
        return Layout(n, buckets, 0, {}, {}, [i % n for i in range(buckets)], [0.0] * n)
    limit = max(1, total // (n * grain))
    counts = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = F.col("n") > limit
    rows = (
        counts.groupBy(F.when(hot, F.col("k")).alias("k"), F.when(~hot, _bucket(F.col("k"), buckets)).alias("b"))
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    items: list[tuple[float, object]] = []
    heavy_rows = {r.k: r.n for r in rows if r.k is not None}
    for k, size in heavy_rows.items():
        shards = -(-size // limit)
        items += [(size / shards, (k, i)) for i in range(shards)]
    items += [(r.n, r.b) for r in rows if r.k is None]
    cells = [(0.0, c) for c in range(n)]
    heavy: dict[str, list[int]] = {k: [] for k in heavy_rows}
    bucket_cell, loads = [i % n for i in range(buckets)], [0.0] * n
    for size, what in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        load, cell = heapq.heappop(cells)
        if isinstance(what, tuple):
            heavy[what[0]].append(cell)
        else:
            bucket_cell[what] = cell
        loads[cell] = load + size
        heapq.heappush(cells, (load + size, cell))
    return Layout(n, buckets, total, heavy, heavy_rows, bucket_cell, loads)


def _cell_values(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` shuffle partitions an integer that Spark's hash partitioning sends there."""
    found: dict[int, int] = {}
    start, step = 0, max(1024, n * 8)
    while len(found) < n:
        part = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
        for r in spark.range(start, start + step, 1, 1).groupBy(part.alias("p")).agg(F.min("id").alias("v")).collect():
            found.setdefault(r.p, r.v)
        start += step
    return [found[i] for i in range(n)]


def _heavy_table(spark: SparkSession, layout: Layout, values: list[int]) -> DataFrame:
    schema = T.StructType([T.StructField("_hk", T.StringType()), T.StructField("_cells", T.ArrayType(T.IntegerType()))])
    return spark.createDataFrame([(k, [values[c] for c in cells]) for k, cells in layout.heavy.items()], schema)


def lay_out(large: DataFrame, key: str, matching: DataFrame | None, matching_key: str | None, layout: Layout) -> DataFrame:
    """Rows of both sides with ``_cell`` and ``_side`` (0 large, 1 matching), spread over the layout's cells.

    ``large`` and ``matching`` become the struct columns ``_l`` and ``_m``, so equal column names cannot
    clash. Rows with a null key are dropped from both sides. The shard of a row is its position among the
    rows of its scan partition, which a re-run of a lost task repeats.
    """
    spark = large.sparkSession
    values = _cell_values(spark, layout.n_cells)
    cell_of_bucket = F.array(*[F.lit(values[c]) for c in layout.bucket_cell])
    heavy = F.broadcast(_heavy_table(spark, layout, values))  # at most n_cells * grain rows

    def placed(df: DataFrame, k: str, field: str) -> DataFrame:
        rows = df.where(F.col(k).isNotNull()).select(F.col(k).cast("string").alias("_k"), F.struct("*").alias(field))
        return rows.join(heavy, F.col("_k") == F.col("_hk"), "left").drop("_hk")

    light = F.element_at(cell_of_bucket, _bucket(F.col("_k"), layout.buckets) + 1)
    shard = F.pmod(F.monotonically_increasing_id(), F.size("_cells")).cast("int")
    out = placed(large, key, "_l").withColumn(
        "_cell", F.when(F.col("_cells").isNull(), light).otherwise(F.element_at("_cells", shard + 1))
    ).select("_cell", F.lit(0).alias("_side"), "_k", "_l")
    if matching is not None:
        copies = placed(matching, matching_key, "_m").withColumn(
            "_cell", F.explode(F.when(F.col("_cells").isNull(), F.array(light)).otherwise(F.array_distinct("_cells")))
        ).select("_cell", F.lit(1).alias("_side"), "_k", "_m")
        out = out.unionByName(copies, allowMissingColumns=True)
    return out.repartition(layout.n_cells, "_cell")


def balanced_join(large: DataFrame, key: str, matching: DataFrame, matching_key: str, layout: Layout | None = None) -> DataFrame:
    """Left join of ``large`` with the unique rows of ``matching``, laid out as above.

    Output: ``_k``, ``_l`` (struct of the large row), ``_m`` (struct of its matching row, null if none).
    ``matching`` must hold one row per key; of several, the smallest struct is taken.
    """
    from pyspark.sql import Window

    layout = layout or plan_layout(large, key)
    rows = lay_out(large, key, matching, matching_key, layout)
    group = Window.partitionBy("_cell", "_k").orderBy(F.col("_side").desc(), F.col("_m").asc_nulls_last())
    first = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_m", F.first("_m").over(first)).where("_side = 0").select("_k", "_l", "_m")


def balanced_profile(relation: DataFrame, nodes: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Work ``relation`` up per ``source_id`` against ``nodes`` (``id``, ``name``, ``level``).

    One row per non-null ``source_id``: rows, share of all rows of ``relation`` (null keys count in the
    denominator), smallest and largest target, layers, described rows, the node's name and level, shards.
    Repeated rows count as they stand; a key without a node keeps its row with a null name; an empty
    relation gives no row.
    """
    layout = layout or plan_layout(relation, "source_id")
    all_rows = relation.count()
    slim = relation.select("source_id", "target_id", "layer", "created_at", F.col("attributes.description").isNotNull().alias("described"))
    rows = lay_out(slim, "source_id", nodes.select("id", "name", "level"), "id", layout)
    is_row = F.col("_side") == 0
    partial = rows.groupBy("_cell", "_k").agg(
        F.sum(F.when(is_row, 1).otherwise(0)).alias("n"),
        F.min("_l.target_id").alias("first_target"),
        F.max("_l.target_id").alias("last_target"),
        F.max("_l.layer").alias("max_layer"),
        F.sum(F.when(F.col("_l.described"), 1).otherwise(0)).alias("described"),
        F.max("_l.created_at").alias("latest"),
        F.min("_m.name").alias("name"),
        F.min("_m.level").alias("level"),
    ).where("n > 0")
    return partial.groupBy(F.col("_k").alias("source_id")).agg(
        F.sum("n").alias("n_rows"),
        (F.sum("n") / F.lit(max(1, all_rows))).alias("share"),
        F.min("first_target").alias("first_target"),
        F.max("last_target").alias("last_target"),
        F.max("max_layer").alias("max_layer"),
        F.sum("described").alias("described"),
        F.max("latest").alias("latest"),
        F.min("name").alias("name"),
        F.min("level").alias("level"),
        F.count(F.lit(1)).alias("shards"),
    )


def overloaded_keys(profile: DataFrame, least_share: float = 0.03) -> DataFrame:
    """Keys that hold at least ``least_share`` of all rows."""
    return profile.where(F.col("share") >= least_share).select("source_id")
