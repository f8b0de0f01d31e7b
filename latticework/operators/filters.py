"""Row filters. Null conditions never keep a row; tables without rows stay empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.batch import with_position


def within_length(df: DataFrame, text: str, most: int) -> DataFrame:
    """Rows of at most ``most`` white-space tokens; a null text counts as too long."""
    n = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda x: x != ""))
    return df.where(F.when(F.col(text).isNotNull(), n).otherwise(most + 1) <= most)


def pseudo_random(seed: int, *keys: str) -> Column:
    """A hash in [0, 2^32) that other engines can repeat: a linear congruence of a numeric key."""
    return F.pmod(F.col(keys[0]).cast("bigint") * 2654435761 + seed * 40503, F.lit(4294967296))


def some_rows(df: DataFrame, n: int, key: str, seed: int | None = None) -> DataFrame:
    """The first ``n`` rows by ``key``, or ``n`` pseudo-random ones without replacement."""
    return df.orderBy(key).limit(n) if seed is None else df.orderBy(pseudo_random(seed, key), key).limit(n)


def labelled(df: DataFrame, label: str) -> DataFrame:
    """Rows with a non-empty label."""
    return df.where(F.length(label) > 0)


def between_dates(df: DataFrame, ts: str, start: str, stop: str) -> DataFrame:
    """Rows of the half-open range; literals keep the scan's own type, so the filter is pushed down."""
    kind = dict(df.dtypes)[ts]
    return df.where((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(stop).cast(kind)))


def known(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``done``."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def from_charts(source: Column) -> Column:
    """Whether a chunk id names a chart."""
    return F.coalesce(source.contains("chart"), F.lit(False))


def stripped(text: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def named(df: DataFrame, name: str = "name") -> DataFrame:
    """Rows with a name that is not blank."""
    return df.where(stripped(F.col(name)) != "")


def no_loops(df: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    return df.where(F.col(source) != F.col(target))


def by_accuracy_and_length(df: DataFrame, group: str, score: str, length: str, low: float, high: float, most: int, oversample: int) -> DataFrame:
    """Passing groups first (mean score within [low, high], no row at the length limit), then a share of all rows.

    Keeps ``rows // oversample`` rows, by (passing, group, row order within the group). The share is cut by position, not by one
    sort of all rows in a task.
    """
    w = Window.partitionBy(group)
    mean, longest = F.avg(score).over(w), F.max(length).over(w)
    rows = df.withColumn("passes", (mean >= low) & (mean <= high) & (longest < most))
    rows = with_position(rows.withColumn("_f", ~F.col("passes")), "_f", group, *[c for c in df.columns if c != group], name="_p")
    return rows.where(F.col("_p") < df.count() // oversample).drop("_f", "_p")


def varied_groups(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Rows of groups whose metric varies (population deviation above 0), and of groups of one."""
    w = Window.partitionBy(group)
    return df.withColumn("_v", (F.stddev_pop(metric).over(w) > 0) | (F.count(F.lit(1)).over(w) == 1)).where("_v").drop("_v")


def fill_up(batches: list[DataFrame], group: str, needed: int, order: str) -> DataFrame:
    """Rows of the first ``needed`` groups over several filtered batches; stops taking batches once there are enough."""
    taken: DataFrame | None = None
    for b in batches:
        taken = b if taken is None else taken.unionByName(b)
        if taken.select(group).distinct().count() >= needed:
            break
    if taken is None:
        raise ValueError("no batches")
    keep = taken.groupBy(group).agg(F.min(order).alias("_o")).orderBy("_o", group).limit(needed).select(group)
    return taken.join(keep, group, "left_semi")


def unmasked(ids: Column, mask: Column) -> Column:
    """The items of an array where the mask is 1."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("i"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["i"])


def of_sources(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(file, id): the entities whose source holds a file, each once per file. ``files`` has the column ``file``."""
    held = entities.select("id", F.explode(F.array_distinct("source")).alias("file"))
    return files.select("file").distinct().join(held, "file").distinct()
