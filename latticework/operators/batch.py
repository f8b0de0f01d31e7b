"""Columnar batch algebra as DataFrame functions.

A batch is a DataFrame with a position column (``pos``, 0..n-1), since rows of a DataFrame have no order of their own.
Functions keep extra columns, accept nulls in them and return empty frames for empty input. Positions are assigned
by ``with_position`` without sending all rows to one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.session import materialize

#: Rows from which positions are counted per range instead of by one sort.
RANGES_FROM = 1_000_000


def with_position(df: DataFrame, *order: str, name: str = "pos", rows_per_range: int = RANGES_FROM) -> DataFrame:
    """Adds the position of each row in the total order of ``order`` (nulls first), from 0.

    Frames of more than ``rows_per_range`` rows are cut into ranges of all the columns together, whatever their types, so that one
    frequent value of the first is no large range; rows are numbered within ranges, and each range starts after the counted
    rows of those before it (a list of at most 10,000 counts). Smaller frames are sorted in one task.
    """
    total = df.count()
    if total <= rows_per_range:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1)
    ranged = df.repartitionByRange(min(10_000, total // rows_per_range + 1), *order).withColumn("_r", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sizes, offset, starts = {r["_r"]: r["n"] for r in ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("n")).collect()}, 0, []
    for k in sorted(sizes):
        starts.append((k, offset))
        offset += sizes[k]
    lookup = df.sparkSession.createDataFrame(starts, "_r int, _start bigint")
    place = F.row_number().over(Window.partitionBy("_r").orderBy(*order)) - 1
    return ranged.withColumn("_p", place).join(F.broadcast(lookup), "_r").withColumn(name, F.col("_start") + F.col("_p")).drop("_r", "_p", "_start")


def select_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """The named columns; unknown names raise."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    return df.select(*keys)


def pop(df: DataFrame, keys: list[str], key: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(popped, rest), both with the position; unknown names raise."""
    return select_columns(df, [key, *[k for k in keys if k != key]]), df.drop(*[k for k in keys if k != key])


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """Rename columns pairwise; lists of different lengths or unknown names raise."""
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    select_columns(df, old)
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def gather(df: DataFrame, indices: list[int], pos: str = "pos") -> DataFrame:
    """Rows at ``indices``, in that order and as often as named; indices out of range raise nothing and are left out."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, p) for p, i in enumerate(indices)], f"`{pos}` bigint, _to bigint")
    return df.join(wanted, pos).drop(pos).withColumnRenamed("_to", pos)


def keep(df: DataFrame, mask: Column) -> DataFrame:
    """Rows where ``mask`` is true; null counts as false."""
    return df.where(mask)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, pos: str = "pos") -> DataFrame:
    """Python's ``[start:stop:step]`` with a positive step; negative bounds count from the end."""
    if step < 1:
        raise ValueError("step must be positive")
    n = df.count() if any(x is not None and x < 0 for x in (start, stop)) else 0
    start = 0 if start is None else max(0, start + n) if start < 0 else start
    cond = (F.col(pos) >= start) & ((F.col(pos) - start) % step == 0)
    if stop is not None:
        cond = cond & (F.col(pos) < (stop + n if stop < 0 else stop))
    return df.where(cond).withColumn(pos, ((F.col(pos) - start) / step).cast("bigint"))


def concat(*frames: DataFrame, pos: str = "pos") -> DataFrame:
    """Row union in the order given; a column that a frame lacks is null there."""
    out, offset = [], 0
    for df in frames:
        out.append(df.withColumn(pos, F.col(pos) + offset))
        offset += df.count()
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def union_columns(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Positional union of columns. A column of both sides must agree (null equals null, NaN equals NaN), else it
    raises when run; row counts may not differ."""
    both = [c for c in right.columns if c in left.columns and c != pos]
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in both}).withColumn("_in_r", F.lit(True))
    out = left.withColumn("_in_l", F.lit(True)).join(r, pos, "full")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in both], F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull())
    checked = out.withColumn("_ok", F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("columns disagree at row "), F.col(pos).cast("string"))).cast("boolean")))
    return checked.where("_ok").drop("_ok", "_in_l", "_in_r", *[f"_r_{c}" for c in both])


def conflicts(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """(column, rows): how many rows of a shared column disagree."""
    both = [c for c in right.columns if c in left.columns and c != pos]
    r = right.select(pos, *[F.col(c).alias(f"_r_{c}") for c in both])
    counts = left.join(r, pos).agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"_r_{c}"))).alias(c) for c in both])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows")) for c in both])).alias("x")).select("x.*")


def merge_meta(a: dict, b: dict) -> dict:
    """Union of two settings; a key of both must have equal values."""
    for k in a.keys() & b.keys():
        if a[k] != b[k] and not (a[k] != a[k] and b[k] != b[k]):
            raise ValueError(f"settings disagree on {k}")
    return a | b


def align(prompts: DataFrame, generated: DataFrame, uid: str = "uid") -> DataFrame:
    """Prompt rows repeated for each generated row of the same uid; a generated row without a prompt raises when run.

    Columns of both sides other than the uid come out as the structs ``prompt`` and ``generated``.
    """
    p = prompts.select(F.col(uid).alias("_u"), F.struct("*").alias("prompt"))
    g = generated.select(F.col(uid).alias(uid), F.struct("*").alias("generated"))
    out = g.join(p, F.col(uid) == F.col("_u"), "left")
    bad = F.raise_error(F.concat(F.lit("no prompt for "), F.coalesce(F.col(uid).cast("string"), F.lit("null"))))
    return out.withColumn("_ok", F.when(F.col("_u").isNotNull(), True).otherwise(bad.cast("boolean"))).where("_ok").select(uid, "prompt", "generated")


def reorder_to(rows: DataFrame, target: DataFrame, uid: str, row_order: str, target_order: str) -> DataFrame:
    """Rows matched one to one with ``target`` by uid and rank within the uid; unequal multisets raise when run."""
    rank = lambda df, o: df.withColumn("_k", F.row_number().over(Window.partitionBy(uid).orderBy(o)))
    a = rank(rows, row_order).withColumn("_a", F.lit(1))
    b = rank(target.select(uid, F.col(target_order).alias("_to")), "_to").withColumn("_b", F.lit(1))
    out = a.join(b, [uid, "_k"], "full")
    bad = F.raise_error(F.lit("the rows of a uid differ in number")).cast("boolean")
    return out.withColumn("_ok", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), True).otherwise(bad)).where("_ok").drop("_ok", "_a", "_b", "_k").withColumnRenamed("_to", "new_pos")


def repeat(df: DataFrame, times: int, interleave: bool = True, pos: str = "pos") -> DataFrame:
    """Each row ``times`` times: a,a,b,b with ``interleave``, else a,b,a,b. 0 gives no rows."""
    if times <= 0:
        return df.limit(0)
    n = 0 if interleave else df.count()
    out = df.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    new = F.col(pos) * times + F.col("_rep") if interleave else F.col("_rep") * n + F.col(pos)
    return out.withColumn(pos, new.cast("bigint")).drop("_rep")


def repeat_each(df: DataFrame, times: str, pos: str = "pos") -> DataFrame:
    """Each row as often as its own ``times`` says; 0 or null drops it. Adds ``rep``; ``pos`` stays the source's."""
    return df.where(F.col(times) > 0).withColumn("rep", F.explode(F.sequence(F.lit(0), F.col(times).cast("int") - 1)))


def unfold_chunks(df: DataFrame, columns: list[str], n: int, pos: str = "pos") -> DataFrame:
    """Arrays of ``columns`` cut into ``n`` equal parts, a row for each part; other columns repeat.

    A length that ``n`` does not divide raises when run.
    """
    def parts(c: str) -> Column:
        w = (F.size(c) / n).cast("int")
        bad = F.raise_error(F.lit(f"{c} cannot be cut into {n} parts"))
        cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(F.col(c), (i * w + 1).cast("int"), w))
        return F.when(F.size(c) % n == 0, cut).otherwise(F.from_json(bad.cast("string"), df.select(cut.alias("x")).schema[0].dataType))

    zipped = F.arrays_zip(*[parts(c).alias(c) for c in columns])
    rest = [c for c in df.columns if c not in columns]
    out = df.select(*rest, F.posexplode(zipped).alias("_i", "_x")).select(*rest, "_i", *[F.col("_x")[c].alias(c) for c in columns])
    return out.withColumn(pos, F.col(pos) * n + F.col("_i")).drop("_i").select(*df.columns)


def fold(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """(pos, rows): ``size`` consecutive rows as one array of structs; a last part may be shorter."""
    part = F.floor(F.col(pos) / size)
    return df.groupBy(part.alias("_p")).agg(F.array_sort(F.collect_list(F.struct(pos, *[c for c in df.columns if c != pos]))).alias("rows")).withColumnRenamed("_p", pos)


def unfold(df: DataFrame, pos: str = "pos") -> DataFrame:
    """The rows of folded batches, numbered by the folded order; all parts but the last must have equal size."""
    size = df.agg(F.max(F.size("rows")).alias("n")).first().n or 1
    out = df.select(F.col(pos).alias("_p"), F.posexplode("rows").alias("_i", "_x"))
    fields = [f for f in df.schema["rows"].dataType.elementType.fieldNames() if f != pos]
    return out.select((F.col("_p") * size + F.col("_i")).alias(pos), *[F.col("_x")[f].alias(f) for f in fields])


def chunk(df: DataFrame, n: int, pos: str = "pos", padded: bool = False) -> DataFrame:
    """Adds ``chunk`` (0..n-1) of equal sizes; a row count that ``n`` does not divide raises unless ``padded``
    (then parts hold ceil(rows / n) rows)."""
    total = df.count()
    if total % n and not padded:
        raise ValueError(f"{total} rows cannot be cut into {n} equal parts")
    return df.withColumn("chunk", F.floor(F.col(pos) / max(1, -(-total // n))).cast("int"))


def split(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """Adds ``part``: consecutive parts of ``size`` rows."""
    return df.withColumn("part", F.floor(F.col(pos) / size).cast("int"))


def pad_to_divisor(df: DataFrame, divisor: int, pos: str = "pos") -> DataFrame:
    """Rows from the head repeated cyclically until ``divisor`` divides their number, with ``is_pad``."""
    n = df.count()
    pad = (-n) % divisor
    base = df.withColumn("is_pad", F.lit(False))
    if not n or not pad:
        return base
    extra = df.where(F.col(pos) < pad).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(-(-pad // n) - 1))))
    extra = extra.withColumn(pos, F.col(pos) + F.col("_c") * n).where(F.col(pos) < pad).withColumn(pos, F.col(pos) + n).drop("_c")
    return base.unionByName(extra.withColumn("is_pad", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    """Undo ``pad_to_divisor``."""
    return df.where("not is_pad").drop("is_pad")


def padding(df: DataFrame, size: int, first: bool = True, pos: str = "pos") -> DataFrame:
    """``size`` copies of the first (or last) row appended."""
    n = df.count()
    if not n or size <= 0:
        return df
    row = df.where(F.col(pos) == (0 if first else n - 1)).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return df.unionByName(row.withColumn(pos, F.col("_c") + n).drop("_c"))


def mini_batches(df: DataFrame, size: int, epochs: int = 1, seed: int | None = None, pos: str = "pos") -> DataFrame:
    """Adds ``epoch`` and ``batch``: each epoch holds every row once, in a seeded order (or as it stands)."""
    n = df.count()
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    key = F.col(pos) if seed is None else F.xxhash64(F.col(pos), F.col("epoch"), F.lit(seed))
    out = with_position(out.withColumn("_k", key), "epoch", "_k", pos, name="_n").drop("_k")
    return out.withColumn("batch", F.floor((F.col("_n") - F.col("epoch") * n) / size).cast("int")).drop("_n")


def collate(df: DataFrame, batch: str, pos: str = "pos") -> DataFrame:
    """One row per batch with a list of each other column, in position order. Batches are bounded by their size."""
    rest = [c for c in df.columns if c not in (batch, pos)]
    packed = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(pos, *rest))).alias("_x"))
    return packed.select(batch, *[F.col("_x")[c].alias(c) for c in rest])


def reorder(df: DataFrame, indices: list[int], pos: str = "pos") -> DataFrame:
    """Row ``i`` of the result is row ``indices[i]``; the list must be a permutation."""
    if sorted(indices) != list(range(len(indices))) or df.count() != len(indices):
        raise ValueError("indices are not a permutation of the rows")
    return gather(df, indices, pos)


def restore(df: DataFrame, source: str, pos: str = "pos") -> DataFrame:
    """Undo a reordering: ``source`` holds each row's position before it."""
    return df.withColumn(pos, F.col(source).cast("bigint")).drop(source)


def pad_array(a: Column, length: int, value: Column, left: bool = False) -> Column:
    """An array filled up to ``length``; longer ones stay."""
    fill = F.array_repeat(value, F.greatest(F.lit(0), F.lit(length) - F.size(a)).cast("int"))
    return F.concat(fill, a) if left else F.concat(a, fill)


def truncate_array(a: Column, length: int, how: str = "right") -> Column:
    """At most ``length`` items, dropping from the right, the left, the middle, or raising (``error``)."""
    n = F.size(a)
    if how == "right":
        short = F.slice(a, 1, length)
    elif how == "left":
        short = F.slice(a, n - length + 1, F.lit(length))
    elif how == "middle":
        short = F.concat(F.slice(a, 1, length // 2), F.slice(a, n - (length - length // 2) + 1, F.lit(length - length // 2)))
    elif how == "error":
        return F.when(n <= length, a).otherwise(F.slice(a, 1, F.raise_error(F.lit(f"longer than {length}")).cast("int")))
    else:
        raise ValueError(f"unknown way {how}")
    return F.when(n <= length, a).otherwise(short)


def first_of_duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``; null keys are one key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_rn = 1").drop("_rn")


def sample_lists(df: DataFrame, key: str, sample: str, text: str) -> DataFrame:
    """(key, texts): the generated texts of each row in sample order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(sample, text))).alias("_x")).select(key, F.col("_x")[text].alias("texts"))


def share_of(df: DataFrame, low: float, high: float, *order: str) -> DataFrame:
    """Rows whose rank in ``order`` lies in [low, high) of all, as a split like ``[:75%]``; negative bounds count
    from the end."""
    n = df.count()
    bound = lambda x: round((x + 1 if x < 0 else x) * n)
    return with_position(df, *order, name="_p").where((F.col("_p") >= bound(low)) & (F.col("_p") < bound(high))).drop("_p")
