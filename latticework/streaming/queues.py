"""Bounded queues with version-based freshness: a replay of a log, a stateful stream, and the batches made of them.

One queue is sequential by nature; queues are independent and run in parallel. A queue's state is at most its capacity.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col


class Bounded:
    """First in, first out, dropping the oldest when full."""

    def __init__(self, capacity: int, items: list[int] | None = None):
        self.items: deque[int] = deque(items or [])
        self.capacity = capacity

    def put(self, item: int) -> int | None:
        """Add an item; the item dropped for it, if any."""
        out = self.items.popleft() if len(self.items) >= self.capacity else None
        self.items.append(item)
        return out

    def get(self) -> int | None:
        return self.items.popleft() if self.items else None


def replay(log: DataFrame, queue: str, order: str, capacity: int) -> DataFrame:
    """(queue, order, kind, item): what a log of operations does. ``log`` has an ``op`` (put or get) and an ``item``.

    ``kind`` is put, dropped (the item a put pushed out), got, or empty (a get that found nothing).
    """
    key, at = log.schema[queue].dataType.simpleString(), log.schema[order].dataType.simpleString()

    def run(b: pd.DataFrame) -> pd.DataFrame:
        q, rows = Bounded(capacity), []
        for name, t, op, item in b.sort_values(order)[[queue, order, "op", "item"]].itertuples(index=False):
            if op == "put":
                rows.append((name, t, "put", item))
                if (lost := q.put(item)) is not None:
                    rows.append((name, t, "dropped", lost))
            else:
                found = q.get()
                rows.append((name, t, "empty" if found is None else "got", found))
        return pd.DataFrame(rows, columns=[queue, order, "kind", "item"]).astype({"item": "Int64"})

    return log.select(queue, order, "op", "item").groupBy(queue).applyInPandas(run, f"`{queue}` {key}, `{order}` {at}, kind string, item bigint")


def counters(done: DataFrame, queue: str) -> DataFrame:
    """(queue, produced, consumed, dropped)."""
    of = lambda k: F.count_if(C("kind") == k)
    return done.groupBy(queue).agg(of("put").alias("produced"), of("got").alias("consumed"), of("dropped").alias("dropped"))


def stream(log: DataFrame, queue: str, capacity: int) -> DataFrame:
    """The same over a stream of (queue, item, op), with the queue's items as state: (queue, kind, item) in append mode."""
    key = log.schema[queue].dataType.simpleString()

    def run(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        q, rows = Bounded(capacity, list(state.get[0]) if state.exists else []), []
        for b in batches:
            for op, item in b[["op", "item"]].itertuples(index=False):
                if op == "put":
                    rows.append((name[0], "put", item))
                    if (lost := q.put(item)) is not None:
                        rows.append((name[0], "dropped", lost))
                else:
                    found = q.get()
                    rows.append((name[0], "empty" if found is None else "got", found))
        state.update(([int(x) for x in q.items],))
        yield pd.DataFrame(rows, columns=[queue, "kind", "item"]).astype({"item": "Int64"})

    return log.select(queue, "op", "item").groupBy(queue).applyInPandasWithState(run, f"`{queue}` {key}, kind string, item bigint", "items array<bigint>", "append", "NoTimeout")


def assembled(samples: DataFrame, queue: str, order: str, size: int) -> DataFrame:
    """Adds ``batch``: consecutive samples of a queue in full batches of ``size``; an unfinished last batch is left out."""
    w = Window.partitionBy(queue)
    n = F.row_number().over(w.orderBy(order))
    rows = samples.withColumn("batch", F.floor((n - 1) / size).cast("int")).withColumn("_full", F.floor(F.count(F.lit(1)).over(w) / size))
    return rows.where(C("batch") < C("_full")).drop("_full")


def staleness_budget(required: int, threshold: float, every: int) -> int:
    """Samples a producer may run ahead before it pauses."""
    return int(required * (threshold + 1) * every)


def fresh(samples: DataFrame, version: str, current: int, most: int) -> DataFrame:
    """Samples at most ``most`` versions behind."""
    return samples.where(F.lit(current) - C(version) <= most)


def since_update(samples: DataFrame, queue: str, version: str, order: str) -> DataFrame:
    """Adds ``since``: samples made since the last version update, starting over with each version."""
    return samples.withColumn("since", F.row_number().over(Window.partitionBy(queue, version).orderBy(order)))


def batch_statistics(batches: DataFrame, queue: str, value: str, version: str) -> DataFrame:
    """(queue, batch, n, mean, versions, lag): per assembled batch, over all of its samples."""
    return batches.groupBy(queue, "batch").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.count_distinct(version).alias("versions"), (F.max(version) - F.min(version)).alias("lag"))
