"""Items of varying length packed into containers of fixed capacity.

Bounded-space online packing: every partition keeps a fixed number of open containers, puts each
item into the one where it fits best, and emits the fullest when none fits. The items of containers
that stay open at the end are merged over groups of partitions, level by level, and packed again.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.session import checkpoint, small

OPEN = 64
#: Partitions whose leftovers one task of the next level merges.
FAN_IN = 64


class Packer:
    """The open containers of one capacity in one partition."""

    def __init__(self, capacity: int, prefix: str, most_open: int = OPEN):
        self.capacity, self.prefix, self.most = capacity, prefix, most_open
        self.free: list[tuple[int, int]] = []  # (room left, container), sorted
        self.items: dict[int, list] = {}
        self.next = 0

    def _new(self) -> int:
        self.next += 1
        self.items[self.next] = []
        return self.next

    def put(self, item, size: int) -> list[tuple[str, list]]:
        """Place an item that fits a container; returns the containers emitted for it."""
        out = []
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, box = self.free.pop(at)  # the least room that suffices
        else:
            if len(self.free) >= self.most:
                _, full = self.free.pop(0)
                out.append((f"{self.prefix}-{full}", self.items.pop(full)))
            room, box = self.capacity, self._new()
        self.items[box].append(item)
        if room == size:
            out.append((f"{self.prefix}-{box}", self.items.pop(box)))
        else:
            insort(self.free, (room - size, box))
        return out

    def close(self) -> list[tuple[str, list]]:
        """The containers still open."""
        out = [(f"{self.prefix}-{box}", self.items[box]) for _, box in self.free]
        self.free, self.items = [], {}
        return out


def _pack_level(df: DataFrame, level: int, last: bool, most_open: int, kind: str) -> DataFrame:
    """Pack (window_id, capacity, _group, key, piece, start, tokens); leftovers get no container unless ``last``."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packers: dict[tuple[str, int], Packer] = {}

        def rows(window: str, group: int, emitted: list[tuple[str, list]], placed: bool = True) -> list[tuple]:
            return [(window, packers[window, group].capacity, group, *item, name if placed else None) for name, items in emitted for item in items]

        columns = ["window_id", "capacity", "_group", "_key", "piece", "start", "tokens", "container"]
        for pdf in batches:
            out: list[tuple] = []
            for window, capacity, group, key, piece, start, tokens in pdf[columns[:-1]].itertuples(index=False):
                if (window, group) not in packers:
                    packers[window, group] = Packer(capacity, f"{level}-{group}", most_open)
                out += rows(window, group, packers[window, group].put((key, piece, start, tokens), tokens))
            yield pd.DataFrame(out, columns=columns)
        out = [r for (window, group), p in packers.items() for r in rows(window, group, p.close(), last)]
        yield pd.DataFrame(out, columns=columns)

    return df.mapInPandas(scan, f"window_id string, capacity long, _group int, _key {kind}, piece int, start long, tokens long, container string")


def pack(items: DataFrame, windows: DataFrame, key: str = "doc_id", tokens: str = "tokens", most_open: int = OPEN, fan_in: int = FAN_IN) -> DataFrame:
    """(window_id, capacity, container, key, piece, start, tokens): which item lies in which container.

    ``windows`` gives (window_id, capacity_tokens), a handful of rows; windows without a positive
    capacity are left out. An item is split only if it exceeds the capacity: into pieces of exactly
    the capacity, each a full container, and a rest that is packed like an item (``piece`` counts
    from 0, ``start`` is the first token). Items without tokens need no room and get no container;
    repeated rows are items of their own.
    """
    sizes = windows.where("window_id is not null and capacity_tokens > 0").dropDuplicates(["window_id"]).select(F.col("window_id").cast("string"), F.col("capacity_tokens").cast("long").alias("capacity"))
    base = items.select(F.col(key).alias("_key"), F.col(tokens).cast("long").alias("_n")).where("_n > 0")
    base = base.withColumn("_group", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    base = checkpoint(base)
    kind = dict(base.dtypes)["_key"]
    groups = base.rdd.getNumPartitions()
    # A row for each piece: the full ones, which need no packing, and the rest.
    pieces = base.crossJoin(small(sizes)).withColumn("whole", F.floor((F.col("_n") - 1) / F.col("capacity")).cast("int"))
    full = pieces.where("whole > 0").select(
        "window_id", "capacity", "_key", "_row", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece")
    )
    full = full.select("window_id", "capacity", F.concat_ws("-", F.lit("x"), F.col("_row").cast("string"), F.col("piece").cast("string")).alias("container"), "_key", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("tokens"))
    rest = pieces.select("window_id", "capacity", "_group", "_key", F.col("whole").alias("piece"), (F.col("whole") * F.col("capacity")).alias("start"), (F.col("_n") - F.col("whole") * F.col("capacity")).alias("tokens"))
    columns = ["window_id", "capacity", "container", "_key", "piece", "start", "tokens"]
    placed, level = [full.select(columns)], 0
    while True:
        last = groups <= 1
        packed = checkpoint(_pack_level(rest, level, last, most_open, kind))
        placed.append(packed.where("container is not null").select(columns))
        if last:
            break
        groups = -(-groups // fan_in)
        level += 1
        left = packed.where("container is null").drop("container").withColumn("_group", F.floor(F.col("_group") / fan_in).cast("int"))
        # Larger items first: what is left is small enough to be sorted.
        rest = left.repartition(max(1, groups), "window_id", "_group").sortWithinPartitions("window_id", "_group", F.col("tokens").desc(), "_key", "piece")
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("_key", key)


def fill(packed: DataFrame) -> DataFrame:
    """(window_id, capacity, containers, tokens, filled): how much of the containers' room is used."""
    per = packed.groupBy("window_id", "capacity", "container").agg(F.sum("tokens").alias("tokens"))
    out = per.groupBy("window_id", "capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return out.withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity")))
