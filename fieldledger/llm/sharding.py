"""Shards of near equal size by minimax contiguous partition.

Documents with equal texts are one group and stay together.  Groups stand in order of their least id; of all ways to
cut that row into contiguous shards, the smallest feasible capacity is found by binary search: a capacity is feasible
if filling shards greedily uses no more of them than there are.  Then the row is cut there: each shard ends at the
group end nearest to its even share of what is left, within the capacity and such that the rest still fits.

Sizes never pass the driver as a whole.  The row of groups is sorted and summed by Spark, and cut into at most
2 x BLOCKS blocks of even size (a group larger than such a block stands in one of its own).  The driver searches over
the blocks' sums; where a block's inner ends matter, which is near the cuts only, it reads that block's ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.base import boxed, cut, join_by_weight, read_table, written

SHARDS = 8
#: The driver holds the sums of at most twice so many blocks.
BLOCKS = 1 << 15
#: So many blocks near the cuts are read at once; others when they are needed.
MOST_LOADED = 4096
LAW = "bytes"


class Ends:
    """Where groups begin in the row of all groups: the blocks' begins, and inner ones that ``fetch`` gets for some blocks."""

    def __init__(self, begins: np.ndarray, single: np.ndarray, total: int, fetch):
        """``begins`` (ascending, the first 0) and ``single``: whether the block is one group."""
        self.edges, self.single, self.total, self.fetch = np.append(begins, total), single, total, fetch
        self.inner: dict[int, np.ndarray] = {}

    def load(self, blocks) -> None:
        """Gets the inner begins of several blocks at once."""
        new = sorted({int(b) for b in blocks if 0 <= b < len(self.single) and not self.single[b] and b not in self.inner})
        if new:
            found = self.fetch([(int(self.edges[b]), int(self.edges[b + 1])) for b in new])
            for b in new:
                self.inner[b] = found[np.searchsorted(found, self.edges[b]) : np.searchsorted(found, self.edges[b + 1])]

    def block(self, x: int) -> int:
        return int(np.searchsorted(self.edges, x, "right")) - 1

    def below(self, x: int) -> int:
        """The last group begin, or the end of all, at or before ``x``."""
        if x >= self.total:
            return self.total
        b = self.block(x)
        if self.single[b] or x == self.edges[b]:
            return int(self.edges[b])
        self.load([b])
        inner = self.inner[b]
        return int(inner[np.searchsorted(inner, x, "right") - 1])

    def above(self, x: int) -> int:
        """The first group begin, or the end of all, after ``x``."""
        if x >= self.total:
            return self.total
        b = self.block(x)
        if self.single[b]:
            return int(self.edges[b + 1])
        self.load([b])
        inner = self.inner[b]
        at = int(np.searchsorted(inner, x, "right"))
        return int(inner[at]) if at < len(inner) else int(self.edges[b + 1])

    def surely(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy cuts at begins of blocks only, or None if they don't reach the end: then the capacity may be feasible all the same."""
        return self._greedy(capacity, shards, lambda x: int(self.edges[self.block(x)]))

    def perhaps(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy cuts anywhere within blocks of several groups, or None: then the capacity is surely not feasible."""
        return self._greedy(capacity, shards, lambda x: int(self.edges[self.block(x)]) if self.single[self.block(x)] else x)

    def exactly(self, capacity: int, shards: int) -> list[int] | None:
        return self._greedy(capacity, shards, self.below)

    def _greedy(self, capacity: int, shards: int, reach) -> list[int] | None:
        at, cuts = 0, []
        for _ in range(shards):
            if at >= self.total:
                break
            stop = self.total if at + capacity >= self.total else reach(at + capacity)
            if stop <= at:
                return None
            at = stop
            cuts.append(at)
        return cuts if at >= self.total else None


def smallest(low: int, high: int, feasible) -> int:
    """The least number from ``low`` to ``high`` that is feasible; ``high`` is."""
    while low < high:
        middle = (low + high) // 2
        if feasible(middle):
            high = middle
        else:
            low = middle + 1
    return low


def capacity_of(ends: Ends, shards: int) -> int:
    """The smallest capacity for which ``shards`` contiguous shards hold all groups."""
    high = smallest(-(-ends.total // shards), ends.total, lambda c: ends.surely(c, shards) is not None)
    low = smallest(-(-ends.total // shards), high, lambda c: ends.perhaps(c, shards) is not None)
    # All greedy cuts of capacities between the two lie between the sure cuts of the lower one and the possible ones of the higher.
    at, near = 0, []
    for possible in ends.perhaps(high, shards) or []:
        at = int(ends.edges[ends.block(min(at + low, ends.total))])
        near += range(ends.block(at), ends.block(possible) + 1)
    ends.load(near[:MOST_LOADED])
    return smallest(low, high, lambda c: ends.exactly(c, shards) is not None)


def cuts_of(ends: Ends, shards: int, capacity: int) -> list[int]:
    """Where each shard ends, ascending; each at most ``capacity`` after the one before, and the last the end of all."""
    # The least place from which the last k shards can hold the rest, by filling them from the end.
    least = [ends.total]
    for _ in range(shards):
        x = least[-1] - capacity
        least.append(0 if x <= 0 else x if ends.below(x) == x else ends.above(x))
    out, at = [], 0
    for k in range(shards, 0, -1):
        if k == 1 or at >= ends.total:
            out.append(ends.total)
            at = ends.total
            continue
        even = at + (ends.total - at) / k
        before, after = ends.below(int(even)), ends.above(int(even))
        best = before if even - before <= after - even and before > at else after
        best = max(best, least[k - 1])
        if best > at + capacity:
            best = ends.below(at + capacity)
        at = best
        out.append(at)
    return out


def text_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds text_key (what groups go by), size and text_crc32; a null text counts as an empty one."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumns({"text_key": F.unhex(F.sha2(data, 256)), "size": F.octet_length(data).cast("long") + 1, "text_crc32": F.crc32(data)})


def numbered(sorted_rows: DataFrame, weight: Column, name: str) -> DataFrame:
    """Adds the running sum of ``weight`` before each row, by the order that ``sorted_rows`` have within and over their partitions.

    ``sorted_rows`` are range-partitioned and sorted, and are written first, so that both passes see one order.  The driver
    holds one sum for each partition.
    """
    rows = cut(sorted_rows.withColumn("w_part", F.spark_partition_id()).withColumn("w_sum", weight.cast("long")))
    sums = sorted(rows.groupBy("w_part").agg(F.sum("w_sum").alias("s")).collect(), key=lambda r: r["w_part"])
    upto, before = 0, {}
    for r in sums:
        before[r["w_part"]] = upto
        upto += r["s"]
    kept = [f for f in rows.schema if f.name not in ("w_part", "w_sum")]

    def run(batches):
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            w = batch.column("w_sum").to_numpy()
            at = before[batch.column("w_part")[0].as_py()] if at is None else at
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(at + np.cumsum(w) - w)], names=[*[f.name for f in kept], name])
            at += int(w.sum())

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"{name} long"]))


def spread(df: DataFrame, *keys: Column) -> DataFrame:
    """Sorted over all partitions by ``keys``, whose values should be distinct, so that no key is hot."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def shard_rows(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(id, row_no, text_key, size, ...) -> the rows with shard and slot; row_no is distinct.

    Within a shard rows stand in order of their groups, then of their ids.
    """
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("g_size"), F.count("*").alias("n"), F.min("id").alias("first_id"))
    ordered = written(numbered(spread(groups, F.col("first_id").asc_nulls_first(), F.col("text_key")), F.col("g_size"), "begin"), "groups")
    total = ordered.agg(F.sum("g_size")).first()[0]
    if not total:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    unit = max(1, total // BLOCKS)
    block = (F.floor(F.col("begin") / unit) * 2 + F.when(F.col("g_size") > unit, 1).otherwise(0)).cast("long")
    blocks = ordered.groupBy(block.alias("block")).agg(F.min("begin").alias("begin"), F.count("*").alias("n")).toArrow().sort_by("begin")

    def fetch(ranges):
        inside = F.lit(False)
        for a, b in joined(ranges):
            inside = inside | ((F.col("begin") >= a) & (F.col("begin") < b))
        return np.sort(ordered.filter(inside).select("begin").toArrow().column("begin").to_numpy())

    ends = Ends(blocks.column("begin").to_numpy(), blocks.column("n").to_numpy() == 1, total, fetch)
    cuts = cuts_of(ends, shards, capacity_of(ends, shards))
    shard = sum([F.when(F.col("begin") >= c, 1).otherwise(0) for c in cuts[:-1]], F.lit(0)).cast("int")
    placed = join_by_weight(rows, ordered.select("text_key", "begin", "n"), "text_key", "n").withColumn("shard", shard)
    slots = numbered(spread(placed, F.col("begin"), F.col("id").asc_nulls_first(), F.col("row_no")), F.lit(1), "place")
    slots = cut(slots)
    first = F.broadcast(slots.groupBy("shard").agg(F.min("place").alias("first_place")))  # one row a shard
    return slots.join(first, "shard").withColumn("slot", F.col("place") - F.col("first_place")).drop("place", "first_place", "begin")


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def placements(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of ``docs`` (doc_id, text).

    A null text counts as an empty one, of size 1.  Null and repeated ids are values like others (nulls first); which of several
    rows with one text and id has which slot is open.  Texts of any length go by their hash.  With fewer groups than shards some
    shards are empty; a group larger than an even share makes shards uneven, and no contiguous cut of the row has a smaller
    largest shard.  Other columns are left out; an empty table gives no rows.
    """
    rows = text_columns(docs.select("doc_id", "text")).drop("text").withColumnRenamed("doc_id", "id")
    rows = cut(rows.withColumn("row_no", F.monotonically_increasing_id()))
    law = {"law": F.lit(LAW), "grown_shard": F.lit(None).cast("int")}
    return shard_rows(rows, shards).withColumns(law).select(F.col("id").alias("doc_id"), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the rows of ``docs`` (doc_id, text, ...) as they are, in one folder `shard=K` each, in the order of their slots.

    Rows meet their places by a number that is written with them; files are cut by size, not one to a shard.
    """
    boxes = written(boxed(docs, "doc_id", "text").withColumn("row_no", F.monotonically_increasing_id()), "rows")
    rows = text_columns(boxes).select(F.col("doc_id").alias("id"), "row_no", "text_key", "size")
    placed = shard_rows(rows, shards).select("row_no", "shard", "slot")
    out = boxes.select("boxed_row", "row_no").join(placed, "row_no")
    spread(out, F.col("shard"), F.col("slot")).select(F.col("boxed_row.*"), F.col("shard").alias("shard")).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placements(read_table(spark, sf_dir, "documents"))
