"""Operator 5: shards of equal size by best-fit-decreasing bin packing.

Groups of equal texts are indivisible.  They are packed on two levels, so that
no task or driver sees them all: every task packs its small groups, largest
first, into *units* of at most a ``fineness``-th of a shard; then the driver
packs units and large groups into the shards.  Units that are less than half
full never stand side by side, so the driver's list has at most
2 * shards * fineness rows and one for each task, whatever the input.  An item
enters the open bin with the least room that still holds it, found in a
balanced tree of the bins' room; what fits nowhere goes to the shard with most
room.

The one exception to indivisible groups: a group larger than a whole shard is
cut into shard-sized pieces, because no law of equal sizes could hold otherwise.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.llm.stored import stored

SHARDS = 40
OVERHEAD = 16
FINENESS = 1000
RANK_ROWS = 10_000


class RoomTree:
    """Bins by room in a two-level balanced tree: leaves of up to ``LEAF`` entries, split in halves when full."""

    LEAF = 512

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.tops: list[tuple[int, int]] = []  # last entry of every leaf but the last

    def add(self, room: int, bin_: int) -> None:
        k = bisect_left(self.tops, (room, bin_))
        leaf = self.leaves[k]
        insort(leaf, (room, bin_))
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[k : k + 1] = [leaf[:half], leaf[half:]]
            self.tops.insert(k, leaf[half - 1])

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the bin with the least room of at least ``size``."""
        k = bisect_left(self.tops, (size, -1))
        while k < len(self.leaves):
            at = bisect_left(self.leaves[k], (size, -1))
            if at < len(self.leaves[k]):
                return self._take(k, at)
            k += 1
        return None

    def widest(self) -> tuple[int, int] | None:
        """Take out the bin with most room."""
        for k in range(len(self.leaves) - 1, -1, -1):
            if self.leaves[k]:
                return self._take(k, len(self.leaves[k]) - 1)
        return None

    def _take(self, k: int, at: int) -> tuple[int, int]:
        found = self.leaves[k].pop(at)
        if not self.leaves[k] and len(self.leaves) > 1:
            del self.leaves[k]
            del self.tops[min(k, len(self.tops) - 1)]
        return found


def best_fit_decreasing(sizes: np.ndarray, capacity: int, bins: int | None = None) -> np.ndarray:
    """Bin of each size; sizes go in descending order, equal ones as they stand.

    Without ``bins``, a new bin opens whenever none has room (a size above the
    capacity gets one alone).  With ``bins``, that many are open from the start
    and what fits nowhere enters the one with most room.
    """
    tree = RoomTree()
    out = np.zeros(len(sizes), np.int64)
    made = bins or 0
    for b in range(made):
        tree.add(capacity, b)
    sizes = sizes.tolist() if isinstance(sizes, np.ndarray) else sizes
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.tightest(sizes[i])
        if found is None:
            if bins is None:
                found = (max(capacity, sizes[i]), made)
                made += 1
            else:
                found = tree.widest()
        room, out[i] = found
        tree.add(room - sizes[i], found[1])
    return out


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with a gapless rank from 0 within ``keys`` (not null), in groups of any size.

    Rows are spread over buckets by a hash of ``order``; ranks count inside a
    bucket and start after the rows of the buckets before it.  ``df`` should be
    stored, it is read twice.
    """
    n = max(1, -(-df.count() // RANK_ROWS))
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    counts = spread.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_from", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return spread.join(before, [*keys, "_bucket"]).withColumn(name, F.col("_from") + inside).drop("_bucket", "_from")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
          fineness: int = FINENESS) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) of every row.

    size: bytes of the text and ``OVERHEAD``; a null text has none and belongs to
    the group of the empty one.  Shards are nearly equal in bytes, as far as
    indivisible rows allow; slots count from 0 in each shard.  Repeated rows
    and null ids are rows like any other.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.unhex(F.md5(body)).alias("g")), "sizes")
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("size").alias("one"))
    groups = stored(groups, "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    capacity = max(1, -(-total // shards))
    unit = max(1, total // (shards * fineness))

    # Small groups, packed into units by the tasks that hold them.
    def pack(batches):
        part = TaskContext.get().partitionId()
        whole = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if whole is not None and whole.num_rows:
            bins = best_fit_decreasing(whole.column("bytes").to_numpy(), unit)
            yield from whole.append_column("part", pa.array(np.full(len(bins), part, np.int32))).append_column(
                "item", pa.array(bins)).select(["g", "bytes", "part", "item"]).combine_chunks().to_batches()

    small = groups.filter(F.col("bytes") <= unit).select("g", "bytes").repartition("g").sortWithinPartitions(F.desc("bytes"), "g")
    small = stored(small.mapInArrow(pack, "g binary, bytes long, part int, item long"), "units")
    units = small.groupBy("part", "item").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "part", "item").collect()
    large = groups.filter(F.col("bytes") > unit).orderBy(F.desc("bytes"), "g").collect()

    # Items of the driver: (bytes, key of the unit or group, piece).
    items = [(r["bytes"], (r["part"], r["item"]), 0) for r in units]
    cut = {}
    for r in large:
        each = max(1, capacity // r["one"])
        if r["bytes"] > capacity and r["n"] > 1:
            cut[bytes(r["g"])] = each
            items += [(min(each, r["n"] - k) * r["one"], bytes(r["g"]), k // each) for k in range(0, r["n"], each)]
        else:
            items.append((r["bytes"], bytes(r["g"]), 0))
    bins = best_fit_decreasing([i[0] for i in items], capacity, shards).tolist()
    of_unit = [(*key, b) for (_, key, _), b in zip(items, bins) if isinstance(key, tuple)]
    of_group = [(bytearray(key), piece, b) for (_, key, piece), b in zip(items, bins) if isinstance(key, bytes)]
    unit_shard = spark.createDataFrame(of_unit, "part int, item long, shard int")
    group_shard = spark.createDataFrame(of_group, "g binary, piece long, shard int")

    # At most ``shards`` groups are larger than a shard.
    oversized = spark.createDataFrame([(bytearray(g), each) for g, each in cut.items()], "g binary, each long")
    in_pieces = rows.limit(0).withColumn("piece", F.lit(0).cast("long"))
    if cut:
        own = stored(rows.join(F.broadcast(oversized), "g"), "oversized")
        in_pieces = ranked(own, ["g"], ["id", "size"]).select(*rows.columns, F.floor(F.col("rank") / F.col("each")).cast("long").alias("piece"))
    others = rows.join(F.broadcast(oversized), "g", "left_anti")
    place = group_shard.filter("piece = 0").select("g", "shard").union(small.join(unit_shard, ["part", "item"]).select("g", "shard"))
    placed = others.join(place, "g").unionByName(in_pieces.join(group_shard, ["g", "piece"]).drop("piece"))
    placed = stored(placed.select("id", "size", "text_crc32", "shard"), "placed")
    out = ranked(placed, ["shard"], ["id", "text_crc32", "size"], "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
