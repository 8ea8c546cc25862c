"""Operator 13: Merkle manifest of a dataset, kept as concatenated level strings.

Rows of a group (a source) stand in order; ``FAN`` consecutive nodes become one
parent until one node is left.  Nodes are dealt to aligned blocks of ``BLOCK``
(a power of ``FAN``), and a block keeps each of its levels as one string of
64-character digests.  A parent is the hash of one fixed-width substring; the
siblings of a node are the two substrings on either side of it in its run.
The roots of the blocks are the nodes of the next, ``BLOCK`` times shorter
sequence, and so on until every group is one block.  The roots of the groups
are such a sequence themselves.

Everything is SQL functions.  No group is gathered: places come from a range
partitioning with counts of the partitions before, so that a source with a
third of all rows costs as many tasks as its size asks for; a task holds blocks
of 256 digests.  Proofs are made where the block is and never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.llm.stored import stored

FAN = 16
LEVELS = 2  # of a block
BLOCK = FAN**LEVELS
DIGEST = 64


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of one row: '-' for a null, else the number of UTF-8 bytes, a colon and the value, all concatenated."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, key: str, order: Sequence[str]) -> tuple[DataFrame, int]:
    """``rows`` with _at (place from 0 within the key, by ``order``) and _n (rows of the key), and the largest _n."""
    placed = stored(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "placed")
    counts = placed.groupBy(key, "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.select(
        key, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(key)).alias("_n")), "counts")
    inside = Window.partitionBy(key, "_part").orderBy(*order)
    out = placed.join(counts, [key, "_part"]).withColumn("_at", F.row_number().over(inside) - 1 + F.col("_before"))
    return out.drop("_part", "_before"), counts.agg(F.max("_n")).first()[0] or 0


def _parents(level: Column) -> Column:
    """The level above: hashes of the fixed-width substrings, joined."""
    width = FAN * DIGEST
    starts = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(starts, lambda k: F.sha2(F.substring(level, k * width + 1, F.lit(width)), 256)), "")


def _siblings(levels: Sequence[Column], at: Column, depth: Column) -> Column:
    """(left, right) substrings beside the ancestors of node ``at`` of a block, level by level."""
    pairs = []
    for k, level in enumerate(levels):
        node = F.floor(at / FAN**k)
        run, own = F.floor(node / FAN) * FAN, node % FAN
        cut = lambda a, n: F.substring(level, (a * DIGEST + 1).cast("int"), (n * DIGEST).cast("int"))  # noqa: E731, B023
        pairs.append(F.struct(cut(run, own).alias("left"), cut(run + own + 1, FAN - 1 - own).alias("right")))
    return F.slice(F.array(*pairs), F.lit(1), depth)


def tree(nodes: DataFrame, most: int) -> DataFrame:
    """Blocks of ``nodes`` (_key, _at, _n, _hash, _load): _key, _block, _rows, _level0.., _depth, _above, _top.

    _rows are the block's nodes in order, _above the sibling strings above the
    block and _top the root of the key.  ``most`` is the largest _n.
    """
    depth = sum((F.col("_n") > FAN**k).cast("int") for k in range(LEVELS))
    blocks = nodes.groupBy("_key", F.floor(F.col("_at") / BLOCK).alias("_block")).agg(
        F.max("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_at", "_hash", "_load"))).alias("_rows"))
    blocks = blocks.withColumn("_depth", depth).withColumn("_level0", F.array_join(F.transform("_rows", lambda r: r["_hash"]), ""))
    root = F.col("_level0")
    for k in range(1, LEVELS + 1):
        blocks = blocks.withColumn(f"_level{k}", F.when(F.col("_depth") >= k, _parents(F.col(f"_level{k - 1}"))))
        root = F.coalesce(F.col(f"_level{k}"), root)
    blocks = stored(blocks.withColumn("_root", root), "blocks")
    none = F.array().cast("array<struct<left:string,right:string>>")
    if most <= BLOCK:
        return blocks.withColumn("_above", none).withColumn("_top", F.col("_root"))
    parents = blocks.filter(F.col("_n") > BLOCK).select(
        "_key", F.col("_block").alias("_at"), F.ceil(F.col("_n") / BLOCK).alias("_n"), F.col("_root").alias("_hash"), F.lit(None).cast("string").alias("_load"))
    upper = paths(tree(parents, -(-most // BLOCK)))
    upper = stored(upper.select("_key", F.col("_at").alias("_block"), F.col("_proof").alias("_above"), "_top"), "above")
    return blocks.join(upper, ["_key", "_block"], "left").withColumn("_above", F.coalesce("_above", none)).withColumn("_top", F.coalesce("_top", "_root"))


def paths(blocks: DataFrame, *more: str) -> DataFrame:
    """_key, _at, _hash, _load, _proof, _top and ``more`` of every node of ``tree``'s blocks."""
    rows = blocks.select("*", F.posexplode("_rows").alias("_place", "_row"))
    levels = [F.col(f"_level{k}") for k in range(LEVELS)]
    proof = F.concat(_siblings(levels, F.col("_place"), F.col("_depth")), F.col("_above"))
    return rows.select("_key", F.col("_row._at").alias("_at"), F.col("_row._hash").alias("_hash"), F.col("_row._load").alias("_load"),
                       proof.alias("_proof"), "_top", *more)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof lead to."""
    return F.aggregate(proof, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(rows: DataFrame, group_col: str = "source", order_col: str = "doc_id", leaf_col: str = "leaf", keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, leaf, subroot, root and proof of every row.

    ``rows`` brings its leaf digests (see ``leaf``).  Rows of a group ascend by
    ``order_col``, ties by leaf; a null order value comes first and a null group
    is a group of its own, before all others; groups ascend bytewise.  proof is
    an array of (left, right) strings from the leaf's run to the root, empty for
    a table of one row.  Equal rows are leaves of their own.  An empty table
    gives an empty result.
    """
    group = F.col(group_col).cast("string")
    narrow = stored(rows.select(
        F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group)).alias("_key"), F.col(order_col).alias("_order"),
        F.col(leaf_col).alias("_hash"), F.struct(F.lit(0).alias("_"), *keep).alias("_load"), F.monotonically_increasing_id().alias("_uid")), "leaves")
    nodes, most = numbered(narrow, "_key", ["_order", "_hash", "_uid"])
    blocks = stored(tree(nodes.select("_key", "_at", "_n", "_hash", "_load"), most), "groups")
    groups = blocks.filter("_block = 0").select(F.lit("").alias("_key"), F.col("_key").alias("_group"), F.col("_top").alias("_hash"))
    nodes, most = numbered(groups, "_key", ["_group"])
    over = paths(tree(nodes.select("_key", "_at", "_n", "_hash", F.col("_group").alias("_load")), most))
    over = stored(over.select(F.col("_load").alias("_key"), F.col("_proof").alias("_over"), F.col("_top").alias("_all")), "roots")
    done = paths(blocks.join(over, "_key"), "_over", "_all")
    return done.select(*[F.col("_load")[c].alias(c) for c in keep], F.col("_hash").alias("leaf"), F.col("_top").alias("subroot"),
                       F.col("_all").alias("root"), F.concat("_proof", "_over").alias("proof"))
