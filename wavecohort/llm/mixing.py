"""Operator 8: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source gets a target in words.  Its documents fall into blocks by a hash,
about ``BLOCKS`` for each shard over all sources, so that every shard gets many
draws at every size; a target of 2.3 times the source takes every
block twice and 0.3 of the words from blocks in permuted order.  The last block
is entered document by document, again in permuted order, and the last document
is cut, so that the words taken are the rounded target exactly.

The number of block draws of each source is split among the output shards by a
binary tree: at every node the left half receives an exact share of all draws,
whose composition by source is one multivariate-hypergeometric draw.  Each
shard thus has the mix of the whole up to sampling noise, and the quotas of a
source add up to its draws.  The permuted draws of a source are then dealt to
the shards by these quotas, disjointly; inside a shard, rows are ordered by a
hash.  The tree sees one number for each source and shard; blocks and documents
stay in Spark.  All hashes and draws are seeded, so reruns agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.llm.stored import kept, scratch, stored
from wavecohort.operators.sets import join_null_safe

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 8
BLOCKS = 100  # for each shard
SHARDS = 40
PART_WORDS = 4_000_000  # words in one partition of the mix
SMALL = 50_000  # rows of the table of blocks that are broadcast at most


def targets(sizes: dict, weights: tuple = WEIGHTS, most: int = MOST) -> dict:
    """Words to take from each source (name or None -> words).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    the sum of all sizes; a target above ``most`` times its source stops there
    and the excess is shared anew, until none is above.  Empty sources get 0.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), list(names)
    while open_:
        unit = left / sum(weigh[s] for s in open_)
        over = [s for s in open_ if unit * weigh[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weigh[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def split_tree(draws: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(sources, shards): exact quotas that add up to ``draws`` by row; shards differ by rounding only in their sums."""
    if shards == 1:
        return draws.reshape(-1, 1)
    left = shards // 2
    share = int(draws.sum()) * left // shards
    part = rng.multivariate_hypergeometric(draws, share, method="marginals") if len(draws) else draws
    return np.concatenate([split_tree(part, left, rng), split_tree(draws - part, shards - left, rng)], axis=1)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more) -> DataFrame:
    """_source, _size (words) and _key (the permutation's hash) of every row, and ``more``."""
    body = F.col(text_col).cast("string")
    return docs.select(
        *more, F.col(source_col).cast("string").alias("_source"),
        F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), body).alias("_key"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, most: int = MOST, shards: int = SHARDS, block_words: int | None = None,
        seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and parts, an array of (copy, shard, words, place).

    A part is one appearance of the document in the mix, place its order in the
    shard; a part with fewer words than the document stands for its first words.
    Rows that the mix leaves out have an empty array.  A null text has 0 words
    and a null source is a source of its own; rows without words are never
    taken.  Repeated rows are taken alike: where the target ends among them,
    each gives as many words.  Columns named like the added ones are replaced.
    """
    return _mix(docs, id_col, text_col, source_col, weights, most, shards, block_words, seed)[0]


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple = WEIGHTS, most: int = MOST,
         shards: int = SHARDS, block_words: int | None = None, seed: int = SEED) -> tuple[DataFrame, int]:
    """The rows of ``mix`` and the words taken over all.

    All is decided on (source, size, key) rows and per block.  What becomes of a
    document follows from its key and one row for its block, so texts are read
    once and are never shuffled for it.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "parts")]
    with scratch(spark):
        narrow = stored(_sized(docs, id_col, text_col, source_col, seed), "sizes")
        sizes = {r["_source"]: int(r["n"]) for r in narrow.groupBy("_source").agg(F.sum("_size").alias("n")).collect()}
        goal = targets(sizes, weights, most)
        block_words = block_words or max(1, sum(sizes.values()) // (shards * BLOCKS))
        plan = []
        for s, n in sizes.items():
            words = round(goal[s])
            plan.append((s, n, goal[s], max(1, -(-n // block_words)), words // n if n else 0, words % n if n else 0))
        sources = spark.createDataFrame(plan, "_source string, source_size long, target double, _blocks long, _full long, _rest long")

        def with_block(df: DataFrame) -> DataFrame:
            return join_null_safe(df, sources, ["_source"]).withColumn("_block", F.pmod(F.col("_key"), F.col("_blocks")))

        # One row for each block: its place in the permuted order and what of it is drawn beyond full copies.
        order = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed), "_source", "_block"), "_block")
        blocks = (
            with_block(narrow).groupBy("_source", "_block", "_full", "_rest").agg(F.sum("_size").alias("_words"))
            .withColumn("_before", F.sum("_words").over(order) - F.col("_words"))
            .withColumn("_left", F.greatest(F.lit(0).cast("long"), F.least(F.col("_words"), F.col("_rest") - F.col("_before")))))
        blocks = stored(blocks, "blocks")
        copies = F.col("_full") + F.when(F.col("_left") > 0, 1).otherwise(0)
        counts = {r["_source"]: int(r["n"]) for r in blocks.groupBy("_source").agg(F.sum(copies).alias("n")).collect()}
        names = sorted(counts, key=lambda s: (s is None, s or ""))
        quotas = split_tree(np.array([counts[s] for s in names], np.int64), shards, np.random.default_rng(seed))
        deal = spark.createDataFrame([(s, np.cumsum(q).tolist()) for s, q in zip(names, quotas)], "_source string, _ends array<long>")
        draws = blocks.filter(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
        turn = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed), "_source", "_block", "_copy"), "_block", "_copy")
        draws = draws.withColumn("_turn", F.row_number().over(turn).cast("long") - 1)
        draws = join_null_safe(draws, deal, ["_source"])
        shard = F.size(F.filter("_ends", lambda q: q <= F.col("_turn")))
        dealt = draws.groupBy("_source", "_block").agg(
            F.array_sort(F.collect_list(F.struct(F.col("_copy").alias("copy"), shard.alias("shard")))).alias("_dealt"))
        # The one block of a source that is drawn in part: the key at which the words end, and what is left for the rows with it.
        entered = blocks.filter((F.col("_left") > 0) & (F.col("_left") < F.col("_words"))).select("_source", "_block", "_left")
        inside = Window.partitionBy("_source", "_block").orderBy("_key")
        ends = join_null_safe(with_block(narrow), entered, ["_source", "_block"]).groupBy("_source", "_block", "_left", "_key").agg(
            F.sum("_size").alias("_words"), F.count("*").alias("_ties")).withColumn("_upto", F.sum("_words").over(inside))
        ends = ends.filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_words") < F.col("_left"))).select(
            "_source", "_block", F.col("_key").alias("_last"),
            F.floor((F.col("_left") - F.col("_upto") + F.col("_words")) / F.col("_ties")).alias("_some"))
        table = join_null_safe(blocks.select("_source", "_block", "_left"), dealt, ["_source", "_block"], "left")
        table = kept(join_null_safe(table, ends, ["_source", "_block"], "left"), "draws")
        small = table.count() <= SMALL

    rows = with_block(_sized(docs, id_col, text_col, source_col, seed, F.col(id_col).cast("string").alias("_name"), F.struct(*own).alias("_row")))
    rows = join_null_safe(rows, F.broadcast(table) if small else table, ["_source", "_block"])
    extra = (F.when(F.col("_left") == 0, F.lit(0).cast("long")).when(F.col("_last").isNull() | (F.col("_key") < F.col("_last")), F.col("_size"))
             .when(F.col("_key") == F.col("_last"), F.least("_some", "_size")).otherwise(F.lit(0).cast("long")))
    words = lambda d: F.when(d["copy"] < F.col("_full"), F.col("_size")).otherwise(F.col("_extra"))
    place = lambda d: F.xxhash64(F.lit(seed), "_name", d["copy"])
    part = F.transform("_dealt", lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), words(d).alias("words"), place(d).alias("place")))
    empty = F.array().cast("array<struct<copy:bigint,shard:int,words:bigint,place:bigint>>")
    # The parts are made in a step of their own, where no column of the input is in sight.
    done = rows.withColumn("_extra", extra).withColumn("_parts", F.coalesce(F.filter(part, lambda p: p["words"] > 0), empty))
    done = done.select(
        *[F.col("_row")[c].alias(c) for c in own], F.col("_size").alias("size"), "source_size", "target", F.col("_parts").alias("parts"))
    return done, sum(round(t) for t in goal.values())


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: shard after shard, shuffled inside each.

    A document that is taken several times gives several rows; a cut document
    keeps its first words, joined by single spaces.  The partition of a row
    follows from its shard and its place, so rows move once and no order is sampled.
    """
    own = docs.columns
    shards = options.get("shards", SHARDS)
    boxed = docs.select(F.struct(*own).alias("_row"), F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"),
                        F.col(source_col).alias("_from"))
    taken, total = _mix(boxed, "_id", "_text", "_from", seed=seed, **options)
    cut = F.array_join(F.slice(F.filter(F.split("_text", GAP), lambda w: w != ""), 1, F.col("_part.words").cast("int")), " ")
    body = F.when(F.col("_part.words") < F.col("size"), cut).otherwise(F.col("_text"))
    rows = taken.withColumn("_part", F.explode("parts")).select(
        *[body.alias(f"_{k}") if c == text_col else F.col("_row")[c].alias(f"_{k}") for k, c in enumerate(own)],
        F.col("_part.shard").alias("_shard"), F.col("_part.place").alias("_place"))
    parts = max(1, -(-total // PART_WORDS))
    share = (F.col("_shard") + F.col("_place") / 2.0**64 + 0.5) / shards
    rows = rows.repartitionById(parts, F.least(F.lit(parts - 1), F.floor(share * parts).cast("int"))).sortWithinPartitions("_shard", "_place")
    return rows.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(own)])
