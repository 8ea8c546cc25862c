"""Operator 2: SimHash near-duplicates by a self-join of binary tries.

Fingerprints at Hamming distance at most 4 are linked.  Two fingerprints that
differ in at most 4 bits differ in at most 1 bit of the first half or in at
most 2 bits of the second, so two tries are joined with themselves: one reads
the halves in order with 1 error allowed in the first 32 bits, one in reverse
order with 2.  The top of a trie is spread over Spark: a *cell* is one top
node; it holds its own fingerprints and, as visitors, those of the smaller top
nodes within the error budget.  Inside a cell, node pairs descend together,
their differing bits add up, and a pair is dropped when the budget is exceeded.

Only what connects is emitted: a cell keeps a union-find over its leaves, runs
with rising total budgets (0 to 4), and drops a node pair when both nodes lie
in one component already.  A group of k near copies therefore costs about k
links and never k^2 pairs.  Components over all cells follow in Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecohort.llm import text as X
from wavecohort.llm.components import components
from wavecohort.llm.stored import kept, scratch, stored

SEED = 42
BITS = 64
DISTANCE = 4
LEAVES = 1 << 16  # fingerprints a cell owns, about
BLOCK = 1 << 18  # node pairs expanded at a time
CHUNK = 1 << 16  # shingles whose bits are counted at a time


def half_budgets(distance: int) -> tuple[int, int]:
    """Errors allowed in the first 32 bits of each trie; their sum is the distance less one."""
    return (distance - 1) // 2, distance // 2


# --- fingerprints ------------------------------------------------------------------


def fingerprint(value: bytes, size: int) -> int:
    """Fingerprint of one text: majority bits of the XXH64 of its shingles; 0 without words."""
    parts = value.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    k = min(size, len(parts))
    high = ends[k - 1:].tolist()
    low = [0, *(ends[: len(parts) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(high), CHUNK):
        h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(low[at:at + CHUNK], high[at:at + CHUNK])], ">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(high)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", size: int = 4) -> DataFrame:
    """``keep`` columns and fp (long, the 64 bits) of every row; null texts count as empty."""
    def run(batches):
        for b in batches:
            column = X.plain(b.column(b.num_columns - 1))
            data, offsets = X.buffers(column)
            at = offsets.tolist()
            whole = data.tobytes()
            fp = np.fromiter((fingerprint(whole[a:z], size) for a, z in zip(at, at[1:])), np.uint64, len(column))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], [*keep, "fp"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(X.trimmed(run), schema)


# --- one cell ------------------------------------------------------------------------


class Forest:
    """Union-find over leaves, in bulk."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join leaf a[i] with b[i]; afterwards ``up`` holds the smallest leaf of each component."""
        up = self.up
        while True:
            x, y = up[a], up[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while True:
                flat = up[up]
                if np.array_equal(flat, up):
                    break
                up[:] = flat


def _split(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """First leaf of each node whose ``bit`` (from the top) is set; node = [low, high) of sorted values under one prefix."""
    mask = np.uint64((1 << (BITS - bit)) - 1)
    edge = np.uint64(1 << (BITS - bit - 1))
    head = values[low] & ~mask | edge
    return np.clip(np.searchsorted(values, head), low, high)


def _uniform(up: np.ndarray) -> np.ndarray:
    """For each leaf, the end of the run of leaves of its component that starts there."""
    n = len(up)
    change = np.flatnonzero(np.append(up[1:] != up[:-1], True)) + 1
    return change[np.searchsorted(change, np.arange(n), "right")]


def join_cell(values: np.ndarray, owned: np.ndarray, top: int, half: int, distance: int) -> np.ndarray:
    """Smallest linked leaf of each leaf.

    ``values``: distinct fingerprints in ascending order; ``owned``: those of
    the cell's own top node, the others are visitors and not joined with each
    other.  ``half``: errors allowed in the first 32 bits.
    """
    n = len(values)
    forest = Forest(n)
    own = np.flatnonzero(owned)
    if not len(own) or n < 2:
        return forest.up
    tops = values >> np.uint64(BITS - top) if top else np.zeros(n, np.uint64)
    low = np.flatnonzero(np.append(True, tops[1:] != tops[:-1]))
    high = np.append(low[1:], n)
    mine = np.searchsorted(low, own[0], "right") - 1
    error = np.bitwise_count(tops[low] ^ tops[own[0]]).astype(np.int64)
    for budget in range(1, distance + 1):
        stack = [(top, low, high, np.full(len(low), low[mine]), np.full(len(low), high[mine]), error)]
        end = _uniform(forest.up)
        while stack:
            bit, al, ah, bl, bh, e = stack.pop()
            allowed = min(half, budget) if bit <= 32 else budget
            keep = (e <= allowed) & (ah > al) & (bh > bl)
            al, ah, bl, bh, e = al[keep], ah[keep], bl[keep], bh[keep], e[keep]
            keep = (end[al] < ah) | (end[bl] < bh) | (forest.up[al] != forest.up[bl])
            al, ah, bl, bh, e = al[keep], ah[keep], bl[keep], bh[keep], e[keep]
            single = (ah - al == 1) & (bh - bl == 1)
            if single.any():
                a, b = al[single], bl[single]
                diff = values[a] ^ values[b]
                near = (np.bitwise_count(diff) <= budget) & (np.bitwise_count(diff >> np.uint64(32)) <= half)
                if near.any():
                    forest.link(a[near], b[near])
                    end = _uniform(forest.up)
                al, ah, bl, bh, e = al[~single], ah[~single], bl[~single], bh[~single], e[~single]
            if not len(al):
                continue
            if len(al) > BLOCK:
                for at in range(0, len(al), BLOCK):
                    part = slice(at, at + BLOCK)
                    stack.append((bit, al[part], ah[part], bl[part], bh[part], e[part]))
                continue
            am, bm = _split(values, al, ah, bit), _split(values, bl, bh, bit)
            same = al == bl  # a node with itself: its children's mixed pair counts once
            other = ~same
            stack.append((
                bit + 1,
                np.concatenate([al, am, al, am[other]]),
                np.concatenate([am, ah, am, ah[other]]),
                np.concatenate([bl, bm, bm, bl[other]]),
                np.concatenate([bm, bh, bh, bm[other]]),
                np.concatenate([e, e, e + 1, e[other] + 1]),
            ))
    return forest.up


# --- the join ------------------------------------------------------------------------


def _turned(values: np.ndarray, trie: int) -> np.ndarray:
    return values if trie == 0 else (values << np.uint64(32)) | (values >> np.uint64(32))


def _neighbours(top: int, budget: int) -> np.ndarray:
    """Differences of ``top`` bits with at most ``budget`` set."""
    masks = np.arange(1 << top, dtype=np.uint64)
    return masks[np.bitwise_count(masks) <= budget]


def links(distinct: DataFrame, top: int, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links that connect all fingerprints (column fp, distinct) within ``distance``."""
    shift = np.uint64(BITS - top)
    budgets = half_budgets(distance)

    def spread(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            cells, values = [], []
            for trie, budget in enumerate(budgets):
                turned = _turned(fp, trie)
                node = turned >> shift if top else np.zeros(len(fp), np.uint64)
                for d in _neighbours(top, budget):
                    other = node ^ d
                    to = other >= node
                    cells.append(other[to].astype(np.int64) * 2 + trie)
                    values.append(fp[to])
            cell, value = np.concatenate(cells), np.concatenate(values).view(np.int64)
            for at in range(0, len(cell), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(cell[at:at + (1 << 16)]), pa.array(value[at:at + (1 << 16)])], ["cell", "fp"])

    def join(key, tab):
        cell = key[0].as_py()
        trie, node = cell % 2, cell // 2
        values = np.sort(_turned(tab.column("fp").to_numpy().view(np.uint64), trie))
        owned = (values >> shift if top else np.zeros(len(values), np.uint64)) == np.uint64(node)
        up = join_cell(values, owned, top, budgets[trie], distance)
        moved = np.flatnonzero(up != np.arange(len(up)))
        back = _turned(values, trie).view(np.int64)
        return pa.table({"a": pa.array(back[moved]), "b": pa.array(back[up[moved]])})

    return distinct.select("fp").mapInArrow(X.trimmed(spread), "cell long, fp long").groupBy("cell").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4,
                    leaves: int = LEAVES) -> DataFrame:
    """(id_col, fp, component_id) for every row of ``docs``.

    component_id is the smallest id reachable over links, the row's own
    included.  Null and empty texts, and texts without a word, have fingerprint
    zero and are linked like any other.  Rows with a null id get the class of
    their fingerprint, but never name it; a class of such rows alone is null.
    Equal rows give equal rows.  An empty table gives an empty result.
    """
    with scratch(docs.sparkSession):
        rows = kept(fingerprints(docs, [id_col], text_col, size), "fingerprints")
        found = kept(classes(rows, id_col, leaves), "classes")
    return rows.join(found, "fp").select(id_col, "fp", "component_id")


def classes(rows: DataFrame, id_col: str, leaves: int = LEAVES) -> DataFrame:
    """(fp, root, component_id): one row for each fingerprint of ``rows`` (id_col, fp); root is the class's fingerprint."""
    known = stored(rows.groupBy("fp").agg(F.min(id_col).alias("_least")), "distinct")
    top = max(4, int(np.ceil(np.log2(max(1, known.count()) / leaves))))
    return rooted(known, components(links(known, top)))


def rooted(known: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, root, component_id) from ``known`` (fp, _least) and the (node, root) of linked fingerprints."""
    rows = stored(known.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "_least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rows.groupBy("root").agg(F.min("_least").alias("component_id"))
    return rows.join(named, "root").select("fp", "root", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """One row of ``docs`` for each class, all columns unchanged; see ``one_of_each``."""
    def marks(df, keep, col):
        return fingerprints(df, keep, col, size)

    with scratch(docs.sparkSession):
        rows = stored(marks(docs, [id_col], text_col), "fingerprints")
        named, nameless = chosen(rows, classes(rows, id_col), id_col)
    return one_of_each(docs, named, nameless, marks, id_col, text_col)


def chosen(rows: DataFrame, of_fp: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(ids that name their class, (fp, root) of classes without an id), for ``one_of_each``; they outlive the scope."""
    of_fp = stored(of_fp, "classes")
    named = rows.join(of_fp, "fp").filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    return kept(named, "named"), kept(of_fp.filter("component_id is null").select("fp", "root"), "nameless")


def one_of_each(docs: DataFrame, named: DataFrame, of_fp: DataFrame, marks, id_col: str, text_col: str) -> DataFrame:
    """The row with the class's id of each class; ``marks(docs, keep, text_col)`` has the fp, ``named`` and ``of_fp`` are ``chosen``.

    Of several rows with that id the one with the least hash of all columns
    stays.  A class of rows without id keeps one row in the same way; in other
    classes rows without id go.
    """
    # Whole rows travel as one column, so that none of their names can clash.
    boxed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_body"))
    order = F.xxhash64("_row")
    turn = F.row_number().over(Window.partitionBy("_id").orderBy(order))
    first = boxed.join(named.withColumnRenamed(id_col, "_id"), "_id", "left_semi").withColumn("_turn", turn)
    nameless = marks(boxed.filter("_id is null"), ["_row"], "_body")
    nameless = nameless.join(of_fp, "fp")
    nameless = nameless.withColumn("_turn", F.row_number().over(Window.partitionBy("root").orderBy(order)))
    both = first.filter("_turn = 1").select("_row").union(nameless.filter("_turn = 1").select("_row"))
    return both.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
