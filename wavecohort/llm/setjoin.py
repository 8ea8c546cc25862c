"""Operator 11: n-gram Jaccard self-join by T-occurrence search.

Two sets of n and m shingles link at a similarity s if they share at least
T(n, m) = ceil(s (n + m) / (1 + s)) of them, so a partner of a set stands in at
least T of the inverted lists of its n shingles.  DivideSkip puts the longest
lists aside, merges the others, and looks the survivors up in the long ones.

Over the cluster the lists put aside are as many as can be: all but the
``n - ceil(s n) + 1`` rarest shingles of a set.  Every linked pair then shares
one of the short lists, which come from one shuffle by shingle.  Rarity is taken
from counts of all shingles in a table of fixed size; it decides the cost and
not the result.  In a task, a query set meets a batch of the sets its short
lists hold: the batch's own inverted lists are divided again, the short ones
are merged with a heap, sets that reach T less the number of long lists are
probed in the long ones by bisection, and those with T occurrences stay.

Sets are distinct (equal texts are one set).  No list emits all its pairs:
first every set of a list meets one star, the set with the least name; what
links is connected.  Then sets of one list meet in pairs only if they lie in
different components still, and if their sizes and places in the lists leave
room for T common shingles.  A pair inside one component changes nothing.

Every set has 256 parity bits, one shingle flipping one of them.  Two sets that
differ in d shingles differ in at most d bits, so pairs with more such bits than
n + m - 2 T are no candidates.  This settles most near misses in the join.  In
large sets any two differ in about half of 256 bits, which settles nothing;
there a sketch with a bit for two to four shingles does, by the same bound, and
only pairs that it leaves open are joined with their sets.
"""

from __future__ import annotations

import heapq
from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecohort.llm import text as X
from wavecohort.llm.components import components
from wavecohort.llm.jaccard import shingles
from wavecohort.llm.stored import stored

SIZE = 3
PERCENT = 90
BUCKETS = 1 << 20  # of the table of counts: 4 MB, whatever the data
BLOCK = 1 << 12  # buckets in one row of the counts of a task
SMALL = 500_000  # pairs that are broadcast at most, 16 bytes each
BATCH = 128  # sets that meet a query at a time
BITS = 1 << 23  # of the map of wanted sets: 1 MB
PARITY = 4  # words of 64 parity bits
SHARE = 2  # a sketch has a bit for so many shingles at least
MU = 0.0085  # share of the cost of a probe in the choice of the long lists


def needed(n, m, percent: int = PERCENT):
    """Common shingles from which sets of n and m are similar enough."""
    return -(-percent * (n + m) // (100 + percent))


def short(n, percent: int = PERCENT):
    """Number of a set's short lists, one of which holds every similar set."""
    return n + percent * n // -100 + 1


def _sets(column, size: int):
    """Slices: (first row, end row, shingle hashes in ascending order, first one of each text and the total, their hash as a set)."""
    for low, high, data, offsets in X.slices(pc.ascii_lower(X.plain(column))):
        start, end, first = X.words(data, offsets)
        s, cut = shingles(X.span_hashes(data, start, end), first, size)
        who = np.repeat(np.arange(high - low), np.diff(cut))
        order = np.lexsort((s, who))
        s, who = s[order], who[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (who[1:] != who[:-1])
        s, cut = s[new], np.searchsorted(who[new], np.arange(high - low + 1))
        yield low, high, s, cut, X.span_hashes(s, cut[:-1], cut[1:]).view(np.int64)


PARITIES = [f"p{k}" for k in range(PARITY)]


def parities(s: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One row of ``PARITY`` words for each set: the parity of its shingles by 8 bits of their hashes."""
    texts, bits = len(cut) - 1, 64 * PARITY
    place = np.repeat(np.arange(texts), np.diff(cut)) * bits + (X.mix(s) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(place, minlength=texts * bits).astype(np.uint8) & 1
    return np.packbits(odd).view("<i8").reshape(texts, PARITY)


def sketch(s: np.ndarray) -> bytes:
    """The parity of a set's shingles by hash: a power of two of bits, of which one stands for ``SHARE`` shingles at least, and 64 or more in all."""
    bits = max(64, 1 << max(1, len(s) // SHARE).bit_length() - 1)
    return np.packbits(np.bincount((X.mix(s) % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def sketched_apart(a: bytes, b: bytes) -> int:
    """In how many shingles the sets of two sketches differ at least; the longer one is folded, since a bit's place is a hash modulo their number."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)))).sum(dtype=np.int64))


def _named(docs: DataFrame, kind: T.DataType, size: int) -> DataFrame:
    """(id, n, node, parities, sketch) of every row; node is the hash of its set, null for an empty one."""
    names = ["n", "node", *PARITIES, "sketch"]

    def run(batches):
        for b in batches:
            for low, high, s, cut, node in _sets(b.column(1), size):
                n = np.diff(cut)
                bits = [pa.array(np.ascontiguousarray(c)) for c in parities(s, cut).T]
                bits.append(pa.array([sketch(s[a:z]) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), pa.array(n), pa.array(node, mask=n == 0), *bits], ["id", *names])

    return docs.mapInArrow(run, T.StructType([T.StructField("id", kind), *[T.StructField(c, T.LongType()) for c in names[:-1]], T.StructField("sketch", T.BinaryType())]))


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _counted(docs: DataFrame, size: int) -> np.ndarray:
    """Occurrences of shingles by bucket of their hash, over all texts."""
    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, s, _, _ in _sets(b.column(0), size):
                total += np.bincount(_bucket(s), minlength=BUCKETS)
        rows = total.reshape(-1, BLOCK)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([r.astype("<u4").tobytes() for r in rows[some]], pa.binary())], ["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, row in zip(b.column(0).to_pylist(), b.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(row.as_py(), "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in sums.values()], pa.binary())], ["block", "counts"])

    shape = "block long, counts binary"
    # A task adds as it reads, so that a block costs one row a task however many tasks there are.
    rows = docs.select("text").mapInArrow(count, shape).repartition("block").mapInArrow(add, shape).collect()
    out = np.zeros((BUCKETS // BLOCK, BLOCK), np.uint32)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["counts"], "<u4")
    return out.ravel()


def _short_lists(docs: DataFrame, size: int, percent: int, counts) -> DataFrame:
    """(node, n, token, at): the rarest shingles of every set, by rarity from 0, once in each task; tasks can share a set."""
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for _, _, s, cut, node in _sets(b.column(0), size):
                n = np.diff(cut)
                who = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((s, counts.value[_bucket(s)], who))
                at = np.arange(len(s)) - cut[who]
                new = np.array([k > 0 and not (x in seen or seen.add(x)) for x, k in zip(node.tolist(), n.tolist())], bool)
                keep = new[who] & (at < short(n, percent)[who])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[who][keep]), pa.array(n[who][keep]), pa.array(s[order][keep].view(np.int64)), pa.array(at[keep])], ["node", "n", "token", "at"])

    return docs.select("text").mapInArrow(run, "node long, n long, token long, at long")


def divide_skip(query: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[bool]:
    """Which of ``sets`` have the occurrences needed in the inverted lists of ``query``'s elements; all are ascending and distinct."""
    if not sets:
        return []
    want = [needed(len(query), len(s), percent) for s in sets]
    least = min(want)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")  # stable: every list ascends by set
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
    flat = flat[order]
    low, high = np.searchsorted(flat, query, "left"), np.searchsorted(flat, query, "right")
    by_length = np.argsort(high - low, kind="stable")
    longest = int(high[by_length[-1]] - low[by_length[-1]])
    aside = min(least - 1, int(least / (MU * log2(longest) + 1))) if longest else 0
    merge, probe = by_length[: len(query) - aside], np.sort(by_length[len(query) - aside :])
    seen = Counter(heapq.merge(*[owner[a:z].tolist() for a, z in zip(low[merge].tolist(), high[merge].tolist()) if z > a]))
    out = [False] * len(sets)
    for k, times in seen.items():
        if times >= want[k] - aside:
            at = np.searchsorted(sets[k], query[probe])
            there = at < len(sets[k])
            out[k] = times + int((sets[k][at[there]] == query[probe][there]).sum()) >= want[k]
    return out


def _hopeful(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sketches leave room for enough common shingles."""
    def run(batches):
        for b in batches:
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            room = n - 2 * (-(-percent * n // (100 + percent)))
            keep = [sketched_apart(x.as_py(), y.as_py()) <= r for x, y, r in zip(b.column(4), b.column(5), room.tolist())]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: known.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInArrow(run, "a long, b long")


def _searched(pairs: DataFrame, docs: DataFrame, known: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) of those pairs whose sets are similar enough; a is the query."""
    pairs = stored(_hopeful(pairs, known, percent), "pairs")
    wanted = stored(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
    small = pairs.count() <= SMALL
    marks = np.zeros(BITS, bool)
    marks[wanted.select(F.pmod("node", F.lit(BITS)).alias("k")).distinct().toArrow().column(0).to_numpy()] = True
    marks = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def once(batches):
        seen: set[int] = set()
        some = np.unpackbits(marks.value).view(bool)
        for b in batches:
            for _, _, s, cut, node in _sets(b.column(0), size):
                # Most sets that nobody asks for stop here; the join drops the others.
                asked = np.flatnonzero(some[node % BITS] & (np.diff(cut) > 0)).tolist()
                new = [k for k in asked if not (int(node[k]) in seen or seen.add(int(node[k])))]
                yield pa.RecordBatch.from_arrays([pa.array(node[new]), pa.array([s[cut[k] : cut[k + 1]].tobytes() for k in new], pa.binary())], ["node", "s"])

    def search(batches):
        for b in batches:
            a = b.column(0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(a, prepend=a[:1] - 1 if len(a) else None))
            keep = []
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(a)]):
                query = np.frombuffer(b.column(2)[lo].as_py(), np.uint64)
                for at in range(lo, hi, BATCH):
                    keep += divide_skip(query, [np.frombuffer(x.as_py(), np.uint64) for x in b.column(3).slice(at, min(BATCH, hi - at))], percent)
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = docs.select("text").mapInArrow(once, "node long, s binary").join(F.broadcast(wanted) if small else wanted, "node", "left_semi")
    sets = stored(sets.groupBy("node").agg(F.min("s").alias("s")), "sets")
    found = (F.broadcast(pairs) if small else pairs).join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    found = found.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").select("a", "b", "sa", "sb")
    return found.sortWithinPartitions("a").mapInArrow(search, "a long, b long")


def _fits(percent: int):
    """Whether the sizes and the parity bits of a pair (n, p0.., n2, q0..) leave room for enough common shingles."""
    least, most = F.least("n", "n2"), F.greatest("n", "n2")
    differ = sum(F.bit_count(F.col(p).bitwiseXOR(F.col(p.replace("p", "q")))) for p in PARITIES)
    return (100 * least >= percent * most) & (differ <= F.col("n") + F.col("n2") - 2 * _needed(percent))


def _needed(percent: int):
    return F.expr(f"({percent} * (n + n2) + {99 + percent}) div {100 + percent}")


def _members(lists: DataFrame) -> DataFrame:
    """(token, size, node, n, at, star, star_n) of the lists with two sets or more: each set once, star is the least one.

    Most lists hold one set. The lists move once, by shingle, and such end there.
    """
    whole = Window.partitionBy("token").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = lists.withColumns({"star": F.first("node").over(whole), "star_n": F.first("n").over(whole), "_last": F.last("node").over(whole), "size": F.count("*").over(whole)})
    return own.filter("star < _last").dropDuplicates(["token", "node"]).select("token", "size", "node", "n", "at", "star", "star_n")


def _links(spark: SparkSession, docs: DataFrame, named: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) of every set that is similar to another one; ``named`` has node, n, parities and sketch."""
    known = named.select("node", *PARITIES)
    other = known.select(F.col("node").alias("node2"), *[F.col(p).alias(p.replace("p", "q")) for p in PARITIES])
    counts = spark.sparkContext.broadcast(_counted(docs, size))
    members = stored(_members(_short_lists(docs, size, percent, counts)), "members")
    stars = members.filter((F.col("node") != F.col("star")) & (100 * F.least("n", "star_n") >= percent * F.greatest("n", "star_n"))).select(
        "node", "n", F.col("star").alias("node2"), F.col("star_n").alias("n2")).distinct()
    stars = stars.join(known, "node").join(other, "node2").filter(_fits(percent))
    stars = stored(stars.select(F.col("node2").alias("a"), F.col("node").alias("b")), "stars")
    edges = stored(_searched(stars, docs, named, size, percent), "edges")
    part = components(edges)
    open_ = members.filter("size > 2").select("token", "node", "n", "at").join(part, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = stored(open_, "open")
    mixed = open_.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("token")
    left = stored(open_.join(mixed, "token").join(known, "node"), "apart")
    right = left.select("token", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("root").alias("root2"),
                        *[F.col(p).alias(p.replace("p", "q")) for p in PARITIES])
    # At the first list that a pair shares, no more than the rest of either set can be common.
    room = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= _needed(percent)
    apart = (F.col("node") < F.col("node2")) & (F.col("root") != F.col("root2"))
    rest = left.join(right.withColumnRenamed("token", "token2"), (F.col("token") == F.col("token2")) & apart & room & _fits(percent))
    rest = rest.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    if rest.take(1):
        part = components(stored(edges.union(_searched(rest, docs, named, size, percent)), "edges"))
    return part


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row.

    A text is lower-cased in A to Z and cut into words; its set are the distinct
    runs of ``size`` words, or all its words if they are fewer.  Texts link if
    ``100 * common >= percent * union``.  component_id is the smallest id
    reachable over links, the row's own included.  A null or empty text and one
    without a word has no shingles and is alone.  Rows with a null id belong to
    the component of their text but never name it.  Equal rows give equal rows.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(_named(narrow, docs.schema[id_col].dataType, size), "names")
    known = stored(rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"), *[F.first(p).alias(p) for p in ("n", *PARITIES)], F.first("sketch").alias("sketch")), "known")
    found = _links(spark, narrow, known.select("node", "n", *PARITIES, "sketch"), size, percent)
    part = stored(known.select("node", "least").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    names = part.groupBy("root").agg(F.min("least").alias("component_id"))
    named = part.join(names, "root").select("node", "component_id")
    full = rows.filter("node is not null").join(named, "node").select("id", "n", "component_id")
    alone = rows.filter("node is null").select("id", "n", F.col("id").alias("component_id"))
    return full.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
