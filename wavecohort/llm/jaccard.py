"""Near copies of the corpus pipeline: Jaccard similarity of five-word shingles, verified.

Candidates come from two sources.  The trie join of SimHash fingerprints
(``simhash``, here of five-word shingles) finds the copies within four bits.
It cannot find all: at a similarity of 0.8 about ten bits
differ, and a trie join with that budget visits nearly all pairs.  Candidates
are therefore also texts with one band of minimum hashes in common.  A pair at
similarity s shares none of ``BANDS`` bands with probability
(1 - s^ROWS)^BANDS: 7e-5 at 0.8, less above.  Every candidate is verified on
the whole shingle sets, and components follow in Spark.

No band emits all pairs of its texts.  Each text first meets the star of its
band, which differs from band to band; what verifies is connected.  Then texts
of one band are compared in blocks, only if they are in different components
still, and only pairs that could be similar leave the task: texts carry the
parities of their shingle set by hash, and two sets differ by at least as many
shingles as parities.  Equal results follow, since a pair inside one component
changes nothing and the bound drops no similar pair.
Texts with equal words are one text from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecohort.llm import simhash
from wavecohort.llm import text as X
from wavecohort.llm.components import components
from wavecohort.llm.simhash import fingerprint
from wavecohort.llm.stored import scratch, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
WORDS = 16  # longs of parities of a text
MEMBERS = 2048  # texts of a band in one block
PAIRS = 128  # pairs whose shingles are held at a time
FACTORS = X.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(h: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first hash of each text and the total) of ``size`` words each; a shorter text is one shingle."""
    at = X.window_starts(first, size)
    n = np.diff(first)
    short = np.flatnonzero((n < size) & (n > 0))
    s = np.concatenate([X.span_hashes(h, at, at + size), X.span_hashes(h, first[short], first[short + 1])])
    who = np.concatenate([np.searchsorted(first, at, "right") - 1, short])
    order = np.argsort(who, kind="stable")
    return s[order], np.searchsorted(who[order], np.arange(len(first)))


def bands(s: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One row of ``BANDS`` keys for each text that has a shingle."""
    low = cut[:-1][np.diff(cut) > 0]
    keys = np.zeros((len(low), BANDS), np.uint64)
    if len(low):
        for k, factor in enumerate(FACTORS):
            least = np.minimum.reduceat(s * factor, low)
            keys[:, k // ROWS] = X.mix(keys[:, k // ROWS] + least + np.uint64(k))
    return keys


def parities(s: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, parities of their number by hash as ``WORDS`` longs) of each text that has a shingle."""
    sizes = np.diff(cut)
    who = np.repeat(np.arange((sizes > 0).sum()), sizes[sizes > 0])
    order = np.lexsort((s, who))
    s, who = s[order], who[order]
    first = np.append(True, (s[1:] != s[:-1]) | (who[1:] != who[:-1]))[:len(s)]
    s, who = X.mix(s[first]), who[first]
    bits = np.zeros((int((sizes > 0).sum()), WORDS), np.uint64)
    np.bitwise_xor.at(bits, (who, ((s >> np.uint64(6)) % np.uint64(WORDS)).astype(np.int64)), np.uint64(1) << (s & np.uint64(63)))
    return np.bincount(who, minlength=len(bits)), bits


def most_apart(size, similarity: float):
    """Shingles in which two sets of ``size`` together may differ at most; for numbers and columns."""
    return size * ((1 - similarity) / (1 + similarity)) + 1e-6


def _texts(column):
    """Slices of a column in lower case: (first row, end row, word hashes, first word of each text and the total)."""
    for low, high, data, offsets in X.slices(pc.utf8_lower(X.plain(column))):
        start, end, first = X.words(data, offsets)
        yield low, high, X.span_hashes(data, start, end), first


def _names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of all words of each text; 0 without words."""
    return np.where(np.diff(first) > 0, X.span_hashes(h, first[:-1], first[1:]), np.uint64(0)).view(np.int64)


def named(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and fp (long, the hash of the words) of every row; null texts count as empty."""
    def run(batches):
        for b in batches:
            fp = [np.empty(0, np.int64), *(_names(h, first) for _, _, h, first in _texts(b.column(b.num_columns - 1)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(fp))], [*keep, "fp"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(X.trimmed(run), schema)


def banded(docs: DataFrame, text_col: str) -> DataFrame:
    """(fp, keys array<long>, n, bits array<long>) of every text with a word, once in each task."""
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for _, _, h, first in _texts(b.column(0)):
                fp = _names(h, first)[np.diff(first) > 0]
                found = shingles(h, first)
                keys, (n, bits) = bands(*found).view(np.int64), parities(*found)
                new = [k for k, x in enumerate(fp.tolist()) if not (x in seen or seen.add(x))]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1, dtype=np.int32) * v.shape[1]), pa.array(v[new].ravel()))
                         for v in (keys, bits.view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(fp[new]), lists[0], pa.array(n[new]), lists[1]], ["fp", "keys", "n", "bits"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(X.trimmed(run), "fp long, keys array<long>, n long, bits array<long>")


def possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) that the parities of both do not rule out."""
    side = lambda c: sketches.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    apart = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, v: t + v)
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(apart <= most_apart(F.col("na") + F.col("nb"), similarity)).select("a", "b")


def met_in_blocks(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b, of texts with a key in common and different roots that the parities do not rule out.

    ``members``: key, size (texts with the key, at least), fp, root, n, bits.  A key with more than ``MEMBERS``
    texts is cut into parts by hash, and every two of its parts meet in a task of their own.
    """
    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        fp, root, n, part = (table.column(c).to_numpy() for c in ("fp", "root", "n", "part"))
        bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(fp), -1)
        low, high = key[1].as_py(), key[2].as_py()
        own, other = np.flatnonzero(part == low), np.flatnonzero(part == high)
        for k in own.tolist():
            rest = other[(root[other] != root[k]) & ((fp[other] > fp[k]) if low == high else True)]
            apart = np.bitwise_count(bits[rest] ^ bits[k]).sum(1, dtype=np.int64)
            near = fp[rest[apart <= most_apart(n[rest] + n[k], similarity)]]
            if len(near):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(near, fp[k])), pa.array(np.maximum(near, fp[k]))], ["a", "b"])

    parts = F.ceil(F.col("size") / MEMBERS).cast("int")
    placed = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "fp", "root", "n", "bits", "part")
    return cells.groupBy("key", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def _sets(texts) -> list[np.ndarray]:
    out = []
    for _, _, h, first in _texts(texts):
        s, cut = shingles(h, first)
        out += [np.unique(s[a:z]) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]
    return out


def verified(pairs: DataFrame, docs: DataFrame, text_col: str, similarity: float) -> DataFrame:
    """(a, b) of those pairs whose shingle sets are similar enough; whole texts are compared."""
    def once(batches):
        seen: set[int] = set()
        for b in batches:
            for low, high, h, first in _texts(b.column(0)):
                fp = _names(h, first)
                new = [k for k, x in enumerate(fp.tolist()) if not (x in seen or seen.add(x))]
                yield pa.RecordBatch.from_arrays([pa.array(fp[new]), b.column(0).slice(low, high - low).take(pa.array(new, pa.int64()))], ["n", "t"])

    def verify(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                b = batch.slice(at, PAIRS)
                keep = []
                for x, y in zip(_sets(b.column(2)), _sets(b.column(3))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
                yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("n")).union(pairs.select(F.col("b").alias("n"))).distinct()
    texts = docs.select(F.col(text_col).cast("string")).mapInArrow(X.trimmed(once), "n long, t string").join(wanted, "n", "left_semi")
    texts = stored(texts.groupBy("n").agg(F.min("t").alias("t")), "texts")
    both = pairs.join(texts.select(F.col("n").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("n").alias("b"), F.col("t").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(X.trimmed(verify), "a long, b long")


def trie_pairs(docs: DataFrame, text_col: str) -> DataFrame:
    """(a, b) of texts (by the hash of their words) whose fingerprints the trie join links; equal fingerprints are linked to the least text."""
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            column = X.plain(b.column(0))
            for low, _, h, first in _texts(column):
                nodes = _names(h, first).tolist()
                new = [k for k, x in enumerate(nodes) if x and not (x in seen or seen.add(x))]
                fp = np.array([fingerprint(column[low + k].as_buffer().to_pybytes(), SHINGLE) for k in new], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in new], pa.int64()), pa.array(fp.view(np.int64))], ["node", "fp"])

    marked = docs.select(F.col(text_col).cast("string")).mapInArrow(X.trimmed(run), "node long, fp long")
    marked = stored(marked.distinct(), "marked")
    known = stored(marked.groupBy("fp").agg(F.min("node").alias("least")), "marks")
    top = max(4, int(np.ceil(np.log2(max(1, known.count()) / simhash.LEAVES))))
    same = marked.join(known, "fp").filter("node != least").select("node", "least")
    met = simhash.links(known, top)
    met = met.join(known.toDF("a", "na"), "a").join(known.toDF("b", "nb"), "b").select("na", "nb")
    pairs = same.union(met).toDF("a", "b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of every text (by the hash of its words) that is similar to another one."""
    sketches = stored(banded(docs, text_col).dropDuplicates(["fp"]), "bands")
    keyed = sketches.select("fp", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.min_by("fp", F.xxhash64("fp", "key")).alias("star"), F.count("*").alias("size")).filter("size > 1")
    members = stored(keyed.join(met, "key"), "members")
    stars = members.filter("fp != star").select(F.least("fp", "star").alias("a"), F.greatest("fp", "star").alias("b")).distinct()
    stars = stored(stars.union(trie_pairs(docs, text_col)).distinct(), "stars")
    hopeful = stored(possible(stars, sketches, similarity), "hopeful")
    edges = stored(verified(hopeful, docs, text_col, similarity), "edges")
    part = components(edges)
    open_ = members.filter("size > 2").select("key", "size", "fp").join(part.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    open_ = stored(open_, "open")
    mixed = open_.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("key")
    left = open_.join(mixed, "key").join(sketches.select("fp", "n", "bits"), "fp")
    rest = stored(met_in_blocks(left, similarity).join(stars, ["a", "b"], "left_anti"), "rest")
    if rest.take(1):
        part = components(stored(edges.union(verified(rest, docs, text_col, similarity)), "edges"))
    return part


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group of near copies, all columns unchanged; see ``simhash.one_of_each``.

    Texts without a word, null ones included, are copies of each other.
    """
    with scratch(docs.sparkSession):
        rows = stored(named(docs, [id_col], text_col), "names")
        known = stored(rows.groupBy("fp").agg(F.min(id_col).alias("_least")), "distinct")
        ids, nameless = simhash.chosen(rows, simhash.rooted(known, links(docs, text_col, similarity)), id_col)
    return simhash.one_of_each(docs, ids, nameless, named, id_col, text_col)
