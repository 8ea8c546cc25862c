"""Operator 9: document fingerprints as threshold-scaled sketches.

A sketch keeps every 64-bit shingle hash below a fixed fraction of the range,
and nothing else decides what is kept.  Sketches of parts therefore merge by
union into the sketch of the whole, and the share of one sketch found in
another estimates containment, however unequal the documents are.  A text in
which no hash is below the threshold keeps its smallest one, so that every text
with a word has something to be compared by.

The text that follows in ascending id is needed for the edited texts.  It comes
with one range shuffle: documents are cut into ranges of ids, the first
document of each range goes to the range before as well, and every range is
read in order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.llm import text as X

SHINGLE = 5
FRACTION = 8  # one hash in so many is kept
ROWS = 128  # texts handled at a time


def sketch(h: np.ndarray, first: np.ndarray, size: int = SHINGLE, fraction: int = FRACTION) -> list[np.ndarray]:
    """Sorted distinct hashes kept of each document, from its word hashes."""
    at = X.window_starts(first, size)
    who = np.searchsorted(first, at, "right") - 1
    short = np.flatnonzero((np.diff(first) < size) & (np.diff(first) > 0))
    s = np.concatenate([X.span_hashes(h, at, at + size), X.span_hashes(h, first[short], first[short + 1])])
    who = np.concatenate([who, short])
    least = np.full(len(first) - 1, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, who, s)
    keep = (s < np.uint64((1 << 64) // fraction)) | (s == least[who])
    s, who = s[keep], who[keep]
    order = np.lexsort((s, who))
    s, who = s[order], who[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (who[1:] != who[:-1])
    s, who = s[new], who[new]
    # A smallest hash above the threshold stands alone, so nothing else has to be dropped.
    cut = np.searchsorted(who, np.arange(len(first)))
    return [s[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def sketches_of(texts: list[bytes], size: int = SHINGLE, fraction: int = FRACTION) -> list[np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    start, end, first = X.words(data, offsets)
    return sketch(X.span_hashes(data, start, end), first, size, fraction)


def merge(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """Sketch of two texts together (their shingles united)."""
    both = np.union1d(a, b)
    low = both[both < np.uint64((1 << 64) // fraction)]
    return low if len(low) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 if ``a`` has none."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among all of both (Jaccard); two texts without words are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - both
    return both / total if total else 1.0


def text_of(s: np.ndarray) -> str:
    """Hashes in ascending order, 16 hexadecimal digits each."""
    return s.astype(">u8").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                 fraction: int = FRACTION) -> DataFrame:
    """(id_col, sketch array<long>) of every row: the general form of the operator, one scan without a shuffle.

    Null and empty texts, and texts without a word, have an empty sketch.
    Hashes are unsigned; as longs, large ones are negative.
    """
    def run(batches):
        for b in batches:
            for low, high, data, offsets in X.slices(X.plain(b.column(1))):
                start, end, first = X.words(data, offsets)
                found = sketch(X.span_hashes(data, start, end), first, size, fraction)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))],
                    [id_col, "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, sketch array<long>")


def edited(own: str, following: str) -> str:
    """``own`` with its last half replaced by the first as many code points of ``following``."""
    n = len(own) // 2
    return own[: len(own) - n] + following[:n] if n else own


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
             fraction: int = FRACTION) -> DataFrame:
    """Sketches of every text, of its edited text, and their likeness; see ``edited``.

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  The next document is that of the next row in
    ascending (id, text), after the last the first; rows of one id follow each
    other, null ids come first.  A null text is empty.  A single row is followed
    by itself.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = [k / ranges for k in range(1, ranges)]
    cuts = rows.select("id").filter("id is not null").approxQuantile("id", steps, 0.1 / ranges) if steps else []
    at = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    ranged = rows.select(F.coalesce(F.size(F.filter(at, lambda c: c <= F.col("id"))), F.lit(0)).alias("r"), F.col("id").isNotNull().alias("known"), "id", "t")
    # One row for each range: its first id, and the range before, which needs that document too.
    firsts = sorted(ranged.groupBy("r").agg(F.min(F.struct("known", "id")).alias("f")).collect(), key=lambda x: x["r"])
    if not firsts:
        return spark.createDataFrame([], _compared_schema(id_col, kind))
    leads = spark.createDataFrame(
        [(x["r"], x["f"]["id"], firsts[k - 1]["r"]) for k, x in enumerate(firsts)], f"r int, id {kind}, before int")
    wanted = F.col("id").isin([x["f"]["id"] for x in firsts if x["f"]["known"]])
    if not firsts[0]["f"]["known"]:
        wanted = wanted | F.col("id").isNull()
    marks = ranged.filter(wanted).alias("a").join(leads.alias("b"), (F.col("a.r") == F.col("b.r")) & F.col("a.id").eqNullSafe(F.col("b.id")))
    marks = marks.groupBy("b.before").agg(F.min("a.t").alias("t")).select(
        F.col("before").alias("r"), F.lit(True).alias("mark"), F.lit(True).alias("known"), F.lit(None).cast(kind).alias("id"), "t")
    stream = ranged.withColumn("mark", F.lit(False)).unionByName(marks)
    ordered = stream.repartition("r").sortWithinPartitions("r", "mark", "known", "id", "t").select("mark", "id", "t")

    def run(batches):
        held = None  # (mark, id, text, sketch) of the row that waits for its next one
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                marks, ids, texts = (part.column(k).to_pylist() for k in range(3))
                sketches = sketches_of([t.encode() for t in texts], size, fraction)
                line = ([held] if held else []) + list(zip(marks, ids, texts, sketches))
                held = line[-1]
                pairs = [(x, y) for x, y in zip(line, line[1:]) if not x[0]]
                changed = [edited(x[2], y[2]).encode() for x, y in pairs]
                found = sketches_of(changed, size, fraction)
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[1] for x, _ in pairs], b.column(1).type), pa.array([len(x[2]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
                    pa.array([text_of(x[3]) for x, _ in pairs], pa.string()), pa.array([text_of(s) for s in found], pa.string()),
                    pa.array([likeness(x[3], s) for (x, _), s in zip(pairs, found)], pa.float64()),
                    pa.array([likeness(x[3], y[3]) for x, y in pairs], pa.float64()),
                ], [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(run, _compared_schema(id_col, kind))


def _compared_schema(id_col: str, kind: str) -> str:
    return (f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")
