"""Operator 12: maximal periodic runs of words, found in tiles by period octave.

A run is a stretch in which words ``q`` apart are identical, at least
``max(LEAST, TIMES * q)`` words long, with smallest period ``q``.

Periods fall into octaves with a scale P: [1, 16) with P = 8, then [P, 2P).
Every run of an octave holds a multiple c of P from which P words repeat q words
later.  For all grid points c and periods q of the octave these P words are
compared by hash, n comparisons for n words and an octave.  Where they agree,
the Z-values at the boundary c say how far the repetition goes: the common
prefix of the words from c and from c + q, and the common suffix before both,
by bisection over hashes.  What is not primitive (the words from c to c + q
have a smaller period that divides q) belongs to an earlier octave and is
dropped; what is left is compared word by word.

A document of more than ``LONG`` words is exploded into overlapping tiles, each
of one octave: it owns the grid points of a stretch of at least 16 P words and
sees 4 P words on either side.  Tiles are dealt over all tasks and solved alone;
a run then comes out as intervals cut off at the borders of tiles.  Shuffled by
document and period, intervals that share a whole period are one run.
Documents up to that length are one tile of all octaves and are solved where
they are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecohort.llm import text as X
from wavecohort.llm.stored import stored

LEAST, TIMES = 24, 3
FIRST = 8  # scale of the first octave
LONG = 1 << 14  # words of the longest document that is one tile
TILE = 1 << 13  # words that a tile owns at least
CHUNK = 1 << 20  # comparisons at a time


def octave(k: int) -> tuple[int, int, int]:
    """(scale, first period, end of periods)."""
    scale = FIRST << k
    return scale, 1 if k == 0 else scale, 2 * scale


def _common(total, down, a, b, most, back: bool) -> np.ndarray:
    """Longest common extension of two positions, forward or back, at most ``most`` words."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        x, y = (a - mid, b - mid) if back else (a, b)
        same = (total[x + mid] - total[x]) * down[x] == (total[y + mid] - total[y]) * down[y]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _primitive(total, down, c, q) -> np.ndarray:
    """Whether the words from c to c + q are no power of shorter ones."""
    out = np.ones(len(c), bool)
    rest, p = q.copy(), 2
    while (rest > 1).any():
        if p * p > rest.max():  # only primes are left
            d = np.where(rest > 1, q // rest, q)
            rest = np.ones_like(rest)
        else:
            hit = rest % p == 0
            d = np.where(hit, q // p, q)
            while hit.any():
                rest = np.where(hit, rest // p, rest)
                hit = rest % p == 0
            p += 1
        x = (total[c + q - d] - total[c]) * down[c]
        y = (total[c + q] - total[c + d]) * down[c + d]
        out &= (d == q) | (x != y)
    return out


def solve(w: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray, end: np.ndarray, cut: np.ndarray, octaves) -> list[tuple]:
    """(tile, period, start, end) of the periodic stretches of some tiles, each as far as its tile shows it.

    ``w`` are 64-bit words; a tile sees [low, high) and owns the grid points in
    [own, end).  Stretches that are too short are given only where they end at a
    border inside the document: bit 1 of ``cut`` for the left, 2 for the right.
    """
    up, down = X.powers(X.BASE, len(w) + 1)
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * up[: len(w)], out=total[1:])
    found = set()
    for k in octaves:
        scale, first, last = octave(k)
        tiles = np.flatnonzero(high - low >= max(LEAST if k == 0 else 0, first + scale))
        if not len(tiles):
            break
        count = -(-(end[tiles] - own[tiles]) // scale)
        tile = np.repeat(tiles, count)
        c = own[tile] + scale * (np.arange(len(tile)) - np.repeat(np.cumsum(count) - count, count))
        inside = c + first + scale <= high[tile]
        tile, c = tile[inside], c[inside]
        grams = (total[scale:] - total[:-scale]) * down[: len(total) - scale]
        q = np.arange(first, last)
        step = max(1, CHUNK // len(q))
        for lo in range(0, len(c), step):
            at, of = c[lo : lo + step], tile[lo : lo + step]
            there = at[:, None] + q[None, :]
            ok = there + scale <= high[of][:, None]
            hit = (grams[np.minimum(there, len(grams) - 1)] == grams[at][:, None]) & ok
            row, col = np.nonzero(hit)
            if not len(row):
                continue
            x, t, p = at[row], of[row], q[col]
            keep = _primitive(total, down, x, p)
            x, t, p = x[keep], t[keep], p[keep]
            s = x - _common(total, down, x, x + p, x - low[t], True)
            e = x + p + _common(total, down, x, x + p, high[t] - x - p, False)
            clipped = ((s == low[t]) & (cut[t] & 1 > 0)) | ((e == high[t]) & (cut[t] & 2 > 0))
            keep = (e - s >= np.maximum(LEAST, TIMES * p)) | clipped
            found.update(zip(t[keep].tolist(), p[keep].tolist(), s[keep].tolist(), e[keep].tolist()))
    return sorted(f for f in found if np.array_equal(w[f[2] : f[3] - f[1]], w[f[2] + f[1] : f[3]]))


def octaves_of(n: int) -> range:
    """Octaves with a run in ``n`` words."""
    k = 0
    while n >= LEAST and TIMES * octave(k)[1] <= n:
        k += 1
    return range(k)


def joined(data, start, end, first, keep) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the kept words of each document, with one space between them.

    Words are separated by at least one white-space byte, which becomes the space.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[keep]
    start, end = start[keep], end[keep]
    inner = np.zeros(len(doc), bool)
    inner[:-1] = doc[1:] == doc[:-1]
    size = end - start + inner
    upto = np.cumsum(size)
    out = data[np.repeat(start - (upto - size), size) + np.arange(int(size.sum()))] if len(doc) else np.empty(0, np.uint8)
    out[upto[inner] - 1] = 32
    return out, np.append(0, np.cumsum(np.bincount(doc, weights=size, minlength=len(first) - 1))).astype(np.int64)


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    if offsets[-1] >= 1 << 31:
        return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())])


PIECES = "array<struct<period:bigint,start:bigint,end:bigint>>"
PIECE_TYPE = pa.list_(pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _first_pass(docs: DataFrame, kind: str, long: int) -> DataFrame:
    """(id, n, state, body, pieces): state 0 is done (body has its words joined), 1 has pieces, 2 is long; the body of these is the text."""
    def run(batches):
        for b in batches:
            texts = X.plain(b.column(1))
            for lo, hi, data, offsets in X.slices(texts):
                start, end, first = X.words(data, offsets)
                n = np.diff(first)
                h = X.span_hashes(data, start, end)
                short = np.flatnonzero((n <= long) & (n >= LEAST))
                a, z = first[short], first[short + 1]
                pieces = [[] for _ in range(hi - lo)]
                for t, p, s, e in solve(h, a, z, a, z, np.zeros(len(a), np.int64), octaves_of(int(n[short].max(initial=0)))):
                    d = int(short[t])
                    pieces[d].append({"period": p, "start": s - int(first[d]), "end": e - int(first[d])})
                state = np.where(n > long, 2, np.array([bool(p) for p in pieces], int))
                body = _strings(*joined(data, start, end, first, np.ones(len(start), bool)))
                own = texts.slice(lo, hi - lo)
                body = pa.compute.if_else(pa.array(state == 0), body, own.cast(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(state.astype(np.int32)), body, pa.array(pieces, PIECE_TYPE)],
                    ["id", "n", "state", "body", "pieces"])

    return docs.mapInArrow(run, f"id {kind}, n long, state int, body string, pieces {PIECES}")


def _tiles(long: DataFrame, tile: int) -> DataFrame:
    """Overlapping tiles of each octave: (uid, octave, low, high, own, end, n, words); words are numbered within a document."""
    names = ["uid", "octave", "low", "high", "own", "end", "n", "words"]

    def run(batches):
        for b in batches:
            for uid, text in zip(b.column(0).to_pylist(), b.column(1)):
                data, offsets = X.buffers(pa.array([text.as_py()]))
                start, end, _ = X.words(data, offsets)
                w = np.unique(X.span_hashes(data, start, end), return_inverse=True)[1].astype("<i4")
                n = len(w)
                for k in octaves_of(n):
                    scale = octave(k)[0]
                    size = max(tile, 16 * scale)
                    for own in range(0, n, size):
                        stop = min(n, own + size)
                        low, high = max(0, own - 4 * scale), min(n, stop + 4 * scale)
                        row = [uid, k, low, high, own, stop, n, w[low:high].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names)

    return long.select("uid", "body").mapInArrow(run, "uid long, octave long, low long, high long, own long, end long, n long, words binary")


def _solved(tiles: DataFrame) -> DataFrame:
    """(uid, period, start, end) of what every tile shows."""
    def run(batches):
        for b in batches:
            out = []
            for r in range(b.num_rows):
                uid, k, low, high, own, end, n, words = (b.column(i)[r].as_py() for i in range(8))
                w = X.mix(np.frombuffer(words, "<i4").astype(np.uint64) + np.uint64(1))
                one = lambda v: np.array([v])
                cut = one((low > 0) + 2 * (high < n))
                for _, p, s, e in solve(w, one(0), one(high - low), one(own - low), one(end - low), cut, [k]):
                    out.append((uid, p, s + low, e + low))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4,
                                             ["uid", "period", "start", "end"])

    return tiles.mapInArrow(run, "uid long, period long, start long, end long")


def stitched(pieces: DataFrame) -> DataFrame:
    """(uid, runs) from the (uid, period, start, end) of tiles: pieces of one period that share a whole period are one run."""
    order = Window.partitionBy("uid", "period").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > reach - F.col("period")), 1).otherwise(0)
    runs = pieces.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order)).groupBy("uid", "period", "_run").agg(
        F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    runs = runs.filter(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    return runs.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def _collapsed(rows: DataFrame, kind: str) -> DataFrame:
    """(id, n, runs, body) with the words of ``body`` that no run repeats."""
    def run(batches):
        for b in batches:
            texts, runs = X.plain(b.column(3)), b.column(2)
            for lo, hi, data, offsets in X.slices(texts):
                start, end, first = X.words(data, offsets)
                gone = np.zeros(len(start) + 1, np.int64)
                for d in range(hi - lo):
                    for r in runs[lo + d].as_py() or ():
                        gone[first[d] + r["start"] + r["period"]] += 1
                        gone[first[d] + r["start"] + r["length"]] -= 1
                body = _strings(*joined(data, start, end, first, np.cumsum(gone)[:-1] == 0))
                yield pa.RecordBatch.from_arrays([b.column(i).slice(lo, hi - lo) for i in range(3)] + [body], ["id", "n", "runs", "body"])

    return rows.mapInArrow(run, f"id {kind}, n long, runs {RUNS}, body string")


RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text", long: int = LONG, tile: int = TILE) -> DataFrame:
    """(id_col, n_words, runs, text) of every row.

    runs is an array of (start, period, length) in words from 0, by start and
    period; text has the words, joined by one space, without those that lie in
    a run after its first period.  A null, empty or blank text has no words, no
    runs and the text ''.  Repeated rows and null ids are rows like any other.
    An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    body = F.col(text_col) if isinstance(text_col, str) else text_col
    rows = _first_pass(docs.select(F.col(id_col).alias("id"), body.cast("string").alias("text")), kind, long)
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "passed")
    small = rows.filter("state = 1").select("uid", F.explode("pieces").alias("p")).select("uid", "p.period", "p.start", "p.end")
    large = _solved(_tiles(rows.filter("state = 2"), tile).repartition("uid", "octave", "own"))
    runs = stored(stitched(small.union(large)), "runs")
    none = F.array().cast(RUNS)
    open_ = rows.filter("state > 0").join(runs, "uid", "left").select("id", "n", F.coalesce("runs", none).alias("runs"), "body")
    done = rows.filter("state = 0").select("id", "n", none.alias("runs"), "body").union(_collapsed(open_, kind))
    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), "runs", F.col("body").alias("text"))
