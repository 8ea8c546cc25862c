"""Operator 1: substring deduplication by recompression.

Every document is a string of words, and rounds replace it by shorter strings
of symbols: a round names maximal runs of one symbol, then pairs of a *left*
and a *right* symbol, where one bit of a symbol's name tells its side.  A name
is a hash of what it stands for, so all tasks give one name to one content and
no dictionary has to be shuffled.  Equal substrings get the same symbols except
near their ends; each symbol carries the exact span of words on which its being
there depends, so it is known which symbols of a window any equal window has
too.

1. Symbols of the last round are counted over the corpus.  A window that holds
   (with its dependency) a symbol found in one text only is not repeated.
   Windows without such a symbol are candidates, those without any symbol of
   their own included: nothing is missed, whatever the text looks like.
2. Candidates are verified by a 128-bit hash of all their words, grouped with
   map-side aggregation to the smallest document.
3. Words covered by a window that also starts in a smaller document are removed.

Equal texts count as one in step 1 and 2: later copies take no part there and
are removed as a whole if they have a window at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.llm import text as X
from wavecohort.llm.stored import stored

WINDOW = 50
ROUNDS = 7
SHORTEST = 4  # words that a symbol must stand for to be counted


# --- parsing ---------------------------------------------------------------------------


class Symbols:
    """Symbols of some documents in a row: names, spans of words and spans they depend on."""

    def __init__(self, h: np.ndarray, first: np.ndarray):
        n = len(h)
        self.words = h
        self.doc = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        self.name = h
        self.start = np.arange(n, dtype=np.int32)
        self.end = self.start + 1
        self.low, self.high = self.start.copy(), self.end.copy()

    def _joints(self) -> np.ndarray:
        """For each symbol but the last: the next one is in the same document."""
        return self.doc[self.start[1:]] == self.doc[self.start[:-1]]

    def _merge(self, head: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Keep the symbols at ``head``, each up to the next head, with new names; dependencies by group."""
        last = np.append(head[1:], len(self.name)) - 1
        self.low, self.high = np.minimum.reduceat(low, head), np.maximum.reduceat(high, head)
        self.start, self.end = self.start[head], self.end[last]
        self.name = name

    def runs(self) -> None:
        """Name maximal runs of one symbol."""
        if len(self.name) < 2:
            return
        joint = self._joints()
        same = (self.name[1:] == self.name[:-1]) & joint
        head = np.flatnonzero(np.append(True, ~same))
        # A boundary holds wherever the words next to it differ from those of the neighbour; else it depends on the neighbour.
        low, high = self.low.copy(), self.high.copy()
        w = self.words
        gap = joint & ~same
        left = np.flatnonzero(gap) + 1  # symbols with a neighbour before them
        clear = w[self.start[left] - 1] != w[self.end[left] - 1]
        low[left] = np.minimum(low[left], np.where(clear, self.start[left] - 1, self.low[left - 1]))
        right = left - 1
        clear = w[self.end[right]] != w[self.start[right]]
        high[right] = np.maximum(high[right], np.where(clear, self.end[right] + 1, self.high[right + 1]))
        # At the ends of a document there is no neighbour: such a boundary is not seen inside an equal window elsewhere.
        self._ends(low, high, joint, np.ones(len(self.name), bool), np.ones(len(self.name), bool))
        count = np.diff(np.append(head, len(self.name))).astype(np.uint64)
        name = self.name[head]
        name = np.where(count > 1, X.mix(name * np.uint64(X.BASE) + count), name)
        self._merge(head, name, low, high)

    def _ends(self, low, high, joint, need_left, need_right) -> None:
        """Mark dependencies beyond a document's ends by one word, which no window can hold."""
        lead = np.append(True, ~joint) & need_left
        tail = np.append(~joint, True) & need_right
        low[lead] = np.minimum(low[lead], self.start[lead] - 1)
        high[tail] = np.maximum(high[tail], self.end[tail] + 1)

    def pairs(self, round_: int) -> None:
        """Name pairs of a left and a right symbol."""
        if len(self.name) < 2:
            return
        joint = self._joints()
        right = (X.mix(self.name ^ np.uint64((round_ + 1) * X.BASE2 % (1 << 64))) & np.uint64(1)).astype(bool)
        pair = joint & ~right[:-1] & right[1:]
        head = np.flatnonzero(np.append(True, ~pair))
        low, high = self.low.copy(), self.high.copy()
        # A left symbol needs no look before it and a right symbol none after it.
        at = np.flatnonzero(joint & right[1:] & right[:-1]) + 1
        low[at] = np.minimum(low[at], self.low[at - 1])
        at = np.flatnonzero(joint & ~right[1:] & ~right[:-1])
        high[at] = np.maximum(high[at], self.high[at + 1])
        self._ends(low, high, joint, right, ~right)
        name = self.name[head]
        two = np.flatnonzero(pair)  # positions of left symbols
        place = np.searchsorted(head, two)
        name[place] = X.mix(name[place] * np.uint64(X.BASE) + X.mix(self.name[two + 1] ^ np.uint64(X.BASE2)))
        self._merge(head, name, low, high)


def parse(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS, shortest: int = SHORTEST) -> Symbols:
    """Symbols of the last round that stand for ``shortest`` words or more."""
    s = Symbols(h, first)
    for k in range(rounds):
        s.runs()
        s.pairs(k)
    keep = s.end - s.start >= shortest
    s.name, s.start, s.end, s.low, s.high = (v[keep] for v in (s.name, s.start, s.end, s.low, s.high))
    return s


def window_hashes(h: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the windows that start at ``at``."""
    return (X.span_hashes(h, at, at + size), X.span_hashes(X.mix(h ^ np.uint64(X.BASE2)), at, at + size, X.BASE2))


def _documents(column):
    """(row, words of the row) slices: (first row, bytes, word starts, word ends, first word of each row)."""
    for low, _, data, offsets in X.slices(X.plain(column)):
        yield low, data, *X.words(data, offsets)


# --- Spark -----------------------------------------------------------------------------


def _symbol_table(docs: DataFrame, kind: str, window: int) -> DataFrame:
    """(id, h1, h2, n_words, names): hash of the text's words and its distinct symbol names; names only where a window fits."""
    def run(batches):
        for b in batches:
            for low, data, start, end, first in _documents(b.column(1)):
                h = X.span_hashes(data, start, end)
                a, z = first[:-1], first[1:]
                t1, t2 = X.span_hashes(h, a, z), X.span_hashes(X.mix(h ^ np.uint64(X.BASE2)), a, z, X.BASE2)
                s = parse(h, first)
                doc = s.doc[s.start] if len(s.start) else np.zeros(0, np.int32)
                ok = ((z - a) >= window)[doc] & (s.high - s.low <= window)
                pair = np.unique(np.stack([doc[ok].astype(np.uint64), s.name[ok]], axis=1), axis=0) if ok.any() else np.zeros((0, 2), np.uint64)
                cut = np.searchsorted(pair[:, 0], np.arange(len(first), dtype=np.uint64)).astype(np.int32)
                names = pa.ListArray.from_arrays(pa.array(cut), pa.array(pair[:, 1].copy().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(low, len(a)), pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64)), pa.array((z - a).astype(np.int64)), names],
                    ["id", "h1", "h2", "n_words", "names"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, h1 long, h2 long, n_words long, names array<long>")


def _candidates(docs: DataFrame, kind: str, window: int) -> DataFrame:
    """(id, text, copy, w1, w2): hashes of the distinct windows that may be repeated; a null ``shared`` marks a copy."""
    def run(batches):
        for b in batches:
            shared = b.column(2)
            for low, data, start, end, first in _documents(b.column(1)):
                h = X.span_hashes(data, start, end)
                n = len(first) - 1
                mine = shared.slice(low, n)
                own_names = mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                own_doc = np.repeat(np.arange(n), pc.list_value_length(mine).fill_null(0).to_numpy(zero_copy_only=False))
                skip = mine.is_null().to_numpy(zero_copy_only=False)
                s = parse(h, first)
                local = np.flatnonzero(s.high - s.low <= window)
                doc = s.doc[s.start[local]].astype(np.int64) if len(local) else np.zeros(0, np.int64)
                # A symbol that no other text has rules out every window that holds it.
                known = np.isin(_tag(doc, s.name[local]), _tag(own_doc, own_names))
                only = local[~known]
                out = np.zeros(len(h) + 1, np.int32)
                np.add.at(out, np.maximum(s.high[only] - window, 0), 1)
                np.add.at(out, s.low[only] + 1, -1)
                ruled = np.cumsum(out)[: len(h)] > 0
                at = X.window_starts(first, window)
                who = np.searchsorted(first, at, "right") - 1
                keep = ~ruled[at] & ~skip[who]
                at, who = at[keep], who[keep]
                w1, w2 = window_hashes(h, at, window)
                order = np.lexsort((w2, w1, who))
                at, who, w1, w2 = at[order], who[order], w1[order], w2[order]
                new = np.ones(len(at), bool)
                new[1:] = (who[1:] != who[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
                who, w1, w2 = who[new], w1[new], w2[new]
                cut = pa.array(np.searchsorted(who, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(low, n), b.column(1).slice(low, n), mine.is_null(),
                     pa.ListArray.from_arrays(cut, pa.array(w1.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(w2.view(np.int64)))],
                    ["id", "text", "copy", "w1", "w2"])

    return docs.select("id", "text", "shared").mapInArrow(run, f"id {kind}, text string, copy boolean, w1 array<long>, w2 array<long>")


def _tag(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    """One value for a name in a document."""
    return X.mix(name + doc.astype(np.uint64) * np.uint64(X.BASE))


def covered(n: int, at: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words are in a window that starts at ``at``."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + window, -1)
    return np.cumsum(mark)[:n] > 0


def _kept(rows: DataFrame, kind: str, window: int) -> DataFrame:
    """(id, n_words, n_removed, kept) from (id, text, copy, gone): gone holds first hash halves of windows to remove."""
    def run(batches):
        for b in batches:
            for low, data, start, end, first in _documents(b.column(1)):
                n = len(first) - 1
                copy = b.column(2).slice(low, n).to_numpy(zero_copy_only=False)
                gone = b.column(3).slice(low, n)
                marked = np.flatnonzero(pc.list_value_length(gone).fill_null(0).to_numpy(zero_copy_only=False) > 0)
                h = X.span_hashes(data, start, end) if len(marked) else None
                whole, removed, kept = data.tobytes(), np.zeros(n, np.int64), []
                size = np.diff(first)
                mark = {int(d): None for d in marked}
                for d in mark:
                    own = h[first[d] : first[d + 1]]
                    at = np.arange(len(own) - window + 1)
                    hit = np.isin(window_hashes(own, at, window)[0].view(np.int64), np.array(gone[d].as_py(), np.int64))
                    mark[d] = covered(len(own), at[hit], window)
                for d in range(n):
                    i, z = first[d], first[d + 1]
                    if copy[d] and size[d] >= window:
                        removed[d] = size[d]
                        kept.append(b"")
                    elif d in mark:
                        removed[d] = mark[d].sum()
                        at = np.flatnonzero(~mark[d]) + i
                        kept.append(b" ".join([whole[x:y] for x, y in zip(start[at].tolist(), end[at].tolist())]))
                    else:
                        kept.append(b" ".join(whole[start[i] : end[z - 1]].split()) if z > i else b"")
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(low, n), pa.array(size.astype(np.int64)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "n_removed", "kept"])

    return rows.select("id", "text", "copy", "gone").mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, n_words, n_removed, kept) for every row: the words left over, joined by one space.

    A word is removed where a window of ``window`` words over it also starts in
    a document with a smaller id; all windows are judged on the input.  A null
    text has no words and keeps ''.  Shorter texts have no window and stay.  Rows
    of one id never remove from each other; rows with a null id are neither
    source nor changed.  An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    symbols = stored(_symbol_table(rows.filter("id is not null"), kind, window), "symbols")
    found = symbols.select("id", "h1", F.explode("names").alias("name"))
    shared = found.groupBy("name").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a < b").select("name")
    first = symbols.groupBy("h1", "h2").agg(F.min("id").alias("least"))
    # Per id: the hashes of its texts that no smaller id has, and its names that other texts have too.
    names = found.join(shared, "name").groupBy("id").agg(F.collect_set("name").alias("shared"))
    origin = symbols.select("id", "h1", "h2").distinct().join(first, ["h1", "h2"])
    copies = origin.groupBy("id").agg(F.max(F.col("id") == F.col("least")).alias("origin"))
    plan = stored(copies.join(names, "id", "left").select(
        "id", F.when(F.col("origin"), F.coalesce("shared", F.array().cast("array<bigint>"))).alias("shared")), "shared")
    table = stored(_candidates(rows.filter("id is not null").join(plan, "id"), kind, window), "candidates")
    windows = table.select("id", F.explode(F.arrays_zip("w1", "w2")).alias("w")).select("id", "w.w1", "w.w2")
    least = windows.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").drop("most")
    gone = stored(windows.join(least, ["w1", "w2"]).filter("id > least").groupBy("id").agg(F.collect_set("w1").alias("gone")), "repeats")
    touched = F.size("w1") > 0
    plain = table.filter(~touched).select("id", "text", "copy", F.lit(None).cast("array<bigint>").alias("gone"))
    changed = table.filter(touched).select("id", "text", "copy").join(gone, "id", "left")
    nameless = rows.filter("id is null").select("id", "text", F.lit(False).alias("copy"), F.lit(None).cast("array<bigint>").alias("gone"))
    out = _kept(plain.unionByName(changed).unionByName(nameless), kind, window)
    return out.withColumnRenamed("id", id_col)
