"""Operator 6: benchmark decontamination with spaced seeds.

Tokens are runs of letters and digits (any byte beyond ASCII counts as a
letter) of the lower-cased text.  A mask keeps some positions of a token window
and ignores the others; windows of test and training text with equal kept
tokens meet by hash, whatever stands at the ignored positions.  Every meeting
point names a diagonal (document, item, shift), along which all tokens of the
item are compared: a document contains an item where some ``WINDOW`` aligned
tokens agree in at least ``LEAST`` places.

The two masks hit every window of 13 tokens with at most two substitutions
(tests/llm checks all cases), so nothing that the rule names is missed.  Items
of 5 to 12 tokens are found as a whole, without substitutions; shorter ones
identify nothing and are never reported.

The benchmark is the stated query set: it is taken in blocks of bounded size,
each shipped to all tasks, and every block is held against all documents in one
scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.llm import text as X

WINDOW, LEAST = 13, 11
MASKS = ("1110111", "1101001011")
SHORTEST = 5
BLOCK_TOKENS = 1_000_000
FILTER_BITS = 22
LINES = 1 << 14  # diagonals compared at a time


def _letters() -> np.ndarray:
    ok = np.zeros(256, bool)
    ok[48:58] = ok[65:91] = ok[97:123] = ok[128:] = True
    return ok


LETTER = _letters()


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, first token of each row and the total) of slices of a string column."""
    for low, _, data, offsets in X.slices(pc.utf8_lower(X.plain(column))):
        start, end, first = X.runs(LETTER[data], offsets)
        yield low, X.span_hashes(data, start, end), first


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the kept tokens of the window at every position that has room for it."""
    n = len(h) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), np.uint64)
    for k, keep in enumerate(mask):
        if keep == "1" and n > 0:
            out = out * np.uint64(X.BASE) + h[k : k + n]
    return X.mix(out)


class Block:
    """Seeds and tokens of some benchmark items."""

    def __init__(self, items: list, texts: list[str]):
        self.items = items
        self.tokens, self.first = np.zeros(0, np.uint64), [0]
        parts, seeds, entry = [], {}, {}
        at = 0
        for _, h, first in tokens(pa.array(texts, pa.string())):
            for i, z in zip(first[:-1], first[1:]):
                own = h[i:z]
                if len(own) >= WINDOW:
                    masks = MASKS
                else:
                    masks = ("1" * len(own),) if len(own) >= SHORTEST else ()
                for m in masks:
                    s = _seeds(own, m)
                    seeds.setdefault(m, []).append(s)
                    entry.setdefault(m, []).append(np.arange(at, at + len(s)))
                parts.append(own)
                at += len(own)
                self.first.append(at)
        self.first = np.array(self.first)
        self.tokens = np.concatenate(parts) if parts else self.tokens
        self.owner = np.repeat(np.arange(len(items)), np.diff(self.first))
        self.masks = {}
        for m, s in seeds.items():
            s, e = np.concatenate(s), np.concatenate(entry[m])
            order = np.argsort(s, kind="stable")
            there = np.zeros(1 << FILTER_BITS, bool)
            there[s >> np.uint64(64 - FILTER_BITS)] = True
            self.masks[m] = (s[order], e[order], there)

    def diagonals(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (row, item, document position of the item's first token) with a seed in common."""
        found = [np.zeros((0, 3), np.int64)]
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for m, (seeds, entry, there) in self.masks.items():
            s = _seeds(h, m)
            at = np.flatnonzero(there[s >> np.uint64(64 - FILTER_BITS)])
            low = np.searchsorted(seeds, s[at])
            hit = low < len(seeds)
            hit[hit] = seeds[low[hit]] == s[at[hit]]
            at, low = at[hit], low[hit]
            at_end = at + len(m) - 1
            same = row[at] == row[at_end]  # the window stays in one document
            at, low = at[same], low[same]
            n = np.searchsorted(seeds, s[at], "right") - low
            e = entry[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            at = np.repeat(at, n)
            item = self.owner[e]
            found.append(np.unique(np.stack([row[at], item, at - (e - self.first[item])], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def hits(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first and end token in the row, equal tokens) of the best diagonal of each row and item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        lines = self.diagonals(h, first)
        size = np.diff(self.first)[lines[:, 1]]
        # Lines of similar item length together, so that the padding stays small.
        order = np.argsort(size, kind="stable")
        lines, size = lines[order], size[order]
        at = 0
        while at < len(lines):
            to = min(at + max(1, LINES * 64 // int(size[min(at + LINES, len(lines)) - 1])), at + LINES, len(lines))
            self._compare(h, first, lines[at:to], size[at:to], best)
            at = to
        return [(r, i, *v) for (r, i), v in sorted(best.items())]

    def _compare(self, h, first, lines, size, best) -> None:
        row, item, start = lines[:, 0], lines[:, 1], lines[:, 2]
        step = np.arange(int(size.max()))
        here = start[:, None] + step
        ok = (step < size[:, None]) & (here >= first[row][:, None]) & (here < first[row + 1][:, None])
        mine = self.first[item][:, None] + step
        equal = ok & (h[np.where(ok, here, 0)] == self.tokens[np.where(ok, mine, 0)])
        total = np.concatenate([np.zeros((len(lines), 1), np.int64), np.cumsum(equal, axis=1)], axis=1)
        for k in range(len(lines)):
            span = min(WINDOW, int(size[k]))
            need = LEAST if size[k] >= WINDOW else span
            full = total[k, span : size[k] + 1] - total[k, : size[k] + 1 - span]
            good = np.flatnonzero(full >= need)
            if len(good):
                low, high = good[0], good[-1] + span
                value = (int(start[k] + low - first[row[k]]), int(start[k] + high - first[row[k]]), int(total[k, high] - total[k, low]))
                key = (int(row[k]), int(item[k]))
                if key not in best or (value[2], -value[0]) > (best[key][2], -best[key][0]):
                    best[key] = value


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_TOKENS) -> Iterator[Block]:
    """The benchmark in blocks of about ``limit`` tokens (a longer item is a block of its own); null texts are skipped."""
    items, texts, size = [], [], 0
    for r in benchmark.select(id_col, text_col).filter(F.col(text_col).isNotNull()).distinct().toLocalIterator():
        own = len(r[1]) // 2 + 1
        if items and size + own > limit:
            yield Block(items, texts)
            items, texts, size = [], [], 0
        items.append(r[0])
        texts.append(r[1])
        size += own
    if items:
        yield Block(items, texts)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", limit: int = BLOCK_TOKENS) -> DataFrame:
    """(id_col, item_col, start_token, end_token, n_equal): one row for each document row and item it contains.

    The span covers all agreeing windows of the best diagonal; ties go to the
    first.  Null and empty texts contain nothing, and repeated rows give
    repeated rows; distinct benchmark rows of one id are reported each.  Empty
    tables give an empty result.
    """
    spark = docs.sparkSession
    doc_kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {doc_kind}, `{item_col}` {item_kind}, start_token long, end_token long, n_equal long"
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark, item_col, item_text_col, limit):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches, shipped=shipped):
            own = shipped.value
            for b in batches:
                found = []
                for low, h, first in tokens(b.column(1)):
                    found += [(low + r, *rest) for r, *rest in own.hits(h, first)]
                rows = pa.array([f[0] for f in found], pa.int64())
                kind = pa.array(own.items[:1]).type
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), pa.array([own.items[f[1]] for f in found], kind),
                     *(pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4))],
                    [id_col, item_col, "start_token", "end_token", "n_equal"])

        out = out.union(narrow.mapInArrow(X.trimmed(run), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", limit: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of ``docs`` that contain no benchmark item, all columns unchanged; one scan for all blocks."""
    at = docs.columns.index(text_col)
    for block in blocks(benchmark, item_col, item_text_col, limit):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shipped=shipped):
            own = shipped.value
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for low, h, first in tokens(b.column(at)):
                    keep[[low + r for r, *_ in own.hits(h, first)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(X.trimmed(run), docs.schema)
    return docs
