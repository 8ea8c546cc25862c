"""Operator 3: fuzzy line deduplication.

Lines are normalised to lower-case words without punctuation.  Where digits
make up at most a fifth of a line they are read as 0: lines that then have the
same words differ in at most those digits, so all of them are similar by the
edit rule itself and form one class without any comparison.  Lines with more
digits (rows of numbers) keep them, and only equal ones are one class.  A class
stands for its lines by its first one, by (document, line).

A class gets a 64-bit SimHash of its words.  Classes at Hamming distance at
most 3 agree in some blocks of a partition of the 64 bits (pigeonhole), so they
meet in a join on block keys; pairs that meet are verified by edit similarity,
and of every connected group one occurrence is kept, the first.

Rows of a key are sorted next to each other and compared as arrays of bits; a
pair counts only at the first key it agrees on, and only if the lengths of its
lines, which a class fixes, leave room for the similarity.  A key with more near pairs
than ``PAIRS`` for each class emits one pair a class, that with the first
near class, and a key of more than ``HOT`` classes the pairs with its first
class.  Once these are verified and connected, the classes of such keys are
compared in blocks spread over tasks, and only pairs from different components
go on.  Equal results follow, since a pair inside one component changes
nothing.  The number of blocks grows with the number of classes so that chance
meetings stay below one for each; it decides the cost and not the result.
"""

from __future__ import annotations

import re
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.llm import text as X
from wavecohort.llm.components import components
from wavecohort.llm.contamination import LETTER
from wavecohort.llm.stored import kept, scratch, stored

DISTANCE = 3
SIMILARITY = 0.8
CHUNK = 1 << 17  # words of long lines whose bits are counted at a time
LANES = np.uint64(0x0101010101010101)
SIEVE = 1 << 24  # bits that tell which ids a join can leave out
DIGITS = 5  # one digit in so many characters still leaves lines that differ in digits similar
HOT = 4096  # classes of one key that a task compares at once
PAIRS = 1  # near pairs a key emits for each of its classes at once
ROWS = 1 << 18  # rows compared at a time


def _digits() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[48:58] = 48
    return table


FOLD = _digits()


def simhashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Majority bits of the word hashes of each line; 0 for a line without words.

    Every eighth bit is counted at a time, each in a byte of its own; lines of
    more words than a byte counts are done apart.
    """
    out = np.zeros(len(first) - 1, np.uint64)
    size = np.diff(first)
    some = np.flatnonzero(size > 0)
    if not len(some):
        return out
    h, at, half = h[: first[-1]], first[some], np.minimum(size[some] // 2, 255).astype(np.uint8)[:, None]
    bits = np.zeros(len(some), np.uint64)
    for k in range(8):
        votes = np.add.reduceat((h >> np.uint64(k)) & LANES, at).astype("<u8", copy=False)
        bits |= (votes.view(np.uint8).reshape(-1, 8) > half).view("<u8").ravel() << np.uint64(k)
    out[some] = bits
    for own in some[size[some] > 255]:
        votes = np.zeros(64, np.int64)
        for lo in range(first[own], first[own + 1], CHUNK):
            part = h[lo : min(lo + CHUNK, first[own + 1])]
            votes += np.unpackbits(part.byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[own] = np.packbits(2 * votes > size[own]).view(">u8")[0]
    return out


def _lines(column):
    """Slices: (first row, line starts, lines before each row and the total, class names, word hashes, words before each line, characters of each written line)."""
    for low, _, data, offsets in X.slices(pc.utf8_lower(X.plain(column))):
        cuts = np.flatnonzero(data == 10)
        row_start = offsets[:-1]
        start = np.sort(np.concatenate([row_start, cuts + 1]), kind="stable")
        # A line break that ends a row is followed by an empty line of that row, which stands before the next row's first.
        row_line = np.searchsorted(cuts, offsets) + np.arange(len(offsets))
        bounds = np.append(start, len(data))
        w, z, _ = X.runs(LETTER[data], np.unique(bounds))
        first = np.append(np.searchsorted(w, start), len(w))
        # Digits and continuation bytes are few, so they are found by place; all of them are in words.
        inside = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask), bounds))
        size = np.concatenate([[0], np.cumsum(z - w)])[first]
        chars = np.diff(size) - inside((data & 0xC0) == 0x80) + np.diff(first) - 1
        digits = inside((data >= 48) & (data <= 57))
        few = DIGITS * digits <= chars
        if digits[few].any():
            data = np.where(np.repeat(few, np.diff(bounds)), FOLD[data], data)
        h = X.span_hashes(data, w, z)
        yield low, start, row_line, X.span_hashes(h, first[:-1], first[1:]), h, first, chars


def class_name(line: str) -> str:
    """The words of a written line, with digits as 0 where they are few."""
    few = DIGITS * sum(c in "0123456789" for c in line) <= len(line)
    return re.sub("[0-9]", "0", line) if few else line


def written(line: bytes) -> str:
    """The words of one lower-case line."""
    return re.sub(rb"[^0-9A-Za-z\x80-\xff]+", b" ", line).strip().decode("utf-8", "replace")


def line_table(docs: DataFrame, kind: str) -> DataFrame:
    """(id, line, n, sim, chars) of every line that has a word; n is the hash of its class, sim the SimHash and chars the characters of that."""
    def run(batches):
        for b in batches:
            for low, start, row_line, n, h, first, chars in _lines(b.column(1)):
                sim, keep = simhashes(h, first), np.diff(first) > 0
                row = np.repeat(np.arange(len(row_line) - 1), np.diff(row_line))
                no = np.arange(len(start)) - row_line[row]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(low + row[keep])), pa.array(no[keep].astype(np.int64)), pa.array(n[keep].view(np.int64)),
                     pa.array(sim[keep].view(np.int64)), pa.array(chars[keep].astype(np.int32))], ["id", "line", "n", "sim", "chars"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, line long, n long, sim long, chars int")


def block_masks(distance: int, rows: int) -> list[int]:
    """Masks of which some key agrees for any two values within ``distance``.

    64 bits fall into distance + c blocks and every choice of c makes a key.
    The smallest c is taken for which ``rows`` random values meet fewer than
    one other each.
    """
    for c in range(1, 6):
        m = distance + c
        if comb(m, c) * rows < 2 ** (64 * c / m) or c == 5:
            edges = [64 * k // m for k in range(m + 1)]
            blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
            return [sum(pick) for pick in combinations(blocks, c)]
    raise AssertionError


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def bit_counts(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def near_pairs(group: np.ndarray, m: np.ndarray, sim: np.ndarray, distance: int, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j), i < j, of one group whose SimHashes are near; each pair only where ``m`` is the first mask it agrees on.

    A group is all rows of one hash of (mask, masked bits), so rows of different keys can share it.
    """
    left, right = [], []
    i, step = np.arange(len(group)), 1
    while True:
        i = i[: int(np.searchsorted(i, len(group) - step))]
        i = i[group[i] == group[i + step]]
        if not len(i):
            break
        x = sim[i] ^ sim[i + step]
        near = (bit_counts(x) <= distance) & (m[i] == m[i + step]) & ((x & masks[m[i]]) == 0)
        at, x = i[near], x[near]
        before = np.zeros(len(at), bool)
        for k, mask in enumerate(masks):
            before |= (m[at] > k) & ((x & mask) == 0)
        left.append(at[~before])
        right.append(at[~before] + step)
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def long_enough(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether lines of so many characters can be similar, by the first rule of ``similar``."""
    return np.abs(x - y) <= (1 - similarity) * np.maximum(x, y) + 1e-9


def _meet(classes: DataFrame, distance: int, masks: list[int], similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, m): near pairs with m null; of keys that have too many, some pairs, and all classes a of the key m (b is the SimHash).

    The mask's number stands in the low byte of m, the characters of the class above; without a column chars, lengths are not compared.
    """
    table = np.array(masks, np.uint64)
    signed = F.array(*[F.lit(_signed(m)) for m in masks])
    chars = F.col("chars") if "chars" in classes.columns else F.lit(0)
    keyed = classes.select("n", "sim", chars.cast("long").alias("chars"), F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("m"))
    keyed = keyed.select("n", "sim", (F.shiftleft("chars", 8) + F.col("m")).alias("m"))
    mask = F.col("m").bitwiseAND(F.lit(255)).cast("int")
    key = F.col("sim").bitwiseAND(F.get(signed, mask))

    def out(a, b, m=None):
        m = pa.nulls(len(a), pa.int64()) if m is None else pa.array(m)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), m], ["a", "b", "m"])

    def whole(n, sim, m, key):
        """Rows of complete keys."""
        change = np.ones(len(n), bool)
        change[1:] = key[1:] != key[:-1]
        group = np.cumsum(change) - 1
        i, j = near_pairs(group, m & 255, sim, distance, table)
        room = long_enough(m[i] >> 8, m[j] >> 8, similarity)
        i, j = i[room], j[room]
        size = np.bincount(group)
        heavy = np.bincount(group[i], minlength=len(size)) > PAIRS * size
        if heavy.any():
            least = np.full(len(n), len(n))
            np.minimum.at(least, j, i)
            stay = ~heavy[group[i]] | (least[j] == i)
            i, j = i[stay], j[stay]
            mine = heavy[group]
            yield out(n[mine], sim[mine].view(np.int64), m[mine])
        yield out(n[i], n[j])

    def run(batches):
        held = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]
        star = None  # the first class of a hot key that goes on
        for b in batches:
            new = [b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(), b.column(3).to_numpy()]
            if star is not None:
                same = new[3] == star[3]
                k = len(same) if same.all() else int(np.argmin(same))
                yield from hot(star, *[c[:k] for c in new])
                new = [c[k:] for c in new]
                if not len(new[0]):
                    continue
                star = None
            held = [np.concatenate([x, y]) for x, y in zip(held, new)]
            if len(held[0]) < ROWS:
                continue
            cut = int(np.searchsorted(held[3], held[3][-1]))
            yield from whole_or_hot(*[c[:cut] for c in held])
            held = [c[cut:] for c in held]
            if len(held[0]) > HOT:
                star = tuple(c[0] for c in held)
                yield from hot(star, *held)
                held = [c[:0] for c in held]
        if len(held[0]):
            yield from whole_or_hot(*held)

    def hot(star, n, sim, m, key):
        """Classes of a hot key meet its first class; the rest follows in blocks."""
        near = (bit_counts(sim ^ star[1]) <= distance) & (n != star[0]) & long_enough(m >> 8, star[2] >> 8, similarity)
        yield out(np.full(int(near.sum()), star[0]), n[near])
        yield out(n, sim.view(np.int64), m)

    def whole_or_hot(n, sim, m, key):
        if not len(n):
            return
        at = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(n))
        large = np.diff(at) > HOT
        for k in np.flatnonzero(large):
            own = slice(at[k], at[k + 1])
            yield from hot((n[at[k]], sim[at[k]], m[at[k]]), n[own], sim[own], m[own], key[own])
        rest = ~np.repeat(large, np.diff(at))
        if rest.any():
            yield from whole(n[rest], sim[rest], m[rest], key[rest])

    # One number is the key to both, so that rows are sorted by their prefixes.
    placed = keyed.repartition(F.xxhash64(mask, key)).withColumn("key", F.xxhash64(mask, key)).sortWithinPartitions("key")
    return placed.select("n", "sim", "m", "key").mapInArrow(run, "a long, b long, m long")


def _rest(open_: DataFrame, part: DataFrame, distance: int, masks: list[int], similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): near pairs of open keys whose classes are in different components; keys are compared in blocks of ``HOT`` classes.

    Block x meets block y in a group of its own, so a class travels once for each block of its key.
    """
    table = np.array(masks, np.uint64)
    signed = F.array(*[F.lit(_signed(m)) for m in masks])
    rows = open_.select(F.col("a").alias("n"), F.col("b").alias("sim"), F.col("m").bitwiseAND(F.lit(255)).cast("int").alias("m"), F.shiftright("m", 8).alias("chars"))
    rows = rows.withColumn("key", F.col("sim").bitwiseAND(F.get(signed, F.col("m"))))
    rows = rows.join(part.withColumnRenamed("node", "n"), "n", "left").withColumn("root", F.coalesce("root", "n"))
    keys = rows.groupBy("m", "key").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("blocks"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    rows = rows.join(keys.where("r0 < r1"), ["m", "key"]).withColumn("x", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int"))
    met = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "n", "sim", "root", "m", "key", "chars", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "x")
    schema = "a long, b long"

    def run(batch: pa.Table) -> pa.Table:
        n, root, x, chars = (batch.column(c).to_numpy() for c in ("n", "root", "x", "chars"))
        sim, m = batch.column("sim").to_numpy().view(np.uint64), batch.column("m")[0].as_py()
        one = len(x) > 0 and batch.column("lo")[0].as_py() == batch.column("hi")[0].as_py()
        low = np.flatnonzero(x == batch.column("lo")[0].as_py())
        high = low if one else np.flatnonzero(x != batch.column("lo")[0].as_py())
        left, right = [], []
        for i in low:
            d = sim[high] ^ sim[i]
            ok = (bit_counts(d) <= distance) & (root[high] != root[i]) & long_enough(chars[high], chars[i], similarity)
            if one:
                ok &= n[high] > n[i]
            for mask in table[:m]:
                ok &= (d & mask) != 0
            left.append(np.full(int(ok.sum()), n[i]))
            right.append(n[high[ok]])
        a, b = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (left, right))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return met.groupBy("m", "key", "lo", "hi").applyInArrow(run, schema)


def similar(a: str, b: str, similarity: float) -> bool:
    """Whether at most ``1 - similarity`` of the longer string's characters have to be edited.

    What both begin and end with is left out.  The rest can always be
    overwritten, and characters that one side has more often have to go: these
    bounds settle most pairs.  Then word edits bound the character edits from
    above: one costs at most the longest word and a space.  Else the longest
    common subsequence bounds them: what the longer one has besides is edited,
    and what both have besides is edited at most.  Only what all this leaves
    open is compared by the full rule.
    """
    allowed = (1 - similarity) * max(len(a), len(b)) + 1e-9
    if abs(len(a) - len(b)) > allowed:
        return False
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    low = int(differ[0]) if len(differ) else n
    x, y, n = x[low:], y[low:], n - low
    differ = np.flatnonzero(x[len(x) - n:][::-1] != y[len(y) - n:][::-1])
    high = int(differ[0]) if len(differ) else n
    x, y = x[:len(x) - high], y[:len(y) - high]
    if max(len(x), len(y)) <= allowed:
        return True
    more = np.bincount(x & 255, minlength=256) - np.bincount(y & 255, minlength=256)
    if max(more[more > 0].sum(), -more[more < 0].sum()) > allowed:
        return False
    left, right = trim(a.split(" "), b.split(" "))
    if distance(left, right) * (1 + max(map(len, left + right))) <= allowed:
        return True
    x, y = x.tolist(), y.tolist()
    both = common(x, y)
    if max(len(x), len(y)) - both > allowed:
        return False
    return len(x) + len(y) - 2 * both <= allowed or distance(x, y) <= allowed


def trim(a: list, b: list) -> tuple[list, list]:
    """Both without what they begin and end with alike."""
    n, low = min(len(a), len(b)), 0
    while low < n and a[low] == b[low]:
        low += 1
    high = 0
    while high < n - low and a[-1 - high] == b[-1 - high]:
        high += 1
    return a[low : len(a) - high], b[low : len(b) - high]


def places(a: list) -> dict:
    """The places of each item, as bits of an integer."""
    found, bit = {}, 1
    for c in a:
        found[c] = found.get(c, 0) | bit
        bit <<= 1
    return found


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence: one pass over ``b`` with the places of ``a`` as bits of an integer (Hyyro, 2004)."""
    at, full = places(a), (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def distance(a: list, b: list) -> int:
    """Edit distance of two sequences: one pass over ``b`` with the places of ``a`` as bits of an integer (Myers, 1999)."""
    if not a or not b:
        return len(a) + len(b)
    at, full = places(a), (1 << len(a)) - 1
    up, down = full, 0  # bits: the column grows, or shrinks, by one from place to place
    for c in b:
        m = at.get(c, 0)
        level = (((m & up) + up) ^ up) | m | down
        more = (down | (full & ~(level | up))) << 1 | 1
        less = (up & level) << 1
        up, down = (less | ~(level | more)) & full, more & level & full
    return len(b) + up.bit_count() - down.bit_count()


def split(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose id may be in ``ids``, and rows whose id is not, so that only the first have to move for a join.

    Hashes of all ids are held as a bitmap of ``SIEVE`` bits (2 MB), in pieces
    that every task gets; more ids make it let more rows through.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(SIEVE)) + 1
    at = ids.select(F.bitmap_bucket_number(place).alias("_piece"), F.bitmap_bit_position(place).alias("bit")).repartition("_piece")
    pieces = at.groupBy("_piece").agg(F.bitmap_construct_agg("bit").alias("_bits"))
    rows = docs.join(F.broadcast(pieces), F.bitmap_bucket_number(place) == F.col("_piece"), "left")
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return rows.filter(there).select(*docs.columns), rows.filter(~there).select(*docs.columns)


def _texts(met: DataFrame, distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """(n, t): the first line, as written, of every class in a pair or an open key; documents with such a line move once for both."""
    wanted = met.select(F.col("a").alias("n")).union(met.filter("m is null").select(F.col("b").alias("n"))).distinct()
    places = stored(wanted.join(distinct, "n").groupBy("id").agg(F.collect_list(F.struct("line", "n")).alias("lines")), "places")

    def run(batches):
        for b in batches:
            lowered = pc.utf8_lower(X.plain(b.column(0)))
            ns, texts = [], []
            for t, lines in zip(lowered, b.column(1)):
                parts = t.as_buffer().to_pybytes().split(b"\n")
                for x in lines.as_py():
                    if x["line"] < len(parts):
                        ns.append(x["n"])
                        texts.append(written(parts[x["line"]]))
            # Rows of one id can differ; only a line of the wanted class counts.
            found = [n for _, _, _, n, _, _, _ in _lines(pa.array(texts, pa.string()))]
            right = np.concatenate(found).view(np.int64) == np.array(ns, np.int64) if found else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(ns, pa.int64()), pa.array(texts, pa.string())], ["n", "t"]).filter(pa.array(right, pa.bool_()))

    # Merged at every size, so that what moves grows with the documents and no table is sent to all tasks.
    return split(docs, places)[0].join(places.hint("merge"), "id").select("text", "lines").mapInArrow(run, "n long, t string").groupBy("n").agg(F.min("t").alias("t"))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of those pairs whose first lines, with their digits, are similar enough; whole lines are compared."""
    both = pairs.join(texts.select(F.col("n").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("n").alias("b"), F.col("t").alias("tb")), "b")

    def verify(batches):
        for b in batches:
            keep = [similar(x, y, similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def _gone(known: DataFrame, kind: str, distance: int, similarity: float) -> DataFrame:
    """(id, gone): the numbers of the lines that each row loses."""
    lines = stored(line_table(known, kind), "lines")
    place = F.struct("id", "line")
    # Copies of one class are folded by a plain minimum on the map side; then the first place of each.
    ids = lines.groupBy("n").agg(F.min("id").alias("id"), F.min("sim").alias("sim"), F.min("chars").alias("chars"), F.count(F.lit(1)).alias("copies"))
    first_line = lines.groupBy("n", "id").agg(F.min("line").alias("line"))
    distinct = stored(ids.join(first_line, ["n", "id"]), "distinct")
    masks = block_masks(distance, distinct.count())
    met = stored(_meet(distinct, distance, masks, similarity), "met")
    near = met.filter("m is null").select("a", "b")
    texts = stored(_texts(met, distinct, known), "texts")
    edges = stored(_verified(near, texts, similarity), "edges")
    part = components(edges)
    open_ = met.filter("m is not null")
    if open_.take(1):
        rest = stored(_rest(open_, part, distance, masks, similarity).join(near, ["a", "b"], "left_anti"), "rest")
        edges = stored(edges.union(_verified(rest, texts, similarity)), "edges")
        part = components(edges)
    # The first place of every group of classes; a class outside of them has its own, and lines to lose only if it has several.
    groups = stored(distinct.select("n", "id", "line").join(part.withColumnRenamed("node", "n"), "n"), "groups")
    first = groups.groupBy("root").agg(F.min(place).alias("first"))
    moved = groups.select("n", "root").join(first, "root").select("n", "first")
    where = distinct.join(moved, "n", "left").filter("copies > 1 or first is not null").select("n", F.coalesce("first", place).alias("first"))
    dropped = lines.join(where, "n").filter((F.col("id") != F.col("first.id")) | (F.col("line") != F.col("first.line")))
    return dropped.groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE,
                similarity: float = SIMILARITY) -> DataFrame:
    """(id_col, n_lines, n_removed, kept) of every row: the text without the lines that repeat an earlier one.

    Lines end at line breaks.  Lines without a word (blank, rules) are always
    kept and group with nothing.  A null text is empty: one line, kept.  Rows
    with a null id are left as they are and are no source.  Rows of one id
    share their line numbers, so equal rows lose the same lines.  An empty
    table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = rows.filter("id is not null")
    # The tables behind it are gone before texts move for the result.
    with scratch(docs.sparkSession):
        gone = kept(_gone(known, kind, distance, similarity), "dropped")
    some, none = split(rows, gone)

    def run(batches):
        for b in batches:
            counts, removed, texts = [], [], []
            for t, g in zip(X.plain(b.column(1)).to_pylist(), b.column(2).to_pylist()):
                parts, drop = t.split("\n"), set(g or ())
                stay = [p for k, p in enumerate(parts) if k not in drop]
                counts.append(len(parts))
                removed.append(len(parts) - len(stay))
                texts.append("\n".join(stay))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                                             [id_col, "n_lines", "n_removed", "kept"])

    lost = some.join(gone.hint("merge"), "id", "left").select("id", "text", "gone").mapInArrow(
        run, f"`{id_col}` {kind}, n_lines long, n_removed long, kept string")
    text = F.coalesce("text", F.lit(""))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return lost.union(none.select(F.col("id").alias(id_col), (breaks + 1).cast("long"), F.lit(0).cast("long"), text))
