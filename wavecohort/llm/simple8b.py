"""Simple-8b word-aligned coding of ids, encoded and decoded in bulk with numpy.

A 64-bit word holds a selector in its top four bits and equally wide values
below.  ``LAYOUT`` gives the (count, bits) of selectors 1 to 14; selector 0
stands for 240 zeros, and selector 15 is the escape: the next word is one whole
64-bit value.  Values are cut into blocks of ``BLOCK``; a block starts at a word
of its own, and an index of word offsets lets blocks be decoded alone or all at
once.  The last word of a block is filled up with zeros.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

# Fixed values of the format: values per word and bits per value of selectors 1 to 14.
LAYOUT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ZEROS = 240
ESCAPE = 15
BLOCK = 4096
CHUNK = 64  # blocks encoded at a time
MAGIC = b"S8B1"
SMALL = np.frexp(np.arange(1 << 16, dtype=np.float32))[1].astype(np.uint8)  # bits of small values


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block and the total) of unsigned 64-bit values, some blocks at a time."""
    parts, offsets = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for lo in range(0, len(values), CHUNK * block):
        words, own = _encode(values[lo : lo + CHUNK * block], block)
        parts.append(words)
        offsets.append(offsets[-1][-1] + own[1:])
    return np.concatenate(parts), np.concatenate(offsets)


def _encode(values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode``, all at once.

    Every word takes the selector that holds most of the next values; a word
    ends with its block at the latest, and the next one follows it.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    choice = _choices(_bits(values), block)
    taken = np.array([ZEROS, *(c for c, _ in LAYOUT), 1], np.uint8)
    left = np.minimum(np.arange(block, 0, -1), ZEROS).astype(np.uint8)
    step = np.minimum(taken[choice], left).tobytes()  # bytes, since a loop reads them fastest
    begins, at = bytearray(n), 0
    while at < n:
        begins[at] = 1
        at += step[at]
    first = np.flatnonzero(np.frombuffer(begins, np.uint8))
    kind = choice.reshape(-1)[first]
    size = np.diff(first, append=n)
    bits = np.array([0, *(b for _, b in LAYOUT), 0])[kind]
    # Every value moves to its place in its word; the values of a word are joined.
    shift = np.arange(n) * np.repeat(bits, size) - np.repeat(bits * first, size)
    joined = np.bitwise_or.reduceat(values << shift.view(np.uint64), first)
    escape = kind == ESCAPE
    width = 1 + escape
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    words[place] = kind.astype(np.uint64) << np.uint64(60) | np.where(escape, np.uint64(0), joined)
    words[place[escape] + 1] = joined[escape]
    offsets = np.append(place[np.searchsorted(first, np.arange(0, n, block))], len(words))
    return words, offsets.astype(np.int64)


def _bits(values: np.ndarray) -> np.ndarray:
    """The bits that each value takes."""
    if values.max() < len(SMALL):
        return SMALL[values]
    high, low = (values >> np.uint64(32)).astype(np.float64), (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.uint8)


def _choices(bits_of: np.ndarray, block: int) -> np.ndarray:
    """The selector of a word that starts at each value, by block: the one that holds most of the next values of the block.

    The widest of the next c values is the wider of two shorter stretches that
    cover them; behind the end of a block stand values without bits.
    """
    n, rows = len(bits_of), -(-len(bits_of) // block)
    wide = np.zeros((rows, block + ZEROS), np.uint8)
    full = n // block
    wide[:full, :block] = bits_of[: full * block].reshape(full, block)
    if full < rows:
        wide[full, : n - full * block] = bits_of[full * block :]
    choice = np.full((rows, block), ESCAPE, np.uint8)
    have = 1
    for selector, (count, bits) in sorted([*enumerate(LAYOUT, 1), (0, (ZEROS, 0))], key=lambda x: x[1][0]):
        while have < count:
            step = min(have, count - have)
            wide[:, :-step] = np.maximum(wide[:, :-step], wide[:, step:])
            have += step
        np.copyto(choice, np.uint8(selector), where=wide[:, :block] <= bits)
    return choice


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK, kind: type = np.uint64) -> np.ndarray:
    """The ``n`` values of consecutive blocks, as unsigned numbers of a type that holds them; some blocks at a time."""
    out = np.zeros(n, kind)
    for lo in range(0, len(offsets) - 1, CHUNK):
        own = offsets[lo : lo + CHUNK + 1]
        a, z = lo * block, min(n, (lo + CHUNK) * block)
        out[a:z] = _decode(words[own[0] : own[-1]], own - own[0], z - a, block)
    return out


def _decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int) -> np.ndarray:
    """As ``decode``, all at once."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    raw = np.zeros(len(words), bool)
    kind = (words >> np.uint64(60)).astype(np.int64)
    # The word after an escape is a value; escapes are told apart from values that look like them one run at a time.
    escape = np.flatnonzero(kind == ESCAPE)
    if len(escape):
        run_start = escape[np.append(True, np.diff(escape) > 1)]
        run = np.searchsorted(run_start, escape, "right") - 1
        true = escape[(escape - run_start[run]) % 2 == 0]
        raw[true + 1] = True
    head = np.flatnonzero(~raw)
    kind = kind[head]
    taken = np.array([ZEROS, *(c for c, _ in LAYOUT), 1])[kind]
    total = np.cumsum(taken) - taken
    lead = np.searchsorted(head, offsets[:-1])
    block_of = np.searchsorted(lead, np.arange(len(head)), "right") - 1
    start = block_of * block + total - total[lead][block_of]
    stop = np.minimum((block_of + 1) * block, n)
    for selector in range(1, len(LAYOUT) + 1):
        count, bits = LAYOUT[selector - 1]
        own = np.flatnonzero(kind == selector)
        mask = np.uint64((1 << bits) - 1)
        for k in range(count if len(own) else 0):
            ok = own[start[own] + k < stop[own]]
            out[start[ok] + k] = (words[head[ok]] >> np.uint64(bits * k)) & mask
    own = np.flatnonzero(kind == ESCAPE)
    out[start[own]] = words[head[own] + 1]
    return out


class Packer:
    """One file whose ids come in parts: whole chunks of blocks are encoded at once, so that words are held and not ids."""

    def __init__(self):
        self.n, self.open, self.n_open = 0, [], 0
        self.words, self.offsets = [], [np.zeros(1, np.int64)]

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.n_open += len(ids)
        self.open.append(ids)
        if self.n_open >= CHUNK * BLOCK:
            self._encode(self.n_open // (CHUNK * BLOCK) * CHUNK * BLOCK)

    def _encode(self, upto: int) -> None:
        ids = np.concatenate(self.open)
        words, offsets = encode(ids[:upto])
        self.words.append(words.astype("<u8", copy=False))
        self.offsets.append(self.offsets[-1][-1] + offsets[1:])
        self.open, self.n_open = [ids[upto:].copy()], len(ids) - upto

    def parts(self, doc_counts: np.ndarray, start: int) -> Iterator[bytes | np.ndarray]:
        """Magic, header, ids per document, block index and words, all little-endian.

        ``start``: ids before the first document of the file, in its partition.
        """
        if self.n_open:
            self._encode(self.n_open)
        counts, count_offsets = encode(doc_counts)
        yield struct.pack("<4sqqqqqq", MAGIC, len(doc_counts), self.n, start, BLOCK, len(counts), sum(map(len, self.words)))
        yield from (count_offsets.astype("<i8"), counts.astype("<u8"), np.concatenate(self.offsets).astype("<i8"), *self.words)


def pack(doc_counts: np.ndarray, ids: np.ndarray, start: int) -> bytes:
    """One file of ids that are all there."""
    packer = Packer()
    packer.add(ids)
    return b"".join(packer.parts(doc_counts, start))


def unpack(body: bytes, id_kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids per document, ids as ``id_kind``, start) of one file."""
    magic, docs, n, start, block, n_counts, n_words = struct.unpack_from("<4sqqqqqq", body)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b token file")
    at = struct.calcsize("<4sqqqqqq")
    arrays = []
    for size, kind in ((-(-docs // block) + 1, "<i8"), (n_counts, "<u8"), (-(-n // block) + 1, "<i8"), (n_words, "<u8")):
        arrays.append(np.frombuffer(body, kind, size, at).astype(kind[1:]))
        at += 8 * size
    return decode(arrays[1], arrays[0], docs, block).astype(np.int64), decode(arrays[3], arrays[2], n, block, id_kind), start
