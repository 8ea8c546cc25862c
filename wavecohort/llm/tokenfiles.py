"""Operator 7: token ids in Simple-8b files.

Documents are range-partitioned by id and sorted; every partition encodes its
texts and writes files of about ``FILE_IDS`` ids to a shared folder, each file
whole or not at all (a temporary name first), under a name that depends on the
partition and so is the same when a task runs again.  Files are read back
through Spark's binary reader, one per row.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecohort.llm import simple8b
from wavecohort.llm import text as X
from wavecohort.llm.stored import stored
from wavecohort.session import scratch_path

END_ID = 2
FILE_IDS = 1 << 22
CACHE = 500_000  # pieces a task keeps
LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
STOP = np.array([chr(b) in ",.;:!?" for b in range(256)])
SPACE_LEAD = np.array([9 <= b <= 13 or 28 <= b <= 32 or b in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])
SLICE = 1 << 19  # bytes of text handled at a time; a worker takes some 150 times as much while it encodes
TEXTS = 64  # strings given to the tokenizer at a time
JOINED = 256  # pieces in one string


class Encoder:
    """Ids of texts as the tokenizer gives them for the whole text.

    A byte-level tokenizer without normaliser cuts a text before every space
    that a visible character follows, wherever it stands; between a letter (a to
    z) and a stop; and on both sides of a single line break between visible
    characters.  Such pieces repeat a lot: each is found by a 128-bit hash, encoded once and kept by the task.
    New pieces go to the tokenizer joined to longer strings, and the bytes that
    each id stands for tell where a piece ends.  Texts with other white space
    after a space, or with the string of a special token, and texts of other
    tokenizers are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.pieces = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True
            and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE")
        special = [re.escape(t["content"].encode()) for t in spec.get("added_tokens", [])]
        # White space, as the tokenizer sees it; longer than one byte where the first is 0xc2 or 0xe1 to 0xe3.
        self.space = re.compile(rb"[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
        self.special = re.compile(b"|".join(special)) if special else None
        # In the byte-level alphabet one character of a token is one byte.
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.h1, self.h2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.low, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for lo in range(0, len(texts), TEXTS) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + TEXTS], add_special_tokens=False)]

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
        """Encode the pieces at [start, end) and keep their ids."""
        body = data.tobytes()
        lead = data[start] == 32
        flat, counts = [], np.zeros(len(start), np.int64)
        # Pieces that begin with a space can follow each other; those that begin with a letter follow a line break.
        led, word = np.flatnonzero(lead), np.flatnonzero(LETTER[data[start]])
        for own_kind, before in ((led, b""), (word, b"\n")):
            for lo in range(0, len(own_kind), JOINED * TEXTS):
                own = own_kind[lo : lo + JOINED * TEXTS]
                groups = [own[k : k + JOINED] for k in range(0, len(own), JOINED)]
                texts = [b"".join([before + body[a:z] for a, z in zip(start[g].tolist(), end[g].tolist())]).decode() for g in groups]
                for g, ids in zip(groups, self._raw(texts)):
                    ids = np.array(ids, np.uint32)
                    ends = np.cumsum(end[g] - start[g] + len(before))
                    upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, "right")
                    counts[g] = np.diff(upto, prepend=0) - len(before)
                    flat.append(np.delete(ids, np.append(0, upto[:-1])) if before else ids)
        rest = np.flatnonzero(~lead & ~LETTER[data[start]])
        for k, ids in zip(rest, self._raw([body[a:z].decode() for a, z in zip(start[rest].tolist(), end[rest].tolist())])):
            counts[k] = len(ids)
            flat.append(np.array(ids, np.uint32))
        order = np.concatenate([led, word, rest])
        low = np.zeros(len(start), np.int64)
        low[order] = len(self.ids) + np.cumsum(counts[order]) - counts[order]
        self.ids = np.concatenate([self.ids, *flat])
        h1, h2 = np.concatenate([self.h1, h1]), np.concatenate([self.h2, h2])
        low, size = np.concatenate([self.low, low]), np.concatenate([self.size, counts])
        order = np.argsort(h1, kind="stable")
        self.h1, self.h2, self.low, self.size = h1[order], h2[order], low[order], size[order]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each) of UTF-8 texts."""
        n, body = len(offsets) - 1, data.tobytes()
        alone = np.ones(n, bool)
        if self.pieces:
            after = SPACE_LEAD[data[1:]] & (data[:-1] == 32)
            found = np.array([k for k in np.flatnonzero(after).tolist() if self.space.match(body, k + 1)], np.int64)
            if self.special:
                found = np.append(found, [m.start() for m in self.special.finditer(body)]).astype(np.int64)
            alone = np.zeros(n, bool)
            alone[np.searchsorted(offsets, found, "right") - 1] = True
            filled = np.flatnonzero(np.diff(offsets) > 0)
            alone[filled[data[offsets[filled + 1] - 1] == 32]] = True
        cut = data == 32
        cut[1:] |= STOP[data[1:]] & LETTER[data[:-1]]
        line = np.flatnonzero((data[1:-1] == 10) & (data[:-2] > 32) & (data[:-2] < 127) & LETTER[data[2:]]) + 1
        cut[line] = cut[line + 1] = True
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        doc = np.searchsorted(offsets, start, "right") - 1
        keep = ~alone[doc]
        start, end, doc = start[keep], end[keep], doc[keep]
        h1, h2 = X.span_hashes(data, start, end), X.span_hashes(data, start, end, X.BASE2)
        if len(self.h1) > CACHE:
            self.clear()
        order = np.argsort(h1)
        fresh = np.ones(len(h1), bool)
        fresh[1:] = h1[order][1:] != h1[order][:-1]
        one = order[fresh]  # a place of every distinct piece, by hash
        at = np.searchsorted(self.h1, h1[one])
        new = np.ones(len(one), bool)
        inside = at < len(self.h1)
        new[inside] = self.h1[at[inside]] != h1[one[inside]]
        if new.any():
            own = one[new]
            self._learn(data, start[own], end[own], h1[own], h2[own])
            at = np.searchsorted(self.h1, h1[one])
        place = np.empty(len(h1), np.int64)
        place[order] = np.cumsum(fresh) - 1
        at = at[place]
        twin = np.zeros(n, bool)
        twin[doc[self.h2[at] != h2]] = True  # equal in one hash only: such a text is encoded whole
        keep = ~twin[doc]
        low, size, doc = self.low[at[keep]], self.size[at[keep]], doc[keep]
        whole = np.flatnonzero(alone | twin)
        own = [np.array(i, np.uint32) for i in self._raw([body[offsets[d] : offsets[d + 1]].decode() for d in whole])]
        more = np.array([len(o) for o in own], np.int64)
        pool = np.concatenate([self.ids, *own])
        low = np.concatenate([low, len(self.ids) + np.cumsum(more) - more])
        size, doc = np.concatenate([size, more]), np.concatenate([doc, whole])
        order = np.argsort(doc, kind="stable")
        low, size = low[order], size[order]
        ids = pool[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        return ids, np.bincount(doc[order], weights=size, minlength=n).astype(np.int64)


KNOWN = ("h1", "h2", "low", "size", "ids")
SAMPLE = 2_000  # rows


def frequent_pieces(docs: DataFrame, tokenizer: str) -> dict[str, np.ndarray]:
    """Pieces of at most ``SAMPLE`` rows with their ids, which every task starts from.

    They save work and decide nothing: a piece that is not among them is learned by the task that meets it.
    """
    def run(batches):
        encoder = Encoder(tokenizer)
        for b in batches:
            for _, _, data, offsets in X.slices(X.plain(b.column(0)), SLICE):
                encoder(data, offsets)
        yield pa.RecordBatch.from_arrays([pa.array([k for k in KNOWN]), pa.array([getattr(encoder, k).tobytes() for k in KNOWN])], ["name", "value"])

    kinds = {k: v.dtype for k, v in zip(KNOWN, [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.uint32)])}
    rows = docs.select("_text").limit(SAMPLE).coalesce(1).mapInArrow(X.trimmed(run), "name string, value binary").collect()
    return {r["name"]: np.frombuffer(r["value"], kinds[r["name"]]) for r in rows}


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder[len("file:"):].lstrip("/")
    if folder.startswith("/"):
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int | None = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all rows, in ascending order of ``id_col`` (integers), to ``folder``.

    Returns the manifest: (part, file, n_docs, n_ids), one row for each file.
    A null text counts as empty; rows of one id are ordered by text; null ids
    come first.  ``end_id`` follows every document.  An empty table gives no
    file.
    """
    def run(batches):
        part = TaskContext.get().partitionId()
        encoder = Encoder(tokenizer)
        vars(encoder).update(known.value)
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        packer, counts, names, nulls = simple8b.Packer(), [], [], []
        before = made = 0

        def flush():
            nonlocal packer, counts, names, nulls, before, made
            n_docs = len(names)
            key = np.array(names, "<i8").tobytes() + np.packbits(np.array(nulls, bool)).tobytes()
            name = f"part-{part:08d}-{made:06d}.s8b"
            temporary = f"{root}/_{name}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(temporary) as f:
                f.write(np.array([n_docs], "<i8").tobytes() + key)
                for body in packer.parts(np.array(counts), before):
                    f.write(body)
            fs.move(temporary, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [n_docs], "n_ids": [packer.n]})
            before += packer.n
            made += 1
            packer, counts, names, nulls = simple8b.Packer(), [], [], []
            return row

        for b in batches:
            for lo, high, data, offsets in X.slices(X.plain(b.column(1)), SLICE):
                own = b.column(0).slice(lo, high - lo)
                flat, n = encoder(data, offsets)
                if end_id is not None:
                    flat = np.insert(flat, np.cumsum(n), end_id)
                    n = n + 1
                packer.add(flat)
                counts += n.tolist()
                names += own.fill_null(0).to_pylist()
                nulls += own.is_null().to_pylist()
                if packer.n >= file_ids:
                    yield flush()
        if names:
            yield flush()

    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    known = docs.sparkSession.sparkContext.broadcast(frequent_pieces(narrow, tokenizer))
    ordered = narrow.repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    return stored(ordered.mapInArrow(X.trimmed(run), "part int, file string, n_docs long, n_ids long"), "manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(id_col, start, n_tokens, ids array<long>, ids_crc32) of every document in the files of ``manifest``.

    Without ``with_ids`` the column ids is left out; the files are read and decoded all the same.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is taken
    over the ids as little-endian unsigned 32-bit integers.
    """
    columns = ["part", id_col, "at", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        for b in batches:
            for path, body in zip(b.column(0).to_pylist(), b.column(1)):
                body = body.as_buffer()
                n = int(np.frombuffer(body, "<i8", 1)[0])
                names = np.frombuffer(body, "<i8", n, 8)
                null = np.unpackbits(np.frombuffer(body, np.uint8, -(-n // 8), 8 + 8 * n), count=n).astype(bool)
                counts, ids, start = simple8b.unpack(memoryview(body)[8 + 8 * n + -(-n // 8):], np.dtype("<u4"))
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[z - c : z].tobytes()) for z, c in zip(ends.tolist(), counts.tolist())]
                part = int(path.rsplit("part-", 1)[1][:8])
                found = [pa.array(np.full(n, part, np.int32)), pa.array(names, mask=null), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    found.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(found, columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").schema(
        "path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "content")
    rows = files.mapInArrow(X.trimmed(run), f"part int, `{id_col}` long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    # One number for each partition of the sort.
    total, starts = 0, []
    for r in sorted(parts, key=lambda r: r["part"]):
        starts.append((r["part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(starts, "part int, offset long")
    return rows.join(offsets, "part").select(id_col, (F.col("at") + F.col("offset")).alias("start"), "n_tokens", *["ids"] * with_ids, "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                end_id: int | None = END_ID, folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """Write the files (to a new shared folder unless one is named) and read them back, see ``read``."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    manifest = write(docs, folder, tokenizer, id_col, text_col, end_id)
    if not manifest.take(1):
        return spark.createDataFrame([], f"`{id_col}` long, start long, n_tokens long, " + "ids array<long>, " * with_ids + "ids_crc32 long")
    return read(spark, folder, manifest, id_col, with_ids)
