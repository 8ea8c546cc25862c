import sys
import tracemalloc
import zlib

import numpy as np
import pytest

from tests.llm import fixtures as D
from wavecohort.llm import queries, simple8b, text, tokenfiles
from wavecohort.llm.stored import stored
from wavecohort.session import scratch_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_round_trip_of_all_kinds_of_values():
    rng = np.random.default_rng(0)
    for trial in range(200):
        n = int(rng.integers(0, 900))
        values = [
            rng.integers(0, 2**64, n, dtype=np.uint64) >> rng.integers(0, 64, n).astype(np.uint64),
            rng.integers(0, 50_257, n).astype(np.uint64),
            np.where(rng.random(n) < 0.9, 0, rng.integers(0, 2**62, n)).astype(np.uint64),
            np.zeros(n, np.uint64),
            rng.integers(2**63, 2**64, n, dtype=np.uint64),
            rng.integers(0, 4, n).astype(np.uint64),
        ][trial % 6]
        block = int(rng.choice([7, 64, 256, 4096]))
        words, offsets = simple8b.encode(values, block)
        assert (simple8b.decode(words, offsets, n, block) == values).all()


def test_words_are_packed_as_the_layout_says():
    words, offsets = simple8b.encode(np.array([3] * 30, np.uint64))
    assert len(words) == 1 and int(words[0]) >> 60 == 2 and offsets.tolist() == [0, 1]
    words, _ = simple8b.encode(np.array([1 << 63], np.uint64))
    assert [int(w) for w in words] == [15 << 60, 1 << 63]


def test_one_block_is_decoded_alone():
    values = np.arange(10_000, dtype=np.uint64)
    words, offsets = simple8b.encode(values)
    part = words[offsets[1]:offsets[2]]
    assert (simple8b.decode(part, np.array([0, len(part)]), 4096) == values[4096:8192]).all()


def test_pieces_give_the_ids_of_the_whole_text(tokenizer):
    texts = ["", " ", "  a", "a  b", "a \nb", "x <|endoftext|> y", "it's 'tis don't", "tab\t x", "end ", "12 345 ,.!? é ñ", "\n\n\n a",
             "a\n b \n\n c", "<|endoftext|>", "don 's 've", " lead", "a  b 　c", "a  b"] + [r[1] or "" for r in D.ROWS]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    encoder = tokenfiles.Encoder(queries.tokenizer_path())
    encoder(np.frombuffer(b"a lead", np.uint8), np.array([0, 6]))  # known pieces change nothing
    ids, counts = encoder(np.frombuffer(b"".join(raw), np.uint8), offsets)
    ends = np.cumsum(counts)
    for t, n, z in zip(texts, counts, ends):
        assert ids[z - n:z].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_random_texts_give_the_ids_of_the_whole_text(tokenizer):
    rng = np.random.default_rng(7)
    letters = list("abThe") + ["the", "ing", " the", " a", " ", "  ", "\n", "\n\n", "\t", ".", ",", "!", "?\n", ";", ":", "'s", "'", "1", "42", "é", "ß", "”", "—",
                                 "\u00a0", "\x85", "\u2028", "\u3000", "\x1c", "<|endoftext|>", "日本", "\U0001f600", "_", "-", "\r\n", "\x00"]
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 14)))) for _ in range(4000)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    ids, counts = tokenfiles.Encoder(queries.tokenizer_path())(np.frombuffer(b"".join(raw), np.uint8), offsets)
    ends = np.cumsum(counts)
    wrong = [t for t, n, z in zip(texts, counts, ends) if ids[z - n:z].tolist() != tokenizer.encode(t, add_special_tokens=False).ids]
    assert wrong == []


def want(rows, tokenizer):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_whole_encoding(spark, sf, tokenizer):
    rows = [(r.doc_id, r.text) for r in D.documents(spark, sf).collect()]
    got = queries.QUERIES["op7_token_files"](spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want(rows, tokenizer)


def test_odd_rows_and_many_files(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SLICE", 100)
    df = D.odd(spark)
    folder = scratch_path(spark, "tokens")
    manifest = tokenfiles.write(df, folder, queries.tokenizer_path(), file_ids=50)
    assert manifest.count() > 2
    got = stored(tokenfiles.read(spark, folder, manifest), "read").collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want([(r[0], r[1]) for r in D.ROWS], tokenizer)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert tokenfiles.token_files(D.empty(spark), queries.tokenizer_path()).collect() == []


def test_a_worker_takes_little_memory_for_a_file(spark):
    ids = np.random.default_rng(1).integers(0, 50_257, 2_000_000).astype("<u4")
    body = simple8b.pack(np.array([len(ids)]), ids, 0)
    tracemalloc.start()
    try:
        _, found, _ = simple8b.unpack(body, np.dtype("<u4"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (found == ids).all()
    # 8 MB of ids, the words of the file once, and the arrays of some blocks.
    assert peak < 3 * found.nbytes + len(body)
    text._powers.clear()
    text.powers(text.BASE, 1000)
    assert len(text._powers[text.BASE][0]) <= text.STEP + 1


def test_a_file_is_packed_in_parts_with_the_words_in_memory_and_not_the_ids():
    parts = np.random.default_rng(3).integers(0, 50_257, (40, 100_001)).astype("<u4")
    whole = parts.ravel()
    counts = np.full(40, parts.shape[1])
    body = simple8b.pack(counts, whole, 7)
    tracemalloc.start()
    try:
        packer = simple8b.Packer()
        for p in parts:
            packer.add(p.copy())
        crc = 0
        for piece in packer.parts(counts, 7):
            crc = zlib.crc32(piece, crc)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert packer.n == len(whole) and crc == zlib.crc32(body)
    # The words once, and the arrays of one chunk, here 21 MB; ids and whole files took twice as much.
    assert peak < len(body) + 25e6


def test_rows_without_ids_are_those_with_ids(spark):
    docs = spark.createDataFrame([(3, "a b"), (1, None), (2, "c d e")], "doc_id long, text string")
    whole = tokenfiles.token_files(docs, queries.tokenizer_path()).drop("ids")
    short = tokenfiles.token_files(docs, queries.tokenizer_path(), with_ids=False)
    assert short.columns == whole.columns and sorted(short.collect()) == sorted(whole.collect())
    assert tokenfiles.token_files(docs.limit(0), queries.tokenizer_path(), with_ids=False).columns == short.columns


def greedy(values, block):
    """Words one after the other: the selector that holds most of the next values, up to the end of the block."""
    words, offsets = [], []
    for lo in range(0, len(values), block):
        offsets.append(len(words))
        own, at = values[lo:lo + block], 0
        while at < len(own):
            for selector, (count, bits) in [(0, (240, 0)), *enumerate(simple8b.LAYOUT, 1)]:
                part = own[at:at + count]
                if all(v >> bits == 0 for v in part):
                    words.append(selector << 60 | sum(v << bits * k for k, v in enumerate(part)))
                    break
            else:
                part = own[at:at + 1]
                words += [15 << 60, part[0]]
            at += len(part)
    return words, [*offsets, len(words)]


def test_words_are_those_of_the_greedy_rule():
    rng = np.random.default_rng(8)
    for trial in range(60):
        n = int(rng.integers(1, 700))
        values = np.where(rng.random(n) < rng.random(), 0, rng.integers(0, 2**64, n, dtype=np.uint64) >> rng.integers(0, 64, n).astype(np.uint64)).astype(np.uint64)
        block = int(rng.choice([1, 7, 64, 256, 4096]))
        words, offsets = simple8b.encode(values, block)
        assert (words.tolist(), offsets.tolist()) == greedy(values.tolist(), block)


def test_a_chunk_is_encoded_in_calls_for_its_values_together():
    values = np.random.default_rng(9).integers(0, 50_257, 64 * simple8b.BLOCK).astype("<u4")
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "c_call"

    sys.setprofile(count)
    try:
        simple8b.encode(values)
    finally:
        sys.setprofile(None)
    assert calls < 1000  # thousands when blocks move forward word by word
