import hashlib

import numpy as np
import pytest

from tests.llm import fixtures as D
from wavecohort.llm import queries, recompression, text


def brute(rows, window):
    """{position in rows: (n_words, kept)} by looking every window up."""
    first, words = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p:p + window]), i)
    out = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p:p + window])] < i:
                gone[p:p + window] = True
        out.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("letters", [2, 3, 20, 500])
def test_symbols_of_a_window_do_not_depend_on_its_context(letters):
    rng = np.random.default_rng(letters)
    vocabulary = text.mix(np.arange(1, letters + 1).astype(np.uint64))
    for trial in range(40):
        window = vocabulary[rng.integers(0, letters, 50)]
        if trial % 3 == 0:
            window = np.repeat(window[:10], 5)
        seen = []
        for _ in range(2):
            before, after = (vocabulary[rng.integers(0, letters, rng.integers(0, 60))] for _ in range(2))
            h = np.concatenate([before, window, after])
            s = recompression.parse(h, np.array([0, len(h)]))
            n = len(before)
            own = (s.low >= n) & (s.high <= n + 50)
            seen.append(set(zip((s.start[own] - n).tolist(), (s.end[own] - n).tolist(), s.name[own].tolist())))
        assert seen[0] == seen[1]


def test_query_equals_brute_force(spark, sf):
    want = brute([(r.doc_id, r.text) for r in D.documents(spark, sf).collect()], 50)
    got = queries.QUERIES["op1_substring_dedup"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == sorted(
        ((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in want), key=str)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in D.ROWS]
    assert found(recompression.deduplicate(D.odd(spark))) == brute(rows, 50)
    assert found(recompression.deduplicate(D.empty(spark))) == []


def test_repetitive_texts_and_chains(spark):
    a, b = " ".join(["the"] * 120), " ".join(["a b c"] * 40)
    texts = [a, b, a + " " + b, b + " x " + a, "y " * 49, " ".join(["the"] * 50)]
    rows = [(k + 1, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(recompression.deduplicate(df)) == brute(rows, 50)
