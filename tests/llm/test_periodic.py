import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm import fixtures as D
from wavecohort.llm import periodic, queries


def runs_of(w):
    """(start, length, period) of every run, from every period and start."""
    found = {}
    n = len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(i, t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    return w


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(rows):
    out = []
    for i, t in rows:
        w = planted(i, t)
        runs = sorted(runs_of(w), key=lambda r: (r[0], r[2]))
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        four = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
        out.append((i, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept(w, runs))))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in D.documents(spark, sf).collect()]
    want = brute([(i, t) for i, t in rows if len(t or "") < 20_000])
    got = sorted((tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, sf).collect()), key=str)
    assert len(got) == len(rows) and sum(r[1] > 0 for r in want) > 10
    small = {i for i, *_ in want}
    assert [r for r in got if r[0] in small] == want


def texts(seed):
    """Words of few kinds with powers of many periods in them, runs inside runs, and runs that meet."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(40):
        w = []
        while len(w) < int(rng.integers(30, 900)):
            q = int(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100]))
            unit = [f"v{x}" for x in rng.integers(0, 2 + k % 5, q)]
            w += (unit * 9)[: int(q * rng.uniform(1, 8))] + [f"u{x}" for x in rng.integers(0, 50, int(rng.integers(0, 4)))]
        rows.append((k, " ".join(w)))
    rows.append((90, "same " * 700))
    rows.append((91, "a b a a b " * 5 + "x " + "a b " * 200))
    rows.append((92, " ".join(("ab" * 3 + "c") * 30)))
    return rows


@pytest.mark.parametrize(("long", "tile"), [(1 << 14, 1 << 13), (24, 128), (24, 512)])
def test_tiles_of_any_size_give_all_runs(spark, long, tile):
    rows = texts(long + tile)
    got = periodic.collapse(spark.createDataFrame(rows, "doc_id long, text string"), long=long, tile=tile).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        w = text[r.doc_id].split()
        want = sorted(runs_of(w), key=lambda x: (x[0], x[2]))
        assert [(x.start, x.length, x.period) for x in r.runs] == want, r.doc_id
        assert (r.n_words, r.text) == (len(w), kept(w, want))


def test_odd_rows(spark):
    got = {(r.doc_id, r.n_words, r.text) for r in periodic.collapse(D.odd(spark)).collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert got == {(r[0], len(words(r[1])), " ".join(words(r[1]))) for r in D.ROWS}
    assert periodic.collapse(D.empty(spark)).collect() == []


def test_one_word_many_times_costs_no_square():
    w = np.full(200_000, 7, np.uint64)
    one = lambda v: np.array([v])
    assert periodic.solve(w, one(0), one(len(w)), one(0), one(len(w)), one(0), periodic.octaves_of(len(w))) == [(0, 1, 0, len(w))]
