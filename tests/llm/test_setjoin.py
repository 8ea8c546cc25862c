import re

import numpy as np
import pytest

from tests import oracle
from tests.llm import fixtures as D
from wavecohort.llm import queries, setjoin


def shingle_set(t, size=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    k = min(size, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def similar(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 90 * (len(a) + len(b) - both)


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    distinct = list(dict.fromkeys(sets))
    root = D.groups_of([(i, j) for i, a in enumerate(distinct) for j in range(i) if similar(a, distinct[j])], range(len(distinct)))
    place = {s: root[k] for k, s in enumerate(distinct)}
    least = {}
    for (i, _), s in zip(rows, sets):
        if i is not None:
            least[place[s]] = min(i, least.get(place[s], i))
    return sorted(((i, len(s), least.get(place[s]) if s else i) for (i, _), s in zip(rows, sets)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    want = brute([(r.doc_id, r.text) for r in D.documents(spark, sf).collect()])
    assert len({c for *_, c in want}) < len(want)
    assert got(queries.QUERIES["op11_jaccard_join"](spark, sf)) == want


def test_query_equals_sql(spark, sf):
    assert oracle.compare(queries.QUERIES["op11_jaccard_join"](spark, sf), oracle.connect(sf), queries.ORACLE["op11_jaccard_join"]) == []


def test_odd_rows(spark):
    assert got(setjoin.joined(D.odd(spark))) == brute([(r[0], r[1]) for r in D.ROWS])
    assert setjoin.joined(D.empty(spark)).collect() == []


def changed(rng, base, n):
    t = list(base)
    for p in rng.choice(len(base), n, replace=False):
        t[p] = f"new{rng.integers(10**9)}"
    return t


def test_links_on_both_sides_of_the_limit(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(30):
        base = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(8, 260)))]
        rows += [(len(rows) + k, " ".join(changed(rng, base, min(len(base), n)))) for k, n in enumerate((0, 1, 2, 3, 4, 5, 7))]
    rows += [(1000 + k, " ".join(f"w{x}" for x in range(k))) for k in range(1, 40)]  # every length, each a part of the next
    want = brute(rows)
    assert 60 < len({c for *_, c in want}) < len(rows)
    assert got(setjoin.joined(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_a_shared_passage_and_chains(spark):
    """Texts that share rare shingles without being similar, and groups linked only in a chain."""
    rng = np.random.default_rng(2)
    passage = [f"p{k}" for k in range(200)]
    rows = [(k, " ".join([f"own{k}x{i}" for i in range(18)] + passage)) for k in range(40)]
    step = [f"c{k}" for k in range(150)]
    for k in range(40):
        rows.append((100 + k, " ".join(step)))
        step = step[3:] + [f"d{k}x{i}" for i in range(3)]
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    want = brute(rows)
    assert len({c for i, _, c in want if i >= 100}) == 1 and len({c for i, _, c in want if i < 100}) == 40
    assert got(setjoin.joined(spark.createDataFrame(rows, "doc_id long, text string"))) == want


@pytest.mark.parametrize("seed", range(5))
def test_divide_skip_equals_intersections(seed):
    rng = np.random.default_rng(seed)
    query = np.unique(rng.integers(0, 400, 150).astype(np.uint64))
    sets = []
    for _ in range(60):
        own = rng.permutation(query)[: int(rng.integers(len(query) * 8 // 10, len(query) + 1))]
        sets.append(np.unique(np.concatenate([own, rng.integers(0, 10**6, int(rng.integers(0, 20))).astype(np.uint64)])))
    want = [similar(set(query.tolist()), set(s.tolist())) for s in sets]
    assert any(want) and not all(want)
    assert setjoin.divide_skip(query, sets) == want


def test_short_lists_hold_every_partner():
    for n in range(1, 400):
        for m in range(n, 450):
            t = setjoin.needed(n, m)
            if t <= n:
                assert t > n - setjoin.short(n) and t > m - setjoin.short(m)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a = np.unique(rng.integers(0, 1 << 60, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 60, 20).astype(np.uint64)]))
        p = setjoin.parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        bits = sum((int(x) ^ int(y)).bit_count() if (int(x) ^ int(y)) >= 0 else ((int(x) ^ int(y)) & (2**64 - 1)).bit_count() for x, y in zip(*p))
        assert 0 < bits <= len(np.setxor1d(a, b))


def test_sketches_bound_the_difference_of_large_sets():
    """Large sets that share a passage and little else are told apart, which 256 parity bits cannot; similar ones never are."""
    rng = np.random.default_rng(4)
    for n in (1, 63, 200, 1500, 20_000):
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        near = np.unique(np.concatenate([a[rng.random(len(a)) > 0.05], rng.integers(0, 1 << 60, n // 20).astype(np.uint64)]))
        far = np.unique(np.concatenate([a[: n // 20], rng.integers(0, 1 << 60, n - n // 20).astype(np.uint64)]))
        for b in (near, far):
            assert setjoin.sketched_apart(setjoin.sketch(a), setjoin.sketch(b)) <= len(np.setxor1d(a, b))
        room = len(a) + len(far) - 2 * setjoin.needed(len(a), len(far))
        if n >= 1500:
            assert setjoin.sketched_apart(setjoin.sketch(a), setjoin.sketch(far)) > room
            assert len(setjoin.sketch(a)) <= n // 16


def test_lists_keep_sets_that_meet_another_once(spark):
    rows = [(5, 9, 1, 0), (5, 9, 1, 0), (7, 4, 2, 1), (5, 9, 2, 1), (5, 9, 2, 1), (-3, 8, 2, 0)]
    got = setjoin._members(spark.createDataFrame(rows, "node long, n long, token long, at long")).collect()
    assert sorted((r.token, r.node, r.n, r.at, r.star, r.star_n) for r in got) == [(2, -3, 8, 0, -3, 8), (2, 5, 9, 1, -3, 8), (2, 7, 4, 1, -3, 8)]
