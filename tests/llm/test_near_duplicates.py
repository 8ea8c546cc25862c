import numpy as np
import xxhash

from tests.llm import fixtures as D
from wavecohort.llm import queries, simhash
from wavecohort.llm.components import components


def fingerprint(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [(i, fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in fps})
    root = D.groups_of([(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4], distinct)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in fps), key=str)


def test_query_equals_brute_force(spark, sf):
    want = brute([(r.doc_id, r.text) for r in D.documents(spark, sf).collect()])
    got = queries.QUERIES["op2_simhash_near_dedup"](spark, sf).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_odd_rows(spark):
    got = simhash.near_duplicates(D.odd(spark)).collect()
    assert sorted(((r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in got), key=str) == brute([(r[0], r[1]) for r in D.ROWS])
    assert simhash.near_duplicates(D.empty(spark)).collect() == []


def test_representatives_keep_one_row_of_each_class(spark):
    df = D.odd(spark)
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    # Classes: the fox (1, 1, 2), no words (3, 4, 5), the long text (6, 7), the two rows without id, the others alone.
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 6, 8, 9, 10, None, 11, 12], key=str)


def near_group(n, seed, bits=12):
    """Fingerprints around one centre, in chains of small steps, and random ones."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 2**63))
    out = {base ^ sum(1 << int(k) for k in rng.choice(bits, int(rng.integers(0, 5)), replace=False)) for _ in range(n)}
    return sorted(out | {int(x) for x in rng.integers(0, 2**63, n)})


def test_trie_join_links_exactly_the_components(spark):
    values = near_group(150, 3)
    want = D.groups_of([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4], values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for top in (0, 4, 6):
        got = simhash.links(df, top).collect()
        assert D.groups_of([(r.a, r.b) for r in got], values) == want


def test_a_large_group_costs_few_links():
    values = np.array(near_group(3000, 5, 16), np.uint64)
    up = simhash.join_cell(values, np.ones(len(values), bool), 0, 2, 4)
    assert (up != np.arange(len(values))).sum() < len(values)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (102, 102), (None, 3), (200, 150), (150, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
