import numpy as np

from tests.llm import fixtures as D
from wavecohort.llm import mixing, queries


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def count(t):
    return len((t or "").encode().split())


def check(rows, docs):
    """Rows of (doc_id, size, source_size, target, taken) against the documents."""
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = plain_targets(sizes)
    source = {i: s for i, _, s in docs}
    taken = {}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert {s: taken[s] for s in sizes} == {s: round(want[s]) for s in sizes}
    assert sorted(r.size for r in rows) == sorted(count(t) for _, t, _ in docs)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in D.documents(spark, sf).collect()]
    first = queries.QUERIES["op8_source_mixing"](spark, sf).collect()
    check(first, docs)
    assert sorted(first) == sorted(queries.QUERIES["op8_source_mixing"](spark, sf).collect())


def test_odd_rows_small_blocks_and_parts(spark):
    df = D.odd(spark).filter("doc_id is not null")
    docs = [(r[0], r[1], r[3]) for r in D.ROWS if r[0] is not None]
    from pyspark.sql import functions as F

    for words in (1_000_000, 50):
        mixed = mixing.mix(df, block_words=words, shards=5)
        rows = mixed.select("doc_id", "size", "source_size", "target", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["words"]).alias("taken"))
        source = {i: s for i, _, s in docs}
        assert {source[r.doc_id] for r in rows.collect()} == set(source.values())
        check(rows.collect(), docs)
    assert mixing.mix(D.empty(spark)).collect() == []
    body = mixing.mixed(D.odd(spark), shards=3)
    assert body.columns == D.odd(spark).columns and all(count(r.text) for r in body.collect())


def test_mixed_rows_hold_the_words_taken(spark, sf):
    docs = D.documents(spark, sf)
    assert sorted(r.doc_id for r in mixing.mix(docs, block_words=300).select("doc_id").collect()) == sorted(r.doc_id for r in docs.collect())
    rows = mixing.mixed(docs, shards=4, block_words=300).collect()
    sizes, got = {}, {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + count(r.text)
    for r in rows:
        got[r.source] = got.get(r.source, 0) + count(r.text)
    assert got == {s: round(t) for s, t in plain_targets(sizes).items()}


def test_targets_stop_at_three_times_the_source():
    assert mixing.targets({"a": 10, "b": 1000, None: 0}) == plain_targets({"a": 10, "b": 1000, None: 0})
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_splitting_tree_keeps_quotas_and_shares():
    draws = np.array([1000, 0, 37, 250])
    got = mixing.split_tree(draws, 7, np.random.default_rng(1))
    assert got.shape == (4, 7) and got.sum(1).tolist() == draws.tolist() and got.min() >= 0
    assert np.ptp(got.sum(0)) <= 3
    assert abs(got[0] / got.sum(0) - 1000 / 1287).max() < 0.12
