import zlib

import numpy as np

from tests.llm import fixtures as D
from wavecohort.llm import packing, queries


def plain_best_fit(sizes, capacity, bins):
    rooms = [capacity] * (bins or 0)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(r, b) for b, r in enumerate(rooms) if r >= sizes[i]]
        if fits:
            b = min(fits)[1]
        elif bins is None:
            rooms.append(max(capacity, sizes[i]))
            b = len(rooms) - 1
        else:
            b = max((r, b) for b, r in enumerate(rooms))[1]
        rooms[b] -= sizes[i]
        out[i] = b
    return out


def test_tree_packs_like_a_plain_search(monkeypatch):
    rng = np.random.default_rng(0)
    for trial in range(150):
        monkeypatch.setattr(packing.RoomTree, "LEAF", int(rng.choice([2, 3, 512])))
        sizes = rng.integers(1, 100, int(rng.integers(0, 300))).tolist()
        bins = None if trial % 2 else int(rng.integers(1, 12))
        capacity = int(rng.integers(50, 2000))
        assert packing.best_fit_decreasing(sizes, capacity, bins).tolist() == plain_best_fit(sizes, capacity, bins)


def check(rows, texts):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(x.slot for x in own) == list(range(len(own))) for own in by.values())
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
    return {s: sum(x.size for x in own) for s, own in by.items()}


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in D.documents(spark, sf).collect()}
    rows = queries.QUERIES["op5_sharding"](spark, sf).collect()
    check(rows, docs.values())
    shards, sizes = {}, {}
    for r in rows:
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
        shards.setdefault(docs[r.doc_id], set()).add(r.shard)
        sizes[docs[r.doc_id]] = sizes.get(docs[r.doc_id], 0) + r.size
    capacity = sum(sizes.values()) / 40
    assert all(len(s) == 1 or sizes[t] > capacity for t, s in shards.items())


def test_sizes_are_near_equal_even_with_a_hot_group(spark):
    rows = [(k, "one text of many" if k % 3 else f"text {k} " * (k % 40)) for k in range(5000)]
    got = packing.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=10, fineness=20).collect()
    sizes = check(got, [t for _, t in rows])
    assert len(sizes) == 10 and max(sizes.values()) <= 1.06 * min(sizes.values())


def test_odd_rows(spark):
    check(packing.shard(D.odd(spark)).collect(), [r[1] for r in D.ROWS])
    assert packing.shard(D.empty(spark)).collect() == []
