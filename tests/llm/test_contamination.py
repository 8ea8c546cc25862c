import re
from itertools import combinations

import numpy as np

from tests.llm import fixtures as D
from wavecohort.llm import contamination, queries

TOKEN = re.compile("[a-z0-9\u0080-\U0010ffff]+")


def brute(docs, items):
    """(doc, item) with 13 aligned tokens of which 11 agree; shorter items whole."""
    found = set()
    for j, q in items:
        q = TOKEN.findall((q or "").lower())
        span = min(13, len(q))
        if len(q) < 5:
            continue
        for i, t in docs:
            w = TOKEN.findall((t or "").lower())
            for p in range(-len(q) + 1, len(w)):
                low, high = max(0, -p), min(len(q), len(w) - p)
                if high - low < span:
                    continue
                c = np.concatenate([[0], np.cumsum([w[p + k] == q[k] for k in range(low, high)])])
                if (c[span:] - c[:-span]).max() >= (11 if len(q) >= 13 else span):
                    found.add((i, j))
                    break
    return found


def test_masks_hit_every_window_with_two_substitutions():
    for gone in combinations(range(contamination.WINDOW), contamination.WINDOW - contamination.LEAST):
        assert any(
            not any(m[g - s] == "1" for g in gone if 0 <= g - s < len(m))
            for m in contamination.MASKS for s in range(contamination.WINDOW - len(m) + 1))


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in D.documents(spark, sf).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = queries.QUERIES["op6_benchmark_decontamination"](spark, sf).collect()
    keys = [(r.doc_id, r.item_id) for r in got]
    assert len(keys) == len(set(keys)) and set(keys) == brute(docs, items)


def test_substitutions_short_items_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    words = [f"q{k}" for k in range(40)]
    items = [(1, " ".join(words[:20])), (2, "Five words, that match whole"), (3, "too short"), (4, None), (5, ""), (6, " ".join(words[25:38]))]
    docs = [(r[0], r[1]) for r in D.ROWS if r[0] is not None]
    for k in range(40):
        own = words[:20] if k % 2 else words[25:38]
        for at in rng.choice(len(own), int(rng.integers(0, 6)), replace=False):
            own = own[:at] + ["zz"] + own[at + 1:]
        docs.append((100 + k, "Lead in: " + " ".join(own).upper() + ". And out."))
    docs += [(200, "five words that MATCH whole!"), (201, "five words that match whol"), (202, "too short")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1_000_000, 10):
        got = {(r.doc_id, r.item_id) for r in contamination.overlaps(df, bench, limit=limit).collect()}
        assert got == brute(docs, items)
    odd = D.odd(spark)
    assert contamination.clean(odd, bench).collect() == odd.collect()
    assert {r.doc_id for r in contamination.clean(df, bench, limit=10).collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert contamination.overlaps(D.empty(spark), bench).collect() == [] and contamination.overlaps(df, bench.limit(0)).collect() == []
