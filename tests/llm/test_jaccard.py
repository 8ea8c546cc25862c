import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm import fixtures as D
from wavecohort.llm import jaccard, simhash


def shingle_set(t):
    parts = [w for w in re.split(r"[ \t-\r]+", (t or "").lower()) if w]
    k = min(5, len(parts))
    return {tuple(parts[i:i + k]) for i in range(len(parts) - k + 1)} if parts else set()


def pairs(rows):
    """(i, j, similarity) of every two rows."""
    sets = [shingle_set(t) for _, t in rows]
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(a & sets[j])
            yield i, j, both / (len(a) + len(sets[j]) - both) if a or sets[j] else 1.0


def kept(rows):
    root = D.groups_of([(i, j) for i, j, s in pairs(rows) if s >= 0.8 - 1e-9], range(len(rows)))
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root[k], []).append(rows[k][0])
    return sorted(min(i for i in g if i is not None) if any(i is not None for i in g) else -1 for g in groups.values())


def copies(seed=5, texts=40, words=300):
    """Texts with copies whose changed words leave similarities from 0.7 to 0.99."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(texts):
        base = [f"w{x}" for x in rng.integers(0, 5000, words)]
        for n in (0, 1, 3, 5, 6, 7, 9):
            t = list(base)
            for p in rng.choice(words, n, replace=False):
                t[p] = f"new{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(t)))
    return rows


def test_stage_keeps_one_of_all_pairs_from_0_8(spark, sf):
    rows = copies()
    assert any(0.8 <= s < 0.85 for *_, s in pairs(rows)) and any(0.7 < s < 0.8 for *_, s in pairs(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, df, sf).collect()) == kept(rows)


def test_documents_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in D.documents(spark, sf).collect()]
    assert sorted(r.doc_id for r in jaccard.representatives(D.documents(spark, sf)).collect()) == kept(rows)


def test_odd_rows(spark):
    got = jaccard.representatives(D.odd(spark))
    assert got.dtypes == D.odd(spark).dtypes
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == kept([(r[0], r[1]) for r in D.ROWS])
    assert jaccard.representatives(D.empty(spark)).collect() == []


@pytest.mark.parametrize("distance", [1, 4, 6])
def test_tries_link_all_pairs_at_any_distance(spark, distance):
    rng = np.random.default_rng(distance)
    values = []
    for _ in range(60):
        v = int(rng.integers(0, 2**63))
        low = int(rng.integers(0, distance + 1))
        flips = [*rng.choice(32, low, replace=False), *(32 + rng.choice(32, distance - low, replace=False))]
        values += [v, v ^ sum(1 << int(k) for k in flips)]
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, distance).collect()
    assert {frozenset((r.a, r.b)) for r in got} == {frozenset(p) for p in zip(signed[::2], signed[1::2])}


def test_parities_keep_every_similar_pair_and_blocks_meet_all(spark, monkeypatch):
    """A band of many texts that are not similar: few pairs leave the tasks, and every similar one is among them."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 500, 120)
    texts = []
    for _ in range(60):
        t = base.copy()
        at = rng.choice(120, rng.integers(0, 9), replace=False)
        t[at] = rng.integers(0, 500, len(at))
        texts.append(" ".join(f"w{v}" for v in t))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = jaccard.banded(docs, "text").dropDuplicates(["fp"])
    sets = {t: set(s.tolist()) for t, s in zip(texts, jaccard._sets(pa.array(texts)))}
    name = {t: r.fp for t, r in zip(texts, jaccard.named(docs.coalesce(1), ["text"]).collect())}
    alike = {tuple(sorted((name[x], name[y]))) for x in texts for y in texts
             if name[x] < name[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])}
    assert {r.n for r in rows.collect()} <= {len(v) for v in sets.values()}
    monkeypatch.setattr(jaccard, "MEMBERS", 16)
    members = rows.selectExpr("1L AS key", "60L AS size", "fp", "fp AS root", "n", "bits")
    met = {(r.a, r.b) for r in jaccard.met_in_blocks(members, 0.8).collect()}
    assert alike and alike <= met and len(met) < len(name) * (len(name) - 1) / 4
    pairs = spark.createDataFrame([tuple(sorted((a, b))) for a in name.values() for b in name.values() if a < b], "a long, b long")
    assert {(r.a, r.b) for r in jaccard.possible(pairs, rows, 0.8).collect()} == met
