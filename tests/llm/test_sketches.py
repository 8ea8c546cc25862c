import hashlib

import numpy as np

from tests.llm import fixtures as D
from wavecohort.llm import queries, sketches


def shingles(t):
    w = (t or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expect(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        n = len(t) // 2
        after = rows[(k + 1) % len(rows)][1]
        out.append((i, len(t), hashlib.sha256((t[:len(t) - n] + after[:n]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in D.documents(spark, sf).collect()}
    rows = queries.QUERIES["op9_fingerprints"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=str) == expect(texts.items())
    ids = sorted(texts)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    error = []
    for r in rows:
        t, n = texts[r.doc_id], len(texts[r.doc_id]) // 2
        a, b = shingles(t), shingles(t[:len(t) - n] + texts[after[r.doc_id]][:n])
        if len(a) > 500:
            error.append(r.near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.08
    same = {}
    for r in rows:
        same.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in same.values())


def test_odd_rows(spark):
    got = sketches.compared(D.odd(spark)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == expect([(r[0], r[1]) for r in D.ROWS])
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert all((r.fingerprint == "") == (not shingles(next(x[1] for x in D.ROWS if x[0] == r.doc_id))) for r in got if r.doc_id)
    assert sketches.compared(D.empty(spark)).collect() == [] and len(sketches.compared(D.odd(spark).limit(1)).collect()) == 1
    general = {r.doc_id: r.sketch for r in sketches.fingerprints(D.odd(spark)).collect()}
    assert general[6] == general[7] and general[4] == []


def test_merge_and_containment():
    parts = [" ".join(f"a{k}" for k in range(3000)).encode(), " ".join(f"b{k}" for k in range(400)).encode()]
    a, b = sketches.sketches_of(parts)
    whole, = sketches.sketches_of([parts[0] + b" " + parts[1]])
    union = sketches.merge(a, b)
    assert len(np.setdiff1d(union, whole)) == 0 and len(np.setdiff1d(whole, union)) <= 4
    assert sketches.containment(b, whole) == 1 and sketches.containment(whole, b) < 0.3
    empty = sketches.sketches_of([b""])[0]
    assert sketches.likeness(empty, empty) == 1 and sketches.likeness(a, empty) == 0
