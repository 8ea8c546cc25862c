import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests import oracle
from tests.llm import fixtures as D
from wavecohort.llm import merkle, queries


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(leaves):
    out = [list(leaves)]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k:k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    """(left, right) level by level."""
    pairs = []
    for level in tree[:-1]:
        run = i // 16 * 16
        pairs.append(("".join(level[run:i]), "".join(level[i + 1:run + 16])))
        i //= 16
    return pairs


def brute(rows):
    """rows: (doc_id, source, leaf)."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([r[2] for r in groups[s]]) for s in names]
    top = levels([t[-1][0] for t in trees])
    for k, s in enumerate(names):
        for i, (doc, _, leaf) in enumerate(groups[s]):
            yield doc, leaf, trees[k][-1][0], top[-1][0], siblings(trees[k], i) + siblings(top, k)


def fold(h, proof):
    for left, right in proof:
        h = H(left, h, right)
    return h


def documents(rows):
    """What the query returns for rows of (doc_id, source, lang, n_chars, text)."""
    own, changed = [], {}
    for d, s, lang, n, t in rows:
        leaf = H(*map(field, (d, s, lang, n, t)))
        low = t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        changed[(d, leaf)] = H(*map(field, (d, s, lang, n, low))) if hit else leaf
        own.append((d, s, leaf))
    for d, leaf, sub, root, proof in brute(own):
        end = fold(changed[(d, leaf)], proof)
        yield d, leaf, sub, root, H(*(a + b for a, b in proof)), end, end == root


def test_query_equals_brute_force(spark, sf):
    docs = D.documents(spark, sf)
    want = sorted(documents([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]), key=str)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
           for r in queries.QUERIES["op13_merkle_manifest"](spark, sf).collect()]
    assert sorted(got, key=str) == want
    assert {r[-1] for r in got} == {True, False}


def test_query_equals_sql(spark, sf):
    sql = queries.ORACLE["op13_merkle_manifest"]
    assert oracle.compare(queries.QUERIES["op13_merkle_manifest"](spark, sf), oracle.connect(sf), sql) == []


@pytest.mark.parametrize("sizes", [[1], [2], [16, 1], [17], [255, 256, 257], [4097, 3], [1] * 300])
def test_every_tree_shape(spark, sizes):
    rows = [(k * 10_000 + i, f"s{k}" if k else None, H(str((k, i)))) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").orderBy(F.rand(1))
    got = merkle.manifest(df, keep=["doc_id"]).withColumn("end", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in got) == sorted(brute(rows))
    assert {r.end for r in got} == {got[0].root}


def test_odd_rows(spark):
    df = D.odd(spark).withColumn("leaf", merkle.leaf([F.col(c) for c in queries.LEAF]))
    got = merkle.manifest(df, keep=["doc_id", "size"]).collect()
    want = list(brute([(r[0], r[3], H(*map(field, (r[0], r[3], r[2], r[4], r[1])))) for r in D.ROWS]))
    flat = lambda rows: sorted(map(str, rows))
    assert flat((r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof]) for r in got) == flat(want)
    assert merkle.manifest(df.limit(0), keep=["doc_id"]).collect() == []
