import zlib

import numpy as np

from tests.llm import fixtures as D
from wavecohort.llm import quality, queries


def test_query_finds_bad_text_without_seeing_its_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op10_quality_classifier"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == D.documents(spark, sf).count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    assert (good[:, None] > bad).mean() > 0.97
    assert (good >= 0.3).mean() > 0.97 and (bad < 0.3).mean() > 0.7


def test_the_class_prior_is_recovered(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(3000):
        junk = rng.random() < 0.3
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(30)]
        rows.append((k, " ".join(w.upper() + "!!" if junk else w for w in words), junk))
    df = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    known = spark.createDataFrame([(k,) for k, _, junk in rows if not junk and k % 3 == 0], "doc_id long")
    weights, prior = quality.fit(df, known)
    assert abs(prior - 0.7) < 0.05
    score = {r.doc_id: r.score for r in quality.score(df, weights).collect()}
    assert np.mean([(score[k] < 0.3) == junk for k, _, junk in rows]) > 0.98


def test_odd_rows(spark):
    df = D.odd(spark)
    scored = quality.score(df, np.zeros(quality.WIDTH))
    assert set(scored.columns) == set(df.columns) and {r.score for r in scored.collect()} == {0.5}
    known = spark.createDataFrame([(1,), (1,), (None,), (999,), (8,)], "doc_id long")
    weights, _ = quality.fit(df, known)
    assert np.isfinite(weights).all()
    rows = quality.score(df, weights).collect()
    assert len(rows) == len(D.ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(D.empty(spark), weights).collect() == []
    assert quality.fit(D.empty(spark), known)[1] == quality.START_PRIOR
    assert not quality.fit(df, known.limit(0))[0].any()


def test_features_are_finite_and_bounded():
    x = quality._features_of(__import__("pyarrow").array(["", " ", "A!!", "x" * 100_000, D.LONG, "\n\n\n", "é" * 10]))
    assert np.isfinite(x).all() and abs(x).max() <= 10 and (x[:2, 12:] == 0).all()
