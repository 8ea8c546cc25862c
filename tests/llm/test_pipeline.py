import numpy as np
import pytest

import corpus_pipeline
from tests.llm import fixtures as D
from tests.llm.test_contamination import brute as contaminated
from tests.llm.test_jaccard import kept
from tests.llm.test_mixing import count, plain_targets
from tests.llm.test_tokens import tokenizer, want  # noqa: F401
from wavecohort.llm.stored import stored


@pytest.fixture(scope="module")
def steps(spark, sf):
    """Rows before and after every stage."""
    docs = D.documents(spark, sf)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
        out.append(docs)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "simhash near-dedup", "benchmark decontamination", "source mixing", "token files"]
    assert all(s.dtypes == steps[0].dtypes for s in steps[:-1])


def test_classifier_keeps_good_documents(spark, sf, steps):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {i for i, _ in rows(steps[1])}
    good = [i for i, q in quality.items() if q]
    assert np.mean([i in kept for i in good]) > 0.97
    assert set(rows(steps[1])) <= set(rows(steps[0]))


def test_one_document_of_each_group_stays(steps):
    assert sorted(i for i, _ in rows(steps[2])) == kept(rows(steps[1]))


def test_contaminated_documents_go(spark, sf, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i, _ in contaminated(rows(steps[2]), items)}
    assert sorted(rows(steps[3])) == sorted(r for r in rows(steps[2]) if r[0] not in leaks)


def test_sources_meet_their_targets(steps):
    before, after = {}, {}
    for r in steps[3].collect():
        before[r.source] = before.get(r.source, 0) + count(r.text)
    for r in steps[4].collect():
        after[r.source] = after.get(r.source, 0) + count(r.text)
        assert r.n_chars == len(r.text)
    assert after == {s: round(t) for s, t in plain_targets(before).items() if round(t)}


def test_token_rows(steps, tokenizer):  # noqa: F811
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in steps[5].collect()), key=lambda r: r[1])
    assert got == want(rows(steps[4]), tokenizer)
