"""Worked examples with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecohort.operators import metrics as M
from wavecohort.operators import summary as S


def preds(spark, true, pred, scores=None, groups=None):
    rows = [(i, int(t), int(p), float(s), int(g)) for i, (t, p, s, g) in enumerate(
        zip(true, pred, scores or [0.5] * len(true), groups or [0] * len(true)))]
    df = spark.createDataFrame(rows, "id long, y_true long, y_pred long, score double, group_id long")
    return df.withColumn("scores", F.array(1.0 - F.col("score"), F.col("score")))


def one(df):
    return df.collect()[0].asDict()


def test_binary(spark):
    df = preds(spark, "11112222", "11122221", [.1, .2, .3, .6, .8, .9, .7, .4])
    got = one(M.evaluate(df, [], [1, 2]))
    assert got["accuracy"] == .75
    for m in ("macro_sensitivity", "macro_specificity", "macro_precision", "macro_f1"):
        assert got[m] == pytest.approx(.75)
    assert got["auc"] == pytest.approx(.9375)


def test_three_classes(spark):
    df = preds(spark, "111222333", "112221333")
    macro = one(M.macro_metrics(M.per_class_metrics(df, [], [1, 2, 3]), []))
    assert one(M.accuracy(df, []))["accuracy"] == pytest.approx(7 / 9)
    assert macro["macro_sensitivity"] == pytest.approx(7 / 9)
    assert macro["macro_specificity"] == pytest.approx(8 / 9)
    assert macro["macro_f1"] == pytest.approx(7 / 9)
    assert M.confusion_long(df, [], [1, 2, 3]).count() == 9


def test_perfect(spark):
    df = preds(spark, "112233", "112233")
    macro = one(M.macro_metrics(M.per_class_metrics(df, [], [1, 2, 3]), []))
    assert one(M.accuracy(df, []))["accuracy"] == 1 and macro["macro_f1"] == 1 and macro["macro_sensitivity"] == 1


def test_confusion(spark):
    df = preds(spark, "111222", "112122")
    got = {(r.true_class, r.pred_class): r.n for r in M.confusion_long(df, [], [1, 2]).collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (2, 1): 1, (2, 2): 2}


def test_vote(spark):
    df = preds(spark, "111222", "112112", groups=[1, 1, 1, 2, 2, 2])
    rolled = M.group_rollup(df, [], "group_id", [1, 2])
    assert rolled.count() == 2 and one(M.accuracy(rolled, []))["accuracy"] == .5


def test_auc_separable_and_one_sided(spark):
    assert one(M.auc_binary(preds(spark, "111222", "111222", [.1, .2, .3, .9, .8, .7]), [], 2))["auc"] == 1
    assert one(M.auc_binary(preds(spark, "111", "111", [.1, .2, .3]), [], 2))["auc"] is None


def test_one_predicted_class(spark):
    df = preds(spark, "112233", "111111")
    macro = one(M.macro_metrics(M.per_class_metrics(df, [], [1, 2, 3]), []))
    assert macro["macro_sensitivity"] == pytest.approx(1 / 3)
    assert macro["macro_specificity"] == pytest.approx(2 / 3)
    assert macro["macro_precision"] == pytest.approx(1 / 3)
    assert macro["macro_f1"] == pytest.approx(.5)
    got = one(M.count_metrics(df, [], [1, 2, 3]))
    assert got["macro_f1"] == pytest.approx(.5) and got["macro_precision"] == pytest.approx(1 / 3)


def test_ties(spark):
    df = preds(spark, "1111122222", "1111222221", [.1] * 4 + [.9] * 5 + [.4], [1, 1, 1, 2, 2, 2, 3, 3, 4, 4])
    assert one(M.evaluate(df, [], [1, 2]))["accuracy"] == pytest.approx(.8)
    assert one(M.auc_binary(df, [], 2))["auc"] == pytest.approx(.88)
    rolled = M.group_rollup(df, [], "group_id", [1, 2])
    assert {r.group_id: r.y_pred for r in rolled.collect()} == {1: 1, 2: 2, 3: 2, 4: 1}
    got = one(M.evaluate(rolled, [], [1, 2]))
    assert got["accuracy"] == pytest.approx(.5) and got["auc"] == pytest.approx(1.0)


def test_auc_matches_pairs_when_scores_are_all_distinct(spark):
    n = 3000
    df = spark.range(n).select(
        F.col("id").alias("id"), (F.hash("id") % 2 == 0).alias("pos"),
        (F.xxhash64("id") / F.lit(2.0 ** 62) + F.hash("id") % 2).alias("s"))
    rows = df.collect()
    pos, neg = [r.s for r in rows if r.pos], [r.s for r in rows if not r.pos]
    want = sum((p > q) + .5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert one(M.auc(df, [], "s", F.col("pos")))["auc"] == pytest.approx(want, abs=1e-12)


def test_best_configuration_takes_first_on_ties_and_skips_missing(spark):
    rows = [("B", "X", .9), ("A", "Y", .9), ("A", "X", None), ("A", "Z", float("nan")), ("B", "Y", .1)]
    df = spark.createDataFrame(rows, "recipe string, classifier string, m double")
    best = one(S.best_configuration(df, "m", ["A", "B"], ["X", "Y", "Z"]))
    assert (best["recipe"], best["classifier"]) == ("A", "Y")


def test_bootstrap_weights_have_mean_and_variance_one(spark):
    df = spark.range(4000)
    w = M.bootstrap_weights(df, ["id"], 5).groupBy("replicate").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") ** 2).alias("q"))
    rows = w.collect()
    assert len(rows) == 5
    for r in rows:
        mean = r.s / 4000
        assert abs(mean - 1) < .08 and abs(r.q / 4000 - mean ** 2 - 1) < .15


def test_vote_tie_uses_mean_probability(spark):
    df = preds(spark, "11", "13", [.2, .6], [7, 7])
    got = one(M.vote_rollup(df, [], "group_id"))
    assert got["pred_label"] == 1 and got["confidence"] == .5
    df = preds(spark, "33", "13", [.45, .9], [7, 7])
    assert one(M.vote_rollup(df, [], "group_id"))["pred_label"] == 3


@pytest.mark.parametrize("partitions", [1, 7])
def test_replicates_equal_weighted_auc(spark, partitions):
    """Vectors over ranges give what one weighted AUC for each replicate gives; ties, nulls and NaN included."""
    rng = np.random.default_rng(4)
    s = [None if k % 17 == 0 else float("nan") if k % 29 == 0 else float(rng.integers(0, 12)) if k % 3 else 5.0 for k in range(400)]
    rows = [(k, None if k % 41 == 0 else bool(rng.random() < 0.4), v) for k, v in enumerate(s)]
    df = spark.createDataFrame(rows, "id long, hit boolean, s double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r.replicate: r.auc for r in M.auc_replicates(df, ["id"], "s", F.col("hit"), 9).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    plain = M.auc(M.bootstrap_weights(df, ["id"], 9), ["replicate"], "s", F.col("hit"), weight=F.col("weight").cast("double"))
    want = {r.replicate: r.auc for r in plain.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_replicates_of_one_class_or_no_rows(spark):
    df = spark.createDataFrame([(k, True, 1.0) for k in range(5)], "id long, hit boolean, s double")
    assert {r.auc for r in M.auc_replicates(df, ["id"], "s", F.col("hit"), 4).collect()} == {None}
    assert M.auc_replicates(df.limit(0), ["id"], "s", F.col("hit"), 4).collect() == []


def test_equal_means_tie_in_any_order(spark):
    """Scores whose floating sums fall on either side of one half."""
    scores = [k / 100 * 10 for k in (7, 3, 6, 4, 8, 2, 1, 9, 0, 10, 3, 7)]
    orders = [np.random.default_rng(g).permutation(scores).tolist() for g in range(12)]
    flat = [(g, 3, s) for g, own in enumerate(orders) for s in own] + [(12, 3, 0.500000001), (13, 3, float("nan")), (13, 3, 1.0), (14, 3, None)]
    df = spark.createDataFrame(flat, "group_id long, y_true long, score double").coalesce(1)
    got = {r.group_id: r.y_pred for r in M.mean_posterior_rollup(df, [], "group_id").collect()}
    assert {g for g, p in got.items() if p == 3} == {12}
    rounded = M.mean_posterior_rollup(df, [], "group_id", exact=False).where("group_id < 12 and y_pred = 3")
    assert rounded.count() > 0
