"""Grouped operators, with one group holding most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecohort.operators import aggregates as G
from wavecohort.operators import cleaning as C
from wavecohort.operators import folds as K
from wavecohort.operators import metrics as M
from wavecohort.operators import ordered as O
from wavecohort.plans import cv


def skewed(spark, n=5000):
    """Group 0 holds nine tenths of the rows."""
    return spark.range(n).select(
        "id", F.when(F.col("id") % 10 < 9, F.lit(0)).otherwise(F.col("id") % 7).cast("long").alias("g"),
        (F.pmod(F.xxhash64("id"), F.lit(997)) / 7.0).alias("v"))


def test_hash_rank_is_a_permutation_in_hash_order(spark):
    got = O.hash_rank(skewed(spark), ["g"], F.col("id"), ["id"], totals=True).toPandas()
    import hashlib
    got["h"] = [hashlib.md5(str(i).encode()).hexdigest() for i in got["id"]]
    for _, part in got.groupby("g"):
        part = part.sort_values(["h", "id"])
        assert list(part["rn"]) == list(range(1, len(part) + 1)) and set(part["rn_total"]) == {len(part)}


def test_row_rank_and_value_ranks(spark):
    df = skewed(spark)
    local = df.toPandas()
    got = O.row_rank(df, ["g"], "v", ["id"]).toPandas().sort_values("id")
    want = local.sort_values(["v", "id"]).groupby("g").cumcount().sort_index() + 1
    assert list(got["rn"]) == list(want)
    ranks = O.value_ranks(df, ["g"], "v").toPandas().set_index(["g", "v"])
    for (g, v), r in ranks.sample(50, random_state=1).iterrows():
        part = local[local.g == g]["v"]
        assert r["below"] == (part < v).sum() and r["cnt"] == (part == v).sum() and r["n"] == len(part)


def test_median_with_skew_nan_and_few_rows(spark):
    df = skewed(spark)
    got = {r.g: r.median for r in O.group_median(df, ["g"], "v").collect()}
    want = df.toPandas().groupby("g")["v"].median()
    assert got == pytest.approx(want.to_dict())
    small = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 1.0), (2, float("nan")), (3, 4.0)], "g long, v double")
    got = {r.g: r.median for r in O.group_median(small, ["g"], "v").collect()}
    assert got[1] == 6 and np.isnan(got[2]) and got[3] == 4


def test_trimmed_mean(spark):
    x = np.random.default_rng(1).normal(size=(41, 3))
    df = spark.createDataFrame([(0, [float(v) for v in r]) for r in x], "s long, features array<double>")
    got = {r.pos: r.value for r in G.trimmed_mean_points(df, ["s"], 0.1).collect()}
    for p in range(3):
        s = np.sort(x[:, p])
        assert got[p] == pytest.approx(s[4:37].mean())


def test_order_statistics_are_the_same_in_one_task_and_by_points(spark):
    rng = np.random.default_rng(4)
    nan, inf = float("nan"), float("inf")
    rows = [(k, [float(v) for v in np.round(rng.normal(size=5), 1)]) for k in [1] * 40 + [2] * 7 + [None] * 2]
    rows += [(3, [1.0, nan, 2.0]), (3, [4.0, inf, 2.0]), (3, [5.0, 1.0]), (4, [7.0, nan]), (5, None), (5, [3.0, None]), (6, [])]
    df = spark.createDataFrame(rows, "k long, features array<double>").repartition(3)

    def cells(out, value):
        return sorted((repr(r.k), r.pos, repr(None if r[value] is None else round(r[value], 9))) for r in out.collect())

    for run, value in [(G.median_points, "median"), (G.mean_or_median_points, "value"),
                       (lambda d, k, **kw: G.trimmed_mean_points(d, k, 0.1, **kw), "value")]:
        whole = cells(run(df, ["k"]), value)
        # with one row as the limit only single signals stay in a task; with five, small and large keys are mixed
        assert whole and whole == cells(run(df, ["k"], gather=1), value) == cells(run(df, ["k"], gather=5), value)
    medians = {r.k: r.median_signal for r in G.median_signal(df, ["k"]).collect()}
    assert medians[1] == pytest.approx(np.median([r[1] for r in rows if r[0] == 1], axis=0))
    assert medians[3][0] == 4 and np.isnan(medians[3][1]) and medians[3][2] == 2 and np.isnan(medians[5][1])
    assert None in medians and G.median_signal(df.limit(0), ["k"]).count() == 0


def test_dedup_keeps_lowest_session(spark):
    rows = [("DD004", p, f"DD004-T001-S{s}_x.mat") for s in (25, 11) for p in "abc"]
    rows += [("DD007", p, f"DD007-T001-S{s}_x.mat") for s in (18, 4) for p in "abc"] + [("DD009", "a", "plain.mat")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, probe string, position string, f string")
    out = C.dedup_lowest_session(df, "probe", "position", "f", ["i"]).collect()
    assert len(out) == 7 and {r.session for r in out} == {11, 4, 2147483647}


def test_folds(spark):
    rows = [(g * 10 + s, g, 1 if g < 8 else 2) for g in range(12) for s in range(3)]
    df = spark.createDataFrame(rows, "sample_id long, group_id long, label long")
    folds = K.stratified_group_folds(df, "group_id", "label", 3, 2, 42)
    local = folds.toPandas()
    assert len(local) == 24
    for _, part in local.groupby(["repeat", "fold"]):
        assert set(part["label"]) == {1, 2} and part["group_id"].is_unique
    for _, part in local.groupby("repeat"):
        assert set(part["group_id"]) == set(range(12))
    assert folds.exceptAll(K.stratified_group_folds(df, "group_id", "label", 3, 2, 42)).count() == 0
    assert folds.exceptAll(K.stratified_group_folds(df, "group_id", "label", 3, 2, 43)).count() > 0
    first, second = (local[local["repeat"] == r].set_index("group_id")["fold"].sort_index() for r in (1, 2))
    assert (first != second).any()
    sizes = K.fold_sizes(df, folds, "group_id", 3).collect()
    assert all(r.n_train + r.n_test == 36 and r.n_train_groups + r.n_test_groups == 12 for r in sizes)
    rows = cv.with_folds(df, folds, "group_id", 2)
    assert cv.fold_leaks(rows, "group_id", 1, 2).count() == 0
    with pytest.raises(ValueError):
        K.stratified_group_folds(df, "group_id", "label", 1)


def test_folds_with_fewer_groups_than_folds(spark):
    df = spark.createDataFrame([(g, 1) for g in range(3)], "group_id long, label long")
    assert {r.fold for r in K.folds_remainder_last(df, "group_id", "label", 5).collect()} == {5}
    missing = K.folds_missing_class(K.folds_remainder_last(df, "group_id", "label", 5), "label", [1, 3], 5).collect()
    assert (5, 1) in {(r.fold, r.label) for r in missing} and sum(r.label == 3 for r in missing) == 5


def test_leakage_guard(spark):
    a = spark.createDataFrame([(1,), (2,)], "g long")
    b = spark.createDataFrame([(2,), (3,)], "g long")
    with pytest.raises(ValueError, match="both"):
        K.leakage_guard(a, b, "g")
    K.leakage_guard(a, b.where("g = 3"), "g")


def test_whole_groups_in_balanced_split(spark):
    rows = [(f"g{i}", i % 2, ["mal", "ben", "int"][i % 3]) for i in range(60) for _ in range(i % 4 + 1)]
    df = spark.createDataFrame(rows, "g string, label long, cluster string")
    out = K.balanced_group_split(df, "g", "label", "cluster", {"mal": "train", "ben": "test"}, 0.7).toPandas()
    assert out["g"].is_unique and len(out) == 60
    by = {r.g: r.cluster for r in df.distinct().collect()}
    assert all(s == "train" for g, s in zip(out.g, out.split) if by[g] == "mal")
    assert all(s == "test" for g, s in zip(out.g, out.split) if by[g] == "ben")


def test_outlier_flags_keep_everything_on_mismatch(spark):
    s = spark.createDataFrame([(p, i) for p in "ab" for i in range(3)] + [("c", 0)], "probe string, pos long")
    f = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("a", 2, False), ("b", 0, True)], "probe string, pos long, bad boolean")
    got = {(r.probe, r.pos) for r in C.join_outlier_flags(s, f, "probe", "pos", "bad").collect()}
    assert got == {("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2), ("c", 0)}


def test_mean_median_fallback(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, inf]), (1, [8.0, 4.0])], "s long, features array<double>")
    got = {r.pos: r.value for r in G.mean_or_median_points(df, ["s"]).collect()}
    assert got == {0: 4.0, 1: 3.0}


def test_null_is_a_group_like_any_other(spark):
    rows = [(None if k % 4 == 0 else f"g{k % 4}", float(k % 17)) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in O.group_median(df, ["g"], "v", "m").collect()}
    assert got == {g: float(np.median([v for h, v in rows if h == g])) for g in {g for g, _ in rows}}
    ranked = O.hash_rank(df.withColumn("id", F.monotonically_increasing_id()), ["g"], F.col("id"), ["id"])
    assert ranked.count() == 200 and ranked.where("g IS NULL").agg(F.max("rn")).head()[0] == 50
    folds = K.stratified_group_folds(df.withColumn("y", F.lit(1)), "g", "y", 2, 2)
    assert cv.with_folds(df, folds, "g", 2).count() == 200


def test_a_group_without_a_declared_label_has_none(spark):
    df = spark.createDataFrame([("a", 7), ("a", 7), ("b", 1), ("b", 7), ("c", None)], "g string, y long")
    got = {r.g: r.y for r in df.groupBy("g").agg(M.majority("y", [1, 3]).alias("y")).collect()}
    assert got == {"a": None, "b": 1, "c": None}


def test_groups_with_mixed_labels_are_placed_once(spark):
    rows = [(f"g{k % 30}", (k * 7 + k // 30) % 2, "free") for k in range(300)]
    df = spark.createDataFrame(rows, "g string, y int, cluster string")
    got = K.balanced_group_split(df, "g", "y", "cluster", {"held": "test"}).collect()
    assert len(got) == 30 and len({r.g for r in got}) == 30 and sum(r.n for r in got) == 300
    assert {r.split for r in got} == {"train", "test"}
