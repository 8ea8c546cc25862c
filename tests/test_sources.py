"""Readers, writers, guards and the clean-up plan."""

import pytest
from pyspark.sql import functions as F

from wavecohort.functions import labels as L
from wavecohort.operators import sets as S
from wavecohort.plans import prepare, recipes
from wavecohort.sources import sinks, tables


def samples(spark):
    rows = [(1, "p1", "WHO-1", [[1.0] * 12, [3.0] * 12]), (2, "p2", "WHO-3", [[2.0] * 12])]
    return spark.createDataFrame(rows, "uid long, Patient_ID string, WHO_Grade string, RawSpectra array<array<double>>")


def test_load_and_round_trip(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.sink_clean_table(samples(spark), path)
    with pytest.raises(Exception):
        sinks.sink_clean_table(samples(spark), path)
    got = {r.uid: r for r in tables.scan_samples(spark, path).collect()}
    assert got[1].features == [2.0] * 12 and got[1].group_id == "p1" and got[2].label == "WHO-3"
    assert tables.scan_samples(spark, path, method="median").count() == 2
    with pytest.raises(ValueError):
        tables.scan_samples(spark, path, method="mode")


def test_column_priority(spark):
    df = samples(spark).withColumn("MeanRawSpectrum", F.col("RawSpectra")[0])
    assert tables.resolve_columns(df).schema["spectra"].dataType.simpleString() == "array<array<double>>"
    assert tables.load_samples(df, "MeanRawSpectrum").head().features == [1.0] * 12
    old = samples(spark).withColumnRenamed("RawSpectra", "CombinedRawSpectra")
    with pytest.warns(DeprecationWarning):
        tables.resolve_columns(old)
    with pytest.raises(ValueError, match="spectra"):
        tables.resolve_columns(samples(spark).drop("RawSpectra"))
    with pytest.raises(ValueError):
        tables.guard_columns(old)
    with pytest.raises(ValueError, match="earlier layout"):
        tables.guard_columns(samples(spark).withColumn("MeanSpectrum_PP1", F.lit(1)))
    tables.guard_columns(samples(spark))


def test_split_loading(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "group_id long, v string")
    b = spark.createDataFrame([(2, "y")], "group_id long, v string")
    a.write.parquet(str(tmp_path / "train"))
    b.write.parquet(str(tmp_path / "test"))
    assert {r.split for r in tables.scan_split(spark, str(tmp_path)).collect()} == {"train", "test"}
    with pytest.raises(ValueError, match="both"):
        tables.load_split(a, a)


def test_label_texts(spark):
    rows = ["WHO-1 (94)", "who-3", "2", "3.0", " WHO-2 ", "4", "", None, "13", "WHO-10"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, t string").orderBy("i")
    got = [r.g for r in df.select(L.norm_grade(F.col("t")).alias("g")).collect()]
    assert got == ["WHO-1", "WHO-3", "WHO-2", "WHO-3", "WHO-2", "", "", "", "", ""]
    assert [r.g for r in df.select(L.label_from_text(F.col("t")).alias("g")).collect()][:3] == [1, 3, None]
    assert df.where("t = '13'").select(L.label_from_text(F.col("t")).alias("g")).head().g == 1
    names = spark.createDataFrame([(t,) for t in [" fibromatös ", "NAN", "<Missing>", None, "other"]], "t string")
    assert [r.s for r in names.select(L.map_subtype(F.col("t")).alias("s")).collect()] == ["fibro", "Unknown", "Unknown", "Unknown", "other"]


def test_model_parameters_survive_storage(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 7.0],)], "features array<double>")
    fitted = recipes.recipe_fit(df, "10200X")
    sinks.sink_model_params(fitted.to_row(spark), str(tmp_path / "p"))
    assert recipes.FittedRecipe.from_row(spark.read.parquet(str(tmp_path / "p"))) == fitted


def test_split_counts(spark):
    df = spark.createDataFrame([("train", 1), ("train", 1), ("test", 2)], "split string, g long")
    counts = S.split_counts(df, "split", "g")
    expected = spark.createDataFrame([(1, 1, 2, 2)], "train_groups long, test_groups long, train_count long, test_count long")
    r = S.split_count_check(counts, expected).head()
    assert r.train_groups_ok and r.train_count_ok and not r.test_count_ok


def test_prepare(spark):
    sp = [[float(j % 5 + i) for j in range(44)] for i in range(2)]
    rows = [("P1", "a", "P1-S2_a.mat", 0, sp), ("P1", "a", "P1-S1_a.mat", 1, sp), ("P2", "a", "P2-S1_a.mat", 2, sp), ("P9", "a", "x", 3, sp)]
    pos = spark.createDataFrame(rows, "probe string, position string, f string, row_id long, spectra array<array<double>>")
    meta = spark.createDataFrame([(" P1 ", "WHO-1 (3)", "w", "klarzellig"), ("P2", "3", "m", "")], "key string, g string, s string, t string")
    meta = prepare.clean_metadata(meta, "g", "s", "t")
    out = prepare.prepare_signals(pos, meta, "probe", "position", "f", "row_id", "key").collect()
    assert len(out) == 4 and {r.session for r in out} == {1}
    assert {(r.probe, r.grade, r.sex, r.subtype) for r in out} == {("P1", "WHO-1", "Female", "clear"), ("P2", "WHO-3", "Male", "Unknown")}
    assert len(out[0].pp1) == 44 and len(out[0].pp2) == 11


def test_row_local_operators_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i + j) for j in range(12)]) for i in range(20)], "signal_id long, features array<double>")
    df.write.parquet(str(tmp_path / "in"))
    fitted = recipes.recipe_fit(df, "21210X")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = fitted.transform(stream).writeStream.format("memory").queryName("transformed").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {r.signal_id: r.features for r in fitted.transform(df).collect()}
    got = {r.signal_id: r.features for r in spark.table("transformed").collect()}
    assert got == want
