"""Queries on sources, sinks, scalars, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavecohort.catalog import views as V
from wavecohort.catalog.views import longs, r6, register, rounded
from wavecohort.functions import arrays as A
from wavecohort.functions import labels as L
from wavecohort.operators import aggregates as G
from wavecohort.operators import cleaning as C
from wavecohort.operators import folds as K
from wavecohort.operators import sets as S
from wavecohort.operators import summary as Y
from wavecohort.plans import cv
from wavecohort.session import scratch_path as scratch
from wavecohort.sources import sinks, tables


def raw_samples(spark, sf):
    """Sample rows with the column names of the source tables."""
    return V.positions(spark, sf).select(
        F.col("signal_id").alias("ProbeUID"), F.col("diss_id").alias("Patient_ID"), F.col("label").alias("WHO_Grade"),
        F.col("spectra").alias("RawSpectra"),
    )


def long_of(df, keys, features="features", out="value"):
    return df.select(*keys, F.posexplode(features).alias("pos", out)).withColumns(
        {"pos": F.col("pos").cast("long"), out: r6(out)})


# --- A: sources and sinks ------------------------------------------------------------

NESTED_MEAN = """SELECT signal_id AS "ProbeUID", label, diss_id AS group_id, CAST(i AS BIGINT) AS pos,
    round({agg}, 6) + 0.0 AS value
    FROM {{positions}}, range(0, 16) t(i), range(1, 5) u(k) GROUP BY ALL"""


@register("scan_samples", NESTED_MEAN.format(agg="avg(spectra[k][i+1])"))
def scan_samples(spark, sf):
    path = scratch(spark, "samples")
    sinks.sink_clean_table(raw_samples(spark, sf), path)
    return long_of(tables.scan_samples(spark, path), ["ProbeUID", "label", "group_id"])


@register("scan_samples_median", NESTED_MEAN.format(agg="median(spectra[k][i+1])"))
def scan_samples_median(spark, sf):
    return long_of(tables.load_samples(raw_samples(spark, sf), method="median"), ["ProbeUID", "label", "group_id"])


@register("scan_split", """SELECT split, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups,
    round(sum(price), 2) + 0.0 AS total FROM {split_orders} GROUP BY split""")
def scan_split(spark, sf):
    path = scratch(spark, "split")
    rows = V.split_orders(spark, sf)
    for side in ("train", "test"):
        sinks.sink_clean_table(rows.where(F.col("split") == side).drop("split"), f"{path}/{side}")
    return tables.scan_split(spark, path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("group_id").alias("n_groups"),
        (F.round(F.sum("price"), 2) + F.lit(0.0)).alias("total"))


@register("scan_csv_metrics", """SELECT l_suppkey AS supplier, count(*) AS n, round(avg(l_discount), 6) + 0.0 AS mean_discount
    FROM lineitem GROUP BY ALL""")
def scan_csv_metrics(spark, sf):
    path = scratch(spark, "metrics")
    m = V.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("l_discount")).alias("mean_discount"))
    m.write.csv(path, header=True, mode="errorifexists")
    return tables.scan_csv_metrics(spark, path, "supplier long, n long, mean_discount double")


@register("resolve_columns", "SELECT signal_id AS \"ProbeUID\", label, diss_id AS group_id, CAST(len(spectra) AS BIGINT) AS n_spectra FROM {positions}")
def resolve_columns(spark, sf):
    return tables.resolve_columns(raw_samples(spark, sf)).select(
        "ProbeUID", "label", "group_id", F.size("spectra").cast("long").alias("n_spectra"))


@register("guard_columns", "SELECT signal_id AS \"ProbeUID\", label AS \"WHO_Grade\" FROM {positions}")
def guard_columns(spark, sf):
    df = raw_samples(spark, sf)
    tables.guard_columns(df)
    return df.select("ProbeUID", "WHO_Grade")


@register("sink_predictions_csv", """SELECT order_id, line_no, group_id, y_true, y_pred, round(1-score, 6) + 0.0 AS score_1,
    round(score, 6) + 0.0 AS score_2 FROM {preds}""")
def sink_predictions_csv(spark, sf):
    path = scratch(spark, "preds")
    cols = ["order_id", "line_no", "group_id", "y_true", "y_pred", "scores"]
    sinks.sink_predictions_csv(V.preds(spark, sf).select(*cols), path, 2)
    schema = "order_id long, line_no long, group_id long, y_true long, y_pred long, score_1 double, score_2 double"
    return rounded(tables.scan_csv_metrics(spark, path, schema), "score_1", "score_2")


@register("sink_by_classifier", """SELECT classifier, y_true = y_pred AS correct, count(*) AS n,
    round(avg(greatest(score, 1-score)), 6) + 0.0 AS mean_confidence FROM {preds} GROUP BY ALL""")
def sink_by_classifier(spark, sf):
    path = scratch(spark, "by-classifier")
    sinks.sink_by_classifier(V.preds(spark, sf), path)
    return spark.read.parquet(path).groupBy("classifier", "correct").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("confidence")).alias("mean_confidence"))


@register("sink_clean_table", """SELECT signal_id AS "ProbeUID", diss_id AS "Patient_ID", label AS "WHO_Grade",
    round(list_sum(flatten(spectra)), 6) + 0.0 AS total FROM {positions}""")
def sink_clean_table(spark, sf):
    path = scratch(spark, "clean")
    sinks.sink_clean_table(raw_samples(spark, sf), path)
    return spark.read.parquet(path).select("ProbeUID", "Patient_ID", "WHO_Grade",
                                           r6(A.array_sum(F.flatten("RawSpectra"))).alias("total"))


# --- B: projections and scalars ------------------------------------------------------


@register("explode_signals", """SELECT signal_id, diss_id, label, CAST(k AS BIGINT) AS local_index,
    round(list_sum(spectra[k]), 6) + 0.0 AS total FROM {positions}, range(1, 5) t(k)""")
def explode_signals(spark, sf):
    rows = C.explode_signals(V.positions(spark, sf), "spectra", ["signal_id", "diss_id", "label"])
    return rows.select("signal_id", "diss_id", "label", "local_index", r6(A.array_sum(F.col("features"))).alias("total"))


@register("long_form", """SELECT signal_id, pos, axis, round(features[pos+1], 6) + 0.0 AS value
    FROM {signals}, {axis}""")
def long_form(spark, sf):
    return rounded(C.long_form(V.signals(spark, sf), V.AXIS, ["signal_id"]), "value")


@register("band_slice", """SELECT signal_id, count(*) AS n_points, round(min(features[pos+1]), 6) + 0.0 AS lowest,
    round(max(features[pos+1]), 6) + 0.0 AS highest, round(avg(features[pos+1]), 6) + 0.0 AS mean_value
    FROM {signals}, {axis} WHERE axis BETWEEN 1000 AND 1700 GROUP BY signal_id""")
def band_slice(spark, sf):
    band = A.band_values(F.col("features"), V.AXIS, (1000.0, 1700.0))
    return V.signals(spark, sf).select("signal_id", band.alias("b")).select(
        "signal_id", F.size("b").cast("long").alias("n_points"), r6(F.array_min("b")).alias("lowest"),
        r6(F.array_max("b")).alias("highest"), r6(A.array_mean(F.col("b"))).alias("mean_value"))


@register("rename_drop", """SELECT signal_id AS "ProbeUID", diss_id AS "Patient_ID", label AS "WHO_Grade",
    CAST(len(spectra) AS BIGINT) AS "RawSpectra" FROM {positions}""")
def rename_drop(spark, sf):
    old = raw_samples(spark, sf).withColumnRenamed("RawSpectra", "CombinedRawSpectra")
    for c in ("CombinedSpectra_PP1", "CombinedSpectra_PP2", "MeanSpectrum_PP1", "MeanSpectrum_PP2"):
        old = old.withColumn(c, F.col("CombinedRawSpectra"))
    new = C.rename_drop(old, {"CombinedRawSpectra": "RawSpectra"}, tables.STALE_COLUMNS[:4])
    return new.withColumn("RawSpectra", F.size("RawSpectra").cast("long"))


@register("filter_labels", "SELECT signal_id, group_id, label FROM {signals} WHERE label IN (1, 3)")
def filter_labels(spark, sf):
    return C.filter_labels(V.signals(spark, sf), "label", [1, 3]).select("signal_id", "group_id", "label")


@register("norm_grade", r"""WITH t AS (SELECT custkey, trim(regexp_replace(grade_text, '\s*\(\d+\)$', '')) AS g FROM {subjects})
    SELECT custkey, CASE WHEN try_cast(g AS DOUBLE) = 1 OR upper(g) = 'WHO-1' THEN 'WHO-1'
    WHEN try_cast(g AS DOUBLE) = 2 OR upper(g) = 'WHO-2' THEN 'WHO-2'
    WHEN try_cast(g AS DOUBLE) = 3 OR upper(g) = 'WHO-3' THEN 'WHO-3' ELSE '' END AS grade FROM t""")
def norm_grade(spark, sf):
    return V.subjects(spark, sf).select("custkey", L.norm_grade(F.col("grade_text")).alias("grade"))


@register("label_from_text", """SELECT custkey, CAST(CASE WHEN contains(grade_text, '1') THEN 1
    WHEN contains(grade_text, '3') THEN 3 END AS BIGINT) AS label FROM {subjects}""")
def label_from_text(spark, sf):
    return V.subjects(spark, sf).select("custkey", L.label_from_text(F.col("grade_text")).alias("label"))


@register("norm_sex", """SELECT custkey, CASE WHEN lower(trim(sex_text)) IN ('w', 'female') THEN 'Female'
    WHEN lower(trim(sex_text)) IN ('m', 'male') THEN 'Male' ELSE 'Unknown' END AS sex FROM {subjects}""")
def norm_sex(spark, sf):
    return V.subjects(spark, sf).select("custkey", L.norm_sex(F.col("sex_text")).alias("sex"))


@register("map_subtype", """SELECT custkey, CASE trim(subtype_text) WHEN 'fibromatös' THEN 'fibro' WHEN 'meningothelial' THEN 'meningo'
    WHEN 'transitional' THEN 'trans' WHEN 'klarzellig' THEN 'clear' WHEN 'chordoid' THEN 'chord' WHEN 'anaplastisch' THEN 'anap'
    WHEN 'atypisch' THEN 'atyp' WHEN 'psammomatös' THEN 'psamm'
    ELSE CASE WHEN lower(trim(subtype_text)) IN ('', 'nan', '<missing>') THEN 'Unknown' ELSE trim(subtype_text) END END AS subtype
    FROM {subjects}""")
def map_subtype(spark, sf):
    return V.subjects(spark, sf).select("custkey", L.map_subtype(F.col("subtype_text")).alias("subtype"))


@register("session_number", r"""SELECT event_id, coalesce(try_cast(nullif(regexp_extract(source_file, '-S(\d+)', 1), '') AS BIGINT), 2147483647)
    AS session FROM {sessions}""")
def session_number(spark, sf):
    return V.sessions(spark, sf).select("event_id", L.session_number(F.col("source_file")).alias("session"))


@register("make_key", "SELECT event_id, trim(probe) || '_' || position AS dedup_key FROM {sessions}")
def make_key(spark, sf):
    return V.sessions(spark, sf).select("event_id", L.make_key(F.col("probe"), F.col("position")).alias("dedup_key"))


def holed(spark, sf):
    """Signals with NaN wherever the value exceeds a limit."""
    hole = lambda v: F.when(v > 0.25, F.lit(float("nan"))).otherwise(v)
    return V.signals(spark, sf).withColumn("features", F.transform("features", hole))


@register("nan_policy", """SELECT t.signal_id, t.pos, round(CASE WHEN t.value > 0.25 THEN m.fill ELSE t.value END, 6) + 0.0 AS value
    FROM {traces} t JOIN (SELECT pos, avg(CASE WHEN value <= 0.25 THEN value END) AS fill FROM {traces} GROUP BY pos) m ON t.pos = m.pos""")
def nan_policy(spark, sf):
    return long_of(C.nan_policy(holed(spark, sf), "impute"), ["signal_id"])


@register("nan_policy_remove", "SELECT signal_id FROM {traces} GROUP BY signal_id HAVING max(value) <= 0.25")
def nan_policy_remove(spark, sf):
    return C.nan_policy(holed(spark, sf), "remove").select("signal_id")


@register("nan_policy_error", "SELECT signal_id, label FROM {signals}")
def nan_policy_error(spark, sf):
    return C.nan_policy(V.signals(spark, sf), "error").where(F.size("features") > 0).select("signal_id", "label")


@register("validate_signals", """SELECT count(*) AS n_signals, count(DISTINCT sample_id) AS n_samples,
    count(*) FILTER (len(features) = 0) AS n_empty, max(len(features)) <> min(len(features)) AS mixed_width,
    count(*) FILTER (list_max(features) > 0.25) AS n_nonfinite, count(*) FILTER (label NOT IN (1, 3)) AS n_bad_label,
    count(DISTINCT label) AS n_classes, count(DISTINCT label) >= 2 AS enough_classes, max(len(features)) >= 10 AS enough_features
    FROM {signals}""")
def validate_signals(spark, sf):
    return C.validate_signals(holed(spark, sf), "sample_id", "label", [1, 3])


@register("duplicate_ids", "SELECT o_custkey AS custkey, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return C.duplicate_ids(V.table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")


@register("duplicate_ids_listed", """SELECT o_custkey AS custkey, count(*) AS n_rows FROM orders GROUP BY 1
    HAVING count(*) > 1 ORDER BY custkey LIMIT 10""")
def duplicate_ids_listed(spark, sf):
    return C.duplicate_ids(V.table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey")), "custkey", 10)


def masks(spark, sf):
    """A validity mask for the signals whose first value is not negative, and flagged samples."""
    s = V.signals(spark, sf)
    mask = s.where(F.col("features")[0] >= 0).select("signal_id", (F.col("features")[1] > 0).alias("is_valid"))
    flagged = s.groupBy("sample_id").agg(F.max(F.col("features")[2]).alias("m")).where(F.col("m") > 0.3).select("sample_id")
    return s, mask, flagged


MASKED = """kept AS (SELECT * FROM {signals} s WHERE NOT (features[1] >= 0 AND NOT features[2] > 0)
    AND sample_id NOT IN (SELECT sample_id FROM {signals} GROUP BY sample_id HAVING max(features[3]) > 0.3))"""


@register("apply_qc_mask", f"WITH {MASKED} SELECT signal_id, sample_id, label FROM kept")
def apply_qc_mask(spark, sf):
    s, mask, flagged = masks(spark, sf)
    return C.apply_qc_mask(s, mask, ["signal_id"], flagged).select("signal_id", "sample_id", "label")


@register("emptied_samples", f"WITH {MASKED} SELECT DISTINCT sample_id FROM {{signals}} WHERE sample_id NOT IN (SELECT sample_id FROM kept)")
def emptied_samples(spark, sf):
    s, mask, flagged = masks(spark, sf)
    return C.emptied_samples(s, C.apply_qc_mask(s, mask, ["signal_id"], flagged))


@register("l2_norm_scalar", "SELECT signal_id, round(sqrt(sum(value*value)), 6) + 0.0 AS norm FROM {traces} GROUP BY signal_id")
def l2_norm_scalar(spark, sf):
    return V.signals(spark, sf).select("signal_id", r6(A.l2_norm(F.col("features"))).alias("norm"))


@register("sigmoid_scores", """SELECT order_id, line_no, round(1 - 1/(1+exp(-(score*4-2))), 6) + 0.0 AS p_low,
    round(1/(1+exp(-(score*4-2))), 6) + 0.0 AS p_high FROM {preds}""")
def sigmoid_scores(spark, sf):
    s = A.sigmoid_scores(F.col("score") * 4 - 2)
    return V.preds(spark, sf).select("order_id", "line_no", s.alias("s")).select(
        "order_id", "line_no", r6(F.col("s")[0]).alias("p_low"), r6(F.col("s")[1]).alias("p_high"))


@register("softmax_scores", """WITH e AS (SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, exp(l_discount*10) AS a,
    exp(l_tax*10) AS b, exp(l_quantity/50) AS c FROM lineitem)
    SELECT order_id, line_no, round(a/(a+b+c), 6) + 0.0 AS s1, round(b/(a+b+c), 6) + 0.0 AS s2, round(c/(a+b+c), 6) + 0.0 AS s3 FROM e""")
def softmax_scores(spark, sf):
    raw = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50)
    return V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line_no"),
        A.softmax_scores(raw).alias("s")).select("order_id", "line_no", *[r6(F.col("s")[i]).alias(f"s{i + 1}") for i in range(3)])


@register("distance_scores", """WITH e AS (SELECT order_id, line_no, exp(-abs(score*3-1)) AS a, exp(-abs(score*3-2)) AS b,
    exp(-abs(score*3-3)) AS c FROM {preds})
    SELECT order_id, line_no, round(a/(a+b+c), 6) + 0.0 AS s1, round(b/(a+b+c), 6) + 0.0 AS s2, round(c/(a+b+c), 6) + 0.0 AS s3 FROM e""")
def distance_scores(spark, sf):
    return V.preds(spark, sf).select("order_id", "line_no", A.distance_scores(F.col("score") * 3, 3).alias("s")).select(
        "order_id", "line_no", *[r6(F.col("s")[i]).alias(f"s{i + 1}") for i in range(3)])


@register("round_clamp_class", """SELECT order_id, line_no, CAST(greatest(1, least(3, round(l.q))) AS BIGINT) AS class_no
    FROM (SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, l_quantity/10 - 1 AS q FROM lineitem) l""")
def round_clamp_class(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line_no"),
        A.round_clamp_class(F.col("l_quantity") / 10 - 1, 3).alias("class_no"))


@register("entropy_bits", """WITH g AS (SELECT group_id, avg(1-score) AS a, avg(score) AS b FROM {preds} GROUP BY group_id)
    SELECT group_id, round(-(a*log2(a+2.220446049250313e-16) + b*log2(b+2.220446049250313e-16)), 6) + 0.0 AS entropy FROM g""")
def entropy_bits(spark, sf):
    g = V.preds(spark, sf).groupBy("group_id").agg(F.avg(1.0 - F.col("score")).alias("a"), F.avg("score").alias("b"))
    return g.select("group_id", r6(A.entropy_bits(F.col("a"), F.col("b"))).alias("entropy"))


@register("label_index", """SELECT group_id, CAST(list_position(['A', 'N', 'R'], y_true) AS BIGINT) AS class_no, y_true AS back,
    count(*) AS n FROM {preds3} GROUP BY ALL""")
def label_index(spark, sf):
    i = L.label_index(F.col("y_true"), V.FLAGS)
    return V.preds3(spark, sf).select("group_id", i.alias("class_no"), L.index_label(i, V.FLAGS).alias("back")).groupBy(
        "group_id", "class_no", "back").agg(F.count(F.lit(1)).alias("n"))


@register("fill_missing_category", "SELECT custkey, coalesce(nullif(trim(sex_text), ''), '') AS sex FROM {subjects}")
def fill_missing_category(spark, sf):
    return V.subjects(spark, sf).select(
        "custkey", L.fill_missing_category(F.nullif(F.trim("sex_text"), F.lit(""))).alias("sex"))


PROFILED = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
            ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


def profile_sql(k: int, c: str, kind: str) -> str:
    text = "CAST(NULL AS VARCHAR)" if kind == "double" else f"CAST({c} AS VARCHAR)"
    number = f"CAST({c} AS DOUBLE)" if kind in ("bigint", "double") else "CAST(NULL AS DOUBLE)"
    return f"""SELECT CAST({k} AS BIGINT) AS position, '{c}' AS name, '{kind}' AS type, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null,
    count(DISTINCT {c}) AS n_distinct, min({text}) AS least, max({text}) AS most, min({number}) AS least_number, max({number}) AS most_number FROM orders"""


@register("column_profile", " UNION ALL ".join(profile_sql(k, c, kind) for k, (c, kind) in enumerate(PROFILED, 1)))
def column_profile(spark, sf):
    return tables.column_profile(V.table(spark, sf, "orders"))


@register("carry_metadata", "SELECT signal_id, diss_id, label, CAST(len(spectra) AS BIGINT) AS n_spectra FROM {positions}")
def carry_metadata(spark, sf):
    return C.carry_metadata(V.positions(spark, sf), "spectra", ["signal_id", "diss_id", "label"])


# --- D: joins ------------------------------------------------------------------------


@register("join_metadata", """SELECT o_orderkey AS sample_id, s.custkey, s.patient, s.nationkey, n.n_name AS nation
    FROM orders o JOIN {subjects} s ON CAST(o.o_custkey AS VARCHAR) = trim(s.proben_id) JOIN nation n ON n.n_nationkey = s.nationkey""")
def join_metadata(spark, sf):
    orders = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").cast("string").alias("probe_id"))
    meta = V.subjects(spark, sf).select("proben_id", "custkey", "patient", "nationkey")
    nation = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("nation"))
    first = C.join_metadata(orders, meta, "probe_id", "proben_id")
    return C.join_metadata(first, nation, "nationkey", "key").select("sample_id", "custkey", "patient", "nationkey", "nation")


@register("join_outlier_flags", """WITH s AS (SELECT o_custkey AS probe, o_orderkey AS pos FROM orders),
    f AS (SELECT o_custkey AS probe, o_orderkey AS pos, o_totalprice > 400000 AS bad FROM orders
          WHERE NOT (o_custkey % 3 = 0 AND o_orderstatus = 'P') AND o_custkey % 5 <> 0),
    u AS (SELECT a.probe FROM (SELECT probe, count(*) AS n FROM s GROUP BY 1) a JOIN (SELECT probe, count(*) AS n FROM f GROUP BY 1) b
          ON a.probe = b.probe AND a.n = b.n)
    SELECT s.probe, s.pos FROM s LEFT JOIN f ON s.probe = f.probe AND s.pos = f.pos AND f.bad AND s.probe IN (SELECT probe FROM u)
    WHERE f.probe IS NULL""")
def join_outlier_flags(spark, sf):
    o = V.table(spark, sf, "orders")
    s = o.select(F.col("o_custkey").alias("probe"), F.col("o_orderkey").alias("pos"))
    gap = ((F.col("o_custkey") % 3 == 0) & (F.col("o_orderstatus") == "P")) | (F.col("o_custkey") % 5 == 0)
    f = o.where(~gap).select(F.col("o_custkey").alias("probe"), F.col("o_orderkey").alias("pos"), (F.col("o_totalprice") > 400000).alias("bad"))
    return C.join_outlier_flags(s, f, "probe", "pos", "bad")


@register("semi_group", "SELECT sample_id, group_id FROM {split_orders} WHERE group_id IN (SELECT custkey FROM {subjects} WHERE acctbal > 5000)")
def semi_group(spark, sf):
    groups = V.subjects(spark, sf).where(F.col("acctbal") > 5000).select(F.col("custkey").alias("group_id"))
    return K.semi_group(V.split_orders(spark, sf), groups, "group_id").select("sample_id", "group_id")


@register("anti_train", "SELECT sample_id, group_id FROM {split_orders} WHERE group_id NOT IN (SELECT custkey FROM {subjects} WHERE acctbal > 5000)")
def anti_train(spark, sf):
    groups = V.subjects(spark, sf).where(F.col("acctbal") > 5000).select(F.col("custkey").alias("group_id"))
    return K.anti_train(V.split_orders(spark, sf), groups, "group_id").select("sample_id", "group_id")


@register("leakage_guard", """SELECT DISTINCT a.o_custkey AS group_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
    WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'""")
def leakage_guard(spark, sf):
    o = V.table(spark, sf, "orders").withColumnRenamed("o_custkey", "group_id")
    s = V.split_orders(spark, sf)
    K.leakage_guard(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"), "group_id")
    return K.leaked_groups(o.where(F.col("o_orderstatus") == "F"), o.where(F.col("o_orderstatus") == "O"), "group_id")


@register("axis_join", "SELECT signal_id, t.pos, axis, round(value, 6) + 0.0 AS value FROM {traces} t JOIN {axis} a ON t.pos = a.pos")
def axis_join(spark, sf):
    t = V.traces(spark, sf).select("signal_id", "pos", "value")
    return rounded(C.axis_join(t, C.axis_table(t, V.AXIS)), "value").select("signal_id", "pos", "axis", "value")


@register("config_cross", """WITH g AS (SELECT recipe, classifier, CAST(r AS BIGINT) AS repeat, CAST(f AS BIGINT) AS fold
    FROM (VALUES ('10200X'), ('10220X')) a(recipe), (VALUES ('PCA-LDA'), ('PLS-DA')) b(classifier), range(1, 3) c(r), range(1, 4) d(f))
    SELECT g.*, count(p.order_id) AS n FROM g LEFT JOIN {preds} p USING (recipe, classifier, repeat, fold) GROUP BY ALL""")
def config_cross(spark, sf):
    p = V.preds(spark, sf)
    grid = cv.config_grid(p, ["10200X", "10220X"], ["PCA-LDA", "PLS-DA"], 2, 3)
    counts = p.groupBy(*Y.FOLD).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, list(Y.FOLD), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@register("params_join", """WITH m AS (SELECT recipe, repeat, fold, avg(score) AS mu, stddev_samp(score) AS sd FROM {preds} GROUP BY ALL)
    SELECT order_id, line_no, round((score - mu)/sd, 6) + 0.0 AS z FROM {preds} JOIN m USING (recipe, repeat, fold)""")
def params_join(spark, sf):
    from wavecohort.plans.recipes import zscore_apply, zscore_fit
    keys = ["recipe", "repeat", "fold"]
    rows = V.preds(spark, sf).select("order_id", "line_no", *keys, F.array("score").alias("features"))
    return zscore_apply(rows, zscore_fit(rows, keys), keys).select("order_id", "line_no", r6(F.col("features")[0]).alias("z"))


# --- H: sets -------------------------------------------------------------------------


@register("distinct_groups", "SELECT DISTINCT group_id FROM {split_orders}")
def distinct_groups(spark, sf):
    return S.distinct_groups(V.split_orders(spark, sf), "group_id")


def _by_status(spark, sf):
    o = V.split_orders(spark, sf)
    return o.where(F.col("label") == "F"), o.where(F.col("label") == "P")


@register("intersect_groups", """SELECT group_id FROM {split_orders} WHERE label='F' INTERSECT
    SELECT group_id FROM {split_orders} WHERE label='P'""")
def intersect_groups(spark, sf):
    return S.intersect_groups(*_by_status(spark, sf), "group_id")


@register("union_groups", """SELECT group_id FROM {split_orders} WHERE label='F' UNION
    SELECT group_id FROM {split_orders} WHERE label='P'""")
def union_groups(spark, sf):
    return S.union_groups(*_by_status(spark, sf), "group_id")


@register("subset_check", """WITH x AS (SELECT DISTINCT group_id FROM {split_orders} WHERE group_id NOT IN
    (SELECT group_id FROM {split_orders} WHERE label='P')) SELECT count(*) AS n_outside, count(*) = 0 AS is_subset FROM x""")
def subset_check(spark, sf):
    o = V.split_orders(spark, sf)
    return S.subset_check(o, o.where(F.col("label") == "P"), "group_id")


@register("split_count_check", """WITH a AS (SELECT count(DISTINCT group_id) FILTER (split='train') AS train_groups,
    count(DISTINCT group_id) FILTER (split='test') AS test_groups, count(*) FILTER (split='train') AS train_count,
    count(*) FILTER (split='test') AS test_count FROM {split_orders}),
    e AS (SELECT count(DISTINCT o_custkey) AS g, count(*) AS n FROM orders)
    SELECT a.*, train_groups = g AS train_groups_ok, test_groups = g AS test_groups_ok, train_count = n - test_count AS train_count_ok,
    test_count = n AS test_count_ok FROM a, e""")
def split_count_check(spark, sf):
    o = V.split_orders(spark, sf)
    actual = S.split_counts(o, "split", "group_id")
    n_test = F.sum((F.col("split") == "test").cast("long"))
    expected = o.agg(
        F.countDistinct("group_id").alias("train_groups"), F.countDistinct("group_id").alias("test_groups"),
        (F.count(F.lit(1)) - n_test).alias("train_count"), F.count(F.lit(1)).alias("test_count"))
    return S.split_count_check(actual, expected)


@register("except_columns", """SELECT group_id, min(sample_id) AS sample_id, round(sum(price), 2) + 0.0 AS price FROM {split_orders} GROUP BY group_id""")
def except_columns(spark, sf):
    o = V.split_orders(spark, sf)
    keep = S.except_columns(o, o.select("label", "split"))
    return o.select(*keep).groupBy("group_id").agg(F.min("sample_id").alias("sample_id"), (F.round(F.sum("price"), 2) + F.lit(0.0)).alias("price"))
