"""Queries on aggregation, ordering, splitting and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavecohort.catalog import views as V
from wavecohort.catalog.tables import holed
from wavecohort.catalog.views import r6, register, rounded
from wavecohort.functions import labels as L
from wavecohort.operators import aggregates as G
from wavecohort.operators import cleaning as C
from wavecohort.operators import folds as K
from wavecohort.operators import ordered as O
from wavecohort.operators import summary as Y
from wavecohort.plans import prepare

# --- E: aggregation --------------------------------------------------------------------


@register("mean_signal", "SELECT sample_id, pos, round(avg(value), 6) + 0.0 AS value FROM {traces} GROUP BY ALL")
def mean_signal(spark, sf):
    m = G.mean_signal(V.signals(spark, sf), ["sample_id"])
    return m.select("sample_id", F.posexplode("mean_signal").alias("pos", "value")).select(
        "sample_id", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


@register("mean_signal_omit_nan", """SELECT group_id, pos, round(avg(CASE WHEN value <= 0.25 THEN value END), 6) + 0.0 AS value
    FROM {traces} GROUP BY ALL""")
def mean_signal_omit_nan(spark, sf):
    m = G.mean_signal(holed(spark, sf), ["group_id"], omit_nan=True)
    return m.select("group_id", F.posexplode("mean_signal").alias("pos", "value")).select(
        "group_id", F.col("pos").cast("long").alias("pos"), r6("value").alias("value"))


@register("median_signal", "SELECT sample_id, pos, round(median(value), 6) + 0.0 AS value FROM {traces} GROUP BY ALL")
def median_signal(spark, sf):
    return G.median_points(V.signals(spark, sf), ["sample_id"]).select("sample_id", "pos", r6("median").alias("value"))


@register("mean_or_median_fallback", """SELECT sample_id, pos, round(CASE WHEN max(value) <= 0.25 THEN avg(value)
    ELSE median(CASE WHEN value <= 0.25 THEN value END) END, 6) + 0.0 AS value FROM {traces} GROUP BY ALL""")
def mean_or_median_fallback(spark, sf):
    return rounded(G.mean_or_median_points(holed(spark, sf), ["sample_id"]), "value")


@register("combine_positions", """SELECT diss_id, position, signal_id, CAST(k AS BIGINT) AS signal_pos,
    round(list_sum(spectra[k]), 6) + 0.0 AS total FROM {positions}, range(1, 5) t(k)""")
def combine_positions(spark, sf):
    from wavecohort.functions import arrays as A
    p = V.positions(spark, sf).withColumn("position", F.concat_ws("|", "position", "signal_id"))
    signals, _ = C.combine_positions(p, "diss_id", "position", "spectra")
    part = F.split("position", "\\|")
    return signals.select("diss_id", part[0].alias("position"), part[1].cast("long").alias("signal_id"), "signal_pos",
                          r6(A.array_sum(F.col("features"))).alias("total"))


@register("combine_positions_counts", """SELECT diss_id, count(*) AS num_positions, CAST(sum(len(spectra)) AS BIGINT) AS num_spectra
    FROM {positions} GROUP BY diss_id""")
def combine_positions_counts(spark, sf):
    return C.combine_positions(V.positions(spark, sf), "diss_id", "position", "spectra")[1]


@register("class_counts", """SELECT label, count(*) AS n, round(count(*)*100.0/sum(count(*)) OVER (), 6) + 0.0 AS percent
    FROM {split_orders} GROUP BY label""")
def class_counts(spark, sf):
    return rounded(G.class_counts(V.split_orders(spark, sf), "label"), "percent")


@register("group_size_stats", """WITH s AS (SELECT group_id, count(*) AS n FROM {split_orders} GROUP BY group_id)
    SELECT count(*) AS n_groups, round(avg(n), 6) + 0.0 AS mean_size, round(coalesce(stddev_samp(n), 0), 6) + 0.0 AS std_size,
    min(n) AS min_size, max(n) AS max_size, round(median(n), 6) + 0.0 AS median_size FROM s""")
def group_size_stats(spark, sf):
    return rounded(G.group_size_stats(V.split_orders(spark, sf), "group_id"), "mean_size", "std_size", "median_size")


@register("feature_ranges", """SELECT pos, round(min(value), 6) + 0.0 AS min_value, round(max(value), 6) + 0.0 AS max_value,
    round(avg(value), 6) + 0.0 AS mean_value, round(stddev_samp(value), 6) + 0.0 AS std_value FROM {traces} GROUP BY pos""")
def feature_ranges(spark, sf):
    return rounded(G.feature_ranges(V.signals(spark, sf)), "min_value", "max_value", "mean_value", "std_value")


@register("count_distinct_groups", "SELECT count(DISTINCT group_id) AS n_groups, count(DISTINCT sample_id) AS n_samples FROM {split_orders}")
def count_distinct_groups(spark, sf):
    return G.count_distinct_groups(V.split_orders(spark, sf), "group_id", "sample_id")


@register("dataset_summary", """SELECT coalesce(CASE WHEN grouping(split)=1 THEN 'all' ELSE split END) AS split,
    CASE WHEN grouping(label)=1 THEN 'all' ELSE label END AS label, count(*) AS n_samples, count(DISTINCT group_id) AS n_groups,
    CAST(sum(sample_id % 5 + 1) AS BIGINT) AS n_spectra FROM {split_orders} GROUP BY ROLLUP (split, label)""")
def dataset_summary(spark, sf):
    return G.dataset_summary(V.split_orders(spark, sf), "split", "label", "group_id", F.col("sample_id") % 5 + 1)


@register("majority_label", """WITH c AS (SELECT group_id, label, count(*) AS n FROM {split_orders} GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, label) AS rn FROM c) SELECT group_id, label FROM r WHERE rn = 1""")
def majority_label(spark, sf):
    return G.majority_label(V.split_orders(spark, sf), ["group_id"], "label")


SUPPLIER_FOLDS = """f AS (SELECT recipe, classifier, repeat, fold, avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy,
    avg(score) AS mean_score FROM {preds} GROUP BY ALL)"""


def fold_table(spark, sf):
    p = V.preds(spark, sf)
    return p.groupBy(*Y.FOLD).agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"), F.avg("score").alias("mean_score"))


@register("mean_std_median", f"""WITH {SUPPLIER_FOLDS} SELECT recipe, classifier, round(avg(accuracy), 6) + 0.0 AS mean_accuracy,
    round(stddev_samp(accuracy), 6) + 0.0 AS std_accuracy, round(median(accuracy), 6) + 0.0 AS median_accuracy,
    round(avg(mean_score), 6) + 0.0 AS mean_mean_score, round(stddev_samp(mean_score), 6) + 0.0 AS std_mean_score,
    round(median(mean_score), 6) + 0.0 AS median_mean_score FROM f GROUP BY ALL""")
def mean_std_median(spark, sf):
    out = G.mean_std_median(fold_table(spark, sf), ["recipe", "classifier"], ["accuracy", "mean_score"])
    return rounded(out, *[c for c in out.columns if c not in ("recipe", "classifier")])


@register("ci95", f"""WITH {SUPPLIER_FOLDS} SELECT recipe, classifier,
    round(avg(accuracy) - 1.96*stddev_samp(accuracy)/sqrt(count(*)), 6) + 0.0 AS ci_low,
    round(avg(accuracy) + 1.96*stddev_samp(accuracy)/sqrt(count(*)), 6) + 0.0 AS ci_high FROM f GROUP BY ALL""")
def ci95(spark, sf):
    low, high = G.ci95(F.avg("accuracy"), F.stddev_samp("accuracy"), F.count("accuracy"))
    return fold_table(spark, sf).groupBy("recipe", "classifier").agg(r6(low).alias("ci_low"), r6(high).alias("ci_high"))


@register("percentile_ci", f"""WITH {SUPPLIER_FOLDS} SELECT recipe, classifier, round(quantile_cont(accuracy, 0.025), 6) + 0.0 AS ci_low,
    round(quantile_cont(accuracy, 0.975), 6) + 0.0 AS ci_high FROM f GROUP BY ALL""")
def percentile_ci(spark, sf):
    return rounded(G.percentile_ci(fold_table(spark, sf), ["recipe", "classifier"], "accuracy"), "ci_low", "ci_high")


@register("trimmed_mean_signal", """WITH r AS (SELECT group_id, pos, value,
    percent_rank() OVER (PARTITION BY group_id, pos ORDER BY value) AS pr, count(*) OVER (PARTITION BY group_id, pos) AS n FROM {traces})
    SELECT group_id, pos, round(avg(value), 6) + 0.0 AS value FROM r WHERE n = 1 OR (pr >= 0.05 AND pr <= 0.95) GROUP BY ALL""")
def trimmed_mean_signal(spark, sf):
    return rounded(G.trimmed_mean_points(V.signals(spark, sf), ["group_id"], 0.05), "value")


@register("split_demographics", """WITH s AS (SELECT *, CASE WHEN substr(md5('split:'||custkey),1,1) < 'b' THEN 'train' ELSE 'test' END AS split,
    CASE WHEN lower(trim(sex_text)) IN ('w','female') THEN 'Female' WHEN lower(trim(sex_text)) IN ('m','male') THEN 'Male' ELSE 'Unknown' END AS sex
    FROM {subjects})
    SELECT split, count(*) AS n, round(avg(age), 6) + 0.0 AS age_mean, round(stddev_samp(age), 6) + 0.0 AS age_std,
    round(min(age), 6) + 0.0 AS age_min, round(max(age), 6) + 0.0 AS age_max,
    count(*) FILTER (sex='Female') AS "n_sex_Female", count(*) FILTER (sex='Male') AS "n_sex_Male", count(*) FILTER (sex='Unknown') AS "n_sex_Unknown",
    count(*) FILTER (nationkey=1) AS n_label_1, count(*) FILTER (nationkey=3) AS n_label_3,
    count(*) FILTER (cluster='BUILDING') AS "n_cluster_BUILDING", count(*) FILTER (cluster='MACHINERY') AS "n_cluster_MACHINERY"
    FROM s GROUP BY split""")
def split_demographics(spark, sf):
    h = F.md5(F.concat(F.lit("split:"), F.col("custkey").cast("string")))
    s = V.subjects(spark, sf).withColumns({
        "split": F.when(F.substring(h, 1, 1) < "b", F.lit("train")).otherwise(F.lit("test")), "sex": L.norm_sex(F.col("sex_text"))})
    out = G.split_demographics(s, "split", "age", "sex", "nationkey", "cluster", ["Female", "Male", "Unknown"], [1, 3], ["BUILDING", "MACHINERY"])
    return rounded(out, "age_mean", "age_std", "age_min", "age_max")


# --- F: ordered ------------------------------------------------------------------------


@register("dedup_lowest_session", r"""WITH k AS (SELECT *, trim(probe)||'_'||position AS dedup_key,
    coalesce(try_cast(nullif(regexp_extract(source_file, '-S(\d+)', 1), '') AS BIGINT), 2147483647) AS session FROM {sessions}),
    r AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY session, source_file, event_id) AS rn FROM k)
    SELECT dedup_key, session, event_id, round(value, 6) + 0.0 AS value FROM r WHERE rn = 1""")
def dedup_lowest_session(spark, sf):
    out = C.dedup_lowest_session(V.sessions(spark, sf), "probe", "position", "source_file", ["event_id"])
    return out.select("dedup_key", "session", "event_id", r6("value").alias("value"))


def measured(spark, sf):
    """Embeddings as measured positions of a probe: two 32-point spectra, two measurements of each position."""
    n, s = F.floor(F.col("signal_id") / 4), F.col("signal_id") % 7
    probe = F.concat(F.lit("P"), n.cast("string"))
    return V.signals(spark, sf).select(
        F.col("signal_id").alias("row_id"), F.concat(F.lit(" "), probe, F.lit(" ")).alias("probe"),
        F.concat(F.lit("Pos"), F.col("signal_id") % 2).alias("position"),
        F.when(s == 0, F.concat(probe, F.lit("_Pos.mat"))).otherwise(F.concat(probe, F.lit("-S"), s, F.lit("_Pos.mat"))).alias("file"),
        F.array(F.slice("features", 1, 32), F.slice("features", 33, 32)).alias("spectra"))


@register("prepare_signals", r"""WITH raw AS (SELECT signal_id AS row_id, 'P'||(signal_id//4) AS probe, 'Pos'||(signal_id%2) AS position,
    CASE WHEN signal_id%7=0 THEN 'P'||(signal_id//4)||'_Pos.mat' ELSE 'P'||(signal_id//4)||'-S'||(signal_id%7)||'_Pos.mat' END AS file,
    [features[1:32], features[33:64]] AS spectra FROM {signals}),
    k AS (SELECT *, probe||'_'||position AS dedup_key,
      coalesce(try_cast(nullif(regexp_extract(file, '-S(\d+)', 1), '') AS BIGINT), 2147483647) AS session FROM raw),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY session, file, row_id) AS rn FROM k) WHERE rn = 1),
    g AS (SELECT custkey, trim(regexp_replace(grade_text, '\s*\(\d+\)$', '')) AS g, lower(trim(sex_text)) AS s, trim(subtype_text) AS t FROM {subjects}),
    m AS (SELECT 'P'||custkey AS probe, CASE WHEN try_cast(g AS DOUBLE) = 1 OR upper(g) = 'WHO-1' THEN 'WHO-1'
      WHEN try_cast(g AS DOUBLE) = 2 OR upper(g) = 'WHO-2' THEN 'WHO-2' WHEN try_cast(g AS DOUBLE) = 3 OR upper(g) = 'WHO-3' THEN 'WHO-3' ELSE '' END AS grade,
      CASE WHEN s IN ('w', 'female') THEN 'Female' WHEN s IN ('m', 'male') THEN 'Male' ELSE 'Unknown' END AS sex,
      CASE t WHEN 'fibromatös' THEN 'fibro' WHEN 'meningothelial' THEN 'meningo' WHEN 'transitional' THEN 'trans' WHEN 'klarzellig' THEN 'clear'
      WHEN 'chordoid' THEN 'chord' WHEN 'anaplastisch' THEN 'anap' WHEN 'atypisch' THEN 'atyp' WHEN 'psammomatös' THEN 'psamm'
      ELSE CASE WHEN lower(t) IN ('', 'nan', '<missing>') THEN 'Unknown' ELSE t END END AS subtype FROM g),
    x AS (SELECT dedup_key, session, row_id, grade, sex, subtype, CAST(j AS BIGINT) AS local_index, CAST(i AS BIGINT) AS pos, spectra[j][i+1] AS v
      FROM u JOIN m USING (probe), range(1, 3) a(j), range(0, 32) b(i)),
    b AS (SELECT dedup_key, local_index, pos//4 AS pos, avg(v) AS v FROM x GROUP BY ALL),
    s AS (SELECT 1 AS pp, dedup_key, local_index, pos, v FROM x UNION ALL SELECT 2 AS pp, dedup_key, local_index, pos, v FROM b),
    n AS (SELECT pp, dedup_key, local_index, pos, v / sqrt(sum(v*v) OVER (PARTITION BY pp, dedup_key, local_index)) AS v FROM s),
    d AS (SELECT pp, dedup_key, local_index, pos, (2*lag(v, 2, 0) OVER w - lag(v, 1, 0) OVER w - 2*v - lead(v, 1, 0) OVER w + 2*lead(v, 2, 0) OVER w)/7 AS v
      FROM n WINDOW w AS (PARTITION BY pp, dedup_key, local_index ORDER BY pos)),
    z AS (SELECT dedup_key, local_index, sum(v*(pos+1)) FILTER (pp=1) AS a1, sum(v*(pos+1)) FILTER (pp=2) AS a2 FROM d GROUP BY ALL),
    r AS (SELECT dedup_key, session, row_id, grade, sex, subtype, local_index, sum(v*(pos+1)) AS a0 FROM x GROUP BY ALL)
    SELECT dedup_key, session, row_id, grade, sex, subtype, local_index, round(a0, 6) + 0.0 AS raw_sum, round(a1, 6) + 0.0 AS pp1_sum,
    round(a2, 6) + 0.0 AS pp2_sum FROM r JOIN z USING (dedup_key, local_index)""")
def prepare_signals(spark, sf):
    """From measured positions and raw metadata to clean signals with both presets, each summed with its places as weights."""
    from wavecohort.functions import arrays as A
    meta = V.subjects(spark, sf).select(F.concat(F.lit("P"), "custkey").alias("key"), "grade_text", "sex_text", "subtype_text")
    meta = prepare.clean_metadata(meta, "grade_text", "sex_text", "subtype_text")
    out = prepare.prepare_signals(measured(spark, sf), meta, "probe", "position", "file", "row_id", "key")
    weighted = lambda c: A.array_sum(F.transform(c, lambda v, i: v * (i + 1)))
    return out.select("dedup_key", "session", "row_id", "grade", "sex", "subtype", "local_index",
                      *[r6(weighted(c)).alias(f"{c}_sum") for c in ("raw", "pp1", "pp2")])


@register("first_meta_row", """SELECT diss_id, arg_min(position, signal_id) AS position, arg_min(label, signal_id) AS label, min(signal_id) AS signal_id
    FROM {positions} GROUP BY diss_id""")
def first_meta_row(spark, sf):
    return C.first_meta_row(V.positions(spark, sf), "diss_id", ["position", "label", "signal_id"], ["signal_id"])


FOLDS = """g AS (SELECT group_id, min(y) AS y FROM {signals} GROUP BY group_id),
    r AS (SELECT rep AS repeat, group_id, y, row_number() OVER (PARTITION BY rep, y ORDER BY md5((41 + rep)||':'||group_id), group_id) AS rn,
    count(*) OVER (PARTITION BY rep, y) AS n FROM g, range(1, 4) t(rep))"""


@register("stratified_group_folds", f"WITH {FOLDS} SELECT CAST(repeat AS BIGINT) AS repeat, CAST((rn-1)%5+1 AS BIGINT) AS fold, group_id, y FROM r")
def stratified_group_folds(spark, sf):
    return K.stratified_group_folds(V.signals(spark, sf), "group_id", "y", 5, 3, 42)


ORDER_GROUPS = """c AS (SELECT group_id, label, count(*) AS n FROM {split_orders} GROUP BY ALL),
    g AS (SELECT group_id, label FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, label) AS k FROM c) WHERE k = 1)"""


@register("stratified_group_folds_orders", f"""WITH {ORDER_GROUPS}, r AS (SELECT rep AS repeat, group_id, label,
    row_number() OVER (PARTITION BY rep, label ORDER BY md5((6 + rep)||':'||group_id), group_id) AS rn FROM g, range(1, 3) t(rep))
    SELECT CAST(repeat AS BIGINT) AS repeat, CAST((rn-1)%10+1 AS BIGINT) AS fold, group_id, label FROM r""")
def stratified_group_folds_orders(spark, sf):
    return K.stratified_group_folds(V.split_orders(spark, sf), "group_id", "label", 10, 2, 7)


@register("folds_remainder_last", f"""WITH {ORDER_GROUPS}, r AS (SELECT group_id, label,
    row_number() OVER (PARTITION BY label ORDER BY md5('42:'||group_id), group_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM g)
    SELECT CAST(CASE WHEN n//7 > 0 THEN least((rn-1)//(n//7), 6) + 1 ELSE 7 END AS BIGINT) AS fold, group_id, label FROM r""")
def folds_remainder_last(spark, sf):
    return K.folds_remainder_last(V.split_orders(spark, sf), "group_id", "label", 7, 42)


@register("folds_missing_class", """WITH f AS (SELECT CAST(group_id%3+1 AS BIGINT) AS fold, y_true FROM {preds}),
    g AS (SELECT CAST(k AS BIGINT) AS fold, CAST(c AS BIGINT) AS y_true FROM range(1, 4) a(k), (VALUES (1), (3), (5)) b(c))
    SELECT fold, y_true FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.y_true = g.y_true AND f.fold <> g.fold)""")
def folds_missing_class(spark, sf):
    out = K.folds_missing_class(V.preds(spark, sf).select("fold", "y_true"), "y_true", [1, 3, 5], 3)
    return out.withColumn("y_true", F.col("y_true").cast("long"))


@register("fold_sizes", f"""WITH {FOLDS}, f AS (SELECT repeat, (rn-1)%5+1 AS fold, group_id FROM r),
    s AS (SELECT group_id, count(*) AS n FROM {{signals}} GROUP BY group_id), a AS (SELECT f.*, s.n FROM f JOIN s USING (group_id)),
    k AS (SELECT DISTINCT repeat, fold FROM f)
    SELECT CAST(k.repeat AS BIGINT) AS repeat, CAST(k.fold AS BIGINT) AS fold, CAST(sum(n) FILTER (a.fold <> k.fold) AS BIGINT) AS n_train,
    CAST(sum(n) FILTER (a.fold = k.fold) AS BIGINT) AS n_test, count(*) FILTER (a.fold <> k.fold) AS n_train_groups,
    count(*) FILTER (a.fold = k.fold) AS n_test_groups FROM k JOIN a ON a.repeat = k.repeat GROUP BY k.repeat, k.fold""")
def fold_sizes(spark, sf):
    s = V.signals(spark, sf)
    return K.fold_sizes(s, K.stratified_group_folds(s, "group_id", "y", 5, 3, 42), "group_id", 5)


@register("sample_level_folds", """WITH g AS (SELECT signal_id, y FROM {signals}),
    r AS (SELECT signal_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42:'||signal_id), signal_id) AS rn FROM g)
    SELECT CAST(1 AS BIGINT) AS repeat, CAST((rn-1)%5+1 AS BIGINT) AS fold, signal_id, y FROM r""")
def sample_level_folds(spark, sf):
    return K.stratified_group_folds(V.signals(spark, sf), "signal_id", "y", 5, 1, 42)


@register("local_index", """SELECT group_id, sample_id, row_number() OVER (PARTITION BY group_id ORDER BY sample_id) AS local_index
    FROM {split_orders}""")
def local_index(spark, sf):
    return O.row_rank(V.split_orders(spark, sf), ["group_id"], "sample_id", out="local_index").select("group_id", "sample_id", "local_index")


@register("rank_auc", """WITH d AS (SELECT group_id, score, count(*) AS cnt FROM {preds} GROUP BY ALL)
    SELECT group_id, round(score, 6) + 0.0 AS score, cnt, round(coalesce(sum(cnt) OVER (PARTITION BY group_id ORDER BY score
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (cnt + 1)/2.0, 6) + 0.0 AS avg_rank FROM d""")
def rank_auc(spark, sf):
    return rounded(O.tie_average_ranks(V.preds(spark, sf), ["group_id"], "score").select("group_id", "score", "cnt", "avg_rank"),
                   "score", "avg_rank")


@register("lag_diff", """SELECT signal_id, pos, round(value - lag(value) OVER (PARTITION BY signal_id ORDER BY pos), 6) + 0.0 AS diff
    FROM {traces} QUALIFY lag(value) OVER (PARTITION BY signal_id ORDER BY pos) IS NOT NULL""")
def lag_diff(spark, sf):
    from wavecohort.operators.aggregates import lag_diff as op
    return rounded(op(V.traces(spark, sf), "signal_id"), "diff")


@register("cumulative_variance", """WITH v AS (SELECT pos, var_samp(value) AS v FROM {traces} GROUP BY pos),
    o AS (SELECT row_number() OVER (ORDER BY round(v, 12) DESC, pos) AS k, 100*v/sum(v) OVER () AS explained FROM v)
    SELECT k, round(explained, 6) + 0.0 AS explained, round(sum(explained) OVER (ORDER BY k), 6) + 0.0 AS cumulative FROM o""")
def cumulative_variance(spark, sf):
    from wavecohort.operators.outliers import cumulative_explained
    var = G.points(V.signals(spark, sf), []).groupBy("pos").agg(F.var_samp("value").alias("v"))
    from pyspark.sql import Window as W
    # one row per axis point
    one = W.partitionBy(F.lit(0))
    ranked = var.select(F.row_number().over(one.orderBy(F.desc(F.round("v", 12)), "pos")).cast("long").alias("k"),
                        (F.lit(100.0) * F.col("v") / F.sum("v").over(one)).alias("explained"))
    return rounded(cumulative_explained(ranked), "explained", "cumulative")


@register("components_needed", """WITH v AS (SELECT pos, var_samp(value) AS v FROM {traces} GROUP BY pos),
    o AS (SELECT row_number() OVER (ORDER BY round(v, 12) DESC, pos) AS k, 100*v/sum(v) OVER () AS explained FROM v),
    c AS (SELECT k, sum(explained) OVER (ORDER BY k) AS cum FROM o)
    SELECT CAST(greatest(1, least(coalesce(min(k) FILTER (cum >= 60), max(k)), 50)) AS BIGINT) AS n_components FROM c""")
def components_needed(spark, sf):
    from pyspark.sql import Window as W
    from wavecohort.operators.outliers import components_needed as op
    var = G.points(V.signals(spark, sf), []).groupBy("pos").agg(F.var_samp("value").alias("v"))
    one = W.partitionBy(F.lit(0))
    ranked = var.select(F.row_number().over(one.orderBy(F.desc(F.round("v", 12)), "pos")).cast("long").alias("k"),
                        (F.lit(100.0) * F.col("v") / F.sum("v").over(one)).alias("explained"))
    return op(ranked, 0.60, 50)


# --- G: sampling and splits --------------------------------------------------------------


@register("sample_per_class", """SELECT label, signal_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:'||signal_id), signal_id) AS rn
    FROM {signals}) WHERE rn <= 7""")
def sample_per_class(spark, sf):
    return K.sample_by_hash(V.signals(spark, sf).select("label", "signal_id"), ["label"], "signal_id", 7).select("label", "signal_id")


@register("sample_signals", """SELECT group_id, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY md5('11:'||sample_id), sample_id) AS rn
    FROM {split_orders}) WHERE rn <= 3""")
def sample_signals(spark, sf):
    return K.sample_by_hash(V.split_orders(spark, sf).select("group_id", "sample_id"), ["group_id"], "sample_id", 3, 11).select("group_id", "sample_id")


@register("split_70_30", """SELECT label, sample_id, CASE WHEN rn <= round(0.7*n) THEN 'train' ELSE 'test' END AS split FROM
    (SELECT label, sample_id, row_number() OVER (PARTITION BY label ORDER BY sample_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM {split_orders})""")
def split_70_30(spark, sf):
    return K.split_first_share(V.split_orders(spark, sf).select("label", "sample_id"), "label", "sample_id", 0.7)


@register("balanced_group_split", """WITH g AS (SELECT gid, arg_min(label, (-n, label)) AS label, CAST(sum(n) AS BIGINT) AS n, min(cluster) AS cluster FROM
    (SELECT 'g'||CAST(custkey//3 AS BIGINT) AS gid, nationkey%2 AS label, count(*) AS n, min(cluster) AS cluster FROM {subjects} GROUP BY ALL) GROUP BY gid),
    p AS (SELECT *, CASE cluster WHEN 'BUILDING' THEN 'train' WHEN 'MACHINERY' THEN 'test' END AS forced FROM g),
    c AS (SELECT label, sum(n) AS class_n, coalesce(sum(n) FILTER (forced='train'), 0) AS already FROM p GROUP BY label),
    t AS (SELECT label, floor(min(class_n) OVER () * 0.7) AS target, already FROM c),
    f AS (SELECT p.*, sum(n) OVER (PARTITION BY label ORDER BY md5('42:'||gid), gid ROWS UNBOUNDED PRECEDING) AS upto FROM p WHERE forced IS NULL)
    SELECT gid, f.label, n, CASE WHEN upto + already <= target THEN 'train' ELSE 'test' END AS split FROM f JOIN t ON f.label = t.label
    UNION ALL SELECT gid, label, n, forced AS split FROM p WHERE forced IS NOT NULL""")
def balanced_group_split(spark, sf):
    s = V.subjects(spark, sf).select(
        F.concat(F.lit("g"), F.floor(F.col("custkey") / 3).cast("long")).alias("gid"),
        (F.col("nationkey") % 2).alias("label"), "cluster")
    return K.balanced_group_split(s, "gid", "label", "cluster", {"BUILDING": "train", "MACHINERY": "test"}, 0.7, 42)
