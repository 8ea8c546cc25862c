"""Queries on metrics, roll-ups and result summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavecohort.catalog import views as V
from wavecohort.catalog.tables import scratch
from wavecohort.catalog.views import r6, register, rounded
from wavecohort.operators import metrics as M
from wavecohort.operators import summary as S
from wavecohort.plans import evaluate as E
from wavecohort.plans import report
from wavecohort.sources import sinks, tables

RECIPES, CLASSIFIERS = ["10200X", "10220X"], ["PCA-LDA", "PLS-DA"]


def R(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def doubles(df, *skip):
    """Round every double column."""
    return rounded(df, *[n for n, t in df.dtypes if t == "double" and n not in skip])


# --- E11, L1-L6 ---------------------------------------------------------------------------


@register("confusion_long", f"""WITH g AS (SELECT config, t, p FROM (SELECT DISTINCT config FROM {{preds3}}), (VALUES ('A'), ('N'), ('R')) a(t), (VALUES ('A'), ('N'), ('R')) b(p)),
    c AS (SELECT config, y_true, y_pred, count(*) AS n FROM {{preds3}} GROUP BY ALL),
    j AS (SELECT g.config, t, p, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.config = g.config AND c.y_true = t AND c.y_pred = p)
    SELECT config, t AS true_class, p AS pred_class, n, {R("n / nullif(CAST(sum(n) OVER (PARTITION BY config, t) AS DOUBLE), 0)", "row_share")} FROM j""")
def confusion_long(spark, sf):
    return rounded(M.confusion_long(V.preds3(spark, sf), ["config"], V.FLAGS), "row_share")


@register("confusion_pivot", """SELECT config, y_true AS true_class, count(*) FILTER (y_pred='A') AS "A", count(*) FILTER (y_pred='N') AS "N",
    count(*) FILTER (y_pred='R') AS "R" FROM {preds3} GROUP BY ALL""")
def confusion_pivot(spark, sf):
    return M.confusion_pivot(V.preds3(spark, sf), ["config"], V.FLAGS)


@register("accuracy", f"SELECT recipe, classifier, count(*) AS n, {R('avg(CAST(y_true = y_pred AS DOUBLE))', 'accuracy')} FROM {{preds}} GROUP BY ALL")
def accuracy(spark, sf):
    return rounded(M.accuracy(V.preds(spark, sf), ["recipe", "classifier"]), "accuracy")


def sql_per_class(src: str, keys: str, classes: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""pc0 AS (SELECT {k}c AS class, count(*) FILTER (y_true = c AND y_pred = c) AS tp, count(*) FILTER (y_true <> c AND y_pred = c) AS fp,
      count(*) FILTER (y_true <> c AND y_pred <> c) AS tn, count(*) FILTER (y_true = c AND y_pred <> c) AS fn
      FROM {src}, (SELECT unnest({classes}) AS c) GROUP BY ALL),
    pc1 AS (SELECT *, tp / nullif(CAST(tp+fn AS DOUBLE), 0) AS sensitivity, tn / nullif(CAST(tn+fp AS DOUBLE), 0) AS specificity,
      tp / nullif(CAST(tp+fp AS DOUBLE), 0) AS precision FROM pc0),
    pc AS (SELECT *, 2*precision*sensitivity / nullif(precision + sensitivity, 0) AS f1_score FROM pc1)"""


PC_COLS = ", ".join(R(c, c) for c in ("sensitivity", "specificity", "precision", "f1_score"))


@register("per_class_metrics", f"WITH {sql_per_class('{preds3}', 'config', repr(V.FLAGS))} SELECT config, class, tp, fp, tn, fn, {PC_COLS} FROM pc")
def per_class_metrics(spark, sf):
    return doubles(M.per_class_metrics(V.preds3(spark, sf), ["config"], V.FLAGS))


@register("per_class_metrics_sparse", f"WITH {sql_per_class('{preds_docs}', '', '[0, 1, 2]')} SELECT CAST(class AS BIGINT) AS class, tp, fp, tn, fn, {PC_COLS} FROM pc")
def per_class_metrics_sparse(spark, sf):
    out = doubles(M.per_class_metrics(V.preds_docs(spark, sf), [], [0, 1, 2]))
    return out.withColumn("class", F.col("class").cast("long"))


MACRO = ", ".join(R(f"avg({c})", n) for c, n in (("sensitivity", "macro_sensitivity"), ("specificity", "macro_specificity"),
                                                 ("precision", "macro_precision"), ("f1_score", "macro_f1")))


@register("macro_metrics", f"WITH {sql_per_class('{preds3}', 'config', repr(V.FLAGS))} SELECT config, {MACRO} FROM pc GROUP BY config")
def macro_metrics(spark, sf):
    return doubles(M.macro_metrics(M.per_class_metrics(V.preds3(spark, sf), ["config"], V.FLAGS), ["config"]))


def sql_auc(src: str, keys: list[str], score: str, positive: str, name: str = "auc", weight: str = "1") -> str:
    """Mann-Whitney from counts per distinct score."""
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"""{name}_d AS (SELECT {k}{score} AS s, CAST(sum(CASE WHEN {positive} THEN {weight} ELSE 0 END) AS DOUBLE) AS pos,
      CAST(sum(CASE WHEN {positive} THEN 0 ELSE {weight} END) AS DOUBLE) AS neg FROM {src} GROUP BY ALL),
    {name}_c AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}_d),
    {name} AS (SELECT {k}sum(pos*(below + neg/2)) / nullif(sum(pos)*sum(neg), 0) AS auc FROM {name}_c {'GROUP BY ALL' if keys else ''})"""


@register("auc_binary", f"WITH {sql_auc('{preds}', ['recipe', 'classifier'], 'score', 'y_true = 3')} SELECT recipe, classifier, {R('auc', 'auc')} FROM auc")
def auc_binary(spark, sf):
    return rounded(M.auc_binary(V.preds(spark, sf), ["recipe", "classifier"], 3), "auc")


@register("auc_binary_global", f"WITH {sql_auc('{preds}', [], 'score', 'y_true = 3')} SELECT {R('auc', 'auc')} FROM auc")
def auc_binary_global(spark, sf):
    return rounded(M.auc_binary(V.preds(spark, sf), [], 3), "auc")


OVR = "o AS (SELECT config, y_true, c AS class, scores[list_position(['A', 'N', 'R'], c)] AS s FROM {preds3}, (SELECT unnest(['A', 'N', 'R']) AS c))"


@register("auc_per_class", f"WITH {OVR}, {sql_auc('o', ['config', 'class'], 's', 'y_true = class')} SELECT config, class, {R('auc', 'auc')} FROM auc")
def auc_per_class(spark, sf):
    return rounded(M.auc_per_class(V.preds3(spark, sf), ["config"], V.FLAGS), "auc")


@register("auc_ovr", f"WITH {OVR}, {sql_auc('o', ['config', 'class'], 's', 'y_true = class')} SELECT config, {R('avg(auc)', 'auc')} FROM auc GROUP BY config")
def auc_ovr(spark, sf):
    return rounded(M.auc_ovr(V.preds3(spark, sf), ["config"], V.FLAGS), "auc")


MODE = """{name}_m AS (SELECT {keys}, t AS y_true, p AS y_pred FROM
    (SELECT {keys}, y_true AS t FROM (SELECT {keys}, y_true, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, y_true) AS k FROM {src} GROUP BY {keys}, y_true) WHERE k = 1)
    JOIN (SELECT {keys}, y_pred AS p FROM (SELECT {keys}, y_pred, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, y_pred) AS k FROM {src} GROUP BY {keys}, y_pred) WHERE k = 1) USING ({keys})),
    {name} AS (SELECT m.*, score FROM {name}_m m JOIN (SELECT {keys}, avg(score) AS score FROM {src} GROUP BY {keys}) USING ({keys}))"""


def sql_rollup(name: str, src: str, keys: str) -> str:
    return MODE.replace("{name}", name).replace("{src}", src).replace("{keys}", keys)


@register("patient_rollup", f"""WITH {sql_rollup('g', '{preds}', 'group_id')}, n AS (SELECT group_id, count(*) AS n_rows FROM {{preds}} GROUP BY group_id)
    SELECT group_id, n_rows, y_true, y_pred, {R('1-score', 'score_1')}, {R('score', 'score_2')} FROM g JOIN n USING (group_id)""")
def patient_rollup(spark, sf):
    return doubles(sinks.with_score_columns(M.group_rollup(V.preds(spark, sf), [], "group_id", V.CLASSES), 2))


def sql_eval(name: str, src: str, keys: list[str], classes: str = "[1, 3]") -> str:
    """n, accuracy, macro metrics and AUC per key, all in one table."""
    k = ", ".join(keys)
    on = f"USING ({k})" if keys else "ON true"
    sel = f"{k}, " if keys else ""
    grp = f"GROUP BY {k}" if keys else ""
    pc = sql_per_class(src, k, classes).replace("pc0", f"{name}_p0").replace("pc1", f"{name}_p1").replace("pc AS", f"{name}_pc AS")
    return f"""{pc}, {sql_auc(src, keys, 'score', 'y_true = 3', f'{name}_auc')},
    {name}_a AS (SELECT {sel}count(*) AS n, avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy FROM {src} {grp}),
    {name}_mm AS (SELECT {sel}avg(sensitivity) AS macro_sensitivity, avg(specificity) AS macro_specificity, avg(precision) AS macro_precision,
      avg(f1_score) AS macro_f1 FROM {name}_pc {grp}),
    {name} AS (SELECT * FROM {name}_a JOIN {name}_mm {on} JOIN {name}_auc {on})"""


SIX = ("accuracy", "macro_sensitivity", "macro_specificity", "macro_precision", "macro_f1", "auc")
SIX_COLS = ", ".join(R(c, c) for c in SIX)


@register("patient_metrics", f"WITH {sql_rollup('g', '{preds}', 'recipe, group_id')}, {sql_eval('e', 'g', ['recipe'])} SELECT recipe, n, {SIX_COLS} FROM e")
def patient_metrics(spark, sf):
    return doubles(M.evaluate(M.group_rollup(V.preds(spark, sf), ["recipe"], "group_id", V.CLASSES), ["recipe"], V.CLASSES))


@register("two_level_eval", f"""WITH {sql_eval('e', '{preds}', ['recipe'])}, {sql_rollup('g', '{preds}', 'recipe, group_id')}, {sql_eval('h', 'g', ['recipe'])}
    SELECT 'signal' AS level, recipe, n, {SIX_COLS} FROM e UNION ALL SELECT 'group' AS level, recipe, n, {SIX_COLS} FROM h""")
def two_level_eval(spark, sf):
    return doubles(M.two_level_eval(V.preds(spark, sf), ["recipe"], "group_id", V.CLASSES))


# --- F8, L7-L19 ---------------------------------------------------------------------------


@register("roc_points", f"""WITH d AS (SELECT recipe, score AS s, count(*) FILTER (y_true = 3) AS pos, count(*) FILTER (y_true <> 3) AS neg FROM {{preds}} GROUP BY ALL)
    SELECT recipe, {R('s', 'threshold')}, {R('sum(pos) OVER (PARTITION BY recipe ORDER BY s DESC) / CAST(sum(pos) OVER (PARTITION BY recipe) AS DOUBLE)', 'tpr')},
    {R('sum(neg) OVER (PARTITION BY recipe ORDER BY s DESC) / CAST(sum(neg) OVER (PARTITION BY recipe) AS DOUBLE)', 'fpr')} FROM d""")
def roc_points(spark, sf):
    return doubles(M.roc_points(V.preds(spark, sf), ["recipe"], "score", F.col("y_true") == 3))


VOTE = """v0 AS (SELECT fold, group_id, count(*) AS n_rows, count(*) FILTER (y_pred = 1) AS n_low, count(*) FILTER (y_pred = 3) AS n_high,
      avg(1-score) AS mean_p_low, avg(score) AS mean_p_high, coalesce(stddev_samp(1-score), 0) AS std_p_low, coalesce(stddev_samp(score), 0) AS std_p_high,
      count(*) FILTER (y_true = 3) AS t3, count(*) FILTER (y_true = 1) AS t1 FROM {preds} GROUP BY fold, group_id),
    v AS (SELECT *, CAST(CASE WHEN t1 >= t3 THEN 1 ELSE 3 END AS BIGINT) AS true_label,
      CAST(CASE WHEN n_low > n_high THEN 1 WHEN n_high > n_low THEN 3 WHEN mean_p_high > 0.5 THEN 3 ELSE 1 END AS BIGINT) AS pred_label,
      CASE WHEN n_low = n_high THEN 0.5 ELSE greatest(n_low, n_high) / CAST(n_rows AS DOUBLE) END AS confidence,
      -(mean_p_low*log2(mean_p_low+2.220446049250313e-16) + mean_p_high*log2(mean_p_high+2.220446049250313e-16)) AS entropy FROM v0),
    w AS (SELECT *, true_label = pred_label AS correct FROM v)"""
VOTE_COLS = ", ".join(R(c, c) for c in ("mean_p_low", "mean_p_high", "std_p_low", "std_p_high", "confidence", "entropy"))


def votes(spark, sf):
    return M.vote_rollup(V.preds(spark, sf), ["fold"], "group_id")


@register("vote_rollup_conf", f"WITH {VOTE} SELECT fold, group_id, true_label, n_rows, n_low, n_high, pred_label, correct, {VOTE_COLS} FROM w")
def vote_rollup_conf(spark, sf):
    return doubles(votes(spark, sf))


@register("mean_posterior_rollup", f"""WITH {VOTE}, t AS (SELECT fold, group_id, 2 * sum(CAST(score AS DECIMAL(18,12))) > count(score) AS more FROM {{preds}} GROUP BY fold, group_id)
    SELECT group_id, true_label AS y_true, {R('mean_p_low', 'p_low')}, {R('mean_p_high', 'p_high')},
    CAST(CASE WHEN more THEN 3 ELSE 1 END AS BIGINT) AS y_pred FROM w JOIN t USING (fold, group_id)""")
def mean_posterior_rollup(spark, sf):
    return doubles(M.mean_posterior_rollup(V.preds(spark, sf), [], "group_id"))


def sql_counts(src: str, true: str, pred: str, positive: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    return (f"SELECT {k}count(*) FILTER ({true}={positive} AND {pred}={positive}) AS tp, count(*) FILTER ({true}<>{positive} AND {pred}={positive}) AS fp, "
            f"count(*) FILTER ({true}<>{positive} AND {pred}<>{positive}) AS tn, count(*) FILTER ({true}={positive} AND {pred}<>{positive}) AS fn "
            f"FROM {src} {'GROUP BY ' + key if key else ''}")


THREE = "(tp+tn)/CAST(tp+fp+tn+fn AS DOUBLE) AS accuracy, tp/nullif(CAST(tp+fn AS DOUBLE), 0) AS sensitivity, tn/nullif(CAST(tn+fp AS DOUBLE), 0) AS specificity"


@register("compare_rollups", f"""WITH {VOTE}, u AS (SELECT true_label AS t, CASE WHEN n_high > n_low THEN 3 ELSE 1 END AS p1, CASE WHEN mean_p_high > mean_p_low THEN 3 ELSE 1 END AS p2 FROM w),
    a AS (SELECT {THREE} FROM ({sql_counts('u', 't', 'p1', '3')})), b AS (SELECT {THREE} FROM ({sql_counts('u', 't', 'p2', '3')}))
    SELECT {R('a.accuracy', 'vote_accuracy')}, {R('a.sensitivity', 'vote_sensitivity')}, {R('a.specificity', 'vote_specificity')}, {R('b.accuracy', 'mean_accuracy')},
    {R('b.sensitivity', 'mean_sensitivity')}, {R('b.specificity', 'mean_specificity')}, {R('b.accuracy-a.accuracy', 'diff_accuracy')},
    {R('b.sensitivity-a.sensitivity', 'diff_sensitivity')}, {R('b.specificity-a.specificity', 'diff_specificity')} FROM a, b""")
def compare_rollups(spark, sf):
    return doubles(M.compare_rollups(V.preds(spark, sf), "group_id"))


BIN = f"{THREE}, tp/nullif(CAST(tp+fp AS DOUBLE), 0) AS ppv, tn/nullif(CAST(tn+fn AS DOUBLE), 0) AS npv, 2*tp/nullif(CAST(2*tp+fp+fn AS DOUBLE), 0) AS f1"


@register("binary_metrics_npv", f"""WITH b AS (SELECT *, {BIN} FROM ({sql_counts('{preds}', 'y_true', 'y_pred', '3', 'fold')}))
    SELECT fold, tp, fp, tn, fn, {', '.join(R(c, c) for c in ('accuracy', 'sensitivity', 'specificity', 'ppv', 'npv', 'f1'))} FROM b""")
def binary_metrics_npv(spark, sf):
    return doubles(M.binary_metrics_npv(V.preds(spark, sf), ["fold"], 3))


@register("binary_metrics_floor", f"""WITH c AS ({sql_counts('{preds_docs}', 'y_true', 'y_pred', '1')}),
    b AS (SELECT *, (tp+tn)/CAST(greatest(tp+fp+tn+fn, 1) AS DOUBLE) AS accuracy, tp/CAST(greatest(tp+fn, 1) AS DOUBLE) AS sensitivity,
      tn/CAST(greatest(tn+fp, 1) AS DOUBLE) AS specificity, tp/CAST(greatest(tp+fp, 1) AS DOUBLE) AS precision FROM c)
    SELECT tp, fp, tn, fn, {', '.join(R(c, c) for c in ('accuracy', 'sensitivity', 'specificity', 'precision'))},
    {R('coalesce(2*precision*sensitivity/nullif(precision+sensitivity, 0), 0)', 'f1')} FROM b""")
def binary_metrics_floor(spark, sf):
    return doubles(M.binary_metrics_floor(V.preds_docs(spark, sf), [], 1))


@register("confidence_metrics", f"""WITH {VOTE} SELECT fold, {R('avg(confidence)', 'mean_confidence')}, {R('coalesce(stddev_samp(confidence), 0)', 'std_confidence')},
    {R('avg(entropy)', 'mean_entropy')}, {R('coalesce(stddev_samp(entropy), 0)', 'std_entropy')}, count(*) FILTER (confidence >= 0.56) AS n_high,
    {R('count(*) FILTER (confidence >= 0.56 AND correct)/nullif(CAST(count(*) FILTER (confidence >= 0.56) AS DOUBLE), 0)', 'acc_high')},
    count(*) FILTER (confidence <= 0.54) AS n_low, {R('count(*) FILTER (confidence <= 0.54 AND correct)/nullif(CAST(count(*) FILTER (confidence <= 0.54) AS DOUBLE), 0)', 'acc_low')}
    FROM w GROUP BY fold""")
def confidence_metrics(spark, sf):
    return doubles(M.confidence_metrics(votes(spark, sf), ["fold"], 0.56, 0.54))


FLAG = """CASE WHEN confidence >= 0.85 AND correct THEN 'High Confidence - Correct' WHEN confidence >= 0.85 THEN 'High Confidence - INCORRECT (Review!)'
    WHEN confidence <= 0.6 THEN 'Low Confidence - Ambiguous Case' ELSE 'Moderate Confidence' END"""
# Order lines roll up to small groups, so every band occurs.
LINE_VOTE = VOTE.replace("SELECT fold, group_id,", "SELECT fold, order_id AS group_id,").replace("GROUP BY fold, group_id", "GROUP BY fold, order_id")


def line_votes(spark, sf):
    p = V.preds(spark, sf).drop("group_id").withColumnRenamed("order_id", "group_id")
    return M.vote_rollup(p, ["fold"], "group_id")


@register("interpretation_flag", f"WITH {LINE_VOTE} SELECT fold, group_id, {FLAG} AS flag FROM w")
def interpretation_flag(spark, sf):
    return M.flagged(line_votes(spark, sf)).select("fold", "group_id", "flag")


@register("flag_shares", f"WITH {LINE_VOTE}, f AS (SELECT {FLAG} AS flag FROM w) SELECT flag, count(*) AS n, {R('100.0*count(*)/sum(count(*)) OVER ()', 'percent')} FROM f GROUP BY flag")
def flag_shares(spark, sf):
    return doubles(M.flag_shares(M.flagged(line_votes(spark, sf))))


@register("f_beta", f"""WITH b AS (SELECT *, {BIN} FROM ({sql_counts('{preds}', 'y_true', 'y_pred', '3', 'fold')}))
    SELECT fold, {R('5*ppv*sensitivity/nullif(4*ppv+sensitivity, 0)', 'f2')} FROM b""")
def f_beta(spark, sf):
    b = M.binary_metrics_npv(V.preds(spark, sf), ["fold"], 3)
    return b.select("fold", r6(M.f_beta(F.col("ppv"), F.col("sensitivity"))).alias("f2"))


@register("balanced_accuracy", f"""WITH b AS (SELECT *, {BIN} FROM ({sql_counts('{preds}', 'y_true', 'y_pred', '3', 'fold')}))
    SELECT fold, {R('(sensitivity+specificity)/2', 'balanced')} FROM b""")
def balanced_accuracy(spark, sf):
    b = M.binary_metrics_npv(V.preds(spark, sf), ["fold"], 3)
    return b.select("fold", r6(M.balanced_accuracy(F.col("sensitivity"), F.col("specificity"))).alias("balanced"))


@register("metrics_long", f"""WITH b AS (SELECT recipe, {BIN} FROM ({sql_counts('{preds}', 'y_true', 'y_pred', '3', 'recipe')})), {sql_auc('{preds}', ['recipe'], 'score', 'y_true = 3')},
    x AS (SELECT b.*, (sensitivity+specificity)/2 AS balanced_accuracy, 5*ppv*sensitivity/nullif(4*ppv+sensitivity, 0) AS f2, auc FROM b JOIN auc USING (recipe))
    SELECT recipe, metric, round(value, 6) + 0.0 AS value FROM x UNPIVOT INCLUDE NULLS (value FOR metric IN (accuracy, balanced_accuracy, sensitivity, specificity, ppv, npv, f1, f2, auc))""")
def metrics_long(spark, sf):
    return rounded(E.test_report(V.preds(spark, sf), ["recipe"], 3), "value")


def poisson_sql() -> str:
    """Poisson(1) by its distribution function, written as sums of 1/k! over e."""
    terms, out = [], []
    fact = 1
    for k in range(13):
        fact *= max(k, 1)
        terms.append(f"{fact}")
        out.append(f"WHEN u < exp(-1.0) * ({' + '.join('1.0/' + t for t in terms)}) THEN {k}")
    return f"CASE {' '.join(out)} ELSE 13 END"


BOOT = f"""b AS (SELECT y_true, score, CAST(blk*4 + i + 1 AS BIGINT) AS replicate,
      CAST('0x' || substr(md5('42:'||order_id||':'||line_no||':'||sample_id||':'||group_id||':'||blk), 8*i + 1, 8) AS BIGINT) / 4294967296.0 AS u FROM {{preds}}, range(0, 50) x(blk), range(0, 4) y(i)),
    w AS (SELECT y_true, score, replicate, {poisson_sql()} AS w FROM b WHERE replicate <= 200), {sql_auc('w', ['replicate'], 'score', 'y_true = 3', weight='w')}"""
IDENT = ["order_id", "line_no", "sample_id", "group_id"]


@register("auc_replicates", f"WITH {BOOT} SELECT replicate, {R('auc', 'auc')} FROM auc")
def auc_replicates(spark, sf):
    return rounded(M.auc_replicates(V.preds(spark, sf), IDENT, "score", F.col("y_true") == 3), "auc")


@register("auc_bootstrap_ci", f"WITH {BOOT} SELECT {R('avg(auc)', 'auc_mean')}, {R('quantile_cont(auc, 0.025)', 'ci_low')}, {R('quantile_cont(auc, 0.975)', 'ci_high')} FROM auc")
def auc_bootstrap_ci(spark, sf):
    return doubles(M.auc_bootstrap_ci(V.preds(spark, sf), IDENT, "score", F.col("y_true") == 3))


@register("misclassified", "SELECT order_id, line_no, y_true, y_pred FROM {preds} WHERE y_true <> y_pred")
def misclassified(spark, sf):
    from wavecohort.operators.cleaning import misclassified as op
    return op(V.preds(spark, sf)).select("order_id", "line_no", "y_true", "y_pred")


# --- G1, M --------------------------------------------------------------------------------

FOLD_KEYS = ["recipe", "classifier", "repeat", "fold"]
PER_FOLD = f"{sql_eval('e', '{preds}', FOLD_KEYS)}, {sql_rollup('g', '{preds}', ', '.join(FOLD_KEYS) + ', group_id')}, {sql_eval('h', 'g', FOLD_KEYS)}, pf AS (SELECT 'signal' AS level, * FROM e UNION ALL SELECT 'group' AS level, * FROM h)"
SUM_COLS = ", ".join(f"avg({m}) AS mean_{m}, CASE WHEN count({m}) > 0 THEN coalesce(stddev_samp({m}), 0) END AS std_{m}, median({m}) AS median_{m}" for m in SIX)
SUMMARY = f"{PER_FOLD}, su AS (SELECT level, recipe, classifier, {SUM_COLS} FROM pf GROUP BY level, recipe, classifier)"
STAT_NAMES = [f"{s}_{m}" for m in SIX for s in ("mean", "std", "median")]


def per_fold(spark, sf):
    return S.fold_metrics(V.preds(spark, sf), V.CLASSES)


def summary(spark, sf):
    return S.summarize(per_fold(spark, sf))


def level(df, name="signal"):
    return df.where(F.col("level") == name)


@register("fold_metrics", f"WITH {PER_FOLD} SELECT level, recipe, classifier, repeat, fold, n, {SIX_COLS} FROM pf")
def fold_metrics(spark, sf):
    return doubles(per_fold(spark, sf))


@register("summarize", f"WITH {SUMMARY} SELECT level, recipe, classifier, {', '.join(R(c, c) for c in STAT_NAMES)} FROM su")
def summarize(spark, sf):
    return doubles(summary(spark, sf))


EIGHT = f"""recipe AS "Permutation", classifier AS "Classifier", {R('mean_accuracy', '"MeanAccuracy"')}, {R('std_accuracy', '"StdAccuracy"')},
    {R('mean_macro_f1', '"MeanF1"')}, {R('std_macro_f1', '"StdF1"')}, {R('mean_auc', '"MeanAUC"')}, {R('std_auc', '"StdAUC"')}"""


@register("to_table", f"WITH {SUMMARY} SELECT {EIGHT} FROM su WHERE level = 'signal'")
def to_table(spark, sf):
    return doubles(S.to_table(level(summary(spark, sf))))


@register("sink_summary_csv", f"WITH {SUMMARY} SELECT {EIGHT} FROM su WHERE level = 'group'")
def sink_summary_csv(spark, sf):
    path = scratch(spark, "summary")
    sinks.sink_summary_csv(level(summary(spark, sf), "group"), path)
    schema = "Permutation string, Classifier string, MeanAccuracy double, StdAccuracy double, MeanF1 double, StdF1 double, MeanAUC double, StdAUC double"
    return doubles(tables.scan_csv_metrics(spark, path, schema))


@register("best_configuration", f"WITH {SUMMARY} SELECT recipe, classifier, {R('mean_macro_f1', 'mean_macro_f1')} FROM su WHERE level = 'signal' AND mean_macro_f1 IS NOT NULL ORDER BY su.mean_macro_f1 DESC, recipe, classifier LIMIT 1")
def best_configuration(spark, sf):
    best = S.best_configuration(level(summary(spark, sf)), "mean_macro_f1", RECIPES, CLASSIFIERS)
    return doubles(best.select("recipe", "classifier", "mean_macro_f1"))


@register("best_by_metric", f"""WITH {SUMMARY}, l AS (SELECT level, recipe, classifier, metric, value FROM (SELECT level, recipe, classifier, mean_accuracy, mean_macro_f1, mean_auc FROM su)
    UNPIVOT (value FOR metric IN (mean_accuracy, mean_macro_f1, mean_auc))),
    r AS (SELECT *, row_number() OVER (PARTITION BY level, metric ORDER BY value DESC, recipe, classifier) AS k FROM l)
    SELECT level, metric, recipe, classifier, {R('value', 'value')} FROM r WHERE k = 1""")
def best_by_metric(spark, sf):
    return doubles(S.best_by_metric(summary(spark, sf), ["mean_accuracy", "mean_macro_f1", "mean_auc"], RECIPES, CLASSIFIERS))


@register("compare_classifiers", f"""WITH {SUMMARY} SELECT classifier, count(mean_accuracy) AS n_recipes, {R('avg(mean_accuracy)', 'mean_value')},
    {R('coalesce(stddev_samp(mean_accuracy), 0)', 'std_value')} FROM su WHERE level = 'signal' GROUP BY classifier""")
def compare_classifiers(spark, sf):
    return doubles(S.compare_classifiers(level(summary(spark, sf)), "mean_accuracy"))


@register("heatmap_table", f"""WITH {SUMMARY} SELECT recipe, {R("max(mean_auc) FILTER (classifier = 'PCA-LDA')", '"PCA-LDA"')},
    {R("max(mean_auc) FILTER (classifier = 'PLS-DA')", '"PLS-DA"')} FROM su WHERE level = 'signal' GROUP BY recipe""")
def heatmap_table(spark, sf):
    return doubles(S.heatmap_table(level(summary(spark, sf)), "mean_auc", CLASSIFIERS))


@register("recipe_comparison", f"WITH {SUMMARY} SELECT recipe, classifier, {R('mean_macro_f1', 'value')} FROM su WHERE level = 'group'")
def recipe_comparison(spark, sf):
    return doubles(S.recipe_comparison(level(summary(spark, sf), "group"), "mean_macro_f1"))


@register("fold_distribution", f"WITH {PER_FOLD} SELECT recipe||'+'||classifier AS config, repeat, fold, {R('macro_f1', 'value')} FROM pf WHERE level = 'signal'")
def fold_distribution(spark, sf):
    return doubles(S.fold_distribution(level(per_fold(spark, sf)), "macro_f1"))


@register("box_stats", f"""WITH {PER_FOLD} SELECT recipe||'+'||classifier AS config, count(accuracy) AS n, {R('min(accuracy)', 'low')}, {R('quantile_cont(accuracy, 0.25)', 'q1')},
    {R('median(accuracy)', 'median')}, {R('quantile_cont(accuracy, 0.75)', 'q3')}, {R('max(accuracy)', 'high')} FROM pf WHERE level = 'signal' GROUP BY ALL""")
def box_stats(spark, sf):
    return doubles(S.box_stats(S.fold_distribution(level(per_fold(spark, sf)), "accuracy")))


FA = ", ".join(f"{R(f'avg({m})', f'mean_{m}')}, {R(f'stddev_samp({m})', f'std_{m}')}, {R(f'avg({m}) - 1.96*stddev_samp({m})/sqrt(count({m}))', f'ci_low_{m}')}, {R(f'avg({m}) + 1.96*stddev_samp({m})/sqrt(count({m}))', f'ci_high_{m}')}"
               for m in ("accuracy", "sensitivity", "specificity", "f1"))
FA += ", " + ", ".join(f"{R(f'avg({m})', f'mean_{m}')}, {R(f'stddev_samp({m})', f'std_{m}')}" for m in ("ppv", "npv"))


@register("fold_aggregate", f"""WITH b AS (SELECT recipe, fold, {BIN} FROM ({sql_counts('{preds}', 'y_true', 'y_pred', '3', 'recipe, fold')})) SELECT recipe, {FA} FROM b GROUP BY recipe""")
def fold_aggregate(spark, sf):
    return doubles(S.fold_aggregate(M.binary_metrics_npv(V.preds(spark, sf), ["recipe", "fold"], 3), ["recipe"]))


CS = ", ".join(f"avg({m}) AS mean_{m}, stddev_samp({m}) AS std_{m}" for m in ("accuracy", "sensitivity", "specificity", "f2", "auc"))
CS_OUT = ", ".join(R(f"{s}_{m}", f"{s}_{m}") for m in ("accuracy", "sensitivity", "specificity", "f2", "auc") for s in ("mean", "std"))


@register("classifier_summary", f"""WITH b AS (SELECT classifier, repeat, {BIN} FROM ({sql_counts('{preds}', 'y_true', 'y_pred', '3', 'classifier, repeat')})), {sql_auc('{preds}', ['classifier', 'repeat'], 'score', 'y_true = 3')},
    x AS (SELECT b.*, 5*ppv*sensitivity/nullif(4*ppv+sensitivity, 0) AS f2, auc FROM b JOIN auc USING (classifier, repeat)), t AS (SELECT classifier, {CS} FROM x GROUP BY classifier)
    SELECT classifier, {CS_OUT}, row_number() OVER (ORDER BY t.mean_f2 DESC, classifier) = 1 AS is_best FROM t""")
def classifier_summary(spark, sf):
    p = V.preds(spark, sf)
    keys = ["classifier", "repeat"]
    b = M.binary_metrics_npv(p, keys, 3).withColumn("f2", M.f_beta(F.col("ppv"), F.col("sensitivity")))
    return doubles(S.classifier_summary(b.join(M.auc_binary(p, keys, 3), keys)))


@register("detailed_results", f"WITH {VOTE} SELECT fold, group_id, true_label, pred_label, correct, n_rows, n_low, n_high, {VOTE_COLS}, {FLAG} AS flag FROM w")
def detailed_results(spark, sf):
    return doubles(S.detailed_results(votes(spark, sf)))


@register("train_test_gap", f"""WITH {SUMMARY}, t AS (SELECT * FROM pf WHERE repeat = 2 AND fold = 3),
    a AS (SELECT level, recipe, classifier, metric, cv_value FROM (SELECT level, recipe, classifier, {', '.join(f'mean_{m} AS {m}' for m in SIX)} FROM su) UNPIVOT INCLUDE NULLS (cv_value FOR metric IN ({', '.join(SIX)}))),
    b AS (SELECT level, recipe, classifier, metric, test_value FROM (SELECT level, recipe, classifier, {', '.join(SIX)} FROM t) UNPIVOT INCLUDE NULLS (test_value FOR metric IN ({', '.join(SIX)})))
    SELECT level, recipe, classifier, metric, {R('cv_value', 'cv_value')}, {R('test_value', 'test_value')}, {R('cv_value - test_value', 'gap')} FROM a JOIN b USING (level, recipe, classifier, metric)""")
def train_test_gap(spark, sf):
    folds = per_fold(spark, sf)
    test = folds.where((F.col("repeat") == 2) & (F.col("fold") == 3))
    return doubles(S.train_test_gap(S.summarize(folds), test))


@register("full_report", f"WITH {SUMMARY} SELECT level, recipe, classifier, {', '.join(R(c, c) for c in STAT_NAMES)} FROM su")
def full_report(spark, sf):
    """Writes every table, then reads the stored summary."""
    path = scratch(spark, "report")
    report.full_report(V.preds(spark, sf), path, V.CLASSES, RECIPES, CLASSIFIERS)
    return doubles(spark.read.parquet(f"{path}/summary"))
