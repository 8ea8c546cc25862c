"""Queries on moments, components, classifiers, cross-validation and outliers.

Where a model has a closed form in SQL (one feature, one component, or all
components) the query is checked by it; the rest is covered by unit tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.catalog import views as V
from wavecohort.catalog.scores import FOLD_KEYS, STAT_NAMES, SUM_COLS, R, doubles, sql_eval, sql_rollup
from wavecohort.catalog.tables import scratch
from wavecohort.catalog.transforms import TRAIN, is_train
from wavecohort.catalog.views import r6, register, rounded
from wavecohort.models import classifiers as C
from wavecohort.models import store
from wavecohort.models.regression import lda_weighted_priors as weighted_priors
from wavecohort.models.regression import pls_regress as regress
from wavecohort.operators import folds as K
from wavecohort.operators import outliers as O
from wavecohort.operators import summary as S
from wavecohort.operators.moments import moments as gather
from wavecohort.plans import cv, evaluate, tuning
from wavecohort.session import cut_lineage
from wavecohort.sources import sinks

KEEP = ("signal_id", "sample_id", "group_id")
LINE_KEEP = ("order_id", "line_no", "group_id")


def lines(spark, sf):
    """Line items as one-feature signals with a two-class label."""
    return V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line_no"),
        F.col("l_suppkey").alias("group_id"),
        F.when(F.col("l_returnflag") == "R", F.lit(3)).otherwise(F.lit(1)).cast("long").alias("y"),
        F.array(F.col("l_extendedprice") / 10000.0).alias("features"))


LINES = """l AS (SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, l_suppkey AS group_id,
    CAST(CASE WHEN l_returnflag='R' THEN 3 ELSE 1 END AS BIGINT) AS y, l_extendedprice/10000.0 AS x FROM lineitem)"""


def is_train_line():
    return F.substring(F.md5(F.concat(F.lit("split:"), F.col("group_id").cast("string"))), 1, 1) < "b"


def scored(preds, *keep):
    """Ids, labels and both scores of two-class predictions."""
    return preds.select(*keep, "y_true", "y_pred", r6(F.col("scores")[0]).alias("score_1"), r6(F.col("scores")[1]).alias("score_2"))


# --- moments and components -----------------------------------------------------------------


@register("moments", f"""WITH a AS (SELECT signal_id, y, pos, value FROM {{traces}})
    SELECT a.y, a.pos AS i, b.pos AS j, count(*) AS n, {R('covar_samp(a.value, b.value)', 'cov')} FROM a JOIN a b ON a.signal_id = b.signal_id GROUP BY ALL""")
def moments(spark, sf):
    s = V.signals(spark, sf)
    m = gather(s, ["y"])
    d = F.size("mean")
    e = m.select("y", "n", "mean", F.posexplode("scatter").alias("p", "v")).withColumns(
        {"i": F.floor(F.col("p") / d).cast("long"), "j": (F.col("p") % d).cast("long")})
    return e.select("y", "i", "j", "n", r6(F.col("v") / (F.col("n") - 1)).alias("cov"))


@register("moments_by_sample", f"SELECT sample_id, count(DISTINCT signal_id) AS n, {R('sum(value*value)', 'trace')} FROM {{traces}} GROUP BY sample_id")
def moments_by_sample(spark, sf):
    """Keys that grow with the data: rows are gathered by sample first."""
    s = V.signals(spark, sf)
    m = gather(s, ["sample_id"], gather=3)
    # the sum of squares is the centred one and n times the squared mean
    diagonal = F.transform(F.sequence(F.lit(0), F.lit(V.WIDTH - 1)), lambda i: F.get("scatter", i * (V.WIDTH + 1)) + F.col("n") * F.get("mean", i) * F.get("mean", i))
    return m.select("sample_id", "n", r6(F.aggregate(diagonal, F.lit(0.0), lambda a, v: a + v)).alias("trace"))


@register("pca_fit")
def pca_fit(spark, sf):
    s = V.signals(spark, sf)
    return O.pca_table(s, O.pca(s))


@register("pca_fit_invariants", f"""WITH c AS (SELECT a.pos AS i, b.pos AS j, covar_samp(a.value, b.value) AS v FROM {{traces}} a JOIN {{traces}} b ON a.signal_id = b.signal_id GROUP BY ALL)
    SELECT {R('sum(v) FILTER (i = j)', 'total')}, {R('sum(v*v)', 'squares')}, {R('CAST(100.0 AS DOUBLE)', 'explained')} FROM c""")
def pca_fit_invariants(spark, sf):
    """Eigenvalues add up to the variance, their squares to the squared covariances."""
    s = V.signals(spark, sf)
    t = O.pca_table(s, O.pca(s, 1.1, V.WIDTH))
    return t.agg(r6(F.sum("latent")).alias("total"), r6(F.sum(F.col("latent") ** 2)).alias("squares"), r6(F.sum("explained")).alias("explained"))


ENERGY = f"""WITH m AS (SELECT pos, avg(value) AS mu, stddev_samp(value) AS sd FROM {{traces}} GROUP BY pos)
    SELECT signal_id, {{expr}} FROM {{traces}} t JOIN m ON t.pos = m.pos GROUP BY signal_id"""


def energy(col):
    return F.aggregate(col, F.lit(0.0), lambda a, t: a + t * t)


@register("pca_project", ENERGY.replace("{expr}", R("sum((value-mu)*(value-mu))", "energy")))
def pca_project(spark, sf):
    """With all components the squared scores add up to the squared distance from the mean."""
    s = V.signals(spark, sf)
    fit = O.pca(s, 1.1, V.WIDTH)
    return O.project(s, ["signal_id"], fit.mean, fit.coeff).select("signal_id", r6(energy(F.col("pc"))).alias("energy"))


@register("pca_standardized", ENERGY.replace("{expr}", R("sum((value-mu)*(value-mu)/(sd*sd))", "energy")))
def pca_standardized(spark, sf):
    s = V.signals(spark, sf)
    fit, _ = O.pca_standardized(s, 1.1)
    return O.project(s, ["signal_id"], fit.mean, fit.coeff).select("signal_id", r6(energy(F.col("pc"))).alias("energy"))


@register("top_components")
def top_components(spark, sf):
    s = V.signals(spark, sf)
    return O.top_components(O.pca_table(s, O.pca(s, 1.1, V.WIDTH)), 20)


@register("pca_truncate")
def pca_truncate(spark, sf):
    s = V.signals(spark, sf)
    return O.pca_truncate(O.pca_table(s, O.pca(s, 1.1, V.WIDTH)), 15)


@register("pca_scatter")
def pca_scatter(spark, sf):
    s = V.signals(spark, sf)
    preds = C.fit("PCA-LDA", "10200X", s, "y", V.CLASSES).predict(s, ["signal_id"], "y")
    points = O.pca_scatter(s, O.pca(s), ["signal_id", "y"])
    return points.join(preds.select("signal_id", (F.col("y_true") == F.col("y_pred")).alias("correct")), "signal_id")


# --- linear classifiers ---------------------------------------------------------------------


def sql_lda(train: str, rows: str, keys: str = "", cost: float = 1.0) -> str:
    """One-feature discriminant: tables named st (class statistics) and out (posterior per row)."""
    k = f"{keys}, " if keys else ""
    on = f"USING ({keys})" if keys else "ON true"
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""cl AS (SELECT {k}count(*) FILTER (y=1) AS n1, count(*) FILTER (y=3) AS n3, avg(x) FILTER (y=1) AS m1, avg(x) FILTER (y=3) AS m3,
      (var_pop(x) FILTER (y=1) * count(*) FILTER (y=1) + var_pop(x) FILTER (y=3) * count(*) FILTER (y=3)) / (count(*) - 2) AS v, avg(x) AS m FROM {train} {grp}),
    sc AS (SELECT r.*, x*m1/v - 0.5*m1*m1/v + ln(CAST(n1 AS DOUBLE)) AS d1, x*m3/v - 0.5*m3*m3/v + ln({cost!r}*n3) AS d3 FROM {rows} r JOIN cl {on}),
    out AS (SELECT *, 1/(1+exp(d1-d3)) AS p3 FROM sc)"""


LDA_OUT = f"SELECT order_id, line_no, y AS y_true, CAST(CASE WHEN d3 > d1 THEN 3 ELSE 1 END AS BIGINT) AS y_pred, {R('1-p3', 'score_1')}, {R('p3', 'score_2')} FROM out"


@register("lda_fit")
def lda_fit(spark, sf):
    return C.fit("PCA-LDA", "10200X", V.signals(spark, sf), "y", V.CLASSES).to_rows(spark)


@register("lda_predict", f"WITH {LINES}, {sql_lda('l', 'l')} {LDA_OUT}")
def lda_predict(spark, sf):
    rows = lines(spark, sf)
    return scored(C.fit("PCA-LDA", "10200X", rows, "y", V.CLASSES).predict(rows, LINE_KEEP, "y"), "order_id", "line_no")


@register("lda_pseudo", f"WITH {LINES}, {sql_lda('l', 'l')} {LDA_OUT}")
def lda_pseudo(spark, sf):
    """A second feature that is twice the first makes the covariance singular and changes nothing."""
    rows = lines(spark, sf).withColumn("features", F.array(F.col("features")[0], F.col("features")[0] * 2.0))
    model = C.fit("PCA-LDA", "10000X", rows, "y", V.CLASSES, {"pca_variance_threshold": 1.1})
    return scored(model.predict(rows, LINE_KEEP, "y"), "order_id", "line_no")


@register("lda_weighted_priors", f"WITH {LINES} SELECT group_id, {R('count(*) FILTER (y=1)/(count(*) FILTER (y=1) + 5.0*count(*) FILTER (y=3))', 'prior_low')}, {R('5.0*count(*) FILTER (y=3)/(count(*) FILTER (y=1) + 5.0*count(*) FILTER (y=3))', 'prior_high')} FROM l GROUP BY group_id")
def lda_weighted_priors(spark, sf):
    return doubles(weighted_priors(lines(spark, sf), ["group_id"], "y", 1, 3, 5.0))


@register("cost_sensitive_lda", f"WITH {LINES}, {sql_lda('l', 'l', cost=5.0)} {LDA_OUT}")
def cost_sensitive_lda(spark, sf):
    rows = lines(spark, sf)
    return scored(evaluate.cost_sensitive_fit("PCA-LDA", "10200X", rows, "y", V.CLASSES).predict(rows, LINE_KEEP, "y"), "order_id", "line_no")


def sql_ols(target: str, train: str, rows: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    on = f"USING ({keys})" if keys else "ON true"
    return f"""rg AS (SELECT {k}regr_slope({target}, x) AS b, regr_intercept({target}, x) AS a FROM {train} {'GROUP BY ' + keys if keys else ''}),
    ft AS (SELECT r.*, a + b*x AS fit FROM {rows} r JOIN rg {on}),
    pls AS (SELECT *, exp(-abs(fit-1)) AS e1, exp(-abs(fit-2)) AS e2, greatest(1, least(2, round(fit))) AS c FROM ft)"""


NUM = "CASE WHEN y = 3 THEN 2.0 ELSE 1.0 END"
PLS_OUT = f"SELECT order_id, line_no, y AS y_true, CAST(CASE WHEN c = 2 THEN 3 ELSE 1 END AS BIGINT) AS y_pred, {R('e1/(e1+e2)', 'score_1')}, {R('e2/(e1+e2)', 'score_2')} FROM pls"


@register("plsda_predict", f"WITH {LINES}, {sql_ols(NUM, 'l', 'l')} {PLS_OUT}")
def plsda_predict(spark, sf):
    rows = lines(spark, sf)
    return scored(C.fit("PLS-DA", "10200X", rows, "y", V.CLASSES).predict(rows, LINE_KEEP, "y"), "order_id", "line_no")


@register("plsda_fit", f"""WITH yy AS (SELECT signal_id, y, CASE WHEN y = 3 THEN 2.0 ELSE 1.0 END AS n FROM {{signals}}), my AS (SELECT avg(n) AS my FROM yy),
    c AS (SELECT signal_id, pos, value - avg(value) OVER (PARTITION BY pos) AS v FROM {{traces}}),
    w AS (SELECT pos, sum(v*(n-my)) AS w FROM c JOIN yy USING (signal_id), my GROUP BY pos),
    t AS (SELECT signal_id, sum(v*w) AS t FROM c JOIN w USING (pos) GROUP BY signal_id),
    q AS (SELECT sum(t*(n-my))/sum(t*t) AS q FROM t JOIN yy USING (signal_id), my),
    f AS (SELECT signal_id, y, my + t*q AS fit FROM t JOIN yy USING (signal_id), my, q)
    SELECT signal_id, y AS y_true, CAST(CASE WHEN round(fit) >= 2 THEN 3 ELSE 1 END AS BIGINT) AS y_pred,
    {R('exp(-abs(fit-1))/(exp(-abs(fit-1))+exp(-abs(fit-2)))', 'score_1')}, {R('exp(-abs(fit-2))/(exp(-abs(fit-1))+exp(-abs(fit-2)))', 'score_2')} FROM f""")
def plsda_fit(spark, sf):
    """One component on 64 features."""
    s = V.signals(spark, sf)
    return scored(C.fit("PLS-DA", "10000X", s, "y", V.CLASSES, {"pls_ncomp": 1}).predict(s, ["signal_id"], "y"), "signal_id")


@register("plsda_fit_ten")
def plsda_fit_ten(spark, sf):
    return C.fit("PLS-DA", "10220X", V.signals(spark, sf), "y", V.CLASSES).to_rows(spark)


@register("plsda_pm1", f"""WITH {LINES}, rg AS (SELECT regr_slope(CASE WHEN y=1 THEN 1.0 ELSE -1.0 END, x) AS b, regr_intercept(CASE WHEN y=1 THEN 1.0 ELSE -1.0 END, x) AS a FROM l),
    f AS (SELECT l.*, a + b*x AS fit FROM l, rg)
    SELECT order_id, line_no, y AS y_true, CAST(CASE WHEN fit >= 0 THEN 1 ELSE 3 END AS BIGINT) AS y_pred, {R('1/(1+exp(-fit))', 'score_1')}, {R('1-1/(1+exp(-fit))', 'score_2')} FROM f""")
def plsda_pm1(spark, sf):
    rows = lines(spark, sf)
    return scored(C.fit("PLS-PM1", "10000X", rows, "y", V.CLASSES).predict(rows, LINE_KEEP, "y"), "order_id", "line_no")


@register("pls_regress", f"""WITH d AS (SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, l_quantity/50 AS a, l_discount*10 AS b, l_extendedprice/10000 AS y1, l_tax*10 AS y2 FROM lineitem),
    s AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y1) AS a1, covar_pop(b, y1) AS b1, covar_pop(a, y2) AS a2, covar_pop(b, y2) AS b2,
      avg(a) AS ma, avg(b) AS mb, avg(y1) AS m1, avg(y2) AS m2 FROM d)
    SELECT order_id, line_no, {R('m1 + ((a1*bb-b1*ab)*(a-ma) + (b1*aa-a1*ab)*(b-mb))/(aa*bb-ab*ab)', 'fit_1')},
    {R('m2 + ((a2*bb-b2*ab)*(a-ma) + (b2*aa-a2*ab)*(b-mb))/(aa*bb-ab*ab)', 'fit_2')} FROM d, s""")
def pls_regress(spark, sf):
    """With as many components as features the fit is least squares."""
    rows = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line_no"),
        F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("features"),
        F.array(F.col("l_extendedprice") / 10000, F.col("l_tax") * 10).alias("responses"))
    out = regress(rows, 2).predict(rows, ["order_id", "line_no"])
    return out.select("order_id", "line_no", r6(F.col("fitted")[0]).alias("fit_1"), r6(F.col("fitted")[1]).alias("fit_2"))


@register("pls_scores")
def pls_scores(spark, sf):
    rows = V.signals(spark, sf).withColumn("responses", F.array((F.col("y") == 1).cast("double"), (F.col("y") == 3).cast("double")))
    fit = regress(rows, 3)
    return fit.x_scores(rows, ["signal_id"]).join(fit.y_scores(rows, ["signal_id"]), "signal_id")


# --- classifiers through MLlib ----------------------------------------------------------------


def fitted(name, classifier, config=None, penalty=None):
    @register(name)
    def run(spark, sf):
        s = V.signals(spark, sf)
        train, test = s.where(is_train()), s.where(~is_train())
        if penalty is None:
            model = C.fit(classifier, "10200X", train, "y", V.CLASSES, config)
        else:
            model = evaluate.cost_sensitive_fit(classifier, "10200X", train, "y", V.CLASSES, penalty, config)
        return scored(model.predict(test, KEEP, "y"), *KEEP)


FOREST = {"rf_ntrees": 100, "rf_min_leaf_size": 5}
fitted("svm_rbf", "SVM-RBF")
fitted("svm_cost", "SVM-RBF", penalty=5.0)
fitted("svm_platt", "SVM-RBF", {"svm_platt": True})
fitted("random_forest", "RandomForest", FOREST)
fitted("rf_weighted", "RandomForest", FOREST, penalty=5.0)
fitted("logistic_baseline", "Logistic")


@register("cost_sensitive_train", f"WITH {LINES}, {sql_ols(NUM, 'l', 'l')} {PLS_OUT}")
def cost_sensitive_train(spark, sf):
    """The penalty leaves partial least squares as it is."""
    rows = lines(spark, sf)
    return scored(evaluate.cost_sensitive_fit("PLS-DA", "10200X", rows, "y", V.CLASSES).predict(rows, LINE_KEEP, "y"), "order_id", "line_no")


@register("fit_predict", f"WITH {LINES}, tr AS (SELECT * FROM l WHERE {TRAIN}), {sql_lda('tr', 'l')} {LDA_OUT}")
def fit_predict(spark, sf):
    rows = lines(spark, sf)
    model = C.fit("PCA-LDA", "10200X", rows.where(is_train_line()), "y", V.CLASSES)
    return scored(model.predict(rows, LINE_KEEP, "y"), "order_id", "line_no")



@register("sink_model_params", f"SELECT 'PCA-LDA' AS classifier, '10200X' AS recipe, CAST(2 AS BIGINT) AS n_outputs, max(CAST(len(features) AS BIGINT)) AS width FROM {{signals}}")
def sink_model_params(spark, sf):
    path = scratch(spark, "params")
    model = C.fit("PCA-LDA", "10200X", V.signals(spark, sf), "y", V.CLASSES)
    sinks.sink_model_params(model.to_rows(spark), path)
    return spark.read.parquet(path).groupBy("classifier", "recipe").agg(
        F.count(F.lit(1)).alias("n_outputs"), F.max(F.size("weights")).cast("long").alias("width"))


@register("reload_lda", f"WITH {LINES}, {sql_lda('l', 'l')} {LDA_OUT}")
def reload_lda(spark, sf):
    """Fitted, written, read back, and only then used."""
    rows, path = lines(spark, sf), scratch(spark, "model")
    store.save_model(spark, C.fit("PCA-LDA", "10200X", rows, "y", V.CLASSES), path)
    return scored(store.load_model(spark, path).predict(rows, LINE_KEEP, "y"), "order_id", "line_no")


# --- cross-validation and final evaluation -----------------------------------------------------

LINE_FOLDS = f"""{LINES}, gc AS (SELECT group_id, y, count(*) AS n FROM l GROUP BY ALL),
    gm AS (SELECT group_id, y FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, y) AS k FROM gc) WHERE k = 1),
    gf AS (SELECT rep, group_id, (row_number() OVER (PARTITION BY rep, y ORDER BY md5((41+rep)||':'||group_id), group_id) - 1) % 3 + 1 AS gfold FROM gm, range(1, 3) t(rep)),
    lf AS (SELECT l.*, CAST(rep AS BIGINT) AS repeat, CAST(gfold AS BIGINT) AS fold FROM l JOIN gf USING (group_id)),
    agg AS (SELECT repeat, fold, y, count(*) AS n, sum(x) AS s, sum(x*x) AS ss FROM lf GROUP BY ALL),
    tr AS (SELECT a.repeat, b.fold, a.y, sum(a.n) AS n, sum(a.s) AS s, sum(a.ss) AS ss FROM agg a JOIN (SELECT DISTINCT repeat, fold FROM agg) b
      ON a.repeat = b.repeat AND a.fold <> b.fold GROUP BY ALL),
    cl AS (SELECT repeat, fold, max(n) FILTER (y=1) AS n1, max(n) FILTER (y=3) AS n3, max(s/n) FILTER (y=1) AS m1, max(s/n) FILTER (y=3) AS m3,
      sum(ss - s*s/n)/(sum(n)-2) AS v, sum(s)/sum(n) AS m, sum(ss) - sum(s)*sum(s)/sum(n) AS xx FROM tr GROUP BY ALL),
    sc AS (SELECT r.*, (x-m)*(m1-m)/v - 0.5*(m1-m)*(m1-m)/v + ln(CAST(n1 AS DOUBLE)) AS d1, (x-m)*(m3-m)/v - 0.5*(m3-m)*(m3-m)/v + ln(CAST(n3 AS DOUBLE)) AS d3,
      (n1+2.0*n3)/(n1+n3) + (x-m) * (n1*(1-(n1+2.0*n3)/(n1+n3))*(m1-m) + n3*(2-(n1+2.0*n3)/(n1+n3))*(m3-m)) / xx AS fit FROM lf r JOIN cl USING (repeat, fold)),
    pr AS (SELECT 'PCA-LDA' AS classifier, repeat, fold, order_id, line_no, group_id, y AS y_true, CAST(CASE WHEN d3 > d1 THEN 3 ELSE 1 END AS BIGINT) AS y_pred, 1/(1+exp(d1-d3)) AS score FROM sc
      UNION ALL SELECT 'PLS-DA' AS classifier, repeat, fold, order_id, line_no, group_id, y AS y_true, CAST(CASE WHEN round(fit) >= 2 THEN 3 ELSE 1 END AS BIGINT) AS y_pred,
        exp(-abs(fit-2))/(exp(-abs(fit-1))+exp(-abs(fit-2))) AS score FROM sc)"""


def line_cv(spark, sf, keep=LINE_KEEP):
    return cv.cv_grid(lines(spark, sf), ["10200X"], ["PCA-LDA", "PLS-DA"], "y", V.CLASSES, keep=keep, k=3, repeats=2)


@register("cv_grid_lines", f"WITH {LINE_FOLDS} SELECT classifier, repeat, fold, order_id, line_no, y_true, y_pred, {R('score', 'score')} FROM pr")
def cv_grid_lines(spark, sf):
    return line_cv(spark, sf).select("classifier", "repeat", "fold", "order_id", "line_no", "y_true", "y_pred", r6(F.col("scores")[1]).alias("score"))


LINE_SUMMARY = f"""{LINE_FOLDS}, p2 AS (SELECT '10200X' AS recipe, pr.* FROM pr), {sql_eval('e', 'p2', FOLD_KEYS)},
    {sql_rollup('g', 'p2', ', '.join(FOLD_KEYS) + ', group_id')}, {sql_eval('h', 'g', FOLD_KEYS)},
    pf AS (SELECT 'signal' AS level, * FROM e UNION ALL SELECT 'group' AS level, * FROM h),
    su AS (SELECT level, recipe, classifier, {SUM_COLS} FROM pf GROUP BY level, recipe, classifier)"""


@register("cv_summary_lines", f"WITH {LINE_SUMMARY} SELECT level, recipe, classifier, {', '.join(R(c, c) for c in STAT_NAMES)} FROM su")
def cv_summary_lines(spark, sf):
    """Folds, fits, predictions, roll-up and summary, checked from end to end."""
    return doubles(S.summarize(S.fold_metrics(cut_lineage(line_cv(spark, sf, ["group_id"])), V.CLASSES)))


def embedding_cv(spark, sf, recipes=("10200X", "10210X", "10220X", "11220X"), repeats=2):
    return cv.cv_grid(V.signals(spark, sf), list(recipes), ["PCA-LDA", "PLS-DA"], "y", V.CLASSES, k=5, repeats=repeats)


@register("cv_grid")
def cv_grid(spark, sf):
    return scored(embedding_cv(spark, sf), "recipe", "classifier", "repeat", "fold", *KEEP)


@register("cv_grid_mllib")
def cv_grid_mllib(spark, sf):
    """The kernel and forest half of the grid: 4 recipes x 2 classifiers x 2 repeats x 5 folds."""
    p = cv.cv_grid(V.signals(spark, sf), RECIPES, ["SVM-RBF", "RandomForest"], "y", V.CLASSES, PUBLISHED, k=5, repeats=2)
    return scored(p, "recipe", "classifier", "repeat", "fold", *KEEP)


@register("cv_summary")
def cv_summary(spark, sf):
    """The flagship: folds, fits, predictions, roll-up and summary."""
    return S.summarize(S.fold_metrics(cut_lineage(embedding_cv(spark, sf)), V.CLASSES))


# The recipes, classifiers and settings of the published grid.
RECIPES = ["10200X", "10210X", "10220X", "11220X"]
FOUR = ["PCA-LDA", "PLS-DA", "SVM-RBF", "RandomForest"]
PUBLISHED = {"pca_max_components": 20, "rf_ntrees": 100, "rf_min_leaf_size": 5, "rf_max_depth": 30}


def published_cv(spark, sf):
    """The whole published grid: 4 recipes x 4 classifiers x 10 repeats x 5 folds, 800 fits."""
    return cut_lineage(cv.cv_grid(V.signals(spark, sf), RECIPES, FOUR, "y", V.CLASSES, PUBLISHED, k=5, repeats=10))


@register("cv_flagship")
def cv_flagship(spark, sf):
    """The published grid, summarised per configuration."""
    return S.summarize(S.fold_metrics(published_cv(spark, sf), V.CLASSES))


@register("cv_flagship_coverage", f"""SELECT recipe, classifier, CAST(repeat AS BIGINT) AS repeat, count(*) AS n, count(DISTINCT signal_id) AS n_signals,
    CAST(5 AS BIGINT) AS n_folds, CAST(sum(CASE WHEN y = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive, CAST(0 AS BIGINT) AS n_improper
    FROM (SELECT signal_id, y FROM {{signals}}), (SELECT unnest({RECIPES!r}) AS recipe), (SELECT unnest({FOUR!r}) AS classifier), range(1, 11) t(repeat) GROUP BY ALL""")
def cv_flagship_coverage(spark, sf):
    """Each signal has one prediction per repeat and configuration of the published grid, with scores that sum to 1."""
    total = F.aggregate("scores", F.lit(0.0), lambda a, b: a + b)
    return published_cv(spark, sf).groupBy("recipe", "classifier", "repeat").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("signal_id").alias("n_signals"), F.countDistinct("fold").alias("n_folds"),
        F.sum((F.col("y_true") == 3).cast("long")).alias("n_positive"), F.sum((F.abs(total - 1) > 1e-9).cast("long")).alias("n_improper"))


@register("fold_leaks", """SELECT CAST(1 AS BIGINT) AS repeat, CAST(k AS BIGINT) AS fold, CAST(0 AS BIGINT) AS n_leaked, (SELECT count(*) FROM embeddings) AS n_rows FROM range(1, 6) t(k)""")
def fold_leaks(spark, sf):
    """Groups with predictions from more than one fold of a repeat, per fold; counted on the predictions themselves."""
    preds = embedding_cv(spark, sf, recipes=("10200X",), repeats=1).where(F.col("classifier") == "PCA-LDA")
    rows = cut_lineage(preds.select("repeat", "fold", "group_id"))
    per_group = rows.groupBy("repeat", "group_id").agg(F.countDistinct("fold").alias("n"), F.min("fold").alias("fold"))
    leaked = per_group.groupBy("repeat", "fold").agg(F.sum((F.col("n") > 1).cast("long")).alias("n_leaked"))
    total = rows.groupBy("repeat").agg(F.count(F.lit(1)).alias("n_rows"))
    return leaked.join(total, "repeat").select(*[F.col(c).cast("long") for c in ("repeat", "fold", "n_leaked", "n_rows")])


@register("sample_level_cv")
def sample_level_cv(spark, sf):
    p = cv.sample_level_cv(V.signals(spark, sf), ["10200X"], ["PCA-LDA"], "y", V.CLASSES, k=5)
    return scored(p, "recipe", "classifier", "repeat", "fold", *KEEP)


@register("grid_search")
def grid_search(spark, sf):
    return tuning.grid_search(V.signals(spark, sf), "PLS-DA", "10200X", "y", V.CLASSES)


@register("grid_search_forest")
def grid_search_forest(spark, sf):
    """All 16 points; one forest for each fold holds them."""
    return tuning.grid_search(V.signals(spark, sf), "RandomForest", "10200X", "y", V.CLASSES)


@register("grid_search_svm")
def grid_search_svm(spark, sf):
    """All 81 points; the penalties of a kernel scale share its random features."""
    return tuning.grid_search(V.signals(spark, sf), "SVM-RBF", "10200X", "y", V.CLASSES)


@register("tune_ranges")
def tune_ranges(spark, sf):
    """All four wide grids, each with its best point."""
    parts = [tuning.grid_search(V.signals(spark, sf), c, "10200X", "y", V.CLASSES, grid).withColumn("searched", F.lit(c)) for c, grid in tuning.WIDE_GRIDS.items()]
    return reduce(DataFrame.unionByName, parts)


SPLIT_LINES = f"{LINES}, tr AS (SELECT * FROM l WHERE {TRAIN}), te AS (SELECT * FROM l WHERE NOT ({TRAIN}))"


@register("final_fit_test", f"WITH {SPLIT_LINES}, {sql_lda('tr', 'te')} {LDA_OUT}")
def final_fit_test(spark, sf):
    rows = lines(spark, sf)
    _, preds = evaluate.final_fit_test(rows.where(is_train_line()), rows.where(~is_train_line()), "10200X", "PCA-LDA", "y", V.CLASSES, keep=LINE_KEEP)
    return scored(preds, "order_id", "line_no")


@register("best_then_test")
def best_then_test(spark, sf):
    s = V.signals(spark, sf)
    train, test = s.where(is_train()), s.where(~is_train())
    recipes, names = ["10200X", "10220X"], ["PCA-LDA", "PLS-DA"]
    preds = cut_lineage(cv.cv_grid(train, recipes, names, "y", V.CLASSES, k=3))
    summary = S.summarize(S.fold_metrics(preds, V.CLASSES)).where(F.col("level") == "group")
    _, out = evaluate.best_then_test(summary, "mean_macro_f1", recipes, names, train, test, "y", V.CLASSES)
    return evaluate.test_report(out, [], 3)


# --- outliers ------------------------------------------------------------------------------------


@register("mahalanobis_within")
def mahalanobis_within(spark, sf):
    return O.mahalanobis_within(V.signals(spark, sf), "sample_id", ["sample_id", "signal_id"])


@register("mahalanobis_within_sum", """SELECT sample_id, count(*) AS n, CAST(CASE WHEN count(*) > 2 THEN least(10, count(*)-1) ELSE 0 END AS BIGINT) AS n_components,
    CAST(round(CASE WHEN count(*) > 2 THEN least(10, count(*)-1) * (count(*)-1) ELSE 0 END, 6) AS DOUBLE) + 0.0 AS total FROM {signals} GROUP BY sample_id""")
def mahalanobis_within_sum(spark, sf):
    """Squared distances of a sample add up to components x (n - 1)."""
    d = O.mahalanobis_within(V.signals(spark, sf), "sample_id", ["sample_id", "signal_id"])
    return d.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_components").alias("n_components"), r6(F.sum("d2")).alias("total"))


@register("mahalanobis_within_plane", """WITH m AS (SELECT group_id, count(*) AS n, avg(features[1]) AS ma, avg(features[2]) AS mb, var_samp(features[1]) AS va,
    var_samp(features[2]) AS vb, covar_samp(features[1], features[2]) AS ab FROM {signals} GROUP BY group_id),
    d AS (SELECT group_id, signal_id, n, CASE WHEN n > 2 THEN (vb*(features[1]-ma)^2 - 2*ab*(features[1]-ma)*(features[2]-mb) + va*(features[2]-mb)^2) / (va*vb - ab*ab)
    ELSE 0 END AS d2 FROM {signals} JOIN m USING (group_id))
    SELECT group_id, signal_id, round(d2, 6) + 0.0 AS d2, CAST(CASE WHEN n > 2 THEN 2 ELSE 0 END AS BIGINT) AS n_components, d2 > 9.21034 AS is_outlier FROM d""")
def mahalanobis_within_plane(spark, sf):
    """Distances in the plane of the first two points, where SQL has the inverse."""
    plane = V.signals(spark, sf).withColumn("features", F.slice("features", 1, 2))
    return rounded(O.mahalanobis_within(plane, "group_id", ["group_id", "signal_id"]), "d2")


@register("mahalanobis_by_class")
def mahalanobis_by_class(spark, sf):
    return O.mahalanobis_by_class(V.signals(spark, sf).where(is_train()), "y", ["signal_id"])


@register("mahalanobis_by_class_sum", f"SELECT y, count(*) AS n, CAST(10*(count(*)-1) AS DOUBLE) + 0.0 AS total FROM {{signals}} WHERE {TRAIN} GROUP BY y")
def mahalanobis_by_class_sum(spark, sf):
    d = O.mahalanobis_by_class(V.signals(spark, sf).where(is_train()), "y", ["signal_id"])
    return d.groupBy("y").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("d2")).alias("total"))


@register("mahalanobis_test_info")
def mahalanobis_test_info(spark, sf):
    s = V.signals(spark, sf)
    return O.mahalanobis_test_info(s.where(is_train()), s.where(~is_train()), "y", ["signal_id", "y"])


@register("t2_q_outliers")
def t2_q_outliers(spark, sf):
    return O.t2_q_outliers(V.signals(spark, sf).where(is_train()), ["signal_id"])


@register("t2_q_energy", ENERGY.replace("{expr}", R("sum((value-mu)*(value-mu))", "energy")))
def t2_q_energy(spark, sf):
    """Scores and residual split the squared distance from the mean."""
    s = V.signals(spark, sf)
    fit = O.pca(s, 1.1, 5)
    p = O.project(s, ["signal_id"], fit.mean, fit.coeff, residual=True)
    return p.select("signal_id", r6(energy(F.col("pc")) + F.col("q")).alias("energy"))
