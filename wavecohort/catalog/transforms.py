"""Queries on signal transforms, recipes and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavecohort.catalog import views as V
from wavecohort.catalog.tables import holed, long_of
from wavecohort.catalog.views import r6, register, rounded
from wavecohort.functions import arrays as A
from wavecohort.operators import aggregates as G
from wavecohort.operators import quality as Q
from wavecohort.plans import recipes as R

TRAIN = "substr(md5('split:'||group_id),1,1) < 'b'"


def is_train():
    return F.substring(F.md5(F.concat(F.lit("split:"), F.col("group_id").cast("string"))), 1, 1) < "b"


def applied(spark, sf, fn, source=V.signals):
    return long_of(source(spark, sf).select("signal_id", fn(F.col("features")).alias("features")), ["signal_id"])


# --- the same filters as SQL over (signal_id, pos, value) tables -------------------------


def sql_bin(src: str, width: int) -> str:
    return (f"SELECT signal_id, CAST(pos//{width} AS BIGINT) AS pos, avg(value) AS value FROM {src} "
            f"WHERE pos//{width} < {64 // width} GROUP BY ALL")


def sql_smooth(src: str, h: int, poly: int, d: int) -> str:
    """Least-squares smoothing written with orthogonal polynomials over -h..h."""
    m = 2 * h + 1
    s2 = h * (h + 1) * m / 3
    hat = f"1.0/{m} + (w.i*w.j)/{s2!r}"
    if poly == 2:
        c = h * (h + 1) / 3
        s4 = sum((i * i - c) ** 2 for i in range(-h, h + 1))
        hat += f" + ((w.i*w.i-{c!r})*(w.j*w.j-{c!r}))/{s4!r}"
    start = f"least(greatest(p.pos-{h}, 0), {d - m})"
    return f"""SELECT p.signal_id, p.pos, sum(q.value * ({hat})) AS value FROM {src} p
        JOIN (SELECT CAST(a AS DOUBLE) AS i, CAST(b AS DOUBLE) AS j, a AS ai, b AS bj FROM range({-h}, {h + 1}) x(a), range({-h}, {h + 1}) y(b)) w
          ON w.ai = p.pos - {start} - {h}
        JOIN {src} q ON q.signal_id = p.signal_id AND q.pos = {start} + {h} + w.bj GROUP BY p.signal_id, p.pos"""


def sql_second_derivative(src: str) -> str:
    """Window 5, order 2: weights 2 -1 -2 -1 2 over 7, zeros outside."""
    lag = lambda k, f: f"coalesce({f}(value, {k}) OVER (PARTITION BY signal_id ORDER BY pos), 0)"
    return (f"SELECT signal_id, pos, (2*{lag(2, 'lag')} - {lag(1, 'lag')} - 2*value - {lag(1, 'lead')} + 2*{lag(2, 'lead')})/7 AS value FROM {src}")


def sql_unit(src: str) -> str:
    return (f"SELECT signal_id, pos, value / sqrt(sum(value*value) OVER (PARTITION BY signal_id)) AS value FROM {src}")


def sql_diff(src: str) -> str:
    return (f"SELECT signal_id, pos - 1 AS pos, value - lag(value) OVER (PARTITION BY signal_id ORDER BY pos) AS value FROM {src} "
            "QUALIFY lag(value) OVER (PARTITION BY signal_id ORDER BY pos) IS NOT NULL")


def sql_scale(src: str) -> str:
    return f"""SELECT s.signal_id, s.pos, (s.value - m.mu)/m.sd AS value FROM {src} s JOIN (
        SELECT pos, avg(value) AS mu, coalesce(nullif(stddev_samp(value), 0), 1) AS sd FROM {src}
        JOIN (SELECT signal_id FROM {{signals}} WHERE {TRAIN}) g USING (signal_id) GROUP BY pos) m ON s.pos = m.pos"""


def final(src: str) -> str:
    return f"SELECT signal_id, pos, round(value, 6) + 0.0 AS value FROM {src}"


def chain(*steps: str) -> str:
    """Number the steps t1, t2, ...; each may use the one before as ``PREV``."""
    parts, prev = ["t0 AS (SELECT signal_id, pos, value FROM {traces})"], "t0"
    for i, step in enumerate(steps, 1):
        parts.append(f"t{i} AS ({step.replace('PREV', prev)})")
        prev = f"t{i}"
    return f"WITH {', '.join(parts)} {final(prev)}"


# --- C ------------------------------------------------------------------------------------


@register("bin_signal", chain(sql_bin("PREV", 5)))
def bin_signal(spark, sf):
    return applied(spark, sf, lambda x: A.bin_signal(x, 5))


@register("bin_signal_omit_nan", """SELECT signal_id, CAST(pos//4 AS BIGINT) AS pos,
    round(coalesce(avg(CASE WHEN value <= 0.25 THEN value END), CAST('NaN' AS DOUBLE)), 6) + 0.0 AS value FROM {traces} GROUP BY ALL""")
def bin_signal_omit_nan(spark, sf):
    return applied(spark, sf, lambda x: A.bin_signal(x, 4, omit_nan=True), holed)


@register("bin_axis", """SELECT CAST(a.pos//5 AS BIGINT) AS pos, round(avg(axis), 6) + 0.0 AS axis, round(avg(t.value), 6) + 0.0 AS mean_value
    FROM {axis} a JOIN {traces} t ON t.pos = a.pos WHERE a.pos//5 < 12 GROUP BY ALL""")
def bin_axis(spark, sf):
    """Axis and mean signal, binned alike."""
    binned = V.signals(spark, sf).select(F.posexplode(A.bin_signal(F.col("features"), 5)).alias("pos", "value"))
    axis = A.bin_signal(F.array(*[F.lit(a) for a in V.AXIS]), 5)
    return binned.groupBy("pos").agg(F.avg("value").alias("m")).select(
        F.col("pos").cast("long").alias("pos"), r6(F.get(axis, F.col("pos"))).alias("axis"), r6("m").alias("mean_value"))


@register("sg_smooth", chain(sql_smooth("PREV", 5, 2, 64)))
def sg_smooth(spark, sf):
    return applied(spark, sf, lambda x: A.sg_smooth(x, 11, 2))


@register("recipe_smooth", chain(sql_smooth("PREV", 2, 1, 64)))
def recipe_smooth(spark, sf):
    return applied(spark, sf, lambda x: A.sg_smooth(x, *R.Recipe("01000X").smooth_window()))


@register("sg_derivative", chain(sql_second_derivative("PREV")))
def sg_derivative(spark, sf):
    return applied(spark, sf, A.sg_derivative)


@register("diff_signal", chain(sql_diff("PREV")))
def diff_signal(spark, sf):
    return applied(spark, sf, lambda x: A.diff_signal(x, 1))


@register("diff_signal_second", chain(sql_diff("PREV"), sql_diff("PREV")))
def diff_signal_second(spark, sf):
    return applied(spark, sf, lambda x: A.diff_signal(x, 2))


@register("l2_normalize", chain(sql_unit("PREV")))
def l2_normalize(spark, sf):
    return applied(spark, sf, A.l2_normalize)


@register("zscore_fit", f"""SELECT pos, round(avg(value), 6) + 0.0 AS mu, round(stddev_samp(value), 6) + 0.0 AS sigma
    FROM {{traces}} WHERE {TRAIN} GROUP BY pos""")
def zscore_fit(spark, sf):
    p = R.zscore_fit(V.signals(spark, sf).where(is_train()))
    return p.select(F.posexplode(F.arrays_zip("mu", "sigma")).alias("pos", "p")).select(
        F.col("pos").cast("long").alias("pos"), r6(F.col("p.mu")).alias("mu"), r6(F.col("p.sigma")).alias("sigma"))


@register("zscore_apply", chain(sql_scale("PREV")))
def zscore_apply(spark, sf):
    s = V.signals(spark, sf)
    return long_of(R.zscore_apply(s, R.zscore_fit(s.where(is_train())), []), ["signal_id"])


@register("zscore_by_fold", """WITH f AS (SELECT CAST(k AS BIGINT) AS fold, signal_id, group_id, pos, value FROM {traces}, range(0, 3) t(k)),
    m AS (SELECT fold, pos, avg(value) AS mu, stddev_samp(value) AS sd FROM f WHERE group_id % 3 <> fold GROUP BY ALL)
    SELECT f.fold, signal_id, f.pos, round((value - mu)/sd, 6) + 0.0 AS value FROM f JOIN m ON f.fold = m.fold AND f.pos = m.pos WHERE group_id % 3 = f.fold""")
def zscore_by_fold(spark, sf):
    s = V.signals(spark, sf)
    folds = F.filter(F.array(*[F.lit(i).cast("long") for i in range(3)]), lambda k: k != F.col("group_id") % 3)
    params = R.zscore_fit(s.select(F.explode(folds).alias("fold"), "features"), ["fold"])
    return long_of(R.zscore_apply(s.withColumn("fold", F.col("group_id") % 3), params, ["fold"]), ["fold", "signal_id"])


@register("recipe_fit_transform", chain(sql_bin("PREV", 2), sql_smooth("PREV", 2, 1, 32), sql_scale("PREV"), sql_diff("PREV"), sql_diff("PREV")))
def recipe_fit_transform(spark, sf):
    s = V.signals(spark, sf)
    train, fitted = R.recipe_fit_transform(s.where(is_train()), "21220X")
    return long_of(train.unionByName(fitted.transform(s.where(~is_train()), recipe="21220X")), ["signal_id"])


@register("recipe_transform", chain(sql_scale("PREV"), sql_diff("PREV")))
def recipe_transform(spark, sf):
    """Parameters stored as a table and read back before use."""
    s = V.signals(spark, sf)
    stored = R.recipe_fit(s.where(is_train()), "10210X").to_row(spark)
    return long_of(R.FittedRecipe.from_row(stored).transform(s), ["signal_id"])


@register("recipe_dims", """WITH c AS (SELECT * FROM (VALUES ('20000X', 2, 0), ('10220X', 1, 2), ('31110X', 3, 1)) v(recipe, b, c))
    SELECT signal_id, recipe, CAST(k AS BIGINT) AS step_no, ['bin', 'smooth', 'scale', 'difference'][k] AS step,
    CAST(CASE WHEN k = 1 THEN len(features) ELSE len(features)//b END AS BIGINT) AS width_before,
    CAST(CASE WHEN k = 4 THEN len(features)//b - c ELSE len(features)//b END AS BIGINT) AS width_after FROM {signals}, c, range(1, 5) t(k)""")
def recipe_dims(spark, sf):
    return R.recipe_dims(V.signals(spark, sf), ["20000X", "10220X", "31110X"], ["signal_id"])


@register("preset_pp1", chain(sql_unit("PREV"), sql_second_derivative("PREV")))
def preset_pp1(spark, sf):
    return applied(spark, sf, R.PP1.apply)


@register("preset_pp2", chain(sql_bin("PREV", 4), sql_smooth("PREV", 5, 2, 16), sql_unit("PREV"), sql_second_derivative("PREV")))
def preset_pp2(spark, sf):
    return applied(spark, sf, R.PP2.apply)


@register("norm_type", chain(sql_unit("PREV")))
def norm_type(spark, sf):
    return applied(spark, sf, lambda x: R.norm_type(x, "SNV"))


@register("l2_then_zscore", chain(sql_unit("PREV"), sql_scale("PREV")))
def l2_then_zscore(spark, sf):
    s = V.signals(spark, sf)
    return long_of(R.l2_then_zscore(s.where(is_train()), s), ["signal_id"])


@register("nonfinite_report", """SELECT group_id, count(*) FILTER (value > 0.25) AS n_nonfinite, count(*) AS n_values,
    round(100.0 * count(*) FILTER (value <= 0.25) / count(*), 6) + 0.0 AS percent_finite FROM {traces} GROUP BY group_id""")
def nonfinite_report(spark, sf):
    n, bad = F.sum(F.size("features").cast("long")), F.sum(A.nonfinite_count(F.col("features")))
    return holed(spark, sf).groupBy("group_id").agg(
        bad.alias("n_nonfinite"), n.alias("n_values"), r6(F.lit(100.0) * (n - bad) / n).alias("percent_finite"))


# --- I ------------------------------------------------------------------------------------

BANDS = """q AS (SELECT signal_id, sample_id, group_id, y, try_divide_(max(value) FILTER (axis BETWEEN 1000 AND 1700) - min(value) FILTER (axis BETWEEN 1000 AND 1700),
      stddev_samp(value) FILTER (axis BETWEEN 1750 AND 1800)) AS snr, max(value) AS max_value, min(value) AS min_value,
    stddev_samp(value) FILTER (axis BETWEEN 1750 AND 1800 OR axis BETWEEN 950 AND 1000) AS baseline_std,
    count(*) FILTER (value < -0.1) / CAST(count(*) AS DOUBLE) AS negative_share,
    try_divide_(max(value) FILTER (axis BETWEEN 1630 AND 1670), max(value) FILTER (axis BETWEEN 1530 AND 1570)) AS amide_ratio
    FROM {slong} GROUP BY signal_id, sample_id, group_id, y)"""
# Limits suited to the given tables, the rules unchanged.
LIMITS = {"min_snr": 4.0, "max_absorbance": 1.25, "max_baseline": 0.32, "min_value": 0.0, "ratio": (0.5, 2.0)}
CHECKED = BANDS + """, c AS (SELECT *, coalesce(snr >= 4.0, false) AS ok_snr, coalesce(max_value <= 1.25, false) AS ok_saturation,
    coalesce(baseline_std <= 0.32, false) AS ok_baseline, coalesce(min_value >= 0.0, false) AS ok_negative,
    coalesce(amide_ratio BETWEEN 0.5 AND 2.0, false) AS ok_amide FROM q)"""


def bands(sql: str) -> str:
    """Write out the safe division used in the band queries."""
    out, mark = sql, "try_divide_("
    while mark in out:
        start = out.index(mark)
        depth, i, cut = 1, start + len(mark), None
        while depth:
            depth += {"(": 1, ")": -1}.get(out[i], 0)
            if out[i] == "," and depth == 1:
                cut = i
            i += 1
        a, b = out[start + len(mark):cut], out[cut + 1:i - 1]
        out = f"{out[:start]}(({a}) / nullif({b}, 0)){out[i:]}"
    return out


def quality(spark, sf):
    return Q.signal_quality(V.spectra(spark, sf), V.AXIS, **LIMITS)


def value_query(name: str, col: str, ok: str, sql_ok: str):
    sql = bands(f"WITH {CHECKED} SELECT signal_id, round({col}, 6) + 0.0 AS {col}, {sql_ok} AS {ok} FROM c")

    @register(name, sql)
    def run(spark, sf):
        return quality(spark, sf).select("signal_id", r6(col).alias(col), ok)


value_query("qc_snr", "snr", "ok_snr", "ok_snr")
value_query("qc_saturation", "max_value", "ok_saturation", "ok_saturation")
value_query("qc_baseline", "baseline_std", "ok_baseline", "ok_baseline")
value_query("qc_amide_ratio", "amide_ratio", "ok_amide", "ok_amide")


@register("qc_negative", bands(f"WITH {CHECKED} SELECT signal_id, round(min_value, 6) + 0.0 AS min_value, round(negative_share, 6) + 0.0 AS negative_share, ok_negative FROM c"))
def qc_negative(spark, sf):
    return rounded(quality(spark, sf).select("signal_id", "min_value", "negative_share", "ok_negative"), "min_value", "negative_share")


PAIRS = """z AS (SELECT signal_id, sample_id, pos, value - avg(value) OVER (PARTITION BY signal_id) AS v FROM {traces}),
    u AS (SELECT signal_id, sample_id, pos, v / sqrt(sum(v*v) OVER (PARTITION BY signal_id)) AS v FROM z),
    p AS (SELECT a.sample_id, a.signal_id AS i, b.signal_id AS j, sum(a.v*b.v) AS r FROM u a JOIN u b
          ON a.sample_id = b.sample_id AND a.pos = b.pos AND a.signal_id < b.signal_id GROUP BY ALL)"""


@register("qc_within_corr", f"""WITH {PAIRS}, m AS (SELECT sample_id, avg(r) AS r FROM p GROUP BY sample_id),
    n AS (SELECT sample_id, count(*) AS n FROM {{signals}} GROUP BY sample_id)
    SELECT n.sample_id, n.n, round(r, 6) + 0.0 AS within_corr, coalesce(r < 0.85, false) AS low_corr FROM n LEFT JOIN m ON n.sample_id = m.sample_id""")
def qc_within_corr(spark, sf):
    return rounded(Q.flag_low_correlation(Q.within_correlation(V.signals(spark, sf), "sample_id")), "within_corr")


@register("pairwise_within", f"""WITH {PAIRS} SELECT sample_id, count(*) AS n_pairs, round(avg(r), 6) + 0.0 AS within_corr, round(sum(r), 6) + 0.0 AS sum_corr
    FROM p GROUP BY sample_id""")
def pairwise_within(spark, sf):
    return rounded(Q.pairwise_within(V.signals(spark, sf), "sample_id"), "within_corr", "sum_corr")


VALID = "ok_snr AND ok_saturation AND ok_baseline AND ok_negative AND ok_amide"


@register("qc_min_valid", bands(f"WITH {CHECKED} SELECT sample_id, count(*) FILTER ({VALID}) AS n_valid, count(*) FILTER ({VALID}) < 3 AS too_few FROM c GROUP BY sample_id"))
def qc_min_valid(spark, sf):
    return Q.qc_min_valid(quality(spark, sf), ["sample_id"], 3)


FUNNEL = f"""WITH {CHECKED} SELECT sample_id, y, count(*) AS n_original, count(*) FILTER (ok_snr) AS n_after_snr,
    count(*) FILTER (ok_snr AND ok_saturation) AS n_after_saturation, count(*) FILTER (ok_snr AND ok_saturation AND ok_baseline) AS n_after_baseline,
    count(*) FILTER (ok_snr AND ok_saturation AND ok_baseline AND ok_amide) AS n_after_amide,
    count(*) FILTER ({VALID}) AS n_final FROM c GROUP BY sample_id, y"""


@register("qc_funnel", bands(FUNNEL))
def qc_funnel(spark, sf):
    return Q.qc_funnel(quality(spark, sf), ["sample_id", "y"], F.col("ok_negative"))


@register("qc_rejection_log", bands(f"""WITH {CHECKED} SELECT sample_id, group_id, signal_id, y, CASE WHEN NOT ok_snr THEN 'SNR' WHEN NOT ok_saturation THEN 'Saturation'
    WHEN NOT ok_baseline THEN 'Baseline' WHEN NOT ok_amide THEN 'AmideRatio' ELSE 'Negative' END AS reason, round(CASE WHEN NOT ok_snr THEN snr WHEN NOT ok_saturation THEN max_value
    WHEN NOT ok_baseline THEN baseline_std WHEN NOT ok_amide THEN amide_ratio ELSE min_value END, 6) + 0.0 AS qc_value FROM c WHERE NOT ({VALID})"""))
def qc_rejection_log(spark, sf):
    return rounded(Q.qc_rejection_log(quality(spark, sf), ["sample_id", "group_id", "signal_id", "y"]), "qc_value")


@register("qc_filtered_mean", bands(f"""WITH {CHECKED} SELECT l.group_id, l.pos, round(avg(l.value), 6) + 0.0 AS value FROM {{slong}} l
    JOIN c ON c.signal_id = l.signal_id WHERE {VALID} GROUP BY ALL"""))
def qc_filtered_mean(spark, sf):
    q = quality(spark, sf)
    return long_of(Q.qc_filtered_mean(q, "group_id", Q.valid_mask(q)), ["group_id"], "mean_signal")


@register("qc_filtered_median", bands(f"""WITH {CHECKED} SELECT l.group_id, l.pos, round(median(l.value), 6) + 0.0 AS value FROM {{slong}} l
    JOIN c ON c.signal_id = l.signal_id WHERE {VALID} GROUP BY ALL"""))
def qc_filtered_median(spark, sf):
    q = quality(spark, sf)
    return Q.qc_filtered_median(q, "group_id", Q.valid_mask(q)).select("group_id", "pos", r6("median").alias("value"))


@register("qc_retention", bands(FUNNEL).replace("SELECT sample_id, y, count(*) AS n_original", "SELECT sample_id, count(*) AS n_original, round(count(*) FILTER (" + VALID + ") / CAST(count(*) AS DOUBLE), 6) + 0.0 AS retention", 1).replace("GROUP BY sample_id, y", "GROUP BY sample_id"))
def qc_retention(spark, sf):
    return rounded(Q.qc_retention(Q.qc_funnel(quality(spark, sf), ["sample_id"], F.col("ok_negative"))), "retention")


@register("snr_histogram", bands(f"""WITH {CHECKED} SELECT CAST(CASE WHEN snr < 0 THEN 0 WHEN snr >= 20 THEN 11 ELSE floor(snr/2) + 1 END AS BIGINT) AS bin, count(*) AS n FROM c GROUP BY ALL"""))
def snr_histogram(spark, sf):
    return Q.snr_histogram(quality(spark, sf), 0.0, 20.0, 10)


@register("outlier_removal_summary", bands(f"""WITH {CHECKED} SELECT count(*) AS n_total, count(*) FILTER (NOT ok_saturation) AS n_removed, count(*) FILTER (ok_saturation) AS n_kept,
    round(100.0 * count(*) FILTER (NOT ok_saturation) / count(*), 6) + 0.0 AS percent_removed FROM c"""))
def outlier_removal_summary(spark, sf):
    flags = quality(spark, sf).withColumn("bad", ~F.col("ok_saturation"))
    return rounded(Q.outlier_removal_summary(flags, "bad"), "percent_removed")


# The same rules at their published limits, which few of the given rows pass.
PUBLISHED = BANDS + """, c AS (SELECT *, coalesce(snr >= 10.0, false) AS ok_snr, coalesce(max_value <= 1.8, false) AS ok_saturation,
    coalesce(baseline_std <= 0.02, false) AS ok_baseline, coalesce(min_value >= -0.1, false) AS ok_negative,
    coalesce(amide_ratio BETWEEN 1.2 AND 3.5, false) AS ok_amide FROM q)"""


@register("qc_published_limits", bands(f"WITH {PUBLISHED} SELECT signal_id, ok_snr, ok_saturation, ok_baseline, ok_negative, ok_amide, ({VALID}) AS valid FROM c"))
def qc_published_limits(spark, sf):
    q = Q.signal_quality(V.spectra(spark, sf), V.AXIS)
    return q.select("signal_id", "ok_snr", "ok_saturation", "ok_baseline", "ok_negative", "ok_amide", Q.valid_mask(q).alias("valid"))


@register("qc_min_valid_published", bands(f"WITH {PUBLISHED} SELECT group_id, count(*) FILTER ({VALID}) AS n_valid, count(*) FILTER ({VALID}) < 100 AS too_few FROM c GROUP BY group_id"))
def qc_min_valid_published(spark, sf):
    return Q.qc_min_valid(Q.signal_quality(V.spectra(spark, sf), V.AXIS), ["group_id"])


# Distances of the valid signals of a group in the plane of their first two points; 9.21034 is the limit for two components.
CHAIN = CHECKED + f""", v AS (SELECT c.signal_id, c.group_id, s.features[1] AS a, s.features[2] AS b FROM c JOIN {{spectra}} s ON s.signal_id = c.signal_id WHERE {VALID}),
    m AS (SELECT group_id, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS ab FROM v GROUP BY group_id),
    d AS (SELECT signal_id, (vb*(a-ma)*(a-ma) - 2*ab*(a-ma)*(b-mb) + va*(b-mb)*(b-mb)) / (va*vb - ab*ab) AS distance FROM v JOIN m USING (group_id) WHERE n > 2),
    x AS (SELECT c.*, d.distance, coalesce(d.distance <= 9.21034, true) AS ok_distance FROM c LEFT JOIN d USING (signal_id))"""


def chain(spark, sf):
    q = quality(spark, sf).withColumn("plane", F.slice("features", 1, 2))
    return Q.qc_chain(q, "group_id", "plane")


@register("qc_chain_funnel", bands(f"""WITH {CHAIN} SELECT group_id, count(*) AS n_original, count(*) FILTER (ok_snr) AS n_after_snr,
    count(*) FILTER (ok_snr AND ok_saturation) AS n_after_saturation, count(*) FILTER (ok_snr AND ok_saturation AND ok_baseline) AS n_after_baseline,
    count(*) FILTER (ok_snr AND ok_saturation AND ok_baseline AND ok_amide) AS n_after_amide,
    count(*) FILTER ({VALID} AND ok_distance) AS n_final FROM x GROUP BY group_id"""))
def qc_chain_funnel(spark, sf):
    return Q.qc_funnel(chain(spark, sf), ["group_id"], F.col("ok_negative") & F.col("ok_distance"))


@register("qc_chain_log", bands(f"""WITH {CHAIN} SELECT group_id, signal_id, CASE WHEN NOT ok_snr THEN 'SNR' WHEN NOT ok_saturation THEN 'Saturation'
    WHEN NOT ok_baseline THEN 'Baseline' WHEN NOT ok_amide THEN 'AmideRatio' WHEN NOT ok_negative THEN 'Negative' ELSE 'Mahalanobis' END AS reason,
    round(CASE WHEN NOT ok_snr THEN snr WHEN NOT ok_saturation THEN max_value WHEN NOT ok_baseline THEN baseline_std WHEN NOT ok_amide THEN amide_ratio
    WHEN NOT ok_negative THEN min_value ELSE distance END, 6) + 0.0 AS qc_value FROM x WHERE NOT ({VALID} AND ok_distance)"""))
def qc_chain_log(spark, sf):
    return rounded(Q.qc_rejection_log(chain(spark, sf), ["group_id", "signal_id"]), "qc_value")


@register("qc_chain_mean", bands(f"""WITH {CHAIN} SELECT l.group_id, l.pos, round(avg(l.value), 6) + 0.0 AS value FROM {{slong}} l
    JOIN x ON x.signal_id = l.signal_id WHERE {VALID} AND ok_distance GROUP BY ALL"""))
def qc_chain_mean(spark, sf):
    c = chain(spark, sf)
    return long_of(Q.qc_filtered_mean(c, "group_id", Q.chain_mask(c)), ["group_id"], "mean_signal")


@register("session_agreement", """WITH m AS (SELECT group_id, signal_id % 2 AS session, pos, avg(value) AS m FROM {traces} GROUP BY ALL),
    r AS (SELECT pos, avg(value) AS ref FROM {traces} GROUP BY pos)
    SELECT group_id, session, round(corr(m, ref), 6) + 0.0 AS r FROM m JOIN r ON m.pos = r.pos GROUP BY ALL""")
def session_agreement(spark, sf):
    p = G.points(V.signals(spark, sf).withColumn("session", F.col("signal_id") % 2), ["group_id", "session"])
    ref = p.groupBy("pos").agg(F.avg("value").alias("ref"))
    return rounded(Q.session_agreement(p, "group_id", "session", ref), "r")
