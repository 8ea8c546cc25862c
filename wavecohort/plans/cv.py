"""Cross-validation over a grid of recipes and classifiers.

Linear classifiers: one pass gathers moments per (repeat, fold, class), from
which every recipe and fold is fitted; a second pass scores each signal with the
models that did not see its group.  Kernel machines and forests: one task fits
all recipes of a fold and setting on all of its rows (``blocks``).  Other MLlib classifiers: one
fit per recipe and fold, submitted from a few threads.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.models import linear
from wavecohort.models.classifiers import LINEAR, MLLIB, FittedMllib, check_name, score_rows, settings
from wavecohort.models.linear import LinearModel, Stats
from wavecohort.operators.folds import fold_arrays, leaked_groups, stratified_group_folds
from wavecohort.operators.moments import moments
from wavecohort.operators.sets import join_null_safe
from wavecohort.plans import blocks
from wavecohort.plans.recipes import FittedRecipe, Recipe, signal_width
from wavecohort.session import cut_lineage, scratch_path

_MODEL_SCHEMA = ("repeat int, fold int, recipe string, classifier string, kind string, n_out int, "
                 "weights array<double>, intercept array<double>")


def config_grid(df: DataFrame, recipes: Sequence[str], classifiers: Sequence[str], repeats: int, k: int) -> DataFrame:
    """All (recipe, classifier, repeat, fold) combinations, from literals."""
    arr = lambda vs: F.array(*[F.lit(v) for v in vs])
    grid = df.sparkSession.range(1).select(F.explode(arr(recipes)).alias("recipe"))
    grid = grid.select("recipe", F.explode(arr(classifiers)).alias("classifier"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats)).cast("array<bigint>")).alias("repeat"))
    return grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(k)).cast("array<bigint>")).alias("fold"))


def with_folds(signals: DataFrame, folds: DataFrame, group: str, repeats: int) -> DataFrame:
    """Signals with the fold of their group in every repeat.

    The fold table has one row per group; the planner broadcasts it when small
    and otherwise shuffles, splitting a hot group by adaptive skew joins.
    """
    return join_null_safe(signals, fold_arrays(folds, group, repeats), [group])


@dataclass(frozen=True)
class Variant:
    """A classifier with settings, under the name its predictions carry."""

    name: str
    kind: str
    config: Mapping


def fold_models(table: DataFrame, label: str, recipes: Sequence[str], variants: Sequence[Variant],
                classes: Sequence, scaling: bool = False) -> DataFrame:
    """Fit every recipe and linear variant for every fold from moments, one task per repeat.

    A task gets folds x classes moment rows.  With ``scaling`` the frozen mean
    and deviation of each recipe are listed too, for classifiers fitted elsewhere.
    """
    classes, recipes = list(classes), [Recipe(r) for r in recipes]
    fits = [v for v in variants if v.kind in LINEAR]

    def one_repeat(pdf: pd.DataFrame) -> pd.DataFrame:
        stats = {(r.fold, getattr(r, label)): Stats.of(int(r.n), r.mean, r.scatter) for r in pdf.itertuples()}
        out = []
        for fold in sorted({f for f, _ in stats}):
            parts = {}
            for c in classes:
                seen = [s for (f, y), s in stats.items() if f != fold and y == c]
                if seen:
                    parts[c] = linear.pooled(seen)
            for recipe in recipes:
                for v in fits:
                    m = linear.fit_linear(v.kind, recipe, parts, classes, v.config)
                    out.append((fold, recipe.code, v.name, v.kind, len(m.intercept), m.weights.T.ravel(), m.intercept))
                if scaling:
                    train = linear.pooled(list(parts.values()))
                    mu, sigma = linear.scale_params(linear.before_scale(recipe, len(train.mean)), train)
                    out.append((fold, recipe.code, "scale", "scale", 1, sigma, mu))
        frame = pd.DataFrame(out, columns=["fold", "recipe", "classifier", "kind", "n_out", "weights", "intercept"])
        frame.insert(0, "repeat", int(pdf["repeat"].iloc[0]))
        return frame

    return table.groupBy("repeat").applyInPandas(one_repeat, _MODEL_SCHEMA)


def load_models(models: DataFrame) -> tuple[dict, dict]:
    """({(repeat, fold): [(recipe, classifier, model)]}, {(repeat, fold, recipe): (mu, sigma)}).

    Collects the weights: folds x recipes x classifiers vectors, whatever the number of rows.
    """
    linear_models: dict = {}
    scales: dict = {}
    for r in models.collect():
        if r.kind == "scale":
            scales[(r.repeat, r.fold, r.recipe)] = (tuple(r.intercept), tuple(r.weights))
            continue
        w = np.asarray(r.weights, dtype=float).reshape(r.n_out, -1).T
        model = LinearModel(r.kind, np.ascontiguousarray(w), np.asarray(r.intercept, dtype=float))
        linear_models.setdefault((r.repeat, r.fold), []).append((r.recipe, r.classifier, model))
    return linear_models, scales


def cv_variants(signals: DataFrame, recipes: Sequence[str], variants: Sequence[Variant], label: str, classes: Sequence,
                group: str = "group_id", keep: Sequence[str] = ("signal_id", "sample_id", "group_id"), k: int = 5,
                repeats: int = 1, seed: int = 42, features: str = "features", threads: int = 4,
                folds: DataFrame | None = None) -> DataFrame:
    """Flat predictions (recipe, classifier, repeat, fold, ids, y_true, y_pred, scores).

    Every signal is predicted once per repeat and variant, by a model that saw
    no signal of its group.  Fits run at once, and forests score their folds with
    them; other scoring stays lazy.
    """
    for v in variants:
        check_name(v.kind)
    if folds is None:
        folds = stratified_group_folds(signals, group, label, k, repeats, seed)
    rows = with_folds(signals, folds, group, repeats)
    width = signal_width(signals, features)
    table = moments(rows.where(F.col(label).isin(list(classes))), [label], features, fold_array="folds")
    other = [v for v in variants if v.kind in MLLIB]
    models, scales = load_models(fold_models(table, label, recipes, variants, classes, bool(other)))
    parts = []
    if models:
        parts.append(score_rows(rows, models, keep, label, classes, features, fold_array="folds"))
    if batch := [v for v in other if blocks.taken(v)]:
        parts.append(blocks.fold_predictions(rows, batch, label, classes, keep, features, scales, width))
    if other := [v for v in other if not blocks.taken(v)]:
        parts.append(_mllib_folds(rows, other, label, classes, keep, features, scales, width, threads))
    return reduce(DataFrame.unionByName, parts)


def cv_grid(signals: DataFrame, recipes: Sequence[str], classifiers: Sequence[str], label: str, classes: Sequence,
            config: Mapping | None = None, **options) -> DataFrame:
    """:func:`cv_variants` for recipes x classifiers under one set of settings."""
    for c in classifiers:
        check_name(c)
    conf = settings(config, classes)
    return cv_variants(signals, recipes, [Variant(c, c, conf) for c in classifiers], label, classes, **options)


def _mllib_folds(rows, variants, label, classes, keep, features, scales, width, threads):
    """One fit and one scoring job per (repeat, fold, recipe, variant).

    Signals are stored once with their folds, so that no fit repeats the join,
    and every fit writes its predictions, so that the plan stays small and a
    finished fold is never computed again.
    """
    rows = cut_lineage(rows.select(*dict.fromkeys([*keep, label, "folds"]), F.col(features).alias("features")), "cv-rows")
    path = scratch_path(rows.sparkSession, "cv-predictions")

    def one(task):
        number, ((repeat, fold, code), v) = task
        mu, sigma = scales[(repeat, fold, code)]
        recipe = Recipe(code)
        fitted = FittedRecipe(recipe, width, mu if recipe.scale else (), sigma if recipe.scale else ())
        test_fold = F.col("folds")[repeat - 1] == fold
        train = fitted.transform(rows.where(~test_fold).select(label, "features"))
        model = FittedMllib(v.name, fitted, MLLIB[v.kind](train, label, classes, v.config))
        out = model.predict(rows.where(test_fold), keep, label)
        out.withColumns({"repeat": F.lit(repeat).cast("long"), "fold": F.lit(fold).cast("long")}).write.parquet(
            f"{path}/fit={number}")
        return out.schema

    # each task only submits Spark jobs; the fits themselves are distributed
    tasks = list(enumerate((key, v) for key in sorted(scales) for v in variants))
    with ThreadPoolExecutor(max_workers=threads) as pool:
        schema = list(pool.map(one, tasks))[0]
    return rows.sparkSession.read.schema(schema).parquet(*[f"{path}/fit={n}" for n, _ in tasks])


def sample_level_cv(signals: DataFrame, recipes: Sequence[str], classifiers: Sequence[str], label: str,
                    classes: Sequence, sample: str = "sample_id", **kw) -> DataFrame:
    """The same with samples, not groups, kept whole."""
    return cv_grid(signals, recipes, classifiers, label, classes, group=sample, **kw)


def fold_leaks(rows: DataFrame, group: str, repeat: int, fold: int) -> DataFrame:
    """Groups on both sides of a fold; empty by construction."""
    inside = F.col("folds")[repeat - 1] == fold
    return leaked_groups(rows.where(~inside), rows.where(inside), group)
