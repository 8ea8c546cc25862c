"""Kernel and forest fits of all folds: one task fits a setting on all labelled rows of a (repeat, fold), for all recipes.

A kernel machine has a few thousand numbers: machines go back to the rows in
broadcast blocks of at most ``BLOCK_BYTES``.  A forest grows with its rows: its
task also gets the rows of the fold itself and scores them while the trees grow,
so that no forest is stored, moved or held whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecohort.functions.batch import features_matrix, list_array, plain
from wavecohort.models.shared import MAPPED, Forest, KernelMachine, mean_shares
from wavecohort.plans.recipes import FittedRecipe, Recipe
from wavecohort.session import cut_lineage

KINDS = ("SVM-RBF", "RandomForest")
BLOCK_BYTES = 64 << 20


def taken(variant) -> bool:
    """Whether a variant is fitted here; posteriors of kernel machines are not."""
    return variant.kind in KINDS and not variant.config.get("svm_platt")


def _plan(variants: Sequence) -> list[tuple[tuple, list]]:
    """(key, variants) by what variants share: a kernel scale, or the trees' leaf size."""
    shared: dict[tuple, list] = {}
    for v in variants:
        c = v.config
        own = (c["svm_kernel_scale"], c["svm_features"]) if v.kind == "SVM-RBF" else (c["rf_min_leaf_size"],)
        shared.setdefault((*own, c.get("cost_penalty"), c["positive"], c["seed"]), []).append(v)
    return list(shared.items())


def _class_weight(key: tuple, classes: Sequence) -> np.ndarray:
    cost, positive = key[-3], key[-2]
    return np.array([cost if cost and c == positive else 1.0 for c in classes])


def _machine(key: tuple, variants: Sequence, x: np.ndarray, y: np.ndarray, classes: Sequence) -> KernelMachine:
    return KernelMachine(x, np.where(y == 1, 1.0, -1.0), _class_weight(key, classes)[y], key[0], [v.config["svm_C"] for v in variants], key[1], key[-1])


def _machine_scores(model: KernelMachine, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(class number, scores) of every penalty."""
    f = model.decision(x)
    p = 1.0 / (1.0 + np.exp(np.clip(2.0 * f, -700, 700)))
    return [((f[:, i] >= 0).astype(int), np.column_stack([p[:, i], 1.0 - p[:, i]])) for i in range(f.shape[1])]


def _forest_scores(key: tuple, variants: Sequence, recipe: FittedRecipe, x: np.ndarray, y: np.ndarray, test: np.ndarray,
                   classes: Sequence) -> list[tuple[np.ndarray, np.ndarray]]:
    """(class number, scores) of the test rows by every variant."""
    points = [(v.config["rf_ntrees"], v.config["rf_max_depth"]) for v in variants]
    parts = Forest.parts(_applied(recipe, x), y, len(classes), _class_weight(key, classes), max(t for t, _ in points), max(d for _, d in points),
                         key[0], key[-1])
    return [(s.argmax(1), s) for s in mean_shares(parts, _applied(recipe, test), points)]


def _applied(recipe: FittedRecipe, x: np.ndarray) -> np.ndarray:
    """The recipe on all rows, some at a time."""
    out = np.empty((len(x), recipe.recipe.width(recipe.width_in)))
    for i in range(0, len(x), MAPPED):
        out[i:i + MAPPED] = recipe.kernel(x[i:i + MAPPED])
    return out


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row numbers in an order of the values, for the same fit in whatever order the rows come."""
    return np.lexsort((*x.T[:4], y))


def fold_predictions(rows: DataFrame, variants: Sequence, label: str, classes: Sequence, keep: Sequence[str], features: str,
                     scales: Mapping, width: int, max_train: int | None = None) -> DataFrame:
    """Predictions of kernel and forest variants, one for each row, repeat, recipe and variant.

    ``rows`` carry their folds as an array; ``scales`` has the training mean and
    deviation of every (repeat, fold, recipe).  Fits take all labelled rows; a
    caller's ``max_train`` takes about so many of them, by a hash of their ids.
    """
    machines, forests = [_plan([v for v in variants if v.kind == kind]) for kind in KINDS]
    if machines and len(classes) != 2:
        raise ValueError("the support vector machine takes two classes")
    classes = list(classes)
    rows = cut_lineage(rows.select(*dict.fromkeys([*keep, label, "folds"]), F.col(features).cast("array<double>").alias("_x")), "cv-rows")
    recipes: dict[tuple, list] = {}
    for repeat, fold, code in sorted(scales):
        recipes.setdefault((repeat, fold), []).append(code)

    def fitted(repeat: int, fold: int, code: str) -> FittedRecipe:
        recipe = Recipe(code)
        mu, sigma = scales[(repeat, fold, code)] if recipe.scale else ((), ())
        return FittedRecipe(recipe, width, mu, sigma)

    known = F.col(label).isin(classes)
    if max_train is not None:
        share = max_train / max(1, rows.where(known).count())
        known = known & (F.xxhash64(*keep) / 2.0**64 + 0.5 < share)  # a row is in or out wherever it is read

    def copies(n_parts: int, *columns) -> DataFrame:
        """A copy of every row for each fit: (repeat, fold, part), whether the fold holds it, its class number if it trains, signal, columns."""
        fits = F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), F.lit(f).alias("fold"), F.lit(p).alias("part")) for r, f in recipes for p in range(n_parts)]))
        number = F.when(known, F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1)
        every = rows.select(fits.alias("_k"), number.alias("_y"), "folds", "_x", *columns)
        test = F.get("folds", F.col("_k.repeat") - 1).eqNullSafe(F.col("_k.fold"))
        return every.select("_k.*", test.alias("_test"), "_y", "_x", *[c for c in every.columns[4:]])

    def grouped(copied: DataFrame, n_parts: int):
        # A number of its own, so that small tables are not put back into one task.
        return copied.repartition(2 * len(recipes) * n_parts, "repeat", "fold", "part").groupBy("repeat", "fold", "part")

    kind = rows.schema[label].dataType
    schema = T.StructType([
        T.StructField("recipe", T.StringType()), T.StructField("classifier", T.StringType()), T.StructField("repeat", T.LongType()),
        T.StructField("fold", T.LongType()), *[rows.schema[c] for c in keep], T.StructField("y_true", kind), T.StructField("y_pred", kind),
        T.StructField("scores", T.ArrayType(T.DoubleType()))])
    names, n_keep = [f.name for f in schema.fields], len(keep)

    def predicted(code: str, variant, repeat: int, fold: int, ids: Sequence, true, best: np.ndarray, prob: np.ndarray) -> pa.RecordBatch:
        m, lookup = len(best), pa.array(classes, type=true.type)
        return pa.RecordBatch.from_arrays(
            [pa.repeat(code, m), pa.repeat(variant.name, m), pa.array(np.full(m, repeat)), pa.array(np.full(m, fold)), *ids, true,
             lookup.take(pa.array(best)), list_array(prob)], names=names)

    def fit_machine(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeat, fold, part = (k.as_py() for k in key)
        table = pa.Table.from_batches(list(batches))
        x, y = features_matrix(table.column("_x")), table.column("_y").to_numpy()
        del table
        order = _in_order(x, y)
        x, y = x[order], y[order]
        for code in recipes[(repeat, fold)]:
            body = pickle.dumps(vars(_machine(*machines[part], _applied(fitted(repeat, fold, code), x), y, classes)), pickle.HIGHEST_PROTOCOL)
            yield pa.RecordBatch.from_arrays(
                [pa.array([repeat], pa.int32()), pa.array([fold], pa.int32()), pa.array([code]), pa.array([part], pa.int32()), pa.array([body], pa.binary())],
                ["repeat", "fold", "recipe", "part", "model"])

    def fit_forest(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeat, fold, part = (k.as_py() for k in key)
        table = pa.Table.from_batches(list(batches))
        held = table.column("_test").to_numpy()
        unseen = table.filter(table.column("_test")).drop_columns(["_x"]).combine_chunks()
        y = table.filter(pc.invert(table.column("_test"))).column("_y").to_numpy()
        x = features_matrix(table.column("_x"))
        del table
        test, x = x[held], x[~held]
        order = _in_order(x, y)
        x, y = x[order], y[order]
        ids = [plain(unseen.column(i)) for i in range(unseen.num_columns - n_keep - 1, unseen.num_columns)]
        for code in recipes[(repeat, fold)] if unseen.num_rows else ():
            scores = _forest_scores(*forests[part], fitted(repeat, fold, code), x, y, test, classes)
            for v, (best, prob) in zip(forests[part][1], scores):
                yield predicted(code, v, repeat, fold, ids[:-1], ids[-1], best, prob)

    out = []
    if forests:
        copied = copies(len(forests), *[F.col(c).alias(f"_id{i}") for i, c in enumerate(keep)], F.col(label).alias("_true"))
        copied = copied.where(F.col("_test") | F.col("_y").isNotNull())
        out.append(cut_lineage(grouped(copied, len(forests)).applyInArrow(fit_forest, schema), "cv-predictions"))
    if not machines:
        return out[0]
    train = copies(len(machines)).where(~F.col("_test") & F.col("_y").isNotNull())
    models = cut_lineage(grouped(train, len(machines)).applyInArrow(fit_machine, "repeat int, fold int, recipe string, part int, model binary"), "cv-models")
    narrow = rows.select(*keep, F.col(label).alias("_y"), "folds", "_x")

    def of_folds(pairs: Sequence[tuple], test) -> Column:
        return reduce(lambda a, b: a | b, [test(r, f) for r, f in dict.fromkeys(p[:2] for p in pairs)])

    def scored(block, pairs: Sequence[tuple]) -> DataFrame:
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {}
            for repeat, fold, code, part, body in block.value:
                found.setdefault((repeat, fold), []).append((code, part, body))
            for b in batches:
                x, folds = features_matrix(b.column(n_keep + 2)), features_matrix(b.column(n_keep + 1))
                for (repeat, fold), own in found.items():
                    idx = np.flatnonzero(folds[:, repeat - 1] == fold)
                    if not len(idx):
                        continue
                    at = pa.array(idx)
                    ids, true = [b.column(i).take(at) for i in range(n_keep)], b.column(n_keep).take(at)
                    for code, part, body in own:  # unpacked one at a time
                        model = object.__new__(KernelMachine)
                        vars(model).update(pickle.loads(body))
                        values = fitted(repeat, fold, code).kernel(x[idx])
                        for v, (best, prob) in zip(machines[part][1], _machine_scores(model, values)):
                            yield predicted(code, v, repeat, fold, ids, true, best, prob)

        return narrow.where(of_folds(pairs, lambda r, f: F.get("folds", F.lit(r - 1)) == f)).mapInArrow(score, schema)

    # Blocks of models by size; the sizes come first, so that no more than a block is at the driver.
    sizes = models.select("repeat", "fold", "recipe", "part", F.octet_length("model").alias("size")).orderBy("repeat", "fold", "recipe", "part").collect()
    number = np.cumsum([r["size"] for r in sizes]) // BLOCK_BYTES
    for k in sorted(set(number.tolist())):
        names_of = [(r["repeat"], r["fold"], r["recipe"], r["part"]) for r, own in zip(sizes, number) if own == k]
        files = models.where(of_folds(names_of, lambda r, f: (F.col("repeat") == r) & (F.col("fold") == f)))  # skips the other folds' files
        chosen_models = files.join(F.broadcast(rows.sparkSession.createDataFrame(names_of, "repeat int, fold int, recipe string, part int")),
                                    ["repeat", "fold", "recipe", "part"])
        block = [tuple(r) for r in chosen_models.select("repeat", "fold", "recipe", "part", "model").collect()]
        out.append(scored(rows.sparkSession.sparkContext.broadcast(block), names_of))
    return reduce(DataFrame.unionByName, out)
