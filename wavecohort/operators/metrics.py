"""Classification metrics and roll-ups over prediction tables.

Undefined ratios are NULL, never NaN, so that averages leave them out.  All
metrics start from counts per (keys, true, predicted) or per (keys, score),
which combine map-side.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavecohort.functions.arrays import array_mean, entropy_bits
from wavecohort.functions.labels import interpretation_flag
from wavecohort.operators.ordered import running_sum, with_value_bucket
from wavecohort.operators.sets import join_null_safe


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def count_if(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


def accuracy(preds: DataFrame, keys: Sequence[str], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), ratio(count_if(F.col(true) == F.col(pred)), F.count(F.lit(1))).alias("accuracy")
    )


def class_array(classes: Sequence) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def pair_counts(preds: DataFrame, keys: Sequence[str], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Rows per (keys, true, predicted): everything the count metrics need."""
    return preds.groupBy(*keys, true, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_long(preds: DataFrame, keys: Sequence[str], classes: Sequence, true: str = "y_true",
                   pred: str = "y_pred") -> DataFrame:
    """Count and row share of every class pair, zeros included."""
    counted = pair_counts(preds, keys, true, pred)
    cells = counted.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when((F.col(true) == t) & (F.col(pred) == p), F.col("n"))), F.lit(0)).alias(f"_{i}_{j}")
            for i, t in enumerate(classes) for j, p in enumerate(classes)
        ]
    )
    entries = F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.col(f"_{i}_{j}").alias("n"))
        for i, t in enumerate(classes) for j, p in enumerate(classes)
    ])
    long = cells.select(*keys, F.explode(entries).alias("e")).select(
        *keys, F.col("e.t").alias("true_class"), F.col("e.p").alias("pred_class"), F.col("e.n").alias("n")
    )
    row = W.partitionBy(*keys, "true_class")
    return long.withColumn("row_share", ratio(F.col("n"), F.sum("n").over(row)))


def confusion_pivot(preds: DataFrame, keys: Sequence[str], classes: Sequence, true: str = "y_true",
                    pred: str = "y_pred") -> DataFrame:
    long = confusion_long(preds, keys, classes, true, pred)
    return long.groupBy(*keys, "true_class").pivot("pred_class", list(classes)).agg(F.first("n"))


def per_class_metrics(preds: DataFrame, keys: Sequence[str], classes: Sequence, true: str = "y_true",
                      pred: str = "y_pred") -> DataFrame:
    """tp, fp, tn, fn and the derived ratios per declared class."""
    counted = pair_counts(preds, keys, true, pred)
    c = F.col("class")
    expanded = counted.withColumn("class", F.explode(class_array(classes)))
    n = F.col("n")
    is_true, is_pred = F.col(true) == c, F.col(pred) == c
    add = lambda cond: F.sum(F.when(cond, n).otherwise(F.lit(0)))
    cells = expanded.groupBy(*keys, "class").agg(
        add(is_true & is_pred).alias("tp"), add(~is_true & is_pred).alias("fp"),
        add(~is_true & ~is_pred).alias("tn"), add(is_true & ~is_pred).alias("fn"),
    )
    return with_ratios(cells)


def with_ratios(cells: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = cells.withColumns({
        "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "precision": ratio(tp, tp + fp),
    })
    p, s = F.col("precision"), F.col("sensitivity")
    return out.withColumn("f1_score", F.try_divide(2 * p * s, p + s))


def macro_metrics(per_class: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means over the classes whose value is defined."""
    return per_class.groupBy(*keys).agg(
        F.avg("sensitivity").alias("macro_sensitivity"), F.avg("specificity").alias("macro_specificity"),
        F.avg("precision").alias("macro_precision"), F.avg("f1_score").alias("macro_f1"),
    )


def score_cells(preds: DataFrame, keys: Sequence[str], score: str, positive: Column,
                weight: Column | None = None) -> DataFrame:
    """Positive and negative rows per distinct score, with the negatives below and the group totals.

    Columns: keys, score, pos, neg, neg_below, pos_below and the ``_total`` of both.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    zero = F.lit(0).cast("long") if weight is None else F.lit(0.0)
    flagged = preds.select(*keys, F.col(score).cast("double").alias(score), positive.alias("_p"), w.alias("_w"))
    cells = flagged.groupBy(*keys, score).agg(
        F.sum(F.when(F.col("_p"), F.col("_w")).otherwise(zero)).alias("pos"),
        F.sum(F.when(~F.col("_p"), F.col("_w")).otherwise(zero)).alias("neg"),
    )
    bucketed = with_value_bucket(cells, score, "_vb", weight=F.col("pos") + F.col("neg"))
    return running_sum(
        bucketed, keys, "_vb", [F.col(score)], {"neg_below": F.col("neg"), "pos_below": F.col("pos")},
        inclusive=False, totals=True,
    )


def auc(preds: DataFrame, keys: Sequence[str], score: str, positive: Column, weight: Column | None = None,
        out: str = "auc") -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL when a side is empty.

    Exact for any number of rows: scores are bucketed by quantile, so no window
    holds a whole configuration.
    """
    cells = score_cells(preds, keys, score, positive, weight)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    pairs = F.max("pos_below_total").cast("double") * F.max("neg_below_total").cast("double")
    return cells.groupBy(*keys).agg(F.try_divide(wins, pairs).alias(out))


def auc_binary(preds: DataFrame, keys: Sequence[str], positive, score: str = "score", true: str = "y_true") -> DataFrame:
    return auc(preds, keys, score, F.col(true) == F.lit(positive))


def auc_per_class(preds: DataFrame, keys: Sequence[str], classes: Sequence, scores: str = "scores",
                  true: str = "y_true") -> DataFrame:
    """One-vs-rest AUC of every declared class; column ``i`` of the scores belongs to class ``i``."""
    tagged = F.arrays_zip(class_array(classes).alias("c"), F.col(scores).alias("s"))
    one = preds.select(*keys, true, F.explode(tagged).alias("e")).select(
        *keys, true, F.col("e.c").alias("class"), F.col("e.s").alias("_score")
    )
    return auc(one, [*keys, "class"], "_score", F.col(true) == F.col("class"))


def auc_ovr(preds: DataFrame, keys: Sequence[str], classes: Sequence, scores: str = "scores",
            true: str = "y_true") -> DataFrame:
    return auc_per_class(preds, keys, classes, scores, true).groupBy(*keys).agg(F.avg("auc").alias("auc"))


def roc_points(preds: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    """True and false positive rate at every distinct threshold (predict positive when score >= threshold)."""
    cells = score_cells(preds, keys, score, positive)
    return cells.select(
        *keys, F.col(score).alias("threshold"),
        ratio(F.col("pos_below_total") - F.col("pos_below"), F.col("pos_below_total")).alias("tpr"),
        ratio(F.col("neg_below_total") - F.col("neg_below"), F.col("neg_below_total")).alias("fpr"),
    )


def count_metrics(preds: DataFrame, keys: Sequence[str], classes: Sequence, true: str = "y_true",
                  pred: str = "y_pred") -> DataFrame:
    """n, accuracy and the four macro metrics per key, from one pass and one shuffle.

    A task sends one row of counts per key; the rest is arithmetic on one row per key.
    """
    n, t, p = F.col("n"), F.col(true), F.col(pred)
    add = count_if
    cells = [F.count(F.lit(1)).alias("n"), add(t == p).alias("_hit")]
    for i, c in enumerate(classes):
        cells += [add((t == c) & (p == c)).alias(f"_tp{i}"), add(t == c).alias(f"_t{i}"), add(p == c).alias(f"_p{i}")]
    wide = preds.groupBy(*keys).agg(*cells)
    sens, spec, prec, f1 = [], [], [], []
    for i in range(len(classes)):
        tp, nt, np_ = F.col(f"_tp{i}"), F.col(f"_t{i}"), F.col(f"_p{i}")
        s, q = ratio(tp, nt), ratio(tp, np_)
        sens.append(s)
        prec.append(q)
        spec.append(ratio(n - nt - np_ + tp, n - nt))
        f1.append(F.try_divide(2 * q * s, q + s))
    mean = lambda cols: array_mean(F.filter(F.array(*cols), lambda v: v.isNotNull()))
    return wide.select(
        *keys, "n", ratio(F.col("_hit"), n).alias("accuracy"), mean(sens).alias("macro_sensitivity"),
        mean(spec).alias("macro_specificity"), mean(prec).alias("macro_precision"), mean(f1).alias("macro_f1"),
    )


def evaluate(preds: DataFrame, keys: Sequence[str], classes: Sequence, true: str = "y_true", pred: str = "y_pred",
             scores: str = "scores") -> DataFrame:
    """Accuracy, macro metrics and AUC per key, at the grain of the rows given.

    Reads the rows twice (pair counts and score cells): give it a stored or cached table.
    """
    counts = count_metrics(preds, keys, classes, true, pred)
    if len(classes) == 2:
        scored = preds.select(*keys, true, F.col(scores)[1].alias("_score"))
        area = auc(scored, keys, "_score", F.col(true) == F.lit(classes[1]))
    else:
        area = auc_ovr(preds, keys, classes, scores, true)
    if keys:
        return join_null_safe(counts, area, list(keys))
    one = lambda d: d.withColumn("_k", F.lit(0))
    return one(counts).join(one(area), "_k").drop("_k")


def majority(label: str, classes: Sequence) -> Column:
    """Most frequent of the declared classes, the smallest on ties; NULL where no row has one.

    One counter per class keeps the aggregation hashed and in generated code,
    where ``mode`` would fall back to sorting for many groups.
    """
    order = sorted(classes)
    counts = [count_if(F.col(label) == c) for c in order]
    top = F.greatest(*counts) if len(counts) > 1 else counts[0]
    out = F.when(top == 0, F.lit(None))
    for c, n in zip(order, counts):
        out = out.when(n == top, F.lit(c))
    return out


def group_rollup(preds: DataFrame, keys: Sequence[str], group: str, classes: Sequence, true: str = "y_true",
                 pred: str = "y_pred", scores: str = "scores") -> DataFrame:
    """One row per group: majority true and predicted label and mean scores."""
    means = F.array(*[F.avg(F.col(scores)[i]) for i in range(len(classes))])
    typed = lambda c: majority(c, classes).cast(preds.schema[c].dataType).alias(c)
    return preds.groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("n_rows"), typed(true), typed(pred), means.alias(scores),
    )


def vote_rollup(preds: DataFrame, keys: Sequence[str], group: str, low=1, high=3, score: str = "score",
                true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Majority vote with confidence for two classes; ``score`` is the probability of ``high``."""
    p_high = F.col(score)
    p_low = F.lit(1.0) - F.col(score)
    base = preds.groupBy(*keys, group).agg(
        majority(true, [low, high]).cast("long").alias("true_label"), F.count(F.lit(1)).alias("n_rows"),
        count_if(F.col(pred) == low).alias("n_low"), count_if(F.col(pred) == high).alias("n_high"),
        F.avg(p_low).alias("mean_p_low"), F.avg(p_high).alias("mean_p_high"),
        F.coalesce(F.stddev_samp(p_low), F.lit(0.0)).alias("std_p_low"),
        F.coalesce(F.stddev_samp(p_high), F.lit(0.0)).alias("std_p_high"),
    )
    nl, nh = F.col("n_low"), F.col("n_high")
    label = F.when(nl > nh, F.lit(low)).when(nh > nl, F.lit(high)).when(
        F.col("mean_p_high") > 0.5, F.lit(high)).otherwise(F.lit(low))
    confidence = F.when(nl == nh, F.lit(0.5)).otherwise(ratio(F.greatest(nl, nh), F.col("n_rows")))
    return base.withColumns({
        "pred_label": label.cast("long"), "confidence": confidence,
        "entropy": entropy_bits(F.col("mean_p_low"), F.col("mean_p_high")),
    }).withColumn("correct", F.col("true_label") == F.col("pred_label"))


def mean_posterior_rollup(preds: DataFrame, keys: Sequence[str], group: str, low=1, high=3, score: str = "score",
                          true: str = "y_true", exact: bool = True) -> DataFrame:
    """Label with the larger mean probability, the first on ties.

    The means are compared as exact sums of the scores at 12 decimals, so that
    equal means tie in whatever order the rows are added.  Without ``exact`` the
    means are compared as they were rounded.
    """
    total = F.sum(F.col(score).try_cast("decimal(18,12)"))
    mean = preds.groupBy(*keys, group).agg(
        majority(true, [low, high]).cast("long").alias("y_true"), F.avg(1.0 - F.col(score)).alias("p_low"), F.avg(score).alias("p_high"),
        (2 * total > F.count(score)).alias("_more"),
    )
    more = F.col("_more") & ~F.isnan("p_high") if exact else F.col("p_high") > F.col("p_low")
    return mean.withColumn("y_pred", F.when(more, F.lit(high)).otherwise(F.lit(low)).cast("long")).drop("_more")


def binary_counts(preds: DataFrame, keys: Sequence[str], positive, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    t, p = F.col(true) == positive, F.col(pred) == positive
    return preds.groupBy(*keys).agg(
        count_if(t & p).alias("tp"), count_if(~t & p).alias("fp"),
        count_if(~t & ~p).alias("tn"), count_if(t & ~p).alias("fn"),
    )


def binary_metrics_npv(preds: DataFrame, keys: Sequence[str], positive, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Accuracy, sensitivity, specificity, PPV, NPV and F1 for two labels."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return binary_counts(preds, keys, positive, true, pred).withColumns({
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "sensitivity": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp), "ppv": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    })


def binary_metrics_floor(preds: DataFrame, keys: Sequence[str], positive, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """As above with every denominator at least 1, so that 0/0 is 0."""
    floor = lambda num, den: num.cast("double") / F.greatest(den, F.lit(1)).cast("double")
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = binary_counts(preds, keys, positive, true, pred).withColumns({
        "accuracy": floor(tp + tn, tp + fp + tn + fn), "sensitivity": floor(tp, tp + fn),
        "specificity": floor(tn, tn + fp), "precision": floor(tp, tp + fp),
    })
    p, s = F.col("precision"), F.col("sensitivity")
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * p * s, p + s), F.lit(0.0)))


def f_beta(precision: Column, recall: Column, beta: float = 2.0) -> Column:
    b2 = beta * beta
    return F.try_divide((1 + b2) * precision * recall, b2 * precision + recall)


def balanced_accuracy(sensitivity: Column, specificity: Column) -> Column:
    return (sensitivity + specificity) / 2


def confidence_metrics(rollup: DataFrame, keys: Sequence[str], high: float = 0.85, low: float = 0.60) -> DataFrame:
    is_high, is_low = F.col("confidence") >= high, F.col("confidence") <= low
    return rollup.groupBy(*keys).agg(
        F.avg("confidence").alias("mean_confidence"),
        F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("std_confidence"),
        F.avg("entropy").alias("mean_entropy"),
        F.coalesce(F.stddev_samp("entropy"), F.lit(0.0)).alias("std_entropy"),
        count_if(is_high).alias("n_high"), ratio(count_if(is_high & F.col("correct")), count_if(is_high)).alias("acc_high"),
        count_if(is_low).alias("n_low"), ratio(count_if(is_low & F.col("correct")), count_if(is_low)).alias("acc_low"),
    )


def flagged(rollup: DataFrame) -> DataFrame:
    return rollup.withColumn("flag", interpretation_flag(F.col("confidence"), F.col("correct")))


def flag_shares(flags: DataFrame, flag: str = "flag") -> DataFrame:
    counts = flags.groupBy(flag).agg(F.count(F.lit(1)).alias("n"))
    # one row per flag
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


def metrics_long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    cast = wide.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot(list(keys), list(metrics), "metric", "value")


def compare_rollups(preds: DataFrame, group: str, low=1, high=3, score: str = "score") -> DataFrame:
    """Accuracy, sensitivity and specificity of vote and mean-probability roll-ups, and their differences."""
    scored = preds.withColumn("scores", F.array(1.0 - F.col(score), F.col(score)))
    vote = binary_metrics_npv(group_rollup(scored, [], group, [low, high]), [], high)
    mean = binary_metrics_npv(mean_posterior_rollup(preds, [], group, low, high, score, exact=False), [], high)
    names = ["accuracy", "sensitivity", "specificity"]
    v = vote.select(F.lit(0).alias("_k"), *[F.col(n).alias(f"vote_{n}") for n in names])
    m = mean.select(F.lit(0).alias("_k"), *[F.col(n).alias(f"mean_{n}") for n in names])
    return v.join(m, "_k").drop("_k").withColumns({f"diff_{n}": F.col(f"mean_{n}") - F.col(f"vote_{n}") for n in names})


def two_level_eval(preds: DataFrame, keys: Sequence[str], group: str, classes: Sequence) -> DataFrame:
    """The same metrics per row and after the roll-up to groups, side by side.

    Both grains go through one evaluation with the level as a key.
    """
    cols = [*keys, "y_true", "y_pred", "scores"]
    rolled = group_rollup(preds, keys, group, classes)
    both = preds.select(F.lit("signal").alias("level"), *cols).unionByName(
        rolled.select(F.lit("group").alias("level"), *cols))
    return evaluate(both, ["level", *keys], classes)


def _poisson_one(draw: Column) -> Column:
    """Poisson(1) by inversion of a uniform given as eight hexadecimal digits.

    Digits compare like the numbers they stand for, so the bounds are written in
    digits and nothing is parsed.
    """
    total, p, out = 0.0, math.exp(-1.0), None
    for k in range(13):
        total += p
        bound = math.ceil(total * 2**32)
        if bound >= 2**32:
            break
        hit = draw < F.lit(f"{bound:08x}")
        out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
        p /= k + 1
    return out.otherwise(F.lit(k)).cast("long")


def bootstrap_weights(df: DataFrame, ident: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Row copies with a Poisson(1) weight per replicate, from a hash of the row id.

    One md5 gives four 32-bit uniforms, hence four replicates; weight 0 copies
    are dropped, as they add nothing.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ident], F.col("_block").cast("string"))
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 4)))).withColumn("_h", F.md5(text))
    draws = F.array(*[
        F.struct(
            (F.col("_block") * 4 + i + 1).alias("replicate"),
            _poisson_one(F.substring("_h", 8 * i + 1, 8)).alias("w"),
        )
        for i in range(4)
    ])
    rows = blocks.select(*df.columns, F.explode(draws).alias("d"))
    return rows.where((F.col("d.w") > 0) & (F.col("d.replicate") <= n)).select(
        *df.columns, F.col("d.replicate").cast("long").alias("replicate"), F.col("d.w").alias("weight")
    )


def _poisson_bounds() -> np.ndarray:
    """32-bit uniforms below entry k, and not below entry k - 1, give a Poisson(1) weight of k; see ``_poisson_one``."""
    total, p, out = 0.0, math.exp(-1.0), []
    for k in range(13):
        total += p
        if (bound := math.ceil(total * 2**32)) >= 2**32:
            break
        out.append(bound)
        p /= k + 1
    return np.array(out, np.uint32)


def replicate_weights(texts: Sequence[str], n: int) -> np.ndarray:
    """(rows, n) weights, those of ``bootstrap_weights`` for rows whose seed and ids make ``texts``."""
    blocks = [f"{b}".encode() for b in range(-(-n // 4))]
    body = bytearray()
    for t in texts:
        start = hashlib.md5(f"{t}:".encode())
        for b in blocks:
            h = start.copy()
            h.update(b)
            body += h.digest()
    draws = np.frombuffer(bytes(body), ">u4").reshape(len(texts), 4 * len(blocks))[:, :n]
    return np.searchsorted(_poisson_bounds(), draws.astype(np.uint32), "right").astype(np.float64)


class _Run:
    """Ties of one partition in order of the score: (key, positives, negatives) of the first and the last, the rest added up."""

    def __init__(self, n: int):
        self.first = self.last = None
        self.pos, self.neg, self.wins = np.zeros(n), np.zeros(n), np.zeros(n)

    def add(self, keys: list, pos: np.ndarray, neg: np.ndarray) -> None:
        if self.last and self.last[0] == keys[0]:
            pos[0] += self.last[1]
            neg[0] += self.last[2]
        elif self.last:
            self._inner(self.last[1][None], self.last[2][None])
        elif self.first and self.first[0] == keys[0]:
            self.first = (keys[0], self.first[1] + pos[0], self.first[2] + neg[0])
            keys, pos, neg = keys[1:], pos[1:], neg[1:]
        elif not self.first:
            self.first = (keys[0], pos[0], neg[0])
            keys, pos, neg = keys[1:], pos[1:], neg[1:]
        if len(keys):
            self._inner(pos[:-1], neg[:-1])
            self.last = (keys[-1], pos[-1].copy(), neg[-1].copy())

    def _inner(self, pos: np.ndarray, neg: np.ndarray) -> None:
        below = self.neg + np.cumsum(neg, axis=0) - neg
        self.wins += (pos * (below + neg / 2.0)).sum(axis=0)
        self.pos += pos.sum(axis=0)
        self.neg += neg.sum(axis=0)

    def rows(self):
        """(key, positives, negatives, wins) in order; a key of None stands for several."""
        out = [(*self.first, None)] if self.first else []
        return out + ([(None, self.pos, self.neg, self.wins), (*self.last, None)] if self.last else [])


def auc_replicates(preds: DataFrame, ident: Sequence[str], score: str, positive: Column, n: int = 200,
                   seed: int = 42) -> DataFrame:
    """(replicate, auc) over ``n`` Poisson resamples of the rows; NULL where a side is empty.

    A row is shuffled once, whatever ``n`` is: slim rows are sorted by range of
    the score, ties spread by a hash, and all weights of a row are drawn where
    it arrives.  A partition adds up vectors over the replicates and gives its
    first tie, its last tie and the sum of what lies between; these few vectors
    per partition meet in one task.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ident])
    slim = preds.select(text.alias("_t"), F.col(score).cast("double").alias("_s"), positive.cast("int").alias("_p"))
    # NULL scores come first and NaN last, as everywhere in Spark.
    ordered = slim.repartitionByRange("_s", F.xxhash64("_t")).sortWithinPartitions("_s")
    names = ["part", "seg", "null", "score", "pos", "neg", "wins"]
    vectors = lambda rows: pa.array([None if v is None else v.tolist() for v in rows], pa.list_(pa.float64()))

    def add_up(batches):
        run, part = _Run(n), TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                s, null = b.column(1).fill_null(0.0).to_numpy(), b.column(1).is_null().to_numpy(zero_copy_only=False)
                p = b.column(2).fill_null(-1).to_numpy()
                w = replicate_weights(b.column(0).to_pylist(), n)
                same = (null[1:] & null[:-1]) | (~null[1:] & ~null[:-1] & ((s[1:] == s[:-1]) | (np.isnan(s[1:]) & np.isnan(s[:-1]))))
                start = np.append(0, np.flatnonzero(~same) + 1)
                keys = [(bool(null[k]), "nan" if np.isnan(s[k]) else float(s[k])) for k in start.tolist()]
                run.add(keys, np.add.reduceat(w * (p == 1)[:, None], start, axis=0), np.add.reduceat(w * (p == 0)[:, None], start, axis=0))
        rows = run.rows()
        key = [r[0] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(rows), pa.int32()), pa.array(list(range(len(rows))), pa.int32()), pa.array([k and k[0] for k in key], pa.bool_()),
             pa.array([k and (np.nan if k[1] == "nan" else k[1]) for k in key], pa.float64()), *[vectors([r[i] for r in rows]) for i in (1, 2, 3)]], names)

    def meet(batches):
        tie, pos, neg, wins = None, np.zeros(n), np.zeros(n), np.zeros(n)

        def close():
            nonlocal pos, neg, wins, tie
            if tie:
                wins = wins + tie[1] * (neg + tie[2] / 2.0)
                pos, neg, tie = pos + tie[1], neg + tie[2], None

        for b in batches:
            for r in b.to_pylist():
                a, z = np.array(r["pos"]), np.array(r["neg"])
                if r["null"] is None:
                    close()
                    wins = wins + np.array(r["wins"]) + a * neg
                    pos, neg = pos + a, neg + z
                    continue
                key = (r["null"], "nan" if np.isnan(r["score"]) else r["score"])
                if tie and tie[0] == key:
                    tie = (key, tie[1] + a, tie[2] + z)
                else:
                    close()
                    tie = (key, a, z)
        close()
        pairs = pos * neg
        live = np.flatnonzero(pos + neg > 0)
        auc = [float(wins[i] / pairs[i]) if pairs[i] else None for i in live]
        yield pa.RecordBatch.from_arrays([pa.array(live + 1, pa.int64()), pa.array(auc, pa.float64())], ["replicate", "auc"])

    shape = "part int, seg int, null boolean, score double, pos array<double>, neg array<double>, wins array<double>"
    few = ordered.mapInArrow(add_up, shape).repartition(1).sortWithinPartitions("part", "seg")
    return few.mapInArrow(meet, "replicate long, auc double")


def auc_bootstrap_ci(preds: DataFrame, ident: Sequence[str], score: str, positive: Column, n: int = 200,
                     seed: int = 42) -> DataFrame:
    """Percentile interval of the AUC over ``n`` resamples."""
    reps = auc_replicates(preds, ident, score, positive, n, seed)
    return reps.agg(
        F.avg("auc").alias("auc_mean"), F.percentile("auc", 0.025).alias("ci_low"), F.percentile("auc", 0.975).alias("ci_high")
    )


