"""Evaluation of predictions held as rows (doc_id, label_name, y, p, yhat)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.functions import scoring as sc
from modlens.operators.ranking import bucketed_sums, range_buckets, running_sums
from modlens.session import checkpointed
from modlens.sources.tables import small_table

LABEL = "label_name"


def _safe(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def label_params(spark: SparkSession) -> DataFrame:
    """The tuning parameters of the labels."""
    return small_table(
        spark,
        lx.LABEL_PARAMS,
        "label_name string, t_lo double, t_hi double, weight_multiplier double, focal_alpha double",
    )


def threshold_grid() -> dict[str, list[float]]:
    """Candidate thresholds per label, low end included, high end not."""
    return {
        name: np.arange(lo, hi, lx.THRESHOLD_STEP).tolist()
        for name, lo, hi, _, _ in lx.LABEL_PARAMS
    }


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight of each class: rows / (classes x rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row per class
    return counts.withColumn(
        "weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))
    )


def confusion(preds: DataFrame) -> DataFrame:
    """Per label the counts tn, fp, fn, tp."""
    y, h = F.col("y"), F.col("yhat")
    return preds.groupBy(LABEL).agg(
        F.count_if((y == 0) & (h == 0)).alias("tn"),
        F.count_if((y == 0) & (h == 1)).alias("fp"),
        F.count_if((y == 1) & (h == 0)).alias("fn"),
        F.count_if((y == 1) & (h == 1)).alias("tp"),
    )


def classification_report(preds: DataFrame) -> DataFrame:
    """Per label: rows for the classes 0 and 1, the accuracy, the macro and the weighted mean.

    A ratio with nothing to divide by is 0. The accuracy row holds it in all three columns.
    """
    c = {n: F.col(n).cast("double") for n in ("tn", "fp", "fn", "tp")}

    def scores(hit: Column, false_hit: Column, missed: Column) -> tuple[Column, Column, Column]:
        return (
            _safe(hit, hit + false_hit),
            _safe(hit, hit + missed),
            _safe(2 * hit, 2 * hit + false_hit + missed),
        )

    per = confusion(preds)
    zero = scores(c["tn"], c["fn"], c["fp"])
    one = scores(c["tp"], c["fp"], c["fn"])
    n0, n1 = c["tn"] + c["fp"], c["fn"] + c["tp"]
    accuracy = _safe(c["tn"] + c["tp"], n0 + n1)

    def row(name: str, values: tuple, support: Column) -> Column:
        p, r, f = values
        return F.struct(
            F.lit(name).alias("class_name"),
            p.alias("precision"),
            r.alias("recall"),
            f.alias("f1"),
            support.cast("bigint").alias("support"),
        )

    macro = tuple((a + b) / 2 for a, b in zip(zero, one))
    weighted = tuple(_safe(a * n0 + b * n1, n0 + n1) for a, b in zip(zero, one))
    rows = F.array(
        row("0", zero, n0),
        row("1", one, n1),
        row("accuracy", (accuracy, accuracy, accuracy), n0 + n1),
        row("macro avg", macro, n0 + n1),
        row("weighted avg", weighted, n0 + n1),
    )
    return per.select(LABEL, F.explode(rows).alias("r")).select(LABEL, "r.*")


def _score_counts(preds: DataFrame, score: Column) -> DataFrame:
    # Written once, as ranges, sums of buckets and rows are all read from it.
    return checkpointed(
        preds.groupBy(LABEL, score.alias("s")).agg(
            F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
        )
    )


def roc_auc(preds: DataFrame, rows_per_bucket: int = 200_000) -> DataFrame:
    """Per label the share of (positive, negative) pairs in the right order, ties one half.

    NULL where a class is missing.
    """
    sums = running_sums(_score_counts(preds, F.col("p")), LABEL, "s", ["neg"], rows_per_bucket)
    below = F.col("cum_neg") - F.col("neg")
    pairs = F.sum(F.col("pos") * (below.cast("double") + F.col("neg") / 2))
    return sums.groupBy(LABEL).agg(
        F.try_divide(pairs, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc")
    )


def roc_curve(preds: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """Per label the points (threshold, fpr, tpr) by falling score, from (0, 0) on.

    The first point has no threshold. ``drop_intermediate`` leaves out the points on a straight
    line between their neighbours.
    """
    counts = _score_counts(preds, -F.col("p"))
    totals = counts.groupBy(LABEL).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    sums = bucketed_sums(range_buckets(counts, LABEL, "s"), LABEL, "s", ["pos", "neg"])
    if drop_intermediate:
        sums = _corner_points(sums)
    scored = sums.select(
        LABEL,
        (-F.col("s")).alias("threshold"),
        F.col("cum_neg").alias("_fp"),
        F.col("cum_pos").alias("_tp"),
    )
    origin = totals.select(
        LABEL, F.lit(None).cast("double"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    )
    return (
        scored.union(origin)
        .join(totals, LABEL)
        .select(
            LABEL,
            "threshold",
            F.try_divide(F.col("_fp").cast("double"), F.col("_n")).alias("fpr"),
            F.try_divide(F.col("_tp").cast("double"), F.col("_p")).alias("tpr"),
        )
    )


def _corner_points(sums: DataFrame) -> DataFrame:
    # A point is kept if the step after it differs from the step to it, and always at both ends.
    # The step after the last row of a bucket is the first one of the next bucket.
    step = F.struct("pos", "neg")
    heads = sums.groupBy(LABEL, "_bucket").agg(F.min_by(step, "s").alias("_head"))
    next_bucket = Window.partitionBy(LABEL).orderBy("_bucket")
    heads = heads.select(LABEL, "_bucket", F.lead("_head").over(next_bucket).alias("_next_head"))
    inside = Window.partitionBy(LABEL, "_bucket").orderBy("s")
    after = F.coalesce(F.lead(step).over(inside), F.col("_next_head"))
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    return (
        sums.join(heads, [LABEL, "_bucket"])
        .withColumn("_after", after)
        .filter(F.col("_after").isNull() | (F.col("_after") != step) | first)
    )


def summary(preds: DataFrame) -> DataFrame:
    """Per label: AUC, and precision, recall and F1 of the positive class."""
    one = classification_report(preds).filter(F.col("class_name") == "1")
    return one.select(LABEL, "precision", "recall", "f1").join(roc_auc(preds), LABEL)


def prediction_quality(preds: DataFrame) -> DataFrame:
    """Per label: true and predicted positives with their percentages, hits, precision."""
    y, h = F.col("y"), F.col("yhat")
    return (
        preds.groupBy(LABEL)
        .agg(
            F.count("*").alias("total"),
            F.count_if(y == 1).alias("positives"),
            F.count_if(h == 1).alias("predicted"),
            F.count_if((y == 1) & (h == 1)).alias("true_positives"),
            F.count_if((y == 0) & (h == 1)).alias("false_positives"),
        )
        .withColumns(
            {
                "positive_pct": F.col("positives") / F.col("total") * 100,
                "predicted_pct": F.col("predicted") / F.col("total") * 100,
                "precision_pct": F.try_divide(
                    F.col("true_positives").cast("double"), F.col("predicted")
                )
                * 100,
            }
        )
    )


def positive_ratio(preds: DataFrame) -> DataFrame:
    """Per label the share of positives, 0 if there are none."""
    return preds.groupBy(LABEL).agg(F.avg(F.col("y").cast("double")).alias("positive_ratio"))


def mean_focal_loss(preds: DataFrame, gamma: float = 2.0) -> DataFrame:
    """Per label the mean focal loss, alpha from the label parameters."""
    params = label_params(preds.sparkSession).select(LABEL, "focal_alpha")
    loss = sc.focal_loss(gamma)(F.col("y"), F.col("p"), F.col("focal_alpha"))
    return (
        preds.join(F.broadcast(params), LABEL).groupBy(LABEL).agg(F.avg(loss).alias("focal_loss"))
    )


def threshold_table(preds: DataFrame, grid: dict[str, list[float]] | None = None) -> DataFrame:
    """Per label and candidate threshold: tp, fp, fn and F1 of ``p > t``.

    Each row falls once into the number of thresholds below its score. The counts per threshold
    are sums over that small table, so the rows are not multiplied by the grid.
    """
    grid = grid or threshold_grid()
    spark = preds.sparkSession
    lists = small_table(spark, list(grid.items()), f"{LABEL} string, grid array<double>")
    passed = F.size(F.filter("grid", lambda t: F.col("p") > t))
    hist = (
        preds.join(F.broadcast(lists), LABEL)
        .groupBy(LABEL, passed.alias("passed"))
        .agg(
            F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
        )
    )
    points = small_table(
        spark,
        [(n, i, float(t)) for n, ts in grid.items() for i, t in enumerate(ts)],
        f"{LABEL} string, ix int, t double",
    )
    joined = points.join(hist, LABEL)  # grid size x grid size rows per label
    above = F.col("passed") > F.col("ix")
    f1 = _safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return (
        joined.groupBy(LABEL, "t")
        .agg(
            F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"),
        )
        .withColumn("f1", f1)
    )


def best_thresholds(preds: DataFrame, grid: dict[str, list[float]] | None = None) -> DataFrame:
    """Per label the lowest threshold with the best F1; 0.5 if every F1 is 0."""
    table = threshold_table(preds, grid)
    w = Window.partitionBy(LABEL).orderBy(F.col("f1").desc(), F.col("t").asc())
    best = table.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    return best.select(
        LABEL,
        F.when(F.col("f1") > 0, F.col("t")).otherwise(F.lit(0.5)).alias("threshold"),
        F.col("f1").alias("best_f1"),
    )


def apply_thresholds(preds: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Predictions with ``yhat`` = score above the label's threshold."""
    return preds.join(thresholds.select(LABEL, "threshold"), LABEL).withColumn("yhat", (F.col("p") > F.col("threshold")).cast("int"))
