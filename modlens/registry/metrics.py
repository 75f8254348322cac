"""Evaluation queries over the score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from modlens import lexicons as lx
from modlens.operators import metrics as mt
from modlens.plans.sequences import tuned_predictions
from modlens.registry.inputs import SCORES, SIX_LABELS, Query, labels, scores


def _rounded(df, digits=6):
    names = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


def class_weights(spark, folder):
    return _rounded(mt.class_weights(labels(spark, folder), "toxic"))


def class_weights_joined(spark, folder):
    """Every labelled row with the weight of its class."""
    df = labels(spark, folder).select("doc_id", "insult")
    weights = mt.class_weights(df, "insult").select("insult", "weight")
    return _rounded(df.join(F.broadcast(weights), "insult"))


def confusion(spark, folder):
    return mt.confusion(scores(spark, folder))


def classification_report(spark, folder):
    return _rounded(mt.classification_report(scores(spark, folder)))


def roc_auc(spark, folder):
    return _rounded(mt.roc_auc(scores(spark, folder)))


def fine_scores(spark, folder):
    """Scores of which nearly every row has its own."""
    digest = F.md5(F.concat_ws(":", "label_name", F.col("doc_id").cast("string")).cast("binary"))
    spot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return scores(spark, folder).withColumn("p", (spot / 2.0 + F.col("y") * 1e9) / F.lit(3.2e9))


def roc_auc_fine(spark, folder):
    """AUC over many range buckets."""
    return _rounded(mt.roc_auc(fine_scores(spark, folder), rows_per_bucket=50))


def roc_curve(spark, folder):
    return _rounded(mt.roc_curve(scores(spark, folder), drop_intermediate=False))


def roc_corner_points(spark, folder):
    return _rounded(mt.roc_curve(scores(spark, folder)))


def summary(spark, folder):
    return _rounded(mt.summary(scores(spark, folder)))


def prediction_quality(spark, folder):
    return _rounded(mt.prediction_quality(scores(spark, folder)))


def positive_ratio(spark, folder):
    return _rounded(mt.positive_ratio(scores(spark, folder)))


def focal_loss(spark, folder):
    return _rounded(mt.mean_focal_loss(scores(spark, folder)))


def threshold_table(spark, folder):
    return _rounded(mt.threshold_table(scores(spark, folder)), 9)


def best_thresholds(spark, folder):
    return _rounded(mt.best_thresholds(scores(spark, folder)), 9)


def tuned_report(spark, folder):
    """Thresholds found, applied, and the classes reported."""
    _, tuned = tuned_predictions(scores(spark, folder))
    return _rounded(mt.classification_report(tuned))


def tuned_rows(spark, folder):
    _, tuned = tuned_predictions(scores(spark, folder))
    return _rounded(tuned.select("doc_id", "label_name", "threshold", "yhat"), 9)


# -- SQL -------------------------------------------------------------------------------------

CONFUSION = (
    "cm AS (SELECT label_name, count(*) FILTER (y = 0 AND yhat = 0) AS tn,"
    " count(*) FILTER (y = 0 AND yhat = 1) AS fp, count(*) FILTER (y = 1 AND yhat = 0) AS fn,"
    " count(*) FILTER (y = 1 AND yhat = 1) AS tp FROM {source} GROUP BY 1)"
)


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0::DOUBLE ELSE ({a}) / ({b})::DOUBLE END"


def _sql_report(source: str) -> str:
    """CTEs ending in ``rp``: report rows, unrounded."""
    per = (
        f"pc AS (SELECT label_name, '0' AS c, {_div('tn', 'tn + fn')} AS p, {_div('tn', 'tn + fp')} AS r,"
        " tn + fp AS s, tn AS hit FROM cm UNION ALL"
        f" SELECT label_name, '1', {_div('tp', 'tp + fp')}, {_div('tp', 'tp + fn')}, tp + fn, tp FROM cm), "
        f"pf AS (SELECT *, {_div('2 * p * r', 'p + r')} AS f FROM pc)"
    )
    return (
        f"{CONFUSION.format(source=source)}, {per}, rp AS ("
        "SELECT label_name, c AS class_name, p AS precision, r AS recall, f AS f1, s AS support FROM pf"
        " UNION ALL SELECT label_name, 'accuracy', sum(hit) / sum(s)::DOUBLE, sum(hit) / sum(s)::DOUBLE,"
        " sum(hit) / sum(s)::DOUBLE, sum(s)::BIGINT FROM pf GROUP BY 1"
        " UNION ALL SELECT label_name, 'macro avg', avg(p), avg(r), avg(f), sum(s)::BIGINT FROM pf GROUP BY 1"
        " UNION ALL SELECT label_name, 'weighted avg', sum(p * s) / sum(s)::DOUBLE, sum(r * s) / sum(s)::DOUBLE,"
        " sum(f * s) / sum(s)::DOUBLE, sum(s)::BIGINT FROM pf GROUP BY 1)"
    )


_REPORT = (
    "SELECT label_name, class_name, round(precision, 6) AS precision, round(recall, 6) AS recall,"
    " round(f1, 6) AS f1, support FROM rp"
)

# Pairs of distinct scores, weighted by their counts.
AUC = (
    "sc AS (SELECT label_name, p, count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn"
    " FROM scored GROUP BY 1, 2), "
    "auc AS (SELECT a.label_name, sum(a.np * b.nn * CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p"
    " THEN 0.5::DOUBLE ELSE 0 END) / (SELECT sum(np) * sum(nn) FROM sc s WHERE s.label_name = a.label_name)::DOUBLE"
    " AS roc_auc FROM sc a JOIN sc b ON a.label_name = b.label_name GROUP BY 1)"
)

CURVE = (
    "sc AS (SELECT label_name, p, count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn"
    " FROM scored GROUP BY 1, 2), "
    "cu AS (SELECT *, sum(np) OVER w AS tp, sum(nn) OVER w AS fp, sum(np) OVER (PARTITION BY label_name) AS pp,"
    " sum(nn) OVER (PARTITION BY label_name) AS nt, lead(np) OVER o AS np2, lead(nn) OVER o AS nn2,"
    " row_number() OVER o AS place FROM sc"
    " WINDOW w AS (PARTITION BY label_name ORDER BY p DESC ROWS UNBOUNDED PRECEDING),"
    " o AS (PARTITION BY label_name ORDER BY p DESC))"
)
_ORIGIN = " UNION ALL SELECT DISTINCT label_name, NULL, 0::DOUBLE, 0::DOUBLE FROM sc"
_POINTS = (
    "SELECT label_name, round(p, 6) AS threshold, round(fp / nt::DOUBLE, 6) AS fpr,"
    " round(tp / pp::DOUBLE, 6) AS tpr FROM cu"
)

_ALPHA = ", ".join(f"('{n}', {a}::DOUBLE)" for n, _, _, _, a in lx.LABEL_PARAMS)
# Thresholds from the low end in steps of 0.05, the high end left out: first and number per label.
_STEPS = [
    ("toxic", "0.3", 8), ("severe_toxic", "0.4", 8), ("obscene", "0.4", 6), ("threat", "0.3", 4),
    ("insult", "0.4", 6), ("identity_hate", "0.6", 5),
]
_GRID = ", ".join(
    f"('{n}', {low}::DOUBLE + {i} * (({low}::DOUBLE + 0.05::DOUBLE) - {low}::DOUBLE))"
    for n, low, many in _STEPS for i in range(many)
)

GRID = (
    f"gr AS (SELECT * FROM (VALUES {_GRID}) v(label_name, t)), "
    "gt AS (SELECT label_name, t, count(*) FILTER (y = 1 AND p > t) AS tp,"
    " count(*) FILTER (y = 0 AND p > t) AS fp, count(*) FILTER (y = 1 AND p <= t) AS fn"
    " FROM scored JOIN gr USING (label_name) GROUP BY 1, 2), "
    f"gf AS (SELECT *, {_div('2 * tp', '2 * tp + fp + fn')} AS f1 FROM gt), "
    "bt AS (SELECT label_name, CASE WHEN f1 > 0 THEN t ELSE 0.5::DOUBLE END AS threshold, f1 AS best_f1"
    " FROM gf QUALIFY row_number() OVER (PARTITION BY label_name ORDER BY f1 DESC, t) = 1), "
    "tuned AS (SELECT doc_id, label_name, y, p, threshold, CAST(p > threshold AS INT) AS yhat"
    " FROM scored JOIN bt USING (label_name))"
)

QUERIES = {
    "class_weights": Query(
        class_weights,
        f"WITH {SIX_LABELS} SELECT toxic, count(*) AS n, round((SELECT count(*) FROM six)"
        " / ((SELECT count(DISTINCT toxic) FROM six) * count(*))::DOUBLE, 6) AS weight FROM six GROUP BY 1",
    ),
    "class_weights_joined": Query(
        class_weights_joined,
        f"WITH {SIX_LABELS}, w AS (SELECT insult, round((SELECT count(*) FROM six)"
        " / ((SELECT count(DISTINCT insult) FROM six) * count(*))::DOUBLE, 6) AS weight FROM six GROUP BY 1)"
        " SELECT doc_id, insult, weight FROM six JOIN w USING (insult)",
    ),
    "confusion": Query(
        confusion,
        f"WITH {SCORES}, {CONFUSION.format(source='scored')} SELECT label_name, tn, fp, fn, tp FROM cm",
    ),
    "classification_report": Query(
        classification_report, f"WITH {SCORES}, {_sql_report('scored')} {_REPORT}"
    ),
    "roc_auc": Query(
        roc_auc, f"WITH {SCORES}, {AUC} SELECT label_name, round(roc_auc, 6) AS roc_auc FROM auc"
    ),
    "roc_auc_fine": Query(
        roc_auc_fine,
        f"WITH {SCORES}, fs AS (SELECT label_name, y, (crc / 2.0::DOUBLE + y * 1e9::DOUBLE) / 3.2e9::DOUBLE AS p"
        " FROM (SELECT *, CAST('0x' || substr(md5(label_name || ':' || doc_id), 1, 8) AS BIGINT) AS crc FROM preds)),"
        " r AS (SELECT *, rank() OVER (PARTITION BY label_name ORDER BY p)"
        " + (count(*) OVER (PARTITION BY label_name, p) - 1) / 2.0::DOUBLE AS rk FROM fs)"
        " SELECT label_name, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE)"
        " / (sum(y) * (count(*) - sum(y)))::DOUBLE, 6) AS roc_auc FROM r GROUP BY 1",
    ),
    "roc_curve": Query(roc_curve, f"WITH {SCORES}, {CURVE} {_POINTS}{_ORIGIN}"),
    "roc_corner_points": Query(
        roc_corner_points,
        f"WITH {SCORES}, {CURVE} {_POINTS} WHERE np2 IS NULL OR np2 <> np OR nn2 <> nn OR place = 1{_ORIGIN}",
    ),
    "evaluation_summary": Query(
        summary,
        f"WITH {SCORES}, {_sql_report('scored')}, {AUC} SELECT label_name, round(precision, 6) AS precision,"
        " round(recall, 6) AS recall, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc"
        " FROM rp JOIN auc USING (label_name) WHERE class_name = '1'",
    ),
    "prediction_quality": Query(
        prediction_quality,
        f"WITH {SCORES} SELECT label_name, count(*) AS total, count(*) FILTER (y = 1) AS positives,"
        " count(*) FILTER (yhat = 1) AS predicted, count(*) FILTER (y = 1 AND yhat = 1) AS true_positives,"
        " count(*) FILTER (y = 0 AND yhat = 1) AS false_positives,"
        " round(count(*) FILTER (y = 1) / count(*)::DOUBLE * 100, 6) AS positive_pct,"
        " round(count(*) FILTER (yhat = 1) / count(*)::DOUBLE * 100, 6) AS predicted_pct,"
        " round(count(*) FILTER (y = 1 AND yhat = 1) / nullif(count(*) FILTER (yhat = 1), 0)::DOUBLE * 100, 6)"
        " AS precision_pct FROM scored GROUP BY 1",
    ),
    "positive_ratio": Query(
        positive_ratio,
        f"WITH {SCORES} SELECT label_name, round(sum(y) / count(*)::DOUBLE, 6) AS positive_ratio"
        " FROM scored GROUP BY 1",
    ),
    "focal_loss": Query(
        focal_loss,
        f"WITH {SCORES}, al AS (SELECT * FROM (VALUES {_ALPHA}) v(label_name, alpha)),"
        " cl AS (SELECT label_name, alpha,"
        " greatest(1e-7::DOUBLE, least(CASE WHEN y = 1 THEN p ELSE 1 END, 1 - 1e-7::DOUBLE)) AS p1,"
        " greatest(1e-7::DOUBLE, least(CASE WHEN y = 0 THEN p ELSE 0 END, 1 - 1e-7::DOUBLE)) AS p0"
        " FROM scored JOIN al USING (label_name))"
        " SELECT label_name, round(-avg(alpha * pow(1 - p1, 2) * ln(p1))"
        " - avg((1 - alpha) * pow(p0, 2) * ln(1 - p0)), 6) AS focal_loss FROM cl GROUP BY 1",
    ),
    "threshold_table": Query(
        threshold_table,
        f"WITH {SCORES}, {GRID} SELECT label_name, round(t, 9) AS t, tp, fp, fn, round(f1, 9) AS f1 FROM gf",
    ),
    "best_thresholds": Query(
        best_thresholds,
        f"WITH {SCORES}, {GRID} SELECT label_name, round(threshold, 9) AS threshold,"
        " round(best_f1, 9) AS best_f1 FROM bt",
    ),
    "tuned_report": Query(
        tuned_report, f"WITH {SCORES}, {GRID}, {_sql_report('tuned')} {_REPORT}"
    ),
    "tuned_rows": Query(
        tuned_rows,
        f"WITH {SCORES}, {GRID} SELECT doc_id, label_name, round(threshold, 9) AS threshold, yhat FROM tuned",
    ),
}
