"""Run the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from modlens.registry import all_queries
from modlens.session import local_session, run_dir

HEADLINE = [
    "aggression_by_class",
    "clean_comments",
    "tokenise",
    "sentence_split",
    "identity_columns",
    "mention_table",
    "term_statistics",
    "mark_negation",
    "polarity",
    "normalise_table",
    "native_features",
    "bias_patterns",
    "tagged_syntax",
    "full_feature_table",
    "class_feature_profile",
    "tfidf_vocabulary",
    "tfidf_weights",
    "word_frequencies",
    "sizing",
    "first_seen_word_ids",
    "stratified_split",
    "encoded_sequences",
    "classification_report",
    "roc_auc",
    "roc_corner_points",
    "best_thresholds",
    "misclassified_samples",
    "class_mean_gaps",
    "label_correlation",
    "principal_components",
    "embedded_texts",
    "manual_forest_importances",
    "embedding_importances",
    "stream_enrich",
    "roc_auc_fine",
    "manual_forest_summary",
    "embedding_forest_report",
    "forest_prediction_counts",
    "engineered_features",
    "tfidf_block",
    "processed_round_trip",
    "processed_statistics",
    "csv_round_trip",
    "kept_vectors",
]
WARM_UP = "word_split"


def dealt(spark: SparkSession, folder: str, parts: int) -> str:
    """The tables of a folder with their rows dealt over files, so that a scan keeps all cores busy.

    The given tables are one row group each, which one task reads whatever the number of cores.
    """
    out = run_dir(spark, "bench")
    for name in sorted(n.removesuffix(".parquet") for n in os.listdir(folder) if n.endswith(".parquet")):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        df.repartition(parts).write.parquet(f"{out}/{name}.parquet")
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    folder = dealt(spark, folder, cpus)
    # One query first that is not timed, so that starting Spark is not counted for any.
    known[WARM_UP].run(spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # The sink takes every row and writes none.
        known[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "input": f"tables dealt over {cpus} files, not timed",
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
