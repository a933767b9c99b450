"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is computed in full and written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from rostrum import bindings
from rostrum.session import session

HEADLINES = (
    "popularity_levels", "rating_target_set", "ratings_nested", "top_array_contains",
    "posterior_stats", "pause_stats", "turn_stats", "weighted_vector_stats", "talk_features",
    "clean_text", "word_count", "url_join", "speaker_code", "corr_matrix", "histogram",
    "value_counts", "top_bottom_union", "balanced_folds", "auc_ovr", "score_long", "baseline",
    "scaled", "forest_holdout", "rbf_holdout", "pca2", "survey_pairs",
    "speaker_code_rows", "signed_vector_stats",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first job pays for starting the session's threads.
    spark.read.parquet(f"{folder}/region.parquet").count()
    queries, times = bindings.queries(), {}
    for name in HEADLINES:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
