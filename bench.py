"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pairmatch.catalogue import QUERIES
from pairmatch.session import local_session

HEADLINE = (
    "pair_join",
    "pair_text_build",
    "normalised_documents",
    "evidence_batch",
    "macro_average_precision",
    "average_precision_by_category",
    "metric_by_fold",
    "macro_spearman",
    "stress_suite",
    "hard_pair_thresholds",
    "percentile_rank_fold",
    "shuffle_order",
    "connected_components",
    "candidate_pool",
    "hard_replay",
    "blend_category_rank",
    "cross_fitted_global",
    "weight_grid",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # Start the JVM's code paths once, outside the clock.
    QUERIES["category_counts"].run(spark, sf_dir).collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
