"""Times headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]: median of three warm runs; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scribegauge import queries  # noqa: E402
from scribegauge.session import local_session  # noqa: E402

HEADLINE = ("normalized_text", "token_counts", "wer_pairs", "cer_pairs", "hallucination_flags", "punctuation_f1", "keyword_f1", "number_extract", "score_pairs", "role_scores", "weighted_overall", "weighted_by_scenario", "weight_list", "category_profile", "run_rtf", "apportioned_seconds", "merged_conversations")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run = queries.QUERIES[name]
        took = []
        for _ in range(4):
            began = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(median(took[1:]), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
