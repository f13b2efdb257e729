"""Time the headline queries on one machine and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veilframe.catalogue.queries import QUERIES  # noqa: E402
from veilframe.session import local_session  # noqa: E402

HEADLINE = (
    "q01_clean_default q06_id_mapping q08_dedup q09_shared_ids q11_stats q12_k_report q12_k_histogram q13_summary q14_preview "
    "q18_match_rates_full q20_best_candidates q23_detect_then_clean "
    "q12_k_cleaned q13_manifest q16_workbook_k q23_workbook_files q24_stream_clean q26_throttle q26_stream_throttle q27_registry_rows"
).split()
REPEATS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "veilframe-bench")

    def run(name: str) -> float:
        start = time.perf_counter()
        # The noop sink computes every row and column without bringing any to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(HEADLINE[0])  # start the JVM and its compiler once
    seconds = {name: round(min(run(name) for _ in range(REPEATS)), 4) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "veilframe_total_seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
