"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the number of local cores.  Names given on the
command line replace the headline list; ``all`` runs every registered query.  Each query is run once
to warm up and then up to three times; the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from factlake.queries import QUERIES, Tables  # noqa: E402

HEADLINE = [
    "p2_occurrences",
    "p4_conditional_counts",
    "p5_distinct_tokens",
    "p7_category_inventory",
    "p10_classify_targets",
    "j1_resolve_refs",
    "j4_range_lookup",
    "j5_overlap_pairs",
    "j7_asof_attribute",
    "a1_all_of_group",
    "a3_lattice_meet",
    "a4_masks",
    "a7_equivalence_classes",
    "n1_layout_ranges",
    "n5_dead_writes",
    "n6_rank_order",
    "g2_reachable",
    "g3_transitive_closure",
    "g5_strong_components",
    "g8_connected_components",
    "g8_supply_components",
    "g16_reach_summary",
    "d1_structural_classes",
    "s3_chunk_records",
    "t1_parse_int",
    "t2_parse_float",
    "t4_escape_text",
    "t5_printf_inventory",
    "t6_extract_by_pattern",
]
BUDGET = 6.0


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("factlake-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    names = list(QUERIES) if names == ["all"] else names

    def run(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds: dict[str, float] = {}
    for name in names:
        run(name)
        runs: list[float] = []
        while len(runs) < 3 and sum(runs) < BUDGET:
            runs.append(run(name))
        seconds[name] = round(statistics.median(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
