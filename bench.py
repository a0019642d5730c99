"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "seg1_split_chapters",
    "seg8_chunk_by_chars",
    "cln1_md_to_text",
    "cln9_repeated_ngrams",
    "jon1_build_eval",
    "jon15_near_boundary_mean",
    "smp15_cumulative_pages",
    "agg3_bin_quantiles",
    "agg6_best_of_shifts",
    "win3_variance_interval",
    "win6_preprocess",
    "met2_bleu4",
    "met5_edit_dist",
    "met6_meteor_exact",
    "flow_scores_by_language",
    "fit2_fit_loglog",
    "fit12_fit_group_power",
    "em6_em_fit",
    "em12_log_likelihoods",
    "em14_score_points",
]


def main() -> None:
    from pagescale.plans import all_queries
    from pagescale.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in sys.argv[1:] if not n.startswith("-")] or HEADLINE
    spark = local_session("bench", cores=cpus, partitions=2 * int(cpus) if cpus.isdigit() else 16, memory="16g")
    spark.range(1000).selectExpr("sum(id)").collect()  # start executors before the first timing
    queries, seconds = all_queries(), {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        if "-v" in sys.argv:
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
