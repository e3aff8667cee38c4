"""Time the headline queries and print one JSON line.

Every query runs twice against a no-op sink; ``queries`` holds the second,
warm time and ``cold`` the first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vectext.session import drop_cuts, get_session, use_own_folder  # noqa: E402

HEADLINE = [
    "corpus_clean", "prefix_dedup", "reject_reasons", "first_n_clean",
    "tokenize_stats", "sample_positions", "base_rows", "base_vectors", "embedding_lookup", "marker_sites",
    "split_rows", "split_counts", "shuffle_rows", "shuffle_table", "permute_vectors", "epoch_batches",
    "global_index", "chunk_ids", "equalize_groups", "packed_last_index",
    "explain_clean", "explain_rejects", "cache_hits", "cache_misses", "cache_hit_rate", "reuse_exact_join",
    "build_av", "build_ar", "build_rl", "recover_roundtrip", "generation_status", "critic_rows",
    "direction_mse", "reward_scores", "fve_baselines", "fve_by_label", "mean_vector", "linear_head",
    "group_advantage", "reward_percentiles", "pick_top_mid_bottom", "report_rows",
    "manifest_merge", "stream_dedup", "stream_score",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", "vectext-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        # The tables here are files of one row group, which one task would read.
        "spark.vectext.inputPartitions": cpus,
    })
    spark.sparkContext.setLogLevel("ERROR")
    use_own_folder(spark)
    from vectext.plans.catalog import QUERIES

    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    cold, warm = {}, {}
    for name in names:
        for times in (cold, warm):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            drop_cuts(spark)
    print(json.dumps({
        "metric": "headline_queries_warm_total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
