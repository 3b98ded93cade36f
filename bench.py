"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from check import make_session
from uttermark.plans import QUERIES
from uttermark.session import clear_scratch

HEADLINE = [
    "contamination_report",
    "d1_exact_match_rate",
    "e4_ngram_jaccard",
    "d8_max_rouge_l",
    "d9_max_bleu4",
    "e2_language_table",
    "e3_length_stats",
    "e8_duplicate_texts",
    "e11_prf_by_class",
    "e12_span_f1",
    "e15_group_error_spread",
    "e16_eta_squared",
    "e17_within_group_effect",
    "e18_centroid_similarity",
    "e19_build_vocab",
    "e24_inventory_stats",
    "e33_time_features",
    "f1_bio_spans",
    "f3_pick_diverse",
    "f4_pick_until",
    "d3_diff_inventory",
    "d10_bag_match",
    "d12_coverage_by_group",
    "j1_group_split_cut",
    "j5_stratified_kfold",
    "j9_ratio_sweep",
    "k3_fill_quota",
    "k7_expand_coverage",
    "l1_slots_to_bio",
    "l3_project_slots",
    "l7_bio_to_chunks",
    "n1_intent_sweep",
    "a1_read_bio",
]


def main(names):
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = make_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.read.parquet(os.path.join(folder, "nation.parquet")).count()  # start the session
    times = {}
    for name in names:
        t0 = time.time()
        # Every row and column is computed, none is sent to the driver.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    clear_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINE)
