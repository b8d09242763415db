"""Headline queries, timed. Prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from arealis.plans.catalogue import QUERIES  # noqa: E402
from arealis.session import local_session  # noqa: E402

HEADLINE = ("spine_index", "weighted_prevalence", "nutrition_estimates", "diet_and_controls", "unit_price_summary",
            "latest_year_totals", "shannon_mix", "budget_rollup", "descriptives", "latest_per_group", "forward_fill",
            "depth_mean", "rain_features", "index_variants", "rank_correlations", "policy_summary", "join_coverage",
            "ledger_upsert", "anchor_check", "longest_key_prefix", "two_tier_crops", "points_in_areas", "nearest_area",
            "zonal_mean", "queen_contiguity", "moran_of_regions", "ols_two_regressors", "nutrient_supply",
            "child_growth_model")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["weighted_mean"](spark, folder).collect()  # start the session
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
