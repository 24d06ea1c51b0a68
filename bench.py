"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [NAME-PREFIX ...]

Every query runs once to warm up and then BENCH_RUNS times (default 3); its number is the
median.  Results are consumed in full through the ``noop`` sink, without collecting.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "mon1_psi_numeric", "mon1_psi_sketch_edges", "mon2_ks", "mon3_wasserstein", "mon4_missingness", "mon5_out_of_range",
    "mon6_prediction_shift", "mon7_psi_categorical", "mon8_data_quality", "mon11_concept_evidence", "mon13_annual_shift",
    "mon14_subgroup_psi", "rel1_confusion", "rel2_class_metrics", "rel3_auroc", "rel4_auprc", "rel5_ece", "rel6_brier",
    "rel7_attach_labels", "rel9_degradation", "ing4_age_from_dates", "ing5_coverage", "ing6_linkage", "lab1_indicator_overlap",
    "lab5_leakage_report", "adp1_temperature", "ver2_gate", "ver3_active_version", "inj10_manifest", "exp7_ranking",
    "cf2_counterfactuals", "cf3_feasible_paths", "cf4_top_recommendations", "fc1_burden", "fc3_forecast", "str1_stream_monitor",
]


def main() -> None:
    from steadfold.plans import queries
    from steadfold.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 1)))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = sys.argv[1:]
    every = queries()
    names = [n for n in every if any(n.startswith(w) for w in wanted)] if wanted else HEADLINE
    spark = local_session(cpus, "steadfold-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    times: dict[str, float] = {}
    for name in names:
        samples = []
        for i in range(runs + 1):
            start = time.perf_counter()
            every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                samples.append(time.perf_counter() - start)
        times[name] = round(statistics.median(samples), 3)
        print(f"{times[name]:8.3f}  {name}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds, median run of each headline query", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
