"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import time

from gridloom.catalog import QUERIES
from gridloom.catalog.base import Inputs
from gridloom.session import local_session

HEADLINE = [
    "e1_index_by_label",
    "a5_median_composite",
    "a6_annual_medoid",
    "a7_monthly_medoid",
    "a9_quarterly_median",
    "g3_chunk_filter",
    "g7_rasterise",
    "g8_label_cube",
    "a2_band_stats_in_chunks",
    "a13_running_mean",
    "g17_overlapping_patchify",
    "g18_fold_mosaic",
    "p12_apply_mask",
    "a15_binary_scores",
    "a20_ssim_uniform",
    "a20_ssim_gaussian",
    "a21_soft_overlap_by_class",
    "a22_pixel_losses",
    "a29_kernel_density",
    "j3_first_match",
    "j6_samples_imagery_labels",
    "j9_model_pairs",
    "w1_sliding_windows",
    "w9_second_difference",
    "q1_epoch_sample",
    "q3_batches",
    "f8_vector_distances",
    "m3_score_and_mosaic",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), app="bench")
    # class loading and code generation are paid once, outside the clock
    warm = Inputs(spark, folder)
    warm.cube.write.format("noop").mode("overwrite").save()
    only = os.environ.get("BENCH_ONLY")
    times: dict[str, float] = {}
    for name in only.split(",") if only else HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
