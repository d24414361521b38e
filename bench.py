"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from heliospark.catalog import registered  # noqa: E402
from heliospark.session import local_session  # noqa: E402

HEADLINE = (
    "index_map",
    "tricubic",
    "tricubic_gradient",
    "tricubic_skip_nan",
    "sample_density",
    "boundary_lookup",
    "knn_join",
    "mls_fit",
    "boundary_map",
    "paint_accumulate",
    "render_los",
    "render_finish",
    "los_brightness",
    "vignette_newkirk",
    "ring_medians",
    "splat_segments",
    "qmap_slice",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=2 * int(cpus) if cpus.isdigit() else 16)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()[0]
    wanted = sys.argv[1:] or HEADLINE
    queries["julian_date"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}
        )
    )


if __name__ == "__main__":
    main()
