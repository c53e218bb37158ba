"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data folder and the number of cores.
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridloom.catalog import base, registered  # noqa: E402
from gridloom.session import local_session  # noqa: E402

HEADLINE = (
    "gct_forward", "grid_from_lineitem", "complexity", "scene_class_ship", "sobel_ship", "gaussian_blur_reflect", "edge_zone",
    "order_statistics", "foveal_factor", "structure_factor", "block_round_trip", "document_entropy", "contexts", "rd_points",
)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g", app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = registered(), {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in HEADLINE:
        start = time.time()
        base.run(queries[name], spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
