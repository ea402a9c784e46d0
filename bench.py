"""Times the headline queries: one JSON line with the seconds of each, after a warm-up."""

import json
import os
import statistics
import time

from lathework import catalog
from pyspark.sql import SparkSession

HEADLINES = ["ranked_bar", "time_axis", "worksheet_totals", "fixed_level", "table_calculations", "element_search", "snapshot_diff", "structure_groups", "crossed_bands", "rolling_spend", "last_view_as_of", "points_in_boxes", "inherited_style", "page_clusters", "near_rectangles", "secret_findings", "undo_log", "consumed_blocks"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        seconds = []
        for _ in range(4):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        took[name] = round(statistics.median(seconds[1:]), 3)
    print(json.dumps({"metric": "sum of median seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
