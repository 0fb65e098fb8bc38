"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose data and cores, BENCH_RUNS the timed runs after one warm-up. The
calibration is a fixed aggregation of made-up numbers, timed before and after the others: machines differ
and change, so times of different runs compare as ratios to it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from harness import bindings, queries  # noqa: E402
from harness.queries import QUERIES  # noqa: E402
from scopelens.plans import monthly, reports  # noqa: E402

#: Queries that keep counts first and report from them; here the counts are kept once, and only reports are timed.
FROM_KEPT = ("r_pack_from_months", "r_category_brand_kept")
HEADLINE = [name for name in QUERIES if name.startswith("r_") and name not in FROM_KEPT]
SCOPE_COUNTS = (1, 10, 100)


def multi_scope(count: int) -> Callable[[SparkSession, str], DataFrame]:
    known, ids = bindings.many_scopes(count)
    return lambda spark, sf_dir: reports.top_subcat2(
        bindings.cases(spark, sf_dir), known.scopes(ids), bindings.START, bindings.END, taxonomy=bindings.TAXONOMY
    )


def from_kept(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    kept, known = queries.kept_months(spark, sf_dir), bindings.monthly_registry()
    scope = known.scope(queries.SCOPE)
    return {
        "pack_from_kept_months": lambda s, d: monthly.pack_from_months(s, kept, known, bindings.PARAMS, bindings.TAXONOMY),
        "category_brand_from_kept_brands": lambda s, d: reports.category_by_brand_long(
            bindings.cases(s, d), scope, bindings.START, bindings.END, taxonomy=bindings.TAXONOMY, brands=kept.brands(s, scope).select("brand")
        ),
    }


def calibration(spark: SparkSession) -> float:
    start = time.perf_counter()
    numbers = spark.range(0, 60_000_000, 1, 8).select(F.xxhash64("id").alias("h"))
    numbers.groupBy(F.col("h") % 1000).agg(F.sum(F.sqrt(F.abs("h")))).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("scopelens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    timed = {name: QUERIES[name] for name in HEADLINE}
    timed |= {f"multi_scope_top_{count}": multi_scope(count) for count in SCOPE_COUNTS}
    timed |= from_kept(spark, sf_dir)
    seconds = {}
    calibration(spark)
    speed = [calibration(spark) for _ in range(3)]
    for name, query in timed.items():
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    speed += [calibration(spark) for _ in range(3)]
    spark.stop()
    unit = statistics.median(speed)

    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "calibration": round(unit, 3),
                "ratios": {name: round(value / unit, 2) for name, value in seconds.items()},
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
