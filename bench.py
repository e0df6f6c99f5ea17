"""Time the staging job and the marts; prints one JSON line.

``BENCH_SF_DIR`` names the folder of the source tables, ``BENCH_CPUS`` the
number of local cores. Each query runs twice into a sink that discards the
rows; the second run counts. The same is done on the smaller ``SMALL`` tables. ``from_raw_*`` plans everything from the source
tables, ``stage`` writes the star schema, ``mart_*`` reads the written star.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from mercato.catalog import REGISTRY, runner
from mercato.operators.durable import delete_path, new_path
from mercato.plans.warehouse import Warehouse
from mercato.session import build_session
from mercato.sources.retail import RANGE_END, RANGE_START, RetailTables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2
SMALL = "sf0.01"
FROM_RAW = (
    "fct_sales",
    "monthly_growth",
    "executive_summary",
    "customer_journey",
    "unit_economics",
    "strategic_risk_map",
)


def consume(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    seconds = 0.0
    for _ in range(RUNS):
        begin = time.perf_counter()
        action()
        seconds = time.perf_counter() - begin
    return round(seconds, 3)


def main() -> None:
    spark = build_session(
        "mercato-bench",
        master=f"local[{CPUS}]",
        shuffle_partitions=int(CPUS) if CPUS.isdigit() else None,
        extra={
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    seconds = measured(spark, SF_DIR)
    # A second, smaller size shows how the times grow.
    small_dir = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), SMALL)
    small = measured(spark, small_dir) if os.path.isdir(small_dir) and SMALL not in SF_DIR.split("/") else {}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of staging and marts",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "small_sf": SMALL.removeprefix("sf"),
                "small_queries": small,
                "times_small": {name: round(seconds[name] / small[name], 2) for name in small},
            }
        )
    )


def measured(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    def stage() -> str:
        folder = new_path(spark, "bench")
        with Warehouse.from_raw(
            RetailTables(spark, sf_dir), start=RANGE_START, end=RANGE_END
        ) as warehouse:
            warehouse.stage(folder)
        return folder

    def mart(name: str) -> None:
        # A fresh warehouse each time, so that nothing planned is kept.
        with Warehouse.from_staged(
            spark, folder, durable=True, start=RANGE_START, end=RANGE_END
        ) as warehouse:
            consume(getattr(warehouse, name))

    seconds = {"stage": timed(stage)}
    folder = stage()
    for name in (*Warehouse.MARTS, "monthly_growth_diff"):
        seconds[f"mart_{name}"] = timed(lambda: mart(name))
    for name in FROM_RAW:
        query = runner(REGISTRY[name])
        seconds[f"from_raw_{name}"] = timed(lambda: consume(query(spark, sf_dir)))
    delete_path(spark, folder)
    return seconds


if __name__ == "__main__":
    main()
