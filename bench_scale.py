"""Time events to history on many copies of ``events``, folded and step by step, and print one JSON line.

BENCH_SF_DIR picks the table, BENCH_COPIES how often it is repeated, each time with other users; BENCH_HOT=1 gives a third
of all events to one user; BENCH_CPUS the local cores. Both forms are run twice in one session, one after the other.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidelog.operators.history import scd2  # noqa: E402
from tidelog.operators.state import block_forward_fill, collapse_days  # noqa: E402
from tidelog.operators.timeline import drop_resent, latest_per_source_day, with_fingerprint  # noqa: E402
from tidelog.plans.history import history_of  # noqa: E402
from tidelog.plans.tables import USER, change_log, table  # noqa: E402
from tidelog.session import get_spark  # noqa: E402


def repeated(spark: SparkSession, sf_dir: str, folder: str, copies: int, hot: bool) -> str:
    """A folder with ``events`` of ``copies`` times as many users."""
    events = table(spark, sf_dir, "events")
    span = events.agg(F.max("user_id")).first()[0] + 1
    other = F.col("user_id") + F.col("copy") * span
    if hot:
        other = F.when(F.col("event_id") % 3 == 0, 0).otherwise(other)
    many = events.crossJoin(F.broadcast(spark.range(copies).toDF("copy"))).withColumn("user_id", other)
    many.select(*events.columns).repartition(16).write.parquet(f"{folder}/events.parquet")
    return folder


def step_by_step(log: DataFrame) -> DataFrame:
    timeline = latest_per_source_day(with_fingerprint(drop_resent(log), USER), USER)
    return scd2(collapse_days(block_forward_fill(timeline, USER), USER), USER)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    copies, hot = int(os.environ.get("BENCH_COPIES", "100")), os.environ.get("BENCH_HOT") == "1"
    settings = {"spark.sql.shuffle.partitions": "32", "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    with tempfile.TemporaryDirectory(prefix="tidelog-scale-") as folder:
        spark = get_spark("scale", master=f"local[{cpus}]", extra=settings)
        spark.sparkContext.setLogLevel("ERROR")
        log = change_log(spark, repeated(spark, sf_dir, folder, copies, hot))
        seconds: dict[str, list[float]] = {"step by step": [], "folded": []}
        for _ in range(2):
            for name, history in (("step by step", step_by_step(log)), ("folded", history_of(log, USER))):
                start = time.perf_counter()
                history.write.format("noop").mode("overwrite").save()
                seconds[name].append(round(time.perf_counter() - start, 1))
        print(json.dumps({"rows": log.count(), "hot": hot, "cpus": int(cpus), "seconds": seconds, "spark": spark.version}))
        spark.stop()


if __name__ == "__main__":
    main()
