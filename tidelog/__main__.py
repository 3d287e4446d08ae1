"""Build the layers of the purchase model below a base path: ``python -m tidelog --base <uri>``.

Steps can be run one at a time, each from the table the step before it has written.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import SparkSession

from tidelog.config import PURCHASE
from tidelog.plans.layers import Layers, build_daily, build_history, build_timeline, ingest
from tidelog.session import get_spark

Step = Callable[[SparkSession, Layers], dict[str, dict[str, int]]]
STEPS: dict[str, Step] = {
    "bronze": ingest,
    "timeline": build_timeline,
    "daily": build_daily,
    "history": build_history,
}


def main(arguments: list[str] | None = None) -> dict[str, dict[str, int]]:
    parser = argparse.ArgumentParser(prog="tidelog", description=__doc__)
    parser.add_argument("--base", required=True, help="folder that holds raw/<feed>")
    parser.add_argument("--step", choices=[*STEPS, "all"], default="all")
    chosen = parser.parse_args(arguments)
    spark = get_spark(chosen.step)
    layers = Layers(chosen.base.rstrip("/"), PURCHASE)
    counts: dict[str, dict[str, int]] = {}
    for name in STEPS if chosen.step == "all" else [chosen.step]:
        for table, got in STEPS[name](spark, layers).items():
            counts[table] = got
            print(table, *[f"{what}={number}" for what, number in got.items()], flush=True)
    return counts


if __name__ == "__main__":
    main()
