"""Record what became of sent notifications.

    python -m telemetry_lake.plans.deliver ROOT RESULTS RUN BATCH

ROOT is the handler's. RESULTS is a folder of JSON rows `alertId, error, sequence`; an error of null
means sent, and of several results for one alert the highest sequence counts. RUN and BATCH name this
delivery, so repeating it replaces its own entries.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from telemetry_lake.plans.streams import handler_paths
from telemetry_lake.session import configure
from telemetry_lake.streaming.handler import record_results

RESULTS = "alertId string, error string, sequence bigint"


def main(args: list[str]) -> None:
    root, results, run, batch = args
    spark = configure(SparkSession.builder.appName("telemetry-deliver").getOrCreate())
    rows = spark.read.schema(RESULTS).json(results)
    record_results(rows, handler_paths(root, ""), run, int(batch), F.current_timestamp())
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
