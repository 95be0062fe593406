"""The four questions over gold, each saved as JSON.

    python -m telemetry_lake.plans.analytics GOLD STATS
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from telemetry_lake.operators.questions import QUESTIONS, ordering, report_preview
from telemetry_lake.schemas import GOLD
from telemetry_lake.session import configure
from telemetry_lake.sources.lake import read_layer, read_statistics, write_statistics


def answer_all(gold: DataFrame, stats_path: str) -> dict[str, DataFrame]:
    """Compute and save every answer once; what is returned reads the saved files, in the answer's order."""
    spark = gold.sparkSession
    saved = {}
    for name, question in QUESTIONS.items():
        answer = question(gold)
        path = f"{stats_path}/{name}"
        write_statistics(answer, path)
        saved[name] = read_statistics(spark, path, answer.schema).orderBy(*ordering(name))
    return saved


def main(args: list[str]) -> None:
    gold_path, stats_path = args
    spark = configure(SparkSession.builder.appName("telemetry-analytics").getOrCreate())
    for name, answer in answer_all(read_layer(spark, gold_path, GOLD), stats_path).items():
        print(f"[analytics] {name}")
        report_preview(answer).show(truncate=False)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
