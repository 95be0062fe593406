"""Bronze to silver to gold.

    python -m telemetry_lake.plans.datalake BRONZE SILVER GOLD [RECORDS]

BRONZE is a landed folder, or `objects:FOLDER` for one object per record. RECORDS bounds the records taken; text
that is no number is no bound.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from telemetry_lake.operators.gold import to_gold
from telemetry_lake.operators.silver import parse_text_readings, to_silver
from telemetry_lake.schemas import GOLD, SILVER, AlertRules
from telemetry_lake.session import configure
from telemetry_lake.sources.bronze import bound_of, first_records, read_bronze
from telemetry_lake.sources.lake import read_layer, write_layer


def build_layers(
    bronze: DataFrame, silver_path: str, gold_path: str, rules: AlertRules = AlertRules()
) -> tuple[DataFrame, DataFrame]:
    """Write both layers and return them as read back.

    Bronze is parsed once: gold starts from the written silver, and every later read is
    columnar. Both layers are replaced as a whole.
    """
    spark = bronze.sparkSession
    write_layer(to_silver(parse_text_readings(bronze), rules), silver_path)
    silver = read_layer(spark, silver_path, SILVER)
    write_layer(to_gold(silver), gold_path)
    return silver, read_layer(spark, gold_path, GOLD)


def layer_counts(bronze: DataFrame, silver: DataFrame, gold: DataFrame) -> dict[str, int]:
    """Rows per layer. Unlike metrics gathered while writing, the counts hold when a task ran twice. Layers
    in Parquet answer from their footers; bounded bronze counts its offsets again."""
    return {"bronze": bronze.count(), "silver": silver.count(), "gold": gold.count()}


def main(args: list[str]) -> None:
    bronze_path, silver_path, gold_path, *bound = args
    spark = configure(SparkSession.builder.appName("telemetry-datalake").getOrCreate())
    bronze = first_records(read_bronze(spark, bronze_path), bound_of(bound[0] if bound else None))
    silver, gold = build_layers(bronze, silver_path, gold_path)
    print("[datalake]", layer_counts(bronze, silver, gold))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
