"""Parts of a table that are looked up by a key: sorted by its hash, with a Bloom filter each.

A part holds its rows in folders `bucket=k`, equal stretches of the key's hash with some BUCKET_ROWS rows each,
sorted by it. Beside them lies a filter: the hash also names a block of 2^15 bits, in which each key sets
HASHES bits; a block is meant for BLOCK_KEYS keys. A lookup asks the filters first, and opens only the buckets
that may hold a wanted key. A key that is not there passes a filter about once in a thousand times, so a
batch of new keys opens next to nothing however long the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from telemetry_lake.sources.commits import read_kind

BUCKET_ROWS = 1 << 20
BLOCK_KEYS = 2048
HASHES = 6
# Fixed value: the bits of one bitmap of Spark's bitmap functions.
BLOCK_BITS = 1 << 15
_FILTER = StructType([StructField("part", StringType()), StructField("block", IntegerType()), StructField("bits", BinaryType())])


def _bits(count: int, each: int) -> int:
    """Leading bits of the hash that cut `count` rows into stretches of `each` or fewer, on average."""
    return max(0, -(-count // each) - 1).bit_length()


def _leading(h: Column, bits: Column | int) -> Column:
    """The leading bits of a 64-bit hash as a number; no bits give 0."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    # Two steps, because a shift by 64 is a shift by 0.
    return F.call_function("shiftrightunsigned", F.shiftrightunsigned(h, 1), 63 - bits).cast("int")


def _places(key: str) -> Column:
    """The bits of a key within its block."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), key), F.lit(BLOCK_BITS)) for k in range(HASHES)])


def write_part(rows: DataFrame, table: str, name: str, key: str, schema: StructType) -> dict:
    """Write a part's rows, columns of `schema`, and its filter. `rows` is counted before it is dealt out: give a table."""
    spark = rows.sparkSession
    count = rows.count()
    buckets, blocks = _bits(count, BUCKET_ROWS), _bits(count, BLOCK_KEYS)
    place = f"part={name}"
    dealt = rows.select(*schema.names, F.xxhash64(key).alias("_hash")).withColumn("bucket", _leading(F.col("_hash"), buckets))
    ranges = dealt.repartitionByRange(2**buckets, "bucket", "_hash").sortWithinPartitions("bucket", "_hash")
    ranges.write.partitionBy("bucket").parquet(f"{table}/rows/{place}")

    hashes = spark.read.schema("_hash long, " + f"{key} string").parquet(f"{table}/rows/{place}")
    keys = hashes.select(_leading(F.col("_hash"), blocks).alias("block"), F.explode(_places(key)).alias("place"))
    bitmaps = keys.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
    bitmaps.write.parquet(f"{table}/filter/{place}")
    return {"kinds": ["rows", "filter"], "rows": count, "buckets": buckets, "blocks": blocks}


def _hit(bits: Column, place: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place % 8) == 1


def buckets_to_open(spark: SparkSession, table: str, parts: tuple[dict, ...], keys: DataFrame, key: str) -> list[tuple[str, int]]:
    """The (part, bucket) pairs that may hold one of the keys; at most as many as the table has folders."""
    if not parts:
        return []
    live = F.array(
        *[F.struct(F.lit(p["name"]).alias("part"), F.lit(p["buckets"]).alias("buckets"), F.lit(p["blocks"]).alias("blocks")) for p in parts]
    )
    filters = read_kind(spark, table, "filter", parts, _FILTER)
    # One row per key and live part; merging keeps the parts few.
    wanted = keys.select(F.xxhash64(key).alias("hash"), _places(key).alias("places"), F.inline(live))
    asked = wanted.withColumn("block", _leading(F.col("hash"), F.col("blocks")))
    found = asked.join(filters, ["part", "block"]).where(F.forall("places", lambda place: _hit(F.col("bits"), place)))
    pairs = found.select("part", _leading(F.col("hash"), F.col("buckets")).alias("bucket")).distinct()
    return [(r["part"], r["bucket"]) for r in pairs.collect()]


def lookup(
    spark: SparkSession, table: str, parts: tuple[dict, ...], keys: DataFrame, key: str, schema: StructType
) -> DataFrame:
    """The rows of all parts whose key is among `keys` (one row for each). Only buckets that may hold one are read."""
    folders = [
        f"{table}/rows/part={part}/bucket={bucket}"
        for part, bucket in buckets_to_open(spark, table, parts, keys, key)
    ]
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{table}/rows").parquet(*folders)
    return rows.join(keys.select(key), key, "left_semi").select(*schema.names)


def read_parts(spark: SparkSession, table: str, parts: tuple[dict, ...], schema: StructType) -> DataFrame:
    """All rows of the parts."""
    return read_kind(spark, table, "rows", parts, schema).select(*schema.names)
