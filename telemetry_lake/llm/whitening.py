"""Operator 12: whitening of embeddings with MLlib's BlockMatrix.

Rows are numbered without gaps, centred and laid out as an IndexedRowMatrix, then as blocks of BLOCK_ROWS
rows. The scatter is the transposed blocks times the blocks, summed over slices of rows, so that no task
meets more than MULTIPLIED blocks; only this matrix of dimension times dimension reaches the driver, where
numpy decomposes it. A second multiplication by the whitening matrix projects the rows.

Entries are read as whole numbers x = floor(64 * c) + 1000000, whose sums are exact. A centred
entry is (n * x - sum) / n: the numerator is exact, so nothing is lost to the large offset.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetry_lake.llm.common import stored, table

COMPONENTS = 32
BLOCK_ROWS = 1024
# Blocks of either factor that meet in one task of the scatter.
MULTIPLIED = 8
# A component whose eigenvalue is below this share of the largest is rounding error, not variance.
NEGLIGIBLE = 1e-10
# Fixed values of the whole numbers.
SCALE, OFFSET = 64, 1_000_000

_ROW_BITS = 33


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """`vec_id`, `x` (array<long>) of the rows whose vector is fit to use."""
    entries = F.col("embedding").cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    fit = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return fit.select("vec_id", scaled.alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows of a stored table with `row`, 0 to n-1 without gaps.

    `mark` in the table holds the writing task and the place within it; the tasks' row counts, one
    row for each, are summed up.
    """
    task = F.shiftrightunsigned("mark", _ROW_BITS)
    counts = rows.groupBy(task.alias("task")).agg(F.count("*").alias("rows"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    place = F.col("mark").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return rows.withColumn("task", task).join(F.broadcast(starts), "task").select(
        (F.col("start") + place).alias("row"), "vec_id", "x"
    )


def _literal(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def centred(x: Column, n: int, sums: list[int]) -> Column:
    """(n * x - sum) / n of each entry."""
    return F.zip_with(x, _literal(sums), lambda a, s: (a * n - s).cast("double") / float(n))


def deviation(x: Column, n: int, sums: list[int]) -> Column:
    """Exact sum of (n * x - sum)^2; null where it is beyond a long."""
    whole = "decimal(38,0)"
    squares = F.zip_with(x, _literal(sums), lambda a, s: ((a * n - s).cast("decimal(19,0)") * (a * n - s).cast("decimal(19,0)")))
    total = F.aggregate(squares, F.lit(0).cast(whole), lambda a, b: (a + b).cast(whole))
    return total.try_cast("long")


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """`row`, `values` (array<double>) of n rows as blocks of BLOCK_ROWS rows and all columns."""
    vectors = rows.select(F.col("row").alias("index"), array_to_vector("values").alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, width)
    return indexed.toBlockMatrix(BLOCK_ROWS, width)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transposed matrix times the matrix, on the driver.

    The result is one block, for which a plain multiplication sends all rows to one task; the
    middle dimension is therefore cut, and the tasks' sums are added up.
    """
    slices = -(-matrix.numRows() // (BLOCK_ROWS * MULTIPLIED))
    other = matrix._java_matrix_wrapper._java_model
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", other, max(1, int(slices)))
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def times(matrix: BlockMatrix, right: np.ndarray, spark: SparkSession) -> DataFrame:
    """`row`, `values` of the matrix multiplied by a local matrix of as many rows as it has columns."""
    height, width = right.shape
    block = ((0, 0), DenseMatrix(height, width, right.ravel(order="F").tolist()))
    factor = BlockMatrix(spark.sparkContext.parallelize([block], 1), height, width, height, width)
    product = matrix.multiply(factor).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model).toDF("row", "vector")
    return rows.select("row", vector_to_array("vector").alias("values"))


@dataclass(frozen=True)
class Whitening:
    """Eigenvalues in falling order, unit eigenvectors as columns, and the trace of the covariance."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def decompose(covariance: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """The leading components; those without variance are left out, as nothing can scale them to one."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = [k for k in order if values[k] > NEGLIGIBLE * max(values.max(), 0.0)]
    return Whitening(values[order], vectors[:, order], float(np.trace(covariance)))


SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each fit vector of `vec_id`, `embedding` and each component, numbered from 1.

    Left out are rows whose vector is null, empty or holds a null or non-finite entry, and rows whose vector is not
    as long as most are (of equally frequent lengths the greatest counts). Null and repeated ids stay, equal
    vectors are rows of their own, further columns are not looked at. Components without variance (all of
    them where all vectors are equal, or there is one) have no rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    fit = whole_numbers(vectors).withColumn("width", F.size("x")).withColumn("mark", F.monotonically_increasing_id())
    rows = stored(fit, "whole_numbers")
    widths = rows.groupBy("width").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("width")).take(2)
    if not widths:
        return spark.createDataFrame([], SCHEMA)
    width, n = widths[0]
    if len(widths) > 1:
        rows = stored(rows.where(F.col("width") == width).withColumn("mark", F.monotonically_increasing_id()), "whole_numbers")
    by_place = rows.select(F.posexplode("x").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("sum"))
    sums = [int(r["sum"]) for r in by_place.orderBy("place").collect()]

    x = F.col("x")
    placed = numbered(rows).select("row", "vec_id", centred(x, n, sums).alias("values"), deviation(x, n, sums).alias("deviation"))
    placed = stored(placed, "centred")
    matrix = block_matrix(placed, n, width)
    found = decompose(scatter(matrix) / n, components)
    kept = len(found.values)
    if not kept:
        return spark.createDataFrame([], SCHEMA)

    projected = stored(times(matrix, found.matrix, spark), "whitened")
    means = np.array(projected.agg(*[F.avg(F.col("values")[k]) for k in range(kept)]).first(), float)
    rest = F.zip_with("values", F.array(*map(F.lit, means.tolist())), lambda w, m: w - m)
    covariance = scatter(block_matrix(projected.select("row", rest.alias("values")), n, kept)) / n
    error = float(np.abs(covariance - np.eye(kept)).max())

    explained = F.array(*[F.lit(float(v / found.trace)) for v in found.values])
    each = placed.select("row", "vec_id", "deviation").join(projected, "row")
    return each.select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
