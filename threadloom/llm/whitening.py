"""Embedding whitening with MLlib's BlockMatrix.

Vectors become whole numbers on a grid, so that their sums and the distances from the
mean are exact.  Centred rows get dense indices and go into distributed blocks; the
transposed matrix times itself is the scatter, whose eigenvectors are found locally (it
is dims x dims, whatever the number of rows); the blocks times the whitening matrix
are the projected rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import own_names, shared_table

#: Grid of the entries: floor(GRID * c) + SHIFT.
GRID, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows of a block: with 64 columns, half a megabyte of doubles.
BLOCK_ROWS = 1024
#: An eigenvalue below this part of their sum is rounding: its direction has no spread.
LEAST_PART = 1e-12
MADE = "n long, component int, deviation decimal(38,0), whitened double, explained double, identity_error double"


def on_grid(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector can be used, with whole numbers ``_x`` for its entries.

    Null vectors, those with null or non-finite entries, empty ones, and those of another
    length than most are left out.
    """
    c = F.col(f"`{vector}`").cast("array<double>")
    sound = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = rows.where(F.coalesce(sound, F.lit(False))).withColumn("_x", F.transform(c, lambda v: F.floor(v * GRID) + SHIFT))
    lengths = usable.groupBy(F.size("_x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims"))
    most = lengths.first()
    return usable.where(F.size("_x") == (most["dims"] if most else 0))


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """Dense numbers from 0, without a shuffle of the rows.

    ``_id`` is monotonically_increasing_id() as written: its upper bits are the task that
    wrote the row, of which there is one summary row each, and the lower ones its place there.
    """
    part = F.shiftright("_id", 33)
    placed = rows.withColumn("_part", part)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.shiftleft("_part", 33)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_id") + F.col("_offset")).drop("_id", "_part", "_offset")


def blocks_of(rows: DataFrame, n: int, dims: int, block_rows: int) -> BlockMatrix:
    """``rows`` (index, vector) as a matrix of blocks."""
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "vector"), n, dims)
    return matrix.toBlockMatrix(block_rows, dims)


def scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """Transposed matrix times matrix, its products summed by ``splits`` tasks first.

    The product is one block; without splits all blocks would meet in one task.
    """
    other = matrix._java_matrix_wrapper._java_model
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", other, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def components_of(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > LEAST_PART * np.trace(v)]
    return values[order], vectors[:, order]


def identity_error(projected: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``z`` (an array of k) less the identity."""
    n, *means = projected.agg(F.count(F.lit(1)), *[F.avg(F.get("z", F.lit(i))) for i in range(k)]).first()
    centred = [F.get("z", F.lit(i)) - F.lit(means[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = projected.agg(*[F.sum(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(s / n - (i == j)) for s, (i, j) in zip(sums, pairs))


@own_names
def whiten(
    rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """A row for each usable row of ``rows`` and component: all its columns and
    component, n, deviation, whitened, explained, identity_error.

    A vector's entries become floor(1024 c) + 100000.  Components are the unit
    eigenvectors of their covariance (divisor n) by falling eigenvalue e, numbered from
    1; whitened is the centred row projected on it over sqrt(e), explained e's part of
    the trace, deviation the exact sum of (n x - S)^2 with the sums S, a decimal.
    identity_error, one value for all, tells how far the covariance of whitened is from
    the identity.

    Rows whose vector is null, empty, has null or non-finite entries or not the length
    of most (of equally frequent lengths, the larger) are left out.  Other columns may hold
    nulls; equal ids and equal rows count each.  Directions without spread (e below
    1e-12 of the trace) are no components: of rows that are all equal, and of an empty
    table, the result is empty.  Columns of the new names give way.  The driver holds dims
    x dims numbers, blocks ``block_rows`` x dims.
    """
    names = [f.strip().split()[0] for f in MADE.split(",") if " " in f.strip()]
    rest = rows.drop(*[c for c in names if c != vector])
    kept = rest.columns
    table = shared_table(on_grid(rest, vector).withColumn("_id", F.monotonically_increasing_id()), "on-grid")
    sums = {r.d: (r.s, r.n) for r in table.select(F.posexplode("_x").alias("d", "x")).groupBy("d").agg(F.sum("x").alias("s"), F.count("x").alias("n")).collect()}
    dims = len(sums)
    empty = table.select(*[f"`{c}`" for c in kept], *[F.lit(None).cast(t).alias(c) for c, t in zip(names, ("long", "int", "decimal(38,0)", "double", "double", "double"))]).limit(0)
    if not dims:
        return empty
    n = sums[0][1]
    total = F.lit(np.array([sums[d][0] for d in range(dims)]).tolist())
    wide = lambda c: c.cast("decimal(19,0)")
    centred = F.zip_with("_x", total, lambda x, s: n * x - s)
    indexed = shared_table(
        numbered(table, "_row")
        .withColumn("_centred", centred)
        .withColumn("deviation", F.aggregate("_centred", F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + wide(d) * wide(d)).cast("decimal(38,0)")))
        .withColumn("_centred", F.transform("_centred", lambda d: d / F.lit(float(n)))),
        "centred",
    )
    matrix = blocks_of(indexed.select(F.col("_row").alias("index"), array_to_vector("_centred").alias("vector")), n, dims, block_rows)
    splits = max(1, min(-(-n // block_rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    v = scatter(matrix, splits) / n
    e, u = components_of(v, components)
    if not len(e):
        return empty
    whitening = u / np.sqrt(e)
    sc = rows.sparkSession.sparkContext
    right = BlockMatrix(sc.parallelize([((0, 0), Matrices.dense(dims, len(e), whitening.ravel(order="F")))], 1), dims, len(e), dims, len(e))
    product = matrix.multiply(right).toIndexedRowMatrix()
    back = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    z = vector_to_array(F.col("vector"))
    projected = shared_table(back.select(F.col("index").alias("_row"), z.alias("z")), "projected")
    error = identity_error(projected, len(e))
    explained = F.lit((e / np.trace(v)).tolist())
    return (
        indexed.join(projected, "_row")
        .select(*[f"`{c}`" for c in kept], "deviation", F.posexplode("z").alias("_at", "whitened"))
        .select(
            *[f"`{c}`" for c in kept],
            F.lit(n).cast("long").alias("n"),
            (F.col("_at") + 1).alias("component"),
            "deviation",
            "whitened",
            F.get(explained, F.col("_at")).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
