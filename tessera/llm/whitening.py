"""Whitening of embedding vectors by distributed block matrices.

Entries become integers, rows get numbers and are centred exactly (n times the entry less the column's sum, an integer, and
only then divided), so that no digits are lost to a large mean. Spark's BlockMatrix holds the centred rows; its transposed
product with itself is the scatter matrix, whose row blocks are multiplied in many tasks and added up. The driver holds
that matrix (dimensions squared), takes its eigenvectors, and a second block product projects all rows. A third one, of
the projected rows with a column of ones, tells how far their covariance is from the identity.

Defined results: vectors that are null, empty or hold null or non-finite entries have no rows, nor have those of another
length than the most frequent one (the longer of equally frequent ones); components whose variance is below 10^-11 of
the largest can't be told from rounding and have no rows, so equal vectors, a single one and an empty table give an empty
result; 64 times an entry is cut at 2^52 on either side; a deviation beyond 64 bits is null; ties among eigenvalues are
ordered as the solver gives them; a null id is kept, repeated rows count and come each time; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import numbered, pick
from tessera.runtime import stage

SHIFT = 1_000_000
MOST = float(1 << 52)
#: Least share of the largest variance that a component has.
LEAST_SHARE = 1e-11
#: Rows and columns of a block at least (columns: at most), blocks that the driver may list, and bytes of a block at most.
BLOCK = 1024
BLOCKS = 20_000
BLOCK_BYTES = 32 << 20


@dataclass(frozen=True)
class Fit:
    """n, each dimension's sum, all falling variances along the components, their trace and the whitening matrix."""

    n: int
    sums: list[int]
    variances: np.ndarray
    trace: float
    matrix: np.ndarray


def _integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x array<long> of the vectors that take part."""
    slim = pick(vectors, vec_id=id_col, v=F.col(vector_col).cast("array<double>"))
    sound = slim.filter(F.size("v") > 0).filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    cut = lambda c: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), 64 * c))).cast("long") + SHIFT
    whole = sound.select("vec_id", F.transform("v", cut).alias("x"))
    usual = whole.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return whole.filter(F.size("x") == (usual.dim if usual else 0))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column)
    flat = values.flatten().to_numpy()
    return flat.reshape(len(values), -1)


def _column_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sums of the entries, added up in halves that 64 bits hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, "x")
                n, high, low = n + len(x), high + (x >> 26).sum(0), low + (x & ((1 << 26) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(high), dtype=np.int32)), "n": pa.array(np.full(len(high), n)), "high": pa.array(high), "low": pa.array(low)})

    partial = rows.select("x").mapInArrow(run, "at int, n long, high long, low long")
    found = partial.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("at").collect()
    return (found[0].n if found else 0), [(r.high << 26) + r.low for r in found]


def _centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """_row, vec_id, deviation and centred array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, "x")
            largest = n * int(np.abs(x).max()) + max(map(abs, sums))
            d = x * n - np.array(sums) if largest < 1 << 62 else x.astype(object) * n - np.array(sums, object)
            most = int(np.abs(d).max())
            squares = (d * d).sum(1) if len(sums) * most * most < 1 << 63 else (d.astype(object) ** 2).sum(1)
            deviation = [int(v) if v < 1 << 63 else None for v in squares.tolist()]
            flat = (d / n).astype(np.float64).ravel()
            ends = np.arange(len(x) + 1, dtype=np.int32) * len(sums)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("vec_id"), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["_row", "vec_id", "deviation", "centred"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row long, vec_id {kind}, deviation long, centred array<double>")


def _blocks(rows: DataFrame, index: str, values, n: int, dim: int) -> BlockMatrix:
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col(index).alias("index"), array_to_vector(values).alias("vector")), "vector")
    width = min(dim, BLOCK)
    height = min(max(BLOCK, math.ceil(n / BLOCKS)), max(1, BLOCK_BYTES // (8 * width)))
    return IndexedRowMatrix(vectors, n, dim).toBlockMatrix(height, width)


def _scatter(a: BlockMatrix) -> np.ndarray:
    """The transposed product of a tall matrix with itself; its row blocks are multiplied apart, a few in a task."""
    apart = max(1, a.numRowBlocks // 4)
    product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, apart)
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def _local(spark, m: np.ndarray, height: int, width: int) -> BlockMatrix:
    cut = [((i, j), m[i * height : (i + 1) * height, j * width : (j + 1) * width]) for i in range(math.ceil(m.shape[0] / height)) for j in range(math.ceil(m.shape[1] / width))]
    return BlockMatrix(spark.sparkContext.parallelize([(at, Matrices.dense(*b.shape, b.ravel(order="F"))) for at, b in cut], 1), height, width, *m.shape)


def fitted(n: int, sums: list[int], scatter: np.ndarray, components: int) -> Fit:
    """Eigenvectors by falling eigenvalue, each over the root of its own."""
    variances, vectors = np.linalg.eigh(scatter / n)
    order = np.argsort(-variances, kind="stable")
    variances, vectors = variances[order], vectors[:, order]
    kept = int((variances[:components] > max(variances[0], 0) * LEAST_SHARE).sum())
    return Fit(n, sums, variances[:kept], float(np.trace(scatter)) / n, vectors[:, :kept] / np.sqrt(variances[:kept]))


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Fit | None]:
    """vec_id, deviation and whitened array<double> of every row that takes part, and the fit; None without components."""
    spark = vectors.sparkSession
    rows = numbered(_integers(vectors, id_col, vector_col), [F.col("vec_id")], "_row")
    n, sums = _column_sums(rows)
    kind = vectors.schema[id_col].dataType.simpleString()
    nothing = spark.createDataFrame([], f"vec_id {kind}, deviation long, whitened array<double>")
    if n < 2:
        return nothing, None
    centred = stage(_centred(rows, n, sums), "whitening-centred")
    a = _blocks(centred, "_row", F.col("centred"), n, len(sums))
    fit = fitted(n, sums, _scatter(a), components)
    if not len(fit.variances):
        return nothing, None
    product = a.multiply(_local(spark, fit.matrix, a.colsPerBlock, min(BLOCK, fit.matrix.shape[1])))
    projected = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    placed = projected.select(F.col("index").alias("_row"), vector_to_array("vector").alias("whitened"))
    out = centred.select("_row", "vec_id", "deviation").join(placed, "_row")
    return stage(out, "whitening-rows"), fit


def identity_error(rows: DataFrame, n: int, components: int) -> float:
    """The largest absolute entry of the covariance of `whitened` less the identity."""
    numbers = _blocks(rows, "_row", F.concat("whitened", F.array(F.lit(1.0))), n, components + 1)
    product = _scatter(numbers)
    means = product[-1, :-1] / n
    return float(np.abs(product[:-1, :-1] / n - np.outer(means, means) - np.eye(components)).max())


def op12_whitened_embeddings(spark, sf_dir: str) -> DataFrame:
    rows, fit = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    k = len(fit.variances) if fit else 0
    error = identity_error(rows, fit.n, k) if fit else 0.0
    shares = [float(v / fit.trace) for v in fit.variances] if fit else []
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, shares)), F.col("_at") + 1) if fit else F.lit(0.0)
    n = F.lit(fit.n if fit else 0).cast("long")
    return each.select("vec_id", (F.col("_at") + 1).cast("int").alias("component"), n.alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
