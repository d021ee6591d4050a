"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance V is never built. A Spark pass multiplies it by a block Q of orthonormal columns: each task centres its
rows X and adds up X'(XQ), and tasks' sums are added by dimension. Every block is kept beside its product, so the subspace
grows by a block with each pass; Rayleigh-Ritz within it gives the best pairs, and their residuals, orthonormalised by QR,
are the next block. When the residuals of all components are small, a last pass over just these certifies them anew.

Entries are whole numbers x = floor(1024 c) + 100000. Sums are exact, and rows are centred by the rounded mean first, which
is exact too, so nothing is lost by taking large means from large entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

from hirelake.llm._common import read

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Columns of a block; a block is never narrower than twice the components.
BLOCK = 16
#: Columns of the subspace in the driver; a longer one starts anew from its best vectors.
MOST_BASIS = 1024
MOST_PASSES = 500
#: Norm of a residual, and least eigenvalue of a component, as parts of the greatest eigenvalue.
TOLERANCE, LEAST = 1e-12, 1e-10
#: Rows that a task turns into numbers at a time hold so many entries.
ENTRIES = 1 << 19


@dataclass(frozen=True)
class Whitening:
    """What fit() finds: n rows, exact sums by dimension, unit eigenvectors (columns of directions) by falling eigenvalue,
    the trace of the covariance, how far the whitened rows' covariance is from the identity, and the passes it took."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as the nearest whole numbers and what is left of it."""
        return centre(self.n, self.sums)


def centre(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    whole = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(whole, np.int64), np.array([(s - n * w) / n for s, w in zip(sums, whole, strict=True)])


def whole_numbers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and numbers x of the vectors of a batch that count, for each length among them."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    for length in np.unique(lengths[lengths >= 0]).tolist():
        places = np.flatnonzero(lengths == length)
        step = max(1, ENTRIES // max(1, length))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            values = flat[starts[some][:, None] + np.arange(length)]
            fine = np.isfinite(values).all(axis=1)
            scaled = np.floor(SCALE * values[fine])
            if (np.abs(scaled) > 2.0**52).any():
                raise ValueError("entries of embeddings must stay below 2**42")
            yield some[fine], scaled.astype(np.int64) + SHIFT


def _vectors(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("v"))


def exact_sums(df: DataFrame, column: str) -> tuple[int, tuple[int, ...]]:
    """Number of vectors that count, and their sums by dimension."""

    def add(batches):
        found: dict[int, list[int]] = {}
        for batch in batches:
            for _, x in whole_numbers(batch.column(0)):
                if not len(x):
                    continue
                # 2**52 times the rows of a slice may pass 2**63: high and low halves are added apart.
                high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
                old = found.setdefault(x.shape[1], [0] * (x.shape[1] + 1))
                found[x.shape[1]] = [old[0] + len(x), *(o + (int(h) << 26) + int(l) for o, h, l in zip(old[1:], high, low, strict=True))]
        for length, sums in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([length] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int32()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], names=["length", "i", "s"])

    rows = _vectors(df, column).mapInArrow(add, "length int, i int, s decimal(38,0)").groupBy("length", "i").agg(F.sum("s").alias("s")).collect()
    if len({r["length"] for r in rows}) > 1:
        raise ValueError(f"embeddings have several lengths: {sorted({r['length'] for r in rows})}")
    by_place = sorted((r["i"], int(r["s"])) for r in rows)
    return (by_place[0][1], tuple(s for _, s in by_place[1:])) if by_place else (0, ())


def product(df: DataFrame, column: str, n: int, sums: tuple[int, ...], q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass: the covariance times q, and the variances, over the vectors that count."""
    whole, rest = centre(n, sums)
    names = [f"p{j}" for j in range(q.shape[1])] + ["square"]

    def multiply(batches):
        total, squares = np.zeros(q.shape), np.zeros(len(q))
        for batch in batches:
            for _, x in whole_numbers(batch.column(0)):
                c = (x - whole) - rest
                total += c.T @ (c @ q)
                squares += (c * c).sum(axis=0)
        columns = [pa.array(range(len(q)), pa.int32()), *(pa.array(column) for column in total.T), pa.array(squares)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", *names])

    sums_by_dimension = _vectors(df, column).mapInArrow(multiply, ", ".join(["i int", *(f"{x} double" for x in names)])).groupBy("i").agg(*(F.sum(x).alias(x) for x in names))
    rows = sorted(map(tuple, sums_by_dimension.collect()))
    found = np.array(rows)[:, 1:] / n
    return found[:, :-1], found[:, -1]


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what a block has outside a subspace; directions that are lost in rounding go."""
    block = block / np.maximum(np.linalg.norm(block, axis=0), np.finfo(float).tiny)
    for _ in range(2):  # twice is enough
        block = block - against @ (against.T @ block)
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-10]
    return block - against @ (against.T @ block)


def pairs(basis: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: values falling, vectors, and the vectors' products."""
    small = basis.T @ products
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], basis @ turn, products @ turn


def fit(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", block: int = BLOCK, most_basis: int = MOST_BASIS, most_passes: int = MOST_PASSES, tolerance: float = TOLERANCE, seed: int = 11) -> Whitening:
    """Finds the leading components of the covariance (divisor n) of the vectors that count, read once for each pass.

    Vectors that are null, or hold a null, an infinite or no number, don't count. All others must have one length
    (ValueError). Repeated rows count each time. There are fewer components if the vectors have fewer dimensions, or
    vary in fewer: eigenvalues below LEAST of the greatest give none. Without a vector there is none. Eigenvalues that tie
    leave their vectors free within their space, but the same for all rows. RuntimeError if most_passes aren't enough.

    The driver holds two matrices of a vector's length by most_basis columns at most.
    """
    n, sums = exact_sums(vectors, column)
    d = len(sums)
    k = min(components, d)
    if not k:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 1)
    width = min(d, max(block, 2 * k))
    rng = np.random.default_rng(seed)
    basis = products = np.zeros((d, 0))
    new = orthonormal(rng.standard_normal((d, width)), basis)
    for passes in range(2, most_passes):
        made, variances = product(vectors, column, n, sums, new)
        basis, products = np.hstack([basis, new]), np.hstack([products, made])
        values, best, images = pairs(basis, products)
        top = max(values[0], np.finfo(float).tiny)
        residuals = images[:, :width] - best[:, :width] * values[:width]
        new = np.zeros((d, 0))
        if basis.shape[1] < d and (np.linalg.norm(residuals[:, :k], axis=0) > tolerance * top).any():
            if basis.shape[1] + width > max(most_basis, 4 * width):
                basis, products = best[:, : 2 * width], images[:, : 2 * width]
            new = orthonormal(residuals, basis)
        if not new.shape[1]:
            # Nothing is left to be added: the components alone, without what passes have added up.
            own, _ = np.linalg.qr(best[:, :k])
            made, variances = product(vectors, column, n, sums, own)
            values, best, images = pairs(own, made)
            if (np.linalg.norm(images - best * values, axis=0) <= 100 * tolerance * top).all():
                break
            basis = products = np.zeros((d, 0))
            new = orthonormal(np.hstack([best, images - best * values]), basis)
    else:
        raise RuntimeError(f"components are not certain after {most_passes} passes")
    kept = values > LEAST * top
    values, best, images = values[kept], best[:, kept], images[:, kept]
    scaled = best / np.sqrt(values)
    covariance = scaled.T @ (images / np.sqrt(values))
    error = np.abs(covariance - np.eye(len(values))).max(initial=0.0)
    return Whitening(n, sums, best, values, float(variances.sum()), float(error), passes + 1)


def deviations(moved: np.ndarray, n: int, gaps: np.ndarray) -> np.ndarray | list[Decimal]:
    """Sums over dimensions of (n * moved - gaps)**2, exact: in whole numbers of the machine if these suffice."""
    most = n * int(np.abs(moved).max(initial=0)) + int(np.abs(gaps).max(initial=0))
    if most**2 * max(1, len(gaps)) < 1 << 63:
        return ((n * moved - gaps) ** 2).sum(axis=1)
    return [Decimal(int(v)) for v in ((n * moved.astype(object) - gaps.astype(object)) ** 2).sum(axis=1)]


def whiten(vectors: DataFrame, model: Whitening, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Each vector that counts, under its id: n, deviation (decimal; sum over dimensions of (n x - S)**2, exact) and
    whitened (an array with an entry for each component). Other columns are ignored, whatever their names; a null id
    stays null, and repeated rows give repeated results. A vector of another length than the model's is an error."""
    key = vectors.schema[id_column]
    schema = StructType([StructField("id", key.dataType), StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))])
    n, d = model.n, len(model.sums)
    sums = model.sums

    def run(batches):
        whole, rest = model.centre()
        gaps = np.array([s - n * int(w) for s, w in zip(sums, whole, strict=True)])
        scaled = model.directions / np.sqrt(model.eigenvalues)
        for batch in batches:
            ids = batch.column(0)
            for places, x in whole_numbers(batch.column(1)):
                if not len(x):
                    continue
                if x.shape[1] != d:
                    raise ValueError(f"an embedding has {x.shape[1]} entries instead of {d}")
                white = ((x - whole) - rest) @ scaled
                deviation = pa.array(deviations(x - whole, n, gaps)).cast(pa.decimal128(38, 0))
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(places)), deviation, pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))], names=["id", "deviation", "whitened"])

    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).alias("v")).mapInArrow(run, schema)
    return rows.select(F.col("id").alias(id_column), F.lit(n).cast("long").alias("n"), "deviation", "whitened")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on its leading eight whitened components, a row for each."""
    vectors = read(spark, sf_dir, "embeddings")
    model = fit(vectors)
    explained = F.array(*map(F.lit, (model.eigenvalues / (model.trace or 1.0)).tolist())) if len(model.eigenvalues) else F.array().cast("array<double>")
    rows = whiten(vectors, model).select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
