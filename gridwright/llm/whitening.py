"""Whitening of embeddings by LOBPCG.

Vectors become whole numbers, x = floor(256 * c), and each different one is fitted once. The leading
eigenvectors of their covariance are found by LOBPCG: one pass over the rows multiplies the covariance
with a block of directions (each row is centred first, and the covariance itself is never formed), and
Rayleigh-Ritz on the iterate, residual and previous direction blocks gives the next iterate. It ends
when a fresh product certifies the residuals; only then rows are whitened. What comes back from a pass
is one number for each dimension and direction, summed by Spark.

Defined results: rows whose vector is null or has a null, NaN or infinite entry are dropped; a vector
shorter than the longest has zeros at its end; equal vectors are fitted once and whitened alike, whatever
their ids, and repeated or null ids are kept; eigenvectors have their largest entry positive (equal
eigenvalues: any basis); components whose eigenvalue is zero cannot be whitened and give no rows, so fewer
than five different vectors, or dimensions, give fewer components and one vector gives none; numbers that pass
a long are an error; other columns, of any name, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, materialise, read_table, release

COMPONENTS = 4
#: Directions carried beyond the wanted ones; they speed the wanted ones up.
GUARDS = 6
#: Certified residuals, as a share of the largest eigenvalue; iterations go on while they still fall.
TOLERANCE, STALLED = 1e-11, 3
ROUNDS = 1000


def whole_vectors(rows: DataFrame, column: str) -> DataFrame:
    """Rows with x, the vector in 256ths as whole numbers; rows without a finite vector are dropped."""
    c = F.col(column)
    finite = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))  # NaN is above infinity
    return rows.filter(F.coalesce(finite, F.lit(False))).withColumn("x", F.transform(c, lambda v: F.floor(v.cast("double") * 256)))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """The vectors of a batch as rows, with zeros behind shorter ones."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    lengths = np.diff(ends)
    if len(flat) == len(lengths) * dimensions and (lengths == dimensions).all():
        return flat.reshape(-1, dimensions)
    out = np.zeros((len(lengths), dimensions), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(ends[:-1], lengths)] = flat
    return out


@dataclass
class Fitted:
    """n different vectors, their sums, and unit eigenvectors (columns) of their covariance by falling eigenvalue."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    identity_error: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.sums, self.n)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """x - sums / n; the whole part is taken off in whole numbers, so that nothing is lost far from the origin."""
    whole, rest = np.divmod(sums, n)
    return (x - whole).astype(float) - rest / n


def _summed(rows: DataFrame, width: int, of: Callable[[pa.Array], np.ndarray]) -> dict[int, np.ndarray]:
    """The sums over all batches of the matrices that `of` makes, row by row: one row for each dimension comes back."""
    names = [f"y{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = of(batch.column("x"))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *(pa.array(total[:, j]) for j in range(width))], ["i", *names])

    bounded_batches(rows.sparkSession)
    sums = rows.mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*(F.sum(c).alias(c) for c in names))
    return {r.i: np.array(r[1:]) for r in sums.collect()}  # a row a dimension


def _stacked(sums: dict[int, np.ndarray], rows: int, width: int) -> np.ndarray:
    return np.array([sums.get(i, np.zeros(width)) for i in range(rows)]).reshape(rows, width)


class Covariance:
    """Products of the covariance of a table of vectors with blocks of directions, a pass over the table each."""

    def __init__(self, vectors: DataFrame, n: int, sums: np.ndarray):
        self.vectors, self.n, self.sums, self.passes = vectors, n, sums, 0
        self.trace = 0.0

    def __matmul__(self, block: np.ndarray) -> np.ndarray:
        sums, n, d = self.sums, self.n, len(self.sums)

        def of(column: pa.Array) -> np.ndarray:
            c = centred(_matrix(column, d), sums, n)
            return np.column_stack([c.T @ (c @ block), (c * c).sum(0)])

        self.passes += 1
        width = block.shape[1] + 1
        made = _stacked(_summed(self.vectors, width, of), d, width) / n
        self.trace = float(made[:, -1].sum())
        return made[:, :-1]


def _orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of the block's directions outside `against`; dependent ones are left out."""
    for _ in range(2):
        if against is not None and against.size:
            block = block - against @ (against.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 1e-300] / size[size > 1e-300]
        if not block.size:
            return block
        left, scale, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, scale > 1e-10 * scale[0]]
    return block


def lobpcg(covariance, dimensions: int, wanted: int, guards: int = GUARDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """The leading eigenvalues and eigenvectors of a covariance, and the largest residual of a fresh product."""
    m = min(dimensions, wanted + guards)
    x = _orthonormal(np.random.default_rng(7).standard_normal((dimensions, m)))
    ax = covariance @ x
    p = np.zeros((dimensions, 0))
    best, stalled = np.inf, 0
    for _ in range(rounds):
        # Rayleigh-Ritz on the iterate, so that residuals belong to Ritz vectors
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        turn = turn[:, ::-1]
        values, x, ax = values[::-1], x @ turn, ax @ turn
        r = ax - x * values
        size = float(np.linalg.norm(r[:, :wanted], axis=0).max(initial=0)) / max(values[0], 1e-300)
        if size < 0.5 * best:
            best, stalled = size, 0
        else:
            stalled += 1
        if values[0] <= 0 or size <= TOLERANCE and (stalled >= STALLED or size <= 1e-15):
            fresh = covariance @ x[:, :wanted]  # nothing carried over from earlier rounds
            certified = float(np.linalg.norm(fresh - x[:, :wanted] * values[:wanted], axis=0).max(initial=0)) / max(values[0], 1e-300)
            if values[0] <= 0 or certified <= 10 * TOLERANCE:
                return values[:wanted], x[:, :wanted], certified
        w = _orthonormal(r, x)
        p = _orthonormal(p, np.column_stack([x, w]))
        aw_p = covariance @ np.column_stack([w, p])
        s, image = np.column_stack([x, w, p]), np.column_stack([ax, aw_p])
        gram = s.T @ image
        _, turn = np.linalg.eigh((gram + gram.T) / 2)
        top = turn[:, ::-1][:, :m]
        new, new_image = s @ top, image @ top
        p = s[:, m:] @ top[m:]
        x, fix = np.linalg.qr(new)  # orthonormal to rounding; the products follow by the same combination
        ax = np.linalg.solve(fix.T, new_image.T).T
    raise RuntimeError(f"LOBPCG left residuals of {best:.1e} after {rounds} rounds")


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Fitted | None:
    """The whitening of a table's different vectors; None where there is no finite vector."""
    different = materialise(whole_vectors(rows.select(column), column).select("x").distinct(), "whitening")
    size = different.agg(F.count("*"), F.max(F.size("x")), F.min(F.size("x"))).first()
    n, d = size[0], size[1] or 0
    if n and size[2] < d:
        padded = different.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))).alias("x")).distinct()
        unequal, different = different, materialise(padded, "whitening")
        release(unequal)
        n = different.count()
    if not n or not d:
        release(different)
        return None
    sums = np.array([r.s for r in different.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).orderBy("i").collect()], np.int64)  # a row a dimension
    covariance = Covariance(different, n, sums)
    values, vectors, residual = lobpcg(covariance, d, min(components, d))
    trace = covariance.trace
    real = values > max(trace, 0) * 1e-13
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    out = Fitted(n, sums, trace, values, vectors, residual, 0.0, covariance.passes)
    if len(values):
        k = len(values)

        def of(x: pa.Array) -> np.ndarray:
            z = out.whiten(_matrix(x, d))
            return np.vstack([z.T @ z, z.sum(0)])

        sums_of = _stacked(_summed(different, k, of), k + 1, k) / n
        out.identity_error = float(np.abs(sums_of[:k] - np.outer(sums_of[k], sums_of[k]) - np.eye(k)).max())
    release(different)
    return out


def whiten(rows: DataFrame, fitted: Fitted | None, ids: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each finite vector and component."""
    kind = rows.schema[ids].dataType.simpleString()
    schema = f"{ids} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.values):
        return rows.sparkSession.createDataFrame([], schema)
    sent = rows.sparkSession.sparkContext.broadcast(fitted)  # some numbers a dimension

    def make():
        f = sent.value
        d, k = len(f.sums), len(f.values)
        names = [x.split()[0] for x in schema.split(", ")]

        def deviations(x: np.ndarray) -> np.ndarray:
            most = f.n * int(np.abs(x).max(initial=0)) + int(np.abs(f.sums).max(initial=0))
            if most * most * d < 1 << 63:
                return ((f.n * x - f.sums) ** 2).sum(1)
            return np.array([sum((f.n * a - b) ** 2 for a, b in zip(row, f.sums.tolist(), strict=True)) for row in x.tolist()])

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = _matrix(batch.column("x"), d)
            count = len(x)
            repeated = pa.array(np.repeat(np.arange(count), k))
            columns = [batch.column(ids).take(repeated), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, f.n)), pa.array(np.repeat(deviations(x), k), pa.int64()), pa.array(f.whiten(x).ravel()), pa.array(np.tile(f.values / f.trace, count)), pa.array(np.full(count * k, f.identity_error))]
            return pa.RecordBatch.from_arrays(columns, names)

        return each

    return map_batches(whole_vectors(rows.select(ids, column), column).select(ids, "x"), schema, make)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return whiten(rows, fit(rows))
