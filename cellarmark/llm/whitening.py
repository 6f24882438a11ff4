"""Embedding whitening: single-precision eigenvectors of a distributed covariance, refined in higher precision.

Entries become integers ``floor(scale * c) + offset``. One pass sums them, a second one sums the products about the rounded
means; both sums are exact, so the covariance is that of exactly centred vectors, rounded once. The driver gets
one number per dimension and per pair of dimensions. ``numpy.linalg.eigh`` in float32 gives the first eigenvectors; Ogita and
Aishima's iteration (matrix products only, quadratic convergence) corrects them in float64 and then in extended precision.
Eigenvalues closer than the current error form a cluster: its subspace is refined as a whole, and a sub-solve of the matrix
shifted by the cluster's mean turns the basis inside it.

Defined cases: null vectors and vectors with null, non-finite or absurdly large entries (over ``LARGEST``) are dropped, and so are
empty ones and those of another dimension than the commonest (of equally common ones the larger); repeated rows and
ids count as often as they occur, null ids are kept; a component without variance has whitened 0 and is left out of identity_error;
explained is null where nothing varies; a deviation over 63 bits is null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarmark.llm.common import stored, table

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
LARGEST = float(1 << 42)
ROWS_AT_ONCE = 512
FLAT = 1e-12
"""Components with less than this share of the variance count as having none."""


def valid(rows: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) of the rows that can be whitened, all of the commonest dimension."""
    vector = F.col("embedding").cast("array<double>")
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter("size(vector) > 0")
    kept = kept.filter(~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST)))
    common = kept.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.filter(F.size("vector") == (common["d"] if common else 0))


def integers(batch: pa.RecordBatch, dimension: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and the integer vectors of each short run of rows."""
    values = np.floor(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension) * SCALE).astype(np.int64) + OFFSET
    for at in range(0, len(values), ROWS_AT_ONCE):
        yield at, values[at : at + ROWS_AT_ONCE]


def exact_sums(vectors: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """How many vectors, and the sum of each dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dimension, object)
        for batch in batches:
            for _, x in integers(batch, dimension):
                n += len(x)
                sums += x.sum(axis=0).astype(object)
        yield pa.record_batch({"i": pa.array(range(dimension), pa.int32()), "n": pa.array([n] * dimension, pa.int64()), "s": pa.array([str(s) for s in sums])})

    total = vectors.select("vector").mapInArrow(work, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    ordered = sorted(total, key=lambda r: r["i"])
    return (ordered[0]["n"], [int(r["s"]) for r in ordered]) if ordered else (0, [])


def exact_products(vectors: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Sums of (x - centre)(x - centre)^T as Python integers."""
    dimension = len(centre)
    above = np.triu_indices(dimension)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, bound = np.zeros((dimension, dimension), object), np.zeros((dimension, dimension), np.int64), 0
        for batch in batches:
            for _, x in integers(batch, dimension):
                y = x - centre
                most = int(np.abs(y).max()) ** 2 * len(y)
                if most >= 1 << 53:  # beyond exact doubles
                    total += y.T.astype(object) @ y.astype(object)
                    continue
                if bound + most >= 1 << 62:
                    total, held, bound = total + held.astype(object), np.zeros_like(held), 0
                real = y.astype(np.float64)
                held, bound = held + (real.T @ real).astype(np.int64), bound + most
        total = (total + held.astype(object))[above]
        for at in range(0, len(total), 10_000):
            yield pa.record_batch({"i": pa.array(above[0][at : at + 10_000], pa.int32()), "j": pa.array(above[1][at : at + 10_000], pa.int32()), "s": pa.array([str(s) for s in total[at : at + 10_000]])})

    products = np.zeros((dimension, dimension), object)
    for r in vectors.select("vector").mapInArrow(work, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).toLocalIterator():
        products[r["i"], r["j"]] = products[r["j"], r["i"]] = int(r["s"])
    return products


def extended(values: np.ndarray) -> np.ndarray:
    """Fractions as extended floats: a double and what it leaves over."""
    high = np.vectorize(float, otypes=[np.float64])(values)
    low = np.vectorize(lambda f, h: float(f - Fraction(h)), otypes=[np.float64])(values, high)
    return high.astype(np.longdouble) + low.astype(np.longdouble)


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step of the refinement: better eigenvectors and eigenvalues (falling), and the error before the step."""
    d = len(a)
    r = np.eye(d, dtype=a.dtype) - x.T @ x
    s = x.T @ a @ x
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    size = np.sqrt((a * a).sum())
    error = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > error
    x = x + x @ np.where(apart, (s + r * values[None, :]) / np.where(apart, gap, 1), r / 2)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    for cluster in np.split(np.arange(d), np.flatnonzero(values[:-1] - values[1:] > error) + 1):
        if len(cluster) > 1:
            basis = x[:, cluster]
            inner = basis.T @ (a @ basis - values[cluster].mean() * basis)
            _, turn = np.linalg.eigh(((inner + inner.T) / 2).astype(np.float64))
            x[:, cluster] = basis @ turn[:, ::-1].astype(a.dtype)
    return x, values, float(error / size)


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns, largest entry positive) of an extended-precision matrix."""
    d = len(covariance)
    if not np.abs(covariance).max():
        return np.zeros(d), np.eye(d)
    scaled = covariance / np.abs(covariance).max()
    _, first = np.linalg.eigh(scaled.astype(np.float32))
    x, kept = first[:, ::-1], None
    for precision in (np.float64, np.longdouble):
        a, x, before = scaled.astype(precision), x.astype(precision), np.inf
        while True:
            x, values, error = corrected(a, x)
            if not 0 < error <= before / 2:  # no further gain in this precision
                break
            before = error
        x = x + x @ ((np.eye(d, dtype=precision) - x.T @ x) / 2)
    x = x / np.sqrt((x * x).sum(axis=0))
    x = x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(d)])
    values = np.einsum("ij,ij->j", x, covariance @ x)
    order = np.argsort(-values, kind="stable")
    return np.maximum(values[order], 0).astype(np.float64), x[:, order].astype(np.float64)


@dataclass
class Whitening:
    """What a fit leaves at the driver: nothing that grows with the number of vectors."""

    n: int
    centre: np.ndarray
    excess: list[int]
    """Sums less n times the (rounded) centre."""
    values: np.ndarray
    components: np.ndarray
    trace: float

    def explained(self) -> list[float | None]:
        return [float(v / self.trace) if self.trace > 0 else None for v in self.values]

    def varying(self) -> list[bool]:
        return [bool(v > FLAT * self.trace) for v in self.values]

    def transform(self, vectors: DataFrame) -> DataFrame:
        """vec_id, deviation, whitened (array) of valid vectors."""
        n, centre, excess = self.n, self.centre, np.array(self.excess, object)
        shift = np.array([float(Fraction(e, n)) for e in self.excess])
        matrix = self.components * np.array([1 / np.sqrt(v) if varies else 0.0 for v, varies in zip(self.values, self.varying(), strict=True)])
        most_excess = max(abs(e) for e in self.excess)

        def deviations(y: np.ndarray) -> list[int | None]:
            if len(centre) * (n * int(np.abs(y).max()) + most_excess) ** 2 < 1 << 63:
                return ((n * y - excess.astype(np.int64)) ** 2).sum(axis=1).tolist()
            exact = ((n * y.astype(object) - excess) ** 2).sum(axis=1)
            return [int(v) if v < 1 << 63 else None for v in exact]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, x in integers(batch, len(centre)):
                    y = x - centre
                    white = (y.astype(np.float64) - shift) @ matrix
                    yield pa.record_batch(
                        {
                            "vec_id": batch.column("vec_id").slice(at, len(x)),
                            "deviation": pa.array(deviations(y), pa.int64()),
                            "whitened": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(white.ravel())),
                        }
                    )

        return vectors.mapInArrow(work, "vec_id long, deviation long, whitened array<double>")


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of valid vectors (None without any)."""
    first = vectors.select(F.size("vector").alias("d")).first()
    if first is None:
        return None
    n, sums = exact_sums(vectors, first["d"])
    centre = [(2 * s + n) // (2 * n) for s in sums]
    excess = [s - n * m for s, m in zip(sums, centre, strict=True)]
    products = exact_products(vectors, np.array(centre, np.int64))
    outer = np.array(excess, object)
    covariance = np.vectorize(lambda p: Fraction(int(p), n * n), otypes=[object])(n * products - outer[:, None] * outer[None, :])
    values, columns = eigen(extended(covariance))
    return Whitening(n, np.array(centre, np.int64), excess, values[:components], columns[:, :components], float(sum(np.diag(covariance))))


def identity_error(whitened: DataFrame, varying: list[bool]) -> float | None:
    """Largest absolute entry of the whitened components' covariance minus the identity."""
    chosen = [i for i, varies in enumerate(varying) if varies]
    if not chosen:
        return None
    means = whitened.agg(*[F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in chosen]).first()
    part = {i: F.col("whitened")[i] - means[f"m{i}"] for i in chosen}
    pairs = [(i, j) for i in chosen for j in chosen if i <= j]
    found = whitened.agg(*[F.avg(part[i] * part[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = valid(table(spark, sf_dir, "embeddings"))
    model = fit(vectors)
    if model is None:
        return spark.createDataFrame([], schema)
    rows = stored(model.transform(vectors), "whitened")
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained()])
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return long.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(identity_error(rows, model.varying())).cast("double").alias("identity_error"),
    )
