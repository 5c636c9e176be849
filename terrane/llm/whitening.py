"""Embedding whitening: leading principal components by LOBPCG over distributed rows.

The covariance is never formed. Each round makes one product of it with a block of
directions: every partition centres its rows, multiplies them by the block and back,
and the partial blocks are summed by Spark. A Rayleigh-Ritz step on the orthonormal
basis of iterates, residuals and previous directions follows on blocks of
dimension x (3 x block), which is all that reaches the driver. Residuals come from
a fresh product in every round, so the last ones certify the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import Scratch

SCALE, GUARD, ROUNDS = 256, 8, 300
AIM, CERTIFIED = 1e-14, 1e-11  # residual norms over the largest eigenvalue: wanted, and accepted where rounding allows no less
NO_SPREAD = 1e-11  # of the trace: directions with less variance are no components


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # of each dimension, exact
    values: np.ndarray  # eigenvalues, falling
    components: np.ndarray  # dimension x component, unit columns
    trace: float
    residual: float  # largest of the components, over the largest eigenvalue
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ self.components / np.sqrt(self.values)


def scaled(vector: Column) -> Column:
    """floor(SCALE c) of every entry, as long; null where the vector is null, empty or holds a null or non-finite entry."""
    usable = (F.size(vector) > 0) & F.forall(vector, lambda e: F.coalesce(e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")), F.lit(False)))
    return F.when(usable, F.transform(vector, lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double")).cast("long")))


def rows_of(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """The lists of a column as rows of a matrix (all of one length)."""
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), np.int64)


def summed(df: DataFrame, partial: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all batches of rows x of a matrix computed from each; one partial matrix leaves a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = partial(rows_of(b, 0))
                total = part if total is None else total + part
        if total is not None:
            i, j = (x.ravel() for x in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    got = df.select("x").mapInArrow(run, f"i long, j long, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (got.column(c).to_numpy() for c in ("i", "j", "v"))
    out = np.zeros((i.max() + 1, j.max() + 1), v.dtype)
    out[i, j] = v
    return out


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """A basis of what the block's directions add to `against` (itself orthonormal)."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
    if not block.size:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-7 * s[0]]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0]


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues, their unit vectors and the largest residual over the largest eigenvalue."""
    m = min(dims, k + GUARD)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, m)))[0]
    basis, before = x, np.inf
    for _ in range(ROUNDS):
        av = product(basis)
        e, c = np.linalg.eigh((basis.T @ av + av.T @ basis) / 2)
        e, c = e[::-1][:m], c[:, ::-1][:, :m]
        new, residual = basis @ c, av @ c - (basis @ c) * e
        worst = float(np.linalg.norm(residual[:, :k], axis=0).max() / max(e[0], np.finfo(float).tiny))
        if worst <= AIM or (worst <= CERTIFIED and worst > before / 2):
            break
        before = min(before, worst)
        previous = basis[:, x.shape[1] :] @ c[x.shape[1] :]
        x = np.linalg.qr(new)[0]
        add = orthonormal(residual, x)
        basis = np.hstack([x, add])
        if previous.size:
            basis = np.hstack([basis, orthonormal(previous, basis)])
    if worst > CERTIFIED:
        raise RuntimeError(f"whitening: residual {worst:.1e} of the largest eigenvalue after {ROUNDS} rounds")
    lead = new[:, :k] / np.linalg.norm(new[:, :k], axis=0)
    return e[:k], lead * np.sign(lead[np.abs(lead).argmax(0), np.arange(lead.shape[1])]), worst


def prepared(vectors: DataFrame, column: str, out: str) -> DataFrame:
    """The rows that take part, with their scaled vector as `out`.

    Vectors of another length than the commonest (ties: the longest) take no part.
    """
    rows = vectors.withColumn(out, scaled(F.col(f"`{column}`"))).where(F.col(out).isNotNull())
    lengths = rows.groupBy(F.size(out).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    return rows.where(F.size(out) == (lengths[0]["d"] if lengths else 0))


def fit(rows: DataFrame, k: int = 4) -> Whitening | None:
    """From rows of x: the k leading components over each distinct vector once; None where there is no spread at all.

    Fewer than k components where the vectors have fewer dimensions or directions
    with variance.
    """
    fitted = Scratch(rows.sparkSession, "whitening").keep(rows.select("x").distinct(), "fit")
    n = fitted.count()
    if not n:
        return None
    sums = summed(fitted, lambda x: x.sum(0, keepdims=True), "long")[0]
    centre = sums / n
    trace = float(summed(fitted, lambda x: np.array([[((x - centre) ** 2).sum()]]), "double")[0, 0]) / n
    if trace == 0:
        return None

    def product(block: np.ndarray) -> np.ndarray:
        def partial(x: np.ndarray) -> np.ndarray:
            y = x - centre
            return y.T @ (y @ block)

        return summed(fitted, partial, "double") / n

    values, components, residual = lobpcg(product, len(sums), min(k, len(sums)))
    kept = values > NO_SPREAD * trace
    out = Whitening(n, sums, values[kept], components[:, kept], trace, residual)
    mean = summed(fitted, lambda x: out.whitened(x).sum(0, keepdims=True), "double")[0] / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = out.whitened(x) - mean
        return w.T @ w

    out.identity_error = float(np.abs(summed(fitted, spread, "double") / n - np.eye(kept.sum())).max())
    return out


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2, exact; None where that passes a long."""
    if (n * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0))) ** 2 * x.shape[1] < 2.0**62:
        return ((n * x - sums) ** 2).sum(1).tolist()
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, k: int = 4, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every row that takes part.

    Null and empty vectors, and those with a null or non-finite entry, take no part;
    repeated vectors count once in the fit and are answered each; other columns are
    not read. An empty table, or one whose vectors are all equal, gives no rows.
    """
    rows = prepared(vectors.select(F.col(id_col).alias("vec_id"), F.col(column).alias("vector")), "vector", "x").select("vec_id", "x")
    model, kind = fit(rows.select("x"), k), vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, size = rows_of(b, 1), len(model.values)
                each = np.repeat(np.arange(b.num_rows), size)
                columns = [
                    b.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), b.num_rows)),
                    pa.array(np.full(len(each), model.n)),
                    pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(each)),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(model.values / model.trace, b.num_rows)),
                    pa.array(np.full(len(each), model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return (rows if model else rows.limit(0)).mapInArrow(run, schema)
