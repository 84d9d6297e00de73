"""Whitening of embeddings by spectrum slicing.

Spark counts the distinct vectors and sums them, then their products after centring, in whole
numbers; the driver gets one covariance matrix, whose size depends on the vectors' width alone.
Its leading eigenvalues are found by slicing: the inertia of the LDL^T factors of V - s I counts
the eigenvalues above s, and bisection on s narrows an interval until it holds one eigenvalue
only. There Rayleigh quotient iteration converges, cubically, and two more counts just below
and above the result prove that it is the wanted number. Eigenvalues that no double can tell
apart share an interval; an orthonormal basis of their space comes from block inverse iteration.

Entries become whole numbers floor(64 c) + 1000000. The fit list is every distinct vector once,
the result has every row.

Cases: rows whose vector is null or holds null or non-finite entries are dropped; a null id
stays; shorter vectors count as zero for what they lack; 64 c is held within +-2^40; repeated
rows are each returned and fitted once; components whose eigenvalue is zero to double precision
cannot be whitened and are left out, so equal vectors, or one alone, give rows without any
component; tied eigenvalues get an orthonormal basis of their space; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from topicloom.llm.topk import usable
from topicloom.scratch import materialize

SCALE, OFFSET, LIMIT = 64.0, 1_000_000, float(1 << 40)
COMPONENTS = 16
EPS = float(np.finfo(np.float64).eps)
PIVOT = (1 + 17 ** 0.5) / 8


# The matrix: inertia, bisection, Rayleigh quotients.


def above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``matrix`` above ``shift``: positive signs of D in LDL^T.

    Symmetric pivoting with blocks of one and two rows keeps the factors bounded; by
    Sylvester's law the blocks of D have as many positive eigenvalues as the shifted matrix.
    """
    m = matrix - shift * np.eye(len(matrix))
    n, k, positive = len(m), 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j], k:] = m[[j, i], k:]
            m[k:, [i, j]] = m[k:, [j, i]]

    while k < n:
        below = np.abs(m[k + 1:, k])
        most = below.max(initial=0.0)
        two = False
        if most > 0 and abs(m[k, k]) < PIVOT * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(m[r, k:])
            row[r - k] = 0.0
            widest = row.max()
            if abs(m[k, k]) * widest < PIVOT * most ** 2:
                two = abs(m[r, r]) < PIVOT * widest
                swap(k + 1 if two else k, r)
        if two:
            block, rest = m[k:k + 2, k:k + 2], m[k + 2:, k:k + 2]
            det = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            positive += 1 if det < 0 else 2 if block[0, 0] + block[1, 1] > 0 else 0
            inverse = np.array([[block[1, 1], -block[0, 1]], [-block[1, 0], block[0, 0]]]) / det
            m[k + 2:, k + 2:] -= rest @ inverse @ rest.T
            k += 2
        else:
            positive += bool(m[k, k] > 0)
            if m[k, k] != 0:
                c = m[k + 1:, k].copy()
                m[k + 1:, k + 1:] -= np.outer(c, c / m[k, k])
            k += 1
    return positive


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, scale: float) -> np.ndarray:
    eye = np.eye(len(matrix))
    for nudge in (0.0, 4 * EPS * scale, 64 * EPS * scale):
        try:
            found = np.linalg.solve(matrix - (shift + nudge) * eye, right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all() and np.abs(found).max() > 0:
            return found
    return right


def _basis(vectors: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Orthonormal columns of ``vectors`` without their part in the columns of ``found``."""
    for _ in range(2):
        vectors = np.linalg.qr(vectors - found @ (found.T @ vectors))[0]
    return vectors


def _rayleigh(matrix, low, high, found, scale) -> tuple[float, np.ndarray, float]:
    """Eigenvalue, vector and residual that Rayleigh quotient iteration reaches in an interval."""
    v = _basis(np.random.default_rng(0).normal(size=(len(matrix), 1)), found)
    for _ in range(2):
        v = _basis(_solve(matrix, (low + high) / 2, v, scale), found)
    best = (0.0, v, np.inf)
    for _ in range(12):
        rho = float((v.T @ matrix @ v).item())
        residual = float(np.linalg.norm(matrix @ v - rho * v))
        if residual < best[2]:
            best = (rho, v, residual)
        if residual <= 4 * EPS * scale:
            break
        v = _basis(_solve(matrix, rho, v, scale), found)
    return best


@dataclass
class Spectrum:
    """Leading eigenvalues, falling, and their unit vectors in columns."""

    values: np.ndarray
    vectors: np.ndarray


def leading(matrix: np.ndarray, wanted: int) -> Spectrum:
    """The ``wanted`` largest eigenvalues of a positive semidefinite matrix that are not zero."""
    n = len(matrix)
    scale = float(np.abs(matrix).sum(1).max(initial=0.0))
    found, values = np.zeros((n, 0)), []
    if scale == 0:
        return Spectrum(np.zeros(0), found)
    least = 8 * n * EPS * scale
    counts: dict[float, int] = {}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(matrix, shift)
        return counts[shift]

    top = scale * (1 + 4 * EPS)
    wanted = min(wanted, count(least))
    while len(values) < wanted:
        number = len(values) + 1
        # The narrowest known interval of this number.
        low = max(s for s, c in [*counts.items(), (least, wanted)] if c >= number)
        high = min([s for s, c in counts.items() if c < number], default=top)
        while True:
            alone = count(low) == number and count(high) == number - 1
            if alone:
                rho, v, residual = _rayleigh(matrix, low, high, found, scale)
                near = residual + least
                # Only the wanted number lies so near to the quotient.
                if low - near <= rho <= high + near and residual <= 64 * n * EPS * scale \
                        and count(rho - near) >= number and count(rho + near) < number:
                    found, values = np.hstack([found, v]), [*values, rho]
                    break
            middle = (low + high) / 2
            if high - low <= least or not low < middle < high:
                many = max(1, count(low) - (number - 1))
                block = _basis(np.random.default_rng(number).normal(size=(n, many)), found)
                for _ in range(4):
                    block = _basis(_solve(matrix, middle, block, scale), found)
                small, turn = np.linalg.eigh(block.T @ matrix @ block)
                found = np.hstack([found, (block @ turn)[:, ::-1]])
                values += list(small[::-1])
                break
            low, high = (middle, high) if count(middle) >= number else (low, middle)
    # Vectors of near values are orthonormal only after the later of them is found.
    order = np.argsort(-np.array(values), kind="stable")[:wanted]
    vectors = found[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    return Spectrum(np.array(values)[order], vectors * signs)


# The sums.


def whole(vector: Column) -> Column:
    """Entries as whole numbers floor(64 c) + 1000000."""
    held = lambda c: F.greatest(F.least(F.lit(SCALE) * c.cast("double"), F.lit(LIMIT)), F.lit(-LIMIT))
    return F.transform(vector, lambda c: F.floor(held(c)).cast("long") + F.lit(OFFSET))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """A column of whole vectors as a matrix; absent entries are those of zero."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(flat) == len(sizes) * width and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), OFFSET, np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _gram(x: np.ndarray) -> np.ndarray:
    """Exact x^T x of whole numbers."""
    most = float(np.abs(x).max(initial=0)) ** 2 * max(1, len(x))
    if most < 2**53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    return x.T @ x if most < 2**62 else x.astype(object).T @ x.astype(object)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


SUMS = "i int, j int, s decimal(38,0)"


def _summed(fit: DataFrame, width: int, centre: list[int] | None) -> dict[tuple[int, int], int]:
    """Sums of each dimension, or products of each pair after taking ``centre`` away.

    Each task adds up its own rows; the tasks' sums, as many as the width or its square gives,
    meet by dimension in Spark.
    """

    def run(batches):
        total = None
        for batch in batches:
            x = _rows(batch.column(0), width)
            if centre is None:
                part = (x - OFFSET).astype(object).sum(0) if np.abs(x).max(initial=0) > 2**45 else (x - OFFSET).sum(0)
            else:
                part = _gram(x - np.array(centre, np.int64))
            total = part.astype(object) if total is None else total + part
        if total is not None:
            i, j = (np.arange(width), np.arange(width)) if centre is None else np.triu_indices(width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _decimals(total if centre is None else total[i, j])],
                names=["i", "j", "s"],
            )

    added = fit.mapInArrow(run, SUMS).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return {(r["i"], r["j"]): int(r["s"]) for r in added}


@dataclass
class Fit:
    """What every row needs: count, whole centre and the sums' rest over it, components."""

    n: int
    width: int
    centre: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly; as Python's integers where 64 bits could overflow."""
        d = x - self.centre
        if self.n * (float(np.abs(d).max(initial=0)) + 1) >= 2**62:
            d = d.astype(object)
        return d * self.n - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = self.deviations(x).astype(np.float64) / self.n
        return centred @ (self.vectors / np.sqrt(self.values))


def fit_components(fit: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Fit on the written list of distinct vectors ``x``; None where it is empty."""
    shape = fit.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = shape["n"], shape["width"] or 0
    if not n:
        return None
    sums = _summed(fit, width, None) if width else {}
    total = [sums[i, i] + OFFSET * n for i in range(width)]
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * c for s, c in zip(total, centre)]
    products = _summed(fit, width, centre) if width else {}
    v = np.zeros((width, width))
    for (i, j), s in products.items():
        v[i, j] = v[j, i] = (n * s - rest[i] * rest[j]) / (n * n)
    found = leading(v, components)
    return Fit(
        n, width, np.array(centre, np.int64), np.array(rest, np.int64), found.values, found.vectors,
        float(np.trace(v)),
    )


def _identity_error(fit: DataFrame, model) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    k, n = len(model.value.values), model.value.n

    def run(batches):
        m = model.value
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = m.whitened(_rows(batch.column(0), m.width))
            first += w.sum(0)
            second += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[i, np.arange(k)].astype(np.int32)), pa.array(np.r_[j, np.full(k, -1)].astype(np.int32)),
             pa.array(np.r_[second[i, j], first])], names=["i", "j", "s"],
        )

    rows = fit.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    sums = {(r["i"], r["j"]): r["s"] for r in rows.collect()}
    # The rows are centred; the mean that rounding leaves is taken away all the same.
    return max(
        abs(s / n - sums[i, -1] * sums[j, -1] / n**2 - (i == j)) for (i, j), s in sums.items() if j >= 0
    )


def _deviation(d: np.ndarray) -> pa.Array:
    """Sum of squares of each row, exactly."""
    most = float(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1])
    if d.dtype == object or most >= 2**62:
        return _decimals((d.astype(object) ** 2).sum(1))
    return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation decimal(38,0), whitened, explained, identity_error for each row.

    ``whitened`` and ``explained`` are arrays over the components, by falling eigenvalue.
    """
    spark = rows.sparkSession
    kept = rows.filter(usable(F.col("embedding"))).select("vec_id", whole(F.col("embedding")).alias("x"))
    fit = materialize(kept.select("x").distinct(), "whitening-fit")
    width = fit.agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b")).first()
    if width["a"] != width["b"]:
        # Vectors that differ in zeros at their end only are equal.
        lacks = F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(width["b"]) - F.size("x"))
        fit = materialize(fit.select(F.concat("x", lacks).alias("x")).distinct(), "whitening-fit")
    found = fit_components(fit, components)
    schema = "vec_id long, n long, deviation decimal(38,0), whitened array<double>"
    if found is None:
        empty = spark.createDataFrame([], schema)
        return empty.select("*", F.array().cast("array<double>").alias("explained"), F.lit(0.0).alias("identity_error"))
    model = spark.sparkContext.broadcast(found)
    error = _identity_error(fit, model) if len(found.values) else 0.0

    def run(batches):
        m = model.value
        k = len(m.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column(1), m.width)
            d = m.deviations(x)
            w = (d.astype(np.float64) / m.n) @ (m.vectors / np.sqrt(m.values))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(x), m.n)), _deviation(d),
                 pa.ListArray.from_arrays(ends, pa.array(w.ravel()))],
                names=["vec_id", "n", "deviation", "whitened"],
            )

    explained = [float(e / found.trace) for e in found.values]
    return kept.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, schema).select(
        "*", F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
