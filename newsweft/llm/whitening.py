"""Whitening of embeddings through the exact characteristic polynomial of their integer scatter matrix.

Entries become integers x = floor(scale * c) + offset.  The fit list is each distinct vector once; it is made by a grouping
that folds copies before the shuffle, and written once.

1. Sums: n and S, exact, from partial sums of the tasks.
2. Scatter: vectors are centred at the integer nearest to the mean and multiplied (by floating-point products only where every sum
   stays below 2^53, so these are exact too); with the exact correction for the centre, M = n * sum(y y') - T T' holds n^2 times the
   covariance as integers.
3. Polynomial: its coefficients lie between zero and binomial(d, k) * (trace / k)^k up to sign.  Spark deals primes of 31 bits whose product
   exceeds the bound; a task reduces M to Hessenberg form modulo a prime and unrolls the polynomial; Chinese remaindering joins them.
4. Roots: all are real, so the sign changes of the polynomial shifted to a give the exact number of roots above a
   (Budan and Fourier).  Intervals are halved until they hold one root, which is then narrowed by exact signs to ``BITS`` bits.
   Roots that are still together at that width count as one repeated root.
5. Components: inverse iteration for the null space of M - eI in decimal arithmetic of ``DIGITS`` digits, a task for each root; vectors of a
   repeated root are made orthogonal among themselves.  The largest entry of a component is positive.
6. All rows, copies too, are projected; the covariance of the whitened fit list is measured in one more pass.

What reaches the driver or goes out with a task is bounded by the number of dimensions, never by rows.

Defined results: rows whose vector is null or empty or holds a null or non-finite entry are dropped.  If lengths differ, those of the
commonest length among distinct vectors (the longer of two) are kept.  Null ids and repeated rows are kept, each with rows of
its own.  Entries beyond 2^60 / scale count as that bound.  A root of zero has no whitened values, so there are
as many components as the rank allows, and none for an empty table or a single distinct vector.  A deviation
beyond the range of long is null.  Columns other than vec_id and embedding are left behind.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.llm.common import cut_lineage, ready

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
WIDEST = 60
BITS, DIGITS = 170, 60
LIMB = 40
EXACT = 1 << 53
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def integer_vectors(embeddings: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x) of the rows that can be used."""
    entry = F.col("embedding")
    usable = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    wide = F.lit(2.0**WIDEST)
    x = F.transform(entry, lambda c: F.floor(F.least(F.greatest(c.cast("double") * F.lit(float(scale)), -wide), wide)) + F.lit(offset).cast("long"))
    return embeddings.filter(entry.isNotNull() & (F.size(entry) > 0)).filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


# ---------------------------------------------------------------- exact sums


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, d)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b of integer matrices as Python integers, exact whatever their size."""
    bound = len(a) * max(int(np.abs(a).max()), 1) * max(int(np.abs(b).max()), 1)
    if bound < EXACT:
        return (a.astype(float).T @ b.astype(float)).astype(np.int64).astype(object)
    if bound < 1 << 62:
        return (a.T @ b).astype(object)
    return a.T.astype(object) @ b.astype(object)


def _total(fit: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Exact sums over all vectors of the integers that ``of`` makes of a block; tasks send limbs, so no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                some = of(_rows(batch, d))
                held = some if held is None else held + some
        if held is None:
            return
        cells, limbs, values = [], [], []
        for cell, value in enumerate(held.tolist()):
            limb = 0
            while value >> LIMB not in (0, -1):
                cells.append(cell), limbs.append(limb), values.append(value & (1 << LIMB) - 1)
                value, limb = value >> LIMB, limb + 1
            cells.append(cell), limbs.append(limb), values.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(limbs, pa.int32()), pa.array(values, pa.int64())], names=["cell", "limb", "value"])

    parts = fit.select("x").mapInArrow(run, "cell int, limb int, value long").groupBy("cell", "limb").agg(F.sum("value").alias("value")).collect()
    out = [0] * (1 + max((r["cell"] for r in parts), default=-1))
    for r in parts:
        out[r["cell"]] += r["value"] << LIMB * r["limb"]
    return out


def scatter_matrix(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and the integer matrix n^2 * covariance of the vectors in ``fit``."""
    n, *sums = _total(fit, d, lambda x: np.concatenate([np.array([len(x)], dtype=object), x.sum(axis=0, dtype=np.int64).astype(object) if int(np.abs(x).max()) * len(x) < 1 << 62 else x.astype(object).sum(axis=0)]))
    centre = [(2 * s + n) // (2 * n) for s in sums]
    middle, upper = np.array(centre, dtype=np.int64), np.triu_indices(d)
    products = _total(fit, d, lambda x: exact_product(x - middle, x - middle)[upper])
    rest = [s - n * c for s, c in zip(sums, centre)]
    matrix = [[0] * d for _ in range(d)]
    for i, j, value in zip(*[axis.tolist() for axis in upper], products):
        matrix[i][j] = matrix[j][i] = n * value - rest[i] * rest[j]
    return n, sums, matrix


# ---------------------------------------------------------------- characteristic polynomial


def primes_beyond(bound: int) -> list[int]:
    """The largest primes of 31 bits whose product exceeds ``bound``."""
    sieve = np.ones(46_342, dtype=bool)
    sieve[:2] = False
    for i in range(2, 216):
        if sieve[i]:
            sieve[i * i :: i] = False
    small, out, product, top = np.flatnonzero(sieve), [], 1, 2**31 - 1
    while product <= bound:
        if (top % small).all():
            out.append(top)
            product *= top
        top -= 2
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x I - matrix) modulo p, constant first, by reduction to Hessenberg form."""
    h, d = matrix.copy() % p, len(matrix)
    for m in range(1, d - 1):
        pivot = m + int(np.argmax(h[m:, m - 1] != 0))
        if h[pivot, m - 1] == 0:
            continue
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), dtype=np.int64)
    poly[0, 0] = 1
    for k in range(d):
        poly[k + 1, 1:] = poly[k, :-1]
        below, factor = np.zeros(k + 1, dtype=np.int64), 1
        below[k] = h[k, k]
        for i in range(k - 1, -1, -1):
            factor = factor * int(h[i + 1, i]) % p
            if not factor:
                break
            below[i] = int(h[i, k]) * factor % p
        poly[k + 1] = (poly[k + 1] - (below[:, None] * poly[: k + 1] % p).sum(axis=0)) % p
    return poly[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients of det(x I - matrix), constant first, of a positive semidefinite matrix."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    moduli = primes_beyond(max(math.comb(d, k) * trace**k // k**k + 1 for k in range(1, d + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(matrix, dtype=object)
        for batch in batches:
            for number in batch.column("id").to_pylist():
                found = polynomial_modulo((whole % moduli[number]).astype(np.int64), moduli[number])
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["id", "found"])

    tasks = max(1, min(len(moduli) // 16, spark.sparkContext.defaultParallelism))
    rests = spark.range(0, len(moduli), numPartitions=tasks).mapInArrow(run, "id long, found array<long>").collect()
    out, product = [0] * (d + 1), 1
    for number, found in sorted(map(tuple, rests)):
        p = moduli[number]
        inverse = pow(product, -1, p)
        # the k-th coefficient from the top has the sign (-1)^k, so signless ones are joined
        out = [c + product * (((-1) ** (d - k) * f - c) * inverse % p) for k, (c, f) in enumerate(zip(out, found))]
        product *= p
    return [(-1) ** (d - k) * c for k, c in enumerate(out)]


# ---------------------------------------------------------------- real roots


def _scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times as large."""
    return [c << bits * (len(poly) - 1 - k) for k, c in enumerate(poly)]


def roots_above(poly: list[int], a: int) -> int:
    """Roots greater than a, with multiplicity, of a polynomial with real roots only: sign changes after a shift by a."""
    c = list(poly)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _positive(poly: list[int], a: int) -> int:
    value = 0
    for c in reversed(poly):
        value = value * a + c
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], wanted: int, bits: int = BITS) -> list[tuple[Fraction, int]]:
    """(root, number of components) by falling value, until ``wanted`` components or all positive roots are there."""
    zeros = next(k for k, c in enumerate(poly) if c)
    poly = poly[zeros:]
    wanted = min(wanted, len(poly) - 1)
    if not wanted:
        return []
    high = 1 << max(0, -poly[-2]).bit_length()  # beyond the trace
    out: list[tuple[Fraction, int]] = []
    # intervals (low, high] as integers over 2^shift, with the numbers of roots above both ends
    open_ = [(0, high, 0, len(poly) - 1, 0)]
    scaled = {0: poly}
    while open_ and sum(m for _, m in out) < wanted:
        low, high, shift, above_low, above_high = open_.pop()
        if above_low == above_high:
            continue
        fine = low and (high - low) << bits <= low
        if fine or above_low - above_high == 1 and low and low >= high - low:
            value = Fraction(low + high, 2 << shift) if fine else _narrow(poly, low, high, shift, bits)
            out.append((value, min(above_low - above_high, wanted - sum(m for _, m in out))))
            continue
        low, high, shift = 2 * low, 2 * high, shift + 1
        if shift not in scaled:
            scaled[shift] = _scaled(poly, shift)
        middle = (low + high) // 2
        above = roots_above(scaled[shift], middle)
        open_ += [(low, middle, shift, above_low, above), (middle, high, shift, above, above_high)]
    return out


def _narrow(poly: list[int], low: int, high: int, shift: int, bits: int) -> Fraction:
    """The one root in (low, high] over 2^shift, to ``bits`` bits, by exact signs."""
    side = _positive(_scaled(poly, shift), high)
    if side == 0:
        return Fraction(high, 1 << shift)
    # each step halves the interval; the scale grows only as far as the width asks
    more = bits - low.bit_length() + (high - low).bit_length()
    extra = max(0, more)
    low, high, scaled = low << extra, high << extra, _scaled(poly, shift + extra)
    while high - low > 1 and (high - low) << bits > low:
        middle = (low + high) // 2
        sign = _positive(scaled, middle)
        if sign == 0:
            return Fraction(middle, 1 << shift + extra)
        low, high = (low, middle) if sign == side else (middle, high)
    return Fraction(low + high, 2 << shift + extra)


# ---------------------------------------------------------------- components


def null_vectors(matrix: list[list[int]], root: Fraction, number: int) -> np.ndarray:
    """``number`` orthogonal unit eigenvectors of the eigenvalue ``root``, as rows, by inverse iteration."""
    d = len(matrix)
    with decimal.localcontext() as context:
        context.prec = DIGITS
        context.Emax, context.Emin = decimal.MAX_EMAX, decimal.MIN_EMIN
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        a = np.array([[Decimal(v) for v in row] for row in matrix], dtype=object)
        a[np.arange(d), np.arange(d)] -= shift
        least = shift * Decimal(10) ** -DIGITS
        swaps = []
        for c in range(d):
            pivot = c + max(range(d - c), key=lambda i: abs(a[c + i, c]))
            swaps.append(pivot)
            if pivot != c:
                a[[c, pivot]] = a[[pivot, c]]
            if abs(a[c, c]) < least:
                a[c, c] = least
            if c + 1 < d:
                a[c + 1 :, c] /= a[c, c]
                a[c + 1 :, c + 1 :] -= a[c + 1 :, c, None] * a[None, c, c + 1 :]
        found: list[np.ndarray] = []
        for which in range(number):
            # a start that no structure of the matrix is likely to be orthogonal to
            v = np.array([Decimal(math.cos((which + 1.7) * (i + 0.3) ** 1.3)) for i in range(d)], dtype=object)
            for _ in range(3):
                for c, pivot in enumerate(swaps):
                    if pivot != c:
                        v[c], v[pivot] = v[pivot], v[c]
                for c in range(d - 1):
                    v[c + 1 :] -= a[c + 1 :, c] * v[c]
                for c in range(d - 1, -1, -1):
                    v[c] /= a[c, c]
                    v[:c] -= a[:c, c] * v[c]
                for _ in range(2):
                    for w in found:
                        v = v - w * (v * w).sum()
                    v = v / (v * v).sum().sqrt()
            found.append(v)
        return np.array([[float(x) for x in v] for v in found])


def principal_components(spark: SparkSession, matrix: list[list[int]], wanted: int) -> tuple[list[Fraction], np.ndarray]:
    """Eigenvalues of the integer matrix and unit components, one row each, by falling eigenvalue."""
    roots = largest_roots(characteristic_polynomial(spark, matrix), wanted)
    if not roots:
        return [], np.zeros((0, len(matrix)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                vectors = null_vectors(matrix, *roots[number])
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([vectors.tolist()], pa.list_(pa.list_(pa.float64())))], names=["id", "vectors"])

    tasks = min(len(roots), spark.sparkContext.defaultParallelism)
    found = sorted(map(tuple, spark.range(0, len(roots), numPartitions=tasks).mapInArrow(run, "id long, vectors array<array<double>>").collect()))
    vectors = np.array([v for _, some in found for v in some])
    largest = np.abs(vectors).argmax(axis=1)
    return [root for root, m in roots for _ in range(m)], vectors * np.sign(vectors[np.arange(len(vectors)), largest])[:, None]


# ---------------------------------------------------------------- all rows


class _Whitener:
    """Deviations and whitened values of integer vectors."""

    def __init__(self, n: int, sums: list[int], values: list[Fraction], components: np.ndarray):
        self.n, self.sums = n, sums
        self.centre = [(2 * s + n) // (2 * n) for s in sums]
        self.middle, self.rest = np.array(self.centre, dtype=np.int64), [s - n * c for s, c in zip(sums, self.centre)]
        # (n x - S) / n on a component over the root of value / n^2
        self.weights = (components / np.array([math.sqrt(v) for v in values])[:, None]).T

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        y = x - self.middle
        if (int(np.abs(y).max()) + 1) * self.n < 1 << 62:
            return self.n * y - np.array(self.rest, dtype=np.int64)
        return self.n * y.astype(object) - np.array(self.rest, dtype=object)

    def squares(self, z: np.ndarray) -> pa.Array:
        """Sums of squares; null where one does not fit a long."""
        if z.dtype == object or z.shape[1] * int(np.abs(z).max()) ** 2 >= 1 << 63:
            exact = (z.astype(object) ** 2).sum(axis=1).tolist()
            return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
        return pa.array((z * z).sum(axis=1), pa.int64())

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return z.astype(float) @ self.weights


def _identity_error(fit: DataFrame, d: int, whitener: _Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = whitener.weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(k * k + k)
        for batch in batches:
            if batch.num_rows:
                w = whitener.whitened(whitener.deviations(_rows(batch, d)))
                held += np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held)), pa.int64()), pa.array(held)], names=["cell", "value"])

    parts = fit.select("x").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    held = np.zeros(k * k + k)
    for r in parts:
        held[r["cell"]] = r["value"] / whitener.n
    mean = held[k * k :]
    return float(np.abs(held[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and component."""
    spark = embeddings.sparkSession
    ready(spark)
    rows = integer_vectors(embeddings, scale, offset)
    fit = cut_lineage(rows.select("x").distinct())
    commonest = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if commonest is None:
        return spark.createDataFrame([], SCHEMA + ", identity_error double")
    d = commonest["d"]
    fit = fit.filter(F.size("x") == d)
    n, sums, matrix = scatter_matrix(fit, d)
    values, vectors = principal_components(spark, matrix, components)
    if not values:
        return spark.createDataFrame([], SCHEMA + ", identity_error double")
    whitener = _Whitener(n, sums, values, vectors)
    trace = sum(matrix[i][i] for i in range(d))
    explained = [float(v / trace) for v in values]
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = whitener.deviations(_rows(batch, d))
            each = pa.array(np.repeat(np.arange(batch.num_rows), k))
            columns = [
                batch.column("vec_id").take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                pa.array(np.full(batch.num_rows * k, n, dtype=np.int64)),
                whitener.squares(z).take(each),
                pa.array(whitener.whitened(z).ravel()),
                pa.array(np.tile(explained, batch.num_rows)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.filter(F.size("x") == d).mapInArrow(run, SCHEMA).withColumn("identity_error", F.lit(_identity_error(fit, d, whitener)))
