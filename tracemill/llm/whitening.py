"""Whitening of embeddings by exact arithmetic.

1. Entries become whole numbers, and each distinct vector is fitted once. Tasks add up products of its entries; Spark adds
   the tasks' sums, in limbs that no sum overflows. n times the sums of products less the products of the sums is the
   scatter, n squared times the covariance: whole numbers, nothing is cancelled.
2. The scatter's characteristic polynomial: modulo many primes, each in a Spark task, the matrix is brought to Hessenberg
   form and its polynomial read off by the recurrence; Chinese remaindering gives the whole coefficients, as many primes
   are taken as their bound needs.
3. All its roots are real, so the roots above a are as many as the sign changes in the polynomial's coefficients about a.
   That isolates the greatest roots, with their multiplicities, by halving; once a root is alone, signs alone halve on.
4. Components are null vectors: inverse iteration about a root, in decimals of as many digits as the root has. Equal roots
   get orthogonal vectors.
5. Rows are projected where they lie. The covariance of the projected fit list is measured by Spark.

The driver holds the matrix, whose size is that of the dimension squared, and no rows. Work in 2 and 4 grows with the
dimension cubed (and its primes in 2).

Edge cases: vectors that are null or hold null or non-finite entries go; shorter vectors count as filled up with zeros to
the longest; entries whose number does not fit into a long take the nearest that does; a deviation that does not fit is
null; components of variance 0 are none, so one distinct vector, and an empty table, give no rows; null and repeated ids are
rows like others; ids must be numbers; further columns, whatever their names, are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

COMPONENTS, SCALE = 4, 256
#: Sums travel as limbs of 40 bits. Greatest long that a double can name.
LIMB, LIMBS, GREATEST = 40, 4, 2**63 - 1024
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def _vectors(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    """Whole numbers of a batch's vectors, filled up with zeros."""
    lists = batch.column(column)
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    x = np.zeros((len(sizes), d), np.int64)
    x[np.arange(d) < sizes[:, None]] = np.clip(np.floor(SCALE * flat), -float(GREATEST), float(GREATEST)).astype(np.int64)
    return x


def _products(x: np.ndarray) -> np.ndarray:
    """Sums of products of columns, exactly: by doubles where these hold every sum."""
    top = max(1, int(max(x.max(initial=0), -x.min(initial=0))))
    if top * top * len(x) < 1 << 53:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = x.astype(object)
    return o.T @ o


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, sums, and sums of products over the distinct vectors, as whole numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(batch.num_rows, d)
            total = total + _products(np.hstack((x, np.ones((len(x), 1), np.int64))))
        i, j = np.triu_indices(d + 1)
        values = total[i, j].tolist()
        limbs = [[v >> LIMB * k & (1 << LIMB) - 1 if k < LIMBS - 1 else v >> LIMB * k for v in values] for k in range(LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(x, pa.int64()) for x in limbs)], ["i", "j", *(f"l{k}" for k in range(LIMBS))])

    parts = fit.mapInArrow(add, "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    whole = np.zeros((d + 1, d + 1), object)
    for r in parts.groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).collect():  # the matrix
        whole[r.i, r.j] = whole[r.j, r.i] = sum(r[f"l{k}"] << LIMB * k for k in range(LIMBS))
    return whole[d, d], whole[d, :d].tolist(), whole[:d, :d]


def primes(bits: int) -> list[int]:
    """The greatest primes below 2^31, as many as their product needs to exceed `bits` bits."""
    found, p = [], 2**31 - 1
    while len(found) * 30 <= bits:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        if all(x in (1, p - 1) or any(pow(x, 2**k, p) == p - 1 for k in range(1, twos)) for x in (pow(a, odd, p) for a in (2, 3, 5, 7))):  # decides below 3.2e9
            found.append(p)
        p -= 2
    return found


def residues(matrix: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Characteristic polynomial modulo each prime, highest power first."""
    d, q = len(matrix), p[:, None]
    h = np.stack([(matrix % int(m)).astype(np.int64) for m in p])
    for c in range(d - 2):
        r = c + 1
        for k in np.flatnonzero((h[:, r, c] == 0) & h[:, r + 1 :, c].any(axis=1)):
            s = r + 1 + int(np.flatnonzero(h[k, r + 1 :, c])[0])
            h[k, [r, s]] = h[k, [s, r]]
            h[k][:, [r, s]] = h[k][:, [s, r]]
        inverse = np.array([pow(int(v), -1, int(m)) if v else 0 for v, m in zip(h[:, r, c], p, strict=True)])
        u = h[:, r + 1 :, c] * inverse[:, None] % q
        h[:, r + 1 :] = (h[:, r + 1 :] - u[:, :, None] * h[:, None, r] % q[:, :, None]) % q[:, :, None]
        h[:, :, r] = (h[:, :, r] + (u[:, None, :] * h[:, :, r + 1 :] % q[:, :, None]).sum(axis=2)) % q
    found = np.zeros((d + 1, len(p), d + 1), np.int64)  # of the leading blocks, constant term first
    found[0, :, 0] = 1
    for k in range(1, d + 1):
        found[k, :, 1:] = found[k - 1, :, :-1]
        factor = np.ones(len(p), np.int64)
        for i in range(k, 0, -1):
            found[k] = (found[k] - (h[:, i - 1, k - 1] * factor % p)[:, None] * found[i - 1]) % q
            if i > 1:
                factor = factor * h[:, i - 1, i - 2] % p
    return found[d][:, ::-1]


def characteristic(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Whole coefficients of a scatter's characteristic polynomial, highest power first; primes are dealt to tasks."""
    d, trace = len(matrix), sum(matrix.diagonal())
    bits = max(math.comb(d, k).bit_length() + k * (-(-trace // d)).bit_length() for k in range(d + 1)) + 1  # of elementary means
    p, shared = primes(bits), spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(0).to_numpy()
            for lo in range(0, len(mine), 16):
                some = mine[lo : lo + 16]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(residues(shared.value, some)), pa.list_(pa.int64()))], ["p", "residue"])

    dealt = spark.createDataFrame([(x,) for x in p], "p long").repartition(min(len(p), max(2, spark.sparkContext.defaultParallelism)), "p")
    product, total = math.prod(p), [0] * (d + 1)
    for r in dealt.mapInArrow(run, "p long, residue array<long>").collect():  # one polynomial for each prime
        unit = product // r.p * pow(product // r.p, -1, r.p)
        total = [t + c * unit for t, c in zip(total, r.residue, strict=True)]
    # no root is negative, so signs alternate
    return [t % product if k % 2 == 0 else -(-t % product) for k, t in enumerate(total)]


def changes(coefficients: list[int]) -> int:
    signs = [c > 0 for c in coefficients if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def roots_above(coefficients: list[int], a: int) -> int:
    """How many roots are greater than a, with multiplicities: all are real, so sign changes about a count them."""
    c = list(coefficients)
    for stop in range(len(c), 1, -1):
        for k in range(1, stop):
            c[k] += a * c[k - 1]
    return changes(c)


def greatest_roots(coefficients: list[int], many: int, shift: int) -> list[int]:
    """The `many` greatest positive roots times 2^shift, rounded up, falling; fewer if there are fewer."""
    c = [v << shift * k for k, v in enumerate(coefficients)]
    known = {0: changes(c)}

    def above(a: int) -> int:
        if a not in known:
            known[a] = roots_above(c, a)
        return known[a]

    def sign(a: int) -> int:
        v = 0
        for x in c:
            v = v * a + x
        return (v > 0) - (v < 0)

    top = -c[1] + 1  # no root is greater than the trace
    known[top] = 0
    found = []
    for k in range(1, min(many, known[0]) + 1):
        lo = max(a for a, n in known.items() if n >= k)
        hi = min(a for a, n in known.items() if n < k)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if known[lo] == k and known[hi] == k - 1:  # alone: the sign changes once
                if (s := sign(mid)) == 0:
                    hi = mid
                    while hi - lo > 1 and above(hi - 1) >= k:  # the root itself
                        lo = hi - 1
                    break
                inside = s == sign(hi) if sign(hi) else s == (-1) ** (k - 1)
                lo, hi = (lo, mid) if inside else (mid, hi)
                known[lo], known[hi] = k, k - 1
            elif above(mid) >= k:
                lo = mid
            else:
                hi = mid
        found.append(hi)
    return found


def null_vectors(matrix: np.ndarray, roots: list[int], shift: int) -> list[np.ndarray]:
    """Unit eigenvectors by inverse iteration about roots / 2^shift, each orthogonal to those before it. In a decimal context."""
    d, found = len(matrix), []
    whole = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
    for k, root in enumerate(roots):
        a = whole.copy()
        a[np.arange(d), np.arange(d)] -= (Decimal(root) - Decimal("0.5")) / Decimal(2) ** shift
        tiny, order = Decimal(2) ** -shift, list(range(d))
        for c in range(d):
            best = max(range(c, d), key=lambda r: abs(a[r, c]))
            a[[c, best]], order[c], order[best] = a[[best, c]], order[best], order[c]
            if not a[c, c]:
                a[c, c] = tiny
            a[c + 1 :, c] /= a[c, c]
            a[c + 1 :, c + 1 :] -= np.outer(a[c + 1 :, c], a[c, c + 1 :])
        v = np.array([Decimal((i + 1) * 7919 * (k + 3) % 10007 + 1) for i in range(d)], object)
        for _ in range(4):
            y = v[order]
            for c in range(d):
                y[c + 1 :] -= a[c + 1 :, c] * y[c]
            for c in range(d - 1, -1, -1):
                y[c] = (y[c] - (a[c, c + 1 :] * y[c + 1 :]).sum()) / a[c, c]
            for u in (*found, *found):
                y = y - (u * y).sum() * u
            v = y / (y * y).sum().sqrt()
        found.append(v)
    return found


def fitted(spark: SparkSession, matrix: np.ndarray, components: int) -> tuple[list[int], np.ndarray, list[float]]:
    """Of a scatter: projections onto unit eigenvectors over the root of the eigenvalue (a column each), and shares of the trace."""
    trace = sum(matrix.diagonal())
    shift = 96 + 3 * trace.bit_length()
    roots = greatest_roots(characteristic(spark, matrix), components, shift)
    with localcontext() as context:
        context.prec = 40 + (shift + trace.bit_length()) * 31 // 100
        vectors = null_vectors(matrix, roots, shift)
        scaled = [v / ((Decimal(r) - Decimal("0.5")) / Decimal(2) ** shift).sqrt() for v, r in zip(vectors, roots, strict=True)]
        shares = [float(Decimal(r) / Decimal(2) ** shift / Decimal(trace)) for r in roots]
    return roots, np.array([[float(x) for x in v] for v in scaled]).T.reshape(len(matrix), len(roots)), shares


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component."""
    spark = rows.sparkSession
    finite = F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    good = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).filter(finite)
    empty = spark.createDataFrame([], RESULT + ", identity_error double")
    d = good.agg(F.max(F.size("v")).alias("d")).first().d
    if not d:
        return empty

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in _vectors(batch, 0, d).astype("<i8")], pa.binary())], ["x"])

    fit = written(good.select("v").mapInArrow(whole, "x binary").distinct(), "fit")
    n, sums, products = _sums(fit, d)
    matrix = n * products - np.outer(np.array(sums, object), np.array(sums, object))
    if not sum(matrix.diagonal()):
        return empty
    _, project, shares = fitted(spark, matrix, components)
    most = max(map(abs, sums))

    def centred(x: np.ndarray) -> np.ndarray:
        small = n * int(max(x.max(initial=0), -x.min(initial=0))) + most < 1 << 62
        return n * x - np.array(sums, np.int64) if small else n * x.astype(object) - np.array(sums, object)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = centred(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(batch.num_rows, d)).astype(np.float64) @ project
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in w.T], [f"w{k}" for k in range(len(shares))])

    pairs = [(i, j) for i in range(len(shares)) for j in range(i + 1)]
    w = fit.mapInArrow(measure, ", ".join(f"w{k} double" for k in range(len(shares))))
    error = w.agg(F.greatest(*(F.abs(F.covar_pop(f"w{i}", f"w{j}") - int(i == j)) for i, j in pairs), F.lit(0.0)).alias("e")).first().e

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shares)
        for batch in batches:
            c = centred(_vectors(batch, 1, d))
            exact = c if c.dtype == object or int(np.abs(c).max(initial=0)) ** 2 * d < 1 << 63 else c.astype(object)
            deviation = [None if v >= 1 << 63 else int(v) for v in (exact * exact).sum(axis=1)]
            ids = [i for i in batch.column(0).to_pylist() for _ in range(k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.tile(np.arange(1, k + 1), batch.num_rows), pa.int32()), pa.array([n] * len(ids), pa.int64()), pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                 pa.array((c.astype(np.float64) @ project).ravel()), pa.array(np.tile(shares, batch.num_rows))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return good.mapInArrow(finish, RESULT).withColumn("identity_error", F.lit(float(error)))
