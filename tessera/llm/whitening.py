"""Whitening of vectors: principal components of unit variance, from a covariance in double-double arithmetic.

Two numbers hold one: hi and what hi can't hold, lo. Sums of vectors, and the products of vectors from which the mean was
taken, are kept that way throughout: every task adds its rows up by error-free sums, and the tasks' (hi, lo) are merged in
rounds of a bounded fan-in. For the outer products a strip of centred rows is cut into slices of 20 bits, by error-free
subtraction: products of slices are whole numbers of at most 53 bits in some unit, so that a product of matrices gives
their sums without any rounding, and only the (hi, lo) that they are added to rounds. The covariance has as many numbers
as the square of the dimensions, a bounded parameter, and is solved on the driver by tridiagonal divide and conquer
(LAPACK's dsyevd).

Vectors are read three times to fit (sums, covariance, covariance of what was whitened) and once to transform; nothing but
sums leaves a task.

Defined cases: null vectors and those with null, NaN, infinite or enormous (2 ** 46 and more) components are left out, and
so are those whose length is not the commonest one (of equally common ones the longest counts); components whose variance
is not above the rounding errors of the largest one have no unit variance, and are left out; with fewer than two different
vectors there are none. Ids may repeat or be null: each row is projected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, forget, stored

MOST_DIMS, LARGEST = 2048, float(1 << 46)
#: Rows whose products are summed without rounding: 2 * BITS + log2(STRIP) must not exceed 53.
STRIP, BITS, SLICES = 4096, 20, 3
#: Parts that one task merges.
FAN_IN = 64
_PART = "d int, slot int, part bigint, n bigint, hi binary, lo binary"


def two_sum(a, b):
    """a + b and its rounding error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a, b):
    """The sum of two double-doubles (hi, lo)."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def column_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the columns, by halves."""
    hi, lo = x, np.zeros_like(x)
    while len(hi) > 1:
        half = len(hi) // 2
        a, b = add((hi[:half], lo[:half]), (hi[half : 2 * half], lo[half : 2 * half]))
        hi, lo = (np.concatenate([u, v[2 * half :]]) for u, v in ((a, hi), (b, lo)))
    return hi[0], lo[0]


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return add((x, np.zeros_like(x)), (-mean[0], -mean[1]))


def _slices(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """x as a sum of matrices, in each of which a column's entries are multiples of at most 2 ** BITS of one unit; and the rest."""
    top = np.abs(x).max(axis=0)
    unit = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0))))
    out = []
    for _ in range(SLICES):
        unit = unit * 2.0**-BITS
        big = unit * (1.5 * 2.0**52)
        out.append((x + big) - big)  # rounded to a multiple of unit
        x = x - out[-1]  # exact
    return out, x


def products(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum over rows of the outer product of hi + lo with itself, as a double-double."""
    total = (np.zeros((hi.shape[1],) * 2),) * 2
    for s in range(0, len(hi), STRIP):
        slices, rest = _slices(hi[s : s + STRIP])
        tail = rest + lo[s : s + STRIP]
        cross = hi[s : s + STRIP].T @ tail
        for a in slices:
            for b in slices:
                total = add(total, (a.T @ b, 0.0))
        total = add(total, (cross + cross.T, 0.0))
    return total


def _numbers(column: pa.Array) -> Iterator[np.ndarray]:
    """A matrix of the vectors of each length; there are no nulls among them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    sizes, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        yield flat[offsets[:-1][sizes == d][:, None] + np.arange(d)[None, :]]


def usable(vector: Column) -> Column:
    """Whether a vector has neither null nor non-finite nor enormous components."""
    bad = F.exists(vector, lambda c: F.coalesce(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) >= LARGEST), F.lit(True)))
    return F.coalesce(~bad, F.lit(False))


def _merged(parts: DataFrame) -> DataFrame:
    """Partial sums (_PART), merged to one row for each d and slot: rounds of FAN_IN parts a task, in the order of parts."""

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("part").combine_chunks()
        total = (0.0, 0.0)
        for h, x in zip(t["hi"].to_pylist(), t["lo"].to_pylist(), strict=True):
            total = add(total, (np.frombuffer(h), np.frombuffer(x)))
        return pa.table({"d": t["d"][:1], "slot": t["slot"][:1], "part": t["to"][:1], "n": pa.array([sum(t["n"].to_pylist())], "int64"), "hi": [total[0].tobytes()], "lo": [total[1].tobytes()]})

    parts, last = stored(parts, "white-sums"), -1
    while last != 0:
        most = parts.agg(F.max("part")).first()[0] or 0
        merged = parts.withColumn("to", F.floor(F.col("part") / FAN_IN).cast("bigint")).groupBy("d", "slot", "to").applyInArrow(merge, _PART)
        last = most // FAN_IN
        merged = stored(merged, "white-sums")
        forget(parts)
        parts = merged
    return parts


def _matrix(parts: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged rows of a matrix of d columns, at most MOST_DIMS of them."""
    rows = {r["slot"]: r for r in parts.where(F.col("d") == d).collect()}
    forget(parts)
    return tuple(np.stack([np.frombuffer(rows[i][x]) for i in sorted(rows)]) for x in ("hi", "lo"))


def _rows(n: int, matrices: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    hi, lo = matrices
    d, part = hi.shape[1], TaskContext.get().partitionId()
    return pa.RecordBatch.from_pydict({
        "d": pa.array([d] * len(hi), "int32"), "slot": pa.array(range(len(hi)), "int32"), "part": pa.array([part] * len(hi), "int64"), "n": pa.array([n] * len(hi), "int64"),
        "hi": pa.array([x.tobytes() for x in hi]), "lo": pa.array([x.tobytes() for x in lo]),
    })


def _over(total: tuple, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A double-double divided by a whole number."""
    exact = [Fraction(float(a)) + Fraction(float(b)) for a, b in zip(np.ravel(total[0]), np.ravel(total[1]), strict=True)]
    hi = np.array([float(x / n) for x in exact])
    lo = np.array([float(x / n - Fraction(h)) for x, h in zip(exact, hi.tolist(), strict=True)])
    return hi.reshape(np.shape(total[0])), lo.reshape(np.shape(total[0]))


@dataclass
class Whitening:
    """n vectors with the exact sums (hi, lo) and mean; axes are unit eigenvectors as columns, by falling variance."""

    n: int
    sums: tuple[np.ndarray, np.ndarray]
    mean: tuple[np.ndarray, np.ndarray]
    axes: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def dims(self) -> int:
        return len(self.mean[0])

    def project(self, x: np.ndarray) -> np.ndarray:
        hi, lo = centred(x, self.mean)
        return (hi @ self.axes + lo @ self.axes) / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """For whole numbers the sum over dimensions of (n x - sum) ** 2, exactly; None where it exceeds a long."""
        sums = [Fraction(float(a)) + Fraction(float(b)) for a, b in zip(*self.sums, strict=True)]
        if any(s.denominator != 1 for s in sums) or not (x == np.floor(x)).all():
            return [None] * len(x)
        whole = [int(s) for s in sums]
        far = max([abs(int(x.max()) * self.n - s) for s in whole] + [abs(int(x.min()) * self.n - s) for s in whole]) if x.size else 0
        small = far * far * max(1, self.dims) < 1 << 62 and max(map(abs, [*whole, int(np.abs(x).max()) * self.n if x.size else 0])) < 1 << 62
        kind = np.int64 if small else object
        away = x.astype(np.int64).astype(kind) * self.n - np.array(whole, kind)
        return [int(t) if t < 1 << 63 else None for t in (away * away).sum(axis=1)] if x.shape[1] else [0] * len(x)


def fit(vectors: DataFrame, vector_col: str, components: int = 32) -> Whitening | None:
    """Fitted on all usable vectors; None where there are none."""
    told = vectors.where(usable(column(vector_col))).select(column(vector_col).cast("array<double>").alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for x in _numbers(batch.column(0)):
                n, total = held.get(x.shape[1], (0, (0.0, 0.0)))
                held[x.shape[1]] = (n + len(x), add(total, column_sums(x)))
        for n, total in held.values():
            yield _rows(n, (total[0][None, :], total[1][None, :]))

    found = _merged(told.mapInArrow(sums, _PART))
    most = found.orderBy(F.desc("n"), F.desc("d")).first()
    forget(found)
    if most is None:
        return None
    n, d = most["n"], most["d"]
    if d > MOST_DIMS:
        raise ValueError(f"vectors have {d} components; at most {MOST_DIMS} are supported")
    total = np.frombuffer(most["hi"]), np.frombuffer(most["lo"])
    mean = _over(total, n)
    own = told.where(F.size("v") == d)

    def outer(of) -> DataFrame:
        """Sums of outer products of what `of` makes of the vectors (a double-double), and of the rows themselves as the last row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, held, ones = 0, (0.0, 0.0), (0.0, 0.0)
            for batch in batches:
                for x in _numbers(batch.column(0)):
                    hi, lo = of(x)
                    seen, held, ones = seen + len(x), add(held, products(hi, lo)), add(ones, add(column_sums(hi), column_sums(lo)))
            if seen:
                yield _rows(seen, tuple(np.concatenate([a, b[None, :]]) for a, b in zip(held, ones, strict=True)))

        return _merged(own.mapInArrow(run, _PART))

    if d == 0:
        return Whitening(n, total, mean, np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    hi, lo = _matrix(outer(lambda x: centred(x, mean)), d)
    cov = np.add(*_over((hi[:-1], lo[:-1]), n))
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    real = values > max(values[0], 0) * d * np.finfo(float).eps
    k = min(components, int(real.sum()))
    values, axes = values[:k], axes[:, :k]
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)]) if k else np.ones(0)
    made = Whitening(n, total, mean, np.ascontiguousarray(axes * sign), values, values / max(np.trace(cov), np.finfo(float).tiny), 0.0)
    if k:
        hi, lo = _matrix(outer(lambda x: ((w := made.project(x)), np.zeros_like(w))), k)
        centre = hi[-1] / n
        made.identity_error = float(np.abs(hi[:-1] / n - np.outer(centre, centre) - np.eye(k)).max())
    return made


def transform(vectors: DataFrame, made: Whitening | None, id_col: str, vector_col: str) -> DataFrame:
    """A row for each usable vector and component: id, component (from 1), n, deviation (exact for whole numbers, else null),
    whitened, explained and identity_error."""
    names = (id_col, "component", "n", "deviation", "whitened", "explained", "identity_error")
    kinds = (vectors.schema[id_col].dataType.simpleString(), "int", "bigint", "bigint", "double", "double", "double")
    schema = ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))
    if made is None or not len(made.variances):
        return vectors.sparkSession.createDataFrame([], schema).toDF(*names)
    own = vectors.where(usable(column(vector_col)) & (F.size(column(vector_col)) == made.dims)).select(column(id_col).alias("i"), column(vector_col).cast("array<double>").alias("v"))
    k = len(made.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, STRIP):
                batch = whole.slice(a, STRIP)
                x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, made.dims)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                far = pa.array(made.deviations(x), "int64")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), made.n, np.int64)), far.take(each),
                    pa.array(made.project(x).ravel()), pa.array(np.tile(made.explained, len(x))), pa.array(np.full(len(each), made.identity_error)),
                ], names=[f"c{i}" for i in range(7)])

    return own.mapInArrow(run, schema).toDF(*names)
