"""Whitening of embeddings by incremental eigendecomposition.

The scatter of rows around their mean is kept as a spectrum: mean, eigenvalues, eigenvectors. A new row v changes it by
one matrix of rank one, k / (k + 1) * (v - mean)(v - mean)', for k rows so far. With z the row in the eigenvectors' axes the
new eigenvalues are the roots of the secular equation 1 + rho * sum z_i^2 / (d_i - t) = 0, one between each two old ones;
entries of z that are nearly zero and eigenvalues that are nearly equal are deflated first. Vectors are taken from the z
for which the roots found are exact, so they stay orthogonal. Partitions of the fit list make a spectrum each; two
spectra combine by one such update for each eigenvector of the smaller and one for the difference of the means; a tree of
tasks combines all.

The vectors found so far are then refined: the covariance is projected on them in a pass over all rows, centred before
anything is multiplied, and the small matrix, which is nearly diagonal, is solved (Rayleigh-Ritz). As all dimensions are
kept, that gives eigenvectors of the covariance to double precision.

Rows that are a third of all, or copies, meet in the fit list as one; a pass sends a few numbers a partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table
from .vectors import common_width, floored, packed_rows, unpacked

SCALE, ORIGIN, COMPONENTS = 64.0, 1_000_000, 16
#: How many spectra or matrices one task combines.
FAN_IN = 32
EPS = np.finfo(float).eps


def roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The secular equation's roots for strictly rising d, positive z2 and rho: (t, gap), gap[i, j] = d_i - t_j.

    Root j lies between d_j and the next d, or, for the last, d_j + rho * sum z2. It is sought from the nearer of the two,
    so that the gaps keep their digits, within a bracket that shrinks: each step solves the equation with the two
    nearest poles as they are and the others' value and slope (Newton's step is the case without poles).
    """
    k, total = len(d), np.add.reduce
    upper = np.append(d[1:], d[-1] + rho * z2.sum())
    half = (upper - d) / 2
    weight = (rho * z2)[:, None]
    apart = d[:, None] - d
    f = 1 + total(weight / (apart - half), 0)
    left = f >= 0  # the root is at or before the middle
    right_end = ~left
    right_end[-1] = False
    origin = np.where(right_end, upper, d)
    low, high = np.where(right_end, -half, 0.0), np.where(right_end, 0.0, half)
    if not left[-1]:
        low[-1], high[-1] = half[-1], 2 * half[-1]
    from_origin = d[:, None] - origin
    own, beyond = np.arange(k), np.minimum(np.arange(1, k + 1), k - 1)
    t, active = (low + high) / 2, own
    seen, w_own, w_beyond, at_own, at_beyond = from_origin, weight[own, 0], weight[beyond, 0], d - origin, d[beyond] - origin
    w_beyond[-1] = 0
    with np.errstate(all="ignore"):
        # first guess: all poles but the two nearest weigh as they do in the middle of the interval
        c, a, b = f + w_own / half - w_beyond / half, at_own, at_beyond
        m, n = c * (a + b) + w_own + w_beyond, c * a * b + w_own * b + w_beyond * a
        m += np.copysign(np.sqrt(np.maximum(m * m - 4 * c * n, 0)), m)
        s, other = 2 * n / m, m / (2 * c)
        t = np.where((s > low) & (s < high), s, np.where((other > low) & (other < high), other, t))
        result = t.copy()
        for _ in range(40):
            inverse = 1 / (seen - t)
            w = weight * inverse
            f, slope = 1 + total(w, 0), total(w * inverse, 0)
            result[active] = t
            open_ = (np.abs(f) > 1e-13 * np.abs(t) * slope) & (high - low > 4 * EPS * np.abs(t))
            if not open_.any():
                break
            if open_.sum() < 0.7 * len(active):
                active, t, f, slope, low, high, w_own, w_beyond, at_own, at_beyond = (x[open_] for x in (active, t, f, slope, low, high, w_own, w_beyond, at_own, at_beyond))
                seen = np.ascontiguousarray(seen[:, open_])
            low, high = np.where(f < 0, t, low), np.where(f > 0, t, high)
            a, b = at_own - t, at_beyond - t  # the poles on both sides: a < 0 < b
            rest = slope - w_own / (a * a) - w_beyond / (b * b)  # the slope of all others, given to the nearer pole
            to_own = -a < b
            p, q = w_own + np.where(to_own, rest * a * a, 0), w_beyond + np.where(to_own, 0, rest * b * b)
            c = f - p / a - q / b
            # c + p / (a - s) + q / (b - s) = 0
            m, n = c * (a + b) + p + q, f * a * b
            m += np.copysign(np.sqrt(np.maximum(m * m - 4 * c * n, 0)), m)
            s, other = t + 2 * n / m, t + m / (2 * c)
            if active[-1] == k - 1:  # no pole beyond the last
                s[-1] = t[-1] + a[-1] * f[-1] / (f[-1] - slope[-1] * a[-1])
            t = np.where((s >= low) & (s <= high), s, np.where((other >= low) & (other <= high), other, (low + high) / 2))
    return origin + result, from_origin - result


class Spectrum(NamedTuple):
    """n rows around their mean: scatter = vectors @ diag(values) @ vectors', values rising."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def nothing(width: int) -> Spectrum:
    return Spectrum(0, np.zeros(width), np.zeros(width), np.eye(width))


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of vectors @ diag(values) @ vectors' + rho * v v'; rho is not negative."""
    z = v @ vectors
    size = max(abs(values[-1]), abs(values[0]), rho * (z @ z))
    if rho * (z @ z) <= EPS * size:
        return values, vectors
    close = np.flatnonzero(np.diff(values) <= 8 * EPS * size)
    if len(close):  # equal eigenvalues: turn their vectors so that one of them alone meets v
        vectors, first = vectors.copy(), np.r_[True, np.diff(close) > 1]
        for start, stop in zip(close[first], close[np.r_[first[1:], True]] + 2, strict=True):
            part = z[start:stop].copy()
            norm = np.linalg.norm(part)
            mirror = part.copy()
            mirror[-1] += math.copysign(norm, part[-1])
            square = mirror @ mirror
            if square > 0:
                block = vectors[:, start:stop]
                vectors[:, start:stop] = block - np.outer(block @ mirror, 2 / square * mirror)
                z[start:stop] = 0
                z[stop - 1] = -math.copysign(norm, part[-1])
    live = rho * z * z > (8 * EPS) ** 2 * size  # the rest stay what they are
    at = np.flatnonzero(live)
    if len(at) == 0:
        return values, vectors
    d, zl = values[at], z[at]
    if len(at) == 1:
        new = d + rho * zl * zl
        moved = vectors[:, at]
    else:
        new, gap = roots(d, zl * zl, rho)
        # the z for which these roots are exact: rho z_i^2 = prod_j (t_j - d_i) / prod_{j != i} (d_j - d_i), factor by factor
        apart = d[:, None] - d
        apart[np.arange(len(at)), np.arange(len(at))] = -1.0
        z2 = np.abs(np.multiply.reduce(gap / apart, 1))
        turned = np.copysign(np.sqrt(z2), zl)[:, None] / gap
        turned /= np.sqrt(np.add.reduce(turned * turned, 0))
        moved = vectors[:, at] @ turned
    if len(at) == len(values):
        return new, moved
    values, vectors = values.copy(), vectors.copy()
    values[at], vectors[:, at] = new, moved
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def with_row(s: Spectrum, row: np.ndarray) -> Spectrum:
    """s with one row more."""
    off = row - s.mean
    values, vectors = rank_one(s.values, s.vectors, off, s.n / (s.n + 1))
    return Spectrum(s.n + 1, s.mean + off / (s.n + 1), values, vectors)


def combined(a: Spectrum, b: Spectrum) -> Spectrum:
    """The spectrum of the rows of both: the smaller's eigenvectors, and the way between the means, one after the other."""
    a, b = (a, b) if a.n >= b.n else (b, a)
    if b.n == 0:
        return a
    values, vectors = a.values, a.vectors
    for value, v in zip(b.values, b.vectors.T, strict=True):
        if value > 0:
            values, vectors = rank_one(values, vectors, v, value)
    off, n = b.mean - a.mean, a.n + b.n
    values, vectors = rank_one(values, vectors, off, a.n * b.n / n)
    return Spectrum(n, a.mean + off * (b.n / n), values, vectors)


def _tree(rows: RDD, join):
    """All of rows joined, FAN_IN at a time; None if there are none. The driver joins FAN_IN at most, or about."""
    parts = rows.getNumPartitions()
    depth = max(2, math.ceil(math.log(max(parts, 2), FAN_IN)))
    return rows.treeAggregate(None, lambda a, b: b if a is None else join(a, b), lambda a, b: a if b is None else b if a is None else join(a, b), depth)


class Whitening(NamedTuple):
    """Of n vectors x with the exact sums of x - ORIGIN: unit axes as columns, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([math.fsum((s // self.n, (s % self.n) / self.n)) for s in self.sums])


def _partition_sums(fit: DataFrame, width: int, of) -> RDD:
    """An RDD of what of(matrix of a batch) gives, added up within each partition."""

    def sums(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in given:
            if batch.num_rows:
                part = of(unpacked(batch.column(0), width).astype(float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

    return fit.select("x").mapInArrow(sums, "m binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])))


def fit_list(df: DataFrame, vector_col: str, width: int, scale: float = SCALE) -> DataFrame:
    """x: each distinct vector floor(scale * c) once, packed, written in the shared folder.

    Copies within a batch are gone before the shuffle, so that a vector that is a third of all rows is a row a batch. The
    number of partitions is stated, as Spark would join them by size, and an update of a spectrum takes longer than a row's reading.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def once(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            yield pa.RecordBatch.from_arrays([batch.column(0).unique()], ["x"])

    return cut_lineage(packed_rows(df, vector_col, width, scale).mapInArrow(once, "x binary").repartition(parts, "x").distinct())


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list of packed vectors; None if it has no row. At most components axes, of positive eigenvalue."""

    def spectra(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = nothing(width), np.zeros(width, object)
        for batch in given:
            whole = unpacked(batch.column(0), width)
            sums = sums + whole.sum(0, dtype=np.int64).astype(object)
            for row in whole.astype(float):
                own = with_row(own, row)
        if own.n:
            numbers = np.concatenate([own.mean, own.values, own.vectors.ravel()])
            yield pa.RecordBatch.from_pydict({"n": pa.array([own.n], pa.int64()), "sums": pa.array([[str(x) for x in sums]], pa.list_(pa.string())), "m": pa.array([numbers.tobytes()], pa.binary())})

    def read(row) -> tuple:
        m = np.frombuffer(bytes(row[2]))
        return row[0], np.array([int(x) for x in row[1]], object), Spectrum(row[0], m[:width], m[width : 2 * width], m[2 * width :].reshape(width, width))

    found = _tree(rows.select("x").mapInArrow(spectra, "n long, sums array<string>, m binary").rdd.map(read), lambda a, b: (a[0] + b[0], a[1] + b[1], combined(a[2], b[2])))
    if found is None:
        return None
    n, sums, start = found
    model = Whitening(n, tuple(sums.tolist()), start.values[::-1], np.linalg.qr(start.vectors[:, ::-1])[0], 0.0, 0.0)
    axes, mean = model.axes, model.mean

    def projected(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ axes
        return (y.T @ y).ravel()

    small = _tree(_partition_sums(rows, width, projected), np.add).reshape(width, width) / n
    values, turned = np.linalg.eigh((small + small.T) / 2)
    values, axes = values[::-1], axes @ turned[:, ::-1]
    trace = float(np.trace(small))
    kept = min(components, int((values > max(trace, 0) * width * EPS * 16).sum()))
    model = model._replace(values=values[:kept].copy(), axes=np.ascontiguousarray(axes[:, :kept]), trace=trace)
    if kept:
        white = model.axes / np.sqrt(model.values)
        seen = _tree(_partition_sums(rows, width, lambda x: ((y := (x - mean) @ white).T @ y).ravel()), np.add).reshape(kept, kept) / n
        model = model._replace(identity_error=float(np.abs(seen - np.eye(kept)).max()))
    return model


def deviations(model: Whitening, whole: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 of each row, exact; None where it doesn't fit a long."""
    n, sums = model.n, np.array(model.sums, object)
    largest = max(int(np.abs(whole).max(initial=0)) * n + max(map(abs, model.sums)), 1)
    if largest * largest * whole.shape[1] < 2**63:
        off = n * whole.astype(np.int64) - sums.astype(np.int64)
        return (off * off).sum(1).tolist()
    return [k if k < 2**63 else None for k in ((n * row - sums) ** 2 for row in whole.astype(object)) for k in [int(k.sum())]]


def whiten(df: DataFrame, model: Whitening | None, vector_col: str, carried: tuple[str, ...], width: int, scale: float = SCALE) -> DataFrame:
    """The carried columns, component, n, deviation, whitened, explained, identity_error: a row for each row of df that
    takes part and each component of the model, none without a model. No shuffle; the model is as large as its axes."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*carried).schema.fields]
    schema = ", ".join([*fields, "component int", "n long", "deviation long", "whitened double", "explained double", "identity_error double"])
    names = [*carried, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    k = 0 if model is None else len(model.values)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if k == 0:
            return
        mean, white = model.mean, model.axes / np.sqrt(model.values)
        for batch in given:
            kept, whole = floored(batch, vector_col, width, scale)
            rows = np.repeat(kept, k)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(rows)) for c in carried),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(kept))),
                    pa.array(np.full(len(rows), model.n, np.int64)),
                    pa.array(deviations(model, whole), pa.int64()).take(pa.array(np.repeat(np.arange(len(kept)), k))),
                    pa.array(((whole - mean) @ white).ravel()),
                    pa.array(np.tile(model.values / model.trace, len(kept))),
                    pa.array(np.full(len(rows), model.identity_error)),
                ],
                names,
            )

    return df.select(*carried, vector_col).mapInArrow(batches, schema)


def whitened_rows(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of all rows of df that take part.

    Rows take no part whose vector is null, holds null or non-finite entries, has another number of entries than most, or
    an entry c with |64 c| of 2^28 or more, for which the sums aren't exact. Equal vectors count once in the fit list and
    come out alike; repeated and null ids come out as they are; other columns are dropped, whatever their names. Axes
    without variance are left out, so fewer than components come out where the vectors span less, and no row at all where
    all are equal or the table is empty. A deviation that doesn't fit a long is null. The n of a table follows from its
    vectors alone, so ties of eigenvalues, which leave the axes open, are the only thing that may differ between two runs.
    """
    width = common_width(df, vector_col)
    named = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    model = fit(fit_list(named, "vector", width), width, components) if width else None
    return whiten(named, model, "vector", ("vec_id",), width)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(table(spark, sf_dir, "embeddings"))
