"""Whitened embeddings: the leading eigenvectors of the covariance, found by spectrum slicing.

Spark adds up integers only, so moments are exact whatever the order of tasks; what the driver holds is
one matrix of dimension by dimension. There, for a shift s, the signs of D in LDLᵀ = V - sI count the
eigenvalues above s (Sylvester's law of inertia). Bisection on these counts gives every leading eigenvalue
an interval of its own, Rayleigh quotient iteration converges inside it, and two more counts certify the
number of the value found. Values that no shift can part are a cluster: its space is found by
block inverse iteration, and a Rayleigh-Ritz step orders it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import documents

# Fixed point of the entries: x = floor(SCALE * c) + ORIGIN.
SCALE, ORIGIN = 64, 1_000_000
# Entries beyond this size have no exact fixed point in doubles.
LARGEST = float(1 << 52)
ALPHA = (1 + 17**0.5) / 8


# ---------------------------------------------------------------- eigenvalues


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``matrix`` above ``shift``: positive pivots of LDLᵀ, with pivoting by Bunch and Parlett."""
    a = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(a):
        size = np.abs(a)
        one = int(np.argmax(np.diag(size)))
        p, q = divmod(int(np.argmax(size)), len(a))
        if size[p, q] == 0:
            break
        if size[one, one] >= ALPHA * size[p, q]:
            order = [one, *(i for i in range(len(a)) if i != one)]
            a = a[np.ix_(order, order)]
            positive += a[0, 0] > 0
            column = a[1:, 0]
            a = a[1:, 1:] - np.outer(column / a[0, 0], column)
        else:
            # A pivot of two rows with a dominant entry beside the diagonal has one value of each sign.
            order = [p, q, *(i for i in range(len(a)) if i not in (p, q))]
            a = a[np.ix_(order, order)]
            positive += 1
            columns = a[2:, :2]
            a = a[2:, 2:] - columns @ np.linalg.solve(a[:2, :2], columns.T)
        a = (a + a.T) / 2
    return positive


@dataclass(frozen=True)
class Spectrum:
    """Leading eigenvalues (falling), unit eigenvectors as columns, and for each the counts that certify it.

    ``above`` and ``within``: eigenvalues above the upper end of its interval, and inside it.
    """

    values: np.ndarray
    vectors: np.ndarray
    above: np.ndarray
    within: np.ndarray


def _intervals(matrix: np.ndarray, count: int, narrow: float) -> list[tuple[float, float, int, int]]:
    """(low, high, above, within) of the leading eigenvalues: one in each interval, or a cluster no wider than ``narrow``."""
    reach = np.abs(matrix).sum(axis=1).max() * (1 + 1e-12) + 1e-300  # Gershgorin
    open_ = [(-reach, reach, len(matrix), 0)]  # low, high, values above low, values above high
    done = []
    while open_:
        low, high, many, few = open_.pop()
        if many == few or few >= count:
            continue
        if many - few == 1 or high - low <= narrow:
            done.append((low, high, few, many - few))
            continue
        mid = (low + high) / 2
        between = min(max(inertia(matrix, mid), few), many)
        open_ += [(low, mid, many, between), (mid, high, between, few)]
    return sorted(done, key=lambda i: i[2])


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, noise: float) -> np.ndarray:
    """Solution of (matrix - shift I) y = right; an exactly singular system is shifted by rounding noise."""
    eye = np.eye(len(matrix))
    for nudge in (0.0, noise, 16 * noise, 256 * noise):
        try:
            found = np.linalg.solve(matrix - (shift + nudge) * eye, right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    raise ArithmeticError("the shifted matrix cannot be solved")


def _single(matrix, low, high, above, start, noise) -> tuple[float, np.ndarray]:
    """The one eigenpair of an interval by Rayleigh quotient iteration; bisection narrows until it stays inside."""
    for _ in range(200):
        vector, shift = start, (low + high) / 2
        for step in range(12):
            vector = _solve(matrix, shift, vector, noise)
            vector /= np.linalg.norm(vector)
            value = float(vector @ matrix @ vector)
            if np.linalg.norm(matrix @ vector - value * vector) <= 8 * noise:
                break
            # Two steps of inverse iteration at the middle turn the vector to the interval's own.
            shift = value if step >= 1 and low < value < high else shift
        if low < value <= high and np.linalg.norm(matrix @ vector - value * vector) <= 64 * noise:
            return value, vector
        mid = (low + high) / 2
        if not low < mid < high:
            break
        low, high = (mid, high) if inertia(matrix, mid) > above else (low, mid)
    return value, vector


def leading(matrix: np.ndarray, count: int) -> Spectrum:
    """The ``count`` largest eigenvalues of a symmetric matrix with their vectors (all, if it has fewer)."""
    n = len(matrix)
    count = min(count, n)
    norm = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0
    if not norm:
        return Spectrum(np.zeros(count), np.eye(n)[:, :count], np.arange(count), np.ones(count, np.int64))
    noise = np.finfo(float).eps * norm * max(1, n**0.5)
    rng = np.random.default_rng(12)
    pairs: list[tuple[float, np.ndarray, int, int]] = []
    for low, high, above, within in _intervals(matrix, count, 1e3 * noise):
        if within == 1:
            pairs.append((*_single(matrix, low, high, above, rng.standard_normal(n), noise), above, 1))
            continue
        space = np.linalg.qr(rng.standard_normal((n, within)))[0]
        for _ in range(4):
            space = np.linalg.qr(_solve(matrix, high + noise, space, noise))[0]
        small = space.T @ matrix @ space
        values, turn = np.linalg.eigh((small + small.T) / 2)
        pairs += [(float(v), space @ turn[:, i], above, within) for i, v in reversed(list(enumerate(values)))]
    pairs = pairs[:count]
    vectors = np.stack([p[1] for p in pairs], axis=1)
    # Vectors of different values are orthogonal up to rounding over their gap; one sweep takes the rest off.
    for i in range(vectors.shape[1]):
        for _ in range(2):
            vectors[:, i] -= vectors[:, :i] @ (vectors[:, :i].T @ vectors[:, i])
        vectors[:, i] /= np.linalg.norm(vectors[:, i])
    return Spectrum(np.array([p[0] for p in pairs]), vectors, np.array([p[2] for p in pairs]), np.array([p[3] for p in pairs]))


# ---------------------------------------------------------------- rows


def _fixed(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their x as a matrix) by length, without rows that are null or hold null or non-finite entries."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(pa.compute.list_value_length(column).fill_null(0))
    flat = np.asarray(column.flatten().fill_null(np.nan))
    starts = np.cumsum(lengths) - lengths
    good = np.abs(flat) < LARGEST / SCALE
    bad = np.concatenate([[0], np.cumsum(~good)])
    kept = (lengths > 0) & (bad[starts + lengths] == bad[starts])
    for length in np.unique(lengths[kept]).tolist():
        rows = np.flatnonzero(kept & (lengths == length))
        entries = flat[starts[rows][:, None] + np.arange(length)]
        yield rows, np.floor(SCALE * entries).astype(np.int64) + ORIGIN


PART = 4096


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of bounded size with the rows kept in them."""
    for batch in batches:
        for start in range(0, batch.num_rows, PART):
            part = batch.slice(start, PART)
            for rows, x in _fixed(part.column("embedding")):
                yield part, rows, x


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length: number of vectors and sum of each dimension."""
    total: dict[int, list] = {}
    for _, rows, x in _vectors(batches):
        held = total.setdefault(x.shape[1], [0, 0])
        held[0] += len(rows)
        held[1] = held[1] + x.astype(object).sum(axis=0) if np.abs(x).max() > 1 << 40 else held[1] + x.sum(axis=0).astype(object)
    for length, (n, sums) in total.items():
        names = ["length", "dim", "n", "s"]
        yield pa.record_batch([pa.array([length] * length), pa.array(range(length)), pa.array([n] * length), _decimals(sums)], names)


def _products(length: int, centre: list[int]):
    """Per task, the sums of products of z = x - centre, upper triangle by rows."""
    upper = np.triu_indices(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = np.array(centre, np.int64)
        total = np.zeros((length, length), object)
        for _, _, x in _vectors(batches):
            if x.shape[1] != length:
                continue
            z = x - middle
            if np.abs(z).max() < 1 << 20:  # sums of 4,096 products stay below 2^53: exact in doubles
                z = z.astype(float)
                total += (z.T @ z).astype(np.int64).astype(object)
            else:
                z = z.astype(object)
                total += z.T.dot(z)
        if total.any():
            yield pa.record_batch([pa.array(np.arange(len(upper[0]))), _decimals(total[upper])], ["cell", "s"])

    return run


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: of ``n`` vectors with ``sums`` per dimension, ``components`` as rows over sqrt(e)."""

    n: int
    sums: list[int]
    spectrum: Spectrum
    explained: list[float]
    identity_error: float | None = None

    def components(self) -> np.ndarray:
        """Vectors over the root of their values; a component without variance has none (NaN)."""
        values = self.spectrum.values
        some = values > 1e-12 * max(float(values.max(initial=0.0)), 1e-300)
        roots = np.sqrt(np.where(some, values, 1.0))
        return np.where(some[:, None], self.spectrum.vectors.T / roots[:, None], np.nan)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows: x - S/n, by the quotient and remainder of S so that no digits are lost."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return ((x - whole).astype(float) - rest) @ self.components().T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2; None where a long cannot hold it."""
        sums = np.array(self.sums, object)
        reach = max(abs(int(self.n * int(x.max()) - min(self.sums))), abs(int(self.n * int(x.min()) - max(self.sums))))
        if reach * reach * x.shape[1] < 1 << 63 and max(abs(s) for s in self.sums) < 1 << 62:
            y = self.n * x - sums.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        y = self.n * x.astype(object) - sums
        return [int(v) if v < 1 << 63 else None for v in (y * y).sum(axis=1)]


def _moments(how: Whitening):
    """Per task, sums and products of the whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(how.spectrum.values)
        total = np.zeros((k + 1, k))
        for _, _, x in _vectors(batches):
            if x.shape[1] == len(how.sums):
                w = np.nan_to_num(how.project(x))
                total += np.concatenate([w.sum(axis=0)[None], w.T @ w])
        if total.any():
            yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "s"])

    return run


def _whitened(how: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, x in _vectors(batches):
            if x.shape[1] != len(how.sums):
                continue
            w = how.project(x)
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            values = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            columns = [part.column("vec_id").take(pa.array(rows)), pa.array(how.deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, values)]
            yield pa.record_batch(columns, ["vec_id", "deviation", "whitened"])

    return run


def fit(vectors: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of ``vectors`` (vec_id, embedding); None if no vector remains.

    Three passes over the embeddings: sums, products about the integer part of the mean, and the
    moments of the whitened rows. Only sums of the size of the dimension or its square come to the driver.
    """
    rows = documents(vectors, "vec_id", "embedding")
    sums = rows.mapInArrow(_sums, "length bigint, dim bigint, n bigint, s decimal(38,0)")
    sums = sums.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # The most frequent length, the greater of equally frequent ones; other rows have no place in the space.
    length = sums.where("dim = 0").orderBy(F.desc("n"), F.desc("length")).limit(1).select("length")
    found = sorted((r.dim, r.n, int(r.s)) for r in sums.join(F.broadcast(length), "length").collect())
    if not found:
        return None
    n, totals = found[0][1], [s for _, _, s in found]
    centre = [s // n for s in totals]
    cells = rows.mapInArrow(_products(len(totals), centre), "cell bigint, s decimal(38,0)").groupBy("cell").agg(F.sum("s").alias("s"))
    held = {r.cell: int(r.s) for r in cells.collect()}
    # n^2 V in whole numbers: n sum(z z') - sum(z) sum(z)', so that nothing is lost by centring.
    rest = [s - n * c for s, c in zip(totals, centre)]
    matrix = np.zeros((len(totals), len(totals)))
    for cell, (i, j) in enumerate(zip(*np.triu_indices(len(totals)))):
        exact = n * held.get(cell, 0) - rest[i] * rest[j]
        matrix[i, j] = matrix[j, i] = exact / (n * n)
    spectrum = leading(matrix, components)
    trace = float(np.trace(matrix))
    explained = [float(v) / trace if trace else 0.0 for v in spectrum.values]
    how = Whitening(n, totals, spectrum, explained)
    moments = rows.mapInArrow(_moments(how), "cell bigint, s double").groupBy("cell").agg(F.sum("s").alias("s"))
    k = len(spectrum.values)
    total = np.zeros(k * k + k)
    for cell, s in moments.collect():
        total[cell] = s
    mean = total[:k] / n
    some = ~np.isnan(how.components()[:, 0])
    off = total[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)
    error = float(np.abs(off[np.ix_(some, some)]).max(initial=0.0))
    return Whitening(n, totals, spectrum, explained, error)


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each remaining row and component.

    Rows whose vector is null, empty or holds null, non-finite or huge (2^46 and more) entries are dropped, and
    so are rows of another length than the most frequent one. Repeated rows count and come out as often, a null
    vec_id is carried, other columns are ignored. Fewer dimensions give fewer components; components without
    variance (all of them, if all rows are equal) have a null ``whitened`` and stay out of ``identity_error``.
    ``deviation`` is null where a long cannot hold it. An empty table gives none.
    """
    how = fit(vectors, components)
    schema = "vec_id bigint, deviation bigint, whitened array<double>"
    rows = documents(vectors, "vec_id", "embedding")
    rows = rows.where(F.lit(False)).mapInArrow(_nothing, schema) if how is None else rows.mapInArrow(_whitened(how), schema)
    parts = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(v) for v in (how.explained if how else [0.0])])
    return parts.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(how.n if how else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(how.identity_error if how else 0.0).alias("identity_error"),
    )


def _nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from ()
