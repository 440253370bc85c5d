"""Embedding whitening by incremental eigendecomposition.

A spectrum is the state (n, S, mean, values, vectors): the number of vectors, the
exact sums of their long entries, and the eigenvalues and eigenvectors of their
scatter about the mean.  Adding a vector v is one centred rank-one update of the
scatter, n / (n + 1) * (v - mean)(v - mean)^T.  In the eigenbasis that is
D + z z^T, whose eigenvalues are the roots of the secular equation
1 + sum(z_i^2 / (d_i - t)) = 0, one between each pair of poles.  Entries with a
negligible z_i, and poles that coincide (their z is rotated into one of them), are
deflated: they keep their eigenvalue.  The eigenvectors follow from the z that has
the computed roots exactly (Loewner's formula), so they stay orthogonal.

1. A partition deals its vectors to ``LANES`` spectra, updated in step (numpy
   works on all lanes at once), and combines these.
2. Two spectra are combined by successive rank-one updates: the mean shift
   n1 n2 / (n1 + n2) and one update for each eigenpair of the second.  Partitions'
   spectra (one row of d * d numbers each) are combined ``FAN`` at a time, in rounds
   of Spark tasks, until one is left; only that one reaches the driver.
3. A distributed Rayleigh-Ritz step refines it: with the basis orthonormal and the
   mean exact (n x - S is computed in integers), every partition adds up its part of
   the projected covariance; its small eigenproblem turns the basis into the
   eigenvectors to double precision.
4. The whitened rows' covariance is measured in one more pass (``identity_error``).

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries are dropped, as are rows whose vector has not the most frequent length (of
equally frequent ones, the longest).  Entries beyond +-2**46 count as that.  Repeated
rows all count and are all returned; a null vec_id is kept.  Components whose
eigenvalue is zero to double precision (fewer distinct vectors than dimensions,
constant dimensions) cannot be whitened and are not returned; with a single vector,
or none, there are no rows.  deviation is null where it does not fit a long.  Other
columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

COMPONENTS = 32
LANES = 16
FAN = 16
LIMIT = 1 << 46
SHIFT = 1_000_000
_EPS = np.finfo(np.float64).eps
_PART = "part long, state binary"


# ------------------------------------------------------- rank-one updates, many at once

def _deflate(d: np.ndarray, z: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Rotate the z of coinciding poles into the last of them, zero negligible
    ones (both in place); returns the mask of the entries that stay."""
    scale = np.maximum(np.abs(d).max(axis=1), (z * z).sum(axis=1))[:, None]
    tol = 8 * _EPS * scale
    close = np.diff(d, axis=1) <= tol
    for i in np.flatnonzero(close.any(axis=0)):
        at = np.flatnonzero(close[:, i] & (z[:, i] != 0))
        if len(at):
            a, b = z[at, i], z[at, i + 1]
            r = np.hypot(a, b)
            c, s = (b / r)[:, None], (a / r)[:, None]
            left, right = u[at, :, i], u[at, :, i + 1]
            u[at, :, i], u[at, :, i + 1] = c * left - s * right, s * left + c * right
            z[at, i], z[at, i + 1] = 0, r
    norm = np.sqrt((z * z).sum(axis=1))[:, None]
    stay = np.abs(z) * norm > tol / 8
    z[~stay] = 0
    return stay


def _roots(d: np.ndarray, z2: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of the secular equations as (index of the nearest pole, offset from
    it); entries that do not stay are their own root."""
    lanes, size = d.shape
    lane, own = np.nonzero(stay)
    following = np.full((lanes, size), size)                    # the next pole that stays
    for i in range(size - 2, -1, -1):
        following[:, i] = np.where(stay[:, i + 1], i + 1, following[:, i + 1])
    nxt = following[lane, own]
    last = nxt == size
    pole, weight = d[lane], z2[lane]
    low = d[lane, own]
    high = np.where(last, low + z2.sum(axis=1)[lane], d[lane, np.minimum(nxt, size - 1)])
    gap = high - low
    middle = pole - (low + gap / 2)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        at_middle = 1 + np.where(weight > 0, weight / middle, 0).sum(axis=1)
    left = last | (at_middle >= 0)                              # origin: the pole below, else the one above
    origin = np.where(left, own, np.minimum(nxt, size - 1))
    pole = pole - d[lane, origin][:, None]
    lo = np.where(left, 0, -gap / 2)
    hi = np.where(last, gap, np.where(left, gap / 2, 0))
    t = (lo + hi) / 2
    t = np.where(last & (at_middle >= 0), gap / 4, t)
    pole = np.where(weight > 0, pole, np.inf)                   # what has no weight adds nothing
    go = np.arange(len(t))
    below = (np.arange(size)[None, :] <= own[:, None]).astype(float)
    p, w, under = pole, weight, below
    for _ in range(80):
        x = t[go]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            away = 1 / (p - x[:, None])
            q = w * away
            f = 1 + q.sum(axis=1)
            slope = np.multiply(q, away, out=away)
            lower = np.einsum("ij,ij->i", slope, under)
            upper = slope.sum(axis=1) - lower
        size_of = 1 + np.abs(q, out=q).sum(axis=1)
        lo[go] = np.where(f < 0, x, lo[go])
        hi[go] = np.where(f < 0, hi[go], x)
        # f is matched by c + a / (p_low - t) + b / (p_high - t): value and both slopes
        pl = pole[go, own[go]] - x
        ph = np.where(last[go], np.inf, pole[go, np.minimum(nxt[go], size - 1)] - x)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            a = pl * pl * lower
            b = np.where(last[go], 0, np.where(np.isfinite(ph), ph, 0) ** 2 * upper)
            c = f - pl * lower - np.where(last[go], 0, np.where(np.isfinite(ph), ph, 0) * upper)
            # c + a/(pl - s) + b/(ph - s) = 0 for the step s
            two = ~last[go]
            qa = c
            qb = np.where(two, -(c * (pl + np.where(two, ph, 0)) + a + b), 0)
            qc = np.where(two, c * pl * np.where(two, ph, 0) + a * np.where(two, ph, 0) + b * pl, 0)
            root = np.sqrt(np.maximum(qb * qb - 4 * qa * qc, 0))
            s_two = np.where(qb > 0, -2 * qc / (qb + root), np.where(qa != 0, (-qb + root) / (2 * qa), -qc / qb))
            s_two2 = np.where(qb > 0, np.where(qa != 0, -(qb + root) / (2 * qa), -qc / qb), 2 * qc / (-qb + root))
            s = np.where(two, np.where((x + s_two > lo[go]) & (x + s_two < hi[go]), s_two, s_two2), pl + a / c)
        new = x + s
        ok = np.isfinite(new) & (new > lo[go]) & (new < hi[go])
        new = np.where(ok, new, (lo[go] + hi[go]) / 2)
        done = (np.abs(f) <= 8 * _EPS * size_of) | (hi[go] - lo[go] <= 8 * _EPS * np.abs(new)) | (ok & (np.abs(s) <= 1e-13 * np.abs(new)))
        t[go] = np.where(done & ~ok, x, new)
        if done.any():
            go, p, w, under = go[~done], p[~done], w[~done], under[~done]
        if not len(go):
            break
    index, offset = np.broadcast_to(np.arange(size), (lanes, size)).copy(), np.zeros((lanes, size))
    index[lane, own], offset[lane, own] = origin, t
    return index, offset


def update(d: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectra (lanes, size) ascending and (lanes, size, size) of
    u diag(d) u^T + v v^T, lane by lane."""
    u = u.copy()
    z = np.einsum("lki,lk->li", u, v)
    stay = _deflate(d, z, u)
    z2 = z * z
    index, offset = _roots(d, z2, stay)
    at = np.take_along_axis(d, index, axis=1)
    value = at + offset
    from_pole = (at[:, None, :] - d[:, :, None]) + offset[:, None, :]          # root j less pole k: [lane, k, j]
    between = d[:, None, :] - d[:, :, None]                                     # pole j less pole k
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where((between != 0) & stay[:, None, :] & stay[:, :, None], from_pole / between, 1.0)
    both = np.arange(d.shape[1])
    ratio[:, both, both] = np.where(stay, from_pole[:, both, both], 0)
    fitted = np.sqrt(np.maximum(ratio.prod(axis=2), 0)) * np.sign(z)
    with np.errstate(divide="ignore", invalid="ignore"):
        q = np.where(stay[:, :, None] & stay[:, None, :], fitted[:, :, None] / -from_pole, 0)
    q = np.nan_to_num(q, nan=0.0, posinf=0.0, neginf=0.0)
    lane, still = np.nonzero(~stay)
    q[lane, still, still] = 1
    length = np.sqrt((q * q).sum(axis=1, keepdims=True))
    bad = length[:, 0, :] == 0                                  # a root on its pole, to the last bit
    lane, col = np.nonzero(bad)
    q[lane, col, col] = 1
    q /= np.where(length == 0, 1, length)
    u = u @ q
    order = np.argsort(value, axis=1, kind="stable")
    if (order != both).any():
        value = np.take_along_axis(value, order, axis=1)
        u = np.take_along_axis(u, order[:, None, :], axis=2)
    return value, u


class Spectra:
    """``lanes`` spectra of dimension ``size``, updated in step."""

    def __init__(self, lanes: int, size: int):
        self.n = np.zeros(lanes, np.int64)
        self.sums = np.zeros((lanes, size), np.int64)
        self.mean = np.zeros((lanes, size))
        self.d = np.zeros((lanes, size))
        self.u = np.broadcast_to(np.eye(size), (lanes, size, size)).copy()

    def add(self, x: np.ndarray) -> None:
        """One vector (long entries) to each of the first len(x) lanes."""
        k = len(x)
        v = x - self.mean[:k]
        n = self.n[:k, None]
        self.d[:k], self.u[:k] = update(self.d[:k], self.u[:k], v * np.sqrt(n / (n + 1)))
        self.mean[:k] += v / (n + 1)
        self.n[:k] += 1
        self.sums[:k] += x

    def absorb(self, other: "Spectra") -> None:
        """Combine each lane with the other's, by successive rank-one updates."""
        n1, n2 = self.n[:, None], other.n[:, None]
        total = np.maximum(n1 + n2, 1)
        shift = other.mean - self.mean
        self.d, self.u = update(self.d, self.u, shift * np.sqrt(n1 * n2 / total))
        for k in range(self.d.shape[1]):
            root = np.sqrt(np.maximum(other.d[:, k], 0))
            if root.any():
                self.d, self.u = update(self.d, self.u, other.u[:, :, k] * root[:, None])
        self.mean += shift * (n2 / total)
        self.n += other.n
        self.sums += other.sums

    def lanes(self, which) -> "Spectra":
        out = object.__new__(Spectra)
        for name in ("n", "sums", "mean", "d", "u"):
            setattr(out, name, getattr(self, name)[which].copy())
        return out

    def one(self) -> "Spectra":
        """All lanes in one, pairwise."""
        now = self
        while len(now.n) > 1:
            half = len(now.n) // 2
            left, rest = now.lanes(slice(0, half)), now.lanes(slice(2 * half, None))
            left.absorb(now.lanes(slice(half, 2 * half)))
            now = left if not len(rest.n) else _stack([left, rest])
        return now


def _stack(parts: list[Spectra]) -> Spectra:
    out = object.__new__(Spectra)
    for name in ("n", "sums", "mean", "d", "u"):
        setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
    return out


# ------------------------------------------------------------------ Spark side

def _vectors(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a usable vector, and their long entries (rows, size)."""
    column = batch.column(batch.schema.get_field_index("vector")).cast(pa.list_(pa.float64()))
    fits = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), size), False)))
    flat = np.asarray(pc.fill_null(column.take(pa.array(fits)).flatten(), np.nan)).reshape(-1, size)
    good = np.isfinite(flat).all(axis=1)
    x = np.floor(np.clip(64 * flat[good], -LIMIT, LIMIT)).astype(np.int64) + SHIFT
    return fits[good], x


def _combined(rows: DataFrame, merge) -> bytes | None:
    """The states in one, ``FAN`` at a time in rounds; only the last one is
    collected."""
    rows = stored(rows, "whitening-states")
    while True:
        n = rows.count()
        if n <= 1:
            return bytes(rows.first()["state"]) if n else None

        def run(t: pa.Table) -> pa.Table:
            order = np.argsort(np.asarray(t.column("part")))
            state = merge([t.column("state")[int(k)].as_py() for k in order])
            return pa.table({"part": pa.array([t.column("part")[0].as_py() // FAN], pa.int64()),
                             "state": pa.array([state], pa.binary())})

        rows = stored(rows.groupBy(F.expr(f"div(part, {FAN})").alias("k")).applyInArrow(run, _PART), "whitening-states")


def _states(vectors: DataFrame, begin, add, end) -> DataFrame:
    """One row (part, state) per partition that has vectors."""
    def run(batches):
        state = None
        for b in batches:
            x = _rows(b)
            if len(x):
                state = begin() if state is None else state
                add(state, x)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([end(state)], pa.binary())], ["part", "state"])

    return vectors.mapInArrow(run, _PART)


_ROWS = 1 << 14


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return _vectors(b, _size_of(b))[1]


def _size_of(b: pa.RecordBatch) -> int:
    return b.column(b.schema.get_field_index("size"))[0].as_py() if b.num_rows else 0


def dimension(vectors: DataFrame) -> int:
    """The most frequent length (the longest of equally frequent ones; 0: no
    vectors).  Lengths are counted before they move; one row reaches the driver."""
    first = (vectors.where(F.size("vector") > 0).groupBy(F.size("vector").alias("n")).count()
             .orderBy(F.desc("count"), F.desc("n")).limit(1).collect())
    return first[0]["n"] if first else 0


def spectrum(vectors: DataFrame, size: int) -> Spectra | None:
    """The spectrum of all vectors, by incremental updates."""
    def begin():
        return [Spectra(LANES, size)]

    def add(state, x):
        for k in range(0, len(x), LANES):
            state[0].add(x[k:k + LANES])

    def end(state):
        s = state[0]
        return pickle.dumps(s.lanes(s.n > 0).one().__dict__)

    def load(raw):
        out = object.__new__(Spectra)
        out.__dict__.update(pickle.loads(raw))
        return out

    def merge(raws):
        return pickle.dumps(_stack([load(r) for r in raws]).one().__dict__)

    raw = _combined(_states(vectors, begin, add, end), merge)
    return load(raw) if raw is not None else None


def _added(raws: list[bytes]) -> bytes:
    return sum(np.frombuffer(r) for r in raws).tobytes()


def _covariance(vectors: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) of the centred vectors in ``basis``, added up by
    partitions."""
    width = basis.shape[1]

    def begin():
        return np.zeros((width, width))

    def add(state, x):
        for k in range(0, len(x), _ROWS):
            y = _centred(x[k:k + _ROWS], n, sums)[0] @ basis
            state += y.T @ y

    raw = _combined(_states(vectors, begin, add, lambda state: state.tobytes()), _added)
    return np.frombuffer(raw).reshape(width, width) / n


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """x - sums / n, rounded once, and n x - sums in integers (None where these
    may not fit a long)."""
    if float(np.abs(x).max(initial=0)) * n >= 2.0 ** 62:
        q, r = np.divmod(sums, n)
        return (x - q) - r / n, None
    whole = x * n - sums
    return whole / n, whole


class Whitening:
    """The fitted transform: n, sums, eigenvalues (falling), vectors (columns) and
    the trace of the covariance."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace

    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Incremental spectrum, then Rayleigh-Ritz; None without a positive variance."""
    state = spectrum(vectors, size)
    if state is None:
        return None
    n, sums = int(state.n[0]), state.sums[0]
    basis = np.linalg.qr(state.u[0][:, ::-1])[0]
    ritz = _covariance(vectors, n, sums, basis)
    value, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    value, turn = value[::-1], turn[:, ::-1]
    keep = int((value > 4 * size * _EPS * max(value[0], 0)).sum()) if value[0] > 0 else 0
    keep = min(keep, components)
    return Whitening(n, sums, value[:keep], (basis @ turn)[:, :keep], float(np.trace(ritz))) if keep else None


_OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per usable vector and component."""
    spark = rows.sparkSession
    vectors = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    size = dimension(vectors)
    vectors = vectors.where(F.size("vector") == size).withColumn("size", F.lit(size))
    model = fit(vectors, size, components) if size else None
    if model is None:
        return spark.createDataFrame([], _OUT)
    n, sums, matrix = model.n, model.sums, model.matrix()
    explained = model.values / model.trace
    error = float(np.abs(_covariance(vectors, n, sums, matrix) - np.eye(matrix.shape[1])).max())
    width = matrix.shape[1]

    def run(batches):
        for b in batches:
            at, x = _vectors(b, size)
            ids = b.column(0).take(pa.array(at))
            for k in range(0, len(x), 1024):
                part = x[k:k + 1024]
                y, whole = _centred(part, n, sums)
                total = _squares(part, whole, n, sums)
                rows_ = len(part)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(k, rows_).take(pa.array(np.repeat(np.arange(rows_), width))),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows_)),
                    pa.array(np.full(rows_ * width, n, np.int64)),
                    total.take(pa.array(np.repeat(np.arange(rows_), width))),
                    pa.array((y @ matrix).reshape(-1)), pa.array(np.tile(explained, rows_)),
                    pa.array(np.full(rows_ * width, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, _OUT)


def _squares(x: np.ndarray, whole: np.ndarray | None, n: int, sums: np.ndarray) -> pa.Array:
    """Per row the exact sum of (n x - sums)^2, null where it exceeds a long."""
    if whole is not None and (float(np.abs(whole).max(initial=0)) ** 2) * x.shape[1] < 2.0 ** 62:
        return pa.array((whole * whole).sum(axis=1))
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
