"""Whitening of embeddings: blockwise QR, bidiagonalisation, singular values by qd sweeps, directions by twisted factorisations.

Centred rows are reduced to triangles, task by task and then in a tree; the last triangle R has R'R = n V, so the
covariance V itself is never formed and small eigenvalues keep their digits. What reaches the driver is one
triangle, of the vectors' dimension by itself, whatever the number of rows.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.shared import written

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Triangles that one task of the tree joins; rows that are reduced at once; the largest integer an entry may become.
FAN, ROWS, LARGEST = 32, 8192, 1 << 61
#: Directions whose singular value is less than this part of the largest are those of rounding, not of the data.
NEGLIGIBLE = 1e-12
_EPS = 2.0**-52


# --- The small dense problem: one triangle -------------------------------------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A unit vector u and the value h so that x - 2 u (u'x) = (h, 0, ..., 0); u is 0 where nothing is to be done."""
    norm = float(np.linalg.norm(x))
    u = np.zeros_like(x)
    if norm == 0.0 or not np.any(x[1:]):
        return u, float(x[0])
    h = -math.copysign(norm, x[0])
    u[:] = x
    u[0] -= h
    return u / np.linalg.norm(u), h


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, right reflectors) of a square matrix, by Householder reflections from both sides."""
    work = np.array(r, float)
    d = len(work)
    a, b, right = np.zeros(d), np.zeros(max(d - 1, 0)), []
    for k in range(d):
        u, a[k] = _reflector(work[k:, k].copy())
        work[k:, k + 1 :] -= 2 * np.outer(u, u @ work[k:, k + 1 :])
        if k < d - 1:
            v, b[k] = _reflector(work[k, k + 1 :].copy())
            work[k + 1 :, k + 1 :] -= 2 * np.outer(work[k + 1 :, k + 1 :] @ v, v)
            right.append(v)
    return a, b, right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential quotient-difference sweep; the last value is negative if the shift was too large."""
    d, new_q, new_e = q[0] - shift, [], []
    for k, coupling in enumerate(e):
        if d < 0:
            return new_q, new_e, -math.inf
        pivot = d + coupling
        new_q.append(pivot)
        ratio = q[k + 1] / pivot if pivot else 0.0
        new_e.append(coupling * ratio)
        d = (d * ratio if pivot else q[k + 1]) - shift
    new_q.append(d)
    return new_q, new_e, d


def _guess(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows: where the next shift is tried first."""
    above = e[-2] if len(e) > 1 else 0.0
    x, y, z2 = q[-2] + above, q[-1] + e[-1], q[-2] * e[-1]
    half = (x - y) / 2
    root = math.hypot(half, math.sqrt(z2))
    # The product over the larger one, without cancellation: x y - z2 = q q + above (q + e).
    return (q[-2] * q[-1] + above * y) / ((x + y) / 2 + root) if root or x else 0.0


def singular_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The squares of a bidiagonal matrix's singular values, falling, each to nearly full relative accuracy (dqds)."""
    top = max([*map(abs, a), *map(abs, b)], default=0.0)
    if top == 0.0:
        return np.zeros(len(a))
    blocks = [([(x / top) ** 2 for x in a], [(x / top) ** 2 for x in b], 0.0)]
    found: list[float] = []

    def parted(q: list[float], e: list[float], shift: float, k: int) -> bool:
        """Whether the coupling of k and k + 1 changes no value beyond rounding: neither by itself nor beside the diagonal."""
        least = min(q[k], q[k + 1])
        allowed = _EPS * (shift + least)
        return e[k] <= allowed and e[k] * least <= allowed * allowed

    while blocks:
        q, e, shift = blocks.pop()
        for _ in range(100 * (len(q) + 1)):
            while e and parted(q, e, shift, len(e) - 1):
                found.append(shift + q.pop())
                e.pop()
            if not e:
                found += [shift + x for x in q]
                break
            cut = next((k for k in range(len(e) - 2, -1, -1) if parted(q, e, shift, k)), None)
            if cut is not None:
                blocks += [(q[: cut + 1], e[:cut], shift), (q[cut + 1 :], e[cut + 1 :], shift)]
                break
            if 1.5 * q[0] < q[-1]:
                # The sweeps find the smallest first where it stands last; the reversed array has the same values.
                q, e = q[::-1], e[::-1]
            step = _guess(q, e)
            for attempt in range(4):
                step = step if attempt < 3 else 0.0
                new_q, new_e, last = _sweep(q, e, step)
                if last >= 0:
                    q, e, shift = new_q, new_e, shift + step
                    break
                step = max(0.0, (step + last) * (1 - 4 * _EPS)) if last > -math.inf and attempt == 0 else step / 4
        else:
            raise ArithmeticError("the qd sweeps did not converge")
    return np.array(sorted(found, reverse=True)) * top * top


def _twisted(a: np.ndarray, b: np.ndarray, value: float, others: list[np.ndarray]) -> np.ndarray:
    """The unit eigenvector of B'B (diagonal a, superdiagonal b) for an eigenvalue, orthogonal to `others`.

    B'B - value is factorised from the top and from the bottom; where the two meet with the least rest, the
    twist, the vector has its largest entries. The next best twists serve where neighbours are nearly equal, if
    they solve the equation as well.
    """
    d, l = a * a, b / a[:-1]
    n, tiny = len(a), np.finfo(float).tiny / _EPS
    down, s = np.zeros(n - 1), np.full(n, -value)
    up, p = np.zeros(n - 1), np.full(n, d[-1] - value)
    for k in range(n - 1):
        pivot = s[k] + d[k] or tiny
        down[k] = d[k] * l[k] / pivot
        s[k + 1] = down[k] * l[k] * s[k] - value
    for k in range(n - 2, -1, -1):
        pivot = d[k] * l[k] ** 2 + p[k + 1] or tiny
        up[k] = l[k] * d[k] / pivot
        p[k] = p[k + 1] * d[k] / pivot - value
    whole = np.diag(d + np.append(0.0, b * b)) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    allowed = 64 * _EPS * float(np.abs(whole).max())

    def apart(z: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(2):
            for o in others:
                z = z - o * (o @ z)
        return z, float(np.linalg.norm(z))

    for twist in np.argsort(np.abs(s + p + value), kind="stable"):
        z = np.zeros(n)
        z[twist] = 1.0
        for k in range(twist - 1, -1, -1):
            z[k] = -down[k] * z[k + 1]
        for k in range(twist, n - 1):
            z[k + 1] = -up[k] * z[k]
        z, rest = apart(z / np.linalg.norm(z))
        if rest > 0.5 and np.linalg.norm(whole @ z - value * z) <= allowed * rest:
            return z / rest
    # Values equal to the last digit: what is left of their space, by inverse iteration from the unit vector farthest from the others.
    free = 1 - sum((o * o for o in others), np.zeros(n))
    z, rest = apart(np.eye(n)[int(free.argmax())])
    for _ in range(3):
        z = np.linalg.solve(whole - np.eye(n) * value * (1 + 4 * _EPS), z / rest)
        z, rest = apart(z / np.linalg.norm(z))
    return z / rest


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of all singular values, falling; the right singular vectors of the first `most` that aren't negligible, as columns)."""
    a, b, right = bidiagonal(r)
    n = len(a)
    top = max([*map(abs, a), *map(abs, b)], default=0.0)
    if top == 0.0:
        return np.zeros(n), np.zeros((n, 0))
    # A diagonal entry of 0 would part the factorisations; so small a change is less than the triangle's own rounding.
    a = np.where(np.abs(a) < top * _EPS / 8, top * _EPS / 8, a)
    b = np.where(np.abs(b) <= 16 * _EPS * np.minimum(np.abs(a[:-1]), np.abs(a[1:])), 0.0, b)
    edges = [0, *(np.flatnonzero(b == 0) + 1).tolist(), n]
    found = [(value, first, end) for first, end in zip(edges, edges[1:]) for value in singular_squares(a[first:end], b[first : end - 1])]
    found.sort(key=lambda x: -x[0])
    values, vectors = np.array([v for v, *_ in found]), []
    for j, (value, first, end) in enumerate(found[:most]):
        if value <= values[0] * NEGLIGIBLE**2:
            break
        near = [vectors[i][first:end] for i in range(j) if found[i][1] == first and found[i][0] - value <= 1e-3 * value]
        z = np.zeros(n)
        z[first:end] = _twisted(a[first:end], b[first : end - 1], value, near) if end - first > 1 else 1.0
        vectors.append(z)
    out = np.array(vectors).T.reshape(n, len(vectors))
    for k in range(len(right) - 1, -1, -1):
        out[k + 1 :] -= 2 * np.outer(right[k], right[k] @ out[k + 1 :])
    for j in range(out.shape[1]):
        out[:, j] *= math.copysign(1.0, out[np.argmax(np.abs(out[:, j])), j]) / np.linalg.norm(out[:, j])
    return values, out


# --- Rows ------------------------------------------------------------------------------------------------------------


def integers(vectors: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): which vectors have that length and finite entries alone, and these as integers; entries beyond LARGEST become it."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), length), False).to_numpy(zero_copy_only=False))
    values = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), length)
    finite = np.isfinite(values).all(axis=1)
    return rows[finite], np.clip(np.floor(values[finite] * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _exact(x: np.ndarray, factor: int) -> np.ndarray:
    """x, as Python's integers if products with the factor might not fit into 62 bits."""
    return x if not x.size or int(np.abs(x).max()) * max(factor, 1) < 1 << 61 else x.astype(object)


def _off_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact."""
    big = max(map(abs, sums), default=0) >= 1 << 61
    return (x.astype(object) if big else _exact(x, n)) * n - np.array(sums, object if big else np.int64)


@dataclass(frozen=True)
class Whitening:
    n: int
    #: Sums of the integer vectors by dimension; eigenvalues of the kept components; their directions as columns; the trace.
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    trace: float



def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length of the task's vectors, how many there are and their sums."""
    told: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        for length in pc.unique(pc.list_value_length(batch.column(0))).to_pylist():
            if length:
                rows, x = integers(batch.column(0), length)
                if len(rows):
                    n, sums = told.get(length, (0, [0] * length))
                    told[length] = n + len(rows), [s + int(v) for s, v in zip(sums, _exact(x, len(x)).sum(axis=0))]
    kind = pa.list_(pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(told), pa.int32()), pa.array([n for n, _ in told.values()], pa.int64()), pa.array([[decimal.Decimal(v) for v in s] for _, s in told.values()], kind)], ["length", "n", "sums"]
    )


def _joined(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The triangle of a triangle's rows and further ones."""
    d = r.shape[1]
    out = np.zeros((d, d))
    new = np.linalg.qr(np.vstack([r, rows]), mode="r")
    out[: len(new)] = new
    return out


def fit(df: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> Whitening | None:
    """The mean and the principal directions of all vectors; None if there is none.

    Null vectors and those with null or non-finite entries are left out. All should have one length; of several
    lengths the most frequent counts (of equally frequent ones the longest), others are left out. Repeated rows
    count as often as they stand there. Components of no variance have no direction.
    """
    only = df.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    told = written(only.mapInArrow(_sums, "length int, n long, sums array<decimal(38,0)>"), "sums")
    lengths = told.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if lengths is None:
        return None
    length, n = lengths
    by_place = told.where(F.col("length") == length).select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).collect()
    sums = [int(s) for _, s in sorted(by_place)]

    def triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r, some = np.zeros((length, length)), False
        for batch in batches:
            _, x = integers(batch.column(0), length)
            for k in range(0, len(x), ROWS):
                r, some = _joined(r, _off_mean(x[k : k + ROWS], n, sums).astype(float) / n), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["node", "r"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        r = np.zeros((length, length))
        for one in table.column("r").to_pylist():
            r = _joined(r, np.frombuffer(one).reshape(length, length))
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    level = written(only.mapInArrow(triangles, "node long, r binary"), "triangles")
    span = level.agg(F.max("node")).first()[0] + 1
    while span > 1:
        level = level.groupBy(F.floor(F.col("node") / FAN).alias("up")).applyInArrow(join, "node long, r binary")
        span = -(-span // FAN)
    r = np.frombuffer(level.first().r).reshape(length, length)
    squares, directions = principal(r, most)
    return Whitening(n, sums, squares[: directions.shape[1]] / n, directions, float(squares.sum() / n))


def whitened(df: DataFrame, by: Whitening, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, deviation, z): for each vector that the fit took in, the sum of (n x - S)^2 over dimensions, and its whitened coordinates.

    deviation is exact, and null where it is beyond a long. A row without an id keeps a null; repeated rows stay.
    Other columns are not carried along; join by id for them.
    """
    n, sums, length = by.n, by.sums, len(by.sums)
    onto = by.directions / np.sqrt(by.values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = integers(batch.column(1), length)
            off = _off_mean(x, n, sums)
            squares = (_exact(off, int(np.abs(off).max()) * length if off.size else 1) ** 2).sum(axis=1)
            deviation = pa.array([int(v) if v < 1 << 63 else None for v in squares], pa.int64())
            z = (off.astype(float) / n) @ onto
            offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), deviation, pa.ListArray.from_arrays(offsets, pa.array(z.reshape(-1)))], ["id", "deviation", "z"])

    return df.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(rows, "id long, deviation long, z array<double>")


def identity_error(rows: DataFrame, k: int) -> float:
    """The largest entry, without sign, of the covariance of z less the identity. Means of z are 0 but for rounding, and taken off."""
    z = lambda i: F.element_at("z", i + 1)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = rows.agg(F.count(F.lit(1)), *(F.sum(z(i)) for i in range(k)), *(F.sum(z(i) * z(j)) for i, j in pairs)).first()
    n, means, products = row[0], [s / row[0] for s in row[1 : k + 1]], row[k + 1 :]
    return max(abs(p / n - means[i] * means[j] - (i == j)) for (i, j), p in zip(pairs, products))


KIND = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable rows of embeddings by each of the first eight components that have variance; no rows where none has."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    by = fit(df)
    if by is None or not len(by.values):
        return spark.createDataFrame([], KIND)
    rows = written(whitened(df, by), "whitened")
    error = identity_error(rows, len(by.values))
    explained = F.array(*(F.lit(float(v / by.trace)) for v in by.values))
    each = rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("z").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(by.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
