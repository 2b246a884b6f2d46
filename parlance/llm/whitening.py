"""Operator 12: embedding whitening by incremental eigendecomposition.

Vectors become integers (``floor(1024 c) + 100000``), so that their number and
sums are exact and every task centres them alike. Each partition then holds the
eigenvalues and eigenvectors of its centred scatter matrix and takes its rows up
one by one: a rank-one update, whose new eigenvalues are the roots of the secular
equation ``1 + rho * sum(z_i^2 / (d_i - x)) = 0`` between the old ones, after
deflation of the entries that cannot move. The spectra of partitions are merged
the same way, each eigenpair of one a rank-one update of the other, sixteen
spectra a task and round. A last pass over all rows makes the result independent
of how roundings added up: the covariance is projected on the merged basis,
``Q' V Q``, and the small matrix turns the basis (Rayleigh-Ritz).

A task holds one batch of rows and a few matrices of dimension by dimension. What
reaches the driver are such matrices as aggregates, never rows or partitions'
spectra, so it grows with the dimension and not with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
FAN_IN = 16
EPS = np.finfo(float).eps
# A component below this share of the whole variance is noise of rounding, not spread.
LEAST_SHARE = 1e-13


# ---------------------------------------------------------------- one spectrum
def deflate(d: np.ndarray, z: np.ndarray, q: np.ndarray, rho: float) -> np.ndarray:
    """Which entries of an update move their eigenvalue; turns ``z`` and ``q`` in place.

    ``d`` ascends. An entry of z that is next to nothing stays; of two
    eigenvalues that are next to equal one takes both entries by a rotation of
    their vectors, and the other stays.
    """
    small = 8 * EPS * max(abs(d[0]), abs(d[-1]), rho)
    moves = rho * np.abs(z) > small
    at = np.flatnonzero(moves)
    if len(at) > 1:
        gap = np.diff(d[at])
        r2 = z[at[1:]] ** 2 + z[at[:-1]] ** 2
        if (gap * np.abs(z[at[1:]] * z[at[:-1]]) <= small * r2).any():
            i = at[0]
            for j in at[1:]:
                r = np.hypot(z[i], z[j])
                c, s = z[j] / r, z[i] / r
                if (d[j] - d[i]) * abs(c * s) <= small:
                    z[i], z[j] = 0.0, r
                    q[:, i], q[:, j] = c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]
                    moves[i] = False
                i = j
    return moves


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots as (index of the nearest pole, distance from it), so that the
    distances to all poles keep their relative accuracy.

    ``d`` ascends strictly, ``z2`` are squares that sum to 1 and ``rho`` > 0: one
    root lies above each pole and below the next (the last below ``d[-1] + rho``).
    All roots are sought at once by steps that fit a pole on either side, with
    a bracket that halves where a step leaves it.
    """
    k = len(d)
    right = np.append(d[1:], d[-1] + rho)
    width = right - d
    w = rho * z2
    # the sign in the middle tells which pole is nearer
    mid = 1 + (w / (d - (d + width / 2)[:, None])).sum(1)
    near = np.where((mid < 0) & (np.arange(k) < k - 1), np.arange(1, k + 1), np.arange(k))
    low_side = near == np.arange(k)
    lo = np.where(low_side, 0.0, -width / 2)
    hi = np.where(low_side, np.where(mid < 0, width, width / 2), 0.0)
    lo = np.where(low_side & (mid < 0), width / 2, lo)
    poles = d - d[near][:, None]
    own = np.arange(k)
    below = np.tri(k)  # poles at or below a root
    left = poles[own, own]
    far = np.where(own < k - 1, poles[own, np.minimum(own + 1, k - 1)], left + rho)
    x = (lo + hi) / 2
    with np.errstate(all="ignore"):
        for _ in range(60):
            gap = poles - x[:, None]
            part = w / gap
            low_sum = np.einsum("ij,ij->i", part, below)
            f = 1 + part.sum(1)
            slope = part / gap
            a_slope = np.einsum("ij,ij->i", slope, below)
            b_slope = slope.sum(1) - a_slope
            lo, hi = np.where(f < 0, x, lo), np.where(f > 0, x, hi)
            noise = EPS * k * (1 + np.abs(low_sum) + np.abs(f - 1 - low_sum))
            done = (np.abs(f) <= noise) | (hi - lo <= 2 * EPS * np.abs(x))
            if done.all():
                break
            p, r = left - x, far - x
            c = f - p * a_slope - r * b_slope
            a = (p + r) * f - p * r * (a_slope + b_slope)
            b = p * r * f
            root = np.sqrt(np.abs(a * a - 4 * b * c))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = x + step
            new = np.where(np.isfinite(new) & (new > lo) & (new < hi), new, (lo + hi) / 2)
            x = np.where(done, x, new)
    return near, x


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of ``q diag(d) q' + rho v v'`` for rho > 0."""
    z = v @ q
    size = float(z @ z)
    if not size * rho > 0:
        return d, q
    rho, z = rho * size, z / np.sqrt(size)
    q = q.copy()
    moves = deflate(d, z, q, rho)
    at = np.flatnonzero(moves)
    if not len(at):
        return d, q
    da, za = d[at], z[at]
    norm = float(za @ za)
    near, x = secular_roots(da, za * za / norm, rho * norm)
    # distance of every root (row) to every pole (column)
    dist = (da[near][:, None] - da) + x[:, None]
    k = len(at)
    # entries for which the roots found are exact (Gu and Eisenstat): vectors come out
    # orthogonal. Roots below pole j are set against their own pole, the others against the next
    poles = da - da[:, None]
    by = np.tril(poles, -1)
    by[:, :-1] += np.triu(poles, 1)[:, 1:]
    by[:, -1] = 1.0
    ratio = dist.T / by
    fitted = np.sqrt(np.abs(ratio.prod(1)))
    vectors = np.copysign(fitted, za)[None, :] / -dist
    vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
    d = d.copy()
    d[at] = da[near] + x
    q[:, at] = q[:, at] @ vectors.T
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def start(dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(dim), np.eye(dim)


def add_rows(spectrum, rows: np.ndarray, weights: np.ndarray):
    """The spectrum with centred rows taken up, each as a rank-one update."""
    d, q = spectrum
    for v, w in zip(rows, weights):
        d, q = rank_one(d, q, v, float(w))
    return d, q


def merge(a, b):
    """Two spectra of scatter matrices as one: b's eigenpairs update a."""
    return add_rows(a, b[1].T, np.maximum(b[0], 0))


# ---------------------------------------------------------------- Spark
def to_integers(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, x``: the vectors that count, as arrays of long.

    A vector is left out if it is null, empty, or holds a null or non-finite entry.
    """
    c = F.col(vec_col).cast("array<double>")
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + SHIFT)
    return rows.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.coalesce(good, F.lit(False))).select(
        F.col(id_col).alias("id"), x.alias("x")
    )


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a batch as one integer matrix."""
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy().reshape(-1, dim)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - sums / n``, rounded once: the difference is taken in integers."""
    return _scaled(x, n, sums).astype(float) / n


def _scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n x - sums``, exactly: in Python's integers where 64 bits could overflow."""
    if x.size and n * int(np.abs(x).max()) + int(np.abs(sums).max()) >= 1 << 62:
        return x.astype(object) * n - sums.astype(object)
    return x * np.int64(n) - sums


def _totals(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for b in batches:
            if b.num_rows:
                x = _matrix(b, dim)
                n += len(x)
                fits = len(x) * int(np.abs(x).max()) < 1 << 62
                sums = [s + int(t) for s, t in zip(sums, (x if fits else x.astype(object)).sum(0))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(dim)], pa.int32()), pa.array([str(n), *map(str, sums)])], ["k", "v"]
        )

    told = vectors.select("x").mapInArrow(run, "k int, v string")
    got = {r["k"]: int(r["v"]) for r in told.groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    sums = [got.get(k, 0) for k in range(dim)]
    wide = max(map(abs, sums), default=0) >= 1 << 62
    return got.get(-1, 0), np.array(sums, dtype=object if wide else np.int64)


_SPECTRUM = "part bigint, d array<double>, q array<double>"


def _one(d: np.ndarray, q: np.ndarray, part: int) -> pa.RecordBatch:
    kind = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([d.tolist()], kind), pa.array([q.ravel().tolist()], kind)],
        ["part", "d", "q"],
    )


def incremental_spectrum(vectors: DataFrame, dim: int, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of the scatter matrix of centred rows.

    Every partition yields one spectrum; rounds of merges, ``FAN_IN`` to a task,
    leave one. Equal rows of a batch are one update with their number as weight.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, some = start(dim), False
        for b in batches:
            if b.num_rows:
                rows, times = np.unique(_matrix(b, dim), axis=0, return_counts=True)
                spectrum, some = add_rows(spectrum, centred(rows, n, sums), times), True
        if some:
            yield _one(*spectrum, TaskContext.get().partitionId())

    def merged(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        spectrum = None
        for d, q in zip(table.column("d").to_pylist(), table.column("q").to_pylist()):
            one = (np.array(d), np.array(q).reshape(dim, dim))
            spectrum = one if spectrum is None else merge(spectrum, one)
        return pa.Table.from_batches([_one(*spectrum, table.column("part")[0].as_py() // FAN_IN)])

    parts = materialize(vectors.select("x").mapInArrow(run, _SPECTRUM), "spectra")
    while (left := parts.count()) > 1:
        # numbered without gaps, so that every task but the last has FAN_IN of them
        numbers = {r["part"]: k for k, r in enumerate(parts.select("part").orderBy("part").collect())}
        if list(numbers) != list(range(left)):
            renumber = parts.sparkSession.createDataFrame(list(numbers.items()), "part bigint, k bigint")
            parts = parts.join(F.broadcast(renumber), "part").select(F.col("k").alias("part"), "d", "q")
        group = F.floor(F.col("part") / FAN_IN).alias("group")
        parts = materialize(parts.groupBy(group).applyInArrow(merged, _SPECTRUM), "spectra")
    r = parts.first()
    return np.array(r["d"]), np.array(r["q"]).reshape(dim, dim)


def _products(vectors: DataFrame, dim: int, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of the centred rows' projections on the columns of ``basis``."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            y = centred(_matrix(b, dim), n, sums) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], ["k", "v"]
        )

    told = vectors.select("x").mapInArrow(run, "k int, v double")
    out = np.zeros(k * k)
    for r in told.groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"] / n
    return out.reshape(k, k)


def fit_whitening(vectors: DataFrame) -> dict | None:
    """What ``whiten`` needs, from ``id, x`` rows of one length: ``n, sums, values``
    (falling), ``basis`` (unit columns) and ``trace``; None for no rows."""
    first = vectors.select(F.size("x").alias("n")).first()
    if first is None:
        return None
    dim = first["n"]
    n, sums = _totals(vectors, dim)
    _, q = incremental_spectrum(vectors, dim, n, sums)
    small = _products(vectors, dim, n, sums, q)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    basis = np.linalg.qr(q @ turn)[0]
    order = np.argsort(-values, kind="stable")
    return {
        "n": n, "sums": sums, "values": values[order], "basis": basis[:, order], "trace": float(np.trace(small)),
    }


def whiten(
    rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Per vector and component, numbered from 1 by falling variance: ``id_col,
    component, n, deviation, whitened, explained, identity_error``.

    Null vectors, empty ones, those with null or non-finite entries, and those
    shorter than the longest one (their last entries are missing) are left out.
    Repeated rows and ids are rows of their own. Components without variance
    (fewer rows than components, or constant dimensions) are left out, so a
    table of equal vectors, or of one, has no rows. Components of equal variance
    are any basis of their space. Other columns are not read; no rows in, no rows
    out. ``deviation`` is exact and raises where it exceeds a long.
    """
    vectors = to_integers(rows, id_col, vec_col)
    longest = vectors.agg(F.max(F.size("x"))).first()[0]
    kind = rows.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
        "identity_error double"
    )
    if longest is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    vectors = vectors.where(F.size("x") == longest)
    fit = fit_whitening(vectors)
    n, sums, trace = fit["n"], fit["sums"], fit["trace"]
    keep = [j for j in range(min(components, longest)) if fit["values"][j] > LEAST_SHARE * trace]
    if not keep:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    values, k, dim = fit["values"][keep], len(keep), longest
    project = fit["basis"][:, keep] / np.sqrt(values)
    error = float(np.abs(_products(vectors, dim, n, sums, project) - np.eye(k)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            off = _scaled(_matrix(b, dim), n, sums)
            if off.dtype != object and dim * float(np.abs(off).max()) ** 2 >= 2.0**62:
                off = off.astype(object)
            deviation = (off * off).sum(1)
            white = (off.astype(float) / n) @ project
            m = b.num_rows
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(b.schema.get_field_index("id")).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(deviation, k).tolist(), pa.int64()),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, schema).withColumnRenamed("id", id_col)
