"""Embedding whitening by principal components.

Entries become whole numbers floor(64 * c) + offset, so that counts, sums and deviations are exact. Tasks
add up their rows, Spark adds the tasks': first counts and sums per dimension, then, with the means
known, the products of centred entries. The covariance, a square matrix of the dimensions and so of
checked size, goes to the driver: Householder reflections make it tridiagonal, Sturm counts bisect for its
leading eigenvalues, and inverse iteration, orthogonalised again within clusters of close eigenvalues, gives
the components. Their broadcast projection whitens every row, and one more pass measures how far the
covariance of the whitened values is from the identity.

Vectors that are null or hold a null or non-finite entry are dropped. Vectors of each length are a set of
their own, with their own n, sums and components; empty ones have no component. Entries saturate at
2^62. Components without variance beyond rounding (1e-11 of the first) are left out, so equal vectors
have none. Repeated and null vec_ids are rows like any others. Squared lengths may sum up to
``MOST_ENTRIES``; beyond it the operator raises before it collects anything.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridtide.llm.batches import arrow_schema, pick, record_batch
from gridtide.plans.work import written

COMPONENTS, SCALE, OFFSET = 32, 64.0, 1_000_000
MOST_ENTRIES = 1 << 24
# The covariance is added up by at most this many tasks, each with one row per pair of dimensions.
PARTIALS = 4_096
# Entries stay below this, so that differences of two fit 64 bits.
_FAR = 1 << 62
_ROUNDING = 1e-11
_LENGTHS = "size int, at int, n bigint, total decimal(38,0), low bigint, high bigint"
_PRODUCTS = "size int, i int, j int, total double"
_WHITE = "size int, vec_id bigint, n bigint, deviation decimal(38,0), whitened array<double>"


class Basis(NamedTuple):
    """What the vectors of one length are projected with."""

    n: int
    sums: list[int]
    span: int
    mean: np.ndarray
    values: np.ndarray
    trace: float
    projection: np.ndarray


def whiten(
    embeddings: DataFrame,
    components: int = COMPONENTS,
    scale: float = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, n, deviation, whitened, explained and identity_error for every sound row.

    ``whitened`` and ``explained`` have one entry per component. ``deviation`` is the exact sum over the
    dimensions of (n * x - S)^2, null where it has more than 38 digits.
    """
    rows = pick(embeddings, vec_id=id_col, v=vector_col).withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.filter("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('infinity'))")
    rows = rows.filter("size(v) > 0")
    spark = rows.sparkSession
    bases = _fit(rows, components, scale)
    shared = spark.sparkContext.broadcast(bases)
    errors = _identity_errors(rows, shared, scale)
    facts = [(size, [float(e / b.trace) for e in b.values], errors.get(size)) for size, b in bases.items()]
    facts = spark.createDataFrame(facts, "size int, explained array<double>, identity_error double")
    white = rows.mapInArrow(_whitener(shared, scale), _WHITE)
    # One row of facts per length, and lengths are few (MOST_ENTRIES).
    return white.join(F.broadcast(facts), "size").drop("size")


def _whole(batch: pa.RecordBatch, scale: float):
    """(rows, entries) of a batch for each length of its vectors."""
    lists = batch.column(1)
    sizes = lists.value_lengths().to_numpy()
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        values = lists.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), size)
        with np.errstate(over="ignore"):
            scaled = np.clip(np.floor(scale * values), -float(_FAR), float(_FAR))
        yield rows, scaled.astype(np.int64)


def _sums(scale: float):
    out = arrow_schema(_LENGTHS)

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for rows, whole in _whole(batch, scale):
                low, high = whole.min(axis=0), whole.max(axis=0)
                near = max(-int(low.min()), int(high.max())) * len(rows) < _FAR
                total = (whole if near else whole.astype(object)).sum(axis=0)
                part = [len(rows), np.array(total.tolist(), dtype=object), low, high]
                old = found.get(whole.shape[1])
                if old:
                    part = [old[0] + part[0], old[1] + part[1], np.minimum(old[2], low), np.maximum(old[3], high)]
                found[whole.shape[1]] = part
        for size, (n, total, low, high) in found.items():
            sums = [Decimal(t) for t in total.tolist()]
            yield record_batch(out, [[size] * size, range(size), [n] * size, sums, low, high])

    return run


def _fit(rows: DataFrame, components: int, scale: float) -> dict[int, Basis]:
    added = rows.mapInArrow(_sums(scale), _LENGTHS).groupBy("size", "at")
    lengths = written(added.agg(*(make(name).alias(name) for name, make in (("n", F.sum), ("total", F.sum), ("low", F.min), ("high", F.max)))))
    entries = lengths.select("size").distinct().agg(F.sum(F.col("size").cast("bigint") * F.col("size"))).first()[0] or 0
    if entries > MOST_ENTRIES:
        raise ValueError(f"Covariances of {entries} entries, more than {MOST_ENTRIES}")
    found: dict[int, list] = {}
    for row in lengths.orderBy("size", "at").collect():
        found.setdefault(row["size"], []).append((row["n"], int(row["total"]), row["low"], row["high"]))
    means = {size: np.array([float(Fraction(total, n)) for n, total, *_ in dims]) for size, dims in found.items()}
    shared = rows.sparkSession.sparkContext.broadcast(means)
    products = {size: np.zeros((size, size)) for size in found}
    for row in _added(rows, lambda: (shared.value.__getitem__, None), scale).collect():
        products[row["size"]][row["i"], row["j"]] = products[row["size"]][row["j"], row["i"]] = row["total"]
    bases = {}
    for size, dims in found.items():
        n = dims[0][0]
        covariance = products[size] / n
        values, vectors = leading(covariance, components)
        spread = max(high - low for *_, low, high in dims)
        far = max(max(-low, high) for *_, low, high in dims)
        bases[size] = Basis(n, [total for _, total, *_ in dims], max(spread, far), means[size], values, float(np.trace(covariance)), vectors / np.sqrt(values))
    return bases


def _added(rows: DataFrame, prepare, scale: float) -> DataFrame:
    """Sums of products (size, i <= j, total) of the centred entries, or of their projections.

    ``prepare()`` gives, inside the task, the means by length and the projections by length or None.
    """
    out = arrow_schema(_PRODUCTS)

    def run(batches):
        mean, projection = prepare()
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, whole in _whole(batch, scale):
                size = whole.shape[1]
                centred = whole - mean(size)
                if projection is not None:
                    centred = centred @ projection(size)
                found[size] = found.get(size, 0.0) + centred.T @ centred
        for size, total in found.items():
            i, j = np.triu_indices(len(total))
            yield record_batch(out, [np.full(len(i), size), i, j, total[i, j]])

    parts = rows.coalesce(PARTIALS).mapInArrow(run, _PRODUCTS)
    return parts.groupBy("size", "i", "j").agg(F.sum("total").alias("total"))


def _identity_errors(rows: DataFrame, shared, scale: float) -> dict[int, float]:
    """Largest absolute entry of the whitened values' covariance minus the identity, by length.

    Whitened values are centred already: they are projections of centred entries.
    """

    def prepare():
        bases = shared.value
        return lambda size: bases[size].mean, lambda size: bases[size].projection

    counts = {size: basis.n for size, basis in shared.value.items()}
    covered = F.create_map(*(F.lit(x) for pair in counts.items() for x in pair)) if counts else F.create_map(F.lit(0), F.lit(1))
    off = F.abs(F.col("total") / covered[F.col("size")] - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    found = _added(rows, prepare, scale).groupBy("size").agg(F.max(off).alias("error"))
    return {row["size"]: row["error"] for row in found.collect()}


def _whitener(shared, scale: float):
    out = arrow_schema(_WHITE)

    def run(batches):
        bases = shared.value
        for batch in batches:
            for rows, whole in _whole(batch, scale):
                size = whole.shape[1]
                basis = bases[size]
                white = (whole - basis.mean) @ basis.projection
                flat = pa.array(white.ravel())
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * white.shape[1])
                columns = [np.full(len(rows), size), batch.column(0).take(pa.array(rows)), np.full(len(rows), basis.n)]
                yield record_batch(out, [*columns, _deviations(whole, basis), pa.ListArray.from_arrays(offsets, flat).cast(out.field("whitened").type)])

    return run


def _deviations(whole: np.ndarray, basis: Basis) -> pa.Array:
    """Sums of (n * x - S)^2: the offset of x cancels, so the entries without it give the same."""
    most = len(basis.sums) * (2 * basis.n * basis.span) ** 2
    if most < 1 << 63:
        apart = whole * basis.n - np.array(basis.sums, dtype=np.int64)
        return pa.array((apart * apart).sum(axis=1)).cast(pa.decimal128(38, 0))
    apart = whole.astype(object) * basis.n - np.array(basis.sums, dtype=object)
    exact = (apart * apart).sum(axis=1).tolist()
    return pa.array([Decimal(e) if e < 10**38 else None for e in exact], type=pa.decimal128(38, 0))


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    At most ``count``, and only those above rounding. Each vector's largest entry is positive.
    """
    diagonal, off, reflections = _tridiagonal(matrix)
    values = _bisected(diagonal, off, min(count, len(diagonal)))
    values = values[values > _ROUNDING * max(values[0], 0.0)] if len(values) else values
    if not len(values):
        return values, np.zeros((len(diagonal), 0))
    vectors = _inverse_iterated(diagonal, off, values)
    for at, v in reversed(reflections):
        vectors[at:] -= 2.0 * np.outer(v, v @ vectors[at:])
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[largest, np.arange(len(values))])


def _tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Householder reduction: diagonal, off-diagonal, and the unit vectors of the reflections."""
    a = matrix.astype(np.float64, copy=True)
    size = len(a)
    reflections = []
    for k in range(size - 2):
        column = a[k + 1 :, k]
        if not np.any(column[1:]):
            continue
        # Scaled, so that squares of very small or large entries keep their digits.
        v = column / np.abs(column).max()
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        a[k + 1 :, k] -= 2.0 * v * (v @ column)
        a[k, k + 1 :] = a[k + 1 :, k]
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        reflections.append((k + 1, v))
    return a.diagonal().copy(), a.diagonal(1).copy(), reflections


def _below(diagonal: np.ndarray, squares: np.ndarray, shifts: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each shift."""
    count = np.zeros(len(shifts), dtype=np.int64)
    q = np.ones(len(shifts))
    for at, d in enumerate(diagonal.tolist()):
        q = d - shifts - (squares[at - 1] / q if at else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def _bisected(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, each to the last digits of a double."""
    size = len(diagonal)
    reach = np.concatenate((np.abs(off), [0.0])) + np.concatenate(([0.0], np.abs(off)))
    norm = float((np.abs(diagonal) + reach).max(initial=0.0))
    if norm == 0.0:
        return np.zeros(count)
    squares = off * off
    tiny = max(np.finfo(float).tiny / np.finfo(float).eps, float(squares.max(initial=0.0)) * np.finfo(float).tiny)
    low, high = np.full(count, -1.001 * norm), np.full(count, 1.001 * norm)
    wanted = size - 1 - np.arange(count)
    for _ in range(2_000):
        middle = 0.5 * (low + high)
        if np.all((high - low <= 2 * np.finfo(float).eps * np.maximum(np.abs(low), np.abs(high))) | (high - low <= 1e-30 * norm)):
            break
        above = _below(diagonal, squares, middle, tiny) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return 0.5 * (low + high)


def _inverse_iterated(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Eigenvectors of a tridiagonal matrix, all values at once; close ones are made orthogonal in every round."""
    size = len(diagonal)
    norm = float((np.abs(diagonal).max(initial=0.0)) + 2 * np.abs(off).max(initial=0.0))
    solve = _solver(diagonal, off, values, np.finfo(float).eps * norm)
    # A cluster starts where the gap to the value before is large.
    starts = np.concatenate(([True], np.abs(np.diff(values)) > 1e-3 * norm))
    cluster = np.cumsum(starts)
    vectors = np.random.default_rng(size).standard_normal((size, len(values)))
    for _ in range(rounds):
        vectors = solve(vectors)
        for k in range(len(values)):
            v = vectors[:, k] / np.abs(vectors[:, k]).max()
            for other in range(k - 1, -1, -1):
                if cluster[other] != cluster[k]:
                    break
                v -= (vectors[:, other] @ v) * vectors[:, other]
            vectors[:, k] = v / np.sqrt(v @ v)
    return vectors


def _solver(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray, tiny: float):
    """Solves (T - shift) x = b for each shift and its column b, by elimination with row exchanges."""
    size, none = len(diagonal), np.zeros(len(shifts))
    pivots, first, second, factors, swaps = [], [], [], [], []
    here = diagonal[0] - shifts
    beside = none + off[0] if size > 1 else none
    for at in range(size - 1):
        below, next_, after = none + off[at], diagonal[at + 1] - shifts, none + (off[at + 1] if at + 2 < size else 0.0)
        swap = np.abs(below) > np.abs(here)
        pivot = np.where(swap, below, here)
        pivot = np.where(np.abs(pivot) < tiny, tiny, pivot)
        one, two = np.where(swap, next_, beside), np.where(swap, after, 0.0)
        factor = np.where(swap, here, below) / pivot
        here = np.where(swap, beside, next_) - factor * one
        beside = np.where(swap, 0.0, after) - factor * two
        for kept, value in zip((pivots, first, second, factors, swaps), (pivot, one, two, factor, swap)):
            kept.append(value)
    last = np.where(np.abs(here) < tiny, tiny, here)

    def solve(right: np.ndarray) -> np.ndarray:
        b = right.copy()
        for at in range(size - 1):
            top, bottom = np.where(swaps[at], b[at + 1], b[at]), np.where(swaps[at], b[at], b[at + 1])
            b[at], b[at + 1] = top, bottom - factors[at] * top
        b[size - 1] /= last
        for at in range(size - 2, -1, -1):
            b[at] -= first[at] * b[at + 1]
            if at + 2 < size:
                b[at] -= second[at] * b[at + 2]
            b[at] /= pivots[at]
        return b

    return solve
