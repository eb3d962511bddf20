"""Whitening of vectors by shifted CholeskyQR.

The centred rows A are never gathered.  A pass over the vectors adds up the Gram
matrix of A times the inverse of what is known of R, through triangular solves
in each task; the driver takes its Cholesky factor and composes it with the
factors before.  The first passes shift the diagonal, so the factorisation holds
however ill-conditioned the rows are; passes go on until the rows come out
orthonormal.  The composed R has the singular values and right vectors of A, to
double precision, though only sums of squares were ever added.  The SVD of R
then gives the components: a vector's whitened values are its centred entries,
projected on a component and divided by the root of its eigenvalue.

Entries are whole numbers, floor(64 c) + 1000000, so sums and deviations are
exact and rows are centred as (n x - S) / n with one rounding.

What reaches the driver: partial Gram matrices of 64 MB in all, whatever the rows.

Defined results: vectors that are null or hold a null or non-finite entry are
left out; shorter vectors are filled with zeros to the longest; entries whose
floor(64 c) is beyond 2**62 count as that; components without variance (fewer vectors than
entries, constant or dependent entries) have no whitened values and no rows; a
null id, repeated rows and ties are rows like any other; an empty table, or one
without any variance, gives an empty result.  Other columns play no part.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankbench.session import task_count

SCALE, OFFSET = 64.0, 1_000_000
FARTHEST = 2.0**62
COMPONENTS = 32
# Passes of the factorisation at most; two or three are enough for most tables.
PASSES = 8
# Rows come out orthonormal when no entry of their Gram matrix is further off.
ORTHONORMAL = 1e-13
# Singular values below this share of the largest are rounding, for each entry.
RANK = 2.0**-50
# Bytes of partial matrices that may come to the driver, beside one that has to.
DRIVER_BYTES = 64 << 20


@dataclass
class Whitening:
    """``n`` vectors with sums ``sums``; ``eigenvalues`` and the rows of ``components`` by falling variance."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    total: float
    passes: int


def whole_numbers(vectors: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their entries as whole numbers)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    values = vectors.flatten()  # entries of rows that are not null
    entries = values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become nan
    lengths = np.asarray(vectors.value_lengths().fill_null(0), dtype=np.int64)
    given = np.asarray(vectors.is_valid())
    owner = np.repeat(np.arange(n), lengths)
    bad = np.zeros(n, bool)
    bad[owner[~np.isfinite(entries)]] = True
    takes = given & ~bad
    width = int(lengths[takes].max()) if takes.any() else 0
    dim = width if dim is None else dim
    matrix = np.zeros((n, dim), np.int64)
    at = np.arange(len(entries)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    here = takes[owner]
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * entries[here])
    matrix[owner[here], at[here]] = np.clip(scaled, -FARTHEST, FARTHEST).astype(np.int64)
    return np.flatnonzero(takes), matrix[takes] + OFFSET


def deviations(whole: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S for every entry, exactly: 64-bit numbers where they hold it, else Python's."""
    most = int(np.abs(whole.astype(np.float64)).max(initial=0.0)) + 1
    if most * n + max(map(abs, sums), default=0) < 2**62:
        return n * whole - np.array(sums, dtype=np.int64)
    return n * whole.astype(object) - np.array([int(s) for s in sums], dtype=object)


def squared(far: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    if far.dtype != object and len(far):
        most = float(np.abs(far).max(initial=0))
        if most * most * max(1, far.shape[1]) < 2.0**62:
            return [int(d) for d in (far * far).sum(axis=1)]
    return [sum(int(d) * int(d) for d in row) for row in far]


def _centred(whole: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return deviations(whole, n, sums).astype(np.float64) / n


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, S) of all vectors that take part.  Runs a job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, []
        for batch in batches:
            _, whole = whole_numbers(batch.column(0))
            # a vector that is shorter than others has zeros there
            sums += [n * OFFSET] * (whole.shape[1] - len(sums))
            high, low = whole >> 32, whole & 0xFFFFFFFF
            added = [(int(h) << 32) + int(k) for h, k in zip(high.sum(axis=0), low.sum(axis=0))]
            added += [len(whole) * OFFSET] * (len(sums) - len(added))
            sums = [a + b for a, b in zip(sums, added)]
            n += len(whole)
        at = list(range(len(sums)))
        yield pa.RecordBatch.from_pydict(
            {
                "at": pa.array([-1, *at], pa.int32()),
                "n": pa.array([n] * (len(at) + 1), pa.int64()),
                "s": pa.array([Decimal(0), *map(Decimal, sums)], pa.decimal128(38, 0)),
            }
        )

    parts = rows.mapInArrow(run, "at int, n long, s decimal(38,0)")
    added = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    n = next((r["n"] for r in added if r["at"] == -1), 0)
    # tasks whose vectors are all shorter count with zeros
    by = sorted((r["at"], int(r["s"]) + (n - r["n"]) * OFFSET) for r in added if r["at"] >= 0)
    return n, [s for _, s in by]


def _gram(rows: DataFrame, dim: int, make) -> tuple[np.ndarray, np.ndarray]:
    """Sum of q^T q, and of q, over the matrices q that ``make`` gives of whole numbers.

    Each task adds up its rows; the tasks' matrices are added by a bounded number
    of tasks, whose matrices come to the driver.  Runs a job.
    """
    width = dim * dim + dim
    most = int(max(1, min(task_count(rows.sparkSession), DRIVER_BYTES // (8 * width))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total = np.zeros((dim, dim)), np.zeros(dim)
        for batch in batches:
            _, whole = whole_numbers(batch.column(0), dim)
            if len(whole):
                q = make(whole)
                gram += q.T @ q
                total += q.sum(axis=0)
        yield packed(TaskContext.get().partitionId(), np.concatenate([gram.ravel(), total]))

    def packed(task: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "task": pa.array([task], pa.int32()),
                "sums": pa.array([sums.astype("<f8").tobytes()], pa.binary()),
            }
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, first = np.zeros(width), None
        for batch in batches:
            for task, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                first = task if first is None else min(first, task)
                sums += np.frombuffer(part.as_py(), "<f8")
        if first is not None:
            yield packed(first, sums)

    schema = "task int, sums binary"
    parts = rows.mapInArrow(run, schema).repartition(most, "task").sortWithinPartitions("task")
    found = sorted((r["task"], r["sums"]) for r in parts.mapInArrow(add, schema).collect())
    sums = np.zeros(width)
    for _, part in found:
        sums += np.frombuffer(part, "<f8")
    return sums[: dim * dim].reshape(dim, dim), sums[dim * dim :]


def _solved(matrix: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """matrix R1^-1 R2^-1 ..., by one triangular solve after the other."""
    for r in factors:
        matrix = triangular(r, matrix)
    return matrix


def triangular(r: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """X with X R = matrix, for an upper triangular R, by columns in blocks."""
    dim, step = len(r), 32
    x = np.empty_like(matrix)
    for start in range(0, dim, step):
        stop = min(dim, start + step)
        part = matrix[:, start:stop] - x[:, :start] @ r[:start, start:stop]
        for k in range(start, stop):
            inside = x[:, start:k] @ r[start:k, k]
            x[:, k] = (part[:, k - start] - inside) / r[k, k]
    return x


def fit(df: DataFrame, vector: str = "embedding") -> Whitening | None:
    """Components of all vectors of ``df``; None without any variance.

    Runs a job for the sums and one for each pass.
    """
    rows = df.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    n, sums = _sums(rows)
    dim = len(sums)
    if not n or not dim:
        return None
    unit = np.finfo(np.float64).eps / 2
    factors: list[np.ndarray] = []
    r = np.eye(dim)
    scale = np.ones(dim)
    for k in range(PASSES):
        known = list(factors)
        gram, _ = _gram(rows, dim, lambda whole: _solved(_centred(whole, n, sums) / scale, known))
        if k == 0:
            # entries are first brought to one size, so a small one is no rounding of a large one
            spread = np.sqrt(np.diag(gram))
            live = spread > 0
            if not live.any():
                return None
            scale = np.where(live, spread, 1.0)
            gram = gram / np.outer(scale, scale)
        off = np.abs(gram - np.diag(live.astype(float))).max()
        if k and off <= ORTHONORMAL * dim:
            break
        # a shift above all rounding of the sums makes the matrix safely definite; it is
        # left out once the rows are near orthonormal
        size = np.linalg.norm(gram, 2)
        shift = 11.0 * (dim * n**0.5 + dim * (dim + 1)) * unit * size if k == 0 or off > 0.5 else 0.0
        pinned = gram + np.diag(np.where(live, shift, 1.0))
        factors.append(np.linalg.cholesky(pinned).T)
        r = factors[-1] @ r
    r = r * live[:, None] * scale[None, :]
    _, values, right = np.linalg.svd(r)
    alive = values > RANK * dim * values[0]
    return Whitening(
        n, sums, values[alive] ** 2 / n, right[alive], float((values**2).sum() / n), len(factors)
    )


def transform(
    df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS
) -> DataFrame:
    """Rows (key, deviation decimal(38,0), whitened array<double>), one per vector that takes part.

    ``whitened`` has the first ``k`` components, or as many as there are.
    ``deviation`` is null where it has more than 38 digits.
    """
    n, sums = model.n, model.sums
    weights = (model.components[:k] / np.sqrt(model.eigenvalues[:k])[:, None]).T
    fields = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, whole = whole_numbers(batch.column(1), len(sums))
            far = deviations(whole, n, sums)
            exact = [Decimal(d) if d < 10**38 else None for d in squared(far)]
            white = (far.astype(np.float64) / n) @ weights
            ends = np.arange(len(at) + 1, dtype=np.int32) * weights.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(exact, pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel())),
                ],
                names=["id", "deviation", "whitened"],
            )

    id_type = fields.schema["id"].dataType.simpleString()
    found = fields.mapInArrow(run, f"id {id_type}, deviation decimal(38,0), whitened array<double>")
    return found.withColumnRenamed("id", key)


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding", k: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened values' covariance less the identity.  Runs a job."""
    n, sums = model.n, model.sums
    weights = (model.components[:k] / np.sqrt(model.eigenvalues[:k])[:, None]).T
    wide = len(sums)
    rows = df.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))

    def make(whole: np.ndarray) -> np.ndarray:
        white = _centred(whole, n, sums) @ weights
        return np.pad(white, ((0, 0), (0, wide - white.shape[1])))

    gram, total = _gram(rows, wide, make)
    kept = weights.shape[1]
    mean = total[:kept] / n
    return float(np.abs(gram[:kept, :kept] / n - np.outer(mean, mean) - np.eye(kept)).max())
