"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a hash of concatenated signs of random
projections; vectors are sorted by it, and each is compared with the next few
in that order.  Pairs that reach the cosine link, and the links of all passes
are united to components.

In a dense group more vectors lie between two near ones than a window holds, so
further passes compare whole runs: all vectors whose hash begins with the same
few bits, however many.  A pair at the cosine shares such a run with a known
chance whatever lies around it; the bits follow the number of vectors, and the
passes follow the bits, so that a pair is missed by all with a chance of
``MISS`` at most.  Tables of any size go this way.  A long run is compared in
cells of two blocks like a component.

An exact count follows: inside each component every
pair is compared in blocks, so a member's number of links is whole however
narrow the window was.  That count emits a number for each vector, no pairs.

Equal vectors are one node with a count, so any number of copies costs one
comparison and fills no window.  A component is compared in cells of two
blocks, so no task holds a large one.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component link with nothing and keep their own id as component;
vectors of different lengths do not link; rows that repeat a vec_id are vectors
like any other and link with each other; an empty table gives an empty result.
Other columns play no part.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankbench.llm.graph import components, forest
from rankbench.session import checkpointed

COSINE = 0.95
PASSES = 16
WINDOW = 16
BITS = 62
# Bits of a run's prefix, at least.
LEAST_BITS = 4
SEED = 11
# Vectors in one block of the exact count, and the rows that share a task's frame.
BLOCK = 1024
# Chance that no run holds both vectors of a pair that just reaches the cosine.
MISS = 1e-6
# A long run is cut into this many blocks, and into more once they have MOST rows.
PARTS = 16
MOST = 16_384
# Long runs up to this many are broadcast.
BROADCAST = 100_000
# Rounding of a 32-bit cosine, far below what is looked for.
SLACK = 1e-3
# Cosines that a task holds at a time.
TILE = 1 << 20


def usable(vector: Column) -> Column:
    """Whether a vector can take part."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return F.coalesce(
        vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def planes(dim: int, passes: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * bits))


def _matrix(column: pa.Array, dtype) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) for each vector length in a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    out = []
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        out.append((at, values[starts[at][:, None] + np.arange(dim)]))
    return out


def _keyed(passes: int, bits: int, seed: int, dtype):
    """One row for each vector and pass: (pass, dim, key, the other columns, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            others = [c for c in batch.schema.names if c != "vector"]
            for at, matrix in _matrix(batch.column("vector"), dtype):
                dim = matrix.shape[1]
                if dim not in made:
                    made[dim] = planes(dim, passes, bits, seed)
                raw = pa.array([row.tobytes() for row in matrix], pa.binary())
                for p in range(passes):
                    signs = matrix @ made[dim][:, p * bits : (p + 1) * bits] > 0
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, p, np.int32)),
                            pa.array(np.full(n, dim, np.int32)),
                            pa.array(signs @ powers),
                            *(batch.column(c).take(pa.array(at)) for c in others),
                            raw,
                        ],
                        ["pass", "dim", "key", *others, "vector"],
                    )

    return run


def _unpack(raw: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), dtype).astype(np.float64)


def _neighbours(ids, matrix, window: int, cosine: float):
    """Links between rows at most ``window`` apart, as a forest."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    a, b = [], []
    for step in range(1, min(window, len(ids) - 1) + 1):
        dots = np.einsum("ij,ij->i", matrix[:-step], matrix[step:])
        near = dots / (norms[:-step] * norms[step:]) >= cosine
        a.append(ids[:-step][near])
        b.append(ids[step:][near])
    if not a or not sum(map(len, a)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(np.concatenate(a), np.concatenate(b))


def _windows(window: int, cosine: float, dtype):
    """Links of a sorted partition, and its first and last rows for the seams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        head = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if head < window:
                yield from _rows(0, table.slice(0, window - head))
                head += batch.num_rows
            if tail is not None:
                table = pa.concat_tables([tail, table])
            yield from _links(table)
            tail = table.slice(max(0, table.num_rows - window)).combine_chunks()
        if tail is not None:
            yield from _rows(1, tail)

    def _rows(end: int, table: pa.Table):
        part = table.combine_chunks().to_batches()[0]
        n = part.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, end, np.int32)),
                part.column("part"),
                part.column("pass"),
                part.column("dim"),
                part.column("key"),
                part.column("id"),
                pa.nulls(n, pa.int64()),
                part.column("vector"),
            ],
            ["end", "part", "pass", "dim", "key", "a", "b", "vector"],
        )

    def _links(table: pa.Table):
        for a, b in _run_links(table, window, cosine, dtype):
            n = len(a)
            none = pa.nulls(n, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.nulls(n, pa.int64()), pa.array(a), pa.array(b), pa.nulls(n, pa.binary())],
                ["end", "part", "pass", "dim", "key", "a", "b", "vector"],
            )

    return run


def _run_links(table: pa.Table, window: int, cosine: float, dtype):
    """Links within each run of rows of one pass and one vector length."""
    table = table.combine_chunks()
    mark = np.stack([table.column("pass").to_numpy(), table.column("dim").to_numpy()])
    ids = table.column("id").to_numpy()
    edges = np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0)) + 1
    for start, stop in zip([0, *edges], [*edges, len(ids)]):
        if stop - start < 2:
            continue
        raw = table.column("vector").slice(start, stop - start)
        matrix = _unpack(raw, dtype).reshape(stop - start, -1)
        a, b = _neighbours(ids[start:stop], matrix, window, cosine)
        if len(a):
            yield a, b


def projection_links(
    vectors: DataFrame,
    cosine: float = COSINE,
    passes: int = PASSES,
    window: int = WINDOW,
    bits: int = BITS,
    seed: int = SEED,
) -> DataFrame:
    """Links (a, b) of the sorted passes over rows (id, vector), ids unique.

    Only links that hold components together come back, not all pairs.  All
    passes are one range-sorted table; where two of its partitions meet, their
    last and first rows are compared once more.  Runs jobs.
    """
    element = vectors.schema["vector"].dataType.elementType.simpleString()
    dtype = np.float32 if element == "float" else np.float64
    order = ["pass", "dim", "key", "id"]
    ranked = (
        vectors.select("id", "vector")
        .mapInArrow(
            _keyed(passes, bits, seed, dtype), "pass int, dim int, key long, id long, vector binary"
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )
    schema = "end int, part int, pass int, dim int, key long, a long, b long, vector binary"
    met = checkpointed(ranked.mapInArrow(_windows(window, cosine, dtype), schema))
    links = met.where("end is null").select("a", "b")
    ends = met.where("end is not null")
    # partitions that have rows, in order: the last rows of one meet the first of the next
    parts = sorted(r["part"] for r in ends.select("part").distinct().collect())
    places = ends.sparkSession.createDataFrame(
        [(p, i) for i, p in enumerate(parts)] or [(-1, -1)], "part int, place int"
    )
    seams = ends.join(places, "part").withColumn("seam", F.col("place") - F.lit(1) + F.col("end"))

    def across(frame):
        first = frame[frame["end"] == 1].sort_values(["pass", "dim", "key", "a"])
        second = frame[frame["end"] == 0].sort_values(["pass", "dim", "key", "a"])
        both = pa.Table.from_pandas(
            pd.concat([first, second])[["pass", "dim", "a", "vector"]].rename(columns={"a": "id"}),
            preserve_index=False,
        )
        found = list(_run_links(both, window, cosine, dtype)) if both.num_rows else []
        return pd.DataFrame(
            {
                "a": np.concatenate([a for a, _ in found]) if found else np.empty(0, np.int64),
                "b": np.concatenate([b for _, b in found]) if found else np.empty(0, np.int64),
            }
        )

    return links.unionByName(seams.groupBy("seam").applyInPandas(across, "a long, b long"))


def run_passes(vectors: int, cosine: float, block: int, miss: float = MISS) -> tuple[int, int]:
    """(bits, passes) of the runs: about a block in a run of spread-out vectors.

    A small table has ``LEAST_BITS`` all the same, so it is not one run.  Signs of
    one projection differ for a pair with a chance of angle / pi.
    """
    bits = min(BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, vectors) / block))))
    shared = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** bits
    return bits, 1 if shared >= 1 else math.ceil(math.log(miss) / math.log1p(-shared))


def _run_cell(cosine: float, dtype):
    """Links between the two blocks of a cell that are not in one component yet, as a forest."""

    def run(frame):
        matrix = np.frombuffer(b"".join(frame["vector"]), dtype).astype(np.float64)
        matrix = matrix.reshape(len(frame), -1)
        norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        unit = (matrix / norms[:, None]).astype(np.float32)
        own, ids, root = (frame[c].to_numpy() for c in ("own", "id", "root"))
        left = np.flatnonzero(own == frame["i"].iloc[0])
        right = np.flatnonzero(own == frame["j"].iloc[0])
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        step = max(1, TILE // max(1, len(right)))
        for start in range(0, len(left), step):
            rows = left[start : start + step]
            maybe = unit[rows] @ unit[right].T >= cosine - SLACK
            rows = rows[maybe.any(axis=1)]
            if not len(rows):
                continue
            maybe = maybe[maybe.any(axis=1)] & (root[rows][:, None] != root[right])
            rows, maybe = rows[maybe.any(axis=1)], maybe[maybe.any(axis=1)]
            near = matrix[rows] @ matrix[right].T / np.outer(norms[rows], norms[right]) >= cosine
            x, y = np.nonzero(near & maybe)
            if len(x):
                a, b = forest(np.concatenate([a, ids[rows[x]]]), np.concatenate([b, ids[right[y]]]))
        return pd.DataFrame({"a": a, "b": b})

    return run


def run_links(
    members: DataFrame, cosine: float = COSINE, seed: int = SEED, block: int = BLOCK
) -> DataFrame:
    """Links (a, b) across components, for rows (id, root, vector), ids unique.

    Compares all vectors of a run, the runs of ``run_passes``; density only makes
    more cells.  A run of up to ``block`` vectors is one cell.  Counts the members
    and the long runs.
    """
    element = members.schema["vector"].dataType.elementType.simpleString()
    dtype = np.float32 if element == "float" else np.float64
    bits, passes = run_passes(members.count(), cosine, block)
    run = ["pass", "dim", "key"]
    keyed = members.select("id", "root", "vector").mapInArrow(
        _keyed(passes, bits, seed, dtype),
        "pass int, dim int, key long, id long, root long, vector binary",
    )
    blocks = F.greatest(
        F.least(F.ceil(F.col("n") / block), F.lit(PARTS)), F.ceil(F.col("n") / max(block, MOST))
    )
    large = checkpointed(
        keyed.groupBy(*run)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > block)
        .select(*run, blocks.cast("int").alias("blocks"))
    )
    large = F.broadcast(large) if large.count() <= BROADCAST else large
    placed = keyed.join(large, run, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cells = (
        placed.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            *run, "id", "root", "vector", "own",
            F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        )
    )
    return cells.groupBy(*run, "i", "j").applyInPandas(
        _run_cell(cosine, dtype), "a long, b long"
    )


def _count_cell(cosine: float, dtype):
    """Links of each vector to the others in its cells, copies counted."""

    def run(frame):
        out_ids, out_links = [], []
        for _, cell in frame.groupby(["root", "i", "j"], sort=False):
            for _, same in cell.groupby(cell["vector"].str.len(), sort=False):
                matrix = np.frombuffer(b"".join(same["vector"]), dtype).astype(np.float64)
                matrix = matrix.reshape(len(same), -1)
                norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
                own, ids = same["own"].to_numpy(), same["id"].to_numpy()
                copies = same["copies"].to_numpy()
                i, j = same["i"].iloc[0], same["j"].iloc[0]
                left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
                near = (
                    matrix[left] @ matrix[right].T / np.outer(norms[left], norms[right]) >= cosine
                )
                if i == j:
                    np.fill_diagonal(near, False)
                out_ids.append(ids[left])
                out_links.append(near @ copies[right])
                if i != j:
                    out_ids.append(ids[right])
                    out_links.append(near.T @ copies[left])
        return pd.DataFrame(
            {"id": np.concatenate(out_ids), "links": np.concatenate(out_links).astype(np.int64)}
        )

    return run


def link_counts(
    members: DataFrame, cosine: float = COSINE, block: int = BLOCK
) -> DataFrame:
    """Rows (id, links) for rows (id, root, copies, vector): links inside each root's group.

    A group is cut into blocks by a hash of the id, and every pair of blocks is a
    cell of its own; small groups share frames of about ``block`` rows.  Counts
    the members.
    """
    element = members.schema["vector"].dataType.elementType.simpleString()
    dtype = np.float32 if element == "float" else np.float64

    @F.arrow_udf("binary")
    def packed(vectors: pa.Array) -> pa.Array:
        return pa.array([np.array(v.as_py(), dtype).tobytes() for v in vectors], pa.binary())

    frames = members.count() // block + 1
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = members.join(sizes, "root").select(
        "root", "id", "copies", packed("vector").alias("vector"),
        blocks.alias("blocks"),
        F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"),
    )
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", "id", "copies", "vector", "own",
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        # small groups meet in shared frames
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(frames)))
        .otherwise(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")))
        .alias("frame"),
    )
    counted = cells.groupBy("frame").applyInPandas(
        _count_cell(cosine, dtype), "id long, links long"
    )
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(
    table: DataFrame,
    cosine: float = COSINE,
    passes: int = PASSES,
    window: int = WINDOW,
    bits: int = BITS,
    seed: int = SEED,
    block: int = BLOCK,
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row (vec_id, embedding).

    Runs jobs.
    """
    rows = table.select("vec_id", "embedding")
    good = rows.where(usable(F.col("embedding")))
    # a vector without id can be linked to but names nothing
    distinct = checkpointed(
        good.groupBy("embedding").agg(
            F.min("vec_id").alias("first"),
            F.count(F.lit(1)).alias("copies"),
        ).withColumn("id", F.monotonically_increasing_id())
    )
    vectors = distinct.select("id", F.col("embedding").alias("vector"))

    def joined(roots):
        return checkpointed(
            distinct.join(roots, F.col("id") == F.col("node"), "left").select(
                "id", "embedding", "first", "copies",
                F.coalesce("root", "id").alias("root"),
            )
        )

    roots = components(projection_links(vectors, cosine, passes, window, bits, seed))
    linked = joined(roots)
    more = checkpointed(
        run_links(
            linked.select("id", "root", F.col("embedding").alias("vector")), cosine, seed, block
        )
    )
    if more.take(1):
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        linked = joined(components(known.unionByName(more)))
    names = linked.groupBy("root").agg(
        F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members")
    )
    shared = names.where("members > 1").select("root")
    counts = link_counts(
        checkpointed(
            linked.join(shared, "root", "left_semi").select(
                "id", "root", "copies", F.col("embedding").alias("vector")
            )
        ),
        cosine,
        block,
    )
    found = (
        linked.join(names, "root")
        .join(counts, "id", "left")
        .select(
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            "component_id",
        )
    )
    whole = good.join(found, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable(F.col("embedding"))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return whole.unionByName(alone).select(
        "vec_id",
        F.col("n_links").cast("long").alias("n_links"),
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
