"""Nearest neighbours by inner product from a forest of random-projection trees.

Vectors get one more component that makes all of them equally long, so the
largest inner product is the nearest direction.  Each tree splits a bounded
sample at the median of a random projection, again and again; every vector is
then sent to its leaf in every tree.  A query walks all trees at once: one
priority queue holds the branches not taken, by the squared margins on the way,
and leaves are opened in that order until they hold enough vectors.  The
opened leaves' vectors are ranked exactly.

Each vector lies in one place, with the numbers of its leaves in all trees: in
cells of bounded size made of the first tree's leaves, an overfull leaf spread
over several, small ones sharing one.  A query is known by its opened leaves,
one bit each; queries come in blocks, and each (cell, query block) is one task's
work, in which a vector is ranked once if any of its leaves is open, and from
which only the best few of each query leave.  Equal vectors are one candidate
that carries its smallest ids, and one query whatever their number, so copies
fill no leaf and cost no search.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component take no part, nor do vectors of another length than most
have; ties go to the smaller id; a row that repeats an id and its vector counts
once; rows without id are no candidates; fewer candidates than asked give all
that were found; an empty table gives an empty result.  Other columns play no
part.
"""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankbench.llm.sampling import first_by_hash
from rankbench.llm.vector_dedup import usable
from rankbench.session import checkpointed

NEAREST = 20
TREES = 8
LEAF = 64
# Distinct vectors the trees are fitted on, at most: it bounds trees and leaves.
SAMPLE = 65_536
# Random projections tried at each split; the one that spreads the sample most is taken.
TRIES = 32
# Vectors in the opened leaves of a query, repeats in several trees counted, as a
# share of all.  The recall follows from it; see the README for measured figures.
OPENED = 1.3
SEED = 29
CELL_ROWS = 8_192
QUERY_BLOCK = 4_096


@dataclass
class Tree:
    """Split nodes in arrays; a child below zero is leaf ``-child - 1``."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    root: int
    leaves: int

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root)
        while True:
            open_ = np.flatnonzero(at >= 0)
            if not len(open_):
                return -at - 1
            node = at[open_]
            side = np.einsum("ij,ij->i", points[open_], self.normals[node]) > self.cuts[node]
            at[open_] = self.children[node, side.astype(int)]


def grow(points: np.ndarray, leaf: int, tries: int, seed) -> Tree:
    """Tree over sample points; splits that don't separate end in a leaf."""
    rng = np.random.default_rng(seed)
    normals, cuts, children = [], [], []
    leaves = 0
    stack = [(np.arange(len(points)), -1, 0)]
    root = -1
    while stack:
        own, parent, side = stack.pop()
        normal = None
        if len(own) > leaf:
            drawn = rng.standard_normal((points.shape[1], tries))
            drawn /= np.linalg.norm(drawn, axis=0)
            spread = (points[own[:2048]] @ drawn).var(axis=0)
            normal = drawn[:, spread.argmax()]
            along = points[own] @ normal
            cut = np.median(along)
            right = along > cut
            if not right.any():
                right = along >= cut
                normal = None if right.all() else normal
                cut = np.nextafter(cut, -np.inf)
        if normal is None:
            here = -leaves - 1
            leaves += 1
        else:
            here = len(cuts)
            normals.append(normal)
            cuts.append(cut)
            children.append([0, 0])
            stack.append((own[~right], here, 0))
            stack.append((own[right], here, 1))
        if parent < 0:
            root = here
        else:
            children[parent][side] = here
    return Tree(
        np.array(normals).reshape(-1, points.shape[1]), np.array(cuts),
        np.array(children, np.int64).reshape(-1, 2), root, leaves,
    )


@dataclass
class Forest:
    trees: list[Tree]
    longest: float  # squared length that every vector is filled up to

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = self.longest - np.einsum("ij,ij->i", vectors, vectors)
        return np.concatenate([vectors, np.sqrt(np.maximum(0, rest))[:, None]], 1)

    def opened(self, query: np.ndarray, sizes: list[np.ndarray], enough: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue until they hold ``enough``."""
        margins = [t.normals @ query - t.cuts if len(t.cuts) else np.empty(0) for t in self.trees]
        queue = [(0.0, k, t.root) for k, t in enumerate(self.trees)]
        heapq.heapify(queue)
        found, held = [], 0
        while queue and held < enough:
            far, k, node = heapq.heappop(queue)
            tree = self.trees[k]
            while node >= 0:
                margin = margins[k][node]
                near = int(margin > 0)
                heapq.heappush(queue, (far + margin * margin, k, int(tree.children[node, 1 - near])))
                node = int(tree.children[node, near])
            if sizes[k][-node - 1]:
                found.append((k, -node - 1))
                held += sizes[k][-node - 1]
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def fit(vectors: DataFrame, trees: int, leaf: int, sample: int, tries: int, seed: int) -> Forest:
    """Forest over at most ``sample`` vectors of rows (rep, vector).  Runs jobs.

    Each tree is grown by one task from the whole sample; the trees, bounded by
    the sample, come to the driver.
    """
    longest = vectors.select(F.max(_squared(F.col("vector")))).first()[0] or 0.0
    picked = first_by_hash(vectors, sample, seed, "rep")

    def grown(key, frame):
        points = np.stack(frame["vector"].to_numpy()).astype(np.float64)
        forest = Forest([], longest)
        tree = grow(forest.lifted(points), leaf, tries, [seed, int(key[0])])
        parts = (tree.normals, tree.cuts, tree.children)
        return pd.DataFrame(
            [[int(key[0]), tree.root, tree.leaves, *[x.tobytes() for x in parts]]],
            columns=["tree", "root", "leaves", "normals", "cuts", "children"],
        )

    rows = (
        picked.select("vector", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
        .groupBy("tree")
        .applyInPandas(grown, "tree int, root int, leaves int, normals binary, cuts binary, children binary")
        .collect()
    )
    out = []
    for r in sorted(rows, key=lambda r: r["tree"]):
        cuts = np.frombuffer(r["cuts"])
        normals = np.frombuffer(r["normals"])
        normals = normals.reshape(len(cuts), len(normals) // max(1, len(cuts)))
        out.append(Tree(normals, cuts, np.frombuffer(r["children"], np.int64).reshape(-1, 2), r["root"], r["leaves"]))
    return Forest(out, longest)


def _squared(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def _cells(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First cell of each leaf, the number of cells it is spread over, and all cells."""
    starts, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    cell = filled = 0
    for leaf, n in enumerate(sizes.tolist()):
        if filled and filled + n > most:
            cell, filled = cell + 1, 0
        starts[leaf] = cell
        parts[leaf] = max(1, -(-n // most))
        if parts[leaf] > 1:
            cell, filled = cell + int(parts[leaf]), 0
        else:
            filled += n
    return starts, parts, cell + 1


def _best(scores: np.ndarray, reps: np.ndarray, most: int) -> np.ndarray:
    """Positions of the best, ties to the smaller id."""
    if len(scores) > most:
        bar = np.partition(scores, len(scores) - most)[len(scores) - most]
        at = np.flatnonzero(scores >= bar)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((reps[at], -scores[at]))][:most]


def _rank_cell(most: int):
    def run(members, probes):
        """Best ``most`` members in opened leaves for each query."""
        out_q, out_r, out_s = [], [], []
        if len(members) and len(probes):
            reps = members["rep"].to_numpy()
            points = np.stack(members["vector"].to_numpy()).astype(np.float64)
            leaves = np.stack(members["leaves"].to_numpy())
            queries = np.stack(probes["vector"].to_numpy()).astype(np.float64)
            names = probes["query"].to_numpy()
            opened = probes["opened"].to_numpy()
            for begin in range(0, len(names), 256):
                scores = queries[begin : begin + 256] @ points.T
                for k, row in enumerate(scores, start=begin):
                    bits = np.unpackbits(np.frombuffer(opened[k], np.uint8)).view(bool)
                    inside = np.flatnonzero(bits[leaves].any(axis=1))
                    best = inside[_best(row[inside], reps[inside], most)]
                    out_q.append(np.full(len(best), names[k]))
                    out_r.append(reps[best])
                    # summed alike in whatever cell the pair meets
                    out_s.append(np.einsum("j,ij->i", queries[k], points[best], optimize=False))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pd.DataFrame(
            {"query": join(out_q, np.int64), "rep": join(out_r, np.int64), "score": join(out_s, float)}
        )

    return run


def search(
    table: DataFrame,
    is_query: Column,
    nearest: int = NEAREST,
    trees: int = TREES,
    leaf: int = LEAF,
    sample: int = SAMPLE,
    tries: int = TRIES,
    opened: float = OPENED,
    seed: int = SEED,
    cell_rows: int = CELL_ROWS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of the ``nearest`` found for each query row.

    ``table`` has (vec_id, embedding).  Runs jobs.
    """
    spark = table.sparkSession
    good = table.select("vec_id", "embedding", is_query.alias("asks")).where(
        F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    )
    usual = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.where(F.size("embedding") == usual["dim"])
    reps = checkpointed(
        good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.bool_or("asks").alias("asks"))
    )
    vectors = reps.select("rep", F.col("embedding").alias("vector"), "asks")
    forest = fit(vectors, trees, leaf, sample, tries, seed)
    shared = spark.sparkContext.broadcast(forest)

    offsets = np.cumsum([0] + [t.leaves for t in forest.trees])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers of a vector's leaves, those of all trees counted on."""
        own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points = own.lifted(_matrix(batch.column("vector")))
            numbers = np.stack([t.leaf_of(points) for t in own.trees], 1) + offsets[:-1]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(points) + 1) * len(own.trees), pa.int32()),
                pa.array(numbers.ravel(), pa.int32()),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("vector"), lists], ["rep", "vector", "leaves"]
            )

    element = reps.schema["embedding"].dataType.elementType.simpleString()
    placed = checkpointed(
        vectors.select("rep", "vector").mapInArrow(
            leaves, f"rep long, vector array<{element}>, leaves array<int>"
        )
    )
    held = np.zeros(offsets[-1], np.int64)
    for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        held[r["leaf"]] = r["count"]
    sizes = [held[i:j] for i, j in zip(offsets, offsets[1:])]
    total = int(sizes[0].sum())
    starts, parts, cells = _cells(sizes[0], cell_rows)
    layout = spark.sparkContext.broadcast((sizes, starts, parts))
    asked = vectors.where("asks").select("rep", "vector")
    blocks = max(1, -(-asked.count() // query_block))

    @F.arrow_udf("long")
    def cell_of(leaf: pa.Array, rep: pa.Array) -> pa.Array:
        _, first, spread = layout.value
        n, r = leaf.to_numpy(), rep.to_numpy()
        return pa.array(first[n] + r % spread[n])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with one bit for each leaf: whether it is opened."""
        own = shared.value
        counts = layout.value[0]
        for batch in batches:
            plain = _matrix(batch.column("vector"))
            if not len(plain):
                continue
            points = np.concatenate([plain, np.zeros((len(plain), 1))], 1)
            masks = []
            for point in points:
                bits = np.zeros(offsets[-1], bool)
                for k, n in own.opened(point, counts, opened * total):
                    bits[offsets[k] + n] = True
                masks.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("vector"), pa.array(masks, pa.binary())],
                ["query", "vector", "opened"],
            )

    # the stated query set meets all rows, block by block
    wanted = asked.mapInArrow(
        probes, f"query long, vector array<{element}>, opened binary"
    ).select(
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"),
        F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"),
        "query", "vector", "opened",
    )
    members = placed.select(
        cell_of(F.get("leaves", F.lit(0)), F.col("rep")).cast("int").alias("cell"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "leaves", "rep", "vector",
    )
    # one more than asked for: the query itself may be among them
    found = (
        members.groupBy("cell", "block")
        .cogroup(wanted.groupBy("cell", "block"))
        .applyInPandas(_rank_cell(nearest + 1), "query long, rep long, score double")
        .groupBy("query", "rep")
        .agg(F.max("score").alias("score"))
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= nearest + 1)
    # the smallest ids of each vector are all that a list of this length can need
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    ids = (
        good.select("vec_id", "embedding").distinct()
        .withColumn("_n", F.row_number().over(copies))
        .where(F.col("_n") <= nearest + 1)
        .join(reps.select("embedding", "rep"), "embedding")
        .select("rep", "vec_id")
    )
    listed = found.join(ids, "rep")
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= nearest + 1)
    asking = (
        good.where("asks").select(F.col("vec_id").alias("query_id"), "embedding").distinct()
        .join(reps.select("embedding", F.col("rep").alias("query")), "embedding")
        .select("query_id", "query")
    )
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asking.join(listed.select("query", "vec_id", "score"), "query")
        .where("query_id != vec_id")
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )
