"""Exact top-k of every query over every document with a block scorer.

Queries are dealt into blocks and documents into cells, packed into few rows of
bytes, and each pair of a block and a cell meets by key in one task.  Both are as
large as memory lets them be, as a block is moved once for each cell and a cell
once for each block.  A task scores a batch of queries and a tile of documents at
a time, leaves out what can't be among the best any more, and only its best rows
per query leave it, so the pairs are never rows of a table.  Documents are scanned
once to be packed, whatever the number of queries, and neither side passes the
driver.
"""

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankbench.operators.ranking import PLACES, TOPK, top_k
from rankbench.session import task_count

# documents -> matrix of scores, one row per query of the block it was made for.
# One that can tell which pairs reach a bar has more: see BarScorer.
DocScorer = Callable[[pd.DataFrame], np.ndarray]
# queries of a block -> scorer; called once for each batch of them and task.  It gets
# QUERY_BLOCK queries, or as many as its ``most_queries`` says
BlockScorer = Callable[[pd.DataFrame], DocScorer]
# called once per task and not for each block, so it is the place to load a model
ScorerFactory = Callable[[], BlockScorer]

# Queries that a task scores at once, and how many such batches a block has at most.
BATCH_QUERIES = 4096
MOST_BATCHES = 16
CELL_DOCS = 1 << 16
# Of a block and a cell before they are packed.
BATCH_BYTES = 64 * 1024 * 1024
CELL_BYTES = 128 * 1024 * 1024
# Documents that are packed into one row; the first of a cell, which are scored
# before any bar is known, are fewer.
PACKED_DOCS = 4096
FIRST_DOCS = 512
QUERY_BLOCK = 256
DOC_BLOCK = 1024
TASKS_PER_CORE = 8
# Pairs of a block and a cell for each core, if the queries suffice.
PAIRS_PER_CORE = 4
# Scores are compared after rounding, so a pair must be this far below a bar to go.
SLACK = 2 * 10.0**-PLACES

RESULT = "qid string, docno string, score double"
PACKED = "_part int, _piece int, _packed binary"


class BarScorer:
    """A scorer that need not score every pair once the k-th best scores are known.

    ``__call__`` gives the whole matrix.  ``prunes`` says for which of the bars, one
    a query, ``reaching`` can be asked, which gives row, column and score of all
    pairs that reach them, and may give others; a bar of infinity is reached by none.
    Pairs that are not a number are no results if ``only_numbers``.
    """

    only_numbers = False

    def __call__(self, docs) -> np.ndarray:
        raise NotImplementedError

    def prunes(self, bars: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def reaching(self, docs, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raise NotImplementedError


def exhaustive_top_k(
    queries: DataFrame,
    docs: DataFrame,
    scorer: ScorerFactory,
    k: int = TOPK,
    batch_queries: int = BATCH_QUERIES,
    batch_bytes: int = BATCH_BYTES,
    cell_docs: int = CELL_DOCS,
    rank_base: int = 1,
    tasks_per_core: int = TASKS_PER_CORE,
    prepare: Callable[[pd.DataFrame], object] | None = None,
) -> DataFrame:
    """qid, docno, score, rank.

    A score that is not a number ranks below all others and comes back as null.
    A task scores up to ``batch_queries`` queries at once; a block has that many, or
    ``MOST_BATCHES`` times as many where there are enough blocks for all cores, and
    ``batch_bytes`` on average.  A cell has ``cell_docs`` documents and ``CELL_BYTES``
    at most on average.  Pairs go to ``tasks_per_core`` tasks for each core, or
    ``spark.sql.shuffle.partitions`` if those are more; few suit a scorer that is
    slow to load.  ``prepare`` makes of a frame of documents what the scorer is
    given; it has their ``docno``.  Measures both sides.
    """
    spark = docs.sparkSession
    n_queries, n_bytes = _size(queries)
    n_docs, doc_bytes = _size(docs)
    n_cells = max(1, -(-n_docs // cell_docs), -(-doc_bytes // CELL_BYTES))
    enough = PAIRS_PER_CORE * task_count(spark)
    n_blocks = max(
        1,
        -(-n_queries // (MOST_BATCHES * batch_queries)),
        -(-n_bytes // batch_bytes),
        min(-(-enough // n_cells), -(-n_queries // batch_queries)),
    )
    n_cells = max(n_cells, enough // n_blocks)  # where queries are few
    n_tasks = pair_tasks(spark, n_blocks * n_cells, tasks_per_core)
    asked = _packed(queries, n_blocks, batch_queries).withColumnRenamed("_part", "_block")
    placed = _packed(docs, n_cells, PACKED_DOCS, prepare).withColumnRenamed("_part", "_cell")
    found = (
        _by_pair(asked.withColumn("_cell", _each(n_cells)), n_cells, n_tasks)
        .cogroup(_by_pair(placed.withColumn("_block", _each(n_blocks)), n_cells, n_tasks))
        .applyInPandas(_cell_scores(scorer, k), RESULT)
    )
    return top_k(found, k, rank_base=rank_base)


def _size(df: DataFrame) -> tuple[int, int]:
    sized = df.select(_row_bytes(df).alias("bytes"))
    n, n_bytes = sized.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    return n, int(n_bytes or 0)


def pair_tasks(spark: SparkSession, n_pairs: int, per_core: int = TASKS_PER_CORE) -> int:
    """Tasks for so many pairs of a block and a cell: one each, up to some for every core."""
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(n_pairs, max(shuffles, per_core * spark.sparkContext.defaultParallelism))


def _by_pair(rows: DataFrame, n_cells: int, n_tasks: int):
    """Groups of a block and a cell, the same number of them in every task.

    The time of a pair follows from its rows times its columns, not its bytes, so
    pairs are neither hashed nor put together by their size.
    """
    pair = F.col("_block").cast("long") * n_cells + F.col("_cell")
    task = F.pmod(pair, F.lit(n_tasks)).cast("int")
    dealt = rows.withColumn("_task", task).repartitionById(n_tasks, F.col("_task"))
    return dealt.groupBy("_task", "_block", "_cell")


def _each(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _packed(
    rows: DataFrame, n: int, most: int, prepare: Callable[[pd.DataFrame], object] | None = None
) -> DataFrame:
    """The rows in ``n`` parts, ``most`` of them in a row of bytes.

    Rows are dealt to the parts in turn, so that no value of theirs fills one.
    """
    part = F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    dealt = rows.withColumn("_part", part).repartitionById(n, F.col("_part"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = min(most, FIRST_DOCS) if prepare else most
        for piece, held in enumerate(_tables(batches, few, most)):
            frame = held.drop(["_part"]).to_pandas()
            packed = pack(prepare(frame) if prepare else frame)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([held["_part"][0].as_py()], pa.int32()),
                    pa.array([piece], pa.int32()),
                    pa.array([packed], pa.binary()),
                ],
                ["_part", "_piece", "_packed"],
            )

    return dealt.mapInArrow(packed, PACKED)


def _tables(batches: Iterator[pa.RecordBatch], few: int, most: int) -> Iterator[pa.Table]:
    """The same rows in order, ``few`` in the first table, twice as many in the next, up to ``most``."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, few - n))
            batch = batch.slice(few - n)
            n += held[-1].num_rows
            if n == few:
                yield pa.Table.from_batches(held)
                held, n, few = [], 0, min(2 * few, most)
    if n:
        yield pa.Table.from_batches(held)


def pack(what: object) -> bytes:
    plain = pickle.dumps(what, protocol=5)
    return len(plain).to_bytes(8, "big") + pa.compress(plain, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> object:
    size = int.from_bytes(packed[:8], "big")
    return pickle.loads(pa.decompress(packed[8:], size, codec="zstd", asbytes=True))


def _cell_scores(scorer: ScorerFactory, k: int):
    loaded: list[BlockScorer] = []  # of this task

    def once() -> BlockScorer:
        if not loaded:
            loaded.append(scorer())
        return loaded[0]

    def run(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            queries = queries[:0]
        found = [
            best_per_query(unpack(batch), map(unpack, docs["_packed"]), once, k)
            for batch in queries["_packed"]
        ]
        return pd.concat(found or [_as_result([], [], [])], ignore_index=True)

    return run


def _row_bytes(df: DataFrame):
    """Estimate of a row's size."""
    total = F.lit(64)
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind == "array<string>":
            total = total + F.aggregate(
                F.col(field.name), F.lit(0), lambda n, t: n + F.octet_length(t) + 4
            )
        elif kind.startswith("array"):
            total = total + 8 * F.size(field.name)
        elif kind == "string":
            total = total + F.octet_length(F.coalesce(F.col(field.name), F.lit("")))
        else:
            total = total + 8
    return total


def best_per_query(
    queries: pd.DataFrame, pieces: Iterable, scorer: ScorerFactory, k: int
) -> pd.DataFrame:
    """Best ``k`` per query over a stream of documents, frames or prepared: one frame of results."""
    queries = queries.reset_index(drop=True)
    kept = _Best(k, len(queries))
    scorers = None
    for piece in pieces:
        if not len(queries):
            continue
        if scorers is None:
            make = scorer()
            most = getattr(make, "most_queries", QUERY_BLOCK)
            scorers = [
                _Scored(make, queries.iloc[first : first + most], first, kept)
                for first in range(0, len(queries), most)
            ]
        for docs, docnos in _tiles(piece):
            for score in scorers:
                score.add(docs, docnos)
    row, docno, value = kept.result()
    return _as_result(queries["qid"].to_numpy(dtype=object)[row], docno, value)


def _as_result(qid, docno, score) -> pd.DataFrame:
    score = pd.Series(score, dtype="float64")
    return pd.DataFrame(
        {
            "qid": pd.Series(qid, dtype=object),
            "docno": pd.Series(docno, dtype=object),
            "score": score.where(score > -np.inf),
        }
    )


def _tiles(piece) -> Iterator[tuple[object, np.ndarray]]:
    """Documents that are scored at once, and their ids."""
    if not isinstance(piece, pd.DataFrame):
        yield piece, piece.docno
        return
    for start in range(0, len(piece), DOC_BLOCK):
        docs = piece.iloc[start : start + DOC_BLOCK]
        yield docs, docs["docno"].to_numpy(dtype=object)


class _Scored:
    """The queries of one scorer, and which of them still need every score."""

    def __init__(self, make: BlockScorer, queries: pd.DataFrame, first: int, kept: "_Best"):
        self.make, self.queries, self.kept = make, queries, kept
        self.rows = np.arange(first, first + len(queries))
        self.whole = make(queries)
        self.few, self.score_few = None, None

    def add(self, docs, docnos: np.ndarray) -> None:
        bars = self.kept.bars[self.rows]
        if not isinstance(self.whole, BarScorer):
            return self.kept.add(self.rows, self.whole(docs), docnos)
        prunes = self.whole.prunes(bars)
        if prunes.any():
            row, column, value = self.whole.reaching(docs, np.where(prunes, bars - SLACK, np.inf))
            self.kept.hold(self.rows[row], docnos[column], rounded(value))
        rest = np.flatnonzero(~prunes)
        if len(rest):
            numbers = self.whole.only_numbers
            self.kept.add(self.rows[rest], self._scorer_of(rest)(docs), docnos, numbers)

    def _scorer_of(self, rest: np.ndarray) -> DocScorer:
        if len(rest) == len(self.rows):
            return self.whole
        if self.few is None or not np.array_equal(self.few, rest):
            self.few, self.score_few = rest, self.make(self.queries.iloc[rest])
        return self.score_few


def rounded(values: np.ndarray) -> np.ndarray:
    return np.floor(values * 10**PLACES + 0.5) / 10**PLACES


class _Best:
    """Candidates of all queries; those that can't be among the best go now and then.

    ``bars`` has a score for each query that so many documents reach.
    """

    def __init__(self, k: int, n_queries: int):
        self.k, self.n_queries = k, n_queries
        self.bars = np.full(n_queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.room = 0, 2 * k * max(1, n_queries)

    def add(
        self, rows: np.ndarray, matrix: np.ndarray, docnos: np.ndarray, only_numbers: bool = False
    ) -> None:
        """Scores of these queries and all documents of a tile."""
        matrix = np.asarray(matrix, float)
        bars = self.bars[rows]
        if matrix.shape[1] > self.k and not (bars > -np.inf).all():
            matrix = np.where(np.isnan(matrix), -np.inf, matrix)
            place = matrix.shape[1] - self.k
            bars = np.maximum(bars, rounded(np.partition(matrix, place, axis=1)[:, place]))
            self.bars[rows] = bars
        with np.errstate(invalid="ignore"):
            near = matrix >= (bars - SLACK)[:, None]
        if not only_numbers:  # ranked below all others, but ranked
            near |= np.isnan(matrix) & (bars == -np.inf)[:, None]
        row, column = np.nonzero(near)
        value = matrix[row, column]
        if only_numbers:
            real = value > -np.inf
            row, column, value = row[real], column[real], value[real]
        value = rounded(np.where(np.isnan(value), -np.inf, value))
        self.hold(rows[row], docnos[column], value)

    def hold(self, row: np.ndarray, docno: np.ndarray, value: np.ndarray) -> None:
        """Rounded scores of some pairs."""
        near = value >= self.bars[row]  # ties with the k-th stay until docnos decide
        self.parts.append((row[near], docno[near], value[near]))
        self.held += int(near.sum())
        if self.held > self.room:
            self._cut()
            if self.held > self.room:
                self.parts = [self.result()]
                self.held = len(self.parts[0][0])
            self.room = self.held + self.k * self.n_queries

    def _cut(self) -> None:
        """What is below the k-th best score of its query goes."""
        row, docno, value = (np.concatenate(part) for part in zip(*self.parts))
        order = np.lexsort((-value, row))
        counts = np.bincount(row, minlength=self.n_queries)
        full = np.flatnonzero(counts >= self.k)
        starts = np.cumsum(counts) - counts
        kth = value[order[starts[full] + self.k - 1]]
        self.bars[full] = np.maximum(self.bars[full], kth)
        near = value >= self.bars[row]
        self.parts = [(row[near], docno[near], value[near])]
        self.held = int(near.sum())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, docno and score of the best ``k`` of each query, in their order."""
        if not self.parts:
            return np.empty(0, int), np.empty(0, object), np.empty(0)
        self._cut()
        row, docno, value = self.parts[0]
        every = pd.DataFrame({"query": row, "docno": docno, "score": value}).sort_values(
            ["query", "score", "docno"], ascending=[True, False, True], na_position="first"
        )
        best = every.groupby("query", sort=False).head(self.k)
        return (
            best["query"].to_numpy(),
            best["docno"].to_numpy(dtype=object),
            best["score"].to_numpy(),
        )
