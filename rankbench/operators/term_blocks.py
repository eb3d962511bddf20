"""Lexical scores of many queries without a row for each match.

A common word is in a good part of the queries and of the documents, so the
matches of a large topic set grow with the product of both.  Here they are never
rows: queries and documents become arrays of their terms and weights, are packed
and meet in blocks and cells, and a task fills one small matrix of scores at a
time.  Terms that many queries and documents of a tile have are multiplied as
matrices, the others posting by posting.  Once the k-th best scores are known the
matrix is one of 32-bit sums, and only the pairs that may reach them by its error
bound are scored in full.
"""

from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankbench.operators.exhaustive import BarScorer, exhaustive_top_k
from rankbench.operators.joins import SHORT_ROWS
from rankbench.operators.ranking import TOPK

# A term of so many documents, and of so large a share of them, may be common, up to
# a number of terms; it is in a tile where it makes such a share of all pairs matches.
COMMON_DOCS = 16
COMMON_PART = 1 / 64
COMMON_SHARE = 1 / 300
MOST_COMMON = 1024
# Matches of rarer terms that are laid out at once.
MATCHES = 4_000_000
# Queries of a tile.
TILE_QUERIES = 128
# Relative error of a 32-bit sum of n products is below (n + 4) times this.
ROUNDING = 2.0**-22


def retrieve_in_blocks(
    weighed: DataFrame, postings: DataFrame, document_sides: dict[str, Column], k: int = TOPK
) -> DataFrame:
    """Best ``k`` documents per system and query: qid, docno, system, score, rank.

    ``weighed`` has qid, term and weight_0, weight_1 and on, materialised;
    ``document_sides`` the weight of a posting under each system, in that order.
    A document that shares no term with a query is not among its results.  Counts
    both sides.
    """
    wanted = weighed.select("term").distinct()
    if wanted.count() <= SHORT_ROWS:
        postings = postings.join(F.broadcast(wanted), "term", "left_semi")
    found = None
    for i, (system, side) in enumerate(document_sides.items()):
        run = exhaustive_top_k(
            _gathered(weighed, "qid", F.col(f"weight_{i}")),
            _gathered(postings, "docno", side),
            matrix_scorer,
            k,
            prepare=by_term,
        )
        run = run.where(F.col("score").isNotNull()).select(
            "qid", "docno", F.lit(system).alias("system"), "score", "rank"
        )
        found = run if found is None else found.unionByName(run)
    return found


def _gathered(rows: DataFrame, key: str, weight: Column) -> DataFrame:
    """One row per key: its terms and their weights."""
    entry = F.struct("term", weight.cast("double").alias("weight"))
    return rows.groupBy(key).agg(F.collect_list(entry).alias("entries")).select(
        key, F.col("entries.term").alias("terms"), F.col("entries.weight").alias("weights")
    )


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Row number and entry of every entry of the rows' lists, one after another."""
    sizes = lists.map(len).to_numpy(dtype="int64")
    return np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.empty(0), *lists])


@dataclass
class ByTerm:
    """Documents with their terms turned round: the documents of each term and their weights."""

    docno: np.ndarray
    terms: list[str]
    starts: np.ndarray  # of each term's postings, and where the last ends
    doc: np.ndarray
    value: np.ndarray | None  # of each posting; all are 1 where there is none
    figures: dict[str, np.ndarray] = field(default_factory=dict)  # of each document

    def __len__(self) -> int:
        return len(self.docno)


def by_term(docs: pd.DataFrame, terms: str = "terms", weights: str | None = "weights") -> ByTerm:
    """A frame of documents, turned round; a term's weights in one document are summed."""
    doc, found = _flat(docs[terms])
    term, names = pd.factorize(found.astype(object))
    order = np.argsort(term, kind="stable")
    term, doc = term[order], doc[order]
    new = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(doc, prepend=-1))
    value = None
    if weights is not None:
        value = _flat(docs[weights])[1].astype("float64")[order]
        value = np.add.reduceat(value, new) if len(new) else value
    term, doc = term[new], doc[new]
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))])
    docno = docs["docno"] if "docno" in docs else pd.Series(range(len(docs)))
    return ByTerm(
        docno.to_numpy(dtype=object), names.tolist(), starts.astype("int64"),
        doc.astype("int32"), value,
    )


class _Met:
    """Documents as a block of queries sees them: its terms' places there, the common ones' rows."""

    def __init__(self, docs: ByTerm, numbers: dict[str, int]):
        self.docs = docs
        met = np.fromiter(map(numbers.get, docs.terms, repeat(-1)), "int64", len(docs.terms))
        at = np.full(len(numbers), -1)
        at[met[met >= 0]] = np.flatnonzero(met >= 0)
        self.begin = docs.starts[at]
        self.n_with = np.where(at >= 0, docs.starts[at + 1] - self.begin, 0)
        often = np.flatnonzero(self.n_with >= max(COMMON_DOCS, COMMON_PART * len(docs)))
        if len(often) > MOST_COMMON:
            often = often[np.argsort(-self.n_with[often], kind="stable")[:MOST_COMMON]]
        self.row = np.full(len(numbers), -1)
        self.row[often] = np.arange(len(often))
        row, posting = _spans(self.begin[often], self.n_with[often])
        self.values = np.zeros((len(often), len(docs)))
        self.values[row, docs.doc[posting]] = 1 if docs.value is None else docs.value[posting]
        self.short = self.values.astype("float32")
        self.largest = 1.0 if docs.value is None else np.abs(docs.value).max(initial=0.0)


class _Tile:
    """Some queries of a block, and by term who asks for it and with which weight."""

    def __init__(self, first: int, size: int, term: np.ndarray, asking: np.ndarray, weight):
        self.first, self.size = first, size
        # in the order of the queries
        self.terms, self.local, self.counts = np.unique(
            term, return_inverse=True, return_counts=True
        )
        self.weights = weight
        counts = np.bincount(asking, minlength=size)
        self.starts, self.n_terms = np.cumsum(counts) - counts, counts
        # in the order of the terms
        order = np.argsort(self.local, kind="stable")
        self.place, self.asking, self.weight = self.local[order], asking[order], weight[order]

    def column(self, met: _Met) -> np.ndarray:
        """Number of each of the tile's terms among those that are common in it, or -1."""
        matches = met.n_with[self.terms] * self.counts
        least = COMMON_SHARE * self.size * len(met.docs)
        common = np.flatnonzero((met.row[self.terms] >= 0) & (matches >= least))
        column = np.full(len(self.terms), -1)
        column[common] = np.arange(len(common))
        return column

    def common(self, met: _Met, column: np.ndarray, kind: str, shared: bool) -> np.ndarray:
        """Sums of products over common terms, or their numbers if ``shared``."""
        asked = column[self.place]
        kept = asked >= 0
        n = int(column.max(initial=-1)) + 1
        left = np.zeros(self.size * n, kind)
        weight = np.ones(1, kind) if shared else self.weight[kept].astype(kind)
        np.add.at(left, self.asking[kept] * n + asked[kept], weight)  # a term may come twice
        rows = met.row[self.terms[column >= 0]]
        right = (met.short if kind == "float32" else met.values)[rows]
        if shared and met.docs.value is not None:
            right = (right != 0).astype(kind)
        return left.reshape(self.size, n) @ right

    def add_rare(self, total: np.ndarray, met: _Met, column: np.ndarray, shared: bool) -> None:
        """Adds the other terms' products, or their numbers, to a flat matrix of sums."""
        docs = met.docs
        times = met.n_with[self.terms][self.place]
        rare = np.flatnonzero((column[self.place] < 0) & (times > 0))
        times = times[rare]
        begin = met.begin[self.terms][self.place[rare]]
        offset = self.asking[rare] * len(docs)
        weight = None if shared else self.weight[rare].astype(total.dtype)
        ends = np.cumsum(times)
        first = 0
        while first < len(rare):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + MATCHES, "right")))
            part = slice(first, last)
            entry, posting = _spans(begin[part], times[part])
            pair = offset[part][entry] + docs.doc[posting]
            if shared:
                product = np.ones(1, total.dtype)
            else:
                # add.at is slow unless both are of the very same type
                product = np.empty(len(pair), total.dtype)
                value = 1 if docs.value is None else docs.value[posting]
                np.multiply(weight[part][entry], value, out=product, casting="same_kind")
            np.add.at(total, pair, product)
            first = last

    def sums(self, met: _Met, kind: str, shared: bool = False) -> np.ndarray:
        """Sums of products over shared terms, or their numbers if ``shared``."""
        column = self.column(met)
        total = self.common(met, column, kind, shared).reshape(-1)
        self.add_rare(total, met, column, shared)
        return total.reshape(self.size, len(met.docs))

    def reaching(self, met: _Met, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and sum of the pairs whose sum, common terms in 32 bits, is at the bar."""
        n_docs, column = len(met.docs), self.column(met)
        rare = np.zeros(self.size * n_docs)
        self.add_rare(rare, met, column, False)
        total = self.common(met, column, "float32", False)
        pair = np.flatnonzero((total + rare.reshape(total.shape) >= bars[:, None]).reshape(-1))
        row, doc = pair // n_docs, pair % n_docs
        value = rare[pair]
        # a few million entries at a time
        step = max(1, MATCHES // max(1, int(self.n_terms.max(initial=1))))
        for first in range(0, len(pair), step):
            some = slice(first, first + step)
            asked, entry = _spans(self.starts[row[some]], self.n_terms[row[some]])
            common = column[self.local[entry]] >= 0
            asked, entry = asked[common], entry[common]
            at = met.values[met.row[self.terms[self.local[entry]]], doc[some][asked]]
            value[some] += np.bincount(asked, self.weights[entry] * at, len(value[some]))
        return row + self.first, doc, value


def _spans(begin: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the span, and place, of every place in spans of so many places."""
    span = np.repeat(np.arange(len(times)), times)
    return span, np.arange(len(span)) + (begin - (np.cumsum(times) - times))[span]


class TermScorer(BarScorer):
    """Sums of products over shared terms, not a number where none is shared."""

    most_queries = 1 << 30  # it cuts tiles itself
    only_numbers = True

    def __init__(self, queries: pd.DataFrame, terms: str = "terms", weights: str | None = "weights"):
        asking, found = _flat(queries[terms])
        term, names = pd.factorize(found.astype(object))
        self.numbers = {name: i for i, name in enumerate(names)}
        weight = np.ones(len(term)) if weights is None else _flat(queries[weights])[1].astype("float64")
        self.n_queries = len(queries)
        self.n_terms = np.bincount(asking, minlength=len(queries))
        self.weighs = np.bincount(asking, np.abs(weight), minlength=len(queries))
        self.last, self.largest = None, 1.0
        starts = np.concatenate([[0], np.cumsum(self.n_terms)])
        self.tiles = []
        for first in range(0, len(queries), TILE_QUERIES):
            last = min(first + TILE_QUERIES, len(queries))
            part = slice(starts[first], starts[last])
            self.tiles.append(
                _Tile(first, last - first, term[part], asking[part] - first, weight[part])
            )

    def turned(self, docs: pd.DataFrame) -> ByTerm:
        return by_term(docs)

    def meet(self, docs) -> _Met:
        if self.last is None or self.last[0] is not docs:
            given = self.turned(docs) if isinstance(docs, pd.DataFrame) else docs
            self.last = docs, _Met(given, self.numbers)
        return self.last[1]

    def __call__(self, docs) -> np.ndarray:
        met = self.meet(docs)
        self.largest = max(self.largest, met.largest)
        out = np.empty((self.n_queries, len(docs)))
        for tile in self.tiles:
            total = tile.sums(met, "float64")
            shared = tile.sums(met, "float32", shared=True) > 0
            out[tile.first : tile.first + tile.size] = np.where(shared, total, np.nan)
        return out

    def _error(self, largest: float) -> np.ndarray:
        """Bound of the error of each query's 32-bit sums."""
        return (self.n_terms + 4) * ROUNDING * self.weighs * largest

    def prunes(self, bars: np.ndarray) -> np.ndarray:
        # a pair that shares nothing has a sum of 0, which must stay below the bar
        return bars > 1e-3 + 2 * self._error(self.largest)

    def reaching(self, docs, bars: np.ndarray):
        met = self.meet(docs)
        self.largest = max(self.largest, met.largest)
        bars = bars - self._error(met.largest)
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for tile in self.tiles:
            asked = bars[tile.first : tile.first + tile.size]
            if not np.isposinf(asked).all():
                found.append(tile.reaching(met, asked))
        return tuple(np.concatenate(part) for part in zip(*found))


def matrix_scorer():
    """Block scorer: sums of products over shared terms, not a number where none is shared."""
    return TermScorer
