"""Prepared collections: corpus, topics, judgments and their written indexes.

An index is written once per session and data folder, to the shared folder,
and opened by every query after that, as indexing and retrieval are separate
steps.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from rankbench.operators import dense, lexicon_index, pruned
from rankbench.operators.lexicon_index import LexicalIndex
from rankbench.operators.pruned import ImpactIndex
from rankbench.plans import views
from rankbench.session import fresh_path, spread


class Collection:
    def __init__(self, spark: SparkSession, sf_dir: str, name: str):
        self.spark, self.sf_dir, self.name = spark, sf_dir, name

    def _view(self, what: str, *extra) -> DataFrame:
        return getattr(views, f"{self.name}_{what}")(self.spark, self.sf_dir, *extra)

    @cached_property
    def corpus(self) -> DataFrame:
        return spread(self._view("corpus"))

    @property
    def topics(self) -> DataFrame:
        return self._view("topics")

    @property
    def qrels(self) -> DataFrame:
        return self._view("qrels", *([self.index] if self.name == "bench" else []))

    def write_index(self, n_max: int = 1) -> LexicalIndex:
        return lexicon_index.write_index(
            self._view("corpus"), fresh_path(self.spark, f"{self.name}-index"), n_max
        )

    @cached_property
    def index(self) -> LexicalIndex:
        return self.write_index()

    @cached_property
    def bigram_index(self) -> LexicalIndex:
        return self.write_index(2)

    @cached_property
    def impacts(self) -> ImpactIndex:
        return pruned.write_impacts(self.index, fresh_path(self.spark, f"{self.name}-impacts"))

    @cached_property
    def vectors(self) -> DataFrame:
        return dense.write_vectors(
            dense.encode_documents(self.index),
            fresh_path(self.spark, f"{self.name}-vectors"),
        )

    @cached_property
    def topic_vectors(self) -> DataFrame:
        path = fresh_path(self.spark, f"{self.name}-topic-vectors")
        dense.encode_texts(self.topics, self.index).write.parquet(path)
        return self.spark.read.parquet(path)


_opened: dict[tuple[str, str, str], Collection] = {}


def collection(spark: SparkSession, sf_dir: str, name: str) -> Collection:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _opened:
        _opened[key] = Collection(spark, sf_dir, name)
    return _opened[key]
