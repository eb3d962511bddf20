"""Declared schemas of the tables the package reads and writes."""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)


def _strings(*names: str) -> StructType:
    return StructType([StructField(name, StringType()) for name in names])


RAW_CORPUS = _strings("_id", "title", "text", "title_english", "text_english")
RAW_QUERIES = _strings("_id", "text", "text_english")
RAW_TRIPLETS = _strings(
    "query", "positive", "negative",
    "query_english", "positive_english", "negative_english",
)
RAW_QRELS = StructType(
    [
        StructField("query-id", StringType()),
        StructField("corpus-id", StringType()),
        StructField("score", IntegerType()),
    ]
)

CORPUS = _strings("docno", "title", "text")
TOPICS = _strings("qid", "query")
TRIPLES = _strings("query", "positive", "negative")
QRELS = StructType(
    [
        StructField("qid", StringType()),
        StructField("iter", StringType()),
        StructField("docno", StringType()),
        StructField("label", IntegerType()),
    ]
)
RUN = StructType(
    [
        StructField("system", StringType()),
        StructField("qid", StringType()),
        StructField("docno", StringType()),
        StructField("rank", IntegerType()),
        StructField("score", DoubleType()),
    ]
)
METRICS = StructType(
    [
        StructField("system", StringType()),
        StructField("metric", StringType()),
        StructField("value", DoubleType()),
    ]
)
