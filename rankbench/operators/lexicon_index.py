"""Lexical index as tables: postings, lexicon, statistics and a document store."""

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankbench.functions import text as tx
from rankbench.functions.hashing import digest
from rankbench.session import task_count

# Tables laid out by docno: a group by (qid, docno) over them needs no shuffle.
BUCKETED = ("postings", "docstore")
# Text of a bucket.  Counting its postings takes a task some 35 times as much memory.
BYTES_PER_BUCKET = 8 * 1024 * 1024
# Documents of a bucket, which short texts reach first.  Retrieval sums up to 1,000
# queries in a row for each query and document of a bucket, 200 bytes each.
DOCS_PER_BUCKET = 4096


@dataclass(frozen=True)
class LexicalIndex:
    postings: DataFrame  # docno, dl, term, tf
    lexicon: DataFrame  # term, df, cf
    stats: DataFrame  # one row
    docstore: DataFrame  # docno, dl, text_raw, text_tok (and title)
    n_max: int = 1

    @property
    def doclen(self) -> DataFrame:
        """Tokens per document; empty documents count as 0."""
        return self.docstore.select("docno", "dl")


def index_terms(
    n_max: int = 1,
    lower: bool = True,
    title: bool = False,
    tokenizer: tx.Tokenizer = tx.word_tokens,
    text: str = "text",
    max_term: int | None = None,
) -> Column:
    """Array of the index terms of a row, the title's words first when asked for.

    ``max_term`` leaves out longer terms; by default none is.
    """
    found = tx.terms(F.col(text), n_max, lower, tokenizer)
    if title:
        found = F.concat(tx.words(F.col("title"), lower, tokenizer), found)
    return tx.indexable(found, max_term)


def tokenised(corpus: DataFrame, n_max: int = 1, **options) -> DataFrame:
    return corpus.select("docno", index_terms(n_max, **options).alias("terms"))


def count_terms(documents: DataFrame) -> DataFrame:
    """Postings: term frequency per document, with the document's length beside it.

    All tokens of a document start in one task, so the partial aggregation
    already yields the final rows.
    """
    return (
        documents.select("docno", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
        .groupBy("docno", "dl", "term")
        .agg(F.count(F.lit(1)).cast("int").alias("tf"))
    )


def document_frequencies(documents: DataFrame) -> DataFrame:
    """term, df straight from the documents: only one row per term and task travels."""
    return (
        documents.select(F.explode(F.array_distinct("terms")).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def build_lexicon(postings: DataFrame) -> DataFrame:
    """Document and collection frequency of every term."""
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")
    )


def length_stats(doclen: DataFrame) -> DataFrame:
    """One row: documents, tokens, mean length."""
    return doclen.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"),
    )


def collection_stats(doclen: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One row: documents, distinct terms, postings, tokens, mean length."""
    from_terms = lexicon.agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"),
    )
    return length_stats(doclen).select(
        "n_docs",
        from_terms.select("n_terms").scalar().alias("n_terms"),
        from_terms.select("n_postings").scalar().alias("n_postings"),
        "n_tokens",
        "avgdl",
    )


def document_store(
    corpus: DataFrame, n_max: int = 1, max_stored: int | None = None, **options
) -> DataFrame:
    """One row per document: id, length, raw text and indexed text.

    ``max_stored`` cuts the indexed text to so many characters; by default it
    is whole, as the id and the raw text always are.
    """
    kept = [c for c in ("title",) if c in corpus.columns]
    stored = tx.joined(F.col("terms"))
    if max_stored is not None:
        stored = F.left(stored, F.lit(max_stored))
    return corpus.select(
        "docno",
        *kept,
        F.col("text").alias("text_raw"),
        index_terms(n_max, **options).alias("terms"),
    ).select(
        "docno",
        F.size("terms").alias("dl"),
        *kept,
        "text_raw",
        stored.alias("text_tok"),
    )


def build_index(corpus: DataFrame, n_max: int = 1, **options) -> LexicalIndex:
    """All tables as lazy DataFrames."""
    store = document_store(corpus, n_max, **options)
    postings = count_terms(tokenised(corpus, n_max, **options))
    lexicon = build_lexicon(postings)
    stats = collection_stats(store.select("docno", "dl"), lexicon)
    return LexicalIndex(postings, lexicon, stats, store, n_max)


def bucket_count(corpus: DataFrame, n_max: int = 1) -> int:
    """Buckets for a corpus: a bucket is one task, so its text and its documents are bounded.

    A text has about ``n_max`` terms for each word.  Runs a job that counts the
    documents and reads the texts' lengths.  Above Spark's own limit,
    ``spark.sql.sources.bucketing.maxBuckets``, writing raises for the text's bytes,
    and more documents share a bucket.
    """
    most = int(corpus.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    n_docs, n_bytes = corpus.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return max(
        task_count(corpus.sparkSession),
        -(-int(n_bytes or 0) * n_max // BYTES_PER_BUCKET),
        min(most, -(-n_docs // DOCS_PER_BUCKET)),
    )


def write_index(
    corpus: DataFrame, location: str, n_max: int = 1, buckets: int | None = None, **options
) -> LexicalIndex:
    """Write the tables below ``location``, replacing what is there, and open them.

    The corpus is shuffled once, by docno, as text (smaller than its postings),
    into the document store.  The postings are counted from the store bucket by
    bucket, without another shuffle.  Runs jobs.
    """
    spark = corpus.sparkSession
    buckets = buckets or bucket_count(corpus, n_max)
    _save_bucketed(
        document_store(corpus.repartition(buckets, "docno"), n_max, **options),
        f"{location}/docstore", buckets, "docno",
    )
    store = _open_bucketed(spark, f"{location}/docstore", buckets)
    documents = store.select("docno", index_terms(n_max, text="text_raw", **options).alias("terms"))
    _save_bucketed(count_terms(documents), f"{location}/postings", buckets, "term")
    postings = spark.read.parquet(f"{location}/postings")
    build_lexicon(postings).write.mode("overwrite").parquet(f"{location}/lexicon")
    stats = collection_stats(
        store.select("docno", "dl"), spark.read.parquet(f"{location}/lexicon")
    )
    stats.withColumn("n_max", F.lit(n_max)).withColumn("buckets", F.lit(buckets)).write.mode(
        "overwrite"
    ).parquet(f"{location}/stats")
    return open_index(spark, location)


def open_index(spark: SparkSession, location: str) -> LexicalIndex:
    """Open a written index; reads the one-row statistics to learn the layout."""
    stats = spark.read.parquet(f"{location}/stats")
    layout = stats.select("n_max", "buckets").first()
    opened = {
        name: _open_bucketed(spark, f"{location}/{name}", layout["buckets"])
        for name in BUCKETED
    }
    return LexicalIndex(
        lexicon=spark.read.parquet(f"{location}/lexicon"),
        stats=stats.drop("n_max", "buckets"),
        n_max=layout["n_max"],
        **opened,
    )


def _save_bucketed(df: DataFrame, path: str, buckets: int, sort: str) -> None:
    name = f"rankbench_{uuid.uuid4().hex}"
    (
        df.write.mode("overwrite")
        .bucketBy(buckets, "docno")
        .sortBy(sort)
        .option("path", path)
        .saveAsTable(name)
    )
    df.sparkSession.sql(f"DROP TABLE {name}")  # external: the files stay


def _open_bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A written table with its layout.  The catalog entry goes as soon as it is read."""
    name = f"rankbench_{uuid.uuid4().hex}"
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema
    )
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet "
        f"CLUSTERED BY (docno) INTO {buckets} BUCKETS LOCATION :path",
        args={"path": path},
    )
    opened = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # external: the files stay, and the plan knows them
    return opened


def sample_terms(lexicon: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """Repeatable random sample of ``n`` terms."""
    return lexicon.orderBy(digest(seed, F.col("term"))).limit(n)
