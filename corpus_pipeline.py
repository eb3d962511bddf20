"""Corpus pipeline: filter, deduplicate, scrub, mix and pack the documents table.

Every stage works on all rows its predecessor kept.  Stages return the columns
of documents, the last one the packed pieces.  Null and empty texts, repeated
rows and extra columns are handled as the operators of each stage say.
"""

from pyspark.sql import functions as F

from rankbench.llm import mixing, packing, secrets, simhash, toxicity
from rankbench.llm.queries import toxicity_model, word_bpe_path
from rankbench.llm.rows import row_fields, whole_row
from rankbench.session import fresh_path

# Documents at or above this probability of being toxic are rejected.
TOXIC_SCORE = 0.3


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity model rejects go; all others stay as they are."""
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select(
        whole_row(docs).alias("row"), toxicity.score(F.col("text"), model).alias("score")
    )
    return scored.where(F.col("score") < TOXIC_SCORE).select(*row_fields(docs))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate component stays, that of the smallest id."""
    return simhash.deduplicated(docs)


def mask_secrets(spark, docs, sf_dir):
    """Every secret in a text is replaced by a mark; no document is dropped."""
    return secrets.masked(docs, secrets.train(secrets.labelled_samples(docs)))


def mix_sources(spark, docs, sf_dir):
    """Each document as often as the mix takes its words, none to three times.

    Where the mix takes part of a document, the number is rounded, up in that
    share of the cases by a hash of the id, so sources keep their weights.
    Documents that share an id share their words taken; one without words stays
    once.
    """
    mixed = mixing.mix(docs).groupBy("doc_id").agg(
        F.sum("taken").alias("taken"), F.sum("size").alias("size")
    )
    share = F.col("taken") / F.nullif(F.col("size"), F.lit(0))
    draw = F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor(share) + (draw < share - F.floor(share)).cast("long")
    numbered = mixed.select(
        F.col("doc_id").alias("id"), F.coalesce(copies, F.lit(1)).cast("int").alias("copies")
    )
    rows = docs.select("doc_id", whole_row(docs).alias("row"))
    return (
        rows.join(numbered, F.col("doc_id").eqNullSafe(F.col("id")))
        .where("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(*row_fields(docs))
    )


def pack_sequences(spark, docs, sf_dir):
    """Pieces of all documents with their sequence and place."""
    return packing.pack(docs, word_bpe_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources),
    ("pattern_packing", pack_sequences),
]

# Hashes of 64 bits, learned models and the tokenizer have no SQL; the stages are
# tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents table; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
