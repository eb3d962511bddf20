"""Raw tables to corpus, topics, judgments, triples and training pairs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankbench.functions import text as tx
from rankbench.functions.hashing import digest, share
from rankbench.operators.numbering import number_by_digest


def prepare_corpus(raw: DataFrame) -> DataFrame:
    """A null in any raw column drops the row, also in columns not kept."""
    return raw.na.drop("any").select(F.col("_id").alias("docno"), "title", "text")


def prepare_topics(raw: DataFrame) -> DataFrame:
    return raw.na.drop("any").select(
        F.col("_id").alias("qid"), F.col("text").alias("query")
    )


def prepare_qrels(raw: DataFrame) -> DataFrame:
    return (
        raw.na.drop("any")
        .withColumn("iter", F.lit("Q0"))
        .select(
            F.col("`query-id`").alias("qid"),
            "iter",
            F.col("`corpus-id`").alias("docno"),
            F.col("score").alias("label"),
        )
    )


def prepare_triples(raw: DataFrame) -> DataFrame:
    return raw.na.drop("any").select("query", "positive", "negative")


def table_sizes(**tables: DataFrame) -> DataFrame:
    """Row count of each named table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        for name, df in tables.items()
    ]
    out = counts[0]
    for count in counts[1:]:
        out = out.unionByName(count)
    return out


def pretokenised(
    df: DataFrame, key: str, column: str, n_max: int = 2, title: str | None = None
) -> DataFrame:
    """Text replaced by its space-joined terms; null reads as empty."""
    text = F.coalesce(F.col(column), F.lit(""))
    if title:
        text = tx.titled(F.col(title), F.col(column), "space")
    return df.select(key, tx.joined(tx.terms(text, n_max)).alias(column))


def labelled_pairs(triples: DataFrame) -> DataFrame:
    """Each triple as a positive and a negative pair, in one scan."""
    both = F.array(
        F.struct(F.col("positive").alias("sentence2"), F.lit(1).alias("label")),
        F.struct(F.col("negative").alias("sentence2"), F.lit(0).alias("label")),
    )
    return triples.select(
        "triple_id", F.col("query").alias("sentence1"), F.explode(both).alias("pair")
    ).select("triple_id", "sentence1", "pair.sentence2", "pair.label")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in a repeatable random order."""
    return df.orderBy(digest(seed, F.col(key)), key)


def split_by_share(
    df: DataFrame, key: str, fraction: float, seed: int = 42
) -> DataFrame:
    """``part`` column: eval with probability ``fraction``, without any shuffle."""
    return df.withColumn("part", _part(share(seed, F.col(key)) < 1 - fraction))


def split_exact(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """``part`` column with exactly int(n * fraction) eval rows, the last in hash order.

    Only the keys are numbered, to find the digest of the last training row; the
    table itself is then split by comparing each row with that one value.
    """
    mine = digest(seed, F.col(key))
    total = df.agg(F.count(F.lit(1))).scalar()
    wanted = total - F.floor(total * fraction)
    last = (
        number_by_digest(df.select(key), mine, "position")
        .where(F.col("position") == wanted)
        .select(mine)
        .scalar()
    )
    return df.withColumn("part", _part(F.coalesce(mine <= last, F.lit(False))))


def _part(in_train: Column) -> Column:
    return F.when(in_train, F.lit("train")).otherwise(F.lit("eval"))
