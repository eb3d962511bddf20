"""BM25 and TF-IDF retrieval, and Okapi scores of given pairs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankbench.functions import text as tx
from rankbench.operators.joins import HOT_SHARE, hot_keys, lookup_join
from rankbench.operators.lexicon_index import LexicalIndex
from rankbench.operators.ranking import TOPK, rounded, top_k
from rankbench.operators.term_blocks import retrieve_in_blocks
from rankbench.session import checkpointed

# Query terms up to this many rows are broadcast; larger topic sets are joined by
# a shuffle.
BROADCAST_TERMS = 500_000
# Matches of more queries than these are scored in blocks, not as rows: the sums of
# a task have a row for each query and each document of its bucket.
JOINED_QUERIES = 1000


def _cut(n_max: int, lower: bool, pretokenised: bool) -> Column:
    if pretokenised:
        return tx.split_on_space(F.col("query"))
    return tx.terms(F.col("query"), n_max, lower)


def query_terms(
    topics: DataFrame, n_max: int = 1, lower: bool = True, pretokenised: bool = False
) -> DataFrame:
    """qid, term and how often the query has it."""
    return (
        topics.select("qid", F.explode(_cut(n_max, lower, pretokenised)).alias("term"))
        .groupBy("qid", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def query_term_rows(topics: DataFrame, n_max: int = 1, pretokenised: bool = False) -> int:
    """Upper bound of the rows of :func:`query_terms`; runs a job without shuffle."""
    found = topics.agg(F.sum(F.size(_cut(n_max, True, pretokenised)))).first()[0]
    return found or 0


def robertson_idf(n: Column, df: Column, form: str = "robertson") -> Column:
    """idf in bits; common terms go negative unless ``plus1`` or ``floor`` is asked for."""
    odds = (n - df + 0.5) / (df + 0.5)
    if form == "robertson":
        return F.log2(odds)
    if form == "plus1":
        return F.log2(odds + 1)
    if form == "floor":
        return F.greatest(F.log2(odds), F.lit(0.0))
    raise ValueError(f"unknown idf form: {form}")


def bm25_weights(k1=0.9, b=0.4, k3=8.0, idf="robertson"):
    """Query-side and document-side factors of BM25."""

    def query_side(n_docs: Column) -> Column:
        return (
            robertson_idf(n_docs, F.col("df"), idf)
            * (k3 + 1) * F.col("qtf") / (k3 + F.col("qtf"))
        )

    def document_side(avgdl: Column) -> Column:
        return F.col("tf") * (k1 + 1) / (F.col("tf") + _length_norm(k1, b, avgdl))

    return query_side, document_side


def tfidf_weights(k1=1.2, b=0.75):
    """Query-side and document-side factors of TF-IDF with a saturating tf."""

    def query_side(n_docs: Column) -> Column:
        return F.col("qtf") * F.log2(n_docs / F.col("df") + 1)

    def document_side(avgdl: Column) -> Column:
        return k1 * F.col("tf") / (F.col("tf") + _length_norm(k1, b, avgdl))

    return query_side, document_side


def _length_norm(k1: float, b: float, avgdl: Column) -> Column:
    return k1 * ((1 - b) + b * F.col("dl") / avgdl)


def retrieve(
    topics: DataFrame,
    index: LexicalIndex,
    weights=None,
    k: int = TOPK,
    broadcast_rows: int = BROADCAST_TERMS,
    pretokenised: bool = False,
    joined_queries: int = JOINED_QUERIES,
) -> DataFrame:
    """Best ``k`` documents per query: qid, docno, score, rank.

    :func:`retrieve_many` with one weighting.
    """
    found = retrieve_many(
        topics, index, {"run": weights or bm25_weights()}, k, broadcast_rows, pretokenised,
        joined_queries,
    )
    return found.drop("system")


def retrieve_many(
    topics: DataFrame,
    index: LexicalIndex,
    systems: dict,
    k: int = TOPK,
    broadcast_rows: int = BROADCAST_TERMS,
    pretokenised: bool = False,
    joined_queries: int = JOINED_QUERIES,
) -> DataFrame:
    """Best ``k`` documents per system and query: system, qid, docno, score, rank.

    ``systems`` has the weights of each by name.  Postings are matched once and
    scored under all of them.  With a bounded topic set the weighted query terms
    are broadcast: postings are read once, scores are summed inside the docno
    buckets without a shuffle, and only ``k`` rows per system, query and task
    travel.  A larger set of terms is joined by term, hot terms spread over shards.
    More than ``joined_queries`` queries are scored in blocks
    (:func:`term_blocks.retrieve_in_blocks`).  Queries that are ``pretokenised``
    are cut at white space only.  Counts queries and their terms to choose.
    """
    small = query_term_rows(topics, index.n_max, pretokenised) <= broadcast_rows
    weighed = weighed_terms(topics, index, systems, small, pretokenised)
    if topics.count() > joined_queries:
        # one number: a query within another would be in every row's weight
        mean = F.lit(index.stats.select("avgdl").first()["avgdl"])
        sides = {name: side(mean) for name, (_, side) in systems.items()}
        return retrieve_in_blocks(checkpointed(weighed), index.postings, sides, k)
    if small:
        matched = index.postings.join(F.broadcast(weighed), "term")
    else:
        matched = _match_sharded(index, weighed)
    avgdl = index.stats.select("avgdl").scalar()
    sums = [
        rounded(F.sum(F.col(f"weight_{i}") * document_side(avgdl))).alias(f"score_{i}")
        for i, (_, document_side) in enumerate(systems.values())
    ]
    scored = matched.groupBy("qid", "docno").agg(*sums)
    by = ("system", "qid") if len(systems) > 1 else ("qid",)
    return top_k(by_system(scored, systems), k, by)


def by_system(scored: DataFrame, systems: dict) -> DataFrame:
    """One row (system, qid, docno, score) for each of the columns score_0, score_1 and on."""
    each = F.array(
        *[
            F.struct(F.lit(name).alias("system"), F.col(f"score_{i}").alias("score"))
            for i, name in enumerate(systems)
        ]
    )
    return scored.select("qid", "docno", F.inline(each))


def weighed_terms(
    topics: DataFrame, index: LexicalIndex, systems: dict, small: bool, pretokenised: bool = False
) -> DataFrame:
    """qid, term and the query-side weight of each system, weight_0, weight_1 and on.

    ``small`` says that the query terms may be broadcast.
    """
    wanted = query_terms(topics, index.n_max, pretokenised=pretokenised)
    if small:
        known = index.lexicon.join(F.broadcast(wanted), "term")
    else:
        known = lookup_join(
            wanted, index.lexicon, "term", hot_keys(index.lexicon, "term", "df")
        )
    n_docs = index.stats.select("n_docs").scalar()
    return known.select(
        "qid", "term",
        *[side(n_docs).alias(f"weight_{i}") for i, (side, _) in enumerate(systems.values())],
    )


def _match_sharded(index: LexicalIndex, weighed: DataFrame) -> DataFrame:
    """Shuffle join of postings and query terms; a hot term uses many join keys.

    A term with 1/HOT_SHARE of all postings or more (so at most HOT_SHARE of
    them) is cut into as many shards as it has such shares; its query rows are
    repeated per shard.
    """
    n_postings = index.stats.select("n_postings").scalar()
    shards = F.broadcast(
        index.lexicon.where(F.col("df") * HOT_SHARE >= n_postings).select(
            "term",
            (F.floor(F.col("df") * HOT_SHARE / n_postings) + 1).cast("int").alias("shards"),
        )
    )
    count = F.coalesce(F.col("shards"), F.lit(1))
    postings = index.postings.join(shards, "term", "left").withColumn(
        "shard", F.pmod(F.xxhash64("docno"), count).cast("int")
    )
    queries = weighed.join(shards, "term", "left").withColumn(
        "shard", F.explode(F.sequence(F.lit(0), count - 1))
    )
    return postings.drop("shards").join(queries.drop("shards"), ["term", "shard"])


def okapi_idf(lexicon: DataFrame, stats: DataFrame, floor: float = 0.25) -> DataFrame:
    """Natural-log idf per term; negative ones become ``floor`` x the mean raw idf."""
    n_docs = F.broadcast(stats.select("n_docs"))  # one row
    raw = lexicon.join(n_docs).withColumn(
        "raw", F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    )
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.select(
        "term", "df", F.when(F.col("raw") < 0, floor * mean).otherwise(F.col("raw")).alias("idf")
    )


def score_okapi(
    pairs: DataFrame,
    lexicon: DataFrame,
    stats: DataFrame,
    key: str = "pair_id",
    k1: float = 1.5,
    b: float = 0.75,
    lower: bool = False,
) -> DataFrame:
    """Okapi BM25 of each (query, text) row against the given collection figures.

    Every repeat of a query term counts.  Term counts come from the pair's own
    text, so only terms the two sides share leave the row.
    """
    avgdl = stats.select("avgdl").scalar()
    sides = pairs.select(
        key,
        tx.words(F.col("query"), lower).alias("q"),
        tx.words(F.col("text"), lower).alias("d"),
    ).select(key, "q", "d", F.size("d").alias("dl"), F.array_intersect("q", "d").alias("shared"))

    def marked(side: str) -> Column:
        kept = F.filter(F.col(side), lambda t: F.array_contains("shared", t))
        return F.transform(
            kept, lambda t: F.struct(t.alias("term"), F.lit(side).alias("side"))
        )

    both = (
        sides.where(F.size("shared") > 0)
        .select(key, "dl", F.explode(F.concat(marked("q"), marked("d"))).alias("t"))
        .groupBy(key, "dl", F.col("t.term").alias("term"))
        .agg(
            F.count_if(F.col("t.side") == "q").alias("qtf"),
            F.count_if(F.col("t.side") == "d").alias("tf"),
        )
    )
    idf = okapi_idf(lexicon, stats)
    matched = lookup_join(both, idf, "term", hot_keys(lexicon, "term", "df"))
    part = (
        F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1)
        / (F.col("tf") + _length_norm(k1, b, avgdl))
    )
    summed = matched.groupBy(key).agg(F.sum(part).alias("score"))
    return pairs.join(summed, key, "left").withColumn(
        "score", rounded(F.coalesce("score", F.lit(0.0)))
    )
