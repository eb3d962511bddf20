"""Mix sources to target weights by Sainte-Laguë apportionment.

Each source's documents are dealt into shards and laid out there in a seeded
order, which makes a line of words.  The line is cut into blocks of equal size.
The number of blocks that the mix takes is apportioned to the sources by the
highest quotients ``target / (2k + 1)``, and each source's blocks to its shards
likewise, which gives every shard an integer quota.  A quota above the shard's
own length is filled by whole passes over the shard, the rest by blocks in
seeded order.  A document's ``taken`` words are those of its words that lie in
taken blocks, repeats counted.

Everything is DataFrame functions.  Texts are read once, for their sizes; what
moves is (doc_id, source, size).  A source of any share is dealt over as many
shards as its rows need, so no task holds a source.

Defined results: a null text has size 0; null is a source of its own, the last;
empty texts take 0 words; repeated rows are taken each for itself; an empty
table gives an empty result.  Other columns play no part.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankbench.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
BLOCK_WORDS = 128
ROWS_PER_SHARD = 2_000
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, passes: int = MOST_PASSES) -> DataFrame:
    """Adds ``rank`` (from 0) and ``target`` to rows (source, source_size).

    Weights repeat over the sources in code-point order, null last.  Targets
    share the total by weight; a target above ``passes`` times its source stops
    there and the excess is shared by weight among the others until none is
    above.  That is a water level: with sources ordered by limit per weight, it
    is the first level that the next limit does not cut.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.get(cycle, F.pmod(F.col("rank"), F.lit(len(weights))))
    )
    limited = ranked.withColumn("limit", F.col("source_size").cast("double") * passes)
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    total = F.sum("source_size").over(all_rows).cast("double")
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    leveled = limited.withColumn("level", level)
    reached = F.max(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level")))
    final = leveled.withColumn("final", reached.over(all_rows))
    return final.select(
        "source",
        "rank",
        "source_size",
        *[c for c in sources.columns if c not in ("source", "source_size")],
        F.coalesce(F.least("limit", F.col("weight") * F.col("final")), F.col("limit")).alias("target"),
    )


def apportion(votes: DataFrame, group: list[str], vote: str, seats: str, key: str) -> DataFrame:
    """Adds ``quota``: Sainte-Laguë seats of each row within its group.

    With divisor D a row has about vote / D seats, and the seats of p rows
    differ from the sum of vote / D by at most p / 2.  So all quotients between
    the divisors for n + p/2 + 1 and n - p/2 - 1 seats hold the last seat; only
    those few are ranked, about 2p for p rows, whatever the number of seats.
    Ties go to the smaller ``key``.
    """
    whole = Window.partitionBy(*group)
    p = F.count(F.lit(1)).over(whole)
    wide = votes.withColumn("_sum", F.sum(vote).over(whole)).withColumn("_p", p)
    many = F.col(seats) + F.col("_p") / 2 + 1
    few = F.col(seats) - F.col("_p") / 2 - 1
    sure = F.when(few > 0, F.floor(F.col(vote) * few / F.col("_sum") + 0.5)).otherwise(0)
    most = F.ceil(F.col(vote) * many / F.col("_sum") + 0.5)
    ranged = wide.withColumn("_sure", F.when(F.col("_sum") > 0, sure).otherwise(0).cast("long")).withColumn(
        "_most", F.when(F.col("_sum") > 0, most).otherwise(0).cast("long")
    )
    left = ranged.withColumn("_left", F.col(seats) - F.sum("_sure").over(whole))
    tried = left.withColumn(
        "_k",
        F.explode_outer(
            F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_most") - 1))
        ),
    )
    quotient = F.col(vote) / (F.col("_k") * 2 + 1)
    best = Window.partitionBy(*group).orderBy(quotient.desc_nulls_last(), key)
    won = tried.withColumn(
        "_won",
        (F.col("_k").isNotNull() & (F.row_number().over(best) <= F.col("_left"))).cast("long"),
    )
    kept = [c for c in votes.columns if c not in (*group, key)]
    return won.groupBy(*group, key).agg(
        *[F.first(c).alias(c) for c in kept],
        (F.first("_sure") + F.sum("_won")).cast("long").alias("quota"),
    )


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    passes: int = MOST_PASSES,
    block: int = BLOCK_WORDS,
    rows_per_shard: int = ROWS_PER_SHARD,
    seed: int = SEED,
) -> DataFrame:
    """Rows (doc_id, size, source, source_size, target, taken), one for each row.

    The words a source takes differ from its target by half a block, plus less
    than a block for each shard whose last block is short.  Runs a job.
    """
    sized = checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")
    )
    aimed = targets(sources, weights, passes)
    all_rows = Window.partitionBy()
    blocks = F.round(F.sum("target").over(all_rows) / block).cast("long")
    seated = apportion(
        aimed.withColumn("_one", F.lit(1)).withColumn("_blocks", blocks),
        ["_one"], "target", "_blocks", "rank",
    ).withColumn("_shards", F.ceil(F.col("_rows") / rows_per_shard).cast("long"))

    by_source = F.col("d.source").eqNullSafe(F.col("s.source"))
    key = F.xxhash64(F.lit(seed), "d.doc_id")
    dealt = (
        sized.alias("d")
        .join(
            seated.select(
                "source", "rank", "source_size", "target", "_shards", F.col("quota").alias("_quota")
            ).alias("s"),
            by_source,
        )
        .select(
            "d.doc_id", "d.source", "d.size", "s.rank", "s.source_size", "s.target",
            F.col("s._quota").alias("_blocks"),
            F.pmod(key, F.col("s._shards")).alias("_shard"),
            F.xxhash64(F.lit(seed + 1), "d.doc_id").alias("_order"),
        )
    )
    shards = dealt.groupBy("rank", "_shard").agg(
        F.sum("size").alias("_words"), F.first("_blocks").alias("_blocks")
    )
    quotas = apportion(shards, ["rank"], "_words", "_blocks", "_shard")
    line = Window.partitionBy("rank", "_shard").orderBy("_order", "doc_id", "size")
    laid = (
        dealt.drop("_blocks")
        .join(quotas.select("rank", "_shard", "_words", "quota"), ["rank", "_shard"])
        .withColumn("_row", F.row_number().over(line))
        .withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_start", F.col("_end") - F.col("size"))
    )
    wanted = F.col("quota") * block
    laps = F.least(F.floor(wanted / F.col("_words")), F.lit(passes)).cast("long")
    laid = laid.withColumn("_laps", F.when(F.col("_words") > 0, laps).otherwise(0)).withColumn(
        # blocks of the last, partial pass
        "_part",
        F.when(
            (F.col("_words") > 0) & (F.col("_laps") < passes),
            F.round((wanted - F.col("_laps") * F.col("_words")) / block),
        )
        .otherwise(0)
        .cast("long"),
    )
    spans = F.sequence(
        F.floor(F.col("_start") / block).cast("long"), F.floor((F.col("_end") - 1) / block).cast("long")
    )
    over = laid.withColumn("_block", F.explode_outer(F.when(F.col("size") > 0, spans)))
    pick = F.xxhash64(F.lit(seed + 2), "rank", "_shard", "_block")
    drawn = Window.partitionBy("rank", "_shard").orderBy(F.col("_block").isNull(), pick, "_block")
    inside = F.least("_end", (F.col("_block") + 1) * block) - F.greatest("_start", F.col("_block") * block)
    picked = over.withColumn("_rank", F.dense_rank().over(drawn)).withColumn(
        "_words_in", F.when(F.col("_block").isNotNull() & (F.col("_rank") <= F.col("_part")), inside)
    )
    return picked.groupBy("rank", "_shard", "_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("source").alias("source"),
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        (F.first("_laps") * F.first("size") + F.coalesce(F.sum("_words_in"), F.lit(0)))
        .cast("long")
        .alias("taken"),
    ).drop("rank", "_shard", "_row")
