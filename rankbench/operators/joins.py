"""Joins that hold up when one key carries a large share of the rows."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it has at least one in HOT_SHARE of all rows, so there are
# at most HOT_SHARE hot keys whatever the data: that bound allows the broadcast.
HOT_SHARE = 512


def hot_keys(counted: DataFrame, key: str, count: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys with at least 1/``share`` of the total; at most ``share`` rows."""
    total = counted.agg(F.sum(count).alias("_total")).scalar()
    return counted.where(F.col(count) * share >= total).select(key)


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    hot: DataFrame,
    how: str = "inner",
) -> DataFrame:
    """Join ``facts`` to ``lookup`` (unique on ``key``) with hot keys set apart.

    Facts with a hot key stay where they are and meet a broadcast of the few hot
    lookup rows; the others meet in a shuffle that no key can dominate.
    ``hot`` comes from :func:`hot_keys` and must be a subset of the lookup's keys.
    """
    flag = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    hot_rows = F.broadcast(lookup.join(flag, key, "left_semi"))
    marked = facts.join(flag, key, "left")
    warm = marked.where(F.col("_hot")).drop("_hot").join(hot_rows, key)
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(lookup, key, how)
    return warm.unionByName(cold)


# A table of a few numbers and a key a row is short up to this many rows.
SHORT_ROWS = 500_000


def broadcast_if_short(table: DataFrame, most: int = SHORT_ROWS) -> DataFrame:
    """A materialised table, marked for broadcast if it is short.

    Counts the table; a longer one is joined by the shuffle that Spark picks.
    """
    return F.broadcast(table) if table.count() <= most else table


# Ids of a run up to these bytes are broadcast to filter a large table.
BROADCAST_BYTES = 32 << 20
# Bits of a Bloom filter for each id, hashes of an id, and bits at most (2 MB).
BITS_PER_ID = 10
HASHES = 5
MOST_BITS = 1 << 24


def bloom_filter(ids: DataFrame, column: str, n: int) -> Callable[[Column], Column] | None:
    """Predicate that holds for every one of ``n`` ids, and for few other values.

    The bits are set by Spark, 64 of them a row; the words that have any come to
    the driver, ``MOST_BITS`` at most, and go into the plan as one array, so the
    filter runs where the rows are scanned.  None where so many ids would fill it.
    Runs a job.
    """
    bits = 1 << max(10, (n * BITS_PER_ID - 1).bit_length())
    if bits > MOST_BITS:
        bits = MOST_BITS
        if bits < 4 * n:
            return None

    def places(value: Column) -> Column:
        return F.array(*[F.pmod(F.xxhash64(F.lit(i), value), F.lit(bits)) for i in range(HASHES)])

    # nulls match nothing in a join
    words = (
        ids.where(F.col(column).isNotNull())
        .select(F.explode(places(F.col(column))).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("set"))
        .collect()
    )
    table = [0] * (bits >> 6)
    for row in words:
        table[row["word"]] = row["set"]
    # one text, folded into one array: a column call for each number would be slow to build
    stored = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")

    def is_set(at: Column) -> Column:
        word = F.get(stored, F.shiftright(at, 6).cast("int"))
        return F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return lambda value: value.isNotNull() & F.forall(places(value), is_set)


def fetch(run: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """``run`` joined to a large table with one row per docno.

    The table is first cut down to the run's documents where they lie, so it is
    read but not shuffled whole: by a broadcast of the ids of a short run, by a
    Bloom filter of those of a longer one, after which the few rows that are left
    meet the run in a shuffle.  Measures the run, which should be materialised.
    """
    ids = run.select("docno").distinct()
    n, size = ids.agg(F.count(F.lit(1)), F.sum(F.octet_length("docno"))).first()
    if (size or 0) + 16 * n <= BROADCAST_BYTES:
        table = table.join(F.broadcast(ids), "docno", "left_semi")
    else:
        holds = bloom_filter(ids, "docno", n)
        table = table.where(holds(F.col("docno"))) if holds else table
    return run.join(table, "docno", how)
