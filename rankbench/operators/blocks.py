"""Token ids, fixed-size blocks and masking for masked-word training data."""

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from rankbench.functions import text as tx
from rankbench.functions.hashing import draw, share
from rankbench.operators.joins import hot_keys, lookup_join
from rankbench.operators.lexicon_index import tokenised
from rankbench.operators.numbering import ordered_sums

UNKNOWN_ID = 0
MASK_ID = 1
FIRST_ID = 2
BLOCK = 512
BATCH_ROWS = 1000
MASK_SHARE = 0.25
# Characters that the tokenizer is given at once.
ENCODED_CHARS = 1 << 18
KEPT_LABEL = -100


def word_ids(corpus: DataFrame, size: int | None = None) -> DataFrame:
    """term, cf and id of every word, or of the ``size`` most frequent; ids follow (cf desc, term).

    The vocabulary is numbered by a range sort, so it may have any size.  Runs
    a job.
    """
    counted = (
        tokenised(corpus)
        .select(F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("cf"))
        .select("term", "cf", (-F.col("cf")).alias("_rarer"), F.lit(1).alias("_one"))
    )
    numbered = ordered_sums(counted, ["_rarer", "term"], {"_place": "_one"})
    kept = numbered if size is None else numbered.where(F.col("_place") <= size)
    return kept.select(
        "term", "cf", (F.col("_place") + (FIRST_ID - 1)).cast("int").alias("id")
    )


def token_ids(
    corpus: DataFrame, vocabulary: DataFrame, keys: Sequence[str] = ("docno",)
) -> DataFrame:
    """``keys`` and the array of ids of the text's words in order.

    Words are looked up by a join in which frequent ones are set apart; a word
    that ``vocabulary`` (term, cf, id) lacks gets the unknown id.
    """
    laid = corpus.where(F.col("text").isNotNull()).select(*keys, "text")
    found = lookup_join(
        laid.select(*keys, F.posexplode_outer(tx.words(F.col("text"))).alias("pos", "term")),
        vocabulary.select("term", "id"),
        "term",
        hot_keys(vocabulary, "term", "cf"),
        "left",
    ).withColumn("id", F.coalesce("id", F.lit(UNKNOWN_ID)))
    token = F.when(F.col("pos").isNotNull(), F.struct("pos", "id"))
    return found.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(token)), lambda t: t.id).alias("ids")
    )


def subword_ids(corpus: DataFrame, path: str, keys: Sequence[str] = ("docno",)) -> DataFrame:
    """``keys`` and the ids that the tokenizer file ``path`` gives the text, in order.

    The file must lie at ``path`` wherever a task runs; it is opened once for each
    Python worker.  No special tokens are added and texts are whole.  A few texts
    are encoded at a time, as what the tokenizer returns is far larger than its ids.
    """

    @F.arrow_udf(ArrayType(IntegerType()))
    def encoded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _tokenizer(path)
        for part in texts:
            sizes, ids = [0], [np.empty(0, "int32")]
            for few in _few(part):
                for e in tokenizer.encode_batch(few, add_special_tokens=False):
                    ids.append(np.array(e.ids, "int32"))
                    sizes.append(len(ids[-1]))
            ends = pa.array(np.cumsum(sizes), pa.int32())
            yield pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))

    laid = corpus.where(F.col("text").isNotNull())
    return laid.select(*keys, encoded(F.col("text")).alias("ids"))


def _few(texts: pa.Array, most: int = ENCODED_CHARS) -> Iterator[list[str]]:
    """All texts in order, in lists of ``most`` characters or one text."""
    few, held = [], 0
    for text in texts:
        text = text.as_py()
        if few and held + len(text) > most:
            yield few
            few, held = [], 0
        few.append(text)
        held += len(text)
    if few:
        yield few


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def batched(docs: DataFrame, seed: int = 42, rows: int = BATCH_ROWS) -> DataFrame:
    """``batch`` column: about ``rows`` documents share a value."""
    total = docs.agg(F.count(F.lit(1))).scalar()
    n = F.greatest(F.ceil(total / rows), F.lit(1))
    return docs.withColumn("batch", F.pmod(draw(seed, F.col("docno")), n).cast("int"))


def packed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Ids of each batch, in docno order, cut into blocks of exactly ``block``.

    Every document is cut at the block borders it crosses, and a block gathers
    its pieces, so a group holds at most ``block`` ids; the short rest of a
    batch is dropped.
    """
    before = (
        Window.partitionBy("batch")
        .orderBy("docno")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = docs.withColumn(
        "start", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0))
    ).where(F.size("ids") > 0)
    last = F.col("start") + F.size("ids") - 1
    pieces = placed.select(
        "batch", "ids", "start",
        F.explode(
            F.sequence(F.floor(F.col("start") / block), F.floor(last / block))
        ).alias("block"),
    )
    from_id = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    to_id = F.least((F.col("block") + 1) * block - F.col("start"), F.size("ids"))
    cut = pieces.select(
        "batch", "block", "start",
        F.slice("ids", (from_id + 1).cast("int"), (to_id - from_id).cast("int")).alias("piece"),
    )
    return (
        cut.groupBy("batch", "block")
        .agg(
            F.flatten(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("start", "piece"))), lambda p: p.piece
                )
            ).alias("input_ids")
        )
        .where(F.size("input_ids") == block)
        .select("batch", F.col("block").cast("int").alias("block"), "input_ids")
    )


def masked(
    blocks: DataFrame, vocabulary_size, probability: float = MASK_SHARE, seed: int = 42
) -> DataFrame:
    """``input_ids`` with masked positions and ``labels`` with the original ids there.

    A position is chosen with ``probability``; of the chosen ones 80 % become
    the mask id, 10 % a random word id, 10 % stay.  ``vocabulary_size`` is a
    number or a column.
    """
    size = F.lit(vocabulary_size) if isinstance(vocabulary_size, int) else vocabulary_size
    sized = blocks.withColumn("_size", size)

    def key(i):
        return F.concat_ws(":", F.col("batch"), F.col("block"), i)

    def chosen(i):
        return share(f"{seed}/choose", key(i)) < probability

    def masked_id(x, i):
        kind = share(f"{seed}/kind", key(i))
        random_id = (F.pmod(draw(f"{seed}/word", key(i)), F.col("_size")) + FIRST_ID).cast("int")
        replaced = F.when(kind < 0.8, F.lit(MASK_ID)).when(kind < 0.9, random_id).otherwise(x)
        return F.when(chosen(i), replaced).otherwise(x)

    return sized.select(
        "batch", "block",
        F.transform("input_ids", lambda x, i: masked_id(x, i)).alias("input_ids"),
        F.transform(
            "input_ids", lambda x, i: F.when(chosen(i), x).otherwise(F.lit(KEPT_LABEL))
        ).alias("labels"),
    )
