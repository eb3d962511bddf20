"""Near-duplicate documents by SimHash with deletion-variant signatures.

A text's fingerprint is the bitwise majority of the hashes of its word
shingles.  Fingerprints link when they differ in at most ``MAX_BITS`` of 64
bits.  To find all such pairs, a fingerprint is cut into two halves: of three
differing bits at most one falls into one of them, so that half agrees once the
differing position is made a wildcard.  Each of the 64 one-wildcard variants is
a key; fingerprints that share a key meet, and the distance is verified.  No
pair within the distance is missed.

Defined results: a null or empty text, or one of white space, has fingerprint
zero, which is linked like any other; fewer words than a shingle make one
shingle of the whole sequence; equal rows have equal fingerprints; a row whose
doc_id is null takes part, but never names a component (null if no member has
an id); an empty table gives an empty result.  Other columns play no part.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankbench.llm.arrays import pairs_apart, sorted_groups
from rankbench.llm.graph import components, forest
from rankbench.llm.rows import row_fields, whole_row
from rankbench.session import checkpointed

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
HALF = 32
# Fingerprints under one key that a task compares at once; larger groups are
# dealt out as pairs of blocks of this size.
BLOCK = 4096
# Links held in a task before they are reduced to a forest, which takes some 150
# bytes for each.
HELD_LINKS = 65_536


def fingerprint_of(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    # bytes.lower and bytes.split touch ASCII letters and ASCII white space only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    begin = starts[: len(words) - width + 1].tolist()
    end = (starts[width:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(begin, end)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(majority.view(np.uint64)[0])


def fingerprint(column, width: int = SHINGLE_WORDS):
    """Column expression: the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def signed(texts: pa.Array) -> pa.Array:
        found = np.fromiter(
            (fingerprint_of(t.as_py(), width) for t in texts), np.uint64, len(texts)
        )
        return pa.array(found.view(np.int64))

    return signed(column)


def _linked(keys, fps, max_bits):
    """Components of the links within groups of equal keys, as (node, root)."""
    a, b, held = [], [], 0
    bits = fps.view(np.uint64)
    for i, j in pairs_apart(keys):
        near = np.bitwise_count(bits[i] ^ bits[j]) <= max_bits
        if near.any():
            a.append(fps[i[near]])
            b.append(fps[j[near]])
            held += len(a[-1])
        if held > HELD_LINKS:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(np.concatenate(a), np.concatenate(b))


def _compare(keys: list[str], max_bits: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, (fps,), large in sorted_groups(batches, keys, most):
            if large:  # left to the second step: (key, fingerprint)
                kind, a, b = np.ones(len(fps), np.int8), group[0], fps
            else:
                a, b = _linked(group, fps, max_bits)
                kind = np.zeros(len(a), np.int8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(a), pa.array(b)], ["kind", "a", "b"]
            )

    return run


def linked_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join every component of distinct fingerprints ``fp``.

    ``max_bits`` is at most 3: with two halves one of them must hold at most one
    differing bit.  Groups larger than ``block`` are split over pairs of blocks.
    Runs jobs.
    """
    if max_bits > 3:
        raise ValueError("two halves find at most three differing bits")
    segment = F.when(F.col("at") < HALF, F.shiftrightunsigned("fp", HALF)).otherwise(
        F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    )
    wildcard = F.expr("shiftleft(1L, int(at % 32))")
    variants = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * HALF - 1))).alias("at"))
    keyed = variants.select(
        F.shiftleft(F.col("at").cast("long"), HALF)
        .bitwiseOR(segment.bitwiseAND(F.bitwise_not(wildcard)))
        .alias("key"),
        "fp",
    )
    met = checkpointed(
        keyed.repartition("key")
        .sortWithinPartitions("key", "fp")
        .mapInArrow(_compare(["key"], max_bits, block), "kind byte, a long, b long")
    )
    rest = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    sized = rest.join(rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").select(
        "key", "fp", blocks.alias("n"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own")
    )
    cells = sized.select(
        "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    ).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    )
    more = (
        cells.repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "fp")
        .mapInArrow(_compare(["key", "i", "j"], max_bits, 1 << 40), "kind byte, a long, b long")
    )
    return met.where("kind = 0").select("a", "b").unionByName(more.select("a", "b"))


def near_duplicates(
    docs: DataFrame,
    width: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    block: int = BLOCK,
) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links lead to, the row's own
    included.  Texts never leave the scan: only ids and fingerprints move.
    Equal fingerprints are one node, whatever their number.  Runs jobs.
    """
    return _grouped(docs, width, max_bits, block).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, width: int, max_bits: int, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, fp, root, component_id); the root alone tells components apart."""
    marked = checkpointed(docs.select("doc_id", fingerprint("text", width).alias("fp")))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(linked_fingerprints(nodes.select("fp"), max_bits, block))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row for each component: that of the smallest doc_id.

    A component whose ids are all null keeps one of its rows.  Where its smallest
    id stands on several of its rows, one with the least fingerprint stays; rows
    of that id in other components are judged there.
    """
    # whole rows in one column, so that none of their names meets one of this function's
    rows = docs.select("doc_id", "text", whole_row(docs).alias("row"))
    found = checkpointed(_grouped(rows, width, max_bits))
    best = (
        found.where("doc_id is not null and doc_id = component_id")
        .groupBy("root")
        .agg(F.min("component_id").alias("doc_id"), F.min("fp").alias("best"))
    )
    counts = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    best = checkpointed(best.join(counts, "doc_id").select("doc_id", "best", "n"))
    kept = rows.join(best.where("n = 1").select("doc_id"), "doc_id", "left_semi").select("row")
    repeated = best.where("n > 1").select("doc_id", "best")
    if not repeated.isEmpty():
        # only rows of repeated ids need their fingerprints again; they are set apart
        # first, for Spark would fingerprint every row before the join
        again = checkpointed(rows.join(repeated.select("doc_id"), "doc_id", "left_semi"))
        again = again.withColumn("best", fingerprint("text", width))
        again = again.join(repeated, ["doc_id", "best"], "left_semi")
        kept = kept.unionByName(again.dropDuplicates(["doc_id", "best"]).select("row"))
    unnamed = rows.where("doc_id is null")
    if not unnamed.isEmpty():
        # components without any id: their rows meet by the root of their fingerprints
        nameless = found.where("component_id is null").select("fp").distinct()
        roots = components(linked_fingerprints(nameless, max_bits))
        unnamed = (
            unnamed.withColumn("fp", fingerprint("text", width))
            .join(nameless, "fp", "left_semi")
            .join(roots, F.col("fp") == F.col("node"), "left")
            .withColumn("root", F.coalesce("root", "fp"))
            .dropDuplicates(["root"])
        )
        kept = kept.unionByName(unnamed.select("row"))
    return kept.select(*row_fields(docs))
