"""Merkle manifest of a documents table by bitmap ranks.

Each group (language) has a bitmap of its doc_ids, made by merging the bits of
its rows word by word: 64 ids are a word, words without ids are not stored.  A
popcount directory gives each block of 1,024 words and each word the number of
ids before it, so a row's place among the leaves of its group is a directory
entry plus the set bits below its own: no leaf is sorted.  Leaves then meet in
slot arrays keyed by group and block of 512 places; each array gives three
levels at once, and the nodes it leaves are dealt the same way until one per
group is left.  The roots of the groups are the leaves of a last tree.

Proofs come down the same arrays: a block learns what lies above it, once, and
adds the siblings of its own three levels.

Defined results: a null doc_id comes before all others of its language; rows
that share a doc_id follow each other by leaf, equal ones in any order; null
languages are a group of their own, the first; the proof of a lone leaf is the
digest of nothing; an empty table gives an empty result.  Other columns play no
part.
"""

import functools
import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankbench.operators.joins import broadcast_if_short
from rankbench.operators.numbering import ordered_sums
from rankbench.session import checkpointed, fresh_path

# Nodes under one node, and levels that one slot array reduces.
ARITY_BITS = 3
ARRAY_LEVELS = 3
ARRAY_BITS = ARITY_BITS * ARRAY_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Word of the null id, below the word of any other.
NULL_WORD = -(1 << 60)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Manifest:
    """A tree for each group, and the paths that lead out of the leaves' arrays.

    ``leaves``: (g, doc_id, pos, m, h, altered), a row for each document; ``above``:
    (g, block, left, right, subroot, root), the siblings level by level over each
    array of leaves.
    """

    leaves: DataFrame
    above: DataFrame


def leaf(text: Column) -> Column:
    """Digest of a row with this text: each field as its byte count, a colon and the value."""

    def field(value: Column) -> Column:
        written = value.cast("string")
        sized = F.concat(F.octet_length(written).cast("string"), F.lit(":"), written)
        return F.coalesce(sized, F.lit("-"))

    values = [text if name == "text" else F.col(name) for name in FIELDS]
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def lowered(text: Column) -> Column:
    """A-Z lower-cased only."""
    return F.translate(text, UPPER, LOWER)


def _written(rows: DataFrame, purpose: str) -> DataFrame:
    path = fresh_path(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _directory(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, w, bits, before, more) of each word, and (g, m) of each group.

    ``before`` counts the rows of the group below the word, ``more`` the rows
    beyond one of each bit of the word, where ids repeat.
    """
    words = checkpointed(
        leaves.groupBy("g", "w").agg(
            F.expr("bit_or(shiftleft(1L, b))").alias("bits"), F.count(F.lit(1)).alias("n")
        )
    ).withColumn("block", F.shiftright("w", 10))
    blocks = words.groupBy("g", "block").agg(F.sum("n").alias("rows"))
    summed = checkpointed(ordered_sums(blocks, ["g", "block"], {"upto": "rows"}))
    groups = checkpointed(
        summed.groupBy("g").agg(
            F.min(F.col("upto") - F.col("rows")).alias("start"), F.sum("rows").alias("m")
        )
    )
    based = summed.join(broadcast_if_short(groups), "g").select(
        "g", "block", (F.col("upto") - F.col("rows") - F.col("start")).alias("base")
    )
    inside = Window.partitionBy("g", "block").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    directory = (
        words.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(based, ["g", "block"])
        .select("g", "w", "bits", (F.col("base") + F.col("inside")).alias("before"), "n")
    )
    repeated = words.where(F.col("n") > F.bit_count("bits")).select("g", "w")
    more = (
        leaves.select("g", "w", "b")
        .join(repeated, ["g", "w"], "left_semi")
        .groupBy("g", "w", "b")
        .agg((F.count(F.lit(1)) - 1).alias("n"))
        .where("n > 0")
        .groupBy("g", "w")
        .agg(F.collect_list(F.struct("b", "n")).alias("more"))  # a word has 64 bits
    )
    if repeated.isEmpty():
        directory = directory.withColumn("more", F.lit(None).cast("array<struct<b:int,n:bigint>>"))
    else:
        directory = directory.join(more, ["g", "w"], "left")
    return directory.drop("n"), groups.select("g", "m")


def _numbered_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with ``tie``: place from 0 among the rows of one (g, pos), by leaf.

    Equal leaves are numbered partition by partition, so no task takes them all.
    """
    key = ["g", "pos", "h", "part"]
    placed = checkpointed(rows).withColumn("part", F.spark_partition_id())
    counts = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    summed = checkpointed(ordered_sums(counts, key, {"upto": "n"}))
    starts = summed.groupBy("g", "pos").agg(F.min(F.col("upto") - F.col("n")).alias("start"))
    offsets = summed.join(starts, ["g", "pos"]).select(
        *key, (F.col("upto") - F.col("n") - F.col("start")).alias("offset")
    )
    inside = Window.partitionBy(*key).orderBy(F.lit(0))
    return (
        placed.withColumn("inside", F.row_number().over(inside) - 1)
        .join(offsets, key)
        .withColumn("tie", F.col("inside") + F.col("offset"))
        .drop("part", "inside", "offset")
    )


def place(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g, w, b, h, ...) with ``pos``, the place in the group, and its size ``m``.

    Runs jobs.
    """
    directory, groups = _directory(leaves)
    below = F.expr("bit_count(bits & ~shiftleft(-1L, b))")
    extra = F.expr("aggregate(filter(more, e -> e.b < b), 0L, (s, e) -> s + e.n)")
    ranked = leaves.join(directory, ["g", "w"]).select(
        *leaves.columns,
        (F.col("before") + below + F.coalesce(extra, F.lit(0))).alias("pos"),
        F.coalesce(F.expr("exists(more, e -> e.b = b)"), F.lit(False)).alias("repeats"),
    )
    ranked = _written(ranked, "merkle-ranked")
    once = ranked.where("not repeats").withColumn("tie", F.lit(0).cast("long"))
    again = ranked.where("repeats")
    if not again.isEmpty():
        once = once.unionByName(_numbered_repeats(again))
    return once.join(broadcast_if_short(groups), "g").select(
        *leaves.columns, (F.col("pos") + F.col("tie")).alias("pos"), "m"
    )


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _array(table: pa.Table) -> tuple[list[str], list[int], int]:
    """Slot array of a block, the slot of each row, and the levels that it has."""
    slots = [p & ((1 << ARRAY_BITS) - 1) for p in table.column("pos").to_pylist()]
    array = [""] * len(slots)
    for slot, h in zip(slots, table.column("h").to_pylist()):
        array[slot] = h
    left, levels = table.column("m")[0].as_py(), 0
    while left > 1 and levels < ARRAY_LEVELS:
        left, levels = -(-left >> ARITY_BITS), levels + 1
    return array, slots, levels


def _levels(array: list[str], levels: int) -> list[list[str]]:
    """The array and the arrays above it."""
    found = [array]
    for _ in range(levels):
        below = found[-1]
        found.append(
            [_digest(below[k : k + (1 << ARITY_BITS)]) for k in range(0, len(below), 1 << ARITY_BITS)]
        )
    return found


def _reduced(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One block of nodes to the node it becomes."""
    array, _, levels = _array(table)
    (h,) = _levels(array, levels)[-1]
    m = table.column("m")[0].as_py()
    for _ in range(levels):
        m = -(-m >> ARITY_BITS)
    return pa.table({"g": [key[0].as_py()], "pos": [key[1].as_py()], "h": [h], "m": [m]})


def _siblings(levels: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """Level by level the other nodes of the run: those before and those after."""
    found = []
    for nodes in levels[:-1]:
        start = slot >> ARITY_BITS << ARITY_BITS
        stop = start + (1 << ARITY_BITS)
        found.append(("".join(nodes[start:slot]), "".join(nodes[slot + 1 : stop])))
        slot >>= ARITY_BITS
    return found


def _led_down(key: tuple[pa.Scalar, ...], table: pa.Table, above: pa.Table) -> pa.Table:
    """Nodes of a block with all siblings between them and the root."""
    array, slots, levels = _array(table)
    tree = _levels(array, levels)
    left, right = above.column("left")[0].as_py(), above.column("right")[0].as_py()
    paths = [_siblings(tree, slot) for slot in slots]
    n = len(slots)
    return pa.table(
        {
            "g": table.column("g"),
            "block": table.column("pos"),
            "left": pa.array([[a for a, _ in p] + left for p in paths], pa.list_(pa.string())),
            "right": pa.array([[b for _, b in p] + right for p in paths], pa.list_(pa.string())),
            "subroot": [above.column("subroot")[0].as_py()] * n,
            "root": [above.column("root")[0].as_py()] * n,
        }
    )


NODE = "g string, pos long, h string, m long"
PATH = "g string, block long, left array<string>, right array<string>, subroot string, root string"
PATH_COLUMNS = ["g", "block", "left", "right", "subroot", "root"]


def in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", ARRAY_BITS))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Nodes (g, pos, h, m) of each round, and the roots of the groups that end with it.

    Runs a job for every three levels.
    """
    rounds, ends = [nodes], []
    while True:
        above = checkpointed(
            in_blocks(rounds[-1].select("g", "pos", "h", "m"))
            .groupBy("g", "block")
            .applyInArrow(_reduced, NODE)
        )
        ends.append(above.where("m = 1"))
        rounds.append(above.where("m > 1"))
        if rounds[-1].isEmpty():
            return rounds[:-1], ends


def descend(rounds: list[DataFrame], ends: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths (g, block, left, right, subroot, root) over the blocks of the first round.

    ``above`` has those over the roots of the groups.  Runs a job for every three levels.
    """
    paths = None
    for r in reversed(range(len(rounds))):
        known = ends[r].select("g").join(above, "g").withColumn("block", F.lit(0).cast("long"))
        known = known.select(*PATH_COLUMNS)
        if paths is not None:
            known = known.unionByName(paths)
        if r:
            paths = checkpointed(led_down(rounds[r], known))
    return known


def led_down(nodes: DataFrame, known: DataFrame) -> DataFrame:
    blocks = in_blocks(nodes.select("g", "pos", "h", "m")).groupBy("g", "block")
    return blocks.cogroup(known.groupBy("g", "block")).applyInArrow(_led_down, PATH)


def manifest(docs: DataFrame, altered: Column | None = None) -> Manifest:
    """Manifest of ``docs`` (doc_id, source, lang, n_chars, text).

    ``altered`` is the text that a row is to be verified with instead of its own,
    null where that stays.  Runs jobs.
    """
    text = F.col("text").cast("string")
    other = F.lit(None).cast("string") if altered is None else altered
    leaves = _written(
        docs.select(
            F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")).alias("g"),
            F.coalesce(F.shiftright(F.col("doc_id").cast("long"), 6), F.lit(NULL_WORD)).alias("w"),
            F.coalesce(F.col("doc_id").cast("long").bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("b"),
            F.col("doc_id"),
            leaf(text).alias("h"),
            F.when(other.isNotNull(), leaf(other)).alias("altered"),
        ),
        "merkle-leaves",
    )
    placed = _written(place(leaves).drop("w", "b"), "merkle-places")
    rounds, ends = climb(placed)
    subroots = functools.reduce(DataFrame.unionByName, ends).select("g", F.col("h").alias("subroot"))
    ordered = ordered_sums(subroots.withColumn("n", F.lit(1).cast("long")), ["g"], {"upto": "n"})
    groups = checkpointed(
        ordered.select(
            F.col("g").alias("group"),
            F.lit("").alias("g"),
            (F.col("upto") - 1).alias("pos"),
            F.col("subroot").alias("h"),
            F.lit(subroots.count()).cast("long").alias("m"),
        )
    )
    top, top_ends = climb(groups)
    none = F.array().cast("array<string>")
    root = functools.reduce(DataFrame.unionByName, top_ends).select(
        "g", none.alias("left"), none.alias("right"), F.lit("").alias("subroot"),
        F.col("h").alias("root"),
    )
    over = led_down(groups, descend(top, top_ends, root)).drop("g", "subroot")
    named = groups.select("pos", F.col("group").alias("g"), F.col("h").alias("subroot"))
    out = checkpointed(over.join(named, over["block"] == named["pos"]).drop("block", "pos"))
    return Manifest(placed, checkpointed(descend(rounds, ends, out)))


def _proved(key: tuple[pa.Scalar, ...], table: pa.Table, above: pa.Table) -> pa.Table:
    """Proof and folded root of each leaf of a block."""
    array, slots, levels = _array(table)
    tree = _levels(array, levels)
    over = list(zip(above.column("left")[0].as_py(), above.column("right")[0].as_py()))
    end = "".join(a + b for a, b in over)
    subroot, root = above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
    proofs, folded = [], []
    for slot, own, other in zip(slots, table.column("h").to_pylist(), table.column("altered").to_pylist()):
        path = _siblings(tree, slot)
        proofs.append(_digest([*(a + b for a, b in path), end]))
        node = own if other is None else other
        for a, b in (*path, *over):
            node = _digest([a, node, b])
        folded.append(node)
    n = len(slots)
    return pa.table(
        {
            "doc_id": table.column("doc_id"),
            "leaf": table.column("h"),
            "subroot": [subroot] * n,
            "root": [root] * n,
            "proof_sha256": proofs,
            "folded_root": folded,
            "verified": [f == root for f in folded],
        }
    )


def proofs(made: Manifest) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    ``folded_root`` is folded level by level from the altered leaf, or from the
    original one where none was altered, and the original siblings.
    """
    id_type = made.leaves.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean"
    )
    leaves = in_blocks(made.leaves.select("g", "pos", "doc_id", "h", "altered", "m"))
    return (
        leaves.groupBy("g", "block")
        .cogroup(made.above.groupBy("g", "block"))
        .applyInArrow(_proved, schema)
    )
