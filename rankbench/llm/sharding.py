"""Shards from a hierarchical weighted hash tree.

Shards hang in racks and racks in regions.  A document descends the tree: at
each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the
document's id and the child's name, and the smallest draw wins, so a child is
chosen in proportion to its weight.  Draws do not depend on the siblings, so a
changed weight moves documents only into or out of the subtrees whose weights
change.  ``topology`` gives every shard beyond the base tree a region of its
own: one more shard then adds a subtree and changes no other weight, and takes
documents only into itself.

Defined results: the id and the shard count decide, so equal texts under
different ids go their own ways and repeated rows go together; a null id has a
fixed draw of its own; a null text has size 16 and the checksum of no bytes; an
empty table gives an empty result.  Other columns play no part.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankbench.functions.binding import bound
from rankbench.operators.numbering import number_by_digest

RACKS_PER_REGION = 2
SHARDS_PER_RACK = 5
BASE_SHARDS = 40
ROW_BYTES = 16

# region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def topology(shards: int, base: int = BASE_SHARDS) -> Tree:
    """Tree of ``shards`` equal shards; those from ``base`` on stand alone."""
    tree: Tree = {}
    for shard in range(shards):
        if shard < base:
            rack = shard // SHARDS_PER_RACK
            region = f"region{rack // RACKS_PER_REGION}"
            tree.setdefault(region, {}).setdefault(f"rack{rack}", {})[shard] = 1.0
        else:
            tree[f"added{shard}"] = {f"added{shard}": {shard: 1.0}}
    return tree


def weight_of(node) -> float:
    return sum(map(weight_of, node.values())) if isinstance(node, dict) else float(node)


def draw(key: Column, level: str, name, weight: float) -> Column:
    """Exponential draw of one child for one document: the smallest wins."""
    digest = F.xxhash64(F.lit(level), F.lit(str(name)), F.coalesce(key.cast("string"), F.lit("null:")))
    # 53 bits and a half: never 0 or 1
    uniform = (F.shiftrightunsigned(digest, 11).cast("double") + F.lit(0.5)) / F.lit(2.0**53)
    return -F.log(uniform) / F.lit(weight)


def _winner(key: Column, level: str, children: dict) -> Column:
    draws = [
        F.struct(draw(key, level, name, weight_of(child)).alias("draw"), F.lit(name).alias("name"))
        for name, child in children.items()
        if weight_of(child) > 0
    ]
    if len(draws) == 1:
        return draws[0]["name"]
    return F.array_min(F.array(*draws))["name"]


def shard_of(key: Column, tree: Tree) -> Column:
    """Column expression: descend region, rack and shard levels."""

    def choose(won: Column, options: dict) -> Column:
        """The option named by ``won``; only that branch is evaluated."""
        chosen = None
        for name, value in options.items():
            chosen = F.when(won == name, value) if chosen is None else chosen.when(won == name, value)
        return chosen

    racks = {r: {k: v for k, v in node.items() if weight_of(v) > 0} for r, node in tree.items()}
    racks = {r: node for r, node in racks.items() if node}
    by_rack = {name: shards for node in racks.values() for name, shards in node.items()}
    rack = bound(
        _winner(key, "region", racks),
        lambda region: choose(region, {r: _winner(key, "rack", node) for r, node in racks.items()}),
    )
    return bound(
        rack, lambda won: choose(won, {r: _winner(key, "shard", s) for r, s in by_rack.items()})
    )


def assign(docs: DataFrame, shards: int = BASE_SHARDS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot), one for each row of ``docs``.

    ``slot`` counts from 0 within the shard.  Texts are read once and do not
    move; the places are counted over hash buckets, so no task holds a shard.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    placed = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(F.col("doc_id"), topology(shards)).alias("shard"),
    )
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null:")))
    numbered = number_by_digest(placed, order, "slot", ["shard"])
    return numbered.withColumn("slot", F.col("slot").cast("long") - 1)
