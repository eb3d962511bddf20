"""Exact duplicates by Patricia tries.

Texts are dealt by length and content hash, and the whole bytes of each are
inserted into a compressed radix trie: only equal byte strings end in the same
terminal node, which stores the owner of its texts and their number.  The hash
places texts, it never decides.

Each task first inserts its own rows, so copies of a text leave a task as one
terminal however many there are.  Those terminals are written once to the shared
folder.  Where a length and hash occur in one terminal only, that is the answer;
the bytes of the others are shuffled and merged.  A key met in very many
terminals is merged in two steps, so a task sees about the root of their number.
A trie that outgrows its memory gives up its largest subtrees: their texts go to
the next round, dealt by the subtree's path, through a written table.

Defined results: a null text is empty; empty texts are copies of each other;
texts are equal when their UTF-8 bytes are after A-Z are lower-cased.  The owner
of a group is the row with the largest (or smallest) doc_id; a null id owns only
a group without any other; of rows that repeat the owner's id exactly one is
kept.  An empty table gives an empty result.  Other columns play no part.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, ByteType, LongType, StringType, StructField, StructType

from rankbench.operators.joins import broadcast_if_short
from rankbench.session import checkpointed, fresh_path

# Bytes of text that a task's tries hold before they are written or give up subtrees.
TRIE_BYTES = 64 << 20
# Bytes of text in one batch that leaves a task.
BATCH_BYTES = 8 << 20
# A length and hash in more terminals than this is merged in two steps.
FAN_IN = 64
# Salt of a key that one task merges whole.
WHOLE = -1
# What a member or a node costs beside its text, roughly.
NODE_BYTES = 200


class Node:
    """Node of a trie: the bytes of its edge, children by first byte, and a terminal's rows."""

    __slots__ = ("label", "children", "owner", "count", "members", "given_up")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.owner = None
        self.count = 0
        self.members: list = []
        self.given_up = False


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest common prefix of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed radix trie over whole byte strings."""

    def __init__(self):
        self.root = Node(b"")
        self.size = 0

    def place(self, text: bytes) -> tuple[Node, int]:
        """The node where ``text`` ends, made if need be, or the given-up node it passes.

        With it comes the number of bytes on the path to that node.
        """
        here, at = self.root, 0
        while at < len(text):
            child = here.children.get(text[at])
            if child is None:
                child = Node(text[at:])
                here.children[text[at]] = child
                self.size += len(child.label) + NODE_BYTES
                return child, len(text)
            if text.startswith(child.label, at):
                at += len(child.label)
                if child.given_up:
                    return child, at
                here = child
                continue
            n = shared_prefix(child.label, text, at)
            middle = Node(child.label[:n])
            child.label = child.label[n:]
            middle.children[child.label[0]] = child
            here.children[text[at]] = middle
            self.size += NODE_BYTES
            here, at = middle, at + n
        return here, at

    def terminals(self, start: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        """Texts below a node with their terminal nodes."""
        stack = [(prefix, start or self.root)]
        while stack:
            before, node = stack.pop()
            text = before + node.label
            if node.count:
                yield text, node
            stack.extend((text, child) for child in node.children.values())

    def give_up(self, most: int) -> Iterator[tuple[bytes, bytes, Node]]:
        """Subtrees, largest first, until half of ``most`` is left: (path, text, terminal).

        They hang on the first branching node or, where something below was given up
        before, on a node above that, so a text's path stays the same from then on.
        One subtree always stays, so a trie of a single text gives up nothing.
        """
        prefix, top = b"", self.root
        while len(top.children) == 1 and not top.count:
            (child,) = top.children.values()
            prefix, top = prefix + child.label, child
        nodes, above = [top], [-1]
        for k, node in enumerate(nodes):
            nodes.extend(node.children.values())
            above.extend([k] * len(node.children))
        sizes = {id(n): len(n.label) + NODE_BYTES * (1 + len(n.members)) for n in nodes}
        touched = {id(n): n.given_up for n in nodes}
        for k in range(len(nodes) - 1, 0, -1):
            sizes[id(nodes[above[k]])] += sizes[id(nodes[k])]
            touched[id(nodes[above[k]])] |= touched[id(nodes[k])]
        free, stack = [], [(prefix, top)]
        while stack:
            before, node = stack.pop()
            for first, child in node.children.items():
                if not touched[id(child)]:
                    free.append((sizes[id(child)], before + bytes([first]), node))
                elif not child.given_up:
                    stack.append((before + child.label, child))
        free.sort(key=lambda f: f[:2], reverse=True)
        for size, path, node in free if touched[id(top)] else free[:-1]:
            if self.size <= most // 2:
                return
            for text, end in self.terminals(node.children[path[-1]], path[:-1]):
                yield path, text, end
            stub = Node(path[-1:])
            stub.given_up = True
            node.children[path[-1]] = stub
            self.size -= size - NODE_BYTES


def _first(a, b, largest: bool):
    """The better of two owners (doc_id, row): by id, a null id last, then the smaller row."""
    if a is None or b is None:
        return a if b is None else b
    if (a[0] is None) != (b[0] is None):
        return a if b[0] is None else b
    if a[0] == b[0]:
        return a if a[1] < b[1] else b
    return a if (a[0] > b[0]) == largest else b


def normalised(text: bytes) -> bytes:
    """A-Z lower-cased; every other byte stays."""
    return text.lower()


def _key(digest: bytes, hash_bits: int) -> int:
    """Content hash: the leading bits of the digest, as a whole number below 2**63."""
    return int.from_bytes(digest[:8], "big") >> (64 - hash_bits) if hash_bits else 0


class _Batches:
    """Rows collected to Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + NODE_BYTES
        if self.size >= BATCH_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema
            )
            self.rows, self.size = [], 0


def _schema(id_type, fields: str) -> StructType:
    """Columns by name; ``owner`` and ``doc_id`` have the type of the ids."""
    types = {
        "kind": ByteType(), "owner": id_type, "doc_id": id_type, "sha": StringType(), "body": BinaryType(),
    }
    return StructType([StructField(f, types.get(f, LongType())) for f in fields.split()])


LOCAL = "kind node row doc_id length hash sha owner owner_row n body"
MERGED = "kind node into length hash path owner owner_row n body"


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _local(schema: pa.Schema, most: int, hash_bits: int, largest: bool):
    """Rows of a task into tries; terminals (kind 1) and members of repeated ones (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33  # of the next row; names terminals too
        tries: dict[tuple[int, int], tuple[Trie, str]] = {}
        held = 0
        out = _Batches(schema)

        def written():
            for (length, key), (trie, sha) in tries.items():
                for text, node in trie.terminals():
                    name = node.members[0][1]
                    owner, owner_row = node.owner
                    # the digest is the key's own unless two texts share a key
                    digest = sha if sha else hashlib.sha256(text).hexdigest()
                    yield from out.add(
                        (1, name, None, None, length, key, digest, owner, owner_row, node.count, text),
                        len(text),
                    )
                    if node.count > 1:
                        for doc_id, row in node.members:
                            yield from out.add((0, name, row, doc_id, *[None] * 7))

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                text = normalised(text.as_py() or b"")
                digest = hashlib.sha256(text).digest()
                key = (len(text), _key(digest, hash_bits))
                trie, sha = tries.get(key) or (Trie(), digest.hex())
                if key not in tries or sha and sha != digest.hex():
                    tries[key] = (trie, sha if key not in tries else "")
                    held += NODE_BYTES
                before = trie.size
                node, _ = trie.place(text)
                held += trie.size - before + NODE_BYTES
                node.owner = _first(node.owner, (doc_id, number), largest)
                node.count += 1
                node.members.append((doc_id, number))
                number += 1
                if held >= most:
                    yield from written()
                    tries.clear()
                    held = 0
        yield from written()
        yield from out.rest()

    return run


def _merge(schema: pa.Schema, most: int, largest: bool):
    """Groups of a sorted stream into one trie each.

    Rows come with (length, hash, salt, path) in runs.  Kind 0 says which terminal
    a node went into, kind 1 is such a terminal; where its key was salted, or its
    subtree was given up, it has its bytes, else it is done.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Batches(schema)
        trie, at = Trie(), None

        def leave(key, text, node, path):
            """One terminal: whole with its bytes where it has to meet others again."""
            into = node.members[0]
            again = path is not None or key[2] != WHOLE
            yield from out.add(
                (1, into, into, key[0], key[1], _path(path, key[3]), *node.owner, node.count,
                 text if again else None),
                len(text) if again else 0,
            )
            for member in node.members[1:]:
                yield from out.add((0, member, into, *[None] * 7))

        def all_of(key):
            for text, node in trie.terminals():
                yield from leave(key, text, node, None)

        for batch in batches:
            columns = {f: batch.column(f) for f in batch.schema.names}
            keys = zip(*[columns[f].to_pylist() for f in ("length", "hash", "salt", "path")])
            rest = zip(*[columns[f].to_pylist() for f in ("node", "owner", "owner_row", "n")])
            for key, (name, owner, owner_row, n), body in zip(keys, rest, columns["body"]):
                if key != at:
                    yield from all_of(at)
                    trie, at = Trie(), key
                text = body.as_py()
                node, depth = trie.place(text)
                if node.given_up:  # met again in the next round
                    path = _path(text[:depth], key[3])
                    yield from out.add(
                        (1, name, name, key[0], key[1], path, owner, owner_row, n, text), len(text)
                    )
                    continue
                node.owner = _first(node.owner, (owner, owner_row), largest)
                node.count += n
                node.members.append(name)
                trie.size += NODE_BYTES
                if trie.size > most:
                    if key[2] == WHOLE:
                        for path, text, node in trie.give_up(most):
                            yield from leave(key, text, node, path)
                    else:  # combining is all that this step is for
                        yield from all_of(at)
                        trie = Trie()
        yield from all_of(at)
        yield from out.rest()

    return run


def _path(prefix: bytes | None, before: int) -> int:
    """Number of a subtree's path; the path of the round before where it was not given up."""
    if prefix is None:
        return before
    return int.from_bytes(hashlib.sha256(prefix).digest()[:8], "big") >> 1


def duplicates(
    docs: DataFrame,
    keep: str = "smallest",
    hash_bits: int = 63,
    trie_bytes: int = TRIE_BYTES,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each row of ``docs``.

    ``docs`` has (doc_id, text).  ``keep`` is ``smallest`` or ``largest``: whose
    row of equal texts stays.  Runs jobs.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    spark, largest = docs.sparkSession, keep == "largest"
    id_type = docs.schema["doc_id"].dataType
    local, merged = _schema(id_type, LOCAL), _schema(id_type, MERGED)

    def written(rows: DataFrame, purpose: str) -> DataFrame:
        path = fresh_path(spark, purpose)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    stored = written(
        docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
            _local(_arrow(local), trie_bytes, hash_bits, largest), local
        ),
        "trie-local",
    )
    terminals = stored.where("kind = 1").select(
        "node", "length", "hash", "sha", "owner", "owner_row", "n", "body"
    )
    met = checkpointed(
        terminals.groupBy("length", "hash").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    )
    wide = F.ceil(F.sqrt("met")).cast("long")
    pending = terminals.drop("sha").join(broadcast_if_short(met), ["length", "hash"]).withColumn(
        "path", F.lit(0).cast("long")
    )
    # terminals of the same text, round by round: (node, into), and the last of them
    rounds: list[DataFrame] = []
    while True:
        whole = F.lit(WHOLE).cast("long")
        if rounds:
            salt = whole
        else:
            salt = F.when(F.col("met") > fan_in, F.pmod(F.xxhash64("node"), wide)).otherwise(whole)
        dealt = pending.withColumn("salt", salt).drop("met")
        keys = ["length", "hash", "salt", "path"]
        done = written(
            dealt.repartition(*keys)
            .sortWithinPartitions(*keys)
            .mapInArrow(_merge(_arrow(merged), trie_bytes, largest), merged),
            "trie-merged",
        )
        rounds.append(done)
        pending = done.where("kind = 1 and body is not null").drop("kind", "into")
        if pending.isEmpty():
            break
    columns = ["owner", "owner_row", "n"]
    groups = None
    for done in reversed(rounds):
        ends = done.where("kind = 1")
        whole = ends.where("body is null").select("node", *columns)
        if groups is not None:
            whole = whole.unionByName(groups)
        went = done.where("kind = 0").select("node", "into")
        moved = went.join(whole.withColumnRenamed("node", "into"), "into").select("node", *columns)
        groups = checkpointed(whole.unionByName(moved))
    found = groups.select("node", *[F.col(c).alias(f"all_{c}") for c in columns])
    joined = terminals.drop("body").join(broadcast_if_short(found), "node", "left")
    owned = joined.select(
        "node", "sha", "n", F.col("owner").alias("own_id"), F.col("owner_row").alias("own_row"),
        *[F.when(F.col("all_n").isNull(), F.col(c)).otherwise(F.col(f"all_{c}")).alias(f"all_{c}")
          for c in columns],
    )
    members = stored.where("kind = 0").select("node", "row", F.col("doc_id").alias("id"))
    alone = owned.where("n = 1").select("*", F.col("own_row").alias("row"), F.col("own_id").alias("id"))
    several = owned.where("n > 1").join(members, "node")
    return alone.unionByName(several).select(
        F.col("id").alias("doc_id"),
        F.col("all_owner").alias("keep_id"),
        F.col("all_n").alias("group_size"),
        (F.col("row") == F.col("all_owner_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
