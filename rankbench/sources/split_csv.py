"""CSV files with quoted newlines, read in blocks by many tasks.

A line of such a file may begin inside a quoted value, so a block of it can't be
read alone.  A doubled quote leaves the number of quotes even, so what tells is
the parity of the quotes before the line.  One scan counts the quotes of each
block; a running sum over blocks gives the parity at each block's first line.
The next scan cuts every block into records where its lines lie.  Only a record
that crosses from one block to the next travels: its pieces are put together by
their order.

Blocks are the splits that Spark makes of a file
(``spark.sql.files.maxPartitionBytes``).
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankbench.operators.joins import broadcast_if_short
from rankbench.session import checkpointed
from rankbench.sources.files import csv_options

QUOTE = '"'
# Kinds of rows that the cutting gives: a record, the rest of one that began in an
# earlier block, the beginning of one that ends in a later block.
WHOLE, REST, BEGINNING = 0, 1, 2
CUT = "kind int, file string, block long, first boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(QUOTE), F.lit("")))


def block_parities(lines: DataFrame) -> DataFrame:
    """(file, block, odd, open): whether quotes are odd before a block, and after it.

    Only a row per block and task is shuffled; the running sum takes the blocks
    of a file, a few numbers each, in one window.
    """
    counted = lines.groupBy("file", "block").agg(F.sum(_quotes(F.col("value"))).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("file").orderBy("block"))
    return counted.select(
        "file", "block", ((upto - F.col("n")) % 2 == 1).alias("odd"), (upto % 2 == 1).alias("open")
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order to records; rows are (value, file, block, odd)."""
    here, parity, held, kind, first = None, 0, [], WHOLE, False

    def rows(kind, records, first):
        n = len(records)
        file, block = here
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, kind, np.int32)),
                pa.array([file] * n, pa.string()),
                pa.array(np.full(n, block, np.int64)),
                pa.array(first, pa.bool_()),
                records if isinstance(records, pa.Array) else pa.array(records, pa.string()),
            ],
            names=["kind", "file", "block", "first", "record"],
        )

    def ended():
        """The open record of a block that is over."""
        if held:
            yield rows(BEGINNING if kind == WHOLE else REST, ["\n".join(held)], [first])

    for batch in batches:
        if not batch.num_rows:
            continue
        value, file, block, odd = (batch.column(c) for c in ("value", "file", "block", "odd"))
        blocks = block.to_numpy()
        codes = file.dictionary_encode().indices.to_numpy()
        change = np.flatnonzero((blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])) + 1
        for start, stop in zip([0, *change], [*change, len(blocks)]):
            spot = (file[int(start)].as_py(), int(blocks[start]))
            at_start = spot != here
            if at_start:
                yield from ended()
                here, held, parity = spot, [], int(odd[int(start)].as_py())
                kind = REST if parity else WHOLE
                first = False
            part = value.slice(start, stop - start)
            quotes = pc.count_substring(part, QUOTE).to_numpy(zero_copy_only=False)
            after = (parity + np.cumsum(quotes)) % 2
            before = np.concatenate([[parity], after[:-1]])
            # the first record of a file is its header
            heads = np.zeros(len(part), bool)
            heads[0] = at_start and spot[1] == 0
            single = (before == 0) & (after == 0)
            if single.any():
                mask = pa.array(single)
                yield rows(WHOLE, part.filter(mask), heads[single])
            for i in np.flatnonzero(~single):
                if before[i] == 0:
                    held, kind, first = [], WHOLE, bool(heads[i])
                held.append(part[int(i)].as_py())
                if after[i] == 0:
                    yield rows(kind, ["\n".join(held)], [first])
                    held = []
            parity = int(after[-1])
    yield from ended()


def _glued(pieces: DataFrame) -> DataFrame:
    """Records that cross blocks, from their pieces; ``pieces`` is materialised."""
    order = Window.partitionBy("file").orderBy("block", "kind")
    # without the texts, so a file's pieces are small
    numbered = pieces.select(
        "file", "block", "kind",
        F.sum((F.col("kind") == BEGINNING).cast("long")).over(order).alias("number"),
    )
    parts = F.sort_array(F.collect_list(F.struct("block", "record")))
    return (
        pieces.join(numbered, ["file", "block", "kind"])
        .groupBy("file", "number")
        .agg(
            F.max("first").alias("first"),
            F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"),
        )
        .select("first", "record")
    )


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows (first, record): every record of the files, those that begin a file marked.

    Runs a job for the quotes of the blocks, and one for the records that cross
    them if there are any.
    """
    lines = _lines(spark, path)
    parities = checkpointed(block_parities(lines))
    known = lines.join(broadcast_if_short(parities), ["file", "block"]).select(
        "value", "file", "block", "odd"
    )
    records = known.mapInArrow(_cut, CUT).where(F.col("kind") == WHOLE).select("first", "record")
    broken = parities.where("odd or open").select("file", "block")
    if not broken.isEmpty():
        touched = known.join(broadcast_if_short(broken), ["file", "block"], "left_semi")
        pieces = touched.mapInArrow(_cut, CUT).where(F.col("kind") != WHOLE)
        records = records.unionByName(_glued(checkpointed(pieces)))
    clean = F.regexp_replace("record", r"\r\z", "")
    clean = F.when(F.col("first"), F.ltrim(clean, F.lit("\ufeff"))).otherwise(clean)
    return records.select("first", clean.alias("record")).where("record != ''")


def read_split_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    columns: Sequence[str] | None = None,
    sep: str = ",",
    header: bool = True,
) -> DataFrame:
    """Rows as ``files.read_csv`` gives them, from files of any size by many tasks.

    Quotes must be balanced, as that format asks: a quote inside a value is
    doubled and the value quoted.  Lines end with a newline, with or without a
    carriage return before it; line ends inside values stay as they are.  A
    quote that is never closed takes in the rest of its file.  Runs the jobs of
    :func:`csv_records`.
    """
    records = csv_records(spark, path)
    if header:
        records = records.where("not first")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = records.select(F.from_csv("record", fields, csv_options(sep)).alias("row"))
    return parsed.select("row.*").select(*(columns or schema.names))
