"""CSV in blocks: the same rows as the reader that takes whole files."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rankbench.session import fresh_path
from rankbench.sources import files, split_csv

SCHEMA = StructType([StructField(n, StringType()) for n in ("id", "a", "b")])

AWKWARD = (
    'id,a,"b\nhead"\n'
    "1,plain,x\n"
    '2,"two\nlines","say ""hi""\n\n"\n'
    '3,"","\n"\n'
    "4,,\n"
    "\n"
    '5,"a, b","ends with quote"""\n'
    '6,"' + "long line of text\n" * 40 + '",after\n'
    '7,"""\n""","""""\n"\n'
    "8,ünï,日本\n"
    '9,"no end of line","x"'
)


@pytest.fixture
def blocks_of(spark):
    """Sets the block size of scans for a test."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def use(size: int):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield use
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def written(spark, **named) -> str:
    folder = tempfile.mkdtemp(prefix="split-csv-")
    for name, text in named.items():
        with open(os.path.join(folder, f"{name}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return folder


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 7, 64, 300, 1 << 20])
def test_same_rows_whatever_the_blocks(spark, blocks_of, size):
    folder = written(spark, one=AWKWARD, two=AWKWARD + "\n", empty="", header="id,a,b\n")
    whole = rows(files.read_csv(spark, folder, SCHEMA))
    assert len(whole) == 18
    blocks_of(size)
    assert rows(split_csv.read_split_csv(spark, folder, SCHEMA)) == whole


def test_a_large_value_over_many_blocks(spark, blocks_of):
    text = "\n".join(f'say ""{k}"", then' for k in range(2000))
    folder = written(spark, one=f'id,a,b\n1,x,"{text}"\n2,y,z\n')
    blocks_of(500)
    found = split_csv.read_split_csv(spark, folder, SCHEMA, ["id", "b"])
    assert found.columns == ["id", "b"]
    assert rows(found) == [("1", text.replace('""', '"')), ("2", "z")]
    assert split_csv.csv_records(spark, folder).count() == 3


def test_many_tasks_read_one_file(spark, blocks_of, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("docno"), "source", "text"
    )
    path = fresh_path(spark, "one-file")
    files.write_csv(docs.coalesce(1), path)
    schema = StructType([StructField(n, StringType()) for n in ("docno", "source", "text")])
    blocks_of(8000)
    found = split_csv.read_split_csv(spark, path, schema)
    assert found.rdd.getNumPartitions() > 50
    assert found.exceptAll(docs).isEmpty() and docs.exceptAll(found).isEmpty()


@pytest.mark.parametrize("size", [3, 1 << 20])
def test_carriage_returns_mark_separator_and_no_header(spark, blocks_of, size):
    folder = written(spark, one='﻿1;a\rb;"x\r\ny"\r\n2;;""\r\n')
    blocks_of(size)
    found = split_csv.read_split_csv(spark, folder, SCHEMA, sep=";", header=False)
    assert rows(found) == [("1", "a\rb", "x\r\ny"), ("2", None, "")]


def test_files_without_rows(spark):
    folder = written(spark, empty="", header="id,a,b\n")
    assert rows(split_csv.read_split_csv(spark, folder, SCHEMA)) == []


def test_a_broken_row_is_an_error(spark):
    folder = written(spark, one="id,a,b\n1,2,3,4,5\n")
    with pytest.raises(Exception, match="MALFORMED_CSV_RECORD"):
        split_csv.read_split_csv(spark, folder, SCHEMA).collect()
