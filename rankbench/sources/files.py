"""CSV, NDJSON, judgments and runs as files."""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankbench.schemas import QRELS

# Stands for an unquoted blank field while a file is parsed, so that a quoted
# empty string is told from it; it is never written.
_BLANK = "\u0001blank"
# The score of a run row that has none: below all others.
_NO_SCORE = "-inf"


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    columns: Sequence[str] | None = None,
    sep: str = ",",
    header: bool = True,
) -> DataFrame:
    """Declared-schema CSV scan; quoted newlines and doubled quotes are kept.

    A blank field is null, a quoted empty one the empty string.
    Each file is read by one task, which suits folders of many files, as
    :func:`write_csv` leaves them; ``split_csv`` reads large files in blocks.
    """
    df = spark.read.schema(schema).options(header=header, **csv_options(sep)).csv(path)
    return df.select(*columns) if columns else df


def csv_options(sep: str = ",") -> dict[str, str]:
    """Options of the format that every reader shares."""
    return {
        "sep": sep,
        "multiLine": "true",
        "quote": '"',
        "escape": '"',
        "encoding": "UTF-8",
        "nullValue": _BLANK,
        "mode": "FAILFAST",
    }


def write_csv(
    df: DataFrame,
    path: str,
    columns: Sequence[str] = (),
    sep: str = ",",
    header: bool = True,
) -> None:
    """Chosen columns as a folder of CSV files, replacing what is there.

    Null is left blank and the empty string quoted.  A row of nothing but nulls
    in a single column would be a blank line, which readers skip.
    """
    (
        df.select(*(columns or df.columns))
        .write.mode("overwrite")
        .option("header", header)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_ndjson(df: DataFrame, path: str, columns: Sequence[str] = ()) -> None:
    df.select(*(columns or df.columns)).write.mode("overwrite").json(path)


def read_ndjson(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def computed(
    df: DataFrame,
    transformer: Mapping[str, Callable[[], Column]] | None = None,
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Columns computed one after another, then renamed.

    Each builder sees the values earlier builders have put in place.
    """
    for name, build in (transformer or {}).items():
        df = df.withColumn(name, build())
    return df.withColumnsRenamed(dict(rename or {}))


def write_qrels(qrels: DataFrame, path: str) -> None:
    """Tab-separated judgments without a header."""
    write_csv(qrels, path, ["qid", "iter", "docno", "label"], sep="\t", header=False)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Four fields separated by any white space."""
    part = F.split(F.trim("value"), r"\s+")
    return (
        spark.read.text(path)
        .where(F.trim("value") != "")
        .select(
            *[
                part[i].cast(field.dataType).alias(field.name)
                for i, field in enumerate(QRELS.fields)
            ]
        )
    )


def write_runs(runs: DataFrame, folder: str, tag: str | None = None) -> None:
    """One folder of run lines per system: ``qid Q0 docno rank score tag``.

    A null score is written as the lowest one and read back as null.
    """
    line = F.concat_ws(
        " ", "qid", F.lit("Q0"), "docno", F.col("rank").cast("string"),
        F.coalesce(F.col("score").cast("string"), F.lit(_NO_SCORE)), F.lit(tag) if tag else F.col("system"),
    )
    runs.select("system", line.alias("value")).write.mode("overwrite").partitionBy(
        "system"
    ).text(folder)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run below a folder in one scan.

    The system is the stem of a ``*.trec`` file or folder, or the value of a
    ``system=`` folder.
    """
    path = F.col("_metadata.file_path")
    # looked for in few paths only: the expression tries every place of a path
    stem = F.when(F.contains(path, F.lit(".trec")), F.regexp_extract(path, r"([^/]+)\.trec(?:/|$)", 1))
    folder_value = F.regexp_extract(path, r"/system=([^/]+)/", 1)
    part = F.split(F.trim("value"), r"\s+")
    return (
        spark.read.option("recursiveFileLookup", True).text(folder)
        .where(F.trim("value") != "")
        .select(
            F.url_decode(
                F.coalesce(F.nullif(stem, F.lit("")), F.nullif(folder_value, F.lit("")))
            ).alias("system"),
            part[0].alias("qid"),
            part[2].alias("docno"),
            part[3].cast("int").alias("rank"),
            F.when(part[4] != _NO_SCORE, part[4].cast("double")).alias("score"),
        )
    )


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """One folder per system, metrics as the columns of one row."""
    names = [c for c in metrics.columns if c != "system"]
    metrics.select("system", *[F.col(f"`{n}`") for n in names]).write.mode(
        "overwrite"
    ).partitionBy("system").option("header", True).csv(folder)


def read_metrics(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """Metric files of every system below a folder: system, metric, value."""
    fields = ", ".join(f"`{n}` double" for n in names)
    wide = (
        spark.read.schema(f"{fields}, system string").option("header", True).csv(folder)
    )
    return wide.unpivot("system", [F.col(f"`{n}`") for n in names], "metric", "value")
