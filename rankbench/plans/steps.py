"""Steps from one folder of files to another."""

from pyspark.sql import DataFrame, SparkSession

from rankbench import schemas
from rankbench.operators import evaluation, prepare
from rankbench.sources import files

# Names inside a baseline folder.
CORPUS, TOPICS, QRELS = "corpus.csv", "test.queries.csv", "test.qrels.csv"


def write_baseline(corpus, topics, qrels, folder: str) -> None:
    """Corpus (docno, title, text), topics (qid, query) and judgments as files."""
    files.write_csv(corpus, f"{folder}/{CORPUS}", ["docno", "title", "text"])
    files.write_csv(topics, f"{folder}/{TOPICS}", ["qid", "query"])
    files.write_qrels(qrels, f"{folder}/{QRELS}")


def pretokenise_folder(spark: SparkSession, source: str, target: str, n_max: int = 2) -> None:
    """A baseline folder with its texts replaced by their terms; judgments are copied.

    Title and text become one text.  Runs jobs.
    """
    corpus = files.read_csv(spark, f"{source}/{CORPUS}", schemas.CORPUS)
    topics = files.read_csv(spark, f"{source}/{TOPICS}", schemas.TOPICS)
    files.write_csv(
        prepare.pretokenised(corpus, "docno", "text", n_max, title="title"), f"{target}/{CORPUS}"
    )
    files.write_csv(prepare.pretokenised(topics, "qid", "query", n_max), f"{target}/{TOPICS}")
    files.write_qrels(files.read_qrels(spark, f"{source}/{QRELS}"), f"{target}/{QRELS}")


def evaluate_files(
    spark: SparkSession,
    baseline: str,
    run_dir: str | None = None,
    output_dir: str | None = None,
    run_path: str | None = None,
    output_path: str | None = None,
) -> DataFrame:
    """Metrics of a folder of runs, or of one run, against a baseline folder's judgments.

    Give ``run_dir`` and ``output_dir``, or ``run_path`` and ``output_path``; with
    neither pair whole that is a ValueError, and a whole ``run_dir`` pair goes
    first.  Metrics are written, one folder a system, and returned as system,
    metric, value.  Runs jobs.
    """
    if run_dir and output_dir:
        source, target = run_dir, output_dir
    elif run_path and output_path:
        source, target = run_path, output_path
    else:
        raise ValueError("give a folder of runs and one for metrics, or a run and where its metrics go")
    qrels = files.read_qrels(spark, f"{baseline}/{QRELS}")
    scored = evaluation.evaluate(files.read_runs(spark, source), qrels)
    files.write_metrics(evaluation.comparison(scored), target)
    return files.read_metrics(spark, target, evaluation.metric_names())
