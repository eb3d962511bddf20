"""The registered queries: one per operator, over whole tables."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from rankbench import schemas
from rankbench.functions import text as tx
from rankbench.functions.hashing import digest
from rankbench.operators import (
    blocks,
    dense,
    diagnostics,
    evaluation,
    lexical,
    lexicon_index,
    losses,
    numbering,
    pairs,
    prepare,
    pruned,
    shift,
)
from rankbench.operators.ranking import TOPK, as_run, rounded, top_k
from rankbench.plans import chains, steps, views
from rankbench.plans.collections import Collection, collection
from rankbench.session import checkpointed, fresh_path
from rankbench.sources import files, split_csv

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def bench(spark: SparkSession, sf_dir: str) -> Collection:
    return collection(spark, sf_dir, "bench")


def chat(spark: SparkSession, sf_dir: str) -> Collection:
    return collection(spark, sf_dir, "chat")


def _long(vectors: DataFrame, key: str, places: int = 6) -> DataFrame:
    return vectors.select(key, F.posexplode("embedding").alias("slot", "x")).withColumn(
        "x", rounded(F.col("x").cast("double"), places) + 0.0
    )


def _ids(column: str):
    return F.array_join(F.col(column).cast("array<string>"), " ").alias(column)


# --- sources and sinks ------------------------------------------------------


def _corpus_csv(spark, sf_dir) -> str:
    path = fresh_path(spark, "corpus-csv")
    files.write_csv(bench(spark, sf_dir).corpus, path)
    return path


@query
def io_csv_roundtrip(spark, sf_dir):
    return files.read_csv(spark, _corpus_csv(spark, sf_dir), schemas.CORPUS)


@query
def io_csv_split(spark, sf_dir):
    return split_csv.read_split_csv(spark, _corpus_csv(spark, sf_dir), schemas.CORPUS)


@query
def io_csv_columns(spark, sf_dir):
    return files.read_csv(spark, _corpus_csv(spark, sf_dir), schemas.CORPUS, ["docno", "text"])


@query
def io_transform_rename(spark, sf_dir):
    rows = files.read_csv(spark, _corpus_csv(spark, sf_dir), schemas.CORPUS)
    return files.computed(
        rows,
        {
            "text": lambda: tx.joined(tx.terms(F.col("text"))),
            "n_terms": lambda: F.size(tx.split_on_space(F.col("text"))),
        },
        {"docno": "doc_key"},
    )


@query
def io_ndjson_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "topics-ndjson")
    files.write_ndjson(chat(spark, sf_dir).topics, path, ["qid", "query"])
    return files.read_ndjson(spark, path, schemas.TOPICS)


@query
def io_qrels_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "qrels")
    files.write_qrels(chat(spark, sf_dir).qrels, path)
    return files.read_qrels(spark, path)


@query
def io_run_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "run")
    c = bench(spark, sf_dir)
    files.write_runs(as_run(lexical.retrieve(c.topics, c.index), "bm25"), path)
    return files.read_runs(spark, path)


def _lexical_runs(c: Collection) -> DataFrame:
    both = {"bm25": lexical.bm25_weights(), "tfidf": lexical.tfidf_weights()}
    return lexical.retrieve_many(c.topics, c.index, both).unionByName(
        as_run(lexical.retrieve(c.topics, c.bigram_index), "bm25_ng2")
    )


@query
def io_run_directory(spark, sf_dir):
    path = fresh_path(spark, "runs")
    files.write_runs(_lexical_runs(chat(spark, sf_dir)), path)
    return files.read_runs(spark, path)


# --- preparation ------------------------------------------------------------


@query
def prep_corpus(spark, sf_dir):
    return prepare.prepare_corpus(views.raw_corpus(spark, sf_dir))


@query
def prep_topics(spark, sf_dir):
    return prepare.prepare_topics(views.raw_queries(spark, sf_dir))


@query
def prep_qrels(spark, sf_dir):
    return prepare.prepare_qrels(views.raw_qrels(spark, sf_dir))


@query
def prep_triples(spark, sf_dir):
    return prepare.prepare_triples(views.raw_triplets(spark, sf_dir))


@query
def prep_counts(spark, sf_dir):
    return prepare.table_sizes(
        corpus=prep_corpus(spark, sf_dir),
        triplets=prep_triples(spark, sf_dir),
        queries=prep_topics(spark, sf_dir),
        qrels=prep_qrels(spark, sf_dir),
    )


@query
def prep_pretokenize(spark, sf_dir):
    c = bench(spark, sf_dir)
    texts = prepare.pretokenised(c.corpus, "docno", "text", 2, title="title")
    topics = prepare.pretokenised(c.topics, "qid", "query", 2)
    return texts.select(F.lit("corpus").alias("kind"), F.col("docno").alias("id"), "text").unionByName(
        topics.select(
            F.lit("query").alias("kind"), F.col("qid").alias("id"), F.col("query").alias("text")
        )
    )


@query
def step_pretokenize(spark, sf_dir):
    """Files in, files out: terms of corpus and topics, and the judgments beside them."""
    c = chat(spark, sf_dir)
    source, target = fresh_path(spark, "baseline"), fresh_path(spark, "pretokenised")
    steps.write_baseline(c.corpus, c.topics, c.qrels, source)
    steps.pretokenise_folder(spark, source, target)
    texts = files.read_csv(spark, f"{target}/{steps.CORPUS}", StructType([schemas.CORPUS["docno"], schemas.CORPUS["text"]]))
    topics = files.read_csv(spark, f"{target}/{steps.TOPICS}", schemas.TOPICS)
    qrels = files.read_qrels(spark, f"{target}/{steps.QRELS}")
    judged = F.concat_ws(" ", "iter", "docno", F.col("label").cast("string"))
    return (
        texts.select(F.lit("corpus").alias("kind"), F.col("docno").alias("id"), "text")
        .unionByName(topics.select(F.lit("query").alias("kind"), F.col("qid").alias("id"), F.col("query").alias("text")))
        .unionByName(qrels.select(F.lit("qrels").alias("kind"), F.col("qid").alias("id"), judged.alias("text")))
    )


@query
def prep_join_title(spark, sf_dir):
    title, text = F.col("title"), F.col("text")
    return bench(spark, sf_dir).corpus.select(
        "docno",
        tx.titled(title, text, "space").alias("with_space"),
        tx.titled(title, text, "concat").alias("plain"),
        tx.joined(tx.titled(title, text, "tokens", 2)).alias("tokens"),
    )


@query
def prep_shuffle(spark, sf_dir):
    docs = bench(spark, sf_dir).corpus.select("docno")
    return numbering.number_by_digest(docs, digest(42, F.col("docno")), "position")


@query
def prep_train_eval_split(spark, sf_dir):
    return prepare.split_exact(bench(spark, sf_dir).corpus, "docno", 0.1).select(
        "docno", F.length("text").alias("chars"), "part"
    )


@query
def prep_train_eval_share(spark, sf_dir):
    return prepare.split_by_share(bench(spark, sf_dir).corpus, "docno", 0.1).select("docno", "part")


@query
def prep_pairs(spark, sf_dir):
    return prepare.labelled_pairs(views.triples(spark, sf_dir))


# --- text functions ---------------------------------------------------------


@query
def text_tokenize(spark, sf_dir):
    found = tx.words(F.col("text"))
    return bench(spark, sf_dir).corpus.select(
        "docno", tx.joined(found).alias("tokens"), F.size(found).alias("n")
    )


@query
def text_ngrams(spark, sf_dir):
    found = tx.terms(F.col("text"), 3)
    return bench(spark, sf_dir).corpus.select(
        "docno", tx.joined(found).alias("terms"), F.size(found).alias("n")
    )


@query
def text_jaccard(spark, sf_dir):
    return bench(spark, sf_dir).corpus.select(
        "docno", rounded(tx.jaccard(F.col("title"), F.col("text"))).alias("jaccard")
    )


@F.pandas_udf(ArrayType(StringType()))
def _split_udf(text: pd.Series) -> pd.Series:
    return text.str.split()


@query
def udf_custom_tokenizer(spark, sf_dir):
    found = tx.terms(F.col("text"), 2, tokenizer=_split_udf)
    return bench(spark, sf_dir).corpus.select("docno", tx.joined(found).alias("terms"))


# --- lexical index ----------------------------------------------------------


@query
def index_postings(spark, sf_dir):
    return bench(spark, sf_dir).write_index().postings


@query
def index_postings_ng2(spark, sf_dir):
    return bench(spark, sf_dir).bigram_index.postings


@query
def index_doclen(spark, sf_dir):
    return bench(spark, sf_dir).index.doclen


@query
def index_lexicon(spark, sf_dir):
    return bench(spark, sf_dir).index.lexicon


@query
def index_stats(spark, sf_dir):
    return bench(spark, sf_dir).index.stats.withColumn("avgdl", rounded(F.col("avgdl")))


@query
def index_term_sample(spark, sf_dir):
    return lexicon_index.sample_terms(bench(spark, sf_dir).index.lexicon)


@query
def index_docstore(spark, sf_dir):
    # the one table whose limits are its feature
    return lexicon_index.document_store(
        bench(spark, sf_dir).corpus, max_stored=tx.MAX_STORED_CHARS, max_term=tx.MAX_TERM_CHARS
    ).select("docno", "text_raw", "text_tok")


@query
def index_long_docno(spark, sf_dir):
    """Ids that differ only after a long shared prefix, through index and reranking."""
    c = bench(spark, sf_dir)
    prefix = F.lit("https://archive.example.org/collection/volume/document/")
    long = c.corpus.withColumn("docno", F.concat(prefix, "docno"))
    index = lexicon_index.write_index(long, fresh_path(spark, "long-docno-index"))
    return chains.bm25_pair(c.topics, index)


# --- retrieval --------------------------------------------------------------


@query
def retrieve_bm25(spark, sf_dir):
    c = bench(spark, sf_dir)
    return lexical.retrieve(c.topics, c.index)


@query
def index_impacts(spark, sf_dir):
    """The best block of every term in the layout by term."""
    found = bench(spark, sf_dir).impacts.blocks.where("block = 0")
    return found.select(
        "term", F.size("docnos").alias("n"), rounded(F.col("top")).alias("top"),
        F.array_join("docnos", " ").alias("docnos"),
    )


@query
def retrieve_bm25_pruned(spark, sf_dir):
    c = bench(spark, sf_dir)
    return pruned.retrieve_pruned(c.topics, c.impacts)


@query
def retrieve_bm25_ng2(spark, sf_dir):
    c = bench(spark, sf_dir)
    return lexical.retrieve(c.topics, c.bigram_index)


@query
def retrieve_tfidf(spark, sf_dir):
    c = bench(spark, sf_dir)
    return lexical.retrieve(c.topics, c.index, lexical.tfidf_weights())


@query
def retrieve_dense(spark, sf_dir):
    vectors = views.vectors(spark, sf_dir).drop("label")
    return dense.retrieve_dense(views.class_topics(spark, sf_dir), vectors)


@query
def retrieve_dense_text(spark, sf_dir):
    c = bench(spark, sf_dir)
    return dense.retrieve_dense(c.topic_vectors, c.vectors)


@query
def retrieve_pairscore_exhaustive(spark, sf_dir):
    c = bench(spark, sf_dir)
    return pairs.retrieve_pairs(c.topics, c.corpus, rank_base=0)


@query
def score_okapi_pairs(spark, sf_dir):
    return diagnostics.okapi_scores(views.triples(spark, sf_dir)).select(
        "triple_id", "side", "score"
    )


def _sides(spark, sf_dir) -> DataFrame:
    return diagnostics.pair_sides(views.triples(spark, sf_dir))


@query
def score_pairs(spark, sf_dir):
    return pairs.score_pairs(_sides(spark, sf_dir)).select("pair_id", "score")


def _overlap_model():
    def predict(query: pd.Series, text: pd.Series) -> np.ndarray:
        out = np.zeros(len(query))
        for i, (a, b) in enumerate(zip(query, text)):
            left, right = set(a.split()), set(b.split())
            out[i] = len(left & right) / max(len(left | right), 1)
        return out

    return predict


@query
def udf_pair_scorer(spark, sf_dir):
    scorer = pairs.batch_scorer(_overlap_model)
    return pairs.score_pairs(_sides(spark, sf_dir), scorer).select("pair_id", "score")


@query
def train_pair_scorer(spark, sf_dir):
    triples = views.triples(spark, sf_dir)
    columns = ["jaccard", "coverage", "length_ratio", "okapi", "cosine"]
    okapi = diagnostics.okapi_scores(triples).select(
        "pair_id", F.col("score").alias("okapi")
    )
    sides = pairs.with_pair_features(_sides(spark, sf_dir)).withColumn(
        "label", (F.col("side") == "positive").cast("int")
    )
    vectors = _pair_vectors(spark, sf_dir).select(
        "pair_id", dense.cosine(F.col("left"), F.col("right")).alias("cosine")
    )
    features = (
        sides.join(okapi, "pair_id").join(vectors, "pair_id").select("pair_id", "label", *columns)
    )
    stored = fresh_path(spark, "pair-features")
    features.write.parquet(stored)
    features = spark.read.parquet(stored)
    model = pairs.train_pair_scorer(features, columns)
    return pairs.apply_pair_model(model, features).select("pair_id", "label", "score")


def _pair_vectors(spark, sf_dir) -> DataFrame:
    """Unit vectors of both sides of every labelled pair."""
    sides = _sides(spark, sf_dir)
    index = chat(spark, sf_dir).index
    left = dense.encode_texts(sides, index, "pair_id", "query").select(
        "pair_id", F.col("embedding").alias("left")
    )
    right = dense.encode_texts(sides, index, "pair_id", "text").select(
        "pair_id", F.col("embedding").alias("right")
    )
    return left.join(right, "pair_id").withColumn(
        "label", F.endswith(F.col("pair_id"), F.lit("positive")).cast("int")
    )


# --- vectors ----------------------------------------------------------------


@query
def dense_index(spark, sf_dir):
    stored = dense.write_vectors(views.vectors(spark, sf_dir), fresh_path(spark, "vectors"))
    return _long(stored, "docno", 5)


@query
def dense_encode(spark, sf_dir):
    return _long(dense.encode_documents(bench(spark, sf_dir).index), "docno")


@query
def dense_encode_queries(spark, sf_dir):
    c = bench(spark, sf_dir)
    return _long(dense.encode_texts(c.topics, c.index), "qid")


@query
def dense_normalize(spark, sf_dir):
    c = chat(spark, sf_dir)
    raw = dense.encode_documents(c.index, normalize=False)
    return _long(dense.normalized(raw), "docno")


# --- ranking and joins ------------------------------------------------------


@query
def topk_per_query(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select(
        F.col("source").alias("qid"), F.col("doc_id").cast("string").alias("docno"),
        F.col("n_chars").alias("score"),
    )
    return top_k(docs)


@query
def topk_rank_base0(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("qid"), F.col("doc_id").cast("string").alias("docno"),
        F.col("n_chars").alias("score"),
    )
    return top_k(docs, rank_base=0)


@query
def join_run_text(spark, sf_dir):
    c = bench(spark, sf_dir)
    run = checkpointed(lexical.retrieve(c.topics, c.index))
    return chains.chain(run, chains.with_corpus_text(c.corpus)).select(
        "qid", "docno", "rank", "text"
    )


@query
def join_run_docstore(spark, sf_dir):
    c = bench(spark, sf_dir)
    run = checkpointed(lexical.retrieve(c.topics, c.index))
    return chains.chain(run, chains.with_index_text(c.index, "text_tok")).select(
        "qid", "docno", "rank", "text"
    )


# --- reranking --------------------------------------------------------------


@query
def rerank_bm25_dense(spark, sf_dir):
    c = bench(spark, sf_dir)
    return chains.bm25_dense(c.topics, c.index, c.topic_vectors, c.vectors)


@query
def rerank_bm25_pair(spark, sf_dir):
    c = bench(spark, sf_dir)
    return chains.bm25_pair(c.topics, c.index)


@query
def rerank_bm25_pair_pretokenised(spark, sf_dir):
    c = bench(spark, sf_dir)
    return chains.bm25_pair_pretokenised(c.topics, c.bigram_index)


@query
def rerank_dense_pair(spark, sf_dir):
    c = bench(spark, sf_dir)
    return chains.dense_pair(c.topics, c.corpus, c.topic_vectors, c.vectors)


def _matrix(c: Collection) -> DataFrame:
    return chains.run_matrix(
        c.topics, c.corpus, c.index, c.bigram_index, c.topic_vectors, c.vectors
    )


@query
def run_matrix(spark, sf_dir):
    return _matrix(chat(spark, sf_dir))


# --- evaluation -------------------------------------------------------------


def _judged(spark, sf_dir) -> DataFrame:
    c = chat(spark, sf_dir)
    run = as_run(lexical.retrieve(c.topics, c.index), "bm25")
    return evaluation.per_judged_query(run, c.qrels)


def _metric(df: DataFrame, name: str, alias: str):
    return df.select(
        "qid",
        *[rounded(F.col(f"`{name}@{k}`")).alias(f"{alias}_{k}") for k in evaluation.CUTOFFS],
    )


@query
def eval_ndcg(spark, sf_dir):
    return _metric(_judged(spark, sf_dir), "nDCG", "ndcg")


@query
def eval_recall(spark, sf_dir):
    return _metric(_judged(spark, sf_dir), "R", "recall")


@query
def eval_mrr(spark, sf_dir):
    return _judged(spark, sf_dir).select("qid", rounded(F.col("`MRR@10`")).alias("mrr_10"))


@query
def eval_run(spark, sf_dir):
    c = bench(spark, sf_dir)
    run = as_run(lexical.retrieve(c.topics, c.index), "bm25")
    return evaluation.evaluate(run, c.qrels)


@query
def eval_dense(spark, sf_dir):
    run = as_run(retrieve_dense(spark, sf_dir), "dense")
    return evaluation.evaluate(run, views.class_qrels(spark, sf_dir))


@query
def eval_all_runs(spark, sf_dir):
    c = chat(spark, sf_dir)
    runs, metrics = fresh_path(spark, "runs"), fresh_path(spark, "metrics")
    files.write_runs(_lexical_runs(c), runs)
    scored = evaluation.evaluate(files.read_runs(spark, runs), c.qrels)
    files.write_metrics(evaluation.comparison(scored), metrics)
    return files.read_metrics(spark, metrics, evaluation.metric_names())


@query
def eval_single_run(spark, sf_dir):
    """One run out of a folder of runs, files in and files out."""
    c = chat(spark, sf_dir)
    runs, baseline, metrics = (fresh_path(spark, p) for p in ("runs", "baseline", "metrics"))
    files.write_runs(_lexical_runs(c), runs)
    files.write_qrels(c.qrels, f"{baseline}/{steps.QRELS}")
    return steps.evaluate_files(
        spark, baseline, run_path=f"{runs}/system=tfidf", output_path=metrics
    )


@query
def eval_missing_queries(spark, sf_dir):
    c = bench(spark, sf_dir)
    strong = lexical.retrieve(c.topics, c.index).where(F.col("score") > 100)
    return evaluation.missing_queries(strong, c.qrels)


@query
def eval_comparison(spark, sf_dir):
    c = chat(spark, sf_dir)
    stored = fresh_path(spark, "matrix")
    files.write_runs(_matrix(c), stored)
    table = evaluation.comparison(evaluation.evaluate(files.read_runs(spark, stored), c.qrels))
    return table.select(
        "system",
        *[
            F.col(f"`{n}`").alias(n.replace("@", "_").lower())
            for n in evaluation.metric_names()
        ],
    )


# --- diagnostics ------------------------------------------------------------


@query
def diag_bad_triples(spark, sf_dir):
    return diagnostics.bad_triples(views.triples(spark, sf_dir))


@query
def diag_jaccard(spark, sf_dir):
    return diagnostics.jaccard_summary(views.triples(spark, sf_dir))


@query
def diag_contradiction(spark, sf_dir):
    return diagnostics.contradictions(views.triples(spark, sf_dir))


def _lengths(spark, sf_dir) -> DataFrame:
    return diagnostics.length_groups(views.triples(spark, sf_dir), bench(spark, sf_dir).corpus)


@query
def diag_length_groups(spark, sf_dir):
    return diagnostics.length_counts(_lengths(spark, sf_dir))


@query
def diag_length_stats(spark, sf_dir):
    return diagnostics.length_summary(_lengths(spark, sf_dir))


@query
def diag_length_p95(spark, sf_dir):
    return diagnostics.length_p95(_lengths(spark, sf_dir)).withColumn("p95", rounded(F.col("p95")))


@query
def diag_length_ood(spark, sf_dir):
    return diagnostics.out_of_range_share(_lengths(spark, sf_dir)).withColumn(
        "p95", rounded(F.col("p95"))
    )


@query
def diag_length_density(spark, sf_dir):
    return diagnostics.length_density(_lengths(spark, sf_dir))


@query
def diag_query_overlap(spark, sf_dir):
    return shift.shared_texts(*views.shift_by_label(spark, sf_dir))


@query
def diag_shift_dataset(spark, sf_dir):
    return shift.domain_totals(shift.domain_rows(*views.shift_by_language(spark, sf_dir)))


@query
def diag_shift_vocab(spark, sf_dir):
    return shift.vocabulary(shift.domain_rows(*views.shift_by_language(spark, sf_dir)))


@query
def diag_shift_folds(spark, sf_dir):
    return shift.folds(
        shift.domain_rows(*views.shift_by_language(spark, sf_dir)).select("id", "domain")
    )


@query
def diag_shift_auc(spark, sf_dir):
    return shift.cross_validated(shift.domain_rows(*views.shift_by_language(spark, sf_dir)))


@query
def diag_shift_features(spark, sf_dir):
    return shift.telling_features(shift.domain_rows(*views.shift_by_language(spark, sf_dir)))


@query
def metric_auc(spark, sf_dir):
    labels = views.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    sizes = views.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score"))
    return shift.auc(labels.join(sizes, "doc_id"))


# --- masked-word data and losses ---------------------------------------------


@query
def lm_token_ids(spark, sf_dir):
    corpus = bench(spark, sf_dir).corpus
    found = blocks.token_ids(corpus, blocks.word_ids(corpus))
    return found.select("docno", F.size("ids").alias("n"), _ids("ids"))


@query
def lm_subword_ids(spark, sf_dir):
    """Ids of a public tokenizer, packed to blocks as words are."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = blocks.batched(bench(spark, sf_dir).corpus)
    found = blocks.subword_ids(docs, path, ["batch", "docno"])
    return blocks.packed(found).select("batch", "block", _ids("input_ids"))


def _packed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    corpus = bench(spark, sf_dir).corpus
    vocabulary = blocks.word_ids(corpus)
    found = blocks.token_ids(blocks.batched(corpus), vocabulary, ["batch", "docno"])
    return blocks.packed(found), vocabulary


@query
def lm_pack_blocks(spark, sf_dir):
    return _packed(spark, sf_dir)[0].select("batch", "block", _ids("input_ids"))


@query
def lm_mask(spark, sf_dir):
    packed, vocabulary = _packed(spark, sf_dir)
    size = vocabulary.agg(F.count(F.lit(1))).scalar()
    return blocks.masked(packed, size).select("batch", "block", _ids("input_ids"), _ids("labels"))


@query
def loss_contrastive(spark, sf_dir):
    return losses.contrastive(_pair_vectors(spark, sf_dir))


@query
def loss_bce(spark, sf_dir):
    scored = pairs.with_pair_features(_sides(spark, sf_dir)).select(
        pairs.fixed_weight_logit().alias("score"),
        (F.col("side") == "positive").cast("int").alias("label"),
    )
    return losses.binary_cross_entropy(scored)
