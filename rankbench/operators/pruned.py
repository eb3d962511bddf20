"""Term-pruned retrieval: postings laid out by term, in blocks that tell their best impact.

The index keeps postings by docno, which makes scoring local but reads all of
them.  This second layout is for topic sets that know few of the terms:

* Postings of a term are ordered by impact (the document side of the weighting
  it is built for) and cut into blocks of 128 with their largest impact beside
  them.  Blocks lie in folders by a hash of the term and by tier: a term's first
  block, the next three, the next twelve and so on.
* Retrieval reads the folders of its terms only (a filter on the partition column).
  The first tier gives each query a bar: its k-th best document has that score
  at least.  With the query's terms in the order of the most they can give, a
  block yields candidates only if its best, with the most of all terms before
  it, reaches the bar: a document of the top k that has none of the later terms
  is there, and any other comes from a later term's blocks.
* Candidates that can't reach the bar, nor the k-th best sum over the blocks that
  yield them, go.  The blocks that yield none are asked
  for the rest of the candidates' scores alone, so their other postings are
  neither grouped nor shuffled.

No document of the top k is left out, so the rows are those of
:func:`lexical.retrieve`.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankbench.operators import lexical
from rankbench.operators.joins import broadcast_if_short
from rankbench.operators.lexicon_index import LexicalIndex
from rankbench.operators.numbering import ordered_sums
from rankbench.operators.ranking import PLACES, TOPK, rounded, top_k
from rankbench.session import checkpointed, task_count

BLOCK = 128
# Blocks of one term that one task writes.
TASK_BLOCKS = 4096
# Postings that one task ranks; a term that has more is ranked by many tasks.
TASK_POSTINGS = 500_000
# Folders up to this many are named in a scan's filter; a topic set that needs
# more reads them all.
NAMED_FOLDERS = 4096
# Bytes of one posting in this layout, roughly.
POSTING_BYTES = 24
BYTES_PER_FOLDER = 128 * 1024 * 1024
# Scores are compared after rounding, so a bound must be this far below to skip.
SLACK = 2 * 10.0**-PLACES


@dataclass(frozen=True)
class ImpactIndex:
    """``blocks``: term, block, top, docnos, tfs, dls, folder, tier; ``terms``: term, df, top, folder."""

    blocks: DataFrame
    terms: DataFrame
    index: LexicalIndex
    weights: tuple
    folders: int


def folder_of(term: str, folders: int) -> Column:
    """Folder of a term, by the hash that a shuffle by term uses.

    So a shuffle to a multiple of ``folders`` tasks gives each the terms of one folder.
    """
    return F.pmod(F.hash(term), F.lit(folders)).cast("int")


def tier_of(block: str) -> Column:
    """0 for the first block, 1 for the next three, 2 for the next twelve and so on."""
    digits = F.length(F.bin(block))
    return F.when(F.col(block) == 0, F.lit(0)).otherwise(F.ceil(digits / 2)).cast("int")


def _ranked_by_sort(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of few long terms (term, df) with their place in their term, by a range sort.

    A term of any frequency is ranked by many tasks.  Runs jobs.
    """
    ones = postings.withColumn("one", F.lit(1).cast("long"))
    summed = ordered_sums(ones, ["term", "below", "docno"], {"upto": "one"}).drop("one")
    before = ordered_sums(terms, ["term"], {"upto": "df"})
    starts = checkpointed(before.select("term", (F.col("upto") - F.col("df")).alias("start")))
    ranked = summed.join(broadcast_if_short(starts), "term")
    return ranked.withColumn("place", F.col("upto") - F.col("start") - 1).drop("upto", "start")


def _in_blocks(ranked: DataFrame, block: int) -> DataFrame:
    """term, block, entries: ``block`` postings by falling impact."""
    entries = F.sort_array(F.collect_list(F.struct("below", "docno", "tf", "dl")))
    return (
        ranked.withColumn("block", F.floor(F.col("place") / block))
        .groupBy("term", "block")
        .agg(entries.alias("entries"))
    )


def _blocks(
    index: LexicalIndex, impact: Column, block: int, task_postings: int, folders: int
) -> tuple[DataFrame, DataFrame | None]:
    """Blocks of the short terms, and of the long ones if there are any.  Runs jobs."""
    postings = index.postings.select("term", "docno", "tf", "dl")
    n_postings = index.stats.select("n_postings").first()[0] or 0
    parts = max(task_count(postings.sparkSession), -(-n_postings // task_postings))
    parts = -(-parts // folders) * folders
    long = checkpointed(index.lexicon.where(F.col("df") > task_postings).select("term", "df"))
    short = postings
    if not long.isEmpty():
        names = broadcast_if_short(long.select("term"))
        short = postings.join(names, "term", "left_anti")
    # impacts are worked out after the shuffle: a posting travels without them
    scored = short.repartition(parts, "term").withColumn("below", -impact)
    place = F.row_number().over(Window.partitionBy("term").orderBy("below", "docno")) - 1
    blocks = _in_blocks(scored.withColumn("place", place), block)
    if long.isEmpty():
        return blocks, None
    scored = postings.join(names, "term", "left_semi").withColumn("below", -impact)
    return blocks, _in_blocks(_ranked_by_sort(scored, long), block)


def blocks_by_term(
    index: LexicalIndex, impact: Column, block: int = BLOCK, task_postings: int = TASK_POSTINGS
) -> DataFrame:
    """term, block, entries: the postings of each term by falling impact.

    Terms of up to ``task_postings`` postings are shuffled once, by term, and ranked
    and cut into blocks where they come to lie.  The others, at most one for each
    ``task_postings`` of all, are ranked by a range sort.  Runs jobs.
    """
    short, long = _blocks(index, impact, block, task_postings, 1)
    return short if long is None else short.unionByName(long)


def blocks_by_folder(
    index: LexicalIndex,
    impact: Column,
    folders: int,
    block: int = BLOCK,
    task_postings: int = TASK_POSTINGS,
) -> DataFrame:
    """The blocks of :func:`blocks_by_term` as they are stored, dealt and sorted by folder and tier.

    A task that ranks short terms has those of one folder, so their blocks are not
    shuffled again; those of the long terms are.  Runs jobs.
    """

    def stored(blocks: DataFrame) -> DataFrame:
        return blocks.select(
            folder_of("term", folders).alias("folder"),
            tier_of("block").alias("tier"),
            "term",
            "block",
            (-F.element_at("entries", 1)["below"]).alias("top"),
            F.col("entries.docno").alias("docnos"),
            F.col("entries.tf").alias("tfs"),
            F.col("entries.dl").alias("dls"),
        )

    short, long = _blocks(index, impact, block, task_postings, folders)
    blocks = stored(short)
    if long is not None:
        many = F.floor(F.col("block") / TASK_BLOCKS)
        blocks = blocks.unionByName(stored(long).repartition("folder", "tier", many))
    return blocks.sortWithinPartitions("folder", "tier", "term", "block")


def write_impacts(
    index: LexicalIndex,
    location: str,
    weights=None,
    block: int = BLOCK,
    folders: int | None = None,
    task_postings: int = TASK_POSTINGS,
) -> ImpactIndex:
    """Write the layout below ``location``, replacing what is there, and open it.

    The postings are shuffled once, by term.  ``weights`` must be those that retrieval uses.  Runs jobs.
    """
    spark = index.postings.sparkSession
    weights = weights or lexical.bm25_weights()
    figures = index.stats.select("avgdl", "n_postings").first()
    if folders is None:
        n_bytes = (figures["n_postings"] or 0) * POSTING_BYTES
        folders = max(task_count(spark), -(-n_bytes // BYTES_PER_FOLDER))
    impact = weights[1](F.lit(figures["avgdl"]))
    (
        blocks_by_folder(index, impact, folders, block, task_postings)
        .write.mode("overwrite")
        .partitionBy("folder", "tier")
        .parquet(f"{location}/blocks")
    )
    stored = _open_blocks(spark, location)
    (
        stored.where("tier = 0")
        .select("folder", "term", "top")
        .join(index.lexicon.select("term", "df"), "term")
        .select("folder", "term", "df", "top")
        .repartition("folder")
        .sortWithinPartitions("folder", "term")
        .write.mode("overwrite")
        .partitionBy("folder")
        .parquet(f"{location}/terms")
    )
    layout = spark.range(1).select(F.lit(folders).cast("int").alias("folders"))
    layout.write.mode("overwrite").parquet(f"{location}/layout")
    return open_impacts(spark, location, index, weights)


BLOCKS = (
    "term string, block long, top double, docnos array<string>, tfs array<int>, dls array<int>, "
    "folder int, tier int"
)


def _open_blocks(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{location}/blocks")


def open_impacts(
    spark: SparkSession, location: str, index: LexicalIndex, weights=None
) -> ImpactIndex:
    """Open a written layout of ``index``; reads its one-row description."""
    terms = spark.read.schema("term string, df long, top double, folder int").parquet(
        f"{location}/terms"
    )
    folders = spark.read.parquet(f"{location}/layout").first()["folders"]
    weights = weights or lexical.bm25_weights()
    return ImpactIndex(_open_blocks(spark, location), terms, index, weights, folders)


def _postings(blocks: DataFrame, *columns: str) -> DataFrame:
    """A row (..., docno, tf, dl) for each posting of the blocks."""
    return blocks.select(
        *columns, F.inline(F.arrays_zip("docnos", "tfs", "dls"))
    ).withColumnsRenamed({"docnos": "docno", "tfs": "tf", "dls": "dl"})


def _met(stored: DataFrame, wanted: DataFrame, keys: list[str], small: bool | None = None) -> DataFrame:
    """Stored rows joined to a materialised table of what is wanted of them.

    The folders and tiers that the table names, if they are not too many, are all
    that is read; asking for them runs a job each.
    """
    for name in ("folder", "tier"):
        if name in keys:
            found = wanted.select(name).distinct().limit(NAMED_FOLDERS + 1).collect()
            if len(found) <= NAMED_FOLDERS:
                stored = stored.where(F.col(name).isin(sorted(r[name] for r in found)))
    if small is None:
        return stored.join(broadcast_if_short(wanted), keys)
    return stored.join(F.broadcast(wanted) if small else wanted, keys)


def most_lost(asked: DataFrame) -> DataFrame:
    """qid and the most, as a negative number, that its terms of negative weight take away."""
    taken = F.least(F.col("weight") * F.col("top"), F.lit(0.0))
    return asked.groupBy("qid").agg(F.sum(taken).alias("lost"))


def judged_blocks(asked: DataFrame, impacts: ImpactIndex, k: int) -> DataFrame:
    """(folder, tier, term, block, qid, weight, bar, gives, most): all blocks of the query's terms.

    ``gives`` says that a block yields candidates, ``most`` is what its best
    posting adds to a score.  ``asked`` has (qid, folder, term, weight, top),
    materialised.  The bar is the k-th best sum over the first blocks of a query's
    terms, less the most that terms of negative weight may take away; it is null
    where there are fewer documents.
    """
    avgdl = impacts.index.stats.select("avgdl").scalar()
    impact = impacts.weights[1](avgdl)
    first = _met(impacts.blocks.where("tier = 0"), asked.drop("top"), ["folder", "term"])
    gained = F.greatest(F.col("weight") * impact, F.lit(0.0))
    sums = _postings(first, "qid", "weight").groupBy("qid", "docno").agg(F.sum(gained).alias("score"))
    best = F.greatest(F.col("weight") * F.col("top"), F.lit(0.0))
    bars = top_k(sums, k).where(F.col("rank") == k).join(most_lost(asked), "qid")
    bars = bars.select("qid", (F.col("score") + F.col("lost") - SLACK).alias("bar"))
    earlier = (
        Window.partitionBy("qid").orderBy(best, "term").rowsBetween(Window.unboundedPreceding, -1)
    )
    bounded = (
        asked.withColumn("before", F.coalesce(F.sum(best).over(earlier), F.lit(0.0)))
        .drop("top")
        .join(bars, "qid", "left")
    )
    heads = impacts.blocks.select("folder", "tier", "term", "block", "top")
    reaches = F.col("bar").isNull() | (best + F.col("before") >= F.col("bar"))
    return _met(heads, checkpointed(bounded), ["folder", "term"]).select(
        "folder", "tier", "term", "block", "qid", "weight", "bar",
        reaches.alias("gives"), best.alias("most"),
    )


def candidates(judged: DataFrame, given: DataFrame, lost: DataFrame, k: int) -> DataFrame:
    """(qid, docno, score) of documents that may still reach the bar.

    ``given`` has a row (qid, docno, part) for each posting of a block that gives;
    the other blocks add at most the best of each term's first one, and take away
    what ``lost`` says at most.  So the k-th best sum of what is given, less that, is
    a bar too, and it is far above the one of the first blocks.
    """
    sums = given.groupBy("qid", "docno").agg(
        F.sum("part").alias("score"), F.sum(F.greatest("part", F.lit(0.0))).alias("gained")
    )
    kth = top_k(sums.select("qid", "docno", "score"), k).where(F.col("rank") == k)
    higher = kth.join(lost, "qid").select(
        "qid", (F.col("score") + F.col("lost") - SLACK).alias("higher")
    )
    rest = (
        judged.where("not gives")
        .groupBy("qid", "term")
        .agg(F.max("most").alias("most"))
        .groupBy("qid")
        .agg(F.sum("most").alias("rest"))
    )
    bars = judged.groupBy("qid").agg(F.first("bar").alias("bar")).join(rest, "qid", "left")
    bars = bars.join(higher, "qid", "left")
    return (
        sums.join(bars, "qid")
        .where("bar is null or gained + coalesce(rest, 0) >= greatest(bar, higher)")
        .select("qid", "docno", "score")
    )


def retrieve_pruned(
    topics: DataFrame,
    impacts: ImpactIndex,
    k: int = TOPK,
    broadcast_rows: int = lexical.BROADCAST_TERMS,
    pretokenised: bool = False,
) -> DataFrame:
    """Best ``k`` documents per query: qid, docno, score, rank, as ``lexical.retrieve`` gives them.

    Runs jobs for the query terms, the judged blocks and the candidates.
    """
    index = impacts.index
    small = lexical.query_term_rows(topics, index.n_max, pretokenised) <= broadcast_rows
    wanted = lexical.query_terms(topics, index.n_max, pretokenised=pretokenised).withColumn(
        "folder", folder_of("term", impacts.folders)
    )
    n_docs = index.stats.select("n_docs").scalar()
    asked = checkpointed(
        _met(impacts.terms, checkpointed(wanted), ["folder", "term"], small).select(
            "qid", "folder", "term", "top", impacts.weights[0](n_docs).alias("weight")
        )
    )
    judged = checkpointed(judged_blocks(asked, impacts, k))
    avgdl = index.stats.select("avgdl").scalar()
    part = (F.col("weight") * impacts.weights[1](avgdl)).alias("part")

    def parts(blocks: DataFrame) -> DataFrame:
        keys = ["folder", "tier", "term", "block"]
        met = _met(impacts.blocks.drop("top"), blocks.select(*keys, "qid", "weight"), keys)
        return _postings(met, "qid", "weight").select("qid", "docno", part)

    given = parts(judged.where("gives"))
    found = checkpointed(candidates(judged, given, most_lost(asked), k))
    asked_of = found.select("qid", "docno")
    others = parts(judged.where("not gives")).join(
        broadcast_if_short(asked_of), ["qid", "docno"], "left_semi"
    )
    scored = (
        found.withColumnRenamed("score", "part")
        .unionByName(others)
        .groupBy("qid", "docno")
        .agg(rounded(F.sum("part")).alias("score"))
    )
    return top_k(scored, k)
