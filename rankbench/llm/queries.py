"""Registered queries of the subpackage, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankbench.llm import (
    ann,
    html_text,
    langid,
    merkle,
    mixing,
    packing,
    secrets,
    sharding,
    simhash,
    toxicity,
    trie_dedup,
    vector_dedup,
    whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_embedding_dedup(spark, sf_dir):
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_simhash_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from the labelled documents that are not held out."""
    return toxicity.learn(
        toxicity.sample_of(docs, labels.where(~toxicity.held_out(F.col("doc_id"), 4, 2)))
    )


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", toxicity.score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held = toxicity.held_out(F.col("doc_id"), 3, 1)
    model = langid.learn(langid.sample_of(docs.where(~held)))
    found = docs.select("doc_id", langid.identify(F.col("text"), model, spark).alias("found"))
    return found.select(
        "doc_id",
        held.alias("held_out"),
        F.col("found.best").alias("lang_pred"),
        "found.score",
        (F.col("found.lang") == langid.UNKNOWN).alias("rejected"),
    )


def op3_nearest_vectors(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def word_bpe_path() -> str:
    """The public tokenizer file; it is installed wherever a task runs."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_pattern_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe_path())


def op5_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", "url", html_text.main_text(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op6_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))
    return found.select(
        "doc_id",
        *[secrets.counted(F.col("_base"), k).alias(f"n_{secrets.KINDS[k]}") for k in range(3)],
        F.sha2(secrets.written(F.col("_base")), 256).alias("base_sha256"),
        secrets.written(F.col("_spans")).alias("spans"),
    )


def op7_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_hash_tree_shards(spark, sf_dir):
    shards = sharding.BASE_SHARDS
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards)
    grown = sharding.shard_of(F.col("doc_id"), sharding.topology(shards + 1))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
        grown.alias("grown_shard"),
    )


def op11_embedding_whitening(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    schema = (
        f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, "
        "deviation long, whitened double, explained double, identity_error double"
    )
    if model is None:
        return spark.createDataFrame([], schema)
    shares = [float(e) / model.total for e in model.eigenvalues[: whitening.COMPONENTS]]
    error = whitening.identity_error(vectors, model)
    rows = whitening.transform(vectors, model)
    return rows.select(
        "vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened")
    ).select(
        "vec_id",
        (F.col("pos") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("col").alias("whitened"),
        F.get(F.lit(shares), F.col("pos")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    altered = F.when(toxicity.held_out(F.col("doc_id"), 3, 0), merkle.lowered(F.col("text")))
    return merkle.proofs(merkle.manifest(docs, altered))


def op13_trie_exact_dedup(spark, sf_dir):
    return trie_dedup.duplicates(table(spark, sf_dir, "documents"), keep="largest")


QUERIES = {
    f.__name__: f
    for f in [
        op1_toxicity,
        op2_language_id,
        op3_nearest_vectors,
        op4_pattern_packing,
        op5_html_extraction,
        op6_secret_scan,
        op7_mix_sources,
        op8_embedding_dedup,
        op9_simhash_dedup,
        op10_hash_tree_shards,
        op11_embedding_whitening,
        op12_merkle_manifest,
        op13_trie_exact_dedup,
    ]
}

ORACLES: dict[str, str] = {
    # crc32 bit by bit over the digits of the id; the trees level by level
    "op12_merkle_manifest": """
        with recursive written as (
            select
                doc_id, lang, text,
                case when doc_id is null then '-'
                    else strlen(doc_id::varchar) || ':' || doc_id::varchar end
                || case when source is null then '-' else strlen(source) || ':' || source end
                || case when lang is null then '-' else strlen(lang) || ':' || lang end
                || case when n_chars is null then '-'
                    else strlen(n_chars::varchar) || ':' || n_chars::varchar end as head,
                xor(list_reduce(
                    list_prepend(4294967295::bigint, list_transform(
                        string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
                    lambda crc, byte: list_reduce(
                        list_prepend(xor(crc, byte), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
                        lambda v, _: xor(v >> 1, (v & 1) * 3988292384::bigint))
                ), 4294967295::bigint) as crc
            from documents
        ),
        marked as (
            select
                doc_id, lang,
                sha256(head || case when text is null then '-'
                    else strlen(text) || ':' || text end) as leaf,
                case when crc % 3 = 0 and text is not null then sha256(
                    head || strlen(text) || ':' || translate(
                        text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                ) end as altered
            from written
        ),
        grouped as (select *, dense_rank() over (order by lang nulls first) as gi from marked),
        leaves as materialized (
            select
                doc_id, gi, leaf, coalesce(altered, leaf) as given,
                row_number() over (partition by gi order by doc_id nulls first, leaf) - 1 as pos,
                count(*) over (partition by gi) as m
            from grouped
        ),
        nodes(lvl, gi, pos, h, m) as (
            select 0, gi, pos, leaf, m from leaves
            union all
            select lvl + 1, gi, pos // 8, sha256(string_agg(h, '' order by pos)), (m + 7) // 8
            from nodes where m > 1 group by lvl, gi, pos // 8, m
        ),
        ways as materialized (
            select lvl, gi, pos,
                coalesce(string_agg(h, '') over (partition by lvl, gi, pos // 8 order by pos
                    rows between unbounded preceding and 1 preceding), '') as a,
                coalesce(string_agg(h, '') over (partition by lvl, gi, pos // 8 order by pos
                    rows between 1 following and unbounded following), '') as b
            from nodes where m > 1
        ),
        walk(start, lvl, gi, pos, m, f, sib) as (
            select pos, 0, gi, pos, m, given, '' from leaves
            union all
            select start, walk.lvl + 1, walk.gi, walk.pos // 8, (m + 7) // 8,
                sha256(a || f || b), sib || a || b
            from walk join ways
                on walk.lvl = ways.lvl and walk.gi = ways.gi and walk.pos = ways.pos
            where m > 1
        ),
        subroots as materialized (select gi, h, count(*) over () as m from nodes where m = 1),
        top_nodes(lvl, pos, h, m) as (
            select 0, gi - 1, h, m from subroots
            union all
            select lvl + 1, pos // 8, sha256(string_agg(h, '' order by pos)), (m + 7) // 8
            from top_nodes where m > 1 group by lvl, pos // 8, m
        ),
        top_ways as materialized (
            select lvl, pos,
                coalesce(string_agg(h, '') over (partition by lvl, pos // 8 order by pos
                    rows between unbounded preceding and 1 preceding), '') as a,
                coalesce(string_agg(h, '') over (partition by lvl, pos // 8 order by pos
                    rows between 1 following and unbounded following), '') as b
            from top_nodes where m > 1
        ),
        top_walk(start, gi, lvl, pos, m, f, sib) as (
            select w.start, w.gi, 0, w.gi - 1, s.m, w.f, w.sib
            from walk w join subroots s on w.gi = s.gi where w.m = 1
            union all
            select start, gi, top_walk.lvl + 1, top_walk.pos // 8, (m + 7) // 8,
                sha256(a || f || b), sib || a || b
            from top_walk join top_ways
                on top_walk.lvl = top_ways.lvl and top_walk.pos = top_ways.pos
            where m > 1
        )
        select
            l.doc_id, l.leaf, s.h as subroot, r.h as root, sha256(t.sib) as proof_sha256,
            t.f as folded_root, t.f = r.h as verified
        from leaves l
        join top_walk t on l.gi = t.gi and l.pos = t.start and t.m = 1
        join subroots s on l.gi = s.gi
        join (select h from top_nodes where m = 1) r on true
    """,
    "op13_trie_exact_dedup": """
        with lowered as (
            select doc_id, translate(
                coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'
            ) as t
            from documents
        )
        select
            doc_id,
            max(doc_id) over (partition by t) as keep_id,
            count(*) over (partition by t) as group_size,
            doc_id = max(doc_id) over (partition by t) as kept,
            sha256(t) as text_sha256
        from lowered
    """,
    # every pair of vectors: for the small tables
    "op8_embedding_dedup": """
        with recursive vectors as (
            select vec_id, embedding::double[] as e, sqrt(list_dot_product(e, e)) as norm
            from embeddings
            where len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links as (
            select a.vec_id as a, b.vec_id as b
            from vectors a join vectors b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
            where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
        ),
        reach(a, b) as (
            select a, b from links
            union
            select reach.a, links.b from reach join links on reach.b = links.a
        ),
        lowest as (select a, min(b) as low from reach group by a),
        degree as (select a, count(*) as n from links group by a)
        select
            e.vec_id,
            coalesce(degree.n, 0) as n_links,
            least(e.vec_id, coalesce(lowest.low, e.vec_id)) as component_id,
            coalesce(lowest.low, e.vec_id) >= e.vec_id as kept
        from embeddings e
        left join lowest on lowest.a = e.vec_id
        left join degree on degree.a = e.vec_id
    """,
}
