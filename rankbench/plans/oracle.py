"""ANSI-style SQL (DuckDB) with the same meaning as each registered query."""

WORD = r"[\p{L}\p{N}_]+"


def toks(x: str, lower: bool = True) -> str:
    x = f"lower({x})" if lower else x
    return f"regexp_extract_all({x}, '{WORD}')"


def grams(t: str, n: int, sep: str = "_") -> str:
    # the outer one-element list binds the tokens, so they are cut only once
    return (
        f"list_transform([{t}], lambda ts: "
        f"list_transform(range(1, greatest(len(ts) - {n - 2}, 1)), "
        f"lambda i: array_to_string(ts[i:i + {n - 1}], '{sep}')))[1]"
    )


def terms(x: str, n_max: int = 1, lower: bool = True) -> str:
    t = toks(x, lower)
    if n_max == 1:
        return t
    return f"list_concat({', '.join([t] + [grams(t, n) for n in range(2, n_max + 1)])})"


def spaced(t: str) -> str:
    return f"array_to_string({t}, ' ')"


def draw(seed: str, *keys: str) -> str:
    return f"('0x' || substr({digest(seed, *keys)}, 1, 8))::bigint"


def digest(seed: str, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"


def jaccard(a: str, b: str) -> str:
    """Overlap of two lists without repeats."""
    shared = f"len(list_intersect({a}, {b}))"
    return f"coalesce({shared} / nullif(len({a}) + len({b}) - {shared}, 0), 0.0)"


# --- views over the tables ---------------------------------------------------

BENCH = """
docs as (
  select cast(doc_id as varchar) as docno, split_part(text, chr(10), 1) as title, text
  from documents),
topics as (select cast(item_id as varchar) as qid, text as query from benchmark)"""

FRAMED = "' ' || " + spaced(toks("{}")) + " || ' '"

BENCH_QRELS = f"""
needles as (
  select qid, {FRAMED.replace('{}', 'query')} as needle from topics
  where len({toks('query')}) > 0),
hay as (select docno, {FRAMED.replace('{}', 'text')} as hay from docs),
qrels as (
  select qid, 'Q0' as iter, docno, 1 as label from needles, hay where contains(hay, needle))"""

TURNS = """
turns as (select conv_id || '-' || turn as turn_key, * from conversations)"""

CHAT = TURNS + """,
docs as (
  select turn_key as docno, split_part(text, '.', 1) as title, text from turns
  where role = 'assistant'),
topics as (select turn_key as qid, text as query from turns where role = 'user')"""

CHAT_QRELS = """
qrels as (
  select u.turn_key as qid, 'Q0' as iter, a.turn_key as docno,
         case when a.turn = u.turn + 1 then 2 else 1 end as label
  from turns u join turns a
    on a.conv_id = u.conv_id and (a.turn = u.turn + 1 or a.turn = u.turn + 3)
  where u.role = 'user' and a.role = 'assistant')"""

TRIPLES = f"""
answered as (
  select row_number() over (order by {digest('triple', 'u.conv_id', 'u.turn')}) as triple_id,
         u.text as query, a.text as positive
  from conversations u join conversations a
    on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant'),
triples as (
  select t.triple_id, t.query, t.positive, o.positive as negative
  from answered t join answered o
    on o.triple_id = (t.triple_id + 6) % (select count(*) from answered) + 1),
sides as (
  select triple_id || '-positive' as pair_id, triple_id, 'positive' as side, query, positive as text
  from triples
  union all
  select triple_id || '-negative', triple_id, 'negative', query, negative from triples)"""

VECTORS = """
vecs as (select cast(vec_id as varchar) as docno, embedding, label from embeddings)"""

BY_LANGUAGE = """
rows_ as (
  select cast(doc_id as varchar) as id, text, case when lang = 'en' then 0 else 1 end as domain
  from documents)"""


def index_of(docs: str = "docs", topics: str = "topics", n: int = 1, s: str = "", lower=True) -> str:
    return f"""
toks{s} as (
  select docno, text, {terms('text', n, lower)} as terms
  from {docs}),
post{s} as (
  select docno, dl, term, cast(count(*) as int) as tf
  from (select docno, cast(len(terms) as int) as dl, unnest(terms) as term from toks{s})
  group by docno, dl, term),
lex{s} as (
  select term, count(*) as df, cast(sum(tf) as bigint) as cf from post{s} group by term),
st{s} as (
  select (select count(*) from toks{s}) as n_docs,
         (select count(*) from lex{s}) as n_terms,
         (select count(*) from post{s}) as n_postings,
         (select cast(sum(cf) as bigint) from lex{s}) as n_tokens,
         (select avg(len(terms)) from toks{s}) as avgdl)""" + (f""",
qt{s} as (
  select qid, term, count(*) as qtf
  from (select qid, unnest({terms('query', n, lower)}) as term from {topics})
  group by qid, term)""" if topics else "")


def top(name: str, scored: str, k: int = 10, base: int = 1) -> str:
    return f"""
{name} as (
  select qid, docno, score, rank + {base - 1} as rank
  from (select *, row_number() over (partition by qid order by score desc, docno) as rank
        from ({scored}) as scored_{name})
  where rank <= {k})"""


def bm25(name: str = "bm25", s: str = "") -> str:
    return top(name, f"""
    select qid, docno, round(sum(
        log2((n_docs - df + 0.5e0) / (df + 0.5e0)) * 9.0e0 * qtf / (8.0e0 + qtf)
        * tf * 1.9e0 / (tf + 0.9e0 * (0.6e0 + 0.4e0 * dl / avgdl))), 6) as score
    from qt{s} join lex{s} using (term) join post{s} using (term), st{s}
    group by qid, docno""")


TFIDF = top("tfidf", """
    select qid, docno, round(sum(
        qtf * log2(n_docs * 1.0e0 / df + 1)
        * 1.2e0 * tf / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) as score
    from qt join lex using (term) join post using (term), st
    group by qid, docno""")


def encoded(name: str, counts: str, keys: str, key: str) -> str:
    """Long form of the built-in encoder: key, slot, x (unit vectors)."""
    return f"""
raw_{name} as (
  select {key}, cast(('0x' || substr(md5(term), 1, 8))::bigint % 64 as int) as slot,
         sum(case when substr(md5(term), 9, 1) < '8' then 1 else -1 end
             * (1 + ln(tf)) * ln((n_docs + 1) / (df + 1))) as x
  from ({counts}) as counts_{name} join lex using (term), st
  group by 1, 2),
{name} as (
  select {key}, slot, case when size > 0 then x / size else x end as x
  from (select k.{key}, cast(s.slot as int) as slot, coalesce(r.x, 0) as x,
               sqrt(sum(coalesce(r.x, 0) * coalesce(r.x, 0)) over (partition by k.{key})) as size
        from ({keys}) as k cross join range(64) as s(slot)
        left join raw_{name} r on r.{key} = k.{key} and r.slot = s.slot))"""


DOC_VECTORS = encoded("dvec", "select docno, term, tf from post", "select docno from docs", "docno")
TOPIC_VECTORS = encoded(
    "qvec", "select qid, term, qtf as tf from qt",
    "select qid from topics", "qid",
)

COSINES = """
dstored as (select docno, slot, cast(cast(x as float) as double) as x from dvec),
dsize as (select docno, sqrt(sum(x * x)) as size from dstored group by docno),
qsize as (select qid, sqrt(sum(x * x)) as size from qvec group by qid),
cosines as (
  select qid, docno, round(coalesce(dot / nullif(qsize.size * dsize.size, 0), 0), 6) as score
  from (select q.qid, d.docno, sum(q.x * d.x) as dot from qvec q join dstored d using (slot)
        group by q.qid, d.docno) join qsize using (qid) join dsize using (docno))"""

DENSE = top("dense", "select qid, docno, score from cosines")


def logit(query: str, text: str) -> str:
    """Fixed-weight pair score before the logistic function."""
    q, d = f"list_distinct({toks(query)})", f"list_distinct({toks(text)})"
    shared = f"len(list_intersect({q}, {d}))"
    lq, ld = f"len({toks(query)})", f"len({toks(text)})"
    return (
        f"(-2.0e0 + 6.0e0 * coalesce({shared} / nullif(len({q}) + len({d}) - {shared}, 0), 0)"
        f" + 3.0e0 * coalesce({shared} / nullif(len({q}), 0), 0)"
        f" + 0.5e0 * coalesce(least({lq}, {ld}) / nullif(greatest({lq}, {ld}), 0), 0))"
    )


def pair_score(query: str, text: str) -> str:
    return f"round(1 / (1 + exp(-{logit(query, text)})), 6)"


def pair(base: int = 1) -> str:
    q, d = "list_intersect(q.ws, d.ws)", ""
    return f"""
qws as (select qid, list_distinct({toks('query')}) as ws, len({toks('query')}) as n from topics),
dws as (select docno, list_distinct({toks('text')}) as ws, len({toks('text')}) as n from docs),
""" + top("pair", f"""
    select qid, docno, round(1 / (1 + exp(-(
        -2.0e0 + 6.0e0 * coalesce(shared / nullif(qs + ds - shared, 0), 0)
        + 3.0e0 * coalesce(shared / nullif(qs, 0), 0)
        + 0.5e0 * coalesce(least(qn, dn) / nullif(greatest(qn, dn), 0), 0)))), 6) as score
    from (select qid, docno, len({q}) as shared, len(q.ws) as qs, len(d.ws) as ds,
                 q.n as qn, d.n as dn from qws q, dws d)""", base=base).lstrip()


def rerank_cosine(name: str, first: str) -> str:
    return top(name, f"select r.qid, r.docno, c.score from {first} r join cosines c using (qid, docno)")


def rerank_pair(name: str, first: str) -> str:
    return top(name, f"""
    select qid, docno, {pair_score('query', 'text')} as score
    from {first} join topics using (qid) join docs using (docno)""")


def runs(**systems: str) -> str:
    return "\nruns as (\n  " + "\n  union all ".join(
        f"select '{name}' as system, qid, docno, rank, score from {cte}"
        for name, cte in systems.items()
    ) + ")"


METRICS = """
judged as (
  select system, qid, docno, rank, score from (
    select *, row_number() over (partition by system, qid order by score desc, docno) as place
    from runs) where place <= 10),
placed as (
  select r.system, r.qid,
         row_number() over (partition by r.system, r.qid order by r.score desc, r.docno) as place,
         coalesce(q.label, 0) as label
  from judged r left join qrels q on q.qid = r.qid and q.docno = r.docno),
ideal as (
  select qid,
         sum(case when place <= 1 then label / log2(place + 1) end) as i1,
         sum(case when place <= 5 then label / log2(place + 1) end) as i5,
         sum(case when place <= 10 then label / log2(place + 1) end) as i10,
         count(*) filter (where label > 0) as n_relevant
  from (select *, row_number() over (partition by qid order by label desc, docno) as place from qrels)
  group by qid),
found as (
  select system, qid,
         sum(case when place <= 1 then label / log2(place + 1) end) as d1,
         sum(case when place <= 5 then label / log2(place + 1) end) as d5,
         sum(case when place <= 10 then label / log2(place + 1) end) as d10,
         count(*) filter (where label > 0 and place <= 1) as h1,
         count(*) filter (where label > 0 and place <= 5) as h5,
         count(*) filter (where label > 0 and place <= 10) as h10,
         min(case when label > 0 then place end) as first_hit
  from placed group by system, qid),
per_query as (
  select s.system, i.qid,
         coalesce(d1 / nullif(i1, 0), 0) as n1, coalesce(d5 / nullif(i5, 0), 0) as n5,
         coalesce(d10 / nullif(i10, 0), 0) as n10,
         coalesce(h1 / nullif(n_relevant, 0), 0) as r1,
         coalesce(h5 / nullif(n_relevant, 0), 0) as r5,
         coalesce(h10 / nullif(n_relevant, 0), 0) as r10,
         coalesce(1.0e0 / first_hit, 0) as m10
  from (select distinct system from runs) s cross join ideal i
  left join found f on f.system = s.system and f.qid = i.qid),
wide as (
  select system, round(avg(n1), 6) as ndcg_1, round(avg(n5), 6) as ndcg_5,
         round(avg(n10), 6) as ndcg_10, round(avg(r1), 6) as r_1, round(avg(r5), 6) as r_5,
         round(avg(r10), 6) as r_10, round(avg(m10), 6) as mrr_10
  from per_query group by system)"""

LONG_METRICS = " union all ".join(
    f"select system, '{name}' as metric, {column} as value from wide"
    for name, column in [
        ("nDCG@1", "ndcg_1"), ("nDCG@5", "ndcg_5"), ("nDCG@10", "ndcg_10"),
        ("R@1", "r_1"), ("R@5", "r_5"), ("R@10", "r_10"), ("MRR@10", "mrr_10"),
    ]
)

OVERLAPS = f"""
sets as (
  select triple_id, list_distinct({toks('query')}) as q, list_distinct({toks('positive')}) as p,
         list_distinct({toks('negative')}) as n from triples),
overlap_of as (
  select triple_id, {jaccard('q', 'p')} as positive, {jaccard('q', 'n')} as negative from sets)"""

def okapi_of(s: str = "") -> str:
    """Okapi scores of the pair sides; ``s`` ends the names of their index."""
    return f"""
sdocs as (select pair_id as docno, text from sides),
""" + index_of("sdocs", "", s=s, lower=False).lstrip() + f""",
raw_idf as (
  select term, ln(n_docs - df + 0.5e0) - ln(df + 0.5e0) as raw from lex{s}, st{s}),
idf as (
  select term, case when raw < 0 then 0.25e0 * (select avg(raw) from raw_idf) else raw end as idf
  from raw_idf),
asked as (
  select pair_id, term, count(*) as qtf
  from (select pair_id, unnest({toks('query', False)}) as term from sides)
  group by pair_id, term),
okapi as (
  select s.pair_id, s.triple_id, s.side, round(coalesce(sum(
      qtf * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 0), 6) as score
  from sides s
  left join (asked a join post{s} p on p.docno = a.pair_id and p.term = a.term
             join idf i on i.term = a.term cross join st{s}) on a.pair_id = s.pair_id
  group by s.pair_id, s.triple_id, s.side)"""


OKAPI, OKAPI_OF_SIDES = okapi_of(), okapi_of("_sides")

LENGTHS = f"""
lengths as (
  select 'train_positive' as "group", len({toks('positive', False)}) as length from triples
  union all select 'train_negative', len({toks('negative', False)}) from triples
  union all select 'test_corpus', len({toks('text', False)}) from docs),
limits as (
  select "group", quantile_cont(length, 0.95) as p95 from lengths group by "group")"""

WORD_IDS = """
word_ids as (
  select term, row_number() over (order by cf desc, term) + 1 as id from lex),
words as (
  select docno, unnest(w) as term, unnest(range(1, len(w) + 1)) as pos
  from (select docno, """ + toks("text") + """ as w from docs)),
ids as (
  select docno, pos, coalesce(id, 0) as id from words left join word_ids using (term))"""

PACKED = f"""
batches as (
  select docno, {draw('42', 'docno')} % greatest(ceil((select count(*) from docs) / 1000), 1) as batch
  from docs),
numbered as (
  select cast(batch as int) as batch, id,
         row_number() over (partition by batch order by docno, pos) - 1 as spot
  from ids join batches using (docno)),
blocks as (
  select batch, cast(floor(spot / 512) as int) as block, list(id order by spot) as input_ids
  from numbered group by 1, 2 having count(*) = 512)"""


def newton(rows: str, features: int, ridge: float = 0.01, steps: int = 9) -> str:
    """CTE ``optimum`` (w): logistic weights of lists z over ``rows`` (z, y), intercept first.

    Each step solves its linear system by elimination, a pivot at a time.
    """
    n = features + 1
    parts = [f"w0 as materialized (select [0.0e0{', 0.0e0' * features}] as w)"]
    for t in range(steps):
        parts.append(f"""m{t}_0 as materialized (
  select i, j, avg(case when j < {n} then p * (1 - p) * z[i + 1] * z[j + 1] else (p - y) * z[i + 1] end)
         + case when i > 0 and i = j then {ridge}e0 when i > 0 and j = {n} then {ridge}e0 * any_value(w)[i + 1]
           else 0 end as v
  from (select z, y, w, 1 / (1 + exp(-list_dot_product(z, w))) as p from {rows}, w{t}),
       (select unnest(range({n}))::int as i), (select unnest(range({n + 1}))::int as j)
  group by i, j)""")
        for k in range(n):
            parts.append(f"""m{t}_{k + 1} as materialized (
  select a.i, a.j, case when a.i = {k} then a.v / p.v else a.v - own.v * top.v / p.v end as v
  from m{t}_{k} a join m{t}_{k} p on p.i = {k} and p.j = {k}
  join m{t}_{k} own on own.i = a.i and own.j = {k} join m{t}_{k} top on top.i = {k} and top.j = a.j)""")
        parts.append(f"""w{t + 1} as materialized (
  select list(w[i + 1] - v order by i) as w from m{t}_{n}, w{t} where j = {n})""")
    parts.append(f"optimum as (select w from w{steps})")
    return ",\n".join(parts)


def share(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::bigint / 4294967296.0e0)"


def with_(*parts: str, select: str) -> str:
    return "with " + ",".join(p.strip("\n") for p in parts) + "\n" + select.strip()


def oracles() -> dict[str, str]:
    index, index2 = index_of(), index_of(n=2, s="2")
    run = "select qid, docno, score, rank from "
    bench_index, chat_index = (BENCH, index), (CHAT, index)
    lexical_runs = (
        CHAT, index, index2, bm25(), bm25("bm25_ng2", "2"), TFIDF,
        runs(bm25="bm25", bm25_ng2="bm25_ng2", tfidf="tfidf"),
    )
    matrix = (
        CHAT, index, index2, bm25(), bm25("bm25_ng2", "2"), TFIDF,
        DOC_VECTORS, TOPIC_VECTORS, COSINES, DENSE, pair(),
        rerank_cosine("bm25_dense", "bm25"), rerank_pair("bm25_pair", "bm25"),
        rerank_pair("dense_pair", "dense"),
        runs(**{n: n for n in ("bm25", "bm25_ng2", "tfidf", "dense", "pair",
                               "bm25_dense", "bm25_pair", "dense_pair")}),
    )
    pair_vectors = [
        encoded(name, f"""
            select pair_id, term, count(*) as tf
            from (select pair_id, unnest({toks(column)}) as term from sides) group by 1, 2""",
            "select pair_id from sides", "pair_id")
        for name, column in (("lvec", "query"), ("rvec", "text"))
    ]
    chat_judged = (CHAT, CHAT_QRELS, index, bm25(), runs(bm25="bm25"), METRICS)
    bench_vectors = (BENCH, index, DOC_VECTORS, TOPIC_VECTORS, COSINES)
    class_dense = (VECTORS, f"""
means as (
  select label, slot, avg(cast(x as double)) as x
  from (select label, unnest(embedding) as x, unnest(range(len(embedding))) as slot from vecs)
  group by label, slot),
members as (
  select docno, cast(unnest(embedding) as double) as x, unnest(range(len(embedding))) as slot
  from vecs),
""" + top("dense", """
    select cast(label as varchar) as qid, docno,
           round(dot / (sqrt(qq) * sqrt(dd)), 6) as score
    from (select m.label, d.docno, sum(m.x * d.x) as dot, sum(m.x * m.x) as qq,
                 sum(d.x * d.x) as dd
          from means m join members d using (slot) group by m.label, d.docno)""").lstrip())
    prepared = """
raw_corpus as (
  select cast(doc_id as varchar) as _id, split_part(text, chr(10), 1) as title, text,
         lang as title_english, case when lang <> 'fr' then source end as text_english
  from documents),
raw_queries as (
  select cast(item_id as varchar) as _id, text,
         case when length(text) % 7 <> 0 then 'x' end as text_english from benchmark),
raw_qrels as (
  select source as query_id, cast(doc_id as varchar) as corpus_id,
         case when toxic = 0 then quality end as score
  from labels join documents using (doc_id)),
corpus as (
  select _id as docno, title, text from raw_corpus
  where title is not null and text is not null and title_english is not null
    and text_english is not null),
queries_ as (select _id as qid, text as query from raw_queries where text_english is not null),
judgments as (
  select query_id as qid, 'Q0' as iter, corpus_id as docno, score as label from raw_qrels
  where score is not null),
kept as (select query, positive, negative from triples where triple_id % 5 <> 0)"""
    number = f"row_number() over (order by {digest('42', 'docno')})"
    return {
        "io_csv_roundtrip": with_(BENCH, select="select docno, title, text from docs"),
        "io_csv_split": with_(BENCH, select="select docno, title, text from docs"),
        "io_csv_columns": with_(BENCH, select="select docno, text from docs"),
        "io_transform_rename": with_(BENCH, select=f"""
            select docno as doc_key, title, {spaced(toks('text'))} as text,
                   cast(len({toks('text')}) as int) as n_terms from docs"""),
        "io_ndjson_roundtrip": with_(CHAT, select="select qid, query from topics"),
        "io_qrels_roundtrip": with_(CHAT, CHAT_QRELS, select="select * from qrels"),
        "io_run_roundtrip": with_(*bench_index, bm25(), runs(bm25="bm25"), select="select * from runs"),
        "io_run_directory": with_(*lexical_runs, select="select * from runs"),
        "prep_corpus": with_(TRIPLES, prepared, select="select * from corpus"),
        "prep_topics": with_(TRIPLES, prepared, select="select * from queries_"),
        "prep_qrels": with_(TRIPLES, prepared, select="select * from judgments"),
        "prep_triples": with_(TRIPLES, prepared, select="select * from kept"),
        "prep_counts": with_(TRIPLES, prepared, select="""
            select 'corpus' as name, count(*) as n from corpus
            union all select 'triplets', count(*) from kept
            union all select 'queries', count(*) from queries_
            union all select 'qrels', count(*) from judgments"""),
        "prep_pretokenize": with_(BENCH, select=f"""
            select 'corpus' as kind, docno as id, {spaced(terms("(title || ' ' || text)", 2))} as text
            from docs
            union all select 'query', qid, {spaced(terms('query', 2))} from topics"""),
        "step_pretokenize": with_(CHAT, CHAT_QRELS, select=f"""
            select 'corpus' as kind, docno as id, {spaced(terms("(title || ' ' || text)", 2))} as text
            from docs
            union all select 'query', qid, {spaced(terms('query', 2))} from topics
            union all select 'qrels', qid, iter || ' ' || docno || ' ' || label from qrels"""),
        "prep_join_title": with_(BENCH, select=f"""
            select docno, title || ' ' || text as with_space, title || text as plain,
                   {spaced(f"list_concat({toks('title')}, {terms('text', 2)})")} as tokens
            from docs"""),
        "prep_shuffle": with_(BENCH, select=f"select docno, {number} as position from docs"),
        "prep_train_eval_split": with_(BENCH, select=f"""
            select docno, length(text) as chars,
                   case when {number} <= (select count(*) - cast(floor(count(*) * 0.1e0) as bigint)
                                          from docs)
                        then 'train' else 'eval' end as part from docs"""),
        "prep_train_eval_share": with_(BENCH, select=f"""
            select docno, case when {draw('42', 'docno')} / 4294967296.0e0 < 1 - 0.1e0
                               then 'train' else 'eval' end as part from docs"""),
        "prep_pairs": with_(TRIPLES, select="""
            select triple_id, query as sentence1, text as sentence2,
                   case when side = 'positive' then 1 else 0 end as label from sides"""),
        "text_tokenize": with_(BENCH, select=f"""
            select docno, {spaced(toks('text'))} as tokens, cast(len({toks('text')}) as int) as n
            from docs"""),
        "text_ngrams": with_(BENCH, select=f"""
            select docno, {spaced(terms('text', 3))} as terms,
                   cast(len({terms('text', 3)}) as int) as n from docs"""),
        "text_jaccard": with_(BENCH, f"""
sets as (
  select docno, list_distinct({toks('title')}) as a, list_distinct({toks('text')}) as b from docs)""",
            select=f"select docno, round({jaccard('a', 'b')}, 6) as jaccard from sets"),
        "udf_custom_tokenizer": with_(BENCH, r"""
cut as (
  select docno, list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> '') as t
  from docs)""", select=f"select docno, {spaced('list_concat(t, ' + grams('t', 2) + ')')} as terms from cut"),
        "index_postings": with_(*bench_index, select="select docno, dl, term, tf from post"),
        "index_postings_ng2": with_(BENCH, index2, select="select docno, dl, term, tf from post2"),
        "index_doclen": with_(*bench_index, select="select docno, cast(len(terms) as int) as dl from toks"),
        "index_lexicon": with_(*bench_index, select="select term, df, cf from lex"),
        "index_stats": with_(*bench_index, select="""
            select n_docs, n_terms, n_postings, n_tokens, round(avgdl, 6) as avgdl from st"""),
        "index_term_sample": with_(*bench_index, select=f"""
            select term, df, cf from lex order by {digest('42', 'term')} limit 10"""),
        "index_docstore": with_(*bench_index, select=f"""
            select docno, text as text_raw,
                   left({spaced('list_filter(terms, lambda t: length(t) <= 128)')}, 8192) as text_tok
            from toks"""),
        "index_long_docno": with_(
            *bench_index, bm25(), rerank_pair("reranked", "bm25"), select="""
            select qid, 'https://archive.example.org/collection/volume/document/' || docno as docno,
                   score, rank from reranked"""),
        "retrieve_bm25": with_(*bench_index, bm25(), select=run + "bm25"),
        "retrieve_bm25_pruned": with_(*bench_index, bm25(), select=run + "bm25"),
        "index_impacts": with_(*bench_index, """
ranked as (
  select term, docno, impact,
         row_number() over (partition by term order by impact desc, docno) as place
  from (select term, docno,
               tf * 1.9e0 / (tf + 0.9e0 * (0.6e0 + 0.4e0 * dl / avgdl)) as impact
        from post, st))""", select="""
select term, cast(count(*) as int) as n, round(max(impact), 6) as top,
       string_agg(docno, ' ' order by place) as docnos
from ranked where place <= 128 group by term"""),
        "retrieve_bm25_ng2": with_(BENCH, index2, bm25(s="2"), select=run + "bm25"),
        "retrieve_tfidf": with_(*bench_index, TFIDF, select=run + "tfidf"),
        "retrieve_dense": with_(*class_dense, select=run + "dense"),
        "retrieve_dense_text": with_(*bench_vectors, DENSE, select=run + "dense"),
        "retrieve_pairscore_exhaustive": with_(BENCH, pair(0), select=run + "pair"),
        "score_okapi_pairs": with_(TRIPLES, OKAPI, select="select triple_id, side, score from okapi"),
        "score_pairs": with_(TRIPLES, select=f"""
            select pair_id, {pair_score('query', 'text')} as score from sides"""),
        "udf_pair_scorer": with_(TRIPLES, r"""
sets as (
  select pair_id,
    list_distinct(list_filter(string_split_regex(query, '\s+'), lambda t: t <> '')) as a,
    list_distinct(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')) as b
  from sides)""", select=f"select pair_id, round({jaccard('a', 'b')}, 6) as score from sets"),
        "dense_index": with_(VECTORS, select="""
            select docno, cast(slot as int) as slot,
                   round(cast(cast(x / size as float) as double), 5) + 0.0e0 as x
            from (select docno, cast(x as double) as x, slot,
                         sqrt(sum(cast(x as double) * x) over (partition by docno)) as size
                  from (select docno, unnest(embedding) as x,
                               unnest(range(len(embedding))) as slot from vecs))"""),
        "dense_encode": with_(*bench_index, DOC_VECTORS, select="""
            select docno, slot, round(x, 6) + 0.0e0 as x from dvec"""),
        "dense_encode_queries": with_(*bench_index, TOPIC_VECTORS, select="""
            select qid, slot, round(x, 6) + 0.0e0 as x from qvec"""),
        "dense_normalize": with_(*chat_index, DOC_VECTORS, select="""
            select docno, slot, round(x, 6) + 0.0e0 as x from dvec"""),
        "topk_per_query": with_(top("t", """
            select source as qid, cast(doc_id as varchar) as docno, n_chars as score
            from documents"""), select=run + "t"),
        "topk_rank_base0": with_(top("t", """
            select lang as qid, cast(doc_id as varchar) as docno, n_chars as score
            from documents""", base=0), select=run + "t"),
        "join_run_text": with_(*bench_index, bm25(), select="""
            select qid, docno, rank, text from bm25 left join docs using (docno)"""),
        "join_run_docstore": with_(*bench_index, bm25(), select=f"""
            select qid, docno, rank, {spaced('terms')} as text
            from bm25 join toks using (docno)"""),
        "rerank_bm25_dense": with_(
            *bench_vectors, bm25(), rerank_cosine("reranked", "bm25"), select=run + "reranked"),
        "rerank_bm25_pair": with_(
            *bench_index, bm25(), rerank_pair("reranked", "bm25"), select=run + "reranked"),
        "rerank_bm25_pair_pretokenised": with_(
            BENCH, index2, bm25(s="2"), rerank_pair("bm25_pair", "bm25"), select=run + "bm25_pair"),
        "rerank_dense_pair": with_(
            *bench_vectors, DENSE, rerank_pair("reranked", "dense"), select=run + "reranked"),
        "run_matrix": with_(*matrix, select="select * from runs"),
        "eval_ndcg": with_(*chat_judged, select="""
            select qid, round(n1, 6) as ndcg_1, round(n5, 6) as ndcg_5, round(n10, 6) as ndcg_10
            from per_query"""),
        "eval_recall": with_(*chat_judged, select="""
            select qid, round(r1, 6) as recall_1, round(r5, 6) as recall_5,
                   round(r10, 6) as recall_10 from per_query"""),
        "eval_mrr": with_(*chat_judged, select="select qid, round(m10, 6) as mrr_10 from per_query"),
        "eval_run": with_(
            BENCH, BENCH_QRELS, index, bm25(), runs(bm25="bm25"), METRICS, select=LONG_METRICS),
        "eval_dense": with_(*class_dense, """
qrels as (select cast(label as varchar) as qid, docno, 1 as label from vecs)""",
            runs(dense="dense"), METRICS, select=LONG_METRICS),
        "eval_all_runs": with_(*lexical_runs, CHAT_QRELS, METRICS, select=LONG_METRICS),
        "eval_single_run": with_(*lexical_runs, CHAT_QRELS, METRICS, select=(
            f"select * from ({LONG_METRICS}) where system = 'tfidf'")),
        "eval_missing_queries": with_(BENCH, BENCH_QRELS, index, bm25(), select="""
            select qid, count(*) filter (where label > 0) as n_relevant from qrels
            where qid not in (select qid from bm25 where score > 100) group by qid"""),
        "eval_comparison": with_(*matrix, CHAT_QRELS, METRICS, select="select * from wide"),
        "diag_bad_triples": with_(TRIPLES, OVERLAPS, select="""
            select count(*) filter (where positive <= negative) as bad, count(*) as total,
                   round(avg(case when positive <= negative then 1 else 0 end), 6) as share
            from overlap_of"""),
        "diag_jaccard": with_(TRIPLES, OVERLAPS, select="""
            select 'positive' as side, round(avg(positive), 6) as mean,
                   round(median(positive), 6) as median from overlap_of
            union all select 'negative', round(avg(negative), 6), round(median(negative), 6)
            from overlap_of"""),
        "diag_contradiction": with_(TRIPLES, OKAPI, select="""
            select count(*) filter (where n.score > p.score) as contradictions, count(*) as total,
                   round(avg(case when n.score > p.score then 1 else 0 end), 6) as rate
            from okapi p join okapi n using (triple_id)
            where p.side = 'positive' and n.side = 'negative'"""),
        "diag_length_groups": with_(BENCH, TRIPLES, LENGTHS, select="""
            select "group", cast(length as int) as length, count(*) as n
            from lengths group by "group", length"""),
        "diag_length_stats": with_(BENCH, TRIPLES, LENGTHS, select="""
            select "group", round(avg(length), 6) as mean, cast(median(length) as double) as median,
                   cast(max(length) as int) as longest, cast(min(length) as int) as shortest
            from lengths group by "group\""""),
        "diag_length_p95": with_(BENCH, TRIPLES, LENGTHS, select="""
            select "group", round(p95, 6) as p95 from limits"""),
        "diag_length_ood": with_(BENCH, TRIPLES, LENGTHS, select="""
            select m."group", round(m.p95, 6) as p95,
                   count(*) filter (where l.length > m.p95) as exceeding,
                   round(100.0e0 * count(*) filter (where l.length > m.p95) / count(*), 6) as percent
            from limits m, lengths l
            where l."group" = 'test_corpus' and m."group" <> 'test_corpus'
            group by m."group", m.p95"""),
        "diag_length_density": with_(BENCH, TRIPLES, LENGTHS, """
spreads as (
  select "group", count(*) as n,
         1.06e0 * stddev_samp(length) * pow(count(*), -0.2e0) as h from lengths group by "group"),
points as (
  select step, (select p95 from limits where "group" = 'test_corpus') * step / 200 as at
  from range(201) as r(step))""", select="""
            select s."group", cast(p.step as int) as step, round(p.at, 6) as length,
                   round(sum(exp(-0.5e0 * pow((p.at - l.length) / s.h, 2)))
                         / (s.n * s.h * sqrt(2 * pi())), 9) as density
            from spreads s join lengths l on l."group" = s."group", points p
            where s.h > 0
            group by s."group", s.n, s.h, p.step, p.at"""),
        "diag_query_overlap": """
            select count(*) as shared from (
              select text from documents where doc_id not in (select doc_id from labels)
              intersect
              select text from documents where doc_id in (select doc_id from labels))""",
        "diag_shift_dataset": with_(BY_LANGUAGE, select="""
            select domain, count(*) as n from rows_ group by domain"""),
        "diag_shift_vocab": with_(BY_LANGUAGE, f"""
kept as (
  select id, list_filter({toks('text')}, lambda t: length(t) >= 2) as t from rows_),
features as (
  select id, unnest(list_concat(t, {grams('t', 2, ' ')})) as term from kept),
counts as (
  select term, count(distinct id) as df, count(*) as cf from features group by term)""", select="""
            select term, df, cf from counts where df >= 2 order by cf desc, term limit 10000"""),
        "diag_shift_folds": with_(BY_LANGUAGE, select=f"""
            select id, domain, cast((row_number() over (
                partition by domain order by {digest('42', 'id')}) - 1) % 5 as int) as fold
            from rows_"""),
        "metric_auc": """
            with scored as (
              select quality as label, n_chars as score from labels join documents using (doc_id)),
            ranked as (
              select label, avg(place) over (partition by score) as place from (
                select *, row_number() over (order by score) as place from scored))
            select round((sum(case when label = 1 then place end)
                     - count(*) filter (where label = 1)
                       * (count(*) filter (where label = 1) + 1) / 2)
                   / (count(*) filter (where label = 1) * count(*) filter (where label = 0)), 6)
              as auc from ranked""",
        "lm_token_ids": with_(*bench_index, WORD_IDS, select="""
            select docno, cast(count(id) as int) as n,
                   coalesce(string_agg(cast(id as varchar), ' ' order by pos), '') as ids
            from docs left join ids using (docno) group by docno"""),
        "lm_pack_blocks": with_(*bench_index, WORD_IDS, PACKED, select=f"""
            select batch, block, {spaced('input_ids')} as input_ids from blocks"""),
        "lm_mask": with_(*bench_index, WORD_IDS, PACKED, f"""
places as (
  select batch, block, unnest(input_ids) as id, unnest(range(512)) as i from blocks),
drawn as (
  select *, batch || ':' || block || ':' || i as key from places),
masked as (
  select batch, block, i, id,
         {share('42/choose', 'key')} < 0.25e0 as chosen, {share('42/kind', 'key')} as kind,
         ('0x' || substr(md5('42/word|' || key), 1, 8))::bigint
           % (select count(*) from word_ids) + 2 as other
  from drawn)""", select="""
            select batch, block,
              string_agg(cast(case when not chosen then id when kind < 0.8e0 then 1
                                   when kind < 0.9e0 then other else id end as varchar), ' '
                         order by i) as input_ids,
              string_agg(cast(case when chosen then id else -100 end as varchar), ' '
                         order by i) as labels
            from masked group by batch, block"""),
        "train_pair_scorer": with_(CHAT, TRIPLES, index, *pair_vectors, OKAPI_OF_SIDES, f"""
cosine_of as (
  select l.pair_id, coalesce(sum(l.x * r.x)
           / nullif(sqrt(sum(l.x * l.x)) * sqrt(sum(r.x * r.x)), 0), 0) as cosine
  from lvec l join rvec r on l.pair_id = r.pair_id and l.slot = r.slot group by l.pair_id),
words_of as (
  select pair_id, side, list_distinct({toks('query')}) as q, list_distinct({toks('text')}) as d,
         len({toks('query')}) as lq, len({toks('text')}) as ld from sides),
measured as (
  select pair_id, case when words_of.side = 'positive' then 1 else 0 end as label,
         coalesce(len(list_intersect(q, d)) / nullif(len(q) + len(d) - len(list_intersect(q, d)), 0), 0) as f1,
         coalesce(len(list_intersect(q, d)) / nullif(len(q), 0), 0) as f2,
         coalesce(least(lq, ld) / nullif(greatest(lq, ld), 0), 0) as f3,
         o.score as f4, c.cosine as f5
  from words_of join okapi o using (pair_id) join cosine_of c using (pair_id)),
spread as (
  select stddev_samp(f1) as s1, stddev_samp(f2) as s2, stddev_samp(f3) as s3,
         stddev_samp(f4) as s4, stddev_samp(f5) as s5 from measured),
scaled as materialized (
  select pair_id, label as y, [1.0e0, f1 / s1, f2 / s2, f3 / s3, f4 / s4, f5 / s5] as z
  from measured, spread)""", newton("scaled", 5), select="""
            select pair_id, y as label, round(1 / (1 + exp(-list_dot_product(z, w))), 6) as score
            from scaled, optimum"""),
        "loss_contrastive": with_(CHAT, TRIPLES, index, *pair_vectors, """
distances as (
  select l.pair_id, 1 - coalesce(sum(l.x * r.x)
           / nullif(sqrt(sum(l.x * l.x)) * sqrt(sum(r.x * r.x)), 0), 0) as d,
         case when l.pair_id like '%positive' then 1 else 0 end as y
  from lvec l join rvec r on l.pair_id = r.pair_id and l.slot = r.slot group by l.pair_id)""",
            select="""
            select count(*) as pairs, round(avg(0.5e0 * (y * d * d
                     + (1 - y) * pow(greatest(0.5e0 - d, 0), 2))), 6) as loss from distances"""),
        "loss_bce": with_(TRIPLES, f"""
scored as (
  select {logit('query', 'text')} as s, case when side = 'positive' then 1 else 0 end as y
  from sides)""", select="""
            select count(*) as pairs,
                   round(avg(greatest(s, 0) - s * y + ln(1 + exp(-abs(s)))), 6) as loss
            from scored"""),
    }
