"""Merkle manifest: trees, proofs and folded roots against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import compare
import pytest
from pyspark.sql import functions as F

from rankbench.llm import merkle
from rankbench.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        below = found[-1]
        found.append([digest(*below[k : k + 8]) for k in range(0, len(below), 8)])
    return found


def path(levels, at):
    found = []
    for nodes in levels[:-1]:
        run = at // 8 * 8
        found.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])))
        at //= 8
    return found


def altered(row):
    doc_id, *_, text = row
    if doc_id is None or text is None or zlib.crc32(str(doc_id).encode()) % 3:
        return row
    return (*row[:-1], text.translate(LOWER))


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for members in groups.values():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    root = top[-1][0] if langs else None
    out = []
    for k, g in enumerate(langs):
        for i, row in enumerate(groups[g]):
            siblings = path(trees[g], i) + path(top, k)
            folded = leaf(altered(row))
            for a, b in siblings:
                folded = digest(a, folded, b)
            proof = digest(*(a + b for a, b in siblings))
            out.append((row[0], leaf(row), trees[g][-1][0], root, proof, folded, folded == root))
    return Counter(out)


def found(spark, rows, parts=5):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    docs = docs.withColumn("g", F.lit("clash")).withColumn("pos", F.lit(1)).withColumn("h", F.lit(2))
    changed = F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.lowered(F.col("text"))
    )
    got = merkle.proofs(merkle.manifest(docs, changed))
    return Counter(tuple(r) for r in got.collect())


def some_rows(n, langs, seed=3, spread=1):
    draw = random.Random(seed)
    ids = draw.sample(range(-n * spread, n * spread), n)
    return [
        (i, draw.choice(["a", "ü", None]), draw.choice(langs), draw.choice([None, 5]),
         draw.choice([None, "", "abc", "AbÄ", "X" * 5000]))
        for i in ids
    ]


@pytest.mark.parametrize(
    "n, langs, spread",
    [
        (1, ["en"], 1),
        (9, ["en", None], 1),
        (700, ["en"], 1),  # more than one array, a last run of one
        (1300, ["en", "de", None, "", "日本"] + [f"l{k}" for k in range(60)], 1),
        (5000, ["en", "en", "en", "fr"], 10**14),  # sparse ids over all of the long range
    ],
)
def test_against_plain_python(spark, n, langs, spread):
    rows = some_rows(n, langs, spread=spread)
    assert found(spark, rows) == expected(rows)


def test_repeats_and_nulls(spark):
    rows = some_rows(300, ["en", None])
    rows += [(7, "s", "en", 1, f"t{k % 5}") for k in range(600)]  # one id, few texts
    rows += [(None, "s", "en", k, "x") for k in range(30)] + [(None, None, None, None, None)] * 3
    rows += [(-(2**63), "s", "en", 1, "low"), (2**63 - 1, "s", "en", 1, "high"), (63, "s", "en", 1, "x")]
    assert found(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert found(spark, []) == Counter()


def test_one_changed_leaf_is_told(spark):
    rows = [(k, "s", "en", 1, "Text") for k in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    changed = F.when(F.col("doc_id") == 42, F.lit("other"))
    got = merkle.proofs(merkle.manifest(docs, changed)).where("not verified").collect()
    assert [r["doc_id"] for r in got] == [42]
    assert all(r["verified"] for r in merkle.proofs(merkle.manifest(docs)).collect())


def test_unaltered_leaves_are_folded_too(spark):
    rows = [(k, "s", "en" if k % 2 else "de", 1, "Text") for k in range(30)]
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    wrong = F.transform("left", lambda h: F.concat(h, F.lit("0")))
    broken = merkle.Manifest(made.leaves, made.above.withColumn("left", wrong))
    got = merkle.proofs(broken).collect()
    assert len(got) == 30
    assert not any(r["verified"] or r["folded_root"] == r["root"] for r in got)


def test_query_against_sql(spark, sf_dir):
    name = "op12_merkle_manifest"
    tables = compare.connect(sf_dir)
    assert compare.spark_rows(QUERIES[name](spark, sf_dir)) == compare.sql_rows(tables, ORACLES[name])
