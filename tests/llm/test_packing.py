"""Packing: ids as the tokenizer gives them, gapless sequences, few of them."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankbench.llm import packing
from rankbench.llm.queries import QUERIES, word_bpe_path

PATH = word_bpe_path()
SIZE = packing.SEQUENCE
TOKENIZER = Tokenizer.from_file(PATH)


def reference_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def verify(rows, texts, size=SIZE):
    """Pieces rebuild every document, sequences are gapless; number of sequences."""
    ids = {i: [*reference_ids(t), 1] for i, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, parts in by_doc.items():
        assert sorted(parts) == [
            (k, b, min(size, len(ids[i]) - b)) for k, b in enumerate(range(0, len(ids[i]), size))
        ]
    assert set(by_doc) == set(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


TEXTS = [
    None, "", " \n ", "a", "It's  we'll DON'T 'S", "ÀÉÎ ñandú Straße µ ª º × ÷",
    "x²³¹¼½ 12345 3.14", "日本語 テキスト mixed", "<|endoftext|> and <|startoftext|>x", "😀😀 ok",
    "tab\tnbsp nel\u0085end", "file\x1csep\x1funit", "İstanbul ΑΣ", "é combining", "!!! ... ???--- a-b_c",
    "con­soft", "w" * 5000, "long words " * 9000,
]


def test_ids_are_those_of_the_tokenizer():
    fast = packing.WordTokenizer(PATH)
    rng = random.Random(0)
    alphabet = "abcXYZ 019'sS.,!?\n\t \u0085­²½ªµ×éÀßÿ"
    texts = [t or "" for t in TEXTS]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(fast.ids(text), "<u4").tolist() == reference_ids(text), repr(text)


def test_pack_small(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit(1))
    verify(packing.pack(docs, PATH).collect(), dict(rows))
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b")] * 3 + [(None, "c"), (None, "c d")], "doc_id long, text string")
    rows = packing.pack(docs, PATH).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 3, None: 2}
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 5
    assert len({r["sequence_id"] for r in rows}) == 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_the_histogram(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 300))
    counts = rng.poisson(rng.choice([0.2, 3, 50]), size + 1)
    groups = packing.plan(counts, size)
    held = np.zeros(size + 1, int)
    for content, n in groups:
        assert sum(content) <= size
        for length in content:
            held[length] += n
    assert (held[1:] == counts[1:]).all()
    least = -(-(counts * np.arange(size + 1)).sum() // size)
    big = counts[size // 2 + 1 :].sum()
    assert sum(n for _, n in groups) <= 1.15 * max(least, big) + 1


def test_fit_comes_near_the_histogram():
    rng = np.random.default_rng(1)
    counts = rng.integers(50, 100, 65)
    counts[0] = 0
    patterns, repeats = packing.fitted(packing.exact_patterns(counts, 64, 4, 5000), counts)
    assert (repeats >= 0).all() and (patterns.sum(1) == 64).all()
    made = np.bincount(patterns.ravel(), np.repeat(repeats, 4), 65)
    made[0] = 0
    assert np.abs(made - counts)[1:33].sum() < 0.2 * counts[1:33].sum()


def test_query_on_the_table(spark, sf_dir):
    rows = QUERIES["op4_pattern_packing"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    used = verify(rows, {d["doc_id"]: d["text"] for d in docs})
    least = -(-sum(r["length"] for r in rows) // SIZE)
    assert used <= 1.01 * least + 1


def test_every_plan_has_fitted_patterns():
    """No plan is best fit alone, and what the patterns take fills sequences exactly."""
    assert all(share > 0 for share in packing.SHARES)
    counts = np.zeros(101, np.int64)
    counts[[30, 70, 45, 55, 20]] = [40, 40, 25, 25, 50]
    groups = packing.plan(counts, 100)
    # a plan by fitted patterns whose sequences are nearly all full
    assert sum(n for _, n in groups) <= 76
    full = [(c, n) for c, n in groups if 2 <= len(c) <= packing.PATTERN_PIECES and sum(c) == 100]
    assert sum(n for _, n in full) >= 50
