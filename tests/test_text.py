import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankbench.functions import text as tx
from rankbench.functions.vectors import cosine, unit


def one(spark, expression, **values):
    row = spark.createDataFrame(
        [tuple(values.values())], ", ".join(f"{k} string" for k in values)
    )
    return row.select(expression.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, tx.words(F.col("t")), t="Héllo, wörld_1 x²!") == ["héllo", "wörld_1", "x²"]
    for empty in (None, "", "!?"):
        assert one(spark, tx.words(F.col("t")), t=empty) == []


def test_ngrams(spark):
    assert one(spark, tx.terms(F.col("t"), 2), t="a b c") == ["a", "b", "c", "a_b", "b_c"]
    assert one(spark, tx.terms(F.col("t"), 2), t="a") == ["a"]
    assert one(spark, tx.terms(F.col("t"), 3), t="a b c") == ["a", "b", "c", "a_b", "b_c", "a_b_c"]
    assert one(spark, tx.terms(F.col("t"), 3), t=None) == []


def test_title_modes(spark):
    def joined(mode):
        return one(spark, tx.titled(F.col("a"), F.col("b"), mode, 2), a="T x", b="u v")

    assert joined("space") == "T x u v"
    assert joined("concat") == "T xu v"
    assert joined("tokens") == ["t", "x", "u", "v", "u_v"]


def test_jaccard(spark):
    def value(a, b):
        return one(spark, tx.jaccard(F.col("a"), F.col("b")), a=a, b=b)

    assert value("a b", "B c") == 1 / 3
    assert value("", None) == 0.0
    assert value("a a", "a") == 1.0


def test_long_terms_are_dropped_only_when_asked(spark):
    words = tx.words(F.col("t"))
    assert one(spark, tx.indexable(words), t="a " + "b" * 129) == ["a", "b" * 129]
    assert one(spark, tx.indexable(words, 128), t="a " + "b" * 129) == ["a"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=0x17F)), min_size=20, max_size=60))
def test_tokens_as_in_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r["i"]: (r["w"], r["n"]) for r in df.select(
        "i", tx.words(F.col("t"), lower=False).alias("w"), F.size(tx.terms(F.col("t"), 2)).alias("n")
    ).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"\w+", t)
        assert found[i][0] == words
        if words:
            assert found[i][1] == 2 * len(tx_lower(t)) - 1


def tx_lower(t):
    return re.findall(r"\w+", t.lower())


def test_unit_and_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(
        unit(F.col("a")).alias("u"), unit(F.col("b")).alias("z"),
        cosine(F.col("a"), F.col("a")).alias("same"), cosine(F.col("a"), F.col("b")).alias("none"),
    ).first()
    assert row["u"] == [0.6, 0.8] and row["z"] == [0.0, 0.0]
    assert row["same"] == 1.0 and row["none"] == 0.0
