"""Secrets in texts: base patterns, and Markov models of random strings.

Base spans come from three patterns.  The method adds strings that no pattern
names: candidates are long runs of token characters; a character Markov model
of random strings and one of ordinary identifiers, trained from labelled
samples, give each candidate a log-likelihood ratio per character, and those
above a threshold are spans of kind ``markov``.

Everything is DataFrame functions.  Positions come from the texts between the
matches: their lengths and the matches' lengths add up to starts and ends in
code points.  Texts stay where they are; only the model's transition counts
move, of which there are at most 66 x 66 for each label whatever the input.

Defined results: null and empty texts have no spans; a base match that fails
its length is dropped but its characters stay used up for that kind; spans of
different kinds may overlap, but a ``markov`` span never overlaps a base span (a
run that touches one is that span's, with all its characters);
repeated rows give repeated results; without samples of both labels the method
adds nothing; an empty table gives an empty result.  Other columns play no part.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankbench.functions.binding import bound
from rankbench.llm.rows import row_fields, whole_row
from rankbench.llm.sampling import first_by_hash
from rankbench.session import checkpointed

# The base patterns, their least lengths, and the kinds' order.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

# Longest possible matches of the last two are those of at least their length,
# so shorter ones need not be listed.
_ACCESS_LONG = rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}"
_HEX_LONG = rf"[0-9a-f]{{{LEAST_HEX},}}"

# Candidates of the method: whole runs of this many token characters or more.  What
# they are made of is for the models to judge.
LEAST_CANDIDATE = 12
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_CANDIDATE},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Nats per character that the ratio must exceed: 0 where the random model is the likelier one.
THRESHOLD = 0.0
# Labelled samples of each label that the models are fitted on, at most.
SAMPLES = 20_000
SEED = 31
SMOOTHING = 0.5

SPAN = "array<struct<kind:int,start:long,end:long>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def _placed(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of all matches, those that ``keep(match)`` refuses left out."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def spans(found: Column, between: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), _none().alias("spans"), F.lit(0).alias("i"))

        def step(state, match):
            begin = state["at"] + F.get(between, state["i"])
            end = begin + F.length(match)
            one = F.array(
                F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"))
            ).cast(SPAN)
            return F.struct(
                end.alias("at"),
                F.when(keep(match), F.concat(state["spans"], one)).otherwise(state["spans"]).alias("spans"),
                (state["i"] + 1).alias("i"),
            )

        return F.aggregate(found, start, step, lambda state: state["spans"])

    return F.when(
        text.rlike(pattern), bound(matches, lambda found: bound(gaps, lambda g: spans(found, g)))
    ).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Spans (kind, start, end) of the base patterns, by start and kind."""
    value = F.coalesce(text, F.lit(""))

    def long_enough(match):
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= LEAST_VALUE

    every = F.lit(True)
    found = F.concat(
        _placed(value, ASSIGN, 0, long_enough),
        _placed(value, _ACCESS_LONG, 1, lambda m: every),
        _placed(value, _HEX_LONG, 2, lambda m: every),
    )
    return _ordered(found)


def _ordered(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return F.transform(
        F.array_sort(keyed),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )


def candidates(text: Column) -> Column:
    """Spans of kind ``markov`` still to be judged."""
    return _placed(F.coalesce(text, F.lit("")), CANDIDATE, 3, lambda m: F.lit(True))


def labelled_samples(docs: DataFrame, most: int = SAMPLES) -> DataFrame:
    """Rows (value, random): strings that the corpus itself labels.

    Values of base matches are random strings, words of letters ordinary
    identifiers, both from all texts.  A hash of the value picks the same ones on every run; at most
    ``most`` distinct values of each label are kept.  Runs jobs.
    """
    text = F.coalesce("text", F.lit(""))
    secret = F.concat(
        F.filter(
            F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST_VALUE
        ),
        F.regexp_extract_all(text, F.lit(_ACCESS_LONG), F.lit(0)),
        F.regexp_extract_all(text, F.lit(_HEX_LONG), F.lit(0)),
    )
    any_base = f"(?:{ASSIGN})|(?:{_ACCESS_LONG})|(?:{_HEX_LONG})"
    randoms = (
        docs.where(text.rlike(any_base))
        .select(F.explode(secret).alias("value"), F.lit(1).alias("random"))
        .distinct()
    )
    plain = (
        docs.select(
            F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z_]{6,}"), F.lit(0))).alias("value"),
            F.lit(0).alias("random"),
        )
        .distinct()
    )
    picked = [first_by_hash(checkpointed(part), most, SEED, "value") for part in (randoms, plain)]
    return picked[0].unionByName(picked[1])


def train(samples: DataFrame, alphabet: str = ALPHABET, smoothing: float = SMOOTHING) -> list[list[float]] | None:
    """Log-likelihood ratios [previous][next] of rows (value, random).

    The last index stands for any other character; row 0 of ``previous`` is the
    start.  Counts are summed by Spark; at most one row for each pair of
    characters and label comes back.  None if a label has no sample.
    """
    size = len(alphabet) + 1  # any other character
    code = _codes(F.col("value"), alphabet)
    steps = samples.select("random", code.alias("codes")).select(
        "random",
        F.explode(
            F.zip_with(
                F.concat(F.array(F.lit(0)), F.transform("codes", lambda c: c + 1)),
                F.col("codes"),
                lambda a, b: F.struct(a.alias("a"), b.alias("b")),
            )
        ).alias("step"),
    )
    counted = (
        steps.where("step.b is not null").groupBy("random", "step.a", "step.b").count().collect()
    )
    counts = {label: [[smoothing] * size for _ in range(size + 1)] for label in (0, 1)}
    for row in counted:
        counts[row["random"]][row["a"]][row["b"]] += row["count"]
    if {row["random"] for row in counted} != {0, 1}:
        return None
    ratio = []
    for ordinary, random in zip(counts[0], counts[1]):
        n0, n1 = sum(ordinary), sum(random)
        ratio.append([math.log(r / n1) - math.log(o / n0) for o, r in zip(ordinary, random)])
    return ratio


def _codes(value: Column, alphabet: str) -> Column:
    """Index of each character; ``len(alphabet)`` for any other."""
    characters = F.filter(F.split(value, ""), lambda c: c != "")
    places = F.transform(characters, lambda c: F.position(c, F.lit(alphabet)) - 1)
    return F.transform(places, lambda p: F.when(p < 0, F.lit(len(alphabet))).otherwise(p))


def score(value: Column, ratio: list[list[float]], alphabet: str = ALPHABET) -> Column:
    """Log-likelihood ratio per character, random against ordinary."""
    width = len(alphabet) + 1
    # one literal, as text: a column call for each number would be slow to build
    written_out = ",".join(repr(x) for row in ratio for x in row)
    flat = F.split(F.lit(written_out), ",").cast("array<double>")

    def of(table: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("previous"))
        total = F.aggregate(
            _codes(value, alphabet),
            start,
            lambda s, c: F.struct(
                (s["sum"] + F.get(table, s["previous"] * width + c)).alias("sum"),
                (c + 1).alias("previous"),
            ),
            lambda s: s["sum"],
        )
        return total / F.greatest(F.length(value), F.lit(1))

    return bound(flat, of)


def scan(docs: DataFrame, ratio: list[list[float]] | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``_base`` and ``_spans``, arrays of (kind, start, end)."""
    with_base = docs.withColumn("_base", base_spans(F.col("text")))
    if ratio is None:
        return with_base.withColumn("_spans", F.col("_base"))
    text = F.coalesce(F.col("text"), F.lit(""))

    def judged(span: Column) -> Column:
        value = F.substring(text, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        free = ~F.exists("_base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
        return free & (bound(value, lambda v: score(v, ratio)) > threshold)

    return (
        with_base.withColumn("_candidates", candidates(F.col("text")))
        .withColumn(
            "_spans",
            F.when(F.size("_candidates") == 0, F.col("_base")).otherwise(
                _ordered(F.concat("_base", F.filter("_candidates", judged)))
            ),
        )
        .drop("_candidates")
    )


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])
        ),
        ",",
    )


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def mask(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every span replaced by ``mark``, overlapping spans by one."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state, span):
        between = F.substring(
            text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int")
        )
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(span["start"] >= state["at"], F.concat(state["out"], between, F.lit(mark)))
            .otherwise(state["out"])
            .alias("out"),
        )

    def ended(state):
        rest = F.substring(text, (state["at"] + 1).cast("int"), F.length(text))
        return F.concat(state["out"], rest)

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, ended))


def masked(docs: DataFrame, ratio: list[list[float]] | None) -> DataFrame:
    """``docs`` with secrets masked in ``text``; a null text stays null.

    A column ``n_chars``, where there is one, is counted anew for changed texts.
    """
    rows = docs.select("text", whole_row(docs).alias("row"))
    scanned = scan(rows, ratio)
    new = mask(F.col("text"), F.col("_spans"))
    fields = dict(zip(docs.columns, row_fields(docs)))
    fields["text"] = new.alias("text")
    if "n_chars" in fields:
        counted = F.length(new).cast(docs.schema["n_chars"].dataType)
        changed = F.size("_spans") > 0
        fields["n_chars"] = F.when(changed, counted).otherwise(F.col("row")["n_chars"]).alias("n_chars")
    return scanned.select(*fields.values())
