"""Toxicity of texts by a weighted lexicon.

Texts are folded first: compatibility forms, accents, zero-width characters,
look-alike letters of other scripts and digits that stand for letters.  An
Aho-Corasick automaton finds lexicon entries at the starts of words; each word
counts with its heaviest entry, unless an exception phrase covers it.  The sum
of weights, and the sum for each word of the text, give a probability by a
logistic curve.

The lexicon is learned from labelled documents: whole words and word beginnings
that are far more frequent in toxic documents, weighted by their log-odds;
exception phrases are word pairs around an entry that only clean documents use.
Learning reads at most ``SAMPLE`` labelled documents, picked by a hash of the
id; one half gives the lexicon, the other the curve.  Scoring is one scan: only
the learned model, bounded by the sample, goes to the tasks.

Defined results: null, empty and wordless texts score as texts without a match;
without labelled documents of both kinds the score is the share of toxic ones
(0 without any); a doc_id with several labels is toxic if one of them is;
repeated rows score alike; an empty table gives an empty result.  Other columns
play no part.
"""

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankbench.llm.sampling import first_by_hash
from rankbench.session import checkpointed

# Labelled documents that a model is learned from, at most.
SAMPLE = 20_000
SEED = 17
# Items that a task counts before it gives out their counts so far.
HELD_ITEMS = 65_536
# Word beginnings of these lengths may become entries.
PREFIXES = (4, 5, 6, 7, 8)
# An entry's likelihood-ratio statistic and log-odds, at least.
LEAST_STATISTIC = 25.0
LEAST_WEIGHT = 3.5
# A longer entry must weigh that much more than a shorter one that covers it.
GAIN = 0.5
# Uses of an exception phrase in clean documents, at least.
LEAST_EXCEPTION = 3
RIDGE = 0.01

# Look-alikes of Latin letters, and digits and signs used as letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x",
    "ß": "ss", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "æ": "ae", "œ": "oe",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

_FOLD = str.maketrans(
    HOMOGLYPHS
    | {chr(c): None for c in range(0x300, 0x370)}  # combining marks
    # invisible: soft hyphen, zero-width space, joiners, word joiner, byte order mark
    | dict.fromkeys("\u00ad\u200b\u200c\u200d\u2060\ufeff")
)
_LEET = str.maketrans(LEET)
_MIXED = re.compile(r"[\w@$!|]*(?:[a-z][0134578@$!|]|[0134578@$!|][a-z])[\w@$!|]*")
_BREAKS = re.compile(r"[\W_]+")


def _letters(match: re.Match) -> str:
    token = match[0]
    core = token.rstrip("@$!|")  # signs at the end are punctuation
    return core.translate(_LEET) + " " * (len(token) - len(core))


def fold(text: str | None) -> str:
    """Words in folded form with one space before, between and after them."""
    low = (text or "").lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low).translate(_FOLD).lower()
    return f" {_BREAKS.sub(' ', _MIXED.sub(_letters, low)).strip()} "


@dataclass(frozen=True)
class Model:
    """Entries `` beginning`` or `` word `` with weights, exception phrases, curve."""

    weights: dict[str, float]
    exceptions: frozenset[str]
    curve: tuple[float, ...]

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight, False))
        for phrase in self.exceptions:
            # the phrase `` first second `` excuses the entry words in it
            found.add_word(phrase, (len(phrase), 0.0, True))
        if len(found):
            found.make_automaton()
        return found


def matches(folded: str, automaton) -> dict[int, float]:
    """Heaviest weight at each word start that has a match, exceptions left out."""
    if not len(automaton):
        return {}
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for last, (length, weight, exception) in automaton.iter(folded):
        start = last - length + 1
        if exception:
            excused.append((start, last))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    for start, last in excused:
        for at in [a for a in best if start <= a < last]:
            del best[at]
    return best


def measures(text: str | None, automaton) -> tuple[float, float]:
    """(sum of weights, sum for each word of the text)."""
    folded = fold(text)
    total = sum(matches(folded, automaton).values())
    return total, total / max(1, folded.count(" ") - 1)


def _inputs(total, rate):
    return np.stack([np.ones_like(total), np.log1p(total), np.log1p(100 * rate)], axis=-1)


def fit_curve(total: np.ndarray, rate: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small ridge, by Newton steps."""
    x = _inputs(total, rate)
    w = np.zeros(3)
    ridge = RIDGE * np.diag([1e-3, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(3)
        step = np.linalg.solve(hessian, x.T @ (toxic - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has that remainder; false for a null id."""
    digest = F.crc32(F.encode(doc_id.cast("string"), "utf-8"))
    return F.coalesce(F.pmod(digest, F.lit(modulus)) == remainder, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, text, toxic, half) of at most ``most`` labelled documents.

    ``labels`` has (doc_id, toxic).  The chosen ids, at most ``most``, are
    broadcast; texts do not move.  Runs a job.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    chosen = first_by_hash(known, most, seed, "doc_id").withColumn(
        "half", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(2))
    )
    return checkpointed(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    )


def _features(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) >= 3} | {
        f" {w[:n]}" for w in words for n in PREFIXES if len(w) >= n
    }


def _counted(sample: DataFrame, make) -> DataFrame:
    """Number of documents that have each item of ``make()(text)``, summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        of = make()

        def out():
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["item", "n"],
            )
            counts.clear()
            return rows

        for batch in batches:
            for text in batch.column("text"):
                counts.update(of(text.as_py()))
                if len(counts) > HELD_ITEMS:
                    yield out()
        if counts:
            yield out()

    parts = sample.select("text").mapInArrow(run, "item string, n long")
    return parts.groupBy("item").agg(F.sum("n").alias("n"))


def learn(sample: DataFrame) -> Model:
    """Model from rows (text, toxic, half); half 0 gives the lexicon, half 1 the curve.

    What comes to the driver are the entries that tell the labels apart and the
    exceptions, out of a sample of bounded size.
    """
    toxic, clean = (sample.where(f"half = 0 and toxic = {t}") for t in (1, 0))
    n_toxic, n_clean = toxic.count(), clean.count()
    support = max(3, n_toxic // 200)

    def features():
        return lambda text: _features(fold(text))

    in_toxic = checkpointed(_counted(toxic, features).where(F.col("n") >= support))
    in_clean = _counted(clean, features).withColumnRenamed("n", "clean")
    both = in_toxic.join(in_clean, "item", "left").select(
        "item", "n", F.coalesce("clean", F.lit(0)).alias("clean")
    )
    told = both.where(telling(n_toxic, n_clean)).collect()
    weights = select_entries(
        {r["item"]: r["n"] for r in told}, {r["item"]: r["clean"] for r in told}, n_toxic, n_clean
    )

    plain = Model(weights, frozenset(), ())
    exceptions = frozenset()
    if weights:
        harmless = _counted(clean, lambda: _phrases(plain)).where(F.col("n") >= LEAST_EXCEPTION)
        used = _counted(toxic, lambda: _phrases(plain)).select("item")
        exceptions = frozenset(r["item"] for r in harmless.join(used, "item", "left_anti").collect())
    model = Model(weights, exceptions, ())

    @F.arrow_udf("total double, rate double")
    def measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = model.automaton()
        for part in texts:
            found = [measures(t.as_py(), automaton) for t in part]
            yield pa.StructArray.from_arrays(
                [pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)], ["total", "rate"]
            )

    rows = (
        sample.where("half = 1")
        .select("toxic", measured("text").alias("m"))
        .select("toxic", "m.total", "m.rate")
        .collect()
    )
    labels = np.array([r["toxic"] for r in rows], float)
    if len(set(labels)) < 2:  # too few to fit: the share of toxic ones
        share = np.array([r["toxic"] for r in sample.select("toxic").collect()], float)
        p = float(np.clip(share.mean(), 1e-6, 1 - 1e-6)) if len(share) else 1e-6
        curve = (float(np.log(p / (1 - p))), 1.0 if weights else 0.0, 0.0)
    else:
        curve = fit_curve(
            np.array([r["total"] for r in rows]), np.array([r["rate"] for r in rows]), labels
        )
    return Model(weights, exceptions, curve)


def _phrases(model: Model):
    """Function of a text: pairs of a matched word with the words before and after."""
    automaton = model.automaton()

    def of(text: str | None) -> set[str]:
        folded = fold(text)
        words = folded.split()
        starts, at = {}, 0
        for k, word in enumerate(words):
            starts[at] = k
            at += len(word) + 1
        found = set()
        for start in matches(folded, automaton):
            k = starts[start]
            if k:
                found.add(f" {words[k - 1]} {words[k]} ")
            if k + 1 < len(words):
                found.add(f" {words[k]} {words[k + 1]} ")
        return found

    return of


def telling(n_toxic: int, n_clean: int) -> Column:
    """Whether an item in ``n`` toxic and ``clean`` clean documents passes both bars.

    A little below them: :func:`select_entries` decides.
    """
    t, n = F.col("n"), F.col("clean")
    share = n_toxic / max(1, n_toxic + n_clean)
    weight = F.ln((t + 0.5) / (n_toxic + 1)) - F.ln((n + 0.5) / (n_clean + 1))
    statistic = 2 * t * F.ln(t / ((t + n) * share))
    if share < 1:
        statistic += F.when(n > 0, 2 * n * F.ln(n / ((t + n) * (1 - share)))).otherwise(0.0)
    return (weight >= LEAST_WEIGHT - 1e-6) & (statistic >= LEAST_STATISTIC - 1e-6)


def select_entries(
    in_toxic: dict[str, int], in_clean: dict[str, int], n_toxic: int, n_clean: int
) -> dict[str, float]:
    """Entries with their log-odds: significant, and not covered by a shorter one."""
    kept: dict[str, float] = {}
    share = n_toxic / max(1, n_toxic + n_clean)
    for entry in sorted(in_toxic, key=lambda e: (len(e), e)):
        t, n = in_toxic[entry], in_clean.get(entry, 0)
        weight = np.log((t + 0.5) / (n_toxic + 1)) - np.log((n + 0.5) / (n_clean + 1))
        statistic = 2 * t * np.log(t / ((t + n) * share))
        if n:
            statistic += 2 * n * np.log(n / ((t + n) * (1 - share)))
        if weight < LEAST_WEIGHT or statistic < LEAST_STATISTIC:
            continue
        shorter = [kept.get(entry[:k], 0.0) for k in range(2, len(entry))]
        if max(shorter, default=0.0) + GAIN >= weight:
            continue
        kept[entry] = float(weight)
    return kept


def score(text: Column, model: Model) -> Column:
    """Probability that a text is toxic."""

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = model.automaton()
        curve = np.array(model.curve)
        for part in texts:
            found = np.array([measures(t.as_py(), automaton) for t in part]).reshape(-1, 2)
            x = _inputs(found[:, 0], found[:, 1]) @ curve
            yield pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))

    return scored(text)
