"""Language of texts by interpolated Kneser-Ney character models.

Each language has a character model of order 5: every n-gram's interpolated
probability and every context's back-off weight, in arrays sorted by a 64-bit
hash.  A text goes to the language with the lowest cross-entropy per character.
The distances to the others give a score, calibrated on labelled documents that
the models have not seen, and texts that fit no model as well as such documents
do are rejected.

The models are learned from at most ``PER_LANGUAGE`` labelled documents of each
language and ``SAMPLE`` in all, picked by a hash of the id, whole texts; every
fourth of them is kept for calibration.  Spark counts the n-grams; the counts
of the sample, which bounds them, come to the driver, and the arrays go to the
tasks.  Scoring is one scan.

Texts are lower-cased; characters that are not letters become one space.
Defined results: a null text or one without letters is ``und`` with score 0;
without any labelled document all texts are; ties go to the language first by
name; repeated rows get equal results; an empty table gives an empty result.
Other columns play no part.
"""

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankbench.llm.arrays import text_runs
from rankbench.llm.sampling import draw, enough
from rankbench.session import checkpointed

ORDER = 5
PER_LANGUAGE = 1_000
SAMPLE = 20_000
SEED = 23
UNKNOWN = "und"
# Share of unseen labelled documents whose cross-entropy stays below the limit
# of rejection, and the score below which a text is rejected as well.
ACCEPTED = 0.999
LEAST_SCORE = 0.5
SPACE = 32


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(document of each character, matrix of its ``order`` - 1 predecessors and itself)."""
    low = [t.lower() for t in texts]
    joined = "\n".join([*low, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(codes, 0x10FFFF)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter is a space
    doc = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])[keep]
    kept = np.where(letter, codes, SPACE)[keep].astype(np.uint64)
    first = np.searchsorted(doc, doc)  # where the character's document begins
    place = np.arange(len(kept)) - first
    matrix = np.full((len(kept), order), SPACE, np.uint64)
    for back in range(order):
        column = order - 1 - back
        inside = place >= back
        matrix[inside, column] = kept[np.flatnonzero(inside) - back]
    return doc, matrix


def hashed(matrix: np.ndarray) -> np.ndarray:
    """64-bit hash of each row; its length counts."""
    out = np.full(len(matrix), matrix.shape[1] * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for column in range(matrix.shape[1]):
        out = (out ^ matrix[:, column]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


@dataclass
class CharModel:
    """One language: sorted hashes of n-grams and contexts with their logarithms."""

    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_backoff: np.ndarray
    log_base: float

    def log_probability(self, matrix: np.ndarray) -> np.ndarray:
        """Of each row's last character after the others."""
        order = matrix.shape[1]
        total = np.zeros(len(matrix))
        open_ = np.arange(len(matrix))
        for n in range(order, 0, -1):
            rows = matrix[open_, order - n :]
            found, at = _find(self.grams, hashed(rows))
            total[open_[found]] += self.log_p[at[found]]
            open_, rows = open_[~found], rows[~found]
            if not len(open_):
                return total
            seen, at = _find(self.contexts, hashed(rows[:, :-1]))
            total[open_[seen]] += self.log_backoff[at[seen]]
        total[open_] += self.log_base
        return total


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return (table[at] == keys if len(table) else np.zeros(len(keys), bool)), at


def kneser_ney(matrix: np.ndarray, counts: np.ndarray, characters: int) -> CharModel:
    """Model from distinct highest-order n-grams and their counts.

    Lower orders count the different characters before an n-gram; each order has
    the discount n1 / (n1 + 2 n2), and what it leaves goes to the next lower
    order; the lowest leaves it to ``characters`` equally likely ones.
    """
    order = matrix.shape[1]
    levels = [(matrix, counts.astype(float))]
    for _ in range(order - 1):
        shorter = levels[-1][0][:, 1:]
        _, first, kinds = np.unique(hashed(shorter), return_index=True, return_counts=True)
        levels.append((shorter[first], kinds.astype(float)))
    keys, logs, context_keys, backoffs = [], [], [], []
    lower_keys, lower_p = None, None
    for rows, count in reversed(levels):
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        context, inverse = np.unique(hashed(rows[:, :-1]), return_inverse=True)
        sums = np.bincount(inverse, count)
        left = discount * np.bincount(inverse) / sums
        if lower_keys is None:
            below = np.full(len(rows), 1.0 / characters)
        else:
            _, at = _find(lower_keys, hashed(rows[:, 1:]))
            below = lower_p[at]
        p = np.maximum(count - discount, 0) / sums[inverse] + left[inverse] * below
        own = hashed(rows)
        sort = np.argsort(own)
        lower_keys, lower_p = own[sort], p[sort]
        keys.append(own)
        logs.append(np.log(p))
        context_keys.append(context)
        backoffs.append(np.log(left))
    keys, logs = np.concatenate(keys), np.concatenate(logs)
    context_keys, backoffs = np.concatenate(context_keys), np.concatenate(backoffs)
    by_key, by_context = np.argsort(keys), np.argsort(context_keys)
    return CharModel(
        keys[by_key], logs[by_key], context_keys[by_context], backoffs[by_context],
        -float(np.log(characters)),
    )


@dataclass
class LanguageModel:
    """Models by language, in the order of names, and their calibration."""

    languages: list[str]
    models: list[CharModel]
    sharpness: float
    limit: float

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters of each text, cross-entropy per character by language)."""
        doc, matrix = grams(texts)
        sizes = np.bincount(doc, minlength=len(texts))
        out = np.zeros((len(texts), len(self.models)))
        if len(doc):
            _, first, inverse = np.unique(hashed(matrix), return_index=True, return_inverse=True)
            distinct = matrix[first]
            for k, model in enumerate(self.models):
                log_p = model.log_probability(distinct)[inverse]
                out[:, k] = -np.bincount(doc, log_p, len(texts)) / np.maximum(1, sizes)
        return sizes, out

    def scores(self, sizes: np.ndarray, entropy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best language, its share of the calibrated weights)."""
        best = entropy.argmin(1)
        return best, _share(entropy, sizes, self.sharpness)[np.arange(len(best)), best]


def _share(entropy, sizes, sharpness):
    distance = entropy - entropy.min(1, keepdims=True)
    weight = np.exp(-distance * sharpness * np.sqrt(sizes)[:, None])
    return weight / weight.sum(1, keepdims=True)


def sample_of(
    docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE, seed: int = SEED
) -> DataFrame:
    """Rows (text, lang, check) of labelled documents; every fourth is for checking.

    The chosen ids, at most ``most``, are broadcast; texts do not move.  Runs jobs.
    """
    order = draw(seed, "doc_id")
    known = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang")
    # one row for each language, and so for each model that will be held
    totals = known.groupBy("lang").count().collect()
    bars = [F.lit(x) for r in totals for x in (r["lang"], float(enough(per_language, r["count"])))]
    if not bars:
        bars = [F.lit(""), F.lit(0.0)]
    # rows that can't be among the first of their language stay where they lie
    near = known.where(order < F.create_map(*bars)[F.col("lang")])
    ranked = near.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    )
    chosen = (
        ranked.where(F.col("_rank") <= per_language)
        .orderBy("_rank", "lang")
        .limit(most)
        .select("doc_id", "lang", (F.col("_rank") % 4 == 0).alias("check"))
        .dropDuplicates(["doc_id", "lang"])
    )
    return checkpointed(
        docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    )


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, characters of the n-gram, count), summed within runs of texts."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in dict.fromkeys(langs):
            own = batch.filter(pa.array([v == lang for v in langs]))
            for texts in text_runs(own.column("text")):
                _, matrix = grams(texts)
                if not len(matrix):
                    continue
                _, first, counts = np.unique(hashed(matrix), return_index=True, return_counts=True)
                rows = matrix[first].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(rows)), *map(pa.array, rows.T), pa.array(counts)],
                    ["lang", *[f"c{k}" for k in range(ORDER)], "n"],
                )


def learn(sample: DataFrame) -> LanguageModel:
    """Models and calibration from rows (text, lang, check).  Runs jobs."""
    columns = [f"c{k}" for k in range(ORDER)]
    schema = f"lang string, {', '.join(f'{c} int' for c in columns)}, n long"
    parts = sample.where("not check").select("lang", "text").mapInArrow(_gram_counts, schema)
    counted = parts.groupBy("lang", *columns).agg(F.sum("n").alias("n")).toArrow()
    found = np.array(counted.column("lang").to_pylist(), object)
    matrix = np.stack([counted.column(c).to_numpy() for c in columns], 1).astype(np.uint64)
    counts = counted.column("n").to_numpy()
    languages = sorted(set(found.tolist()))
    characters = max(2, len(np.unique(matrix[:, -1])) + 1)
    models = [kneser_ney(matrix[found == v], counts[found == v], characters) for v in languages]
    model = LanguageModel(languages, models, 1.0, float("inf"))
    if not languages:
        return model
    held = checked_entropies(sample.where("check"), model)
    if held:
        sizes = np.array([r["size"] for r in held], float)
        entropy = np.array([r["entropy"] for r in held], float)
        truth = np.array([languages.index(r["lang"]) for r in held])
        losses = {
            s: -np.log(_share(entropy, sizes, s)[np.arange(len(truth)), truth] + 1e-12).mean()
            for s in 2.0 ** np.arange(-4, 7)
        }
        model.sharpness = float(min(losses, key=losses.get))
        model.limit = float(np.quantile(entropy.min(1), ACCEPTED))
    return model


def checked_entropies(sample: DataFrame, model: LanguageModel) -> list:
    """Rows (lang, size, entropy by language); one for each sampled document with letters."""
    shared = sample.sparkSession.sparkContext.broadcast(model)
    known = sample.where(F.col("lang").isin(model.languages))

    @F.arrow_udf("size long, entropy array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        sizes, rows = [], []
        for run in text_runs(texts):
            n, entropy = shared.value.entropies(run)
            sizes += n.tolist()
            rows += entropy.tolist()
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["size", "entropy"]
        )

    measured_rows = known.select("lang", measured("text").alias("m")).select("lang", "m.size", "m.entropy")
    return measured_rows.where("size > 0").collect()


def identify(text: Column, model: LanguageModel, spark) -> Column:
    """Struct (lang, best, score, entropy): ``best`` is the nearest language,
    ``lang`` the same or ``und`` where the text is rejected."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, best string, score double, entropy double")
    def identified(texts: pa.Array) -> pa.Array:
        own = shared.value
        lang, best, score, least = [], [], [], []
        for run in text_runs(texts):
            if not own.models:
                lang += [UNKNOWN] * len(run)
                best += [UNKNOWN] * len(run)
                score += [0.0] * len(run)
                least += [None] * len(run)
                continue
            sizes, entropy = own.entropies(run)
            nearest, share = own.scores(sizes, entropy)
            for n, k, s, h in zip(sizes, nearest, share, entropy.min(1)):
                name = own.languages[k] if n else UNKNOWN
                best.append(name)
                score.append(float(s) if n else 0.0)
                least.append(float(h) if n else None)
                lang.append(name if n and h <= own.limit and s >= LEAST_SCORE else UNKNOWN)
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(least, pa.float64())],
            ["lang", "best", "score", "entropy"],
        )

    return identified(text)
