"""Tokens, n-grams and set overlap as column expressions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankbench.functions.binding import bound

# Letters, numbers and underscore of any script.  Java's plain \w is ASCII only.
WORD_PATTERN = r"[\p{L}\p{N}_]+"

# Limits a stored document table may ask for: fixed values.  Nothing applies them
# unless they are passed on.
MAX_TERM_CHARS = 128
MAX_STORED_CHARS = 8192

Tokenizer = Callable[[Column], Column]


def no_tokens() -> Column:
    return F.array().cast("array<string>")


def word_tokens(text: Column) -> Column:
    """Words of a text in order, case kept."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def words(text: Column, lower: bool = True, tokenizer: Tokenizer = word_tokens) -> Column:
    """Token array; a null text has no tokens."""
    return F.coalesce(tokenizer(F.lower(text) if lower else text), no_tokens())


def ngrams(tokens: Column, n: int, sep: str = "_") -> Column:
    """Runs of ``n`` neighbouring tokens, each joined by ``sep``."""

    def of(toks: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(toks) - n)
        grams = F.transform(
            starts, lambda i: F.concat_ws(sep, *[F.get(toks, i + j) for j in range(n)])
        )
        # a sequence with its end below its start counts down, so short arrays need the guard
        return F.when(F.size(toks) >= n, grams).otherwise(no_tokens())

    return bound(tokens, of)


def terms(
    text: Column,
    n_max: int = 1,
    lower: bool = True,
    tokenizer: Tokenizer = word_tokens,
    sep: str = "_",
) -> Column:
    """Unigrams followed by all n-grams up to ``n_max``."""
    tokens = words(text, lower, tokenizer)
    if n_max < 2:
        return tokens
    return bound(
        tokens,
        lambda toks: F.concat(toks, *[ngrams(toks, n, sep) for n in range(2, n_max + 1)]),
    )


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def split_on_space(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def indexable(tokens: Column, most_chars: int | None = None) -> Column:
    """All tokens, or those of at most ``most_chars`` characters."""
    if most_chars is None:
        return tokens
    return F.filter(tokens, lambda t: F.length(t) <= most_chars)


def titled(title: Column, text: Column, mode: str, n_max: int = 1) -> Column:
    """Title and text as one value.

    ``space`` joins with a blank and reads null as empty, ``concat`` joins
    without separator, ``tokens`` puts the title's words before the text's terms.
    """
    if mode == "space":
        return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    if mode == "concat":
        return F.concat(title, text)
    if mode == "tokens":
        return F.concat(words(title), terms(text, n_max))
    raise ValueError(f"unknown title mode: {mode}")


def token_set(text: Column, lower: bool = True) -> Column:
    return F.array_distinct(words(text, lower))


def set_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.coalesce(shared / F.nullif(total, F.lit(0)), F.lit(0.0))


def jaccard(a: Column, b: Column, lower: bool = True) -> Column:
    return set_overlap(token_set(a, lower), token_set(b, lower))


def word_count(text: Column, lower: bool = False) -> Column:
    return F.size(words(text, lower))
