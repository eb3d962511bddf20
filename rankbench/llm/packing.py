"""Packing token sequences by patterns fitted with non-negative least squares.

Documents longer than a sequence are cut into whole pieces.  The pieces'
lengths make a histogram with one bin for each length, which is as large for any
number of documents.  Patterns of two to four lengths that fill a sequence
exactly are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares, and rounded within what the histogram holds.  The
residual is packed best fit, longest first, by whole runs of equal lengths.

That plan is a table of runs (length, first rank, last rank, first sequence,
offset).  Pieces are numbered within their length over hash buckets, and each
finds its run by its rank: so the corpus is tokenised once and neither texts nor
tokens move.

Defined results: a null text is empty; an empty text is the end token alone;
repeated rows are packed each for itself; a row whose doc_id is null is packed
too; an empty table gives an empty result.  Other columns play no part.
"""

import functools
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankbench.llm.arrays import text_runs
from rankbench.operators.numbering import number_by_digest
from rankbench.session import checkpointed

SEQUENCE = 4096
END_ID = 1
PATTERN_PIECES = 4
PATTERNS = 60_000
FIT_STEPS = 200
# Shares of the histogram that the patterns are fitted to.
SHARES = (1.0, 0.9, 0.75, 0.5)
# Words whose ids a task remembers, at most; then it forgets them all.
REMEMBERED = 400_000


class WordTokenizer:
    """Token ids of texts, as the tokenizer file gives them, with a memory of words.

    A text of Latin-1 characters is cut where the file's own pattern cuts it, and
    each word is merged once by the file's own model; any other text goes to the
    tokenizer whole.  Both ways give the same ids.
    """

    # The pattern of the tokenizer file, for characters below U+0100.
    LETTER = "a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ"
    NUMBER = "0-9²³¹¼½¾"
    WORD = re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+"
    )

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # byte-level alphabet: printable bytes stand for themselves, others follow from U+0100
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            spelled = piece.encode("utf-8").decode("latin-1").translate(self.alphabet)
            ids = [token.id for token in self.model.tokenize(spelled)]
            found = np.array(ids, "<u4").tobytes()
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if "<|" in text or not _latin(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        words, out = self.words, []
        for word in text.lower().split():
            found = words.get(word)
            if found is None:
                found = words[word] = b"".join(map(self._piece, self.WORD.findall(word)))
            out.append(found)
        return b"".join(out)


def _latin(text: str) -> bool:
    # U+001C to U+001F count as white space for str.split alone
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return not any(c in text for c in "\x1c\x1d\x1e\x1f")


@functools.lru_cache(maxsize=2)
def tokenizer_at(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, most: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): documents cut at ``most`` tokens."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(path)
        for batch in batches:
            at = 0
            for texts in text_runs(batch.column("text")):
                row, piece, start, length, crc = [], [], [], [], []
                for k, text in enumerate(texts):
                    raw = tokenizer.ids(text) + end
                    for number, begin in enumerate(range(0, len(raw), 4 * most)):
                        part = raw[begin : begin + 4 * most]
                        row.append(at + k)
                        piece.append(number)
                        start.append(begin // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def exact_patterns(counts: np.ndarray, size: int, parts: int, most: int, seed: int = 3) -> np.ndarray:
    """Rows of ``parts`` lengths, padded by 0, that add up to ``size`` and all occur.

    All patterns of two lengths, and of more lengths a seeded draw: the first
    lengths drawn from the histogram, the last one what is left.
    """
    present = np.flatnonzero(counts[: size + 1])
    present = present[present > 0]
    if not len(present):
        return np.zeros((0, parts), np.int64)
    other = size - present
    pairs = np.stack([present, other], 1)[(other > 0) & (present <= other)]
    pairs = pairs[counts[pairs[:, 1]] > 0]
    found = [np.pad(pairs, ((0, 0), (0, parts - 2)))]
    rng = np.random.default_rng(seed)
    chance = counts[present] / counts[present].sum()
    for n in range(3, parts + 1):
        drawn = rng.choice(present, (most, n - 1), p=chance)
        last = size - drawn.sum(1)
        ok = last > 0
        ok[ok] = counts[last[ok]] > 0
        rows = np.sort(np.concatenate([drawn[ok], last[ok, None]], 1), axis=1)
        found.append(np.pad(rows, ((0, 0), (0, parts - n))))
    return np.unique(np.concatenate(found), axis=0)


def fitted(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, repeats) of a fit that uses no more patterns than there are bins.

    The better half of the patterns is fitted again until so few are left, so
    that counts gather on few patterns and little is lost by rounding.
    """
    repeats = fit_repeats(patterns, counts)
    while len(patterns) > max(1, np.count_nonzero(counts)):
        half = np.sort(np.argsort(-repeats, kind="stable")[: len(patterns) // 2])
        patterns = patterns[half]
        repeats = fit_repeats(patterns, counts)
    return patterns, repeats


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative repeat counts whose lengths come nearest the histogram.

    Least squares by projected gradient with momentum; a pattern touches few
    bins, so no matrix is built.
    """
    n_bins = len(counts)
    weight = np.where(patterns > 0, 1.0, 0.0)
    target = counts.astype(float)

    def lengths(x):
        return np.bincount(patterns.ravel(), (weight * x[:, None]).ravel(), n_bins)

    # Gershgorin bound of the normal matrix: the largest sum over a pattern's bins
    degree = lengths(weight.sum(1))
    bound = float((weight * degree[patterns]).sum(1).max())
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(steps):
        gradient = (weight * (lengths(y) - target)[patterns]).sum(1)
        new = np.maximum(0.0, y - gradient / bound)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


# A group of sequences with the same content: lengths in order, number of sequences.
Group = tuple[tuple[int, ...], int]


def _rounded(patterns: np.ndarray, repeats: np.ndarray, left: np.ndarray) -> list[Group]:
    """Repeat counts rounded, and never above what ``left`` still holds."""
    groups = []
    for k in np.argsort(-repeats, kind="stable"):
        wish = int(repeats[k] + 0.5)
        if wish < 1:
            break
        lengths, uses = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
        n = min(wish, int((left[lengths] // uses).min()))
        if n > 0:
            left[lengths] -= n * uses
            groups.append((tuple(int(v) for v in np.repeat(lengths, uses)[::-1]), n))
    return groups


def _best_fit(left: np.ndarray, size: int) -> list[Group]:
    """Longest first into the fullest sequence that has room, by runs of equal lengths."""
    space: dict[int, list[Group]] = {}
    rooms: list[int] = []  # sorted free spaces that have groups

    def put(room: int, group: Group):
        if room not in space:
            space[room] = []
            insort(rooms, room)
        space[room].append(group)

    for length in range(min(size, len(left) - 1), 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # none has room: open new ones, each as full as it gets
                each = size // length
                if n >= each:
                    put(size - each * length, ((length,) * each, n // each))
                    n %= each
                else:
                    put(size - n * length, ((length,) * n, 1))
                    n = 0
                continue
            room = rooms[at]
            content, held = space[room].pop()
            if not space[room]:
                del space[room]
                rooms.pop(at)
            fits = min(room // length, -(-n // held))
            used = min(held, n // fits)
            if used < held:
                put(room, (content, held - used))
            put(room - fits * length, (content + (length,) * fits, used))
            n -= fits * used
    return [group for room in rooms for group in space[room]]


def plan(counts: np.ndarray, size: int = SEQUENCE) -> list[Group]:
    """Groups of sequences that hold each length as often as ``counts`` says.

    All patterns, and those of two lengths alone, are fitted to several shares of
    the histogram, and the plan with the fewest sequences is taken; what the
    patterns leave is packed best fit.
    """
    best: list[Group] | None = None
    every = exact_patterns(counts, size, PATTERN_PIECES, PATTERNS)
    for parts in (PATTERN_PIECES, 2):  # patterns of more lengths may break up good pairs
        patterns = every[(every > 0).sum(axis=1) <= parts]
        repeats = np.zeros(0)
        if len(patterns):
            patterns, repeats = fitted(patterns, counts)
        for share in SHARES:
            left = counts.astype(np.int64).copy()
            left[0] = 0
            groups = _rounded(patterns, repeats * share, left)
            groups += _best_fit(left, size)
            if best is None or sum(n for _, n in groups) < sum(n for _, n in best):
                best = groups
    return best or []


def runs_of(groups: list[Group]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first, last, sequence, offset): ranks first..last of that length.

    The k-th of them stands in sequence + k, at that offset.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for content, n in groups:
        offset = 0
        for length in content:
            first = used.get(length, 0)
            used[length] = first + n
            rows.append((length, first, first + n - 1, sequence, offset))
            offset += length
        sequence += n
    return rows


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    The plan goes to the tasks as one table of runs.  It has at most
    ``PATTERN_PIECES`` rows for each of the patterns used, and a few for each
    length left over, whatever the number of documents: that bounds the
    broadcast.  Runs jobs.
    """
    cut = checkpointed(pieces(docs, path, size, end_id))
    counts = np.zeros(size + 1, np.int64)
    for row in cut.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    rows = np.array(runs_of(plan(counts, size)), np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    runs = cut.sparkSession.sparkContext.broadcast(rows)
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "piece"))
    ranked = number_by_digest(cut, order, "rank", ["length"])

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        table = runs.value
        # one number that orders by length and rank
        scale = int(counts.max()) + 1
        key = length.to_numpy() * scale + rank.to_numpy() - 1
        at = np.searchsorted(table[:, 0] * scale + table[:, 1], key, side="right") - 1
        k = rank.to_numpy() - 1 - table[at, 1]
        return pa.StructArray.from_arrays(
            [pa.array(table[at, 3] + k), pa.array(table[at, 4])], ["sequence_id", "offset"]
        )

    placed = ranked.withColumn("_place", place(F.col("length"), F.col("rank").cast("long")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset"
    )
