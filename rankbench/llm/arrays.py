"""Small helpers for Arrow batches inside tasks."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def text_runs(texts: pa.Array, most_chars: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in runs of bounded size, null as empty; one text is never cut."""
    run: list[str] = []
    chars = 0
    for text in texts:
        value = text.as_py() or ""
        if run and chars + len(value) > most_chars:
            yield run
            run, chars = [], 0
        run.append(value)
        chars += len(value)
    if run:
        yield run


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], most: int
) -> Iterator[tuple[list[np.ndarray], list[np.ndarray], bool]]:
    """Whole groups of a stream sorted by ``keys``.

    Gives (key columns, other columns, large): many whole groups at once, or,
    with ``large`` set, one part of a group that has more than ``most`` rows.
    No more than a batch and ``most`` rows are held.
    """
    held: list[np.ndarray] | None = None
    large = False
    width = len(keys)

    def cut(columns, start, stop):
        return [c[start:stop] for c in columns]

    def same(columns, i, j):
        return all(columns[k][i] == columns[k][j] for k in range(width))

    for batch in batches:
        names = keys + [n for n in batch.schema.names if n not in keys]
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if len(columns[0]) == 0:
            continue
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        n = len(columns[0])
        change = np.zeros(n, bool)
        for k in range(width):
            change[1:] |= columns[k][1:] != columns[k][:-1]
        starts = np.flatnonzero(change)
        last = int(starts[-1]) if len(starts) else 0
        if large and last:  # the end of the large group that came in parts
            first = int(starts[0])
            part = cut(columns, 0, first)
            yield part[:width], part[width:], True
            columns, last, large = cut(columns, first, n), last - first, False
            n -= first
        if last:
            part = cut(columns, 0, last)
            yield part[:width], part[width:], False
        held = cut(columns, last, n)
        if large or len(held[0]) > most:
            large = True
            # one row stays, to tell whether the group goes on
            part = cut(held, 0, len(held[0]) - 1)
            if len(part[0]):
                yield part[:width], part[width:], True
            held = cut(held, len(held[0]) - 1, len(held[0]))
    if held is not None and len(held[0]):
        yield held[:width], held[width:], large


def pairs_apart(keys: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all rows with equal keys in sorted columns, by their distance."""
    i = np.arange(len(keys[0]))
    step = 0
    while True:
        step += 1
        i = i[i + step < len(keys[0])]
        same = np.ones(len(i), bool)
        for k in keys:
            same &= k[i] == k[i + step]
        i = i[same]
        if not len(i):
            return
        yield i, i + step
