"""Periodic runs of words: stretches that repeat with some period, found on a harmonic grid.

A run is a stretch of consecutive words with smallest period p (words p apart are identical), at least ``max(min_length, 2 * p)`` long, which no
neighbouring word extends. A run of period p holds a multiple g of p with g + p inside it as well. So the grid of all pairs (period p, point
g = 0, p, 2p, ...) meets every run, and since the periods' grids thin out harmonically it has n ln n pairs for n words. For all pairs of a
batch of texts at once, the common extension of g and g + p to the right and to the left is found by binary search over prefix hashes: a pair
whose first words differ has none. What reaches the length is a run, its words are verified one by one, and of equal stretches the
least period stays (the others are its multiples).

Words are numbered exactly within a batch, so equal numbers are equal words. Prefix hashes are modulo two primes; where the verification of a
batch fails, its hashes are drawn anew, so no result rests on them. The pairs are taken in blocks of about BLOCK, so memory grows
with the longest text alone.

Edge cases: a null, empty or blank text has no words and no runs; repeated rows each get their runs; null ids are no matter; an empty table
gives an empty result; a column named runs is replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, pieces

#: Pairs of (period, grid point) that are looked at together, and bytes of a text that are cut into words together.
BLOCK, SLICE = 1 << 19, 1 << 20
_PRIMES = np.array([[2147483647], [2147483629]], np.uint64)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of every word of all texts, words of each text, the words by number), words split at ASCII white space."""
    known: dict[bytes, int] = {}
    parts, counts = [], []
    for text in texts:
        n = at = 0
        while at < len(text):
            end = at + SLICE
            while end < len(text) and not text[end : end + 1].isspace():
                end += 1
            words = text[at:end].split()
            parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
            n, at = n + len(words), end
        counts.append(n)
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(counts, np.int64), list(known)


class Prefixes:
    """Hashes of all prefixes of a row of word numbers, modulo two primes."""

    def __init__(self, words: np.ndarray, kinds: int, seed: int):
        rng = np.random.default_rng(seed)
        base = rng.integers(1 << 20, 1 << 30, (2, 1)).astype(np.uint64)
        value = rng.integers(1, 1 << 30, (2, max(1, kinds))).astype(np.uint64)
        self.power = np.ones((2, len(words) + 1), np.uint64)
        done, step = 1, base
        while done < len(words) + 1:  # powers by doubling
            more = min(done, len(words) + 1 - done)
            self.power[:, done : done + more] = self.power[:, :more] * step % _PRIMES
            done, step = done + more, step * step % _PRIMES
        self.sums = np.zeros((2, len(words) + 1), np.uint64)
        np.cumsum(value[:, words] * self.power[:, :-1] % _PRIMES, axis=1, out=self.sums[:, 1:])
        self.sums %= _PRIMES

    def equal(self, i: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i on equal those from i + p on."""
        j = i + p
        first = (self.sums[:, i + n] + _PRIMES - self.sums[:, i]) * self.power[:, p]
        second = self.sums[:, j + n] + _PRIMES - self.sums[:, j]
        return (first % _PRIMES == second % _PRIMES).all(axis=0)


def extension(prefixes: Prefixes, at: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words (0 to ``most``) agree from ``at`` and ``at + p`` on to the right, or to the left of them."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = prefixes.equal(at - mid if back else at, p, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def runs_of(words: np.ndarray, counts: np.ndarray, kinds: int, min_length: int = 12) -> np.ndarray:
    """Rows (begin, end, period) of all runs of all texts, as places in ``words``, by begin and period. ``counts``: words of each text."""
    for seed in range(64):
        found = _candidates(words, counts, kinds, min_length, seed)
        if _verified(words, found):
            return found
    raise AssertionError("hashes of 62 bits failed 64 times")


def _candidates(words: np.ndarray, counts: np.ndarray, kinds: int, min_length: int, seed: int) -> np.ndarray:
    prefixes = Prefixes(words, kinds, seed)
    begins = np.cumsum(counts) - counts
    long = counts >= max(2, min_length)
    n, periods = counts[long], counts[long] // 2
    before = np.cumsum(periods) - periods
    # One line for each text and period: the text's begin and end, the period, and the number of its grid points.
    first, last = np.repeat(begins[long], periods), np.repeat(begins[long] + n, periods)
    period = np.arange(periods.sum()) - np.repeat(before, periods) + 1
    points = (last - first - 1) // period
    ends = np.cumsum(points)
    found = [np.zeros((0, 3), np.int64)]
    at = 0
    while at < len(points):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        c = points[at:to]
        line = np.repeat(np.arange(at, to), c)
        p = period[line]
        g = first[line] + (np.arange(len(line)) - np.repeat(np.cumsum(c) - c, c)) * p
        same = words[g] == words[g + p]
        line, p, g = line[same], p[same], g[same]
        at = to
        # A run's words agree with those a period later from its begin to one period before its end: at ``need`` places or more, g among them.
        need, after, ahead = np.maximum(p, min_length - p), last[line] - g - p, g - first[line]
        half = need // 2
        likely = _holds(prefixes, g, p, half + 1, half + 1 <= after) | _holds(prefixes, g - half, p, half, half <= ahead)
        line, p, g = line[likely], p[likely], g[likely]
        # Where a whole period from the grid point before agrees, this point lies in the same run.
        whole = _holds(prefixes, g, p, p, g + 2 * p <= last[line])
        again = np.zeros(len(g), bool)
        again[1:] = whole[:-1] & (line[1:] == line[:-1]) & (g[1:] - g[:-1] == p[1:])
        line, p, g = line[~again], p[~again], g[~again]
        right = extension(prefixes, g, p, last[line] - g - p, False)
        left = extension(prefixes, g, p, g - first[line], True)
        whole = left + right + p >= np.maximum(min_length, 2 * p)
        found.append(_least(np.stack([(g - left)[whole], (g + right + p)[whole], p[whole]], axis=1)))
    return _least(np.concatenate(found))


def _holds(prefixes: Prefixes, at: np.ndarray, p: np.ndarray, n: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Whether ``inside`` holds and the n words from ``at`` on equal those p later."""
    out = inside.copy()
    out[inside] = prefixes.equal(at[inside], p[inside], n[inside])
    return out


def _least(rows: np.ndarray) -> np.ndarray:
    """Of rows with equal begin and end that of least period, by begin and period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _verified(words: np.ndarray, rows: np.ndarray) -> bool:
    return all(np.array_equal(words[s : e - p], words[s + p : e]) for s, e, p in rows.tolist())


def collapsed(words: np.ndarray, rows: np.ndarray, known: list[bytes]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, rows[:, 0] + rows[:, 2], 1)
    np.add.at(depth, rows[:, 1], -1)
    kept = words[np.cumsum(depth[:-1]) == 0]
    return b" ".join(b" ".join(map(known.__getitem__, kept[at : at + 65536].tolist())) for at in range(0, len(kept), 65536))


def found_in(texts: list[bytes], min_length: int = 12) -> list[tuple[int, np.ndarray, bytes]]:
    """(number of words, runs as (start, end, period), text without repeats) of each text."""
    words, counts, known = numbered(texts)
    rows = runs_of(words, counts, len(known), min_length)
    begins = np.cumsum(counts) - counts
    cut = np.searchsorted(rows[:, 0], np.append(begins, len(words)))
    out = []
    for i, (begin, n) in enumerate(zip(begins.tolist(), counts.tolist(), strict=True)):
        own = rows[cut[i] : cut[i + 1]] - np.array([begin, begin, 0])
        out.append((n, own, collapsed(words[begin : begin + n], own, known)))
    return out


def runs_in(text: Column, min_length: int = 12) -> Column:
    """struct<n_words, runs: array<struct<start, length, period>> by start and period, collapsed: binary> of a text column."""

    @F.arrow_udf("struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [x for _, texts in pieces(batch) for x in found_in(texts, min_length)]
            rows = np.concatenate([r for _, r, _ in found]) if found else np.zeros((0, 3), np.int64)
            offsets = np.cumsum([0, *(len(r) for _, r, _ in found)])
            fields = pa.StructArray.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], fields=list(_RUNS.value_type))
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields)
            yield pa.StructArray.from_arrays([pa.array([n for n, _, _ in found], pa.int64()), runs, pa.array([c for _, _, c in found], pa.binary())], ["n_words", "runs", "collapsed"])

    return run(text.cast("binary"))


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = 12) -> DataFrame:
    """All rows and columns of ``docs`` plus ``runs``: n_words, runs (by start, then period) and the text collapsed to one period of each. No shuffle."""
    if min_length < 2:
        raise ValueError("a run has two words at least")
    bound_batches(docs.sparkSession)
    return docs.withColumn("runs", runs_in(F.col(text), min_length)).withColumn("runs", F.col("runs").withField("collapsed", F.col("runs.collapsed").cast("string")))
