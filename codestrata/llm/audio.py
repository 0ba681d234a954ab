"""Chroma fingerprints of recordings, and search by offset histograms and bit errors.

A recording's frames (Hann window, overlapping) are folded into twelve pitch classes and normalised. Over the picture of frames by pitch
classes an integral image is kept, so that each filter (a difference of two or three rectangles) costs a few look-ups. Sixteen filters,
each quantised to two bits in Gray code, give one packed 32-bit integer per frame. Index keys are the upper or lower halves of two integers HOP
frames apart; where a key stands at several frames in a row (a steady tone), the first one counts. A search looks up equal keys, votes for the
offset between two recordings, and takes the bit error rate of all overlapping frames at each offset that got enough votes. A query's keys are also
looked up with each single bit changed, so that a vote is a pair of keys of at most one bit of error.

Prints and not keys are shuffled: the prints are dealt over parts, the queries' over blocks, of about GROUP integers each, and each pair of a part and a
block meets in one group. A group sorts its part's keys, looks the block's keys up in them, and counts votes in runs of at most PAIRS pairs of keys. So
votes, most of which come from chance and whose number grows with queries times recordings, never leave their task: only offsets whose error
is small enough do.

A match is an overlap of at least MIN_OVERLAP integers (or of the whole shorter print) with a bit error of at most MAX_ERROR. It takes one vote for each
VOTE_EVERY overlapping integers, at least 1 and at most MOST_VOTES. With independent errors of 0.2 a key has at most one wrong bit with probability
0.8 ** 32 + 32 * 0.2 * 0.8 ** 31 = 0.007, so 180 frames of two keys give some 2.5 votes. Tests measure recall over brute force, without the matches of
queries with themselves (at least 0.9). Equal prints match outright, whatever their length.

Keys that many prints share (silence, a steady tone) are dealt over the parts and blocks like any others, since prints are dealt by the hash of the print.

Equal fingerprints are one class with its least id and size; classes and not their members are joined, so copies cost nothing.

Edge cases: null, empty and too short recordings have no integers and match nothing; recordings of HOP integers or fewer match equal ones only;
silence gives integers like any sound; ties between offsets go to the least error, then most votes, then the one nearest 0, then the smaller; repeated
rows fall into one class; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, HOT_KEYS, bound_batches, small, written

RATE, FRAME, STEP = 4000, 512, 128
#: Frames between the two integers of an index key.
HOP = 12
#: Most bits in error, least integers that overlap, and what votes a match takes (see above).
MAX_ERROR = 0.2
MIN_OVERLAP, VOTE_EVERY, MOST_VOTES = 16, 24, 2
#: Integers of a part or block of prints, and pairs of keys or of integers that are taken at once.
GROUP, PAIRS = 1 << 18, 1 << 20
#: Size of the table of hashes that a part's codes are looked up in first.
SLOTS = 1 << 23


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of the sixteen filters, by rule: kinds in turn, widths from 4 to 16 frames."""
    return [(i % 4, (5 * i) % 7, 4 + i % 3, 4 + 4 * (i // 4)) for i in range(16)]


SPAN = max(w for *_, w in filters())
_GRAY = np.array([0, 1, 3, 2], np.uint32)


@cache
def _pitches() -> tuple[np.ndarray, np.ndarray]:
    """(bins in use, bins in use x 12: the pitch class of each)."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = (hz >= 60) & (hz <= 1800)
    pitch = np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12
    fold = np.zeros((use.sum(), 12))
    fold[np.arange(use.sum()), pitch] = 1
    return use, fold


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12, each frame of unit length (or zero)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::STEP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    use, fold = _pitches()
    out = np.sqrt(power[:, use] @ fold)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Packed integers (uint32), one for each frame that has SPAN frames from it on."""
    image = chroma(samples)
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)

    def area(x: int, w: int, y: int, h: int) -> np.ndarray:
        low, high = total[x : x + n], total[x + w : x + w + n]
        return high[:, y + h] - low[:, y + h] - high[:, y] + low[:, y]

    out = np.zeros(n, np.uint32)
    for i, (kind, y, h, w) in enumerate(filters()):
        half, low = w // 2, h // 2
        if kind == 0:  # upper against lower pitch classes
            a, b = area(0, w, y, low), area(0, w, y + low, h - low)
        elif kind == 1:  # earlier against later
            a, b = area(0, half, y, h), area(half, w - half, y, h)
        elif kind == 2:  # checkerboard
            a, b = area(0, half, y, low) + area(half, w - half, y + low, h - low), area(half, w - half, y, low) + area(0, half, y + low, h - low)
        else:  # middle against both sides
            third = max(1, w // 3)
            a, b = area(third, w - 2 * third, y, h), area(0, third, y, h) + area(w - third, third, y, h)
        value = np.log((1 + a) / (1 + b))
        level = (value > -0.25).astype(int) + (value > 0.0) + (value > 0.25)
        out |= _GRAY[level] << np.uint32(2 * i)
    return out


def melody(vector: np.ndarray) -> np.ndarray:
    """A recording for tables without audio: each value is one tone, two octaves between the vector's least and greatest value."""
    v = np.nan_to_num(np.asarray(vector, np.float64), posinf=0, neginf=0)
    step = np.floor((v - v.min()) / max(1e-12, np.ptp(v)) * 23.999)
    return _tones()[step.astype(int)].reshape(-1) * 0.5


@cache
def _tones() -> np.ndarray:
    """The 24 tones of two octaves, a tenth of a second each."""
    hz = 220.0 * 2.0 ** (np.arange(24) / 12)
    t = np.arange(400) / RATE
    return np.sin(2 * np.pi * hz[:, None] * t[None])


def recorded(vector: np.ndarray, cut: int, gain: float, noise: float, seed: int) -> np.ndarray:
    """``melody`` without its first ``cut`` samples, at another gain, with white noise of the given amplitude."""
    wave = melody(vector)[cut:] * gain
    return wave + np.random.default_rng(seed).normal(0, noise, len(wave)) if noise else wave


def fingerprints(samples: Column) -> Column:
    """array<long> of packed integers for a column array<float> of samples at RATE."""

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([fingerprint(np.nan_to_num(x.values.to_numpy(zero_copy_only=False).astype(np.float64))).astype(np.int64) if x.as_py() else [] for x in column], pa.list_(pa.int64()))

    return run(samples)


def melody_fingerprints(vector: Column, cut: Column, gain: Column, noise: Column, seed: Column) -> Column:
    """Fingerprints of ``recorded(vector, ...)``, without the samples leaving the task's memory."""

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for vectors, *how in batches:
            rows = zip(vectors, *(h.to_pylist() for h in how), strict=True)
            yield pa.array([fingerprint(recorded(np.array(v, np.float64), *h)).astype(np.int64) if (v := x.as_py()) else [] for x, *h in rows], pa.list_(pa.int64()))

    return run(vector, cut, gain, noise, seed)


class Prints:
    """Prints of a part or block end to end: ``flat`` integers, where each begins, and their sizes."""

    def __init__(self, column: pa.ChunkedArray):
        lists = [x for x in column.chunks if len(x)]
        self.flat = np.concatenate([np.zeros(0, np.uint32), *(x.flatten().to_numpy(zero_copy_only=False).astype(np.uint32) for x in lists)])
        self.size = np.concatenate([np.zeros(0, np.int64), *(x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)])
        self.begin = np.cumsum(self.size) - self.size

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, print, frame) of all index keys in order of prints: for each frame and half, the key if the frame before has another one."""
        owner = np.repeat(np.arange(len(self.size)), self.size)
        frame = np.arange(len(self.flat)) - self.begin[owner]
        at = np.flatnonzero(frame + HOP < self.size[owner])
        found = []
        for half in (0, 1):
            part = (self.flat >> np.uint32(16 * half)) & np.uint32(0xFFFF)
            code = part[at].astype(np.int64) << 16 | part[at + HOP]
            first = (frame[at] == 0) | (code != np.concatenate(([-1], code[:-1])))
            found.append((code[first] << 1 | half, owner[at[first]], frame[at[first]]))
        code, owner, frame = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(owner, kind="stable")
        return code[order], owner[order], frame[order]


def runs(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive items whose counts sum to ``most`` or less; an item of more is a run of its own."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, place within it) of each of an item's ``counts`` places, for all items."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - (np.cumsum(counts) - counts)[item]


def _slots(code: np.ndarray) -> np.ndarray:
    """Places of codes in a table of SLOTS bits."""
    return (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - SLOTS.bit_length())


def looked_up(code: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in ``asked``, first place, number of places) of the sorted codes that equal an asked code, or one with a single bit changed.

    Nearly all of the 33 codes that an asked code stands for are in no print of the part, so each distinct one is tried in a table of hashes first, and
    only what may be there is searched for.
    """
    there = np.zeros(SLOTS, bool)
    there[_slots(code)] = True
    order = np.argsort(asked, kind="stable")
    distinct, begin, size = np.unique(asked[order], return_index=True, return_counts=True)
    found = []
    for bit in (0, *(1 << b for b in range(1, 33))):  # the lowest bit of a code is its half
        needle = distinct ^ bit
        maybe = np.flatnonzero(there[_slots(needle)])
        low = np.searchsorted(code, needle[maybe], "left")
        count = np.searchsorted(code, needle[maybe], "right") - low
        some = np.flatnonzero(count)
        found.append((maybe[some], low[some], count[some]))
    which, low, count = (np.concatenate(x) for x in zip(*found, strict=True))
    item, place = spread(size[which])
    return order[begin[which[item]] + place], low[item], count[item]


def voted(part: Prints, block: Prints) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, print, offset, votes) of every offset that got a vote, in runs of queries."""
    code, owner, frame = part.keys()
    order = np.argsort(code, kind="stable")
    code, owner, frame = code[order], owner[order], frame[order]
    q_code, q, q_frame = block.keys()
    key, low, count = looked_up(code, q_code)
    by_query = np.argsort(q[key], kind="stable")
    key, low, count = key[by_query], low[by_query], count[by_query]
    # A cell of the histograms is (query, print, offset), the offset counted from the least that a pair of frames of the block and the part can have.
    least = int(block.size.max(initial=0))
    width = least + int(part.size.max(initial=0)) + 1
    per_query = np.bincount(q[key], weights=count, minlength=len(block.size)).astype(np.int64)
    for a, b in runs(per_query, PAIRS):
        here = slice(*np.searchsorted(q[key], [a, b]))
        ends = np.cumsum(count[here])
        cells, votes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            pair = np.arange(at, min(at + PAIRS, int(ends[-1])))
            i = np.searchsorted(ends, pair, "right")
            k = key[here][i]
            p = low[here][i] + pair - (ends[i] - count[here][i])
            new, n = np.unique((q[k] * len(part.size) + owner[p]) * width + frame[p] - q_frame[k] + least, return_counts=True)
            cells, back = np.unique(np.concatenate((cells, new)), return_inverse=True) if len(cells) else (new, np.arange(len(new)))
            votes = np.bincount(back, weights=np.concatenate((votes, n))).astype(np.int64)
        pair, offset = np.divmod(cells, width)
        yield *np.divmod(pair, max(1, len(part.size))), offset - least, votes


def errors(part: Prints, block: Prints, q: np.ndarray, c: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Bit error rate of all overlapping integers of queries and prints at the given offsets; each overlap has an integer or more."""
    first = np.maximum(0, -offset)
    n = np.minimum(block.size[q], part.size[c] - offset) - first
    out = np.zeros(len(q))
    for a, b in runs(n, PAIRS):
        item, place = spread(n[a:b])
        x = (block.begin[q[a:b]] + first[a:b])[item] + place
        y = (part.begin[c[a:b]] + first[a:b] + offset[a:b])[item] + place
        wrong = np.bitwise_count(block.flat[x] ^ part.flat[y]).astype(np.int64)
        out[a:b] = np.add.reduceat(wrong, np.cumsum(n[a:b]) - n[a:b]) / (32 * n[a:b])
    return out


def matches(part: pa.Table, block: pa.Table) -> pa.Table:
    """(q, c, offset, votes, error) of a part's prints (c, print) at all offsets against a block's (q, asked) that have votes enough and are near MAX_ERROR or less."""
    mine, asked = Prints(part["print"]), Prints(block["asked"])
    c_id, q_id = part["c"].to_numpy(), block["q"].to_numpy()
    found = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0),)]
    for q, c, offset, votes in voted(mine, asked):
        overlap = np.minimum(asked.size[q], mine.size[c] - offset) - np.maximum(0, -offset)
        enough = np.clip(overlap // VOTE_EVERY, 1, MOST_VOTES)
        least = np.minimum(MIN_OVERLAP, np.minimum(asked.size[q], mine.size[c]))
        good = np.flatnonzero((votes >= enough) & (overlap >= least) & (q_id[q] != c_id[c]))
        q, c, offset, votes = q[good], c[good], offset[good], votes[good]
        error = errors(mine, asked, q, c, offset)
        near = np.flatnonzero(error < MAX_ERROR + 1e-6)
        found.append((q_id[q[near]], c_id[c[near]], offset[near], votes[near], error[near]))
    return pa.table(dict(zip(("q", "c", "offset", "votes", "error"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def met(postings: DataFrame, own: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """All pairs of rows of equal code, for keys that stand in tables (``search`` looks its keys up within groups of prints). ``own`` is broadcast up to ``limit`` bytes; beyond it both sides are shuffled by code.

    A code is hot on a side where it has more than one in HOT_KEYS of that side's rows, so at most 2 * HOT_KEYS codes are. Its rows in ``postings`` are
    dealt over a parts and repeated b times, its rows in ``own`` are dealt over b parts and repeated a times: each pair meets once.
    """
    if own.count() * 40 <= limit:
        return postings.join(F.broadcast(own), "code")
    sides = written(own.groupBy("code").agg(F.count("*").alias("m")).join(postings.groupBy("code").agg(F.count("*").alias("n")), "code"), "code-counts")
    n, m = (max(1, (x or 0) // HOT_KEYS) for x in sides.agg(F.sum("n"), F.sum("m")).first())
    grid = F.broadcast(sides.where((F.col("n") > n) | (F.col("m") > m)).select("code", F.ceil(F.col("n") / n).cast("int").alias("a"), F.ceil(F.col("m") / m).cast("int").alias("b")))

    def dealt(df: DataFrame, mine: str, other: str, *by: str) -> DataFrame:
        part = F.coalesce(F.pmod(F.xxhash64(*by), F.col(mine)), F.lit(0)).cast("int").alias(f"__{mine}")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)).alias(f"__{other}")
        return df.join(grid, "code", "left").select(*df.columns, part, every)

    return dealt(postings, "a", "b", "c", "pos").join(dealt(own, "b", "a", "q", "q_pos").hint("merge"), ["code", "__a", "__b"]).drop("__a", "__b")


def search(prints: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """(query, match_id: least id of the matching class, class_size, offset in frames, votes, bit_error) for every query and class.

    ``prints`` has key and print (array<long>); ``queries`` is a part of it. Offsets are those of the match against the query.
    """
    bound_batches(prints.sparkSession)
    p = written(prints.select(F.col(key).alias("id"), F.xxhash64("print").alias("c"), "print"), "prints")
    classes = written(p.where(F.size("print") > 0).groupBy("c").agg(F.min("id").alias("rep"), F.count("*").alias("members"), F.min("print").alias("print")), "classes")
    asked = written(queries.select(F.col(key).alias("id")).distinct().join(p.select("id", "c"), "id").distinct(), "asked")
    able = classes.where(F.size("print") > HOP)
    own = able.join(small(asked.select("c").distinct(), 16), "c", "left_semi").select(F.col("c").alias("q"), F.col("print").alias("asked"))
    parts, blocks = (max(1, -(-(df.agg(F.sum(F.size(prints))).first()[0] or 0) // GROUP)) for df, prints in ((able, "print"), (own, "asked")))

    def dealt(df: DataFrame, key: str, mine: str, n: int, other: str, m: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        return df.withColumns({mine: F.pmod(F.xxhash64(F.lit(9), key), F.lit(n)).cast("int"), other: every})

    mine = dealt(able.select("c", "print"), "c", "part", parts, "block", blocks).groupBy("part", "block")
    both = mine.cogroup(dealt(own, "q", "block", blocks, "part", parts).groupBy("part", "block")).applyInArrow(matches, "q long, c long, offset long, votes long, error double")
    verified = both.withColumn("bit_error", F.round("error", 6)).where(F.col("bit_error") <= MAX_ERROR).join(classes.select("c", "rep", "members"), "c")
    best = verified.groupBy("q", F.col("rep").alias("match_id"), F.col("members").alias("class_size")).agg(F.min_by(F.struct(F.col("offset").cast("int").alias("offset"), "votes", "bit_error"), F.struct("bit_error", -F.col("votes"), F.abs("offset"), "offset")).alias("b")).select("q", "match_id", "class_size", "b.*")
    equal = classes.select(F.col("c").alias("q"), F.col("rep").alias("match_id"), F.col("members").alias("class_size"), F.lit(0).alias("offset"), F.size("print").cast("long").alias("votes"), F.lit(0.0).alias("bit_error"))
    matched = best.unionByName(equal)
    return asked.join(matched, asked.c == matched.q).select(F.col("id").alias(key), "match_id", "class_size", "offset", "votes", "bit_error")
