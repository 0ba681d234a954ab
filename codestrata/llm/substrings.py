"""Exact substring dedup by level-wise doubling over word windows.

A window of ``window`` words is removed if its word sequence also starts anywhere else, in the same text or another. Windows are not
compared at once at full length. At each level (35 words: 9, 18 and 35; each length twice the one before, up to rounding) a window stands with
one gram of that length at a place that its own words decide, so equal windows stand with equal grams. A window whose gram occurs once is
unique and goes; those repeated at one length alone are extended to twice that length. The work ends at full length, or at the first level that
no candidate survives. Longer repeats need no further level: all of their windows are found at full length.

The first level is sparse: a window's gram is the one with the least hash among all its grams, and neighbours mostly share it, so about
one gram in fourteen words is shuffled. Counts are aggregated before shuffling, so a passage in a third of all texts is one row per task.
The first pass over the texts emits the grams of two levels at once; what passes on to full length is, per text, the places that survive.
At full length, a window found once is carried by its own count, so the windows themselves are shuffled only once.

Edge cases: null and short texts have no window and stay whole; repeated rows are copies of each other, so all their windows repeat and
go; ties between equal least grams are settled by place within the window; a null id is like any other; very long texts are joined to the list of their
places and taken through numpy in bounded pieces of texts, one text at least; a column named repeats is replaced; an empty table gives an empty
result; other columns are kept. A third of all rows may be alike in id and text: such a key's rows are spread. Windows are told apart by 64-bit
hashes of their words at every level, so a false repeat has to collide at all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, gram_hashes, pieces, signed, spread_join, tidy, word_hashes, written

_LOW = np.uint64(0xFFFFFFFF)
#: Words of the first level at most.
FIRST = 12


def levels_of(window: int) -> list[int]:
    """Three lengths or more up to ``window``, each twice the one before up to rounding; the first has at most FIRST words."""
    if window < 3:
        raise ValueError("a window takes three words or more")
    levels = [window]
    while levels[0] > FIRST or len(levels) < 3:
        levels.insert(0, -(-levels[0] // 2))
    return levels


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Least of each ``span`` consecutive values."""
    done = 1
    while done < span:
        step = min(done, span - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def windows_in(words: np.ndarray, counts: np.ndarray, window: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, place of the least gram of ``base`` words) of every window that lies within one text; places run through all texts."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = (gram_hashes(words, base) & ~_LOW) | np.arange(n - base + 1, dtype=np.uint64)
    least = (sliding_min(grams, window - base + 1) & _LOW).astype(np.int64)
    last = np.repeat(np.cumsum(counts), counts)  # end of the text of each word
    starts = np.flatnonzero(np.arange(n - window + 1) + window <= last[: n - window + 1])
    return starts, least[starts]


def gram_places(starts: np.ndarray, least: np.ndarray, length: int, window: int, base: int) -> np.ndarray:
    """Where each window's gram of ``length`` words starts: at its least gram if that fits into the window, else ending with it."""
    if length == window:
        return starts
    return np.where(least + length <= starts + window, least, least + base - length)


def _marked(size: int, offsets: np.ndarray, lists: list) -> np.ndarray:
    mark = np.zeros(size + 1, bool)
    for offset, places in zip(offsets, lists, strict=True):
        if places is not None:
            mark[places + offset] = True
    return mark


def _lists(column: pa.Array, start: int, n: int) -> list:
    part = column.slice(start, n)
    return [None if x.as_py() is None else x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in part]


def anchor_rows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, text) to (h, key, lead, mid_at, mid): the distinct grams of the first level, each with the gram of the second level that stands
    for its windows (hash in mid, start in mid_at), or two, to either side; lead is 1 on one row of each first gram."""
    base, middle = levels_of(window)[:2]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("__key").to_numpy(zero_copy_only=False)
            for first, texts in pieces(batch.column("__text")):
                words, counts = word_hashes(texts)
                starts, least = windows_in(words, counts, window, base)
                if not len(starts):
                    continue
                offsets = np.cumsum(counts) - counts
                # Least grams and their sides never go back along a text, so equal ones are neighbours.
                to = gram_places(starts, least, middle, window, base)
                new = np.concatenate(([True], (least[1:] != least[:-1]) | (to[1:] != to[:-1])))
                pairs = np.stack((least[new], to[new]))
                h, mid = gram_hashes(words, base), gram_hashes(words, middle)
                owner = np.repeat(np.arange(len(texts)), counts)[pairs[0]]
                lead = np.diff(pairs[0], prepend=-1) > 0
                for i in range(0, pairs.shape[1], 100_000):
                    (at, to), o = pairs[:, i : i + 100_000], owner[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h[at])), pa.array(keys[first + o]), pa.array(lead[i : i + 100_000].astype(np.int32)), pa.array((to - offsets[o]).astype(np.int32)), pa.array(signed(mid[to]))], names=["h", "key", "lead", "mid_at", "mid"])

    return run


def window_rows(window: int, below: int, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, text, places: starts of surviving grams of ``below`` words) to (h, key, at): grams of ``length`` words of the windows that these stand for."""
    base = levels_of(window)[0]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("__key").to_numpy(zero_copy_only=False)
            for first, texts in pieces(batch.column("__text")):
                words, counts = word_hashes(texts)
                starts, least = windows_in(words, counts, window, base)
                offsets = np.cumsum(counts) - counts
                mark = _marked(len(words), offsets, _lists(batch.column("places"), first, len(texts)))
                held = mark[gram_places(starts, least, below, window, base)]
                at = np.unique(gram_places(starts[held], least[held], length, window, base))
                owner = np.repeat(np.arange(len(texts)), counts)[at]
                for i in range(0, len(at), 100_000):
                    s, o = at[i : i + 100_000], owner[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(_grams_at(words, length, s))), pa.array(keys[first + o]), pa.array((s - offsets[o]).astype(np.int32))], names=["h", "key", "at"])

    return run


def _grams_at(words: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    low, high = int(at[0]), int(at[-1])
    return gram_hashes(words[low : high + length], length)[at - low]


def _per_key(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(F.col("key").alias("__key")).agg(F.collect_set("at").alias(name))


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows (h, key, at), or (h, key, lead, ...), whose h stands on several rows. Counts are summed before the shuffle.

    A passage in very many texts makes a hot h, whose rows are spread.
    """
    times = F.sum("lead") if "lead" in rows.columns else F.count("*")
    found = written(rows.groupBy("h").agg(times.alias("times"), F.count("*").alias("n")).where("times > 1").select("h", "n"), "repeated")
    # Of these rows alone, so that the limit is low enough for each hot h and the hot ones stay few.
    total = found.agg(F.sum("n")).first()[0] or 0
    return spread_join(rows, found, ["h"], [F.monotonically_increasing_id()], rows=total)


KEPT = "n_words long, n_removed long, kept string"
_KEPT_ARROW = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def cut(texts: list[bytes], lists: list, alone: list, window: int) -> list[dict]:
    """What stays of each text. lists: surviving places of the last level but one; alone: starts of windows found once at full length."""
    lengths = levels_of(window)
    todo = [i for i, x in enumerate(lists) if x is not None]
    gone: dict[int, np.ndarray] = {}
    if todo:
        words, counts = word_hashes([texts[i] for i in todo])
        starts, least = windows_in(words, counts, window, lengths[0])
        offsets = np.cumsum(counts) - counts
        starts = starts[_marked(len(words), offsets, [lists[i] for i in todo])[gram_places(starts, least, lengths[-2], window, lengths[0])]]
        starts = starts[~_marked(len(words), offsets, [alone[i] for i in todo])[starts]]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
        covered = np.cumsum(edge[:-1]) > 0
        gone = {i: covered[o : o + c] for i, o, c in zip(todo, offsets, counts, strict=True)}
    out = []
    for i, text in enumerate(texts):
        if i not in gone or not gone[i].any():
            out.append({"n_words": len(text.split()), "n_removed": 0, "kept": text.decode()})
            continue
        data = np.frombuffer(text + b" ", np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        begin = np.concatenate(([0], begin)) if not space[0] else begin
        end = np.concatenate((begin[1:], [len(text)]))  # a word goes with the white space after it
        runs = np.flatnonzero(np.diff(np.concatenate(([True], gone[i], [True])).astype(np.int8)))
        kept = text[: begin[0]] + b"".join(text[begin[a] : end[b - 1]] for a, b in zip(runs[::2], runs[1::2], strict=True))
        out.append({"n_words": len(begin), "n_removed": int(gone[i].sum()), "kept": kept.decode()})
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """All rows and columns of ``docs`` plus ``repeats``: (n_words, n_removed, kept), kept being the text without repeated windows.

    Rows are told apart by a 64-bit hash of (``key``, text), so repeated ids do no harm.
    """
    bound_batches(docs.sparkSession)
    keyed = docs.withColumn("__key", F.xxhash64(F.col(key).cast("string"), F.col(text)))
    texts = keyed.select("__key", F.col(text).cast("binary").alias("__text"))
    alike = written(texts.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1"), "alike")
    total = docs.count()

    def with_texts(rows: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
        """Rows with the lists of their key; a key on very many rows is spread."""
        counted = lists.join(alike, "__key", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
        return spread_join(rows, counted, ["__key"], [F.monotonically_increasing_id()], how, rows=total)

    lengths = levels_of(window)
    first = _repeated(texts.mapInArrow(anchor_rows(window), "h long, key long, lead int, mid_at int, mid long"))
    rows = written(first.select(F.col("mid").alias("h"), "key", F.col("mid_at").alias("at")), "second-level")
    places = written(_per_key(_repeated(rows), "places"), "places")
    for below, length in zip(lengths[1:-1], lengths[2:], strict=True):
        if not places.limit(1).count():
            break
        rows = with_texts(texts, places).mapInArrow(window_rows(window, below, length), "h long, key long, at int")
        if length < window:
            places = written(_per_key(_repeated(written(rows, "level")), "places"), "places")
    once = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("at").alias("at")).where("n = 1")
    lists = written(places.join(_per_key(once, "alone"), "__key", "left"), "lists")

    @F.arrow_udf(KEPT)
    @tidy
    def kept(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, survived, single in batches:
            out: list[dict] = []
            for first, part in pieces(column):
                out += cut(part, _lists(survived, first, len(part)), _lists(single, first, len(part)), window)
            yield pa.array(out, _KEPT_ARROW)

    whole = with_texts(keyed, lists.select("__key", F.col("places").alias("__places"), F.col("alone").alias("__alone")), "left")
    return whole.withColumn("repeats", kept(F.col(text).cast("binary"), "__places", "__alone")).drop("__key", "__places", "__alone")
