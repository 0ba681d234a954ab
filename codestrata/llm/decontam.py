"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items, one scan of each text.

Texts and items are normalised alike: A-Z become a-z, and every byte outside words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``,
so digits, letters and all bytes of non-ASCII characters are kept) separates words. A window is ``window`` consecutive words
of an item; an item with fewer words, but not none, is one window. The automaton runs over words, not bytes: each of the SHORT commonest words of
the items is one letter, any other word of theirs two, and a word that no item has is a letter without edges. So a node stands for a word
or half of one. An occurrence's last letter gives its words, and a word's place in the original is looked up only in texts that are hit.

Edge cases: a null or wordless text has no words and no hits; a null or wordless item has no windows; repeated rows each
get their own result; a very long text is scanned whole, at several times its size in memory; a column named hits is replaced;
items with equal windows are all reported; items whose id is null hit like any other and stand as one null, the
last of a text's items (which counts as one item and leaves joined ids as they are, as in the SQL); an empty benchmark leaves every text clean;
a very long item is cut into parts that share ``window - 1`` words, so that no window is lost.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy, written

#: Nodes of an automaton, at some 55 bytes each. Nodes are counted (from above) before one is built; a benchmark of more is taken in blocks.
NODES = 6_000_000
#: Longer items are cut into parts of so many windows, so that blocks come out even.
PART_WINDOWS = 10_000
#: Words that are one letter of the automaton. Bounds how many edges a node has, since edges are searched one by one.
SHORT = 512

HITS_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def parts_of(text: bytes | None, window: int, most: int = PART_WINDOWS) -> list[tuple[bytes, int]]:
    """(normalised text, most nodes that its windows take) of the parts of an item, each of at most ``most`` windows."""
    words = words_of(text)
    if not words:
        return []
    starts = range(0, max(1, len(words) - window + 1), most)
    parts = [words[i : i + most + window - 1] for i in starts]
    return [(b" ".join(p), 2 * min(window, len(p)) * max(1, len(p) - window + 1)) for p in parts]


class Machine:
    """The automaton over the windows of (id, text) items. ``ids[value]`` are a window's items, ``sizes[value]`` its words."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        import ahocorasick

        counts = Counter(w for _, text in items for w in words_of(text))
        self.letters = {w: self.letter(rank) for rank, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
        self.ids: list[list[str | None]] = []
        self.sizes: list[int] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for item, text in items:
            letters = [self.letters[w] for w in words_of(text)]
            for i in range(max(1, len(letters) - window + 1) if letters else 0):
                key = "".join(letters[i : i + window])
                at = self.automaton.get(key, -1)
                if at < 0:
                    self.automaton.add_word(key, len(self.ids))
                    self.ids.append([item])
                    self.sizes.append(min(window, len(letters)))
                elif self.ids[at][-1] != item:
                    self.ids[at].append(item)
        if self.ids:
            self.automaton.make_automaton()

    @staticmethod
    def letter(rank: int) -> str:
        """One letter for the commonest words; for others a leading one of another range and a trailing one of a third."""
        high, low = divmod(rank - SHORT, SHORT)
        return chr(0x100 + rank) if rank < SHORT else chr(0x1000 + high) + chr(0x100 + SHORT + low)


#: The letter of a word that no item has: it has no edges.
UNKNOWN = "\x01"


def scan(text: bytes | None, machine: Machine) -> tuple[int, int, list[str | None], list[tuple[int, int]]]:
    """(words, words hit, ids of items with an occurrence, byte spans of hit runs in the original text)."""
    words = words_of(text)
    if not words or not machine.ids:
        return len(words), 0, [], []
    letters = [machine.letters.get(w, UNKNOWN) for w in words]
    found = list(machine.automaton.iter("".join(letters)))
    if not found:
        return len(words), 0, [], []
    ends = np.cumsum([len(x) for x in letters])  # letters up to the end of each word
    cover = np.zeros(len(words) + 1, np.int64)
    last = np.searchsorted(ends, np.array([end for end, _ in found]) + 1) + 1
    values = [value for _, value in found]
    np.add.at(cover, last - np.array([machine.sizes[v] for v in values]), 1)
    np.add.at(cover, last, -1)
    ids = {i for v in set(values) for i in machine.ids[v]}
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    places = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    spans = [(places[a][0], places[b - 1][1]) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    return len(words), int(hit.sum()), sorted(ids, key=lambda x: (x is None, x or "")), spans


_built: dict[str, Machine] = {}


def machine_of(items: list[tuple[str | None, bytes | None]], window: int, token: str) -> Machine:
    """The automaton of the items, built once per worker process and kept until that of another call is asked for."""
    if token not in _built:
        _built.clear()
        _built[token] = Machine(items, window)
    return _built[token]


def _parts(window: int):
    """A function of item texts that gives their parts."""

    @F.arrow_udf("array<struct<part: binary, nodes: long>>")
    @tidy
    def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("part", pa.binary()), ("nodes", pa.int64())]))
        for texts in batches:
            yield pa.array([[{"part": p, "nodes": n} for p, n in parts_of(x.as_py(), window)] for x in texts], kind)

    return parts


def blocks_of(benchmark: DataFrame, window: int, limit: int) -> list[DataFrame]:
    """The benchmark (id, text) as parts of items in blocks of about ``limit`` nodes, by a hash of both columns; one block if it is small enough."""
    parts = benchmark.select("id", F.explode(_parts(window)(F.col("text"))).alias("x")).select("id", F.col("x.part").alias("text"), F.col("x.nodes").alias("nodes"))
    n = -(-(parts.agg(F.sum("nodes")).first()[0] or 0) // limit)
    parts = parts.select("id", "text")
    if n <= 1:
        return [parts]
    parts = written(parts, "benchmark-parts")
    return [parts.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) for i in range(n)]


def merged(text: bytes, parts: list[dict]) -> dict:
    """Hits of one text under several blocks of items as one."""
    places = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    starts = np.array([a for a, _ in places], np.int64)
    cover = np.zeros(len(places) + 1, np.int64)
    for p in parts:
        for s in p["spans"]:
            cover[np.searchsorted(starts, s["start"])] += 1
            cover[np.searchsorted(starts, s["end"])] -= 1
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    ids = sorted({i for p in parts for i in p["items"]}, key=lambda x: (x is None, x or ""))
    return {"n_words": len(places), "n_hit": int(hit.sum()), "items": ids, "spans": spans}


def _hits(items, window: int):
    """A function of texts that scans them for a broadcast of items."""
    token = uuid.uuid4().hex

    @F.arrow_udf(HITS)
    @tidy
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = machine_of(items.value, window, token)
        for texts in batches:
            rows = [scan(x.as_py(), machine) for x in texts]
            yield pa.array([{"n_words": n, "n_hit": h, "items": ids, "spans": [{"start": a, "end": b} for a, b in spans]} for n, h, ids, spans in rows], HITS_ARROW)

    return hits


def _both():
    """A function of (text, hits, hits under a further block)."""

    @F.arrow_udf(HITS)
    @tidy
    def both(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, before, now in batches:
            rows = zip(texts, before.to_pylist(), now.to_pylist(), strict=True)
            yield pa.array([a if not b["n_hit"] else b if not a["n_hit"] else merged(t.as_py() or b"", [a, b]) for t, a, b in rows], HITS_ARROW)

    return both


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, limit: int = NODES) -> DataFrame:
    """All rows and columns of ``docs`` plus ``hits``: (n_words, n_hit, items, spans), spans as byte offsets into the text.

    The nodes that the benchmark takes are counted first. Up to ``limit`` of them it is read once to the driver, sent with the tasks, and each text is
    scanned once by one automaton; no shuffle. A larger one is taken in blocks of that size, one after another: each block's hits are written with the
    rows before the next one starts, so no more than one block is held at a time.
    """
    bound_batches(docs.sparkSession)
    blocks = blocks_of(benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("binary").alias("text")), window, limit)
    out = docs
    for i, block in enumerate(blocks):
        hits = _hits(docs.sparkSession.sparkContext.broadcast([(r[0], bytes(r[1])) for r in block.toLocalIterator()]), window)
        t = F.col(text).cast("binary")
        out = out.withColumn("hits", hits(t)) if not i else out.withColumn("__now", hits(t)).withColumn("hits", _both()(t, "hits", "__now")).drop("__now")
        if len(blocks) > 1:
            out = written(out, "hits")
    return out
