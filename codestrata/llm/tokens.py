"""Token counts as a public tokenizer's library gives them, by overlap resynchronisation of chunks.

A text of more than one chunk is encoded in chunks of ``chunk`` characters that overlap by ``overlap``, with offsets. Two neighbours are spliced where, in the
overlap, both open a pre-token with the same token at the same place. The library's split runs from left to right and keeps no state across
a pre-token's start, so from a common start on both encodings agree. The start must lie ``guard`` characters from either chunk's
edge (more than the split looks ahead, and twice the longest added token), where a cut word or a cut special string could mislead. Without
such a place the overlap is doubled, up to the left chunk's begin; if that fails too, both are encoded as one chunk, at least twice as long.
Chunks are encoded in runs of RUN, so a text of any length holds that many encodings at most.

A text of one chunk is one encoding: it has no splice and needs no offsets, so the library is not asked for them.

Edge cases: null counts as an empty text (0 bytes, 0 tokens); a text without any splice (one word of megabytes) is encoded whole in the end;
repeated rows each get their counts; columns named n_tokens, n_bytes or over_limit are replaced, all others are kept; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy

#: Characters of a chunk and of the overlap of two.
CHUNK, OVERLAP = 8192, 512
#: Chunks that are encoded at once.
RUN = 128

def load(path: str):
    """The tokenizer of a ``tokenizers`` JSON file, single-threaded, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def guard_of(tokenizer) -> int:
    return max(64, *(2 * len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), 0)


class Chunk:
    """An encoded stretch of a text: its begin and end, the start of each token in the text, and which tokens open a pre-token.

    Special tokens have no word number and count as pre-tokens of their own.
    """

    def __init__(self, encoding, begin: int, end: int):
        self.begin, self.end, self.ids = begin, end, encoding.ids
        self.starts = [a + begin for a, _ in encoding.offsets]
        words = encoding.word_ids
        self.opens = [w is None or w != v for w, v in zip(words, [None, *words], strict=False)]


def splice(left: Chunk, right: Chunk, low: int, high: int) -> tuple[int, int] | None:
    """(token of left, token of right) of the first place from ``low`` to ``high`` where both open a pre-token with the same token."""
    theirs = {left.starts[j]: j for j in range(bisect_left(left.starts, low), len(left.starts)) if left.opens[j]}
    for i in range(bisect_left(right.starts, low), len(right.starts)):
        if right.starts[i] > high:
            break
        j = theirs.get(right.starts[i])
        if j is not None and right.opens[i] and left.ids[j] == right.ids[i]:
            return j, i
    return None


def whole_counts(tokenizer, texts: list[str]) -> Iterator[int]:
    """Tokens of texts of one chunk, each encoded once and whole."""
    for at in range(0, len(texts), RUN):
        yield from map(len, tokenizer.encode_batch_fast(texts[at : at + RUN], add_special_tokens=False))


def encoded(tokenizer, texts: list[str], chunk: int, overlap: int) -> Iterator:
    """The encodings of all chunks of all texts of more than one, in order."""
    run: list[str] = []
    for text in texts:
        if len(text) <= chunk:
            continue
        for at in range(0, max(1, len(text) - overlap), chunk - overlap):
            run.append(text[at : at + chunk])
            if len(run) == RUN:
                yield from tokenizer.encode_batch(run, add_special_tokens=False)
                run = []
    yield from tokenizer.encode_batch(run, add_special_tokens=False)


def count_tokens(tokenizer, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP, guard: int | None = None) -> list[int]:
    """Tokens of each text; equal to ``len(tokenizer.encode(text, add_special_tokens=False))``."""
    guard = guard_of(tokenizer) if guard is None else guard
    if not 2 * guard < overlap < chunk:
        raise ValueError("an overlap is longer than two guards and shorter than a chunk")
    out = []
    encodings = encoded(tokenizer, texts, chunk, overlap)
    short = iter(whole_counts(tokenizer, [t for t in texts if len(t) <= chunk]))
    for text in texts:
        if len(text) <= chunk:
            out.append(next(short))
            continue

        def encode(begin: int, end: int, text: str = text) -> Chunk:
            return Chunk(tokenizer.encode(text[begin:end], add_special_tokens=False), begin, end)

        total = keep = 0  # tokens before the token ``keep`` of the left chunk are counted
        left = Chunk(next(encodings), 0, chunk)
        for start in range(chunk - overlap, len(text) - overlap, chunk - overlap):
            right = Chunk(next(encodings), start, min(len(text), start + chunk))
            if right.end <= left.end:  # within a chunk that had to be made longer
                continue
            done = left.starts[keep] if keep else left.begin
            width = left.end - right.begin
            while not (found := splice(left, right, max(right.begin + guard, done), left.end - guard)) and right.begin > left.begin:
                width *= 2
                right = encode(max(left.begin, left.end - width), right.end)
            if found:
                total += found[0] - keep
                left, keep = right, found[1]
            else:
                left = encode(left.begin, min(len(text), max(right.end, 2 * left.end - left.begin)))
        out.append(total + len(left.ids) - keep)
    return out


def token_count(text: Column, path: str) -> Column:
    """A column with the number of tokens of a text under the tokenizer file at ``path`` (the same path on every machine)."""

    @F.arrow_udf("long")
    @tidy
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load(path)
        for texts in batches:
            yield pa.array(count_tokens(tokenizer, [x or "" for x in texts.to_pylist()]), pa.int64())

    return counts(text)


def with_token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """All rows and columns of ``docs`` plus n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens). No shuffle."""
    bound_batches(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("n_tokens", token_count(t, path)).withColumn("n_bytes", F.octet_length(t).cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)
