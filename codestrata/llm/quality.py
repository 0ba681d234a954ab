"""A quality classifier: gradient-boosted trees with histograms over document statistics.

Every whole text becomes a row of statistics (``STATISTICS``): shares of kinds of bytes, lengths of words and lines, and how much of the text
repeats itself. Trees of one depth are grown level by level over at most ``BINS`` quantile bins of each statistic, with the gradients of
logistic loss, and are kept flat: one array of statistics and one of thresholds in heap order, one of leaf values. A batch of texts goes down
all trees at once, one array step a level.

Fitting takes a bounded sample of about ``max_rows`` labelled documents, drawn by a hash of the id after labels are averaged by id; where an id
stands on rows of different texts, that with the least hash counts. That bound holds for fitting alone: scores cover all rows.

Edge cases: a null text counts as empty, and an empty one is scored by its statistics (all 0); labels without an id, a value or a
document teach nothing; without any label the score is 0.5; repeated rows get equal scores; an empty table gives an empty result; columns named
score or predicted are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, gram_hashes, mix, pieces, word_hashes

BINS = 64
#: Kinds of bytes; each byte is of the first kind that holds it, and of ``other`` if none does.
_KINDS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "newline": b"\n",
    "blank": b" \t\r\x0b\x0c",
    "stop": b".",
    "comma": b",;:",
    "exclaim": b"!?",
    "quote": b"\"'`",
    "bracket": b"()[]{}<>",
    "bar": b"|/\\_-=+~^",
    "symbol": b"#$%&*@",
    "control": bytes(range(32)) + b"\x7f",
    "other": bytes(range(128, 256)),
}
STATISTICS = [
    *(f"share_{k}" for k in _KINDS),
    "log_bytes", "log_words", "log_lines", "byte_entropy", "word_mean", "word_deviation", "word_max", "short_words", "long_words", "words_ending_plain",
    "words_with_upper_end", "words_per_stop", "line_mean", "line_short", "distinct_words", "commonest_word", "same_as_before", "distinct_pairs", "distinct_fives", "distinct_lines",
]


def _kind_table() -> np.ndarray:
    table = np.full(256, len(_KINDS) - 1, np.int64)
    for i, members in reversed(list(enumerate(_KINDS.values()))):
        table[list(members)] = i
    return table


_KIND = _kind_table()


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, rows of the commonest hash) of each owner."""
    found, at, count = np.unique(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[at], count)
    return np.bincount(owner[at], minlength=n), most


def statistics(texts: list[bytes]) -> np.ndarray:
    """Texts x STATISTICS."""
    if not texts:
        return np.zeros((0, len(STATISTICS)))
    n = len(texts)
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, n)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    owner = np.repeat(np.arange(n), sizes + 1)
    kind = _KIND[data]
    inner = np.ones(len(data), bool)
    inner[begins[1:] - 1] = False  # the line feeds between texts
    kinds = np.bincount(owner[inner] * len(_KINDS) + kind[inner], minlength=n * len(_KINDS)).reshape(n, -1)
    column = dict(zip((f"share_{k}" for k in _KINDS), (kinds / np.maximum(1, sizes)[:, None]).T, strict=True))
    share = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(begins[:-1], begins[:-1] + sizes, strict=True)]) / np.maximum(1, sizes)[:, None]
    column["byte_entropy"] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)

    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    length, of = (ends - starts).astype(np.float64), owner[starts]
    words = np.bincount(of, minlength=n)
    some = np.maximum(1, words)
    mean = np.bincount(of, length, n) / some
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    last = kind[ends - 1]
    names = list(_KINDS)
    plain = np.isin(last, [names.index(k) for k in ("lower", "upper", "digit", "other")])
    upper = last == names.index("upper")
    column |= {"log_bytes": np.log1p(sizes), "log_words": np.log1p(words), "word_mean": mean, "word_max": longest}
    column["word_deviation"] = np.sqrt(np.maximum(0, np.bincount(of, length**2, n) / some - mean**2))
    for name, flag in (("short_words", length <= 2), ("long_words", length >= 12), ("words_ending_plain", plain), ("words_with_upper_end", upper)):
        column[name] = np.bincount(of, flag, n) / some
    column["words_per_stop"] = words / (1 + kinds[:, names.index("stop")] + kinds[:, names.index("exclaim")])

    hashes, _ = word_hashes(texts)
    distinct, most = _distinct(of, hashes, n)
    same = np.zeros(n)
    if len(hashes) > 1:
        again = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        same = np.bincount(of[1:], again, n)
    column |= {"distinct_words": distinct / some, "commonest_word": most / some, "same_as_before": same / some}
    for name, k in (("distinct_pairs", 2), ("distinct_fives", 5)):
        grams = gram_hashes(hashes, k)
        own = of[: len(grams)] == of[k - 1 :] if len(grams) else np.zeros(0, bool)
        at = of[: len(grams)][own]
        column[name] = _distinct(at, grams[own], n)[0] / np.maximum(1, np.bincount(at, minlength=n))

    # Lines: the words between two line feeds, by the sum of their mixed hashes and places in the line.
    line = np.concatenate(([0], np.cumsum(data == 10)))[starts]
    at, first, count = np.unique(line, return_index=True, return_counts=True)
    place = np.arange(len(line)) - np.repeat(first, count)
    total = np.add.reduceat(mix(hashes + mix(place.astype(np.uint64) + np.uint64(1))), first) if len(first) else np.zeros(0, np.uint64)
    line_of = of[first]
    lines = np.bincount(line_of, minlength=n)
    column |= {"log_lines": np.log1p(lines), "line_mean": words / np.maximum(1, lines), "line_short": np.bincount(line_of, count <= 3, n) / np.maximum(1, lines)}
    column["distinct_lines"] = _distinct(line_of, total, n)[0] / np.maximum(1, lines)
    return np.stack([column[s] for s in STATISTICS], axis=1)


@dataclass
class Trees:
    """Trees of one depth in heap order: node i has the children 2i + 1 (at most the threshold) and 2i + 2."""

    prior: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        trees, inner = self.feature.shape
        node = np.zeros((trees, len(x)), np.int64)
        tree, row = np.arange(trees)[:, None], np.arange(len(x))[None, :]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-(self.prior + self.leaf[tree, node - inner].sum(axis=0))))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, penalty: float = 1.0, least: float = 5.0) -> Trees | None:
    """Boosted trees over rows of statistics and labels from 0 to 1; None without rows. ``least``: rows in a child at least."""
    if not len(y):
        return None
    n, features = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS, method="lower")) for f in range(features)]
    code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    cell = code + np.arange(features) * BINS
    prior = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    margin = np.full(n, prior)
    inner = (1 << depth) - 1
    out = Trees(prior, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)  # within the level
        for level in range(depth):
            width = 1 << level
            at = (node[:, None] * (features * BINS) + cell).ravel()
            shape = (width, features, BINS)
            g, h, c = (np.bincount(at, np.repeat(w, features), width * features * BINS).reshape(shape).cumsum(axis=2) for w in (slope, bend, np.ones(n)))
            g_all, h_all, c_all = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + penalty) + (g_all - g) ** 2 / (h_all - h + penalty) - g_all**2 / (h_all + penalty)
            gain = np.where((c >= least) & (c_all - c >= least), gain, 0).reshape(width, -1)
            best = gain.argmax(axis=1)
            split = gain[np.arange(width), best] > 1e-9
            f, b = best // BINS, best % BINS
            place = (width - 1) + np.arange(width)
            out.feature[t, place] = f
            out.threshold[t, place] = [edges[i][j] if s else np.inf for i, j, s in zip(f, b, split, strict=True)]
            node = 2 * node + (split[node] & (code[np.arange(n), f[node]] > b[node]))
        g, h = np.bincount(node, slope, inner + 1), np.bincount(node, bend, inner + 1)
        out.leaf[t] = -rate * g / (h + penalty)
        margin += out.leaf[t, node]
    return out


def statistics_of(text: Column) -> Column:
    """The statistics of a text column, as an array."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = np.concatenate([np.zeros((0, len(STATISTICS))), *(statistics(texts) for _, texts in pieces(batch))])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32()), pa.array(rows.ravel()))

    return run(text.cast("binary"))


def scored(text: Column, model: Trees | None) -> Column:
    """The score of a text column under a trained model."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [model.score(statistics(texts)) if model else np.full(len(texts), 0.5) for _, texts in pieces(batch)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    return run(text.cast("binary"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> Trees | None:
    """Trees from about ``max_rows`` of the labelled documents; ``labels`` holds only rows that may be learned from."""
    bound_batches(docs.sparkSession)
    means = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.avg(label).alias("__y"))
    share = min(1 << 32, max_rows * (1 << 32) // max(1, means.count()))
    drawn = means.where(F.shiftrightunsigned(F.xxhash64(F.col("__key").cast("string"), F.lit("quality")), 32) < share)
    # Bounded by max_rows, whatever the tables' size.
    met = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(drawn), "__key")
    rows = met.select("__key", "__y", F.xxhash64("__text").alias("__h"), statistics_of(F.col("__text")).alias("__x"))
    rows = rows.groupBy("__key").agg(F.first("__y").alias("y"), F.min_by("__x", "__h").alias("x")).select("y", "x").collect()
    rows.sort(key=lambda r: (r.y, list(r.x)))
    return train(np.array([r.x for r in rows]), np.array([r.y for r in rows], float))


def classify(docs: DataFrame, model: Trees | None, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus score (of label 1) and predicted (1 from a score of 0.5 on). No shuffle."""
    bound_batches(docs.sparkSession)
    return docs.withColumn("score", scored(F.col(text), model)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
