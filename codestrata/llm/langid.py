"""Language identification by a byte convolutional network, trained in numpy and applied to whole texts.

Network: bytes are embedded, filters of several widths slide over a window of fixed length, each filter keeps its maximum (max pooling,
after a rectifier), and a softmax over languages follows. Training takes windows of a bounded sample of labelled rows: at most ``per_label``
rows of every label (of MOST_ROWS in all; the least hashes of key and text, the same at every run) and ``per_text`` windows spread over
each text. That bound holds for fitting alone. Prediction covers every window of every text: a text's score is the mean of its windows' softmax, each
window weighted by its bytes.

Since a convolution of embedded bytes is a sum of table rows, inference looks up rows of tables over byte pairs.

Edge cases: a null text, or one without any letter, is ``und`` with score 0; a text shorter than a window is padded with byte 0; ties
go to the label that sorts first; repeated rows get equal results; an empty labelled table makes every text ``und``; columns named lang_pred or score are replaced, all others are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, bound_batches, small, tidy, written

WINDOW = 192
WIDTHS = (2, 3, 4)
#: Rows of all labels together in a sample; with many labels each gives fewer rows, but at least one: every label is learned.
MOST_ROWS = 100_000
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray  # 256 x E
    filters: list[np.ndarray]  # for each width w: (w*E) x C
    bias: np.ndarray  # all filters
    out: np.ndarray  # filters x labels
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, tables of 65536 rows over byte pairs and, for an odd width, a last one of 256 rows."""
        e = self.embed.shape[1]
        result = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            single = [self.embed @ f[j * e : (j + 1) * e] for j in range(w)]
            pairs = [(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for j in range(0, w - 1, 2)]
            result.append(pairs + ([single[-1].astype(np.float32)] if w % 2 else []))
        return result


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows_of(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x window bytes, text of each window, bytes in each window): all bytes, the last window of a text padded with 0."""
    counts = np.array([max(1, -(-len(t) // window)) for t in texts])
    data = np.frombuffer(b"".join(t.ljust(int(c) * window, b"\0") for t, c in zip(texts, counts, strict=True)), np.uint8).reshape(-1, window)
    owner = np.repeat(np.arange(len(texts)), counts)
    size = np.full(len(data), window)
    size[np.cumsum(counts) - 1] = [len(t) - (int(c) - 1) * window for t, c in zip(texts, counts, strict=True)]
    return data, owner, size


def train(samples: list[tuple[bytes, str]], window: int = WINDOW, embed: int = 12, channels: int = 12, epochs: int = 12, batch: int = 128, rate: float = 0.004, seed: int = 3) -> Network | None:
    """Adam on cross-entropy over (window, label) samples; None without samples."""
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    labels = sorted({x[1] for x in samples})
    x = np.frombuffer(b"".join(t[:window].ljust(window, b"\0") for t, _ in samples), np.uint8).reshape(-1, window)
    place = {lang: i for i, lang in enumerate(labels)}
    y = np.array([place[lang] for _, lang in samples])
    p = {"e": rng.normal(0, 0.5, (256, embed)), "b": np.zeros(channels * len(WIDTHS)), "o": rng.normal(0, 0.2, (channels * len(WIDTHS), len(labels))), "ob": np.zeros(len(labels))}
    p |= {f"f{w}": rng.normal(0, 1 / np.sqrt(w * embed), (w * embed, channels)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    mean, square, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    weight = (len(y) / (len(labels) * np.maximum(1, np.bincount(y, minlength=len(labels))))).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            xb, yb, n = x[rows], y[rows], len(rows)
            if step % 2:  # short texts and ends of texts are padded, so half of the batches are too
                xb = np.where(np.arange(window) < rng.integers(24, window, (n, 1)), xb, np.uint8(0))
            z = p["e"][xb]
            pooled, arg = [], []
            for w in WIDTHS:
                cols = np.concatenate([z[:, j : window - w + 1 + j] for j in range(w)], axis=2)
                a = cols @ p[f"f{w}"]
                k = a.argmax(axis=1)
                arg.append((w, k))
                pooled.append(np.take_along_axis(a, k[:, None, :], 1)[:, 0])
            h = np.concatenate(pooled, axis=1) + p["b"]
            r = np.maximum(h, 0)
            prob = _softmax(r @ p["o"] + p["ob"])
            d = prob.copy()
            d[np.arange(n), yb] -= 1
            d *= (weight[yb] / n)[:, None]
            g = {"o": r.T @ d, "ob": d.sum(axis=0)}
            dh = (d @ p["o"].T) * (h > 0)
            g["b"] = dh.sum(axis=0)
            de = np.zeros_like(p["e"])
            for i, (w, k) in enumerate(arg):
                part = dh[:, i * channels : (i + 1) * channels]
                place = k[:, :, None] + np.arange(w)  # n x channels x w
                taken = xb[np.arange(n)[:, None, None], place]
                vectors = p["e"][taken].reshape(n, channels, w * embed)
                g[f"f{w}"] = np.einsum("nc,nck->kc", part, vectors)
                back = part[:, :, None] * p[f"f{w}"].T[None]
                np.add.at(de, taken.reshape(-1), back.reshape(-1, embed))
            g["e"] = de
            step += 1
            for name, grad in g.items():
                mean[name] = 0.9 * mean[name] + 0.1 * grad
                square[name] = 0.999 * square[name] + 0.001 * grad * grad
                p[name] = (p[name] - rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(labels, p["e"], [p[f"f{w}"] for w in WIDTHS], p["b"], p["o"], p["ob"])


def window_probabilities(net: Network, tables: list[list[np.ndarray]], data: np.ndarray) -> np.ndarray:
    """Softmax of each window (rows of bytes)."""
    pooled = []
    pair = data[:, :-1].astype(np.uint16) * np.uint16(256) + data[:, 1:]
    for w, parts in zip(WIDTHS, tables, strict=True):
        n = data.shape[1] - w + 1
        a = None
        for j, table in enumerate(parts):
            got = table[pair[:, 2 * j : 2 * j + n]] if len(table) == 65536 else table[data[:, 2 * j : 2 * j + n]]
            a = got if a is None else np.add(a, got, out=a)
        pooled.append(a.max(axis=1))
    return _softmax(np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.out_bias)


def predict(net: Network | None, tables: list[list[np.ndarray]], texts: list[bytes]) -> list[tuple[str, float]]:
    """(label, score) of each text."""
    if net is None or not texts:
        return [("und", 0.0)] * len(texts)
    data, owner, size = windows_of(texts)
    total = np.zeros((len(texts), len(net.labels)))
    for at in range(0, len(data), 1024):
        p = window_probabilities(net, tables, data[at : at + 1024])
        np.add.at(total, owner[at : at + 1024], p * size[at : at + 1024, None])
    total /= np.maximum(1, np.bincount(owner, weights=size, minlength=len(texts)))[:, None]
    best = total.argmax(axis=1)
    letter = [bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in texts]
    return [(net.labels[b], float(min(1.0, total[i, b]))) if letter[i] else ("und", 0.0) for i, b in enumerate(best)]


def sample(labelled: DataFrame, key: str, text: str, lang: str, per_label: int, per_text: int, window: int = WINDOW) -> list[tuple[bytes, str]]:
    """Windows of about ``per_label`` rows of every label, fewer where all labels together would give over MOST_ROWS: a bounded sample for fitting, by
    a hash of key and text.

    Labels are counted first; a row takes part if its hash lies below the share that leaves twice the wanted rows of its label (40 or more), so windows of
    few rows are cut, within the tasks that read them, and no text is shuffled. Of these, the least hashes count.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).cast("binary").alias("t"), F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit("langid")).alias("h"))
    counts = written(known.groupBy("l").agg(F.count("*").alias("n")), "labels")
    labels = counts.count()
    if not labels:
        return []
    per_label = max(1, min(per_label, MOST_ROWS // labels))
    drawn = max(2 * per_label, 40)  # so many that no label is left without a row
    bound = F.when(F.col("n") <= 2 * drawn, F.lit(1 << 32)).otherwise(F.expr(f"{drawn * (1 << 32)}L div n"))
    # Rows are drawn by 32 bits of the hash, and ranked by all of it.
    taken_rows = known.join(small(counts, 64), "l").where(F.shiftrightunsigned("h", 32) < bound)
    step = F.greatest(F.lit(1), F.floor(F.octet_length("t") / per_text)).cast("int")
    cut = taken_rows.select("l", "h", F.transform(F.sequence(F.lit(0), F.lit(per_text - 1)), lambda i: F.substring("t", i * step + 1, F.lit(window))).alias("w"))
    rows = sorted({(r.l, r.h, tuple(map(bytes, r.w))) for r in cut.toLocalIterator()})
    taken: Counter = Counter()
    out = set()
    for label, _, windows in rows:
        taken[label] += 1
        if taken[label] <= per_label:
            out |= {(w, label) for w in windows if w}
    return sorted(out)


def predicted(text: Column, net: Network | None) -> Column:
    """struct<lang, score> of a text column under a trained network."""

    @F.arrow_udf("struct<lang: string, score: double>")
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = net.tables() if net else []
        for texts in batches:
            out: list[tuple[str, float]] = []
            run, size = [], 0
            for x in texts:
                run.append(x.as_py() or b"")
                size += len(run[-1])
                if size >= PIECE_BYTES:
                    out += predict(net, tables, run)
                    run, size = [], 0
            out += predict(net, tables, run)
            yield pa.array([{"lang": a, "score": b} for a, b in out], pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    return run(text.cast("binary"))


def identify(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_label: int = 500, per_text: int = 5) -> DataFrame:
    """All rows and columns of ``docs`` plus lang_pred and score, from a network trained on a bounded sample of ``labelled``."""
    bound_batches(docs.sparkSession)
    net = train(sample(labelled, key, text, lang, per_label, per_text))
    return docs.withColumn("__p", predicted(F.col(text), net)).withColumn("lang_pred", F.col("__p.lang")).withColumn("score", F.col("__p.score")).drop("__p")
