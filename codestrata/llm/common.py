"""Helpers that several operators share: word hashing, scratch tables, checked broadcasts, components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import bound_batches  # noqa: F401  operators take it from here

#: A side is broadcast only up to this many bytes (rows times the given width); beyond it the join shuffles.
BROADCAST_BYTES = 24 << 20
#: A key with more than one in so many rows is hot: its rows are spread. So there are at most so many hot keys.
HOT_KEYS = 2000
#: Texts are taken through numpy in pieces of about this many bytes, so that temporary arrays stay small.
PIECE_BYTES = 1 << 19


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all executors are in this process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="codestrata-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_tables: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_tables() -> None:
    """Deletes this process's scratch tables when the driver ends; failures are left to the folder's owner."""
    for path, spark in _tables.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


atexit.register(_drop_tables)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables of which all consumers are written too."""
    for t in tables:
        path = t._scratch
        if spark := _tables.pop(path, None):
            _delete(spark, path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _tables[path] = spark
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if rows times ``row_bytes`` is at most BROADCAST_BYTES, else with none."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str | Column], how: str = "inner", rows: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and in ``n`` the number of left rows with that key.

    A hot key's rows are spread by the hash of ``by`` over as many parts as it is times too large, and the right row is repeated for each. The
    hot keys, at most HOT_KEYS of them, are broadcast.
    """
    limit = max(1, (left.count() if rows is None else rows) // HOT_KEYS)
    parts = F.ceil(F.col("n") / limit).cast("int")
    hot = right.where(F.col("n") > limit).select(*keys, parts.alias("__parts"))
    spread = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), parts) - 1))).drop("n")
    return spread.join(copies, [*keys, "__salt"], how).drop("__salt")


def give_back() -> None:
    """Gives this process's freed memory back to the system: Arrow's pool and the C heap keep it, and a worker stays when its task ends."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which what it held is given back: up to four idle workers of an executor would each keep the most that any task took."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied


def word_regex_ws(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+`` as an array; null and blank texts give an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def pieces(batch_texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in runs of about PIECE_BYTES; a null text counts as empty."""
    run: list[bytes] = []
    start = size = 0
    for i, value in enumerate(batch_texts):
        text = value.as_py() or b""
        run.append(text)
        size += len(text)
        if size >= PIECE_BYTES:
            yield start, run
            run, start, size = [], i + 1, 0
    if run:
        yield start, run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts, number of words of each text), words split at ASCII white space.

    A word's hash is the weighted sum of mixed byte values, taken from one running sum over the piece:
    base**-start times the difference of the sum between its two ends, all modulo 2**64.
    """
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    total = np.cumsum(table[data] * _powers(base, len(data)))
    total = np.concatenate((np.zeros(1, np.uint64), total))
    hashes = mix((total[ends] - total[starts]) * _powers(inverse, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    return hashes, np.diff(np.searchsorted(starts, bounds))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (``len(words) - n + 1`` of them)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xA0761D6478BD642F) + words[j : len(words) - n + 1 + j]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component): the least node reachable over ``edges`` (a, b), for every node that has an edge.

    Alternates two steps over distributed edges until nothing changes: each node's larger neighbours move to its least
    neighbour, then each node's smaller neighbours do. Only a count and a checksum of the edges reach the driver.
    """

    def with_least(e: DataFrame, value: Column) -> DataFrame:
        # Both sides are read from tables, so that a node with very many neighbours is a skewed join, which Spark splits.
        return e.join(written(e.groupBy("a").agg(value.alias("m")), tag), "a")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    before = state(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, F.least(F.col("a"), F.min("b"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
        joined = with_least(down, F.min("b"))
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(moved.unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), tag)
        discard(e, down)
        e, now = after, state(after)
        if now == before:  # no edge moved, up to a collision of 64 bits over all edges
            break
        before = now
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
