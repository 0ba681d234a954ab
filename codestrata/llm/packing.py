"""Variable-capacity best-fit packing of documents into training sequences.

Documents are cut into pieces of at most the largest permitted length (nothing is dropped), and pieces are dealt by a hash of their
content into packing groups of bounded size, each of which one task packs: pieces from long to short, each into the open bin it fills
best; if none has room, a bin is opened in the size that costs least for each token it can still be given, counting all permitted
lengths jointly; in the end each bin shrinks to the least permitted length that holds its contents. The cost of a bin of c tokens is
``fixed`` + c + c*c/``square``: a constant for each sequence, a linear part, and attention.

Edge cases: null, empty and wordless texts have length 0 and take no room: they come out with bin null, capacity null and length 0, so
that no row is lost; ties are settled by key, piece and copy; repeated rows are packed once
each; null and repeated keys are kept; a very long text is many pieces; columns other than the key are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces of a packing group, about. A group is what one task holds at a time.
GROUP_PIECES = 8_000
#: Rows alike in key and length that go on as one row of a lot.
LOT = 4096


def cost(capacity: int, fixed: float, square: float) -> float:
    return fixed + capacity + capacity * capacity / square


def best_fit(lengths: list[int], capacities: tuple[int, ...], fixed: float = 64.0, square: float = 16384.0) -> tuple[list[int], list[int]]:
    """(bin of each piece, final capacity of each bin) for pieces that come from long to short."""
    sizes = sorted(capacities)
    room: list[tuple[int, int]] = []  # (tokens left, bin), sorted
    used: list[int] = []
    bins: list[int] = []
    rest = sum(lengths)
    for n in lengths:
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            c = min((c for c in sizes if c >= n), key=lambda c: (cost(c, fixed, square) / min(c, rest), c))
            left, b = c, len(used)
            used.append(0)
        bins.append(b)
        used[b] += n
        rest -= n
        if left > n:
            insort(room, (left - n, b))
    return bins, [sizes[bisect_left(sizes, u)] for u in used]


def pack(docs: DataFrame, length: Column, key: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, fixed: float = 64.0, square: float = 16384.0) -> DataFrame:
    """One row for each piece: ``key``, piece (0, 1, ...), start and length in tokens, bin (long), offset in the bin, capacity.

    Texts are read once. Only narrow rows are shuffled: rows with one key and length are counted (as they may be very many, they go on in lots of
    LOT copies), and their pieces are dealt by key, length, copy and piece. So a null or repeated key spreads like any others, and a group's
    size does not depend on how long documents are.
    """
    top = max(capacities)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    counted = written(rows.groupBy("key", "n").agg(F.count("*").alias("m")), "lengths")
    groups = max(1, math.ceil((counted.select(F.sum(F.ceil(F.col("n") / top) * F.col("m"))).first()[0] or 0) / GROUP_PIECES))
    lots = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / LOT))).alias("lot")).repartition("key", "n", "lot")
    copies = lots.select("key", "n", F.explode(F.sequence(F.col("lot") * LOT, F.least("m", (F.col("lot") + 1) * LOT) - 1)).alias("copy"))
    cut = copies.select("key", "n", "copy", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / top).cast("int") - 1)), lambda i: F.least(F.lit(top), F.col("n") - i * top).cast("long"))).alias("piece", "length"))
    full = cut.where("length > 0").select("key", "piece", (F.col("piece") * top).cast("long").alias("start"), "length", "copy", F.pmod(F.xxhash64("key", "n", "copy", "piece", F.lit("pack")), F.lit(groups)).cast("int").alias("g"))

    def run(group: tuple, table: pa.Table) -> pa.Table:
        n, keys, piece, copy = (table.column(c).to_pylist() for c in ("length", "key", "piece", "copy"))
        order = sorted(range(len(n)), key=lambda i: (-n[i], keys[i] is not None, keys[i] if keys[i] is not None else 0, piece[i], copy[i]))
        bins, sizes = best_fit([n[i] for i in order], capacities, fixed, square)
        filled = [0] * len(sizes)
        offsets = []
        for i, b in zip(order, bins, strict=True):
            offsets.append(filled[b])
            filled[b] += n[i]
        out = table.take(pa.array(order, pa.int64())).select(["key", "piece", "start", "length"])
        for name, values, kind in (("bin", [group[0].as_py() + groups * b for b in bins], pa.int64()), ("offset", offsets, pa.int64()), ("capacity", [sizes[b] for b in bins], pa.int32())):
            out = out.append_column(name, pa.array(values, kind))
        return out

    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, piece int, start long, length long, bin long, offset long, capacity int"
    packed = full.groupBy("g").applyInArrow(run, schema)
    none = copies.where("n = 0").select("key", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.col("n").alias("length"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("int").alias("capacity"))
    return packed.unionByName(none).withColumnRenamed("key", key)
