"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows fall into source blocks by a hash of their content. How many rows each block sends to each shard is drawn beforehand, exactly as
a uniform shuffle would deal them: row by row of the matrix, multivariate hypergeometric with the room that shards have left. Each
block is then permuted locally (a window ordered by a seeded hash) and cut by its counts, the rows are exchanged, and each shard is
permuted again. Shard sizes are exact: at most one row apart.

Only DataFrame functions touch rows. The driver sees one count per block, never rows.

Edge cases: an empty table gives an empty result; fewer rows than shards leave shards empty; null ids and texts are hashed like any
value; rows that are alike in every column are interchangeable, and where they are very many, they are spread by their place in the input, so that
no block gets them all (a table's scan gives the same places again if a task is lost); columns named shard or slot are replaced.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W



def _blocks(rows: int) -> int:
    """Blocks for so many rows: their number and their size both grow with the square root, so neither a block nor the matrix gets large."""
    return max(1, math.ceil(math.sqrt(rows) / 8))


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement, for counts of any size.

    Weights run outward from the mode by the ratios of neighbours, twelve standard deviations to either side (beyond lies less than
    1e-30), and one of them is drawn in proportion.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1)))
    reach = int(12 * spread) + 20
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rising = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    falling = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.cumsum(np.concatenate((falling[::-1], [1.0], rising)))
    return mode - len(falling) + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """counts[b] rows of block b dealt to ``shards`` of equal size (at most one apart): matrix[b][s], with exact row and column sums."""
    rng = random.Random(seed)
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in counts:
        row, left = [], sum(room)
        for r in room:
            left -= r
            row.append(hypergeometric(rng, r, left, n))
            n -= row[-1]
        room = [r - x for r, x in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def _draw(seed: int, salt: str, columns: list[str]) -> Column:
    return F.xxhash64(F.lit(f"{seed}/{salt}"), *columns)


def hypergeometric_shuffle(df: DataFrame, shards: int = 16, seed: int = 7, identity: list[str] | None = None) -> DataFrame:
    """All rows and columns of ``df`` plus shard (int) and slot (long, gapless from 0 within each shard), uniformly at random.

    ``identity`` names the columns whose content decides a row's place (default: all); rows alike in them are interchangeable.
    Two shuffles of the rows; every task sorts one block at a time, in spillable windows. What is broadcast grows with the square root of the
    rows: the cuts (one row of ``shards`` numbers a block) and the starts of parts take some 16 MB for 10**12 rows.
    """
    spark, keys = df.sparkSession, [*(identity or df.columns), "__copy"]
    rows = df.count()
    blocks = _blocks(rows)
    # Rows alike in all of their columns, if they are more than a block or a thousandth of all: at most a thousand such contents.
    content = F.xxhash64(*keys[:-1])
    many = df.groupBy(content.alias("__content")).count().where(F.col("count") > max(1000, rows // 1000)).select("__content", F.lit(True).alias("__many"))
    if many.limit(1).count():
        df = df.withColumn("__content", content).join(F.broadcast(many), "__content", "left").withColumn("__copy", F.when(F.col("__many"), F.monotonically_increasing_id()).otherwise(0)).drop("__content", "__many")
    else:
        df = df.withColumn("__copy", F.lit(0).cast("long"))
    block = F.pmod(_draw(seed, "block", keys), F.lit(blocks)).cast("int")
    sizes = {r[0]: r[1] for r in df.groupBy(block.alias("b")).count().collect()}  # one row a block
    matrix = communication_matrix([sizes.get(b, 0) for b in range(blocks)], shards, seed)
    cuts = "\n".join(f"{b}:{','.join(str(sum(row[: s + 1])) for s in range(shards))}" for b, row in enumerate(matrix))
    ends = spark.sql("SELECT explode(split(:cuts, '\\n')) AS line", {"cuts": cuts}).select(F.substring_index("line", ":", 1).cast("int").alias("__block"), F.split(F.substring_index("line", ":", -1), ",").cast("array<long>").alias("__ends"))
    local = W.partitionBy("__block").orderBy(_draw(seed, "local", keys), *keys)
    dealt = (
        df.withColumn("__block", block)
        .withColumn("__place", F.row_number().over(local))
        .join(F.broadcast(ends), "__block")
        .withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__place"))).cast("int"))
        .drop("__ends", "__place", "__block")
    )
    # The second permutation: a random order of the shard, in parts that follow one another.
    parts = _blocks(sum(sizes.values()) // shards)
    dealt = dealt.withColumn("__part", F.pmod(_draw(seed, "part", keys), F.lit(parts)).cast("int"))
    starts = dealt.groupBy("shard", "__part").count().withColumn("__start", F.sum("count").over(W.partitionBy("shard").orderBy("__part")) - F.col("count")).drop("count")
    inner = W.partitionBy("shard", "__part").orderBy(_draw(seed, "slot", keys), *keys)
    return dealt.withColumn("__rank", F.row_number().over(inner)).join(F.broadcast(starts), ["shard", "__part"]).withColumn("slot", (F.col("__start") + F.col("__rank") - 1).cast("long")).drop("__start", "__rank", "__part", "__copy")
