"""Incremental analysis as a stream: changed files are analysed batch by batch, and their facts are kept in versions.

A store is a folder of versions: ``delta-<batch>`` holds the changes of one micro-batch (a row a file that is new, changed or gone), ``base-<batch>``
all live files as of a batch. ``versions`` lists, for each batch, the base and the deltas that make it up; the latest entry counts. A
micro-batch that is run again after a failure writes the same folders again from the version before it, so a restart neither loses nor
repeats anything, and readers of an earlier version are not disturbed until ``keep`` batches have passed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Facts of files (repo, path, content): one row (repo, file, ...) a file, as ``python_facts.syntax`` gives them.
Analyse = Callable[[DataFrame], DataFrame]
KEYS = ["repo", "path"]


def _versions(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root}/versions")
    except AnalysisException:
        return None


def _latest(spark: SparkSession, root: str, before: int | None = None):
    found = _versions(spark, root)
    if found is None:
        return None
    found = found if before is None else found.where(F.col("batch") < before)
    return found.orderBy(F.desc("batch")).first()


def _stored(spark: SparkSession, root: str, version) -> DataFrame:
    """All rows of a version, later ones of a file replacing earlier ones; files that are gone included."""
    folders = ([version.base] if version.base else []) + list(version.deltas)
    rows = spark.read.parquet(*(f"{root}/{f}" for f in folders))
    if len(folders) == 1:
        return rows
    # Only keys and batch numbers are aggregated; whole rows meet them once.
    last = rows.groupBy(*KEYS).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*KEYS, "batch"], "left_semi")


def snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """(repo, path, hash, batch, facts) of all live files, or None before the first batch. facts is a struct of the analyser's columns."""
    version = _latest(spark, root)
    return None if version is None else _stored(spark, root, version).where("NOT gone").drop("gone")


def _changes(spark: SparkSession, root: str, batch: DataFrame, number: int, version, analyse: Analyse) -> DataFrame:
    """Rows of the files that a batch changes: with new facts, or gone. Of several events of a file the last (by seq) counts."""
    last = batch.groupBy(*KEYS).agg(F.max_by(F.struct(F.sha2("content", 256).alias("hash"), "content", "deleted"), "seq").alias("e")).select(*KEYS, "e.*")
    if version is not None:
        known = _stored(spark, root, version).where("NOT gone").select(*KEYS, F.col("hash").alias("old"))
        last = last.join(known, KEYS, "left")
        last = last.where(F.when(F.col("deleted"), F.col("old").isNotNull()).otherwise(F.coalesce(F.col("old") != F.col("hash"), F.lit(True)))).drop("old")
    else:
        last = last.where("NOT deleted")
    facts = analyse(last.where("NOT deleted").select(*KEYS, "content"))
    facts = facts.select("repo", F.col("file").alias("path"), F.struct(*facts.columns).alias("facts"))
    return last.join(facts, KEYS, "left").select(*KEYS, "hash", F.lit(number).cast("long").alias("batch"), F.col("deleted").alias("gone"), "facts")


def apply_batch(batch: DataFrame, number: int, root: str, analyse: Analyse, compact_every: int = 10, keep: int = 20) -> None:
    """Takes one micro-batch of events (repo, path, content, deleted, seq) into the store. A batch that the store has already is skipped."""
    spark = batch.sparkSession
    newest = _latest(spark, root)
    if newest is not None and newest.batch >= number:
        return
    version = newest
    name = f"delta-{number:012d}"
    _changes(spark, root, batch, number, version, analyse).write.mode("overwrite").parquet(f"{root}/{name}")
    base, deltas = (version.base, [*version.deltas, name]) if version is not None else (None, [name])
    made = spark.createDataFrame([(number, base, deltas)], "batch long, base string, deltas array<string>")
    if len(deltas) >= compact_every:
        base = f"base-{number:012d}"
        _stored(spark, root, made.first()).where("NOT gone").write.mode("overwrite").parquet(f"{root}/{base}")
        made = spark.createDataFrame([(number, base, [])], made.schema)
    made.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    _drop_unused(spark, root, number - keep)


def _drop_unused(spark: SparkSession, root: str, before: int) -> None:
    """Deletes the folders that no version from batch ``before`` on refers to."""
    rows = _versions(spark, root).collect()  # one short row a batch
    old = {f for r in rows if r.batch < before for f in [r.base, *r.deltas] if f}
    used = {f for r in rows if r.batch >= before or r.batch == max(x.batch for x in rows) for f in [r.base, *r.deltas] if f}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in sorted(old - used):
        path = hadoop(f"{root}/{folder}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def follow(events: DataFrame, root: str, checkpoint: str, analyse: Analyse, compact_every: int = 10, **trigger) -> StreamingQuery:
    """Starts the stream of file events (repo, path, content, deleted, seq) into the store at ``root``."""
    writer = events.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, root, analyse, compact_every)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
