"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. All but
the last return the columns of ``documents``. Near duplicates are decided by row, so null and repeated doc_ids go like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import decontam, jaccard, langid, packing, substrings, tokens
from codestrata.llm.common import discard, small, written

#: A text stays if some language is at least this likely; text without letters never is.
MIN_SCORE = 0.35
#: Columns that operators read.
READ = ("doc_id", "text")


def _packed_row(docs: DataFrame) -> DataFrame:
    """(doc_id, text, __row: all other columns), so that what operators add replaces no column of the corpus, whatever its name."""
    return docs.select(*READ, F.struct(*(F.col(c) for c in docs.columns if c not in READ)).alias("__row"))


def _columns(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``docs`` from packed rows, some of them replaced."""
    return [new.get(c, F.col(c) if c in READ else F.col("__row")[c]).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are not text in a known language: null, without a letter, or undecided."""
    found = langid.identify(_packed_row(docs), docs)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies: that of least id (null ids last), then of least hash; and one of rows alike in id and text.

    A row's key is its id and 128 bits of hash over id and text. Rows alike in both share a key.
    """
    none = F.col("doc_id").isNull()
    h1, h2 = F.xxhash64(none, "doc_id", "text"), F.xxhash64(F.lit(1), none, "doc_id", "text")
    key = F.struct(none.alias("none"), F.coalesce("doc_id", F.lit(0).cast(dict(docs.dtypes)["doc_id"])).alias("id"), h1.alias("h1"), h2.alias("h2"))
    lowered = docs.select(key.alias("__row"), "doc_id", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("text"))
    classes = written(jaccard.classes(lowered, key="__row", number="doc_id").select("__row", F.col("component_id").alias("kept")), "near-classes")
    if classes.groupBy("__row").count().where("count > 1").limit(1).count():
        docs = docs.dropDuplicates(["doc_id", "text"])
    gone = written(classes.where("__row <> kept").select(F.col("__row.h1").alias("__h1"), F.col("__row.h2").alias("__h2")).distinct(), "near-gone")
    return docs.withColumn("__h1", h1).withColumn("__h2", h2).join(small(gone, 24), ["__h1", "__h2"], "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated windows of 35 words out of the texts; a document of which nothing is left goes."""
    found = substrings.remove_repeats(_packed_row(docs)).where("repeats.n_removed = 0 OR repeats.n_removed < repeats.n_words")
    kept = F.col("repeats.kept")
    return found.select(_columns(docs, text=kept, n_chars=F.length(kept).cast("long")))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontam.decontaminate(_packed_row(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("hits.n_hit = 0").select(_columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences, tokens plus one separator for each document; an empty text takes no room."""
    import public_tokenizers

    n = tokens.token_count(F.coalesce("text", F.lit("")), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs.select("doc_id", n.alias("n")), F.when(F.col("n") > 0, F.col("n") + 1).otherwise(0))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packed", packed),
]

#: The network of the first stage is not expressible in SQL; tests hold every stage against a plain version of it (tests/llm/test_queries.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)  # the table after it is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
