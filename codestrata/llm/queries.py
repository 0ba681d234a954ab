"""One query for each operator, over its whole table, and the SQL that checks it where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, decontam, html, jaccard, langid, licenses, packing, periodic, quality, shards, spelling, substrings, tokens
from .common import word_regex_ws


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against benchmark items, windows of 10 words."""
    found = decontam.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    h = F.col("hits")
    return found.select(
        "doc_id",
        h.n_words.alias("n_words"),
        h.n_hit.alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"),
        (h.n_hit > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM pat),
win AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), lens WHERE i + n - 1 <= len(w)),
hit AS (SELECT doc_id, i, win.n, item_id FROM win JOIN pat ON win.s = pat.s AND win.n = pat.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents over links of 0.8 or more between sets of five-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("text"))
    return jaccard.classes(docs).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(s) AS s FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 80 * (na.n + nb.n - m)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS x, b AS y FROM both_ways UNION SELECT r.x, both_ways.b FROM r JOIN both_ways ON r.y = both_ways.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(c.y, d.doc_id)) AS BIGINT) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) c ON c.x = d.doc_id
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, laid out as files of repositories: one per source, with two levels of directories.

    Every fortieth document is a licence file of its source, of a directory, or of a sub-directory.
    """
    i = F.coalesce(F.col("doc_id"), F.lit(0))
    top, sub = F.concat(F.lit("p"), (i % 97).cast("string")), F.concat(F.lit("d"), (F.floor(i / 97) % 5).cast("string"))
    kind = F.floor(i / 40) % 3
    name = F.concat(F.lit("LICENSE-"), i.cast("string"))
    path = F.when((i % 40 == 0) & (kind == 0), F.concat_ws("/", "source", name)).when((i % 40 == 0) & (kind == 1), F.concat_ws("/", "source", top, name)).when(i % 40 == 0, F.concat_ws("/", "source", top, sub, name)).otherwise(F.concat_ws("/", "source", top, sub, F.concat(i.cast("string"), F.lit(".txt"))))
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without windows of 35 words whose sequence starts anywhere else."""
    r = F.col("repeats")
    kept = F.trim(F.regexp_replace(r.kept, r"[\x20\x09-\x0D]+", " "))
    found = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", r.n_words.alias("n_words"), r.n_removed.alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE s IN (SELECT s FROM rep)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM words ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id
"""


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; fitted on documents outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), docs.where(~held_out()))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 whose row counts are at most one apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = shards.hypergeometric_shuffle(docs, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of so many words plus one separator packed into sequences of the permitted lengths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.size(word_regex_ws(F.col("text")))
    return packing.pack(docs, F.when(n > 0, n + 1).otherwise(0))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under byte_bpe_50k.json."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that match every fiftieth one. Each vector is played as a melody. Of every ten ids, that ending in 3 is a recording of the melody
    of the one ending in 0 that begins later and is softer, that ending in 7 one with noise, and that ending in 9 one with ten times the noise (if there is such a vector)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    last = F.pmod("vec_id", F.lit(10))
    made = F.coalesce(last.isin(3, 7, 9), F.lit(False))
    source = e.where(last == 0).select(F.col("vec_id").alias("of"), F.col("embedding").alias("played"))
    # Only those rows are joined that may have a source: all others would meet under one null key.
    joined = e.where(made).withColumn("of", F.col("vec_id") - last).join(source, "of", "left").select("vec_id", "embedding", "played")
    alone = e.where(~made).withColumn("played", F.lit(None).cast(dict(e.dtypes)["embedding"]))
    r = joined.unionByName(alone).withColumn("copy", F.col("played").isNotNull() & (last == 3)).withColumn("noisy", F.col("played").isNotNull() & last.isin(7, 9))
    r = r.repartition(max(spark.sparkContext.defaultParallelism, e.count() // 1000), "vec_id", "embedding")
    how = (F.when(F.col("copy"), 1317).otherwise(0), F.when(F.col("copy"), 0.4).otherwise(1.0), F.when(F.col("noisy"), F.when(last == 7, 0.02).otherwise(0.2)).otherwise(0.0), F.coalesce(F.abs("vec_id"), F.lit(0)))
    prints = r.select("vec_id", audio.melody_fingerprints(F.coalesce("played", "embedding"), *how).alias("print"))
    return audio.search(prints, e.where("vec_id % 50 = 0").select("vec_id"), "vec_id")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laid-out visible text of every page."""
    return html.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where each tenth document, by the checksum h of its id, repeats p of its words from word a on to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    cut = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, word_regex_ws(F.col("text"))).alias("w")).withColumn("n", F.size("w").cast("long"))
    placed = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int"))
    left = (F.col("n") - F.col("a")).cast("int")
    times = F.ceil(left / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), F.lit(1), left)
    repeated = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of 12 words or more in every document, a tenth of which get a repeated passage."""
    found = periodic.periodic_runs(with_planted_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    runs = F.col("runs.runs")
    # The longest, then that of least start, then of least period, stands first in this order.
    best = F.array_min(F.transform(runs, lambda x: F.struct((-x.length).alias("length"), x.start.alias("start"), x.period.alias("period"))))
    lines = F.array_join(F.transform(runs, lambda x: F.concat(F.concat_ws(",", x.start.cast("string"), x.length.cast("string"), x.period.cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("runs.collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id",
        "n_runs",
        F.col("b.start").alias("start"),
        (-F.col("b.length")).alias("length"),
        F.col("b.period").alias("period"),
        F.expr("-1000 * b.length div b.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def quality_held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; fitted on labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality").where(~quality_held_out()))
    return quality.classify(docs, model).select("doc_id", F.coalesce(quality_held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def words_with_errata(docs: DataFrame) -> DataFrame:
    """(word) of every letter run of six or more; where 199 divides the checksum of `<doc_id>:<run>`, the run lacks one character."""
    runs = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(":")).alias("id"), F.explode(spelling.letter_runs(F.col("text"), 6)).alias("word"))
    h = runs.withColumn("h", F.crc32(F.concat("id", "word").cast("binary")))
    at = (F.col("h") % F.length("word")).cast("int")
    return h.select(F.when(F.col("h") % 199 == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))).otherwise(F.col("word")).alias("word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, a 199th of which lack a character, with the near word that each is a variant of."""
    return spelling.variants(spelling.counted(words_with_errata(table(spark, sf_dir, "documents").select("doc_id", "text"))))


# The checksum goes over the half bytes of the text's hexadecimal form, the lower half of each byte first, with the table of 16 steps.
OP13_SQL = r"""
WITH RECURSIVE run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS n FROM run WHERE length(w) >= 6 GROUP BY ALL),
hexed AS (SELECT doc_id, w, n, hex(encode(doc_id || ':' || w)) AS x FROM d),
halves AS (SELECT doc_id, w, n, list_transform(range(0, length(x)), lambda i: CAST(instr('0123456789ABCDEF', x[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) - 1 AS BIGINT)) AS b FROM hexed),
sums AS (SELECT doc_id, w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, y: xor(
  [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(c, y) & 15) + 1]::BIGINT, c >> 4)), 4294967295::BIGINT) AS h FROM halves),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM sums),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
del AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b FROM del a JOIN del b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT del.word, v.word FROM del JOIN v ON del.s = v.word UNION SELECT v.word, del.word FROM del JOIN v ON del.s = v.word),
ranked AS (SELECT p.a, p.b, v.n, count(*) OVER (PARTITION BY p.a) AS k, row_number() OVER (PARTITION BY p.a ORDER BY v.n DESC, p.b) AS r FROM p JOIN v ON v.word = p.b),
f AS (SELECT v.word, v.n, coalesce(k, 0) AS n_near, CASE WHEN ranked.n >= 5 * v.n THEN b END AS form, CASE WHEN ranked.n >= 5 * v.n THEN ranked.n END AS form_n FROM v LEFT JOIN ranked ON a = word AND r = 1),
way AS (SELECT word, word AS root FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL),
last AS (SELECT way.word, way.root FROM way JOIN f ON f.word = way.root WHERE f.form IS NULL)
SELECT f.word, f.form, last.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN last ON last.word = f.word
"""


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_license_scan": op3_license_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_sharding": op6_sharding,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_counts": op8_token_counts,
    "op9_audio_fingerprints": op9_audio_fingerprints,
    "op10_html_extraction": op10_html_extraction,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL = {"op1_decontamination": OP1_SQL, "op2_ngram_jaccard": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op13_spelling_variants": OP13_SQL}
