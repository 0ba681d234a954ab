"""All queries over the tables, by name, each with the SQL that checks it.

Queries come in three kinds: over documents and events as they are, over the part graph (parts as files, order lines as edges), and over the
files that ``sources.corpus`` writes, whose facts are known.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, scratch, tables, telemetry
from ..functions.columns import join_routes, normal_path, parent_of, suffix_of
from ..operators import artifact, derive, graphs, languages, quality, resolve, technology, views
from ..sources import archives, corpus, repository
from ..streaming import admission, incremental
from . import known_facts as known
from .analysis import Analysis

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


# Documents as files -------------------------------------------------------------------------------------------------------------------

EXTENSIONS = [".py", ".js", ".ts", ".tsx", ".sql", ".md", ".json", ".css", ".txt"]
DOC_DIRS = ["src", "node_modules/x", "docs", "build", "lib"]


def _doc_path(text: str) -> str:
    ext = "CASE " + " ".join(f"WHEN doc_id % 9 = {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS)) + " END"
    top = "CASE " + " ".join(f"WHEN doc_id % 5 = {i} THEN '{d}'" for i, d in enumerate(DOC_DIRS)) + " END"
    return f"concat({top}, '/', lang, '/d', CAST(doc_id AS {text}), {ext})"


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source's repository."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("repo"), F.expr(_doc_path("STRING")).alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("bytes"), F.col("doc_id").alias("file_ord"))


DOC_FILES = f"files AS (SELECT source AS repo, {_doc_path('VARCHAR')} AS path, text AS content, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, doc_id AS file_ord FROM documents)"
SUFFIX = "lower(regexp_extract(path, '(\\.[^./]+)$', 1))"
SUFFIX_SPARK = r"lower(regexp_extract(f.path, '(\\.[^./]+)$', 1))"
LANGUAGE = "CASE " + " ".join(f"WHEN {SUFFIX} = '{k}' THEN '{v}'" for k, v in fixed.LANGUAGES.items()) + " ELSE 'Configuration' END"
RECORDS = f"{DOC_FILES}, records AS (SELECT repo, path, {LANGUAGE} AS language, CAST(len(content) - len(replace(content, chr(10), '')) + 1 AS BIGINT) AS lines, bytes, sha256(content) AS hash FROM files)"
CODE = "language NOT IN ('Configuration', 'Markdown')"


@query(f"WITH {RECORDS} SELECT repo, concat('file:', path) AS id, path, language, lines, bytes, hash, 'source' AS role FROM records")
def file_records(spark, sf_dir):
    return derive.file_records(doc_files(spark, sf_dir))


@query(f"WITH {RECORDS}, s AS (SELECT repo, language, CAST(sum(lines) AS BIGINT) AS lines FROM records WHERE {CODE} GROUP BY ALL) SELECT repo, language, lines, round_even(CAST(lines AS DOUBLE) / sum(lines) OVER (PARTITION BY repo) * 100, 1) AS share FROM s")
def language_shares(spark, sf_dir):
    return derive.language_shares(derive.file_records(doc_files(spark, sf_dir)))


@query(f"WITH {RECORDS} SELECT repo, language, count(*) AS files FROM records WHERE {CODE} GROUP BY ALL")
def language_counts(spark, sf_dir):
    return derive.language_counts(derive.file_records(doc_files(spark, sf_dir)))


@query(
    f"""WITH {DOC_FILES} SELECT repo, path, CASE WHEN bytes > 20000 THEN 'file_size_limit' ELSE 'kept' END AS outcome FROM files
    WHERE NOT list_has_any(string_split(path, '/'), {_list(fixed.IGNORED_DIRS)}) AND ({SUFFIX} IN {_in(fixed.SUFFIXES)} OR regexp_extract(path, '[^/]*$') IN {_in(fixed.SPECIAL_NAMES)})"""
)
def discovered_files(spark, sf_dir):
    """Discovery checks over documents, with a limit of 20 000 bytes a file."""
    raw = doc_files(spark, sf_dir).select("repo", "path", F.col("content").cast("binary").alias("content"), "bytes", F.lit(False).alias("symlink"))
    files, skipped = repository.discover(raw, repository.Limits(files=10**9, file_bytes=20000), gitignore=False)
    return files.select("repo", "path", F.lit("kept").alias("outcome")).unionByName(skipped.select("repo", "path", F.col("reason").alias("outcome")))


#: Ignore rules of documents as (repo, base, line), later lines of a file coming later: rows for all repositories, and one or two for some documents.
_RULES = """SELECT source AS repo, '' AS base, concat('d', CAST(doc_id AS {text}), '.*') AS line, doc_id + 10 AS n FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT source, concat('docs/', lang), concat('!d', CAST(doc_id AS {text}), '.ts'), doc_id FROM documents WHERE doc_id % 14 = 0
UNION ALL SELECT source, 'lib', concat(lang, '/d', CAST(doc_id AS {text}), '.md'), doc_id FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT source, '', t.line, t.n FROM (SELECT DISTINCT source FROM documents) r, (VALUES ('*.css', 1), ('build/en/', 2), ('fr/', 3), ('!src/fr/', 4), ('# none', 5)) t(line, n)"""


@query(
    f"""WITH {DOC_FILES}, rules AS ({_RULES.format(text="VARCHAR")}), r AS (SELECT repo, base, ltrim(line, '!') AS p, starts_with(line, '!') AS negated, [len(string_split(base, '/')) - (base = '')::INT, n] AS ord, base || n AS tie FROM rules),
    below AS (SELECT f.repo, f.path, r.*EXCLUDE (repo), CASE WHEN base = '' THEN path ELSE substr(path, len(base) + 2) END AS b FROM files f JOIN r ON r.repo = f.repo AND (base = '' OR starts_with(path, base || '/'))),
    hit AS (SELECT * FROM below WHERE CASE WHEN p = '*.css' THEN suffix(path, '.css') WHEN p = 'fr/' THEN contains('/' || b, '/fr/') WHEN suffix(p, '/') THEN contains('/' || b, '/' || p) WHEN contains(p, '/') THEN b = p OR suffix(b, '/' || p)
      WHEN suffix(p, '.*') THEN contains('/' || b, '/' || substr(p, 1, len(p) - 1)) WHEN p = '# none' THEN false ELSE contains('/' || b || '/', '/' || p || '/') END)
    SELECT repo, path FROM files ANTI JOIN (SELECT repo, path FROM hit GROUP BY ALL HAVING NOT arg_max(negated, ord)) USING (repo, path)"""
)
def ignored_files(spark, sf_dir):
    """Documents as files that no ignore rule takes away: names, directories, endings, wildcards, rules of nested directories and exceptions."""
    rules = spark.sql(_RULES.format(text="STRING").replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    texts = rules.groupBy("repo", "base").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("content"))
    raw = texts.select("repo", F.when(F.col("base") == "", ".gitignore").otherwise(F.concat("base", F.lit("/.gitignore"))).alias("path"), F.col("content").cast("binary").alias("content"))
    return repository.apply_gitignore(doc_files(spark, sf_dir).select("repo", "path"), repository.gitignore_rules(raw))


@query(f"WITH {DOC_FILES} SELECT repo, path, bytes, CAST(sum(bytes) OVER w AS BIGINT) AS total, sum(bytes) OVER w <= 50000 AS within FROM files WINDOW w AS (PARTITION BY repo ORDER BY file_ord ROWS UNBOUNDED PRECEDING)")
def cumulative_size_cap(spark, sf_dir):
    return repository.cumulative_cap(doc_files(spark, sf_dir), 50000).select("repo", "path", "bytes", "total", "within")


@query(f"""WITH {DOC_FILES} SELECT repo, 'info' AS severity, 'skipped_file_size_limit' AS code, concat('Skipped ', path, ': file_size_limit') AS message, path AS file FROM files WHERE bytes > 9000
    AND NOT list_has_any(string_split(path, '/'), {_list(fixed.IGNORED_DIRS)}) AND ({SUFFIX} IN {_in(fixed.SUFFIXES)} OR regexp_extract(path, '[^/]*$') IN {_in(fixed.SPECIAL_NAMES)})""")
def skipped_file_diagnostics(spark, sf_dir):
    """What discovery says of the files that it skips, with a limit of 9 000 bytes a file."""
    raw = doc_files(spark, sf_dir).select("repo", "path", F.col("content").cast("binary").alias("content"), "bytes", F.lit(False).alias("symlink"))
    return views.skipped_diagnostics(repository.discover(raw, repository.Limits(files=10**9, file_bytes=9000), gitignore=False)[1])


@query(f"WITH {DOC_FILES} SELECT repo, path, CASE WHEN bytes % 11 = 0 THEN 'Skipped' WHEN {SUFFIX} IN {_in(fixed.PY_SUFFIXES + fixed.JS_SUFFIXES)} THEN 'Parsed' ELSE 'Indexed' END AS status FROM files")
def file_statuses(spark, sf_dir):
    """Files with an error, those of a language with an analyser, and the rest."""
    f = doc_files(spark, sf_dir)
    error = F.when(F.col("bytes") % 11 == 0, F.lit("parse_error"))
    return f.select("repo", "path", views.file_status(error, suffix_of(F.col("path")).isin(fixed.PY_SUFFIXES + fixed.JS_SUFFIXES)).alias("status"))


_SQL_TEXT = "CASE WHEN doc_id % 6 = 1 THEN concat(text, ' SELECT a FROM b ') WHEN doc_id % 6 = 2 THEN concat(text, ' selected from ') ELSE text END"


@query(f"WITH f AS (SELECT concat(source, '/', doc_id) AS repo, {_doc_path('VARCHAR')} AS path, {_SQL_TEXT} AS content FROM documents) SELECT DISTINCT repo, 'database' AS category, 'SQL database' AS tech FROM f WHERE suffix(path, '.sql') OR regexp_matches(content, '{fixed.SQL_WORDS}')")
def sql_text_tags(spark, sf_dir):
    """Repositories, one a document, with an SQL file or SQL in a text."""
    d = table(spark, sf_dir, "documents")
    return technology.sql_tags(d.select(F.concat_ws("/", "source", "doc_id").alias("repo"), F.expr(_doc_path("STRING")).alias("path"), F.expr(_SQL_TEXT).alias("content")))


@query(f"WITH {RECORDS} SELECT repo, path, language FROM records WHERE contains(lower(path), 'd1') OR contains(lower(language), 'd1')")
def file_search(spark, sf_dir):
    return views.search_files(derive.file_records(doc_files(spark, sf_dir)), "D1").select("repo", "path", "language")


@query(
    f"""WITH {RECORDS}, r AS (SELECT *, {SUFFIX} IN {_in(fixed.PY_SUFFIXES + fixed.JS_SUFFIXES)} AS parsed, {CODE} AS code FROM records)
    SELECT repo, count(*) AS files, count(*) FILTER (code) AS source_files, count(*) FILTER (parsed) AS parsed_files, CAST(sum(lines) AS BIGINT) AS lines,
    CASE WHEN count(*) FILTER (code) = 0 THEN 100.0::DOUBLE ELSE round_even(CAST(count(*) FILTER (parsed) AS DOUBLE) / count(*) FILTER (code) * 100, 1) END AS parse_rate FROM r GROUP BY repo"""
)
def repository_totals(spark, sf_dir):
    """Totals of each repository; files of a language with an analyser count as parsed."""
    records = derive.file_records(doc_files(spark, sf_dir))
    return derive.repository_totals(records, records.where(suffix_of(F.col("path")).isin(fixed.PY_SUFFIXES + fixed.JS_SUFFIXES)))


@query(f"WITH {RECORDS} SELECT repo, CAST(count(*) FILTER (bytes % 7 <> 0) AS BIGINT) AS hits, CAST(count(*) FILTER (bytes % 7 = 0) AS BIGINT) AS misses FROM records GROUP BY repo")
def incremental_hits_misses(spark, sf_dir):
    """Files against cached facts from before those of some sizes changed."""
    records = derive.file_records(doc_files(spark, sf_dir))
    cached = records.withColumn("hash", F.when(F.col("bytes") % 7 == 0, F.lit("before")).otherwise(F.col("hash")))
    return admission.cache_counts(records, cached)


@query(f"WITH {RECORDS} SELECT repo, path FROM records WHERE bytes % 7 = 0")
def incremental_work(spark, sf_dir):
    """Files to analyse again."""
    records = derive.file_records(doc_files(spark, sf_dir))
    cached = records.withColumn("hash", F.when(F.col("bytes") % 7 == 0, F.lit("before")).otherwise(F.col("hash")))
    return admission.split_by_cache(records, cached)[1].select("repo", "path")


@query(
    f"""WITH {RECORDS}, e AS (SELECT *, CAST(regexp_extract(path, 'd([0-9]+)\\.', 1) AS BIGINT) AS n FROM records JOIN (SELECT source AS repo, {_doc_path('VARCHAR')} AS path, text FROM documents) USING (repo, path))
    SELECT repo, path, CASE WHEN n % 5 = 0 THEN sha256(concat(text, ' edited')) ELSE hash END AS hash, CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS batch, CAST(length(CASE WHEN n % 5 = 0 THEN concat(text, ' edited') ELSE text END) AS BIGINT) AS chars FROM e WHERE n % 7 <> 0"""
)
def incremental_stream(spark, sf_dir):
    """Facts of documents as files after a stream of two batches: all files, then those of some numbers edited, deleted, or sent again unchanged."""
    n = F.regexp_extract("path", r"d([0-9]+)\.", 1).cast("long")
    files = doc_files(spark, sf_dir).select("repo", "path", "content", n.alias("n"))
    root = f"{scratch.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    first = files.select("repo", "path", "content", F.lit(False).alias("deleted"), "n")
    edited = F.when(F.col("n") % 5 == 0, F.concat("content", F.lit(" edited"))).otherwise(F.col("content"))
    again = files.where("n % 5 = 0 OR n % 7 = 0 OR n % 11 = 0").select("repo", "path", edited.alias("content"), (F.col("n") % 7 == 0).alias("deleted"), F.col("n") + 10**9)
    lengths = lambda df: df.select("repo", F.col("path").alias("file"), F.length("content").cast("long").alias("chars"))
    for events in (first, again):
        events.toDF("repo", "path", "content", "deleted", "seq").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("repo string, path string, content string, deleted boolean, seq long").parquet(f"{root}/in")
        incremental.follow(stream, f"{root}/store", f"{root}/checkpoint", lengths).awaitTermination()
    return incremental.snapshot(spark, f"{root}/store").select("repo", "path", "hash", F.col("batch").cast("int").alias("batch"), "facts.chars")


@query("SELECT doc_id, concat(source, '/', lang) AS path, source AS repo, lang AS rest FROM documents")
def upload_layout(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("path"))
    repo, rest = repository.upload_names(F.col("path"))
    return d.select("doc_id", "path", repo.alias("repo"), rest.alias("rest"))


# Parts as files, order lines as imports and calls -----------------------------------------------------------------------------------------

G = corpus.PART_GRAPH_SQL
LAYER_RULES = [f"WHEN list_has_any(parts, {_list(fixed.TEST_DIRS)}) OR " + " OR ".join(f"suffix(low, '{e}')" for e in fixed.TEST_ENDINGS) + " THEN ['tests', 'test path or filename']"]
_MORE = {"api": "routed", "database": "model", "frontend": "false", "infrastructure": f"name IN {_in(fixed.INFRASTRUCTURE_NAMES)}"}
LAYER_RULES += [f"WHEN list_has_any(parts, {_list(w)}) OR {_MORE.get(n, 'false')} THEN ['{n}', '{why}']" for n, w, why in fixed.LAYERS]
LAYER_RULES += [f"WHEN ext IN {_in(fixed.CONFIGURATION_SUFFIXES)} THEN ['configuration', 'configuration file']", "WHEN list_has_any(parts, ['src', 'app']) THEN ['frontend', 'frontend container path']"]
LAYER = f"""{G},
routes AS (SELECT repo, file, name FROM symbols WHERE name = 'render'),
layer_in AS (SELECT repo, path, lower(path) AS low, string_split(lower(path), '/') AS parts, regexp_extract(path, '[^/]*$') AS name, {SUFFIX} AS ext,
  EXISTS (FROM routes r WHERE r.repo = f.repo AND r.file = f.path) AS routed, EXISTS (FROM symbols s WHERE s.repo = f.repo AND s.file = f.path AND s.type = 'database_model') AS model FROM files f),
layer AS (SELECT repo, path, x[1] AS component, x[2] AS evidence FROM (SELECT repo, path, CASE {' '.join(LAYER_RULES)} ELSE ['other', 'source file outside a recognized layer'] END AS x FROM layer_in))"""
_ORDER = "CASE " + " ".join(f"WHEN component = '{c}' THEN {i}" for i, (c, _) in enumerate(fixed.COMPONENTS)) + " END"
_TITLE = "CASE " + " ".join(f"WHEN component = '{c}' THEN '{n}'" for c, n in fixed.COMPONENTS) + " END"
COMPONENTS = f"{LAYER}, components AS (SELECT repo, component AS id, {_TITLE} AS name, component AS type, {_ORDER} AS ord, list(path ORDER BY path) AS files, CASE WHEN component IN {_in(fixed.SURE_COMPONENTS)} THEN 0.94::DOUBLE ELSE 0.82::DOUBLE END AS confidence, list_sort(list_distinct(list(evidence))) AS evidence FROM layer GROUP BY repo, component)"
CONNECTIONS = """connections AS (SELECT i.repo, concat('component:', a.component, ':', b.component) AS id, a.component AS source, b.component AS target, 'imports' AS type, count(*) AS weight
FROM imports i JOIN layer a ON a.repo = i.repo AND a.path = i.file JOIN layer b ON b.repo = i.repo AND b.path = i.target WHERE a.component <> b.component GROUP BY ALL)"""


def _graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    g = corpus.part_graph(spark, sf_dir)
    g["routes"] = g["symbols"].where("name = 'render'")
    g["layers"] = derive.layers(g["files"], g["routes"], g["symbols"])
    g["components"] = derive.components(g["layers"])
    g["connections"] = derive.connections(g["imports"], g["layers"])
    return g


@query(f"WITH {LAYER} SELECT * FROM layer")
def layer_classify(spark, sf_dir):
    return _graph(spark, sf_dir)["layers"]


@query(f"WITH {COMPONENTS} SELECT * FROM components")
def architecture_components(spark, sf_dir):
    return _graph(spark, sf_dir)["components"]


@query(f"WITH {LAYER}, {CONNECTIONS} SELECT * FROM connections")
def architecture_connections(spark, sf_dir):
    return _graph(spark, sf_dir)["connections"]


DEGREES = """degrees AS (SELECT f.repo, f.path, (SELECT count(*) FROM imports i WHERE i.repo = f.repo AND i.target = f.path) AS inbound,
(SELECT count(*) FROM imports i WHERE i.repo = f.repo AND i.file = f.path AND i.target IS NOT NULL) AS outbound FROM files f)"""


@query(f"WITH {G}, {DEGREES} SELECT * FROM degrees")
def import_degrees(spark, sf_dir):
    g = corpus.part_graph(spark, sf_dir)
    return derive.degrees(g["files"], g["imports"])


@query(f"WITH {G}, {DEGREES} SELECT repo, path AS file, inbound + outbound AS connections, row_number() OVER (PARTITION BY repo ORDER BY inbound + outbound DESC, path) AS rank FROM degrees QUALIFY rank <= 10")
def most_connected_files(spark, sf_dir):
    g = corpus.part_graph(spark, sf_dir)
    return derive.most_connected(derive.degrees(g["files"], g["imports"]))


@query(f"WITH {G}, {DEGREES} SELECT repo, path AS file, inbound + outbound AS connections FROM degrees WHERE inbound + outbound > 40")
def high_coupling_files(spark, sf_dir):
    g = corpus.part_graph(spark, sf_dir)
    return derive.high_coupling(derive.degrees(g["files"], g["imports"]), 40)


_POINTS = "CASE " + " ".join(f"WHEN name = '{n}' THEN {p}" for n, p in fixed.ENTRY_NAMES.items()) + " END"
ENTRIES = f"""ev AS (SELECT repo, path, n, regexp_extract(path, '[^/]*$') AS name, (n % 37 = 0)::INT + (n % 41 = 0)::INT AS k FROM files),
entries AS (SELECT repo, path AS file, coalesce({_POINTS}, 0) + 35 * k AS score, CASE WHEN n % 37 = 0 THEN ['starts an HTTP listener'] ELSE []::VARCHAR[] END || CASE WHEN n % 41 = 0 THEN ['mounts a client application'] ELSE []::VARCHAR[] END
  || CASE WHEN {_POINTS} IS NOT NULL THEN [concat('uses the conventional ', name, ' filename')] ELSE []::VARCHAR[] END AS evidence FROM ev),
ranked AS (SELECT repo, file, CAST(score AS INTEGER) AS score, evidence, least(0.99::DOUBLE, 0.45::DOUBLE + score / 150.0::DOUBLE) AS confidence, row_number() OVER (PARTITION BY repo ORDER BY score DESC, file) AS rank FROM entries WHERE score > 0 QUALIFY rank <= 10)"""


def _entries(g: dict[str, DataFrame]) -> DataFrame:
    reasons = F.array(F.when(F.col("n") % 37 == 0, F.lit("starts an HTTP listener")), F.when(F.col("n") % 41 == 0, F.lit("mounts a client application")))
    return derive.entrypoints(g["files"], g["files"].select("repo", F.col("path").alias("file"), F.posexplode(reasons).alias("ord", "reason")).where("reason IS NOT NULL"))


@query(f"WITH {G}, {ENTRIES} SELECT * FROM ranked")
def entrypoints_ranked(spark, sf_dir):
    return _entries(corpus.part_graph(spark, sf_dir))


IMPORTANT = f"""parts_in AS (SELECT d.*, (SELECT count(*) FROM routes r WHERE r.repo = d.repo AND r.file = d.path) AS routes, coalesce((SELECT max(score) FROM ranked e WHERE e.repo = d.repo AND e.file = d.path), 0) AS entry, CASE WHEN regexp_extract(path, '[^/]*$') IN {_in(fixed.IMPORTANT_CONFIGURATION)} THEN 12 ELSE 0 END AS config FROM degrees d),
important AS (SELECT repo, path AS file, CAST(inbound * 3 + outbound * 2 + routes * 8 + entry + config AS BIGINT) AS score, list_filter([CASE WHEN entry > 0 THEN 'entrypoint candidate' END, CASE WHEN routes > 0 THEN concat('defines ', routes, ' route(s)') END, CASE WHEN inbound > 0 THEN concat('imported by ', inbound, ' file(s)') END, CASE WHEN outbound > 0 THEN concat('imports ', outbound, ' local file(s)') END, CASE WHEN config > 0 THEN 'project configuration' END], lambda x: x IS NOT NULL) AS reasons FROM parts_in),
top AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, file) AS rank FROM important WHERE score > 0 QUALIFY rank <= 20)"""


def _important(g: dict[str, DataFrame]) -> DataFrame:
    return derive.important_files(derive.degrees(g["files"], g["imports"]), g["routes"], _entries(g))


@query(f"WITH {LAYER}, {DEGREES}, {ENTRIES}, {IMPORTANT} SELECT * FROM top")
def important_files(spark, sf_dir):
    return _important(_graph(spark, sf_dir))


_TOUR = "CASE " + " ".join(f"WHEN type = '{t}' THEN '{d}'" for t, d in fixed.TOUR.items()) + " END"


@query(
    f"""WITH {COMPONENTS}, {DEGREES}, {ENTRIES}, {IMPORTANT},
    head AS (SELECT repo, 0 AS stage, 0 AS ord, 'Start at the entry point' AS title, file, array_to_string(evidence[1:2], '; ') AS description FROM ranked WHERE rank = 1
      UNION ALL SELECT repo, 1, ord, concat('Explore ', name), files[1], {_TOUR} FROM components WHERE {_TOUR} IS NOT NULL),
    steps AS (FROM head UNION ALL SELECT repo, 2, rank, 'Read a central file', file, array_to_string(reasons[1:2], ', ') FROM top WHERE (repo, file) NOT IN (SELECT (repo, file) FROM head))
    SELECT repo, title, file, description, row_number() OVER (PARTITION BY repo ORDER BY stage, ord) AS step FROM steps QUALIFY step <= 6"""
)
def onboarding_tour(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return derive.tour(_entries(g), g["components"], _important(g))


def _cycles_sql(longest: int) -> str:
    return f"""edges AS (SELECT DISTINCT repo, file AS a, target AS b FROM imports WHERE target IS NOT NULL),
    ways AS (SELECT repo, a AS start, b AS at, CASE WHEN a = b THEN [a] ELSE [a, b] END AS path, b = a AS closed FROM edges WHERE b >= a
      UNION ALL SELECT w.repo, w.start, e.b, CASE WHEN e.b = w.start THEN w.path ELSE w.path || [e.b] END, e.b = w.start FROM ways w JOIN edges e ON e.repo = w.repo AND e.a = w.at
      WHERE NOT w.closed AND (e.b = w.start OR (e.b > w.start AND NOT list_contains(w.path, e.b) AND len(w.path) < {longest}))),
    cycles AS (SELECT repo, path AS cycle FROM ways WHERE closed)"""


@query(f"WITH RECURSIVE {G}, {_cycles_sql(3)} SELECT repo, cycle FROM cycles WHERE len(cycle) <= 3")
def short_dependency_cycles(spark, sf_dir):
    """All simple import cycles of at most three files."""
    return graphs.short_cycles(corpus.part_graph(spark, sf_dir)["imports"], 3)


# A depth-first walk, one step a row of each repository: to the first file in order that is not done, else back. '' leads to all files that import.
_WALK_SQL = """adj AS (SELECT repo, a, list_sort(list(DISTINCT b)) AS nb FROM (SELECT repo, file AS a, target AS b FROM imports WHERE target IS NOT NULL UNION ALL SELECT repo, '', file FROM imports WHERE target IS NOT NULL) GROUP BY ALL),
    walk AS (SELECT repo, [''] AS path, []::VARCHAR[] AS done FROM adj WHERE a = ''
      UNION ALL SELECT repo, CASE WHEN nxt IS NULL THEN path[1:len(path) - 1] ELSE path || [nxt] END, CASE WHEN nxt IS NULL THEN done ELSE done || [nxt] END
      FROM (SELECT w.repo, w.path, w.done, list_filter(coalesce(j.nb, []), lambda x: NOT list_contains(w.done, x))[1] AS nxt FROM walk w LEFT JOIN adj j ON j.repo = w.repo AND j.a = w.path[-1] WHERE len(w.path) > 0)),
    rings AS (SELECT DISTINCT repo, path[list_position(path, b):] AS ring FROM (SELECT w.repo, w.path, unnest(j.nb) AS b FROM walk w JOIN adj j ON j.repo = w.repo AND j.a = w.path[-1] WHERE len(w.path) > 1) WHERE list_contains(path, b)),
    cycles AS (SELECT DISTINCT repo, ring[list_position(ring, list_min(ring)):] || ring[1:list_position(ring, list_min(ring)) - 1] AS cycle FROM rings)"""


@query(f"WITH RECURSIVE {G}, {_WALK_SQL} SELECT repo, cycle FROM cycles")
def dependency_cycles(spark, sf_dir):
    """Cycles closed by back edges of a depth-first walk."""
    return graphs.dependency_cycles(corpus.part_graph(spark, sf_dir)["imports"])


_METRICS_SQL = """n AS (SELECT repo, (SELECT count(*) FROM files f WHERE f.repo = r.repo) AS files, (SELECT count(*) FROM symbols s WHERE s.repo = r.repo) AS symbols,
    (SELECT count(target) FROM imports i WHERE i.repo = r.repo) AS local_dependencies, (SELECT count(*) FROM imports i WHERE i.repo = r.repo AND external) AS external_dependencies, (SELECT count(*) FROM cycles c WHERE c.repo = r.repo AND len(cycle) <= {longest}) AS cycles FROM (SELECT DISTINCT repo FROM files) r)
    SELECT *, CAST(least(100.0::DOUBLE, round_even(files::DOUBLE * 0.15::DOUBLE + symbols::DOUBLE * 0.04::DOUBLE + local_dependencies::DOUBLE * 0.1::DOUBLE + cycles::DOUBLE * 5.0::DOUBLE, 0)) AS BIGINT) AS complexity FROM n"""


@query(f"WITH RECURSIVE {G}, {_WALK_SQL}, {_METRICS_SQL.format(longest=10**9)}")
def graph_metrics(spark, sf_dir):
    """Counts and complexity, with all cycles of the depth-first walk."""
    g = corpus.part_graph(spark, sf_dir)
    return derive.metrics(g["files"], g["symbols"], g["imports"], graphs.dependency_cycles(g["imports"]))


@query(f"WITH RECURSIVE {G}, {_cycles_sql(2)}, {_METRICS_SQL.format(longest=2)}")
def graph_metrics_of_pairs(spark, sf_dir):
    """The same with cycles of at most two files, found by joins alone."""
    g = corpus.part_graph(spark, sf_dir)
    return derive.metrics(g["files"], g["symbols"], g["imports"], graphs.short_cycles(g["imports"], 2))


CALLS = f"""{G},
in_file AS (SELECT repo, file, name, min(id) AS id FROM symbols WHERE type <> 'module' GROUP BY ALL HAVING count(*) = 1),
in_repo AS (SELECT repo, name, min(id) AS id FROM symbols WHERE type <> 'module' GROUP BY ALL HAVING count(*) = 1),
reach AS (SELECT DISTINCT repo, file, target FROM imports WHERE target IS NOT NULL),
c AS (SELECT *, regexp_extract(callee, '[^.]*$') AS name, contains(callee, '.') AS dotted FROM calls),
far AS (SELECT repo, file, name, min_by(id, target) AS id FROM (SELECT DISTINCT c.repo, c.file, c.name, r.target, f.id FROM c JOIN reach r ON r.repo = c.repo AND r.file = c.file JOIN in_file f ON f.repo = c.repo AND f.file = r.target AND f.name = c.name WHERE c.dotted) GROUP BY ALL),
resolved AS (SELECT c.repo, c.file, c.ord, c.source, c.callee, c.line, CASE WHEN c.dotted AND far.id IS NOT NULL THEN far.id ELSE coalesce(h.id, u.id) END AS target,
 CASE WHEN c.dotted AND far.id IS NOT NULL THEN 0.92::DOUBLE WHEN h.id IS NOT NULL THEN 0.88::DOUBLE WHEN u.id IS NOT NULL AND c.dotted THEN 0.82::DOUBLE WHEN u.id IS NOT NULL THEN 0.72::DOUBLE ELSE 0.55::DOUBLE END AS confidence
 FROM c LEFT JOIN far ON far.repo = c.repo AND far.file = c.file AND far.name = c.name LEFT JOIN in_file h ON h.repo = c.repo AND h.file = c.file AND h.name = c.name LEFT JOIN in_repo u ON u.repo = c.repo AND u.name = c.name)"""


def _calls(g: dict[str, DataFrame]) -> DataFrame:
    return resolve.resolve_calls(g["calls"], g["symbols"], g["imports"])


def _calls_to(hit: DataFrame, g: dict[str, DataFrame]) -> DataFrame:
    g["imports"] = scratch.kept(g["imports"].select("repo", "file", "target"))
    return resolve.resolve_calls_to(hit, g["calls"], g["symbols"], g["imports"])


@query(f"WITH {CALLS} SELECT * FROM resolved")
def call_resolution(spark, sf_dir):
    return _calls(corpus.part_graph(spark, sf_dir))


IMPACT = "hit AS (SELECT * FROM symbols WHERE contains(lower(name), 'only_12') OR contains(lower(id), 'only_12'))"


@query(f"WITH {CALLS}, {IMPACT} SELECT repo, file AS dependent FROM imports SEMI JOIN (SELECT repo, file AS target FROM hit) USING (repo, target) UNION SELECT repo, source FROM resolved SEMI JOIN (SELECT repo, id AS target FROM hit) USING (repo, target)")
def impact_slice(spark, sf_dir):
    g = corpus.part_graph(spark, sf_dir)
    calls = _calls_to(graphs.hits("Only_12", g["symbols"]), g)
    return graphs.impact("Only_12", g["symbols"], g["imports"], calls)


@query(
    f"""WITH {CALLS}, hit AS (SELECT * FROM symbols WHERE contains(lower(name), 'only_12')), both_kinds AS (SELECT repo, file AS dependent, 'imports' AS relation FROM imports SEMI JOIN (SELECT repo, file AS target FROM hit) USING (repo, target) UNION ALL SELECT repo, source, 'calls' FROM resolved SEMI JOIN (SELECT repo, id AS target FROM hit) USING (repo, target)) SELECT * FROM both_kinds"""
)
def impact_edges(spark, sf_dir):
    g = corpus.part_graph(spark, sf_dir)
    calls = _calls_to(graphs.hits("only_12", g["symbols"], ids=False), g)
    return graphs.impact_by_name("only_12", g["symbols"], g["imports"], calls)


@query(f"WITH {G} SELECT repo, file, count(*) FILTER (type <> 'module') AS symbols, list_sort(list_distinct(list(type))) AS types FROM symbols GROUP BY ALL")
def symbols_per_file(spark, sf_dir):
    return derive.symbols_per_file(corpus.part_graph(spark, sf_dir)["symbols"])


@query(f"WITH {LAYER}, {CONNECTIONS}, c AS (SELECT DISTINCT repo, component AS id FROM layer) SELECT repo, id, CASE WHEN id = 'services' THEN 'selected' WHEN EXISTS (FROM connections x WHERE x.repo = c.repo AND x.source = c.id AND x.target = 'services') THEN 'inbound' WHEN EXISTS (FROM connections x WHERE x.repo = c.repo AND x.target = c.id AND x.source = 'services') THEN 'outbound' ELSE 'unrelated' END AS relation FROM c")
def neighbour_relations(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return views.neighbours(g["components"], g["connections"], "services")


@query(f"WITH {COMPONENTS}, {CONNECTIONS} SELECT * FROM connections WHERE source IN {_in(views.FILTERS['services'])} AND target IN {_in(views.FILTERS['services'])}")
def layer_filter_connections(spark, sf_dir):
    """Connections within the services filter."""
    g = _graph(spark, sf_dir)
    return views.induced(g["connections"], views.filter_layers(g["components"], "services"))


_TIER = "CASE " + " ".join(f"WHEN {{0}} = '{n}' THEN {t}" for n, t in views.TIERS.items()) + " ELSE 2 END"


@query(
    f"""WITH {COMPONENTS}, t AS (SELECT repo, id, ord, {_TIER.format("type")} AS tier FROM components),
    p AS (SELECT *, row_number() OVER (PARTITION BY repo, tier ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY repo, tier) AS n, dense_rank() OVER (PARTITION BY repo ORDER BY tier) AS rank FROM t),
    q AS (SELECT *, max(n) OVER (PARTITION BY repo) AS most FROM p)
    SELECT repo, id, CAST(greatest(60, (most * 230 + (most - 1) * 70 - n * 230 - (n - 1) * 70) / 2.0 + 60) + i * 300 AS DOUBLE) AS x, CAST(50 + (rank - 1) * 170 AS BIGINT) AS y FROM q"""
)
def tier_layout(spark, sf_dir):
    return views.layout(_graph(spark, sf_dir)["components"])


@query(f"WITH {LAYER}, {CONNECTIONS} SELECT repo, id, CASE WHEN {_TIER.format('source')} = {_TIER.format('target')} THEN 'right' WHEN {_TIER.format('source')} > {_TIER.format('target')} THEN 'top' ELSE 'bottom' END AS side, CASE WHEN source = 'api' OR target = 'api' THEN 3.0::DOUBLE ELSE least(3.5::DOUBLE, 1.5::DOUBLE + 0.4::DOUBLE * weight) END AS width FROM connections")
def edge_styles(spark, sf_dir):
    return views.edge_style(_graph(spark, sf_dir)["connections"], "api").select("repo", "id", "side", "width")


@query(f"WITH {COMPONENTS} SELECT repo, arg_min(id, CASE WHEN type = 'api' THEN -1 ELSE ord END) AS id FROM components GROUP BY repo")
def default_components(spark, sf_dir):
    return views.default_component(_graph(spark, sf_dir)["components"])


@query(
    f"""WITH {COMPONENTS}, {CONNECTIONS}, lines AS (SELECT DISTINCT repo, 0 AS part, '' AS a, '' AS b, 'flowchart TD' AS line FROM components
    UNION ALL SELECT repo, 1, printf('%03d', ord), '', concat('    ', replace(id, '-', '_'), '["', name, ' (', len(files), ' files)"]') FROM components
    UNION ALL SELECT repo, 2, source, target, concat('    ', replace(source, '-', '_'), ' -->', CASE WHEN weight > 1 THEN concat('|', weight, '|') ELSE '' END, ' ', replace(target, '-', '_')) FROM connections)
    SELECT repo, concat(string_agg(line, chr(10) ORDER BY part, a, b), chr(10)) AS mermaid FROM lines GROUP BY repo"""
)
def export_mermaid(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return views.mermaid(g["components"], g["connections"])


_HEAD = ", ".join(f"(0, '{i:03d}', '{s}')" for i, s in enumerate(views.DOT_HEAD)) + ", (2, '000', ''), (4, '000', '}')"


@query(
    f"""WITH {COMPONENTS}, {CONNECTIONS}, lines AS (SELECT r.repo, t.part, t.a, '' AS b, t.line FROM (SELECT DISTINCT repo FROM components) r, (VALUES {_HEAD}) t(part, a, line)
    UNION ALL SELECT repo, 1, printf('%03d', ord), '', concat('    "', id, '" [label="', name, '\\n(', len(files), ' files)"];') FROM components
    UNION ALL SELECT repo, 3, source, target, concat('    "', source, '" -> "', target, '"', CASE WHEN weight > 1 THEN concat(' [label="', weight, '"]') ELSE '' END, ';') FROM connections)
    SELECT repo, concat(string_agg(line, chr(10) ORDER BY part, a, b), chr(10)) AS dot FROM lines GROUP BY repo"""
)
def export_dot(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return views.dot(g["components"], g["connections"])


@query(f"WITH {COMPONENTS} SELECT repo, len(list(id)) AS components, (SELECT count(*) FROM files f WHERE f.repo = c.repo) AS files FROM components c GROUP BY repo")
def export_json(spark, sf_dir):
    """The JSON export, read back: layers and files of each repository."""
    g = _graph(spark, sf_dir)
    back = F.from_json("json", "struct<components: array<struct<id: string, files: array<string>>>>")
    return views.architecture_json(g["components"], g["connections"]).select("repo", F.size(back["components"]).cast("long").alias("components"), F.size(F.flatten(back["components"]["files"])).cast("long").alias("files"))


@query(
    f"""WITH {COMPONENTS}, {CONNECTIONS}, a AS (SELECT repo, list({{id: id, name: name, type: type, files: files, confidence: confidence, evidence: evidence}} ORDER BY ord) AS c FROM components GROUP BY repo),
    b AS (SELECT repo, list({{id: id, source: source, target: target, type: type, weight: weight}} ORDER BY source, target) AS e FROM connections GROUP BY repo)
    SELECT repo, CAST(to_json({{components: c, connections: coalesce(e, [])}}) AS VARCHAR) AS json FROM a LEFT JOIN b USING (repo)"""
)
def export_json_text(spark, sf_dir):
    """The whole JSON export of each repository."""
    g = _graph(spark, sf_dir)
    return views.architecture_json(g["components"], g["connections"])


@query(
    f"""WITH {G}, f AS (SELECT * FROM files WHERE n % 17 <> 0) SELECT repo, 'symbols.file -> files.path' AS rule, file AS key FROM symbols WHERE (repo, file) NOT IN (SELECT (repo, path) FROM f)
    UNION SELECT repo, 'imports.file -> files.path', file FROM imports WHERE (repo, file) NOT IN (SELECT (repo, path) FROM f) UNION SELECT repo, 'imports.target -> files.path', target FROM imports WHERE target IS NOT NULL AND (repo, target) NOT IN (SELECT (repo, path) FROM f)"""
)
def audit_references(spark, sf_dir):
    """References to files when some files are missing."""
    g = corpus.part_graph(spark, sf_dir)
    return quality.dangling({"files": g["files"].where("n % 17 <> 0"), "symbols": g["symbols"], "imports": g["imports"]})


@query(f"WITH {G} SELECT repo, 'symbols.line >= 1' AS rule, CAST(line - 5 AS VARCHAR) AS key FROM symbols WHERE line - 5 < 1")
def audit_ranges(spark, sf_dir):
    """Lines out of range when all are moved up by five."""
    return quality.out_of_range({"symbols": corpus.part_graph(spark, sf_dir)["symbols"].withColumn("line", F.col("line") - 5)})


@query(f"WITH {G}, d AS (SELECT repo, path FROM files UNION ALL SELECT repo, path FROM files WHERE n % 31 = 0) SELECT repo, 'files unique (path)' AS rule, path AS key FROM d GROUP BY ALL HAVING count(*) > 1")
def audit_keys(spark, sf_dir):
    f = corpus.part_graph(spark, sf_dir)["files"].withColumn("id", F.monotonically_increasing_id().cast("string"))
    return quality.repeated_keys({"files": f.unionByName(f.where("n % 31 = 0").withColumn("id", F.concat("id", F.lit("b"))))}).where("rule = 'files unique (path)'")


#: The fact tables of an audit from the part graph, as SQL for both engines, each with rows that break its rules.
AUDITED = {
    "files": "SELECT repo, path, concat('file:', CASE WHEN n % 43 = 0 THEN 'same' ELSE path END) AS id, n % 50 AS lines, bytes - 2000 AS bytes FROM files WHERE n % 17 <> 0 UNION ALL SELECT repo, path, concat('again:', path), 1, 1 FROM files WHERE n % 31 = 0",
    "symbols": "SELECT repo, file, line - 5 AS line FROM symbols",
    "imports": "SELECT repo, file, target FROM imports",
    "calls": "SELECT repo, line / 5.5e0 AS confidence FROM calls",
    "routes": "SELECT repo, file, (ord % 13) / 10.5e0 AS confidence FROM symbols WHERE name = 'render'",
    "entrypoints": "SELECT repo, path AS file, (n % 7) / 5.5e0 AS confidence FROM files WHERE n % 37 = 0",
    "components": "SELECT DISTINCT repo, concat('c', n % 7) AS id FROM files WHERE n % 7 <> 3",
    "component_files": "SELECT repo, path AS file, concat('c', n % 7) AS component FROM files",
    "connections": "SELECT repo, concat('c', n % 7) AS source, concat('c', n % 8) AS target, n % 5 AS weight FROM files",
    "flow_nodes": "SELECT repo, concat('flow', line) AS flow, source AS id, file FROM calls WHERE ord % 40 = 1",
    "flow_edges": "SELECT repo, concat('flow', line) AS flow, source, concat(source, ord % 2) AS target FROM calls WHERE ord % 40 = 1 UNION ALL SELECT repo, concat('flow', line + 1), source, source FROM calls WHERE ord % 400 = 1",
    "totals": "SELECT repo, count(*) * 1.01e0 AS parse_rate FROM files GROUP BY repo",
}


def _audit_sql() -> str:
    views = ", ".join(f"a_{t} AS ({q})" for t, q in AUDITED.items())
    parts = []
    for t, c, o, k in quality.REFERENCES:
        on = f"r.repo = o.repo AND r.{c} = o.{k}" + (" AND r.flow = o.flow" if t == "flow_edges" else "")
        parts.append(f"SELECT repo, '{t}.{c} -> {o}.{k}' AS rule, {c} AS key FROM (SELECT DISTINCT repo, {c}{', flow' if t == 'flow_edges' else ''} FROM a_{t} WHERE {c} IS NOT NULL) r WHERE NOT EXISTS (FROM a_{o} o WHERE {on})")
    parts += [f"SELECT repo, '{t}.{rule}', CAST({c} AS VARCHAR) FROM a_{t} WHERE NOT coalesce({rule}, false)" for t, c, rule in quality.RANGES if c not in ("confidence", "parse_rate")]
    parts += [f"SELECT repo, '{t}.{rule}', '' FROM a_{t} WHERE NOT coalesce({rule}, false)" for t, c, rule in quality.RANGES if c in ("confidence", "parse_rate")]
    parts += [f"SELECT repo, '{t} unique ({', '.join(ks)})', concat_ws('/', {', '.join(ks)}) FROM a_{t} GROUP BY repo, {', '.join(ks)} HAVING count(*) > 1" for t, ks in quality.KEYS]
    return f"WITH {G}, {views}, v AS ({' UNION ALL '.join(parts)}) SELECT repo, rule, key, count(*) AS n FROM v GROUP BY ALL"


@query(_audit_sql())
def audit_whole(spark, sf_dir):
    """All 12 references, 8 ranges and 3 keys over the part graph with broken rows. Texts of fractions differ between engines, so they are left out."""
    g = corpus.part_graph(spark, sf_dir)
    audited = {t: spark.sql(_braced(q), **{n: g[n] for n in ("files", "symbols", "imports", "calls") if f"{{{n}}}" in _braced(q)}) for t, q in AUDITED.items()}
    fraction = F.col("rule").contains("confidence") | F.col("rule").contains("parse_rate")
    return quality.violations(audited).withColumn("key", F.when(fraction, "").otherwise(F.col("key"))).groupBy("repo", "rule", "key").agg(F.count("*").alias("n"))


def _braced(sql: str) -> str:
    for name in ("files", "symbols", "imports", "calls"):
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return sql


def _line_sql(section: str, source: str, order: list[str], fields: str) -> str:
    return f"SELECT repo, '{section}' AS section, [{', '.join(order)}] AS place, CAST(to_json({{{fields}}}) AS VARCHAR) AS json FROM {source}"


def _padded(column: str) -> str:
    return f"lpad(CAST({column} AS VARCHAR), 20, '0')"


@query(
    f"WITH {G} "
    + " UNION ALL ".join(
        [
            _line_sql("files", "files", ["path"], "path: path, bytes: bytes"),
            _line_sql("symbols", "symbols", ["file", _padded("ord"), "id"], "id: id, type: type, name: name, file: file, line: line"),
            _line_sql("imports", "imports", ["file", _padded("ord")], "source: file, target: target, external: external"),
            _line_sql("calls", "calls", ["file", _padded("ord")], "source: source, callee: callee, file: file, line: line"),
        ]
    )
)
def artifact_sections(spark, sf_dir):
    """Whole sections of the part graph as lines, written in ranges and read back."""
    g = corpus.part_graph(spark, sf_dir)
    sections = {
        "files": (g["files"], ["path"], {"path": "path", "bytes": "bytes"}),
        "symbols": (g["symbols"], ["file", "ord", "id"], {n: n for n in ("id", "type", "name", "file", "line")}),
        "imports": (g["imports"], ["file", "ord"], {"source": "file", "target": "target", "external": "external"}),
        "calls": (g["calls"], ["file", "ord"], {n: n for n in ("source", "callee", "file", "line")}),
    }
    parts = [artifact.section_lines(df, name, order, fields) for name, (df, order, fields) in sections.items()]
    path = f"{scratch.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    artifact.write_lines(reduce(DataFrame.unionByName, parts), path)
    return spark.read.parquet(path)


@query("SELECT source AS repo, concat('d', doc_id, '.txt') AS path, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, false AS symlink, sha256(text) AS hash FROM documents")
def archive_entries(spark, sf_dir):
    """Documents as entries of archives in the shared folder, read back through the archive source, several tasks an archive."""
    d = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("path"), "text")
    root = f"{scratch.shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    archives.write_archives(d.select(F.col("source").alias("repo"), "path", F.col("text").cast("binary").alias("content")), root, parts=4)
    archives.register(spark)
    found = spark.read.format("repository_archive").option("partitionBytes", 1 << 16).load(root)
    return found.select(F.substring_index("repo", "-part", 1).alias("repo"), "path", "bytes", "symlink", F.sha2("content", 256).alias("hash"))


@query("WITH p AS (SELECT p_partkey, concat(p_brand, '/./', p_type, '/x/../', CAST(p_size AS VARCHAR), '.Tar.GZ') AS path FROM part) SELECT p_partkey, concat(p_brand, '/', p_type, '/', CAST(p_size AS VARCHAR), '.Tar.GZ') AS path, concat(p_brand, '/', p_type) AS parent, '.gz' AS suffix, concat('/', p_brand, '/a') AS route FROM (SELECT part.*, p.path FROM part JOIN p USING (p_partkey))".replace("SELECT part.*, p.path FROM part JOIN p USING (p_partkey)", "SELECT * FROM part"))
def path_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("path", normal_path(F.concat("p_brand", F.lit("/./"), "p_type", F.lit("/x/../"), F.col("p_size").cast("string"), F.lit(".Tar.GZ"))))
    return p.select("p_partkey", "path", parent_of(F.col("path")).alias("parent"), suffix_of(F.col("path")).alias("suffix"), join_routes(F.concat(F.col("p_brand"), F.lit("/")), F.lit("/a/")).alias("route"))


# Files of known content -------------------------------------------------------------------------------------------------------------------


def _code(spark: SparkSession, sf_dir: str) -> Analysis:
    return Analysis(corpus.code_files(spark, sf_dir))


@query(known.per_document("file id type name line end_line parent", known.PY_SYMBOLS) + " UNION ALL " + known.per_repository("file id type name line end_line parent", [("config/settings.py", "config/settings.py", "module", "settings.py", 1, 5, None)]).replace("WITH whole", "SELECT * FROM (WITH whole", 1) + ")")
def py_symbols(spark, sf_dir):
    a = _code(spark, sf_dir)
    return a.symbols.where(suffix_of(F.col("file")).isin(fixed.PY_SUFFIXES)).select("repo", "file", "id", "type", "name", "line", "end_line", "parent")


_IMPORTS = known.PY_IMPORTS + known.JS_IMPORTS
_IMPORTS_SQL = known.per_document("file line module names target external", [(*r, r[-1] is None and r[2][0] != ".") for r in _IMPORTS]) + " UNION ALL " + known.per_repository("file line module names target external", [("config/settings.py", 1, "os", ["os"], None, True)]).replace("WITH whole", "SELECT * FROM (WITH whole", 1) + ")"


@query(_IMPORTS_SQL)
def import_resolution(spark, sf_dir):
    """Imports of both languages: relative, absolute, by alias, and external ones."""
    return _code(spark, sf_dir).imports.select("repo", "file", "line", "module", "names", "target", "external")


@query("SELECT repo, file, line, module, names FROM (" + _IMPORTS_SQL + f") WHERE {SUFFIX.replace('path', 'file')} IN {_in(fixed.PY_SUFFIXES)}")
def sql_imports(spark, sf_dir):
    """Imports of Python files through the SQL table function."""
    tables.register(spark)
    return spark.sql(f"SELECT f.repo, f.path AS file, t.line, t.module, t.names FROM {{files}} f, LATERAL python_imports(f.content) t WHERE {SUFFIX_SPARK} IN {_in(fixed.PY_SUFFIXES)}", files=corpus.code_files(spark, sf_dir))


@query("SELECT repo, file, source, callee, line FROM (" + known.per_document("file source callee line", known.PY_CALLS) + ")")
def sql_calls(spark, sf_dir):
    """Calls within definitions of Python files through the SQL table function."""
    tables.register(spark)
    return spark.sql(f"SELECT f.repo, f.path AS file, concat(f.path, '::', t.owner) AS source, t.callee, t.line FROM {{files}} f, LATERAL python_calls(f.content) t WHERE t.owner IS NOT NULL AND {SUFFIX_SPARK} IN {_in(fixed.PY_SUFFIXES)}", files=corpus.code_files(spark, sf_dir))


_CALL_TEXTS = "file source callee receiver arguments assigned_to argument_count line"


@query(known.per_document(_CALL_TEXTS, known.PY_CALL_TEXTS) + " UNION ALL " + known.per_repository(_CALL_TEXTS, [("config/settings.py", "config/settings.py", "os.environ.get", "os.environ", '"DATABASE_URL"', "OTHER", 1, 4)]).replace("WITH whole", "SELECT * FROM (WITH whole", 1) + ")")
def call_texts(spark, sf_dir):
    """What the calls of Python files say: receiver, text and number of arguments, and the name that takes the result."""
    return _code(spark, sf_dir).call_texts.drop("ord")


_CALLS = known.PY_CALLS + known.JS_CALLS


@query(known.per_document("file source callee line", _CALLS))
def call_facts(spark, sf_dir):
    """Calls of both languages with the symbols they stand in; those of scripts go to the last symbol above."""
    return _code(spark, sf_dir).calls.select("repo", "file", "source", "callee", "line")


@query(known.per_document("file id type name line exported", known.JS_SYMBOLS))
def js_symbols(spark, sf_dir):
    return _code(spark, sf_dir).script_symbols.select("repo", "file", "id", "type", "name", "line", "exported")


@query(known.per_document("file method path handler line framework confidence", known.PY_ROUTES + known.JS_ROUTES))
def route_facts(spark, sf_dir):
    """Routes as their files state them: FastAPI, Express, NestJS and both kinds of Next.js."""
    return _code(spark, sf_dir).local_routes.select("repo", "file", "method", "path", "handler", "line", "framework", "confidence")


@query(known.per_document("file line receiver prefix prefix_expression target_expression dynamic target state", known.MOUNTS))
def mount_facts(spark, sf_dir):
    return _code(spark, sf_dir).mounts.select("repo", "file", "line", "receiver", "prefix", "prefix_expression", "target_expression", "dynamic", "target", "state")


@query(known.per_document("file prefix", [(known.SHOP, "/api"), (known.NESTED, "/api/deep")]))
def mount_prefixes(spark, sf_dir):
    return _code(spark, sf_dir).mount_ways.select("repo", "file", "prefix")


@query("SELECT *, concat('route:', file, ':', line, ':', method, ':', path) AS id FROM (" + known.per_document("file method path handler line framework confidence", known.ROUTES) + ")")
def mounted_routes(spark, sf_dir):
    """Routes below the prefixes of their mounts."""
    return _code(spark, sf_dir).routes.select("repo", "file", "method", "path", "handler", "line", "framework", "confidence", "id")


@query(known.per_document("file code message", known.DIAGNOSTICS))
def mount_diagnostics(spark, sf_dir):
    return _code(spark, sf_dir).diagnostics.select("repo", "file", "code", "message")


@query(known.per_document("file method path", [(known.LOOSE, "GET", "/loose")]))
def incomplete_routes(spark, sf_dir):
    from ..operators.mounts import incomplete_routes as find

    a = _code(spark, sf_dir)
    return find(a.routes, a.diagnostics).select("repo", "file", "method", "path")


@query(known.per_document("file quality code", [(known.API, "complete", None), (known.SVC, "complete", None), (known.MODEL, "complete", None), (known.BAD, "partial", "SOURCE_PARSE_PARTIAL")]) + " UNION ALL " + known.per_repository("file quality code", [("config/settings.py", "complete", None)]).replace("WITH whole", "SELECT * FROM (WITH whole", 1) + ")")
def parse_quality(spark, sf_dir):
    from ..operators.python_facts import parse_quality as judge

    a = _code(spark, sf_dir)
    return judge(a.files, a.python)


@query(known.per_document("file name type line", [(known.BAD, "half", "function", 1), (known.BAD, "Whole", "class", 4)]))
def fallback_symbols(spark, sf_dir):
    from ..operators.python_facts import fallback_symbols as find

    a = _code(spark, sf_dir)
    return find(a.files, a.python).select("repo", "file", "name", "type", "line")


@query(known.per_document("file category tech", known.USED))
def source_technologies(spark, sf_dir):
    return _code(spark, sf_dir).used


_MANIFEST = [
    ("framework", "Express"), ("framework", "NestJS"), ("testing", "Vitest"), ("tooling", "npm scripts"), ("external", "HTTPX"), ("testing", "pytest"), ("framework", "FastAPI"), ("database", "SQLAlchemy"),
    ("external", "Redis"), ("infrastructure", "Docker"), ("infrastructure", "Docker Compose"),
]


@query(known.per_repository("category tech", _MANIFEST))
def manifest_technologies(spark, sf_dir):
    return _code(spark, sf_dir).manifest


_ENV = [("Stripe", "config/settings.py", 2), ("PostgreSQL", "config/settings.py", 3), ("PostgreSQL", "config/settings.py", 4)]
_ENV_SQL = known.per_document("tech file line", [("Redis", known.SERVER, 8)]) + " UNION ALL SELECT * FROM (" + known.per_repository("tech file line", _ENV) + ")"


@query(f"SELECT *, 'environment_variable' AS kind FROM ({_ENV_SQL})")
def environment_evidence(spark, sf_dir):
    return _code(spark, sf_dir).environment


_STACK = sorted({"Express", "NestJS", "Vitest", "HTTPX", "pytest", "FastAPI", "Redis", "Docker", "Docker Compose", "SQLAlchemy", "PostgreSQL", "React", "Next.js", "Stripe"})


@query(f"SELECT DISTINCT {corpus.REPO_SQL.format(text='VARCHAR')} AS repo, {_list(_STACK)} AS technologies FROM documents")
def technology_stack(spark, sf_dir):
    """Union of manifests, sources, SQL texts and environment."""
    return technology.stack(_code(spark, sf_dir).technologies)


_BOUNDARIES = [("HTTPX", "external_system", 0.72), ("PostgreSQL", "database", 0.95), ("Redis", "external_system", 0.95), ("SQLAlchemy", "database", 0.72), ("Stripe", "external_system", 0.95)]


@query(f"SELECT b.*, least(20, CASE b.name WHEN 'PostgreSQL' THEN n + 2 WHEN 'Redis' THEN 2 * n WHEN 'Stripe' THEN 1 ELSE 0 END) AS places FROM ({known.per_repository('name type confidence', _BOUNDARIES)}) b JOIN (SELECT {corpus.REPO_SQL.format(text='VARCHAR')} AS repo, count(*) AS n FROM documents GROUP BY 1) c USING (repo)")
def technology_boundaries(spark, sf_dir):
    return _code(spark, sf_dir).boundaries.select("repo", "name", "type", "confidence", F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("places"))


@query(known.per_repository("prefix dest", [("@", "web/src")]))
def tsconfig_aliases(spark, sf_dir):
    return resolve.tsconfig_aliases(corpus.code_files(spark, sf_dir)).select("repo", F.inline("aliases"))


@query(known.per_repository("file reason", [(known.SERVER, "package main points here"), (known.SERVER, "package start script starts this file"), (known.SERVER, "Docker CMD or ENTRYPOINT references this file")]))
def manifest_entrypoints(spark, sf_dir):
    return resolve.manifest_entries(corpus.code_files(spark, sf_dir)).select("repo", "file", "reason")


@query(known.per_document("file reason", [(known.SERVER, "uses a conventional server.js entrypoint filename"), (known.SERVER, "starts an HTTP listener"), (known.MODEL, "contains a __main__ execution guard")]))
def entry_evidence(spark, sf_dir):
    from ..operators import python_facts, script_facts

    a = _code(spark, sf_dir)
    return python_facts.entry_evidence(a.python).unionByName(script_facts.entry_evidence(a.scripts)).select("repo", "file", "reason")


_FLOWS = [
    (known.API, "GET", "/v$ID/orders/{key}", 9, ["GET /v$ID/orders/{key}", "read_order", "Billing", "fetch", "load_orders", "build_$ID"]),
    (known.API, "POST", "/v$ID/orders", 15, ["POST /v$ID/orders", "add_order", "load_orders", "build_$ID"]),
    (known.SHOP, "GET", "/api/items", 7, ["GET /api/items", "listItems"]),
    (known.CART, "GET", "/cart_$ID", 1, ["GET /cart_$ID", "GET"]), (known.CART, "POST", "/cart_$ID", 4, ["POST /cart_$ID", "POST", "GET"]), (known.PING, "ANY", "/api/ping_$ID", 1, ["ANY /api/ping_$ID", "ping"]),
    (known.SHOP, "POST", "/api/items/:id", 8, ["POST /api/items/:id"]), (known.NESTED, "DELETE", "/api/deep/:key", 3, ["DELETE /api/deep/:key"]), (known.LOOSE, "GET", "/loose", 3, ["GET /loose"]), (known.NEST, "GET", "/orders-$ID/:id", 3, ["GET /orders-$ID/:id"]),
]


@query()
def route_flows(spark, sf_dir):
    """Traces of all routes. Which names are unique depends on the repository's size, so tests hold this against a queue walk."""
    nodes, _ = _code(spark, sf_dir).flows
    return nodes.groupBy("repo", "flow").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]).alias("labels"))


@query(known.per_document("flow", [("route:" + known.CART + ":1:GET:/cart_$ID",), ("route:" + known.CART + ":4:POST:/cart_$ID",)]))
def trace_query(spark, sf_dir):
    """Flows with a label that contains 'CART_'."""
    nodes, _ = _code(spark, sf_dir).flows
    return graphs.trace(nodes, "CART_").select("repo", "flow").distinct()


# Requests, telemetry, listings ------------------------------------------------------------------------------------------------------------

WINDOW = 3 * 24 * 3600 * 1000


@query(
    f"""WITH RECURSIVE e AS (SELECT concat('user_', CAST(user_id AS VARCHAR)) AS key, event_id AS id, epoch_us(ts) // 1000 AS ms, CASE WHEN user_id % 2 = 0 THEN 20 ELSE 5 END AS max_n, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
    f AS (SELECT key, id, ms, max_n, n, [ms] AS log, true AS allowed, NULL::BIGINT AS oldest FROM e WHERE n = 1
      UNION ALL SELECT x.key, x.id, x.ms, x.max_n, x.n, CASE WHEN len(x.live) < x.max_n THEN x.live || [x.ms] ELSE x.live END, len(x.live) < x.max_n, x.live[1]
      FROM (SELECT e.*, list_filter(f.log, lambda t: e.ms - t < {WINDOW}) AS live FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1) x)
    SELECT key, id, allowed, CAST(CASE WHEN allowed THEN max_n - len(log) ELSE 0 END AS INTEGER) AS remaining, CASE WHEN NOT allowed THEN CAST(greatest(1, ceil((oldest + {WINDOW} - ms) / 1000.0)) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS retry_after FROM f"""
)
def rate_limit_admission(spark, sf_dir):
    """Events as requests of their users, with a window of three days."""
    e = table(spark, sf_dir, "events")
    key, _ = admission.quota(F.col("user_id").cast("string"), F.lit(None).cast("string"))
    r = e.select(key.alias("key"), F.col("event_id").alias("id"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000").alias("ms"), F.when(F.col("user_id") % 2 == 0, fixed.USER_LIMIT).otherwise(fixed.PUBLIC_LIMIT).alias("max_n"))
    return admission.admit(r, WINDOW).withColumn("retry_after", F.coalesce("retry_after", F.lit(0).cast("long")))


@query(ORACLE_SQL["rate_limit_admission"])
def event_time_admission(spark, sf_dir):
    """The same admissions by a stream that gets the requests in no order, an hour late at most; one request of another key far ahead ends the wait."""
    hour = 3_600_000
    e = table(spark, sf_dir, "events")
    key, _ = admission.quota(F.col("user_id").cast("string"), F.lit(None).cast("string"))
    ms = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000")
    r = e.select(key.alias("key"), F.col("event_id").alias("id"), ms.alias("ms"), F.when(F.col("user_id") % 2 == 0, fixed.USER_LIMIT).otherwise(fixed.PUBLIC_LIMIT).alias("max_n"))
    root = f"{scratch.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # Four files in the order of jittered times, so that rows come up to an hour after later ones.
    late = r.withColumn("arrives", F.col("ms") + F.pmod(F.xxhash64("id"), F.lit(hour)))
    late.repartitionByRange(4, "arrives").drop("arrives").write.parquet(f"{root}/in")
    r.agg((F.max("ms") + 40 * 24 * hour).alias("ms")).select(F.lit("end").alias("key"), F.lit(-1).cast("long").alias("id"), "ms", F.lit(1).alias("max_n")).write.mode("append").parquet(f"{root}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, admission.EVENT_TIME_STORE)
    try:
        stream = admission.admit_in_event_time(spark.readStream.schema(r.schema).parquet(f"{root}/in"), "2 hours", WINDOW)
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{root}/out").withColumn("retry_after", F.coalesce("retry_after", F.lit(0).cast("long")))


@query("SELECT CASE WHEN event_type = 'error' THEN concat('ip_10.0.0.', CAST(user_id AS VARCHAR)) ELSE concat('user_', CAST(user_id AS VARCHAR)) END AS key, CASE WHEN event_type = 'error' THEN 5 ELSE 20 END AS max_n, count(*) AS requests FROM events GROUP BY ALL")
def quota_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    user = F.when(F.col("event_type") == "error", F.lit("anonymous")).otherwise(F.col("user_id").cast("string"))
    key, most = admission.quota(user, F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")))
    return e.select(key.alias("key"), most.alias("max_n")).groupBy("key", "max_n").agg(F.count("*").alias("requests"))


@query("WITH e AS (SELECT CASE WHEN value * 500 < 5000 THEN '<5s' WHEN value * 500 < 15000 THEN '5-15s' WHEN value * 500 < 30000 THEN '15-30s' ELSE '>30s' END AS duration, CASE WHEN user_id * 10 < 50 THEN '<50' WHEN user_id * 10 <= 200 THEN '50-200' WHEN user_id * 10 <= 1000 THEN '200-1000' ELSE '1000+' END AS files FROM events) SELECT duration, files, count(*) AS events FROM e GROUP BY ALL")
def telemetry_buckets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(telemetry.bucket_duration(F.col("value") * 500).alias("duration"), telemetry.bucket_files(F.col("user_id") * 10).alias("files")).agg(F.count("*").alias("events"))


@query("SELECT event_id, list_sort(['kind', 'score'] || CASE WHEN event_type IN ('click', 'view') THEN ['ref'] ELSE []::VARCHAR[] END) AS keys FROM events")
def sanitised_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ref = F.when(F.col("event_type").isin("click", "view"), F.lit("plain")).otherwise(F.lit("https://x/y"))
    m = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("Email"), F.lit("a@b"), F.lit("score"), F.lit("4/5"), F.lit("ref"), ref)
    return e.select("event_id", F.array_sort(F.map_keys(telemetry.sanitised(m))).alias("keys"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN concat('10.', CAST(user_id AS VARCHAR), '.***.***') WHEN user_id % 3 = 1 THEN concat('fe80:', CAST(user_id AS VARCHAR), ':****:****') ELSE '***.***' END AS ip FROM events")
def masked_addresses(spark, sf_dir):
    u = F.col("user_id").cast("string")
    ip = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("10."), u, F.lit(".7.9"))).when(F.col("user_id") % 3 == 1, F.concat(F.lit("fe80:"), u, F.lit(":1:2:3:4:5:6"))).otherwise(F.lit("nowhere"))
    return table(spark, sf_dir, "events").select("event_id", telemetry.masked_ip(ip).alias("ip"))


_PADS = ["".join(f"{b ^ pad:02X}" for b in b"secret".ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"SELECT event_id, left(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(CAST(user_id AS VARCHAR))))), 16) AS id FROM events")
def pseudonymous_ids(spark, sf_dir):
    """HMAC ids of users."""
    return table(spark, sf_dir, "events").select("event_id", telemetry.keyed_hash(F.col("user_id").cast("string"), "secret", 16).alias("id"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 2 THEN NULL ELSE 'acme' END AS owner, CASE WHEN page_id % 3 = 2 THEN NULL ELSE concat('tool-', CAST(page_id AS VARCHAR)) END AS repo FROM pages")
def repository_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    n = F.concat(F.lit("tool-"), F.col("page_id").cast("string"))
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.github.com/acme/"), n, F.lit(".git"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit(" acme/"), n)).otherwise(F.col("url"))
    found = repository.parse_repository_url(url)
    return p.select("page_id", found["owner"].alias("owner"), found["repo"].alias("repo"))


@query("SELECT c_name AS name, concat(c_mktsegment, '/', c_name) AS full_name, row_number() OVER (ORDER BY c_acctbal DESC, concat(c_mktsegment, '/', c_name)) - 15 AS n, true AS has_more FROM customer WHERE contains(lower(concat(c_mktsegment, '/', c_name)), 'build') QUALIFY n BETWEEN 1 AND 15")
def repository_listing(spark, sf_dir):
    """The second page of a listing (its size is the feature)."""
    r = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.concat_ws("/", "c_mktsegment", "c_name").alias("full_name"), F.lit(None).cast("string").alias("description"), F.col("c_acctbal").alias("updated_at"))
    return repository.listing_page(r, "BUILD", 2).select("name", "full_name", "n", "has_more")


@query("SELECT conv_id, turn, CAST(greatest(1, least(5, turn * 2)) AS INTEGER) AS score, left(role, 100) AS use, list_slice(string_split(text, ' '), 1, 10) AS missing, CAST(length(left(text, 500)) AS INTEGER) AS comment_length FROM conversations")
def feedback_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", telemetry.feedback(F.col("turn") * 2, F.col("role"), F.split("text", " "), F.col("text")).alias("f")).select("conv_id", "turn", "f.*")


@query("SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'UNAUTHORIZED' WHEN 1 THEN 'FORBIDDEN' WHEN 2 THEN 'NOT_FOUND' WHEN 3 THEN 'RATE_LIMITED' WHEN 4 THEN 'UPSTREAM_ERROR' END AS code FROM events")
def fetch_error_codes(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, [401, 403, 404, 429, 503, 200])), (F.col("user_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", repository.fetch_error(status).alias("code"))


@query("SELECT event_id, CASE user_id % 6 WHEN 0 THEN 413 WHEN 1 THEN 404 WHEN 2 THEN 504 WHEN 3 THEN 429 WHEN 4 THEN 400 END AS status, CASE WHEN user_id % 6 = 2 THEN 'timeout' WHEN user_id % 6 = 3 THEN 'rate_limited' WHEN user_id % 6 = 5 OR value < 5 THEN 'network_error' END AS reason FROM events")
def error_responses(spark, sf_dir):
    """Status of each error code, and why a client goes on without the server."""
    code = F.element_at(F.array(*map(F.lit, ["TOO_MANY_FILES", "REPO_NOT_FOUND", "FETCH_TIMEOUT", "UPSTREAM_GITHUB_RATE_LIMITED", "OTHER", None])), (F.col("user_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", telemetry.error_status(code).alias("status"), telemetry.fallback_reason(code, F.col("value") < 5).alias("reason"))


@query("SELECT CAST(event_id AS VARCHAR) AS request_id, concat('10.', CAST(user_id AS VARCHAR), '.***.***') AS ip, CASE WHEN user_id % 5 < 3 THEN 'public' ELSE 'authenticated' END AS kind, CASE WHEN event_type = 'error' THEN 'TOO_MANY_FILES' ELSE 'SUCCESS' END AS code, CASE WHEN event_type = 'error' THEN 'TOO_MANY_FILES' END AS failure FROM events")
def request_log(spark, sf_dir):
    """Log rows of events as requests."""
    u = F.col("user_id")
    user = F.when(u % 5 == 0, "anonymous").when(u % 5 == 1, "").when(u % 5 > 2, u.cast("string"))
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("request_id"), "ts", F.lit("POST").alias("method"), F.lit("acme/tool").alias("repo"), F.concat(F.lit("10."), u.cast("string"), F.lit(".1.2")).alias("ip"), user.alias("user"),
        F.lit(1).alias("duration_ms"), F.lit(2).alias("files"), F.lit(200).alias("status"), F.when(F.col("event_type") == "error", "TOO_MANY_FILES").alias("code"),
    )
    return telemetry.request_log(e).select(F.col("requestId").alias("request_id"), F.col("clientIp").alias("ip"), F.col("userType").alias("kind"), F.col("resultCode").alias("code"), F.col("failureCategory").alias("failure"))


@query("SELECT event_id, event_type AS kind FROM events WHERE user_id % 3 = 0")
def consented_events(spark, sf_dir):
    """What a telemetry sink may be given: events of those who agreed, without identifying entries."""
    u = F.col("user_id") % 3
    e = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("kind"), "event_type", F.lit("path"), F.lit("a/b")).alias("props"), F.when(u == 0, "granted").when(u == 1, "denied").alias("consent"))
    return telemetry.captured(e).select("event_id", F.col("props")["kind"].alias("kind"))


@query("SELECT concat('r', CAST(user_id % 50 AS VARCHAR)) AS repo, count(*) FILTER (event_type = 'click') AS mounts, count(*) FILTER (event_type = 'error') AS paths FROM events GROUP BY ALL")
def warning_counts(spark, sf_dir):
    """Warnings of each repository, from events as diagnostics."""
    code = F.when(F.col("event_type") == "click", "DYNAMIC_ROUTE_MOUNT_UNRESOLVED").when(F.col("event_type") == "error", "EXPRESS_ROUTE_PATH_INCOMPLETE").otherwise("other")
    return views.warning_counts(table(spark, sf_dir, "events").select(F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string")).alias("repo"), code.alias("code")))


@query("SELECT page_id, CASE WHEN page_id % 10 < 5 THEN concat('sample-', CAST(page_id % 10 AS VARCHAR)) END AS artifact FROM pages")
def sample_lookup(spark, sf_dir):
    """Stored samples for addresses of repositories, however they are written."""
    n = (F.col("page_id") % 10).cast("string")
    asked = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://github.com/Acme/Tool-"), n, F.lit(".git"))).otherwise(F.concat(F.lit("acme/tool-"), n)).alias("url"))
    samples = spark.createDataFrame([(f"acme/tool-{i}", f"sample-{i}") for i in range(5)], "url string, artifact string")
    return repository.with_samples(asked, samples).select("page_id", "artifact")


@query(f"WITH {DOC_FILES} SELECT repo, path, CASE WHEN {SUFFIX} IN {_in(fixed.PY_SUFFIXES)} THEN 'python' WHEN {SUFFIX} IN {_in(fixed.JS_SUFFIXES)} THEN 'javascript' END AS language FROM files")
def registered_languages(spark, sf_dir):
    """The registered language of every file."""
    return doc_files(spark, sf_dir).select("repo", "path", languages.language_of(F.col("path")).alias("language"))


# A whole artifact with one route, of which other parts break one rule each.
_ARTIFACT = (
    '{"schemaVersion":"1.1.0","repository":{"name":"r","source":"local","languages":{},"fileCount":1,"sourceFileCount":1,"parsedFileCount":1,"lines":1,"fingerprint":{}},'
    '"technologies":[],"files":[],"symbols":[],"imports":[],"calls":[],"routes":[{"id":"i","method":"GET","path":"/x","handler":"h","file":"f","line":3,"framework":"F","confidence":0.5}],'
    '"databases":[],"entrypoints":[],"flows":[],"architecture":{"components":[],"connections":[]},"metrics":{},"diagnostics":[],"metadata":{"fileComponents":{}}}'
)
# (text, text in its place, rule broken, place, whether it is still shown)
_BREAKS = [
    ("", "", None, None, True), ('"flows":[],', "", "flows: required", None, False), ('"fileCount":1', '"fileCount":-1', "repository.fileCount: at least 0", None, True),
    ('"confidence":0.5', '"confidence":2', "routes[].confidence: at most 1", 0, True), ('"line":3', '"line":"3"', "routes[].line: integer", 0, True),
    ('"metrics":{}', '"metrics":null', "metrics: object", None, False), ('"name":"r"', '"name":""', None, None, False), ("{", "", "object", None, False),
    ('"diagnostics":[]', '"diagnostics":[{"severity":"info","code":"c","message":"m"},{"severity":"fatal","code":"c","message":"m","file":null}]', "diagnostics[].severity: one of info, warning, error", 1, True),
]


def _part_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit(_ARTIFACT)
    for i, (a, b, *_) in enumerate(_BREAKS):
        if a:
            text = F.when(F.col("p_partkey") % len(_BREAKS) == i, F.lit(_ARTIFACT.replace(a, b, 1))).otherwise(text)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("repo"), text.alias("json"))


def _quoted(v: str | int | None, kind: str) -> str:
    return f"CAST({'NULL' if v is None else repr(v)} AS {kind})"


@query(" UNION ALL ".join(f"SELECT p_partkey AS repo, {_quoted(rule, 'VARCHAR')} AS rule, {_quoted(place, 'INTEGER')} AS place FROM part WHERE p_partkey % {len(_BREAKS)} = {i}" for i, (_, _, rule, place, _) in enumerate(_BREAKS) if rule))
def artifact_violations(spark, sf_dir):
    """Rules that stored artifacts break, one artifact for each part."""
    return artifact.violations(_part_artifacts(spark, sf_dir))


@query("SELECT p_partkey AS repo, CASE " + " ".join(f"WHEN p_partkey % {len(_BREAKS)} = {i} THEN {str(shown).lower()}" for i, (*_, shown) in enumerate(_BREAKS)) + " END AS shape_ok FROM part")
def artifact_guard(spark, sf_dir):
    """Whether each of them can be shown."""
    return artifact.guarded(_part_artifacts(spark, sf_dir)).select("repo", "shape_ok")


@query(f"SELECT p_partkey AS repo FROM part WHERE p_partkey % {len(_BREAKS)} IN (0, 6)")
def artifact_gate(spark, sf_dir):
    """Those that break no rule, let through the gate; a broken one would end the query (tests/test_artifact.py)."""
    return artifact.gated(_part_artifacts(spark, sf_dir).where(F.col("repo") % len(_BREAKS) % 6 == 0)).select("repo")
