"""Derived views of a repository: records, layers, architecture, rankings, tour, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.columns import ends_with_any, fixed_table, name_of, suffix_of, unordered


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in fixed.LANGUAGES.items() for x in pair))
    return F.coalesce(table[suffix_of(path)], F.lit("Configuration"))


def file_records(files: DataFrame) -> DataFrame:
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    return files.select("repo", F.concat(F.lit("file:"), "path").alias("id"), "path", language(F.col("path")).alias("language"), lines.cast("long").alias("lines"), F.col("bytes").cast("long").alias("bytes"), F.sha2("content", 256).alias("hash"), F.lit("source").alias("role"))


def language_shares(records: DataFrame) -> DataFrame:
    """Per repository: lines of each language but Configuration and Markdown, and their share in per cent to one digit (half to even)."""
    s = records.where(~F.col("language").isin("Configuration", "Markdown")).groupBy("repo", "language").agg(F.sum("lines").alias("lines"))
    total = F.sum("lines").over(W.partitionBy("repo"))
    return s.withColumn("share", F.bround(F.col("lines").cast("double") / total * 100, 1))


def language_counts(records: DataFrame) -> DataFrame:
    return records.where(~F.col("language").isin("Configuration", "Markdown")).groupBy("repo", "language").agg(F.count("*").alias("files"))


def layers(files: DataFrame, routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, path, component, evidence): the first rule that fits, over parts of the lower-cased path, routes and kinds of symbols."""
    low = F.lower("path")
    parts = F.split(low, "/")
    has = lambda words: F.arrays_overlap(parts, F.array(*map(F.lit, words)))
    kinds = symbols.groupBy("repo", F.col("file").alias("path")).agg(F.max(F.col("type") == "database_model").alias("model"), F.max(F.col("type") == "component").alias("view"))
    routed = routes.select("repo", F.col("file").alias("path")).distinct().withColumn("routed", F.lit(True))
    f = files.select("repo", "path").join(kinds, ["repo", "path"], "left").join(routed, ["repo", "path"], "left")
    more = {"api": F.coalesce("routed", F.lit(False)), "database": F.coalesce("model", F.lit(False)), "frontend": F.coalesce("view", F.lit(False)), "infrastructure": name_of(F.col("path")).isin(fixed.INFRASTRUCTURE_NAMES)}
    rules = [(has(fixed.TEST_DIRS) | ends_with_any(low, fixed.TEST_ENDINGS), "tests", "test path or filename")]
    rules += [(has(words) | more.get(name, F.lit(False)), name, why) for name, words, why in fixed.LAYERS]
    rules += [(suffix_of(F.col("path")).isin(fixed.CONFIGURATION_SUFFIXES), "configuration", "configuration file"), (has(["src", "app"]), "frontend", "frontend container path")]
    pick = F.lit(None)
    for rule, name, why in reversed(rules):
        pick = F.when(rule, F.struct(F.lit(name).alias("component"), F.lit(why).alias("evidence"))).otherwise(pick)
    other = F.struct(F.lit("other").alias("component"), F.lit("source file outside a recognized layer").alias("evidence"))
    return f.select("repo", "path", F.coalesce(pick, other).alias("x")).select("repo", "path", "x.component", "x.evidence")


def components(layer: DataFrame) -> DataFrame:
    """(repo, id, name, type, ord, files, confidence, evidence), one row for each layer that has files."""
    dim = fixed_table(layer.sparkSession, [(i, c, n) for i, (c, n) in enumerate(fixed.COMPONENTS)], "ord int, component string, name string")
    g = layer.groupBy("repo", "component").agg(F.array_sort(F.collect_list("path")).alias("files"), unordered("evidence").alias("evidence")).join(F.broadcast(dim), "component")
    return g.select("repo", F.col("component").alias("id"), "name", F.col("component").alias("type"), "ord", "files", F.when(F.col("component").isin(fixed.SURE_COMPONENTS), 0.94).otherwise(0.82).cast("double").alias("confidence"), "evidence")


def connections(imports: DataFrame, layer: DataFrame) -> DataFrame:
    """(repo, id, source, target, type, weight): imports between layers. Edges are counted before the layers are joined."""
    edges = imports.where("target IS NOT NULL").groupBy("repo", "file", "target").agg(F.count("*").alias("n"))
    a = layer.select("repo", F.col("path").alias("file"), F.col("component").alias("s"))
    b = layer.select("repo", F.col("path").alias("target"), F.col("component").alias("t"))
    w = edges.join(a, ["repo", "file"]).join(b, ["repo", "target"]).where("s <> t").groupBy("repo", F.col("s").alias("source"), F.col("t").alias("target")).agg(F.sum("n").alias("weight"))
    return w.select("repo", F.concat(F.lit("component:"), "source", F.lit(":"), "target").alias("id"), "source", "target", F.lit("imports").alias("type"), "weight")


def entrypoints(files: DataFrame, evidence: DataFrame, top: int = 10) -> DataFrame:
    """(repo, rank, file, score, confidence, evidence), the ``top`` of each repository. evidence: (repo, file, ord, reason)."""
    dim = fixed_table(files.sparkSession, list(fixed.ENTRY_NAMES.items()), "name string, points int")
    why = evidence.groupBy("repo", "file", "reason").agg(F.min("ord").alias("ord")).groupBy("repo", F.col("file").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "reason"))), lambda x: x["reason"]).alias("reasons"))
    f = files.select("repo", "path", name_of(F.col("path")).alias("name")).join(F.broadcast(dim), "name", "left").join(why, ["repo", "path"], "left")
    reasons = F.coalesce("reasons", F.array().cast("array<string>"))
    score = F.coalesce("points", F.lit(0)) + fixed.ENTRY_EVIDENCE * F.size(reasons)
    named = F.when(F.col("points").isNotNull(), F.array(F.concat(F.lit("uses the conventional "), "name", F.lit(" filename")))).otherwise(F.array().cast("array<string>"))
    e = f.select("repo", F.col("path").alias("file"), score.cast("int").alias("score"), F.array_distinct(F.concat(reasons, named)).alias("evidence")).where("score > 0")
    e = e.withColumn("confidence", F.least(F.lit(0.99).cast("double"), F.lit(0.45).cast("double") + F.col("score") / F.lit(150.0)))
    return e.withColumn("rank", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("score"), "file"))).where(F.col("rank") <= top)


def degrees(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, path, inbound, outbound) of every file, over local imports."""
    e = imports.where("target IS NOT NULL")
    n = e.select("repo", F.col("target").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select("repo", F.col("file").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o"))).groupBy("repo", "path").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return files.select("repo", "path").join(n, ["repo", "path"], "left").select("repo", "path", F.coalesce("i", F.lit(0)).cast("long").alias("inbound"), F.coalesce("o", F.lit(0)).cast("long").alias("outbound"))


def important_files(degree: DataFrame, routes: DataFrame, entries: DataFrame, top: int = 20) -> DataFrame:
    """(repo, rank, file, score, reasons): 3 a dependent, 2 a dependency, 8 a route, the entry score, 12 for project configuration."""
    r = routes.groupBy("repo", F.col("file").alias("path")).agg(F.count("*").alias("routes"))
    e = entries.select("repo", F.col("file").alias("path"), F.col("score").alias("entry"))
    f = degree.join(r, ["repo", "path"], "left").join(e, ["repo", "path"], "left").na.fill(0, ["routes", "entry"])
    config = F.when(name_of(F.col("path")).isin(fixed.IMPORTANT_CONFIGURATION), 12).otherwise(0)
    score = F.col("inbound") * 3 + F.col("outbound") * 2 + F.col("routes") * 8 + F.col("entry") + config
    say = lambda n, a, b: F.when(F.col(n) > 0, F.concat(F.lit(a), F.col(n).cast("string"), F.lit(b)))
    reasons = F.array_compact(F.array(F.when(F.col("entry") > 0, F.lit("entrypoint candidate")), say("routes", "defines ", " route(s)"), say("inbound", "imported by ", " file(s)"), say("outbound", "imports ", " local file(s)"), F.when(config > 0, F.lit("project configuration"))))
    out = f.select("repo", F.col("path").alias("file"), score.cast("long").alias("score"), reasons.alias("reasons")).where("score > 0")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("score"), "file"))).where(F.col("rank") <= top)


def most_connected(degree: DataFrame, top: int = 10) -> DataFrame:
    d = degree.select("repo", F.col("path").alias("file"), (F.col("inbound") + F.col("outbound")).alias("connections"))
    return d.withColumn("rank", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("connections"), "file"))).where(F.col("rank") <= top)


def high_coupling(degree: DataFrame, over: int = 20) -> DataFrame:
    return degree.select("repo", F.col("path").alias("file"), (F.col("inbound") + F.col("outbound")).alias("connections")).where(F.col("connections") > over)


def metrics(files: DataFrame, symbols: DataFrame, imports: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row a repository: local and external dependencies and the complexity score, at most 100, rounded half to even."""
    f = files.groupBy("repo").agg(F.count("*").alias("files"))
    s = symbols.groupBy("repo").agg(F.count("*").alias("symbols"))
    i = imports.groupBy("repo").agg(F.count("target").alias("local"), F.count_if("external").alias("outside"))
    c = cycles.groupBy("repo").agg(F.count("*").alias("cycles"))
    m = f.join(s, "repo", "left").join(i, "repo", "left").join(c, "repo", "left").na.fill(0)
    d = lambda n: F.col(n).cast("double")
    raw = d("files") * F.lit(0.15).cast("double") + d("symbols") * F.lit(0.04).cast("double") + d("local") * F.lit(0.1).cast("double") + d("cycles") * F.lit(5.0).cast("double")
    return m.select("repo", "files", "symbols", F.col("local").alias("local_dependencies"), F.col("outside").alias("external_dependencies"), "cycles", F.least(F.lit(100.0).cast("double"), F.bround(raw, 0)).cast("long").alias("complexity"))


def repository_totals(records: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per repository: files, source files, parsed files, lines, and the parse rate in per cent (100 without source files). parsed: (repo, path)."""
    r = records.join(parsed.select("repo", "path").distinct().withColumn("ok", F.lit(1)), ["repo", "path"], "left")
    source = ~F.col("language").isin("Configuration", "Markdown")
    t = r.groupBy("repo").agg(F.count("*").alias("files"), F.count_if(source).alias("source_files"), F.count("ok").alias("parsed_files"), F.sum("lines").alias("lines"))
    return t.withColumn("parse_rate", F.when(F.col("source_files") == 0, F.lit(100.0).cast("double")).otherwise(F.bround(F.col("parsed_files").cast("double") / F.col("source_files") * 100, 1)))


def symbols_per_file(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("repo", "file").agg(F.count_if(F.col("type") != "module").alias("symbols"), unordered("type").alias("types"))


def tour(entries: DataFrame, comps: DataFrame, important: DataFrame, steps: int = 6) -> DataFrame:
    """(repo, step, title, file, description): the first entry, then described layers in order, then important files not named before."""
    texts = fixed_table(entries.sparkSession, list(fixed.TOUR.items()), "type string, description string")
    first = entries.where("rank = 1").select("repo", F.lit(0).alias("stage"), F.lit(0).alias("ord"), F.lit("Start at the entry point").alias("title"), "file", F.array_join(F.slice("evidence", 1, 2), "; ").alias("description"))
    layer = comps.join(F.broadcast(texts), "type").select("repo", F.lit(1).alias("stage"), "ord", F.concat(F.lit("Explore "), "name").alias("title"), F.col("files")[0].alias("file"), "description")
    head = first.unionByName(layer)
    rest = important.join(head.select("repo", "file").distinct(), ["repo", "file"], "left_anti").select("repo", F.lit(2).alias("stage"), F.col("rank").alias("ord"), F.lit("Read a central file").alias("title"), "file", F.array_join(F.slice("reasons", 1, 2), ", ").alias("description"))
    n = F.row_number().over(W.partitionBy("repo").orderBy("stage", "ord"))
    return head.unionByName(rest).withColumn("step", n).where(F.col("step") <= steps).drop("stage", "ord")
