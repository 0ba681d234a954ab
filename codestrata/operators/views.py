"""Views and exports of the architecture: search, status, filters, neighbours, layout, Mermaid, DOT and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Layers of each filter, and tiers of the layout from top to bottom.
FILTERS = {"api": ["frontend", "api"], "services": ["services", "domain", "workers", "other"], "data": ["repositories", "database"], "infra": ["infrastructure", "configuration", "tests"]}
TIERS = {"frontend": 0, "api": 1, "services": 2, "domain": 2, "workers": 2, "repositories": 3, "database": 4, "infrastructure": 4, "configuration": 4, "tests": 4, "other": 2}


def search_files(records: DataFrame, query: str) -> DataFrame:
    q = query.lower()
    return records.where(F.lower("path").contains(q) | F.lower("language").contains(q))


def file_status(error: Column, parsed: Column) -> Column:
    return F.when(error.isNotNull(), "Skipped").when(parsed, "Parsed").otherwise("Indexed")


def page(df: DataFrame, order: list[str], number: int, size: int = 100) -> DataFrame:
    """The rows of page ``number`` (from 1) of each repository in the given order, with n, and pages, their number."""
    w = W.partitionBy("repo")
    n = F.row_number().over(w.orderBy(*order))
    ranked = df.withColumn("n", n).withColumn("pages", F.ceil(F.count("*").over(w) / F.lit(size)).cast("int"))
    return ranked.where((F.col("n") > (number - 1) * size) & (F.col("n") <= number * size))


# How many rows of each table a view shows.
SLICES = {"onboarding": 3, "important": 5, "impacts": 12, "imports": 16, "warnings": 10, "symbols": 8, "files": 4}


def shown(df: DataFrame, view: str, order: list[str]) -> DataFrame:
    """The first rows of each repository, as many as the view shows."""
    return page(df, order, 1, SLICES[view]).drop("n", "pages")


def warning_counts(diagnostics: DataFrame) -> DataFrame:
    """(repo, mounts, paths): mounts that could not be followed, and paths that are incomplete."""
    code = F.col("code")
    mounts = F.count_if(code.isin("DYNAMIC_ROUTE_MOUNT_UNRESOLVED", "EXPRESS_ROUTE_MOUNT_UNRESOLVED"))
    return diagnostics.groupBy("repo").agg(mounts.alias("mounts"), F.count_if(code == "EXPRESS_ROUTE_PATH_INCOMPLETE").alias("paths"))


def skipped_diagnostics(skipped: DataFrame) -> DataFrame:
    """(repo, severity, code, message, file) of skipped files (repo, path, reason); '*' stands for no single file."""
    message = F.concat(F.lit("Skipped "), "path", F.lit(": "), "reason")
    return skipped.select("repo", F.lit("info").alias("severity"), F.concat(F.lit("skipped_"), "reason").alias("code"), message.alias("message"), F.nullif("path", F.lit("*")).alias("file"))


def flow_named(rows: DataFrame, method: str, path: str) -> DataFrame:
    """Nodes of the flows of the route with this method and path."""
    top = rows.where((F.col("n") == 1) & (F.col("label") == f"{method} {path}")).select("repo", "flow")
    return rows.join(top, ["repo", "flow"], "left_semi")


def filter_layers(components: DataFrame, group: str) -> DataFrame:
    return components if group == "all" else components.where(F.col("type").isin(FILTERS[group]))


def induced(connections: DataFrame, components: DataFrame) -> DataFrame:
    """Connections of which both ends are among the components."""
    c = components.select("repo", "id")
    return connections.join(c.withColumnRenamed("id", "source"), ["repo", "source"], "left_semi").join(c.withColumnRenamed("id", "target"), ["repo", "target"], "left_semi")


def neighbours(components: DataFrame, connections: DataFrame, selected: str) -> DataFrame:
    """(repo, id, relation): selected, inbound (also where both hold), outbound or unrelated."""
    into = connections.where(F.col("target") == selected).select("repo", F.col("source").alias("id")).distinct().withColumn("i", F.lit(True))
    out = connections.where(F.col("source") == selected).select("repo", F.col("target").alias("id")).distinct().withColumn("o", F.lit(True))
    r = F.when(F.col("id") == selected, "selected").when(F.col("i"), "inbound").when(F.col("o"), "outbound").otherwise("unrelated")
    return components.join(into, ["repo", "id"], "left").join(out, ["repo", "id"], "left").select("repo", "id", r.alias("relation"))


def _tier(kind: Column) -> Column:
    out = F.lit(2)
    for name, tier in TIERS.items():
        out = F.when(kind == name, tier).otherwise(out)
    return out


def layout(components: DataFrame, step_x: int = 300, step_y: int = 170, left: int = 60, top: int = 50) -> DataFrame:
    """(repo, id, x, y): components in rows by tier, rows centred on the widest, tiers that are there one below the other."""
    t = components.withColumn("tier", _tier(F.col("type")))
    row, all_ = W.partitionBy("repo", "tier"), W.partitionBy("repo")
    t = t.withColumn("i", F.row_number().over(row.orderBy("ord")) - 1).withColumn("width", F.count("*").over(row) * step_x)
    t = t.withColumn("widest", F.max("width").over(all_)).withColumn("rank", F.dense_rank().over(all_.orderBy("tier")))
    x = F.greatest(F.lit(left), (F.col("widest") - F.col("width")) / 2 + left) + F.col("i") * step_x
    return t.select("repo", "id", x.cast("double").alias("x"), (F.lit(top) + (F.col("rank") - 1) * step_y).cast("long").alias("y"))


def edge_style(connections: DataFrame, selected: str | None = None) -> DataFrame:
    """Connections with side (where the line leaves, by tiers) and width: 1.5 and 0.4 an import up to 3.5; 3 if selected."""
    a, b = _tier(F.col("source")), _tier(F.col("target"))
    side = F.when(a == b, "right").when(a > b, "top").otherwise("bottom")
    width = F.least(F.lit(3.5).cast("double"), F.lit(1.5).cast("double") + F.lit(0.4).cast("double") * F.col("weight"))
    touched = (F.col("source") == F.lit(selected)) | (F.col("target") == F.lit(selected)) if selected else F.lit(False)
    return connections.withColumn("side", side).withColumn("width", F.when(touched, F.lit(3.0).cast("double")).otherwise(width))


def default_component(components: DataFrame) -> DataFrame:
    """(repo, id) that is shown first: the API layer, else the first."""
    return components.groupBy("repo").agg(F.min_by("id", F.struct(F.col("type") != "api", "ord")).alias("id"))


def _lines(parts: list[DataFrame], name: str) -> DataFrame:
    """One text for each repository from (repo, part, a, b, line) rows, in that order, each line ended."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("part", "a", "b", "line"))), lambda x: x["line"])
    return rows.groupBy("repo").agg(F.concat(F.array_join(sorted_, "\n"), F.lit("\n")).alias(name))


def _constant(repos: DataFrame, part: int, lines: list[str]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(f"{i:03d}").alias("a"), F.lit(s).alias("line")) for i, s in enumerate(lines)))
    return repos.select("repo", F.lit(part).alias("part"), F.inline(rows)).select("repo", "part", "a", F.lit("").alias("b"), "line")


def mermaid(components: DataFrame, connections: DataFrame) -> DataFrame:
    """(repo, mermaid): a flowchart of layers with file counts; edges of several imports carry their number."""
    safe = lambda c: F.replace(F.col(c), F.lit("-"), F.lit("_"))
    order = F.lpad(F.col("ord").cast("string"), 3, "0")
    nodes = components.select("repo", F.lit(1).alias("part"), order.alias("a"), F.lit("").alias("b"), F.concat(F.lit("    "), safe("id"), F.lit('["'), "name", F.lit(" ("), F.size("files"), F.lit(' files)"]')).alias("line"))
    label = F.when(F.col("weight") > 1, F.concat(F.lit("|"), "weight", F.lit("|"))).otherwise("")
    edges = connections.select("repo", F.lit(2).alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), F.concat(F.lit("    "), safe("source"), F.lit(" -->"), label, F.lit(" "), safe("target")).alias("line"))
    return _lines([_constant(components.select("repo").distinct(), 0, ["flowchart TD"]), nodes, edges], "mermaid")


# Head of a DOT export.
DOT_HEAD = [
    "digraph Architecture {",
    "    rankdir=LR;",
    '    node [shape=box, style="rounded,filled", fillcolor="#0d141a", fontcolor="#ffffff", fontname="Helvetica"];',
    '    edge [color="#4ce1f5", fontname="Helvetica", fontsize=10];',
    "",
]


def dot(components: DataFrame, connections: DataFrame) -> DataFrame:
    """(repo, dot): the same graph for Graphviz."""
    repos = components.select("repo").distinct()
    order = F.lpad(F.col("ord").cast("string"), 3, "0")
    nodes = components.select("repo", F.lit(1).alias("part"), order.alias("a"), F.lit("").alias("b"), F.concat(F.lit('    "'), "id", F.lit('" [label="'), "name", F.lit("\\n("), F.size("files"), F.lit(' files)"];')).alias("line"))
    label = F.when(F.col("weight") > 1, F.concat(F.lit(' [label="'), "weight", F.lit('"]'))).otherwise("")
    edges = connections.select("repo", F.lit(3).alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), F.concat(F.lit('    "'), "source", F.lit('" -> "'), "target", F.lit('"'), label, F.lit(";")).alias("line"))
    return _lines([_constant(repos, 0, DOT_HEAD), nodes, _constant(repos, 2, [""]), edges, _constant(repos, 4, ["}"])], "dot")


def architecture_json(components: DataFrame, connections: DataFrame) -> DataFrame:
    """(repo, json): components in order and connections by source and target, as one JSON text."""
    c = components.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "name", "type", "files", "confidence", "evidence"))), lambda x: x.dropFields("ord")).alias("components"))
    e = connections.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "target", "id", "type", "weight"))), lambda x: F.struct(x["id"].alias("id"), x["source"].alias("source"), x["target"].alias("target"), x["type"].alias("type"), x["weight"].alias("weight"))).alias("connections"))
    none = F.array().cast("array<struct<id: string, source: string, target: string, type: string, weight: bigint>>")
    return c.join(e, "repo", "left").select("repo", F.to_json(F.struct("components", F.coalesce("connections", none).alias("connections"))).alias("json"))
