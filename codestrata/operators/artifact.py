"""The analysis of a repository as one JSON artifact: writing, reading behind a shape guard, validation, and the gate.

``artifacts`` makes one row a repository; ``artifact_lines`` one row an item, which only a reader joins to a document.
"""

from __future__ import annotations

import itertools
import json
from functools import reduce
from typing import IO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import cut
from . import derive, graphs, quality, technology

VERSION = "1.1.0"

# Fixed values: (section, field, type, least, most). A '?' allows null, '!' a field that may be missing.
CONSTRAINTS = [
    ("", "schemaVersion", "string", None, None), ("", "repository", "object", None, None), ("", "technologies", "array", None, None), ("", "files", "array", None, None),
    ("", "symbols", "array", None, None), ("", "imports", "array", None, None), ("", "calls", "array", None, None), ("", "routes", "array", None, None), ("", "databases", "array", None, None),
    ("", "entrypoints", "array", None, None), ("", "flows", "array", None, None), ("", "architecture", "object", None, None), ("", "metrics", "object", None, None),
    ("", "diagnostics", "array", None, None), ("", "metadata", "object", None, None),
    ("", "repository.name", "string", None, None), ("", "repository.source", "string", None, None), ("", "repository.languages", "object", None, None), ("", "repository.fileCount", "integer", 0, None),
    ("", "repository.sourceFileCount", "integer", 0, None), ("", "repository.parsedFileCount", "integer", 0, None), ("", "repository.lines", "integer", 0, None), ("", "repository.fingerprint", "object", None, None),
    ("", "architecture.components", "array", None, None), ("", "architecture.connections", "array", None, None),
    ("", "metrics.localDependencies", "integer!", 0, None), ("", "metrics.externalDependencies", "integer!", 0, None),
    ("files", "id", "string", None, None), ("files", "path", "string", None, None), ("files", "language", "string", None, None), ("files", "lines", "integer", 0, None), ("files", "bytes", "integer", 0, None),
    ("files", "hash", "string", None, None), ("files", "role", "string", None, None), ("files", "parsed", "boolean", None, None), ("files", "error", "string?!", None, None),
    ("symbols", "id", "string", None, None), ("symbols", "type", "string", None, None), ("symbols", "name", "string", None, None), ("symbols", "file", "string", None, None), ("symbols", "line", "integer", 1, None),
    ("symbols", "exported", "boolean", None, None), ("symbols", "evidence", "array", None, None), ("symbols", "endLine", "integer?!", None, None), ("symbols", "parent", "string?!", None, None),
    ("imports", "id", "string", None, None), ("imports", "source", "string", None, None), ("imports", "module", "string", None, None), ("imports", "names", "array", None, None), ("imports", "line", "integer", 1, None),
    ("imports", "external", "boolean", None, None), ("imports", "target", "string?!", None, None),
    ("calls", "id", "string", None, None), ("calls", "source", "string", None, None), ("calls", "callee", "string", None, None), ("calls", "file", "string", None, None), ("calls", "line", "integer", 1, None), ("calls", "confidence", "number", 0, 1),
    ("routes", "id", "string", None, None), ("routes", "method", "string", None, None), ("routes", "path", "string", None, None), ("routes", "handler", "string", None, None), ("routes", "file", "string", None, None),
    ("routes", "line", "integer", 1, None), ("routes", "framework", "string", None, None), ("routes", "confidence", "number", 0, 1),
    ("databases", "name", "string", None, None), ("databases", "type", "string", None, None), ("databases", "confidence", "number", 0, 1), ("databases", "evidence", "array", None, None),
    ("entrypoints", "id", "string", None, None), ("entrypoints", "file", "string", None, None), ("entrypoints", "kind", "string", None, None), ("entrypoints", "score", "number", None, None),
    ("entrypoints", "confidence", "number", 0, 1), ("entrypoints", "evidence", "array", None, None),
    ("flows", "id", "string", None, None), ("flows", "name", "string", None, None), ("flows", "confidence", "number", 0, 1), ("flows", "nodes", "array", None, None), ("flows", "edges", "array", None, None),
    ("architecture.components", "id", "string", None, None), ("architecture.components", "name", "string", None, None), ("architecture.components", "files", "array", None, None), ("architecture.components", "confidence", "number", 0, 1),
    ("architecture.connections", "source", "string", None, None), ("architecture.connections", "target", "string", None, None), ("architecture.connections", "weight", "integer", 1, None),
    ("diagnostics", "severity", "string", None, None), ("diagnostics", "code", "string", None, None), ("diagnostics", "message", "string", None, None), ("diagnostics", "file", "string?!", None, None),
]

# Fields that take one of a few texts.
ONE_OF = {("diagnostics", "severity"): ("info", "warning", "error")}

# What a viewer asks of an artifact before it shows it.
SHAPE = [
    ("schemaVersion", "string"), ("repository.name", "some"), ("files", "array"), ("symbols", "array"), ("imports", "array"), ("calls", "array"), ("routes", "array"), ("entrypoints", "array"),
    ("flows", "array"), ("architecture.components", "array"), ("architecture.connections", "array"), ("metrics", "some"), ("diagnostics", "array"), ("metadata.fileComponents", "some"),
]


def _type(v: Column) -> Column:
    """string, integer, number, boolean, array, object, null, or null for a missing value."""
    t = F.schema_of_variant(v)
    integer = t == "BIGINT"
    number = t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT")
    return (
        F.when(v.isNull(), None).when(t == "VOID", "null").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(integer, "integer").when(number, "number")
        .when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object")
    )


def _get(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "variant")


def guarded(artifacts: DataFrame, json: str = "json") -> DataFrame:
    """All rows plus shape_ok: whether a text is an artifact that can be shown, by the conditions of SHAPE."""
    v = F.try_parse_json(F.col(json))

    def holds(field: str, kind: str) -> Column:
        x = _get(v, field)
        if kind != "some":
            return F.coalesce(_type(x) == kind, F.lit(False))
        text = F.try_variant_get(v, f"$.{field}", "string")
        return F.coalesce(~_type(x).isin("null") & ~F.coalesce(text.isin("", "0", "false"), F.lit(False)), F.lit(False))

    return artifacts.withColumn("shape_ok", reduce(lambda a, b: a & b, (holds(f, k) for f, k in SHAPE)))


def violations(artifacts: DataFrame, key: str = "repo", json: str = "json") -> DataFrame:
    """(key, rule, place): rules of CONSTRAINTS that artifacts break; place is the number of the element in its section, null at the top.

    A text that is no JSON object breaks the rule 'object'. Sections are exploded, and every rule is an expression: no Python and no shuffle.
    """
    v = artifacts.select(F.col(key), F.try_parse_json(F.col(json)).alias("v"))
    none = F.lit(None).cast("string")

    def rule(x: Column, section: str, field: str, kind: str, least: int | None, most: int | None) -> Column:
        value = _get(x, field)
        t, name = _type(value), f"{section + '[].' if section else ''}{field}"
        base = kind.rstrip("!?")
        allowed = [base, *(["integer"] if base == "number" else []), *(["null"] if "?" in kind else [])]
        number = F.try_variant_get(value, "$", "double")
        out = F.when(~t.isin(*allowed), f"{name}: {base}")
        if texts := ONE_OF.get((section, field)):
            out = out.when(~F.try_variant_get(value, "$", "string").isin(*texts), f"{name}: one of {', '.join(texts)}")
        if least is not None:
            out = out.when(number < least, f"{name}: at least {least}")
        if most is not None:
            out = out.when(number > most, f"{name}: at most {most}")
        return F.when(t.isNull(), none if "!" in kind else F.lit(f"{name}: required")).otherwise(out)

    top = F.array_compact(F.array(*(rule(F.col("v"), *c) for c in CONSTRAINTS if not c[0])))
    whole = F.coalesce(_type(F.col("v")) == "object", F.lit(False))
    out = v.select(key, F.explode(F.when(whole, top).otherwise(F.array(F.lit("object")))).alias("rule"), F.lit(None).cast("int").alias("place"))
    for section in dict.fromkeys(c[0] for c in CONSTRAINTS if c[0]):
        items = v.select(key, F.posexplode(F.try_variant_get("v", f"$.{section}", "array<variant>")).alias("place", "x"))
        broken = F.array_compact(F.array(*(rule(F.col("x"), *c) for c in CONSTRAINTS if c[0] == section)))
        out = out.unionByName(items.select(key, F.explode(broken).alias("rule"), "place"))
    return out


def gated(artifacts: DataFrame, key: str = "repo", json: str = "json") -> DataFrame:
    """The artifacts, failing with ANALYSIS_SCHEMA_ERROR if any of them breaks a rule."""
    n = violations(artifacts, key, json).groupBy(key).agg(F.count("*").alias("issues"))
    return quality.gate(artifacts.join(n, key, "left"), F.coalesce("issues", F.lit(0))).drop("issues")


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """One JSON line for each repository, behind the gate."""
    gated(artifacts).select("json").write.mode("overwrite").text(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(json, shape_ok) of stored artifacts."""
    return guarded(spark.read.text(path).withColumnRenamed("value", "json"))


def _section(df: DataFrame, section: str, order: list[str], /, **fields: Column | str) -> DataFrame:
    """(repo, section: array of structs in the given order)."""
    item = F.struct(*(F.col(o).alias(f"__{i}") for i, o in enumerate(order)), F.struct(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items())).alias("x"))
    return df.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(item)), lambda e: e["x"]).alias(section))


def _sections(a) -> dict[str, tuple[DataFrame, list[str], dict[str, Column | str]]]:
    """Lists of the artifact: rows, the columns that order them, and the fields of an item."""
    from ..functions.columns import suffix_of
    from . import languages

    parsed = suffix_of(F.col("path")).isin(languages.suffixes())
    errors = a.python.where("error IS NOT NULL").select("repo", F.col("file").alias("path"), "error")
    files = a.records.join(errors, ["repo", "path"], "left").withColumn("parsed", parsed & F.col("error").isNull())
    nodes, edges = a.flows
    node = nodes.groupBy("repo", "flow").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id", "type", "label", "file", "line"))), lambda e: e.dropFields("n")).alias("nodes"))
    edge = edges.groupBy("repo", "flow").agg(F.array_sort(F.collect_list(F.struct("source", "target", "type"))).alias("edges"))
    flows = graphs.flow_summaries(nodes).drop("nodes").join(node, ["repo", "flow"]).join(edge, ["repo", "flow"], "left").withColumn("edges", F.coalesce("edges", F.array().cast(dict(edge.dtypes)["edges"])))
    return {
        "components": (a.components, ["ord"], dict(id="id", name="name", type="type", files="files", confidence="confidence", evidence="evidence")),
        "files": (files, ["path"], dict(id="id", path="path", language="language", lines="lines", bytes="bytes", hash="hash", role="role", parsed="parsed", error="error")),
        "symbols": (a.symbols, ["file", "ord", "id"], dict(id="id", type="type", name="name", file="file", line="line", endLine="end_line", parent="parent", exported="exported", evidence="evidence")),
        "imports": (a.imports, ["file", "ord"], dict(id="id", source="file", module="module", names="names", line="line", target="target", external="external")),
        "calls": (a.calls, ["file", "ord"], dict(id="id", source="source", callee="callee", file="file", line="line", target="target", confidence="confidence")),
        "routes": (a.routes, ["file", "ord", "id"], dict(id="id", method="method", path="path", handler="handler", file="file", line="line", framework="framework", confidence="confidence")),
        "databases": (a.boundaries.where("type = 'database'"), ["name"], dict(name="name", type="type", confidence="confidence", evidence=F.coalesce("evidence", F.array().cast("array<struct<file: string, line: int, kind: string>>")))),
        "externalSystems": (a.boundaries.where("type = 'external_system'"), ["name"], dict(name="name", type="type", confidence="confidence", evidence=F.coalesce("evidence", F.array().cast("array<struct<file: string, line: int, kind: string>>")))),
        "entrypoints": (a.entrypoints, ["rank"], dict(id=F.concat(F.lit("entry:"), "file"), file="file", kind=F.lit("entrypoint"), score="score", confidence="confidence", evidence="evidence")),
        "flows": (flows, ["flow"], dict(id="flow", name="name", confidence="confidence", nodes="nodes", edges="edges")),
        "importantFiles": (a.important, ["rank"], dict(file="file", score="score", reasons="reasons")),
        "onboarding": (a.tour, ["step"], dict(step="step", title="title", file="file", description="description")),
        "diagnostics": (a.diagnostics, ["code", "file", "message"], dict(severity="severity", code="code", message="message", file="file")),
        "connections": (a.connections, ["source", "target"], dict(id="id", source="source", target="target", type="type", weight="weight")),
    }


def section_lines(df: DataFrame, section: str, order: list[str], fields: dict[str, Column | str]) -> DataFrame:
    """(repo, section, place, json): each item of a section as a line of its own. ``place`` sorts as ``order`` does: whole numbers from 0 on are filled up with zeros."""
    kinds = dict(df.dtypes)
    place = F.array(*(F.lpad(F.col(c).cast("string"), 20, "0") if kinds[c] in ("int", "bigint") else F.coalesce(F.col(c), F.lit("")) for c in order))
    item = F.struct(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()))
    return df.select("repo", F.lit(section).alias("section"), place.alias("place"), F.to_json(item, {"ignoreNullFields": "false"}).alias("json"))


#: Sections at the top of a document, and those that it nests in another object.
LISTS = ("files", "symbols", "imports", "calls", "routes", "databases", "externalSystems", "entrypoints", "flows", "importantFiles", "onboarding", "diagnostics")
NESTED = {"components": "architecture", "connections": "architecture", "fileComponents": "metadata"}


def artifact_lines(a, source: str = "local") -> DataFrame:
    """(repo, section, place, json) of the whole analysis: no row holds more than one item, so a repository may be of any size.

    The section '' has one line a repository, with all that is no long list.
    """
    out = artifacts(a, source, lists=False).select("repo", F.lit("").alias("section"), F.array().cast("array<string>").alias("place"), "json")
    for name, (df, order, fields) in _sections(a).items():
        out = out.unionByName(section_lines(df, name, order, fields))
    return out.unionByName(section_lines(a.layers, "fileComponents", ["path"], {"path": "path", "component": "component"}))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in order, dealt by ranges of (repo, section, place): a large section lies in many neighbouring files, each sorted."""
    lines = cut(lines)  # dealing by ranges reads its input twice, once for a sample
    lines.repartitionByRange("repo", "section", "place").sortWithinPartitions("repo", "section", "place").write.mode("overwrite").parquet(path)


def read_lines(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """The lines of one repository in the order of a document: '' first, sections that are nested last."""
    last = F.coalesce(*(F.when(F.col("section") == n, F.lit(i + 1)) for i, n in enumerate(NESTED)), F.lit(0))
    return spark.read.parquet(path).where(F.col("repo") == repo).orderBy(last, "section", "place")


def write_document(lines: DataFrame, out: IO[str]) -> None:
    """One repository's lines (``read_lines``) as one JSON document, empty lists included. They come partition by partition and are written as they come."""
    groups = itertools.groupby(lines.toLocalIterator(), lambda r: r.section)
    head = next(groups, None)
    if head is None:
        return
    out.write(next(head[1]).json[:-1])
    now, outer = next(groups, None), ""
    for name in (*sorted(LISTS), *NESTED):
        inside, mapped = NESTED.get(name, ""), name == "fileComponents"
        if inside != outer:
            out.write(("}" if outer else "") + f',"{inside}":{{')
        else:
            out.write(",")
        out.write(f'"{name}":' + ("{" if mapped else "["))
        if now is not None and now[0] == name:
            for i, r in enumerate(now[1]):
                out.write(("," if i else "") + (":".join(json.dumps(v) for v in json.loads(r.json).values()) if mapped else r.json))
            now = next(groups, None)
        out.write("}" if mapped else "]")
        outer = inside
    out.write("}}")


def artifacts(a, source: str = "local", lists: bool = True) -> DataFrame:
    """(repo, json) of all repositories of an analysis, under VERSION, names in camel case. Without ``lists``, only what is no long list.

    One row a repository: for repositories whose artifact is larger than a row may be, take ``artifact_lines``.
    """
    tech = a.technologies
    named = {"frameworks": "framework", "infrastructure": "infrastructure", "databases": "database", "externalSystems": "external", "testing": "testing", "buildTools": "build", "tooling": "tooling"}
    groups = tech.groupBy("repo").agg(*(F.array_sort(F.collect_set(F.when(F.col("category") == c, F.col("tech")))).alias(f"fp_{n}") for n, c in named.items()))
    shares = derive.language_shares(a.records).groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "share")))).alias("languages"))
    counts = derive.language_counts(a.records).groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "files")))).alias("languageFileCounts"))
    sections = [_section(df, name, order, **fields) for name, (df, order, fields) in _sections(a).items()] if lists else []
    if lists:
        sections.append(a.layers.groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "component")))).alias("fileComponents")))
    sections += [
        technology.stack(tech), groups, shares, counts,
        a.metrics.select("repo", F.struct(F.col("local_dependencies").alias("localDependencies"), F.col("external_dependencies").alias("externalDependencies"), "cycles", "complexity").alias("metrics")),
    ]
    out = a.totals.withColumnRenamed("files", "fileCount")
    for s in sections:
        out = out.join(s, "repo", "left")
        for c, t in s.dtypes:
            if t.startswith("array"):
                out = out.withColumn(c, F.coalesce(c, F.array().cast(t)))
            elif t.startswith("map"):
                out = out.withColumn(c, F.coalesce(c, F.create_map().cast(t)))
    fingerprint = F.struct(F.map_keys("languages").alias("languages"), *(F.col(f"fp_{n}").alias(n) for n in named), "languageFileCounts")
    repository = F.struct(F.col("repo").alias("name"), F.lit(source).alias("source"), "languages", "fileCount", F.col("source_files").alias("sourceFileCount"), F.col("parsed_files").alias("parsedFileCount"), "lines", fingerprint.alias("fingerprint"))
    listed = [c for s in sections for c in s.columns if c in ("technologies", "files", "symbols", "imports", "calls", "routes", "databases", "externalSystems", "entrypoints", "flows", "importantFiles", "onboarding", "metrics", "diagnostics")]
    nested = [F.struct("components", "connections").alias("architecture"), F.struct("fileComponents").alias("metadata")] if lists else []
    whole = F.struct(F.lit(VERSION).alias("schemaVersion"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generatedAt"), repository.alias("repository"), *listed, *nested)
    return out.select("repo", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))
