"""Facts of JavaScript and TypeScript files, by patterns (see ``functions.columns.find_all``).

Only the arguments of ``x.use(...)`` are not a regular language; ``mount_calls`` splits them in Python, file by file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.columns import ends_with_any, find_all, fixed_table, matches, name_of, suffix_of

KEYS = ["repo", "file"]


def scripts(files: DataFrame) -> DataFrame:
    return files.where(suffix_of(F.col("path")).isin(fixed.JS_SUFFIXES)).select("repo", F.col("path").alias("file"), "content")


def _exported(before: str = "before") -> Column:
    return F.col(before).rlike(fixed.JS_EXPORT)


def imports(js: DataFrame) -> DataFrame:
    """Imports with the names they bind: those of the import list, or of the assignment left of a require()."""
    m = matches(js, "content", fixed.JS_IMPORT, 2, KEYS, left=True)
    bare = F.regexp_replace(F.regexp_replace("g1", r"//.*|/\*[\s\S]*?\*/", " "), r"\b(?:type|as|default)\b", " ")
    listed = F.filter(F.regexp_extract_all(bare, F.lit(f"({fixed.NAME})"), F.lit(1)), lambda x: ~x.isin("from", "import"))
    direct = F.regexp_extract("before", rf"\b(?:const|let|var)\s+({fixed.NAME})\s*=\s*$", 1)
    taken = F.regexp_extract("before", r"\b(?:const|let|var)\s*\{([^}]+)\}\s*=\s*$", 1)
    parts = F.transform(F.split(taken, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^.*:\s*", "")))
    names = F.when(F.col("g1") != "", listed).when(direct != "", F.array(direct)).when(taken != "", F.filter(parts, lambda x: x.rlike(f"^{fixed.NAME}$"))).otherwise(F.array().cast("array<string>"))
    return m.select(*KEYS, "ord", F.concat("file", F.lit(":import:"), "line", F.lit(":"), "g2").alias("id"), F.col("g2").alias("module"), names.alias("names"), "line")


def symbols(js: DataFrame) -> DataFrame:
    """Module symbols, classes, interfaces, types, then functions and components; ord follows that order."""
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    none = F.array().cast("array<string>")
    out = js.select(*KEYS, F.lit(-1).alias("ord"), F.col("file").alias("id"), F.lit("module").alias("type"), name_of(F.col("file")).alias("name"), F.lit(1).alias("line"), lines.cast("int").alias("end_line"), F.lit(None).cast("string").alias("parent"), none.alias("evidence"), F.lit(False).alias("exported"))
    kinds = F.array(*map(F.lit, ("class", "interface", "type", "function")))
    m = find_all(js, "content", [fixed.JS_CLASS, fixed.JS_INTERFACE, fixed.JS_TYPE, fixed.JS_FUNCTION], KEYS, left=True)
    name = F.coalesce(F.nullif(F.col("groups")[0], F.lit("")), F.get("groups", 1))
    component = (F.col("kind") == 3) & ends_with_any(F.col("file"), [".jsx", ".tsx"]) & F.substring(name, 1, 1).rlike("^[A-Z]$")
    part = F.when(component, "component").otherwise(F.get(kinds, F.col("kind")))
    why = F.when(component, F.array(F.lit("capitalized JSX/TSX function"))).otherwise(none)
    out = out.unionByName(m.select(*KEYS, (F.col("ord") + F.col("kind") * 10**6).alias("ord"), F.concat("file", F.lit("::"), name).alias("id"), part.alias("type"), name.alias("name"), "line", F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("parent"), why.alias("evidence"), _exported().alias("exported")))
    return out


def _receivers(content: str = "content") -> Column:
    return F.concat(F.array(F.lit("app"), F.lit("router")), F.regexp_extract_all(content, F.lit(fixed.JS_RECEIVER), F.lit(1)))


def _route(columns: DataFrame, framework: str, confidence: float) -> DataFrame:
    return columns.select(*KEYS, "ord", "method", "path", "handler", "line", F.lit(framework).alias("framework"), F.lit(confidence).alias("confidence"), F.concat_ws(":", F.lit("route"), "file", "line", "method", "path").alias("id"))


def express_routes(js: DataFrame, syms: DataFrame) -> DataFrame:
    """Routes of known receivers. The handler is the first symbol of its name by line; else it is named by file, or by line if anonymous."""
    m = matches(js.select(*KEYS, "content", _receivers().alias("receivers")), "content", fixed.JS_ROUTE, 4, KEYS)
    known = js.select(*KEYS, _receivers().alias("receivers"))
    r = m.join(known, KEYS).where(F.array_contains("receivers", F.col("g1")))
    r = r.select(*KEYS, "ord", "line", F.upper("g2").alias("method"), F.col("g3").alias("path"), F.when(F.col("g4") != "", F.col("g4")).otherwise(F.concat(F.lit("anonymous@"), "line")).alias("name"))
    first = syms.where("type <> 'module'").groupBy(*KEYS, "name").agg(F.min_by("id", F.struct("line", "ord")).alias("symbol"))
    r = r.join(first, [*KEYS, "name"], "left").withColumn("handler", F.coalesce("symbol", F.concat("file", F.lit("::"), "name")))
    return _route(r, "Express", fixed.ROUTE_CONFIDENCE["Express"])


def _slashed(x: Column) -> Column:
    inner = F.regexp_replace(x, "^/+|/+$", "")
    return F.when(inner == "", "").otherwise(F.concat(F.lit("/"), inner))


def nest_routes(js: DataFrame) -> DataFrame:
    """Verb decorators of files with a controller, below the first controller's prefix."""
    c = js.where(F.col("content").rlike(fixed.NEST_CONTROLLER))
    prefix = c.select(*KEYS, _slashed(F.regexp_extract("content", fixed.NEST_CONTROLLER, 1)).alias("prefix"))
    m = matches(c, "content", fixed.NEST_ROUTE, 3, KEYS).join(prefix, KEYS)
    path = F.concat("prefix", _slashed(F.col("g2")))
    r = m.select(*KEYS, "ord", "line", F.upper("g1").alias("method"), F.when(path == "", "/").otherwise(path).alias("path"), F.concat("file", F.lit("::"), "g3").alias("handler"))
    return _route(r, "NestJS", fixed.ROUTE_CONFIDENCE["NestJS"])


def next_routes(js: DataFrame, syms: DataFrame) -> DataFrame:
    """Routes by file place: exported verbs of route files below an app directory (groups in parentheses left out), and pages/api files."""
    parts = F.split("file", "/")
    app = F.array_position(parts, "app")
    inside = js.where(name_of(F.col("file")).isin(fixed.NEXT_ROUTE_NAMES) & F.array_contains(F.slice(parts, F.lit(1), F.size(parts) - 1), "app"))
    m = matches(inside, "content", fixed.NEXT_ROUTE, 1, KEYS)
    first = m.groupBy(*KEYS, "g1").agg(F.min("line").alias("first"))  # a repeated verb stands at its first line
    kept = F.filter(F.slice(parts, app.cast("int") + 1, F.greatest(F.lit(0), F.size(parts) - app.cast("int") - 1)), lambda x: ~(x.startswith("(") & x.endswith(")")))
    r = m.join(first, [*KEYS, "g1"]).select(*KEYS, "ord", F.col("first").alias("line"), F.col("g1").alias("method"), F.concat(F.lit("/"), F.array_join(kept, "/")).alias("path"), F.concat("file", F.lit("::"), "g1").alias("handler"))
    app_routes = _route(r, "Next.js", fixed.ROUTE_CONFIDENCE["Next.js app"])
    api = F.array_position(parts, "api")
    pages = js.where(F.array_contains(parts, "pages") & F.array_contains(parts, "api")).select(*KEYS)
    tail = F.slice(parts, api.cast("int") + 1, F.greatest(F.lit(0), F.size(parts) - api.cast("int")))
    tail = F.transform(tail, lambda x, i: F.when(i == F.size(tail) - 1, F.regexp_replace(x, r"(.)\.[^.]+$", "$1")).otherwise(x))
    path = F.regexp_replace(F.concat(F.lit("/api/"), F.array_join(F.filter(tail, lambda x: x != "index"), "/")), "/+$", "")
    exported = syms.where("exported AND type <> 'module'").groupBy(*KEYS).agg(F.min_by("id", F.struct("line", "ord")).alias("symbol"))
    p = pages.join(exported, KEYS, "left").select(*KEYS, F.lit(0).alias("ord"), F.lit(1).alias("line"), F.lit("ANY").alias("method"), path.alias("path"), F.coalesce("symbol", F.concat("file", F.lit("::default"))).alias("handler"))
    return app_routes.unionByName(_route(p, "Next.js", fixed.ROUTE_CONFIDENCE["Next.js pages"]))


def calls(js: DataFrame, syms: DataFrame) -> DataFrame:
    """Calls with their owner: the last symbol that starts on the call's line or above (a backward as-of join within the file).

    Symbols and calls are one stream ordered by line, symbols first; the owner is the last symbol seen. Calls above any symbol are left out.
    """
    m = matches(js, "content", fixed.JS_CALL, 1, KEYS).where(~F.col("g1").isin(fixed.JS_NO_CALL))
    none = F.lit(None).cast("string")
    stream = syms.where("type <> 'module'").select(*KEYS, "line", F.lit(0).alias("late"), "ord", F.col("id").alias("symbol"), none.alias("callee")).unionByName(m.select(*KEYS, "line", F.lit(1).alias("late"), "ord", none.alias("symbol"), F.col("g1").alias("callee")))
    w = W.partitionBy(*KEYS).orderBy("line", "late", "ord").rowsBetween(W.unboundedPreceding, 0)
    c = stream.withColumn("source", F.last("symbol", ignorenulls=True).over(w)).where("callee IS NOT NULL AND source IS NOT NULL")
    return c.select(*KEYS, "ord", F.concat_ws(":", "source", F.lit("call"), "line", "callee").alias("id"), "source", "callee", "line")


_TOKEN = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|[\"'`]|/\*|[(){}\[\],]", re.S)
_USE = re.compile(fixed.JS_MOUNT)
_OPEN, _CLOSE = {"(": 0, "{": 1, "[": 2}, {")": 0, "}": 1, "]": 2}


def split_arguments(source: str, opening: int) -> list[str] | None:
    """Arguments of the call whose '(' stands at ``opening``; None if it never closes or a string does not end."""
    depth, out, begin = [1, 0, 0], [], opening + 1
    for t in _TOKEN.finditer(source, opening + 1):
        x = t[0]
        if x in ("'", '"', "`", "/*"):
            return None
        if x in _OPEN:
            depth[_OPEN[x]] += 1
        elif x in _CLOSE:
            depth[_CLOSE[x]] -= 1
            if x == ")" and not depth[0]:
                last = source[begin : t.start()].strip()
                return [*out, last] if last or out else []
        elif x == "," and depth == [1, 0, 0]:
            out.append(source[begin : t.start()].strip())
            begin = t.end()
    return None


def _mount_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for repo, file, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            rows += [(repo, file, i, source.count("\n", 0, m.start()) + 1, m[1], split_arguments(source, m.end() - 1)) for i, m in enumerate(_USE.finditer(source or ""))]
        if rows:
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["repo", "file", "ord", "line", "receiver", "args"])


def _static(x: Column) -> Column:
    """The value of a quoted literal without interpolation, else null."""
    quoted = x.rlike(r"""^(?:"[\s\S]*"|'[\s\S]*'|`[\s\S]*`)$""") & (F.length(x) >= 2) & ~(x.startswith("`") & x.contains("${"))
    return F.when(quoted, F.regexp_replace(F.expr("substring({0}, 2, length({0}) - 2)".format("__a")), r"""\\([\\'"`])""", "$1"))


def mounts(js: DataFrame) -> DataFrame:
    """Router mounts ``receiver.use([prefix,] target)`` of known receivers: prefix '/' for one argument, null if it is not static."""
    rows = js.select(*KEYS, "content").mapInArrow(_mount_rows, "repo string, file string, ord int, line int, receiver string, args array<string>")
    known = js.select(*KEYS, _receivers().alias("receivers"))
    m = rows.join(known, KEYS).where(F.array_contains("receivers", F.col("receiver")) & (F.size("args") > 0)).withColumn("__a", F.trim(F.col("args")[0])).withColumn("fixed", _static(F.col("__a")))
    target = F.trim(F.element_at("args", -1))
    many = F.size("args") > 1
    m = m.select(
        *KEYS, "line", "receiver", "ord",
        F.when(F.col("fixed").isNotNull(), F.col("fixed")).when(~many, "/").alias("prefix"),
        F.when(F.col("fixed").isNotNull() | many, F.col("__a")).alias("prefix_expression"),
        F.when(target.rlike(f"^{fixed.NAME}$"), target).alias("target_identifier"),
        F.nullif(F.regexp_extract(target, r"""^require\s*\(\s*["']([^"']+)["']\s*\)$""", 1), F.lit("")).alias("target_module"),
        target.alias("target_expression"),
    )
    n = F.row_number().over(W.partitionBy(*KEYS).orderBy("ord")) - 1
    dynamic = F.col("prefix").isNull() | (F.col("target_identifier").isNull() & F.col("target_module").isNull())
    return m.withColumn("id", F.concat(F.lit("express-mount:"), "file", F.lit(":"), "line", F.lit(":"), n)).withColumn("dynamic", dynamic)


def tags(js: DataFrame, imps: DataFrame, routes: DataFrame) -> DataFrame:
    """(repo, file, category, tech) from import roots, routes and helpers; distinct. A root counts by itself or by its scope."""
    spark = js.sparkSession
    dim = fixed_table(spark, [(r, c, t) for c, xs in fixed.SCRIPT_ROOTS.items() for r, t in xs.items()], "root string, category string, tech string")
    parts = F.split("module", "/")
    roots = F.when(F.col("module").startswith("@") & (F.size(parts) > 1), F.array(parts[0], F.concat_ws("/", parts[0], parts[1]))).otherwise(F.array(parts[0]))
    imported = imps.select(*KEYS, F.explode(roots).alias("root")).join(F.broadcast(dim), "root").select(*KEYS, "category", "tech")
    by_route = routes.select(*KEYS, F.lit("framework").alias("category"), F.col("framework").alias("tech"))
    c = F.col("content")
    pair = lambda a, b: F.struct(F.lit(a).alias("category"), F.lit(b).alias("tech"))
    supabase = c.contains("createClient(") & F.lower(c).contains("supabase")
    found = F.array_compact(F.array(F.when(c.contains("createApp("), pair("framework", "Vue")).when(c.contains("createRoot(") | c.contains("ReactDOM.render("), pair("framework", "React")), F.when(supabase, pair("external", "Supabase")), F.when(supabase, pair("database", "Supabase")), F.when(c.rlike(fixed.NEST_CONTROLLER), pair("framework", "NestJS"))))
    return imported.unionByName(by_route).unionByName(js.select(*KEYS, F.inline(found))).distinct()


def entry_evidence(js: DataFrame) -> DataFrame:
    """(repo, file, ord, reason): conventional names, listeners, and client applications that are mounted."""
    name, c = name_of(F.col("file")), F.col("content")
    reasons = F.array(
        F.when(name.isin(fixed.JS_ENTRY_NAMES), F.concat(F.lit("uses a conventional "), name, F.lit(" entrypoint filename"))),
        F.when(c.rlike(r"\b(?:app|server)\.listen\s*\("), F.lit("starts an HTTP listener")),
        F.when(c.contains("createRoot(") | c.contains("ReactDOM.render(") | c.contains("createApp("), F.lit("mounts a client application")),
    )
    return js.select(*KEYS, F.posexplode(reasons).alias("ord", "reason")).where("reason IS NOT NULL")
