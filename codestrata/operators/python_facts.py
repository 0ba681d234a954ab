"""Facts of Python files: one pass over the syntax tree per file gives raw facts; what they mean is decided by Spark expressions.

``syntax`` is the only Python code: it emits imports, definitions with bases and decorators, calls with literal arguments, and prefixes bound
to router names, numbered in visiting order (each alias of an import has its own number). A file that cannot be parsed gives its error and no facts; no other file is touched by it.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import ends_with_any, fixed_table, matches, name_of, suffix_of
from ..functions.scratch import bound_batches

SYNTAX = """repo string, file string, error string, main_guards int, lines int,
imports array<struct<ord: int, line: int, module: string, root: string, names: array<string>>>,
defs array<struct<ord: int, kind: string, name: string, line: int, end_line: int, parents: array<string>, bases: array<string>,
  decorators: array<struct<name: string, path: string, methods: array<string>>>>>,
calls array<struct<ord: int, owner: string, callee: string, line: int, nargs: int, first: string, second: string>>,
binds array<struct<ord: int, name: string, prefix: string>>"""

_TYPES = {
    "imports": pa.list_(pa.struct([("ord", pa.int32()), ("line", pa.int32()), ("module", pa.string()), ("root", pa.string()), ("names", pa.list_(pa.string()))])),
    "defs": pa.list_(pa.struct([("ord", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("parents", pa.list_(pa.string())), ("bases", pa.list_(pa.string())), ("decorators", pa.list_(pa.struct([("name", pa.string()), ("path", pa.string()), ("methods", pa.list_(pa.string()))])))])),
    "calls": pa.list_(pa.struct([("ord", pa.int32()), ("owner", pa.string()), ("callee", pa.string()), ("line", pa.int32()), ("nargs", pa.int32()), ("first", pa.string()), ("second", pa.string())])),
    "binds": pa.list_(pa.struct([("ord", pa.int32()), ("name", pa.string()), ("prefix", pa.string())])),
}


def dotted(node: ast.AST | None) -> str:
    """'a.b.c' of a chain of names and attributes; calls in the chain stand for what they call, other bases for nothing."""
    parts: list[str] = []
    while True:
        if isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        else:
            return ".".join(reversed([*parts, node.id] if isinstance(node, ast.Name) else parts))


def text_of(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _decorator(node: ast.AST) -> dict | None:
    if not isinstance(node, ast.Call):
        return None
    methods = next((k.value.elts for k in node.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple))), None)
    return {"name": dotted(node.func), "path": text_of(node.args[0]) if node.args else None, "methods": None if methods is None else [t for m in methods if (t := text_of(m))]}


class Text:
    """The texts of nodes, by line and byte; lines are those of the parser."""

    def __init__(self, source: str):
        self.data = re.sub(b"\r\n?", b"\n", source.encode())
        self.starts = [0, *(m.end() for m in re.finditer(b"\n", self.data))]

    def between(self, a: tuple[int, int], b: tuple[int, int]) -> bytes:
        return self.data[self.starts[a[0] - 1] + a[1] : self.starts[b[0] - 1] + b[1]]

    def of_call(self, node: ast.Call) -> dict:
        """receiver: the text before the called attribute's dot; arguments: what stands between the brackets, null if the callee has brackets of its own."""
        f = node.func
        start, end = (f.lineno, f.col_offset), (f.end_lineno, f.end_col_offset)
        before = self.between(start, end).rpartition(b".")[0].rstrip(b" \t\n\f\\") if isinstance(f, ast.Attribute) else None
        inner = re.fullmatch(rb"[\s\\]*\((.*)\)", self.between(end, (node.end_lineno, node.end_col_offset)), re.S)
        return {"receiver": None if before is None else before.decode(), "arguments": None if inner is None else inner[1].decode()}


def facts_of(source: str, texts: bool = False) -> dict:
    """Raw facts of one source text; with ``texts``, calls have receiver, arguments, and the name that they are assigned to."""
    out: dict = {"error": None, "main_guards": 0, "lines": source.count("\n") + 1, "imports": [], "defs": [], "calls": [], "binds": []}
    try:
        tree = ast.parse(source, type_comments=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        out["error"] = f"parse_error:{type(e).__name__}:{getattr(e, 'lineno', 0) or 0}"
        return out
    todo: list[tuple[ast.AST, tuple[str, ...]]] = [(tree, ())]
    n = 0
    text, assigned = Text(source) if texts else None, {}
    while todo:
        node, scope = todo.pop()
        n += 1
        inner = scope
        if isinstance(node, (ast.Assign, ast.AnnAssign)) and isinstance(node.value, ast.Call):
            target = node.targets[-1] if isinstance(node, ast.Assign) else node.target
            assigned[id(node.value)] = target.id if isinstance(target, ast.Name) else None
        if isinstance(node, ast.Import):
            out["imports"] += [{"ord": n + i, "line": node.lineno, "module": a.name, "root": a.name.split(".")[0], "names": [a.asname or a.name]} for i, a in enumerate(node.names)]
            n += len(node.names) - 1
        elif isinstance(node, ast.ImportFrom):
            out["imports"].append({"ord": n, "line": node.lineno, "module": "." * node.level + (node.module or ""), "root": (node.module or "").split(".")[0], "names": [a.name for a in node.names]})
        elif isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            is_class = isinstance(node, ast.ClassDef)
            out["defs"].append({"ord": n, "kind": "class" if is_class else "def", "name": node.name, "line": node.lineno, "end_line": node.end_lineno or node.lineno, "parents": list(scope), "bases": [dotted(b) for b in node.bases] if is_class else [], "decorators": [] if is_class else [d for x in node.decorator_list if (d := _decorator(x))]})
            inner = (*scope, node.name)
        elif isinstance(node, ast.Call):
            if callee := dotted(node.func):
                out["calls"].append({"ord": n, "owner": "::".join(scope) if scope else None, "callee": callee, "line": node.lineno, "nargs": len(node.args), "first": text_of(node.args[0]) if node.args else None, "second": dotted(node.args[1]) if len(node.args) > 1 else None})
                if text:
                    out["calls"][-1] |= {**text.of_call(node), "assigned_to": assigned.get(id(node)), "argument_count": len(node.args) + len(node.keywords)}
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Call):
            if dotted(node.value.func).rsplit(".", 1)[-1] in ("APIRouter", "Blueprint"):
                prefix = next((t for k in node.value.keywords if k.arg in ("prefix", "url_prefix") and (t := text_of(k.value)) is not None), "")
                out["binds"] += [{"ord": n, "name": t.id, "prefix": prefix} for t in node.targets if isinstance(t, ast.Name)]
        elif isinstance(node, ast.If) and isinstance(node.test, ast.Compare):
            out["main_guards"] += ast.unparse(node.test) == "__name__ == '__main__'"
        todo += [(c, inner) for c in reversed(list(ast.iter_child_nodes(node)))]
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [facts_of(x or "") for x in batch.column("content").to_pylist()]
        columns = {"repo": batch.column("repo"), "file": batch.column("path"), "error": pa.array([r["error"] for r in rows], pa.string()), "main_guards": pa.array([r["main_guards"] for r in rows], pa.int32())}
        columns["lines"] = pa.array([r["lines"] for r in rows], pa.int32())
        columns |= {k: pa.array([r[k] for r in rows], t) for k, t in _TYPES.items()}
        yield pa.RecordBatch.from_pydict(columns)


def syntax(files: DataFrame) -> DataFrame:
    """Raw facts of the Python files among (repo, path, content): one nested row a file, no shuffle."""
    bound_batches(files.sparkSession)
    return files.where(suffix_of(F.col("path")).isin(fixed.PY_SUFFIXES)).select("repo", "path", "content").mapInArrow(_run, SYNTAX)


def _joined(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def symbols(facts: DataFrame) -> DataFrame:
    """Module, class, model, function and method symbols. A class is a database model by its bases, the first rule that fits counts."""
    module = facts.where("error IS NULL").select("repo", "file", F.lit(0).alias("ord"), F.col("file").alias("id"), F.lit("module").alias("type"), name_of(F.col("file")).alias("name"), F.lit(1).alias("line"), F.col("lines").alias("end_line"), F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("evidence"))
    d = facts.select("repo", "file", F.explode("defs").alias("d")).select("repo", "file", "d.*")
    b = F.col("bases")
    some = lambda f: F.exists(b, f)
    rule = (
        F.when(~some(lambda x: ends_with_any(x, ["Base", "Model", "SQLModel", "Document"])), None)
        .when(some(lambda x: x.contains("models.Model")), "inherits from Django Model")
        .when(some(lambda x: x.contains("SQLModel")), "inherits from SQLModel")
        .when(some(lambda x: x.endswith("Base")), "inherits from an ORM model base")
        .when(some(lambda x: x.endswith("Document")), "inherits from Beanie/Mongo Document")
        .when(some(lambda x: (x == "Model") | x.endswith(".Model")), "inherits from Model base")
    )
    evidence = F.when((F.col("kind") == "class") & rule.isNotNull(), F.array(rule)).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("kind") == "class", F.when(F.size(evidence) > 0, "database_model").otherwise("class")).when(F.size("parents") > 0, "method").otherwise("function")
    parent = F.when(F.size("parents") > 0, _joined("file", "parents"))
    return module.unionByName(d.select("repo", "file", "ord", _joined("file", "parents", F.array("name")).alias("id"), kind.alias("type"), "name", "line", "end_line", parent.alias("parent"), evidence.alias("evidence"))).withColumn("exported", F.lit(False))


def imports(facts: DataFrame) -> DataFrame:
    i = facts.select("repo", "file", F.explode("imports").alias("i")).select("repo", "file", "i.*")
    return i.select("repo", "file", "ord", F.concat("file", F.lit(":import:"), "line", F.lit(":"), "module").alias("id"), "module", "names", "line")


def calls(facts: DataFrame) -> DataFrame:
    c = facts.select("repo", "file", F.explode("calls").alias("c")).select("repo", "file", "c.*").where("owner IS NOT NULL")
    source = _joined("file", "owner")
    return c.select("repo", "file", "ord", F.concat(source, F.lit(":call:"), "line", F.lit(":"), "callee").alias("id"), source.alias("source"), "callee", "line")


CALL_TEXTS = "repo string, file string, ord int, owner string, callee string, receiver string, arguments string, assigned_to string, argument_count int, line int"
_CALL_COLUMNS = CALL_TEXTS.replace(" string", "").replace(" int", "").split(", ")
#: Rows in a batch of calls; a text may be in several of them.
CALLS_A_BATCH = 500


def _call_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.int32() if c in ("ord", "argument_count", "line") else pa.string()) for c in _CALL_COLUMNS])
    for batch in batches:
        for repo, path, content in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "content")), strict=True):
            found = [x | {"repo": repo, "file": path} for x in facts_of(content or "", texts=True)["calls"]]
            for at in range(0, len(found), CALLS_A_BATCH):
                yield pa.RecordBatch.from_pylist([{c: x[c] for c in _CALL_COLUMNS} for x in found[at : at + CALLS_A_BATCH]], schema)


def call_texts(files: DataFrame) -> DataFrame:
    """All calls of the Python files with what was written: (repo, file, ord, source, callee, receiver, arguments, assigned_to, argument_count, line).

    The source is the definition around the call, else the file. A call is assigned to a name if it is all of the right side, and the name the last
    or only target. Texts are those of the file, with line breaks as ``\\n``. Files that cannot be parsed, empty or null give no rows. No shuffle.
    """
    bound_batches(files.sparkSession)
    c = files.where(suffix_of(F.col("path")).isin(fixed.PY_SUFFIXES)).select("repo", "path", "content").mapInArrow(_call_rows, CALL_TEXTS)
    return c.select("repo", "file", "ord", _joined("file", "owner").alias("source"), "callee", "receiver", "arguments", "assigned_to", "argument_count", "line")


def _slashed(x: Column) -> Column:
    """'/' and the text without outer slashes; '' if nothing is left."""
    inner = F.regexp_replace(x, "^/+|/+$", "")
    return F.when(inner == "", "").otherwise(F.concat(F.lit("/"), inner))


def routes(facts: DataFrame) -> DataFrame:
    """Routes of decorators (verbs, and route(methods=...)), and of path() and re_path() calls."""
    d = facts.select("repo", "file", "binds", F.explode("defs").alias("d")).select("repo", "file", "binds", "d.*").where("kind = 'def'")
    r = d.select("repo", "file", "binds", "ord", "line", _joined("file", "parents", F.array("name")).alias("handler"), F.posexplode("decorators").alias("at", "x")).select("*", "x.name", "x.path", "x.methods").where("path IS NOT NULL")
    verb = F.lower(F.substring_index("name", ".", -1))
    listed = F.array_join("methods", ",")
    method = F.when(verb == "route", F.when(F.coalesce(listed, F.lit("")) == "", "GET").otherwise(listed)).when(verb.isin(fixed.HTTP_VERBS), verb)
    owner = F.when(F.instr("name", ".") > 0, F.substring_index("name", ".", 1)).otherwise("")
    bound = F.filter("binds", lambda b: (b["name"] == owner) & (b["ord"] < F.col("ord")))
    prefix = F.coalesce(F.try_element_at(bound, F.lit(-1))["prefix"], F.lit(""))
    full = F.when(prefix != "", F.concat(F.when(_slashed(prefix) == "", "/").otherwise(_slashed(prefix)), _slashed(F.col("path")))).when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path"))
    framework = F.when(verb == "route", "Flask").otherwise("FastAPI")
    decorated = r.select("repo", "file", (F.col("ord") * 100 + F.least(F.lit(99), F.col("at"))).alias("ord"), F.upper(method).alias("method"), full.alias("path"), "handler", "line", framework.alias("framework"), F.lit(fixed.ROUTE_CONFIDENCE["decorator"]).alias("confidence")).where("method IS NOT NULL")
    c = facts.select("repo", "file", F.explode("calls").alias("c")).select("repo", "file", "c.*")
    named = c.where(F.substring_index("callee", ".", -1).isin("path", "re_path") & F.col("first").isNotNull() & ~ends_with_any(F.col("callee"), ["FastAPI", "Flask", "create_engine", "sessionmaker"]))
    handler = F.concat("file", F.lit("::"), F.when(F.col("nargs") > 1, F.coalesce("second", F.lit(""))).otherwise("unknown"))
    called = named.select("repo", "file", (F.col("ord") * 100).alias("ord"), F.lit("ANY").alias("method"), F.concat(F.lit("/"), F.regexp_replace("first", "^/+", "")).alias("path"), handler.alias("handler"), "line", F.lit("Django").alias("framework"), F.lit(fixed.ROUTE_CONFIDENCE["Django"]).alias("confidence"))
    return decorated.unionByName(called).withColumn("id", F.concat_ws(":", F.lit("route"), "file", "line", "method", "path"))


def tags(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, file, category, tech) from imports, calls, bases, routes and connection strings; distinct."""
    roots = facts.select("repo", "file", F.explode("imports.root").alias("root"))
    callees = facts.select("repo", "file", F.explode("calls.callee").alias("callee"))
    parsed = files.join(facts.where("error IS NULL").select("repo", F.col("file").alias("path")), ["repo", "path"], "left_semi")
    return tags_of(roots, callees, symbols(facts), routes(facts), parsed)


def tags_of(named: DataFrame, callees: DataFrame, symbols: DataFrame, routes: DataFrame, files: DataFrame) -> DataFrame:
    """Tags from roots of imports (repo, file, root), calls (repo, file, callee), evidence of symbols, frameworks of routes, and the files' contents."""
    spark = named.sparkSession
    roots = fixed_table(spark, [(r, c, t) for r, xs in fixed.PYTHON_ROOTS.items() for c, t in xs], "root string, category string, tech string")
    imported = named.join(F.broadcast(roots), "root").select("repo", "file", "category", "tech")
    c = F.col("callee")
    sql = F.array(F.struct(F.lit("framework"), F.lit("SQLAlchemy")), F.struct(F.lit("database"), F.lit("SQL database")))
    called = F.when(c.endswith("FastAPI"), F.array(F.struct(F.lit("framework"), F.lit("FastAPI")))).when(c.endswith("Flask"), F.array(F.struct(F.lit("framework"), F.lit("Flask")))).when(ends_with_any(c, ["create_engine", "sessionmaker"]), sql)
    by_call = callees.select("repo", "file", F.inline(called.cast("array<struct<category: string, tech: string>>")))
    models = fixed_table(spark, [("inherits from Django Model", "framework", "Django"), ("inherits from Django Model", "database", "Django ORM"), ("inherits from SQLModel", "framework", "SQLModel"), ("inherits from SQLModel", "database", "SQL database"), ("inherits from an ORM model base", "framework", "SQLAlchemy"), ("inherits from an ORM model base", "database", "SQL database"), ("inherits from Beanie/Mongo Document", "database", "MongoDB"), ("inherits from Model base", "database", "SQL database")], "rule string, category string, tech string")
    by_model = symbols.select("repo", "file", F.explode("evidence").alias("rule")).join(F.broadcast(models), "rule").select("repo", "file", "category", "tech")
    by_route = routes.select("repo", "file", F.lit("framework").alias("category"), F.col("framework").alias("tech"))
    low = F.lower("content")
    urls = F.array_compact(F.array(F.when(low.contains("postgresql://") | low.contains("postgres://"), "PostgreSQL"), F.when(low.contains("mongodb://") | low.contains("mongodb+srv://"), "MongoDB")))
    by_url = files.select("repo", F.col("path").alias("file"), F.lit("database").alias("category"), F.explode(urls).alias("tech"))
    return imported.unionByName(by_call).unionByName(by_model).unionByName(by_route).unionByName(by_url).distinct()


# Fixed value: the reason that a main guard gives.
GUARD = "contains a __main__ execution guard"


def created(callee: Column) -> Column:
    """The reason that a call gives to enter at its file, or null."""
    return F.when(callee.endswith("FastAPI"), "creates a FastAPI application").when(callee.endswith("Flask"), "creates a Flask application")


def entry_evidence(facts: DataFrame) -> DataFrame:
    """(repo, file, ord, reason): applications that are created, and main guards."""
    c = facts.select("repo", "file", F.explode("calls").alias("c"))
    guard = facts.where("main_guards > 0").select("repo", "file", F.lit(10**6).alias("ord"), F.lit(GUARD).alias("reason"))
    return c.select("repo", "file", F.col("c.ord").alias("ord"), created(F.col("c.callee")).alias("reason")).where("reason IS NOT NULL").unionByName(guard)


def fallback_symbols(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Definitions found by pattern in files that could not be parsed: (repo, file, ord, name, type, line)."""
    failed = files.join(facts.where("error IS NOT NULL").select("repo", F.col("file").alias("path")), ["repo", "path"], "left_semi")
    m = matches(failed, "content", r"(?m)^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)".replace("(?m)^", r"(?<![^\n])"), 3, ["repo", "path"])
    kind = F.when(F.col("g2") == "class", "class").when(F.col("g1") != "", "method").otherwise("function")
    return m.select("repo", F.col("path").alias("file"), "ord", F.col("g3").alias("name"), kind.alias("type"), "line")


def parse_quality(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo, file, quality, code): complete, partial (facts by pattern only) or failed, with the diagnostic code of the last two."""
    found = fallback_symbols(files, facts).select("repo", "file").distinct().withColumn("some", F.lit(True))
    q = F.when(F.col("error").isNull(), "complete").when(F.col("some"), "partial").otherwise("failed")
    return facts.join(found, ["repo", "file"], "left").select("repo", "file", q.alias("quality"), F.when(q == "partial", "SOURCE_PARSE_PARTIAL").when(q == "failed", "SOURCE_PARSE_FAILED").alias("code"))



