"""Facts of Python files by lines and patterns, for files that do not parse and for the parser mode 'pattern'.

Files become rows of lines; what reaches over lines (the open class, waiting decorators, the last definition) are windows within a file.
The tables have the columns of ``python_facts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.columns import ends_with_any, name_of, suffix_of
from . import python_facts

# Forms of lines, and words that look like calls.
FROM = r"^from\s+([a-zA-Z0-9_.]+)\s+import\s+(.+)"
IMPORT = r"^import\s+([a-zA-Z0-9_., ]+)"
CLASS = r"^class\s+([a-zA-Z0-9_]+)(?:\s*\((.*?)\))?\s*:"
DEF = r"^(?:async\s+)?def\s+([a-zA-Z0-9_]+)\s*\("
DECORATOR = r"^@([a-zA-Z0-9_.]+)(?:\((.*)\))?"
ROUTER = r"\b([a-zA-Z_$][\w$]*)\s*=\s*(?:APIRouter|Blueprint)\s*\(([\s\S]*?)\)"
CALL = r"\b([a-zA-Z0-9_]+(?:\.[a-zA-Z0-9_]+)*)\s*\("
NO_CALL = ["if", "for", "while", "def", "class", "return", "with", "try", "except"]

_FILE = ["repo", "file"]


def lines(files: DataFrame) -> DataFrame:
    """(repo, file, line, text, kind, name, args, class, n_lines, prefixes) of lines that are not blank or comments; kind is class, def, decorator or null."""
    py = files.where(suffix_of(F.col("path")).isin(fixed.PY_SUFFIXES)).withColumn("all", F.split("content", "\r?\n"))
    prefix = lambda a: F.regexp_extract(a, r"""(?:prefix|url_prefix)\s*=\s*["']([^"']+)["']""", 1)
    bound = F.zip_with(F.regexp_extract_all("content", F.lit(ROUTER), F.lit(1)), F.regexp_extract_all("content", F.lit(ROUTER), F.lit(2)), lambda n, a: F.named_struct(F.lit("name"), n, F.lit("prefix"), prefix(a)))
    x = py.select("repo", F.col("path").alias("file"), F.size("all").alias("n_lines"), bound.alias("prefixes"), F.posexplode("all").alias("at", "raw")).withColumn("text", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")))
    x = x.where((F.col("text") != "") & ~F.col("text").startswith("#")).withColumn("line", F.col("at") + 1)
    is_class, is_def, is_decorator = (F.col("text").rlike(p) for p in (CLASS, DEF, "^@"))
    x = x.withColumn("kind", F.when(is_decorator, "decorator").when(is_class, "class").when(is_def, "def"))
    part = lambda g: F.coalesce(*(F.nullif(F.regexp_extract("text", p, g), F.lit("")) for p in ([DECORATOR, CLASS, DEF] if g == 1 else [DECORATOR, CLASS])))
    x = x.withColumn("name", F.when(F.col("kind").isNotNull(), part(1))).withColumn("args", F.when(F.col("kind").isin("decorator", "class"), F.coalesce(part(2), F.lit(""))))
    # A line without indentation ends the open class, a class line opens one.
    event = F.when(F.col("kind") == "class", F.struct(F.col("name").alias("name"))).when(~F.col("raw").rlike(r"^\s") & F.coalesce(F.col("kind") != "decorator", F.lit(True)), F.struct(F.lit(None).cast("string").alias("name")))
    before = W.partitionBy(*_FILE).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    return x.withColumn("class", F.last(event, ignorenulls=True).over(before)["name"]).drop("raw", "at")


def _id() -> Column:
    inside = F.when((F.col("kind") == "def") & F.col("class").isNotNull(), F.concat("class", F.lit("::"), "name")).otherwise(F.col("name"))
    return F.concat("file", F.lit("::"), inside)


def symbols(x: DataFrame) -> DataFrame:
    """Modules (of files with any line), classes, models, functions and methods."""
    none = F.array().cast("array<string>")
    module = x.groupBy(*_FILE).agg(F.max("n_lines").alias("end_line"))
    module = module.select(*_FILE, F.lit(0).alias("ord"), F.col("file").alias("id"), F.lit("module").alias("type"), name_of(F.col("file")).alias("name"), F.lit(1).alias("line"), "end_line", F.lit(None).cast("string").alias("parent"), none.alias("evidence"), F.lit(False).alias("exported"))
    bases = F.transform(F.split("args", ","), lambda b: F.trim(b))
    some = lambda f: F.exists(bases, f)
    why = (
        F.when(some(lambda b: b.contains("models.Model")), "inherits from Django Model").when(some(lambda b: b == "SQLModel"), "inherits from SQLModel")
        .when(some(lambda b: b.endswith("Document")), "inherits from Beanie/Mongo Document").otherwise("inherits from an ORM model base")
    )
    model = (F.col("kind") == "class") & some(lambda b: ends_with_any(b, ["Base", "Model", "Document"]) | b.contains("models.Model"))
    kind = F.when(model, "database_model").when(F.col("kind") == "class", "class").when(F.col("class").isNotNull(), "method").otherwise("function")
    parent = F.when((F.col("kind") == "def") & F.col("class").isNotNull(), F.concat("file", F.lit("::"), "class"))
    d = x.where(F.col("kind").isin("class", "def"))
    return module.unionByName(d.select(*_FILE, F.col("line").alias("ord"), _id().alias("id"), kind.alias("type"), "name", "line", F.lit(None).cast("int").alias("end_line"), parent.alias("parent"), F.when(model, F.array(why)).otherwise(none).alias("evidence"), F.lit(True).alias("exported")))


def _ord() -> Column:
    """Line and place in it; ties are not possible within 2**20 places, and a file of the permitted size has no more."""
    return F.shiftleft(F.col("line").cast("long"), 20) + F.col("at")


def imports(x: DataFrame) -> DataFrame:
    text = F.col("text")
    bare = lambda n: F.element_at(F.split(F.trim(n), r"\s+as\s+"), 1)
    names = F.filter(F.transform(F.split(F.regexp_extract(text, FROM, 2), ","), bare), lambda n: n != "")
    a = x.where(text.rlike(FROM)).select(*_FILE, "line", F.lit(0).alias("at"), F.regexp_extract(text, FROM, 1).alias("module"), names.alias("names"))
    b = x.where(~text.rlike(FROM) & text.rlike(IMPORT)).select(*_FILE, "line", F.posexplode(F.transform(F.split(F.regexp_extract(text, IMPORT, 1), ","), bare)).alias("at", "module")).where("module <> ''")
    out = a.unionByName(b.withColumn("names", F.array("module")))
    return out.select(*_FILE, _ord().alias("ord"), F.concat("file", F.lit(":import:"), "line", F.lit(":"), "module").alias("id"), "module", "names", "line")


def calls(x: DataFrame) -> DataFrame:
    """Calls on lines that define nothing; their source is the last definition above, else the module."""
    last = F.last(F.when(F.col("kind").isin("class", "def"), _id()), ignorenulls=True).over(W.partitionBy(*_FILE).orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    c = x.withColumn("source", F.coalesce(last, F.col("file"))).where("kind IS NULL").select(*_FILE, "line", "source", F.posexplode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("at", "callee")).where(~F.col("callee").isin(NO_CALL))
    return c.select(*_FILE, _ord().alias("ord"), F.concat("source", F.lit(":call:"), "line", F.lit(":"), "callee").alias("id"), "source", "callee", "line")


def routes(x: DataFrame) -> DataFrame:
    """Routes of decorators that wait for the next definition; a class takes them without a route."""
    after = W.partitionBy(*_FILE).orderBy("line").rowsBetween(1, W.unboundedFollowing)
    definition = F.when(F.col("kind").isin("class", "def"), F.struct("kind", F.col("line").alias("line"), _id().alias("id")))
    d = x.withColumn("next", F.first(definition, ignorenulls=True).over(after)).where("kind = 'decorator' AND next.kind = 'def'")
    verb, owner = F.lower(F.substring_index("name", ".", -1)), F.substring_index("name", ".", 1)
    listed = F.array_join(F.filter(F.transform(F.split(F.regexp_extract("args", r"methods\s*=\s*\[(.*?)\]", 1), ","), lambda m: F.upper(F.regexp_replace(m, r"['\"\s]", ""))), lambda m: m != ""), ",")
    method = F.when(verb == "route", F.when(listed == "", "GET").otherwise(listed)).when(verb.isin(fixed.HTTP_VERBS), F.upper(verb))
    raw = F.regexp_extract("args", r"""["']([^"']+)["']""", 1)
    sub = F.regexp_replace(raw, "^/+", "")
    prefix = F.coalesce(F.try_element_at(F.filter("prefixes", lambda p: (p["name"] == owner) & (p["prefix"] != "")), F.lit(-1))["prefix"], F.lit(""))
    clean = F.concat(F.lit("/"), F.regexp_replace(prefix, "^/+|/+$", ""))
    path = F.when(prefix == "", F.concat(F.lit("/"), sub)).when(sub == "", clean).otherwise(F.concat(clean, F.lit("/"), sub))
    out = d.select(*_FILE, F.col("line").alias("ord"), method.alias("method"), path.alias("path"), F.col("next.id").alias("handler"), F.col("next.line").alias("line"), F.when(verb == "route", "Flask").otherwise("FastAPI").alias("framework"), F.lit(fixed.ROUTE_CONFIDENCE["decorator"]).alias("confidence"), raw.alias("raw"))
    return out.where("method IS NOT NULL AND raw <> ''").drop("raw").withColumn("id", F.concat_ws(":", F.lit("route"), "file", "line", "method", "path"))


def tags(x: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, file, category, tech) of the facts that patterns find, and of connection strings in any Python file; distinct."""
    roots = imports(x).select(*_FILE, F.substring_index("module", ".", 1).alias("root"))
    python = files.where(suffix_of(F.col("path")).isin(fixed.PY_SUFFIXES))
    return python_facts.tags_of(roots, calls(x).select(*_FILE, "callee"), symbols(x), routes(x), python)


def entry_evidence(x: DataFrame) -> DataFrame:
    """(repo, file, ord, reason): applications that are created, and the first main guard of a file; lines that define something count for neither."""
    made = calls(x).select(*_FILE, "ord", python_facts.created(F.col("callee")).alias("reason")).where("reason IS NOT NULL")
    bare = F.translate(F.regexp_replace("text", r"\s", ""), "\"", "'")
    guards = x.where(F.col("kind").isNull() & bare.contains("__name__=='__main__'")).groupBy(*_FILE).agg(F.min("line").alias("line"))
    last = (F.shiftleft(F.col("line").cast("long") + 1, 20) - 1).alias("ord")  # after the calls of its line
    return made.unionByName(guards.select(*_FILE, last, F.lit(python_facts.GUARD).alias("reason")))
