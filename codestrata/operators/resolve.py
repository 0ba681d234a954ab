"""Resolution: imports to files, calls to symbols, manifest entries to files; all by candidate lists, equi-joins and least ordinals.

Every table is keyed by ``repo``. Ties that the order of a set would decide go to the least name.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.columns import ends_with_any, normal_path, parent_of, suffix_of
from ..functions.scratch import bound_batches, cut, kept, small


def package_roots(files: DataFrame) -> DataFrame:
    """(repo, roots): directories that packages lie in, deepest first, then by name."""
    p = F.split("path", "/")
    init = (F.element_at(p, -1) == "__init__.py") & (F.size(p) > 1)
    holder = p[0].isin("src", "lib", "packages")
    found = F.array_compact(F.array(F.when(init, p[0]), F.when(init & (F.size(p) > 2) & holder, F.concat_ws("/", p[0], p[1])), F.when(~init & p[0].isin("src", "lib"), p[0])))
    roots = files.select("repo", F.explode(found).alias("root"))
    order = F.struct(-F.size(F.split("root", "/")), "root")
    return roots.distinct().groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "root"))), lambda x: x["root"]).alias("roots"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once: an expression that stands in several places of functions over arrays is computed in each of them."""
    return F.transform(F.array(value), use)[0]


def _python_at(stem: Column, names: Column) -> Column:
    """Candidates of a module path: the module, its package, its stub, then each imported name below it."""
    own = lambda s: F.array(F.concat(s, F.lit(".py")), F.concat(s, F.lit("/__init__.py")), F.concat(s, F.lit(".pyi")))
    name = lambda p: F.array(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")))
    below = lambda s: F.flatten(F.transform(names, lambda n: _bound(normal_path(F.concat_ws("/", s, n)), name)))
    return _bound(stem, lambda s: F.concat(own(s), below(s)))


def python_candidates(module: Column, names: Column, source: Column, roots: Column) -> Column:
    """Paths to try in order. Leading dots climb from the file's directory; others start at the top, then at each root."""
    dots = F.length(F.regexp_extract(module, r"^\.*", 0))
    rest = F.array_join(F.filter(F.split(F.regexp_replace(module, r"^\.+", ""), r"\."), lambda x: x != ""), "/")
    up = F.split(parent_of(source), "/")
    base = F.array_join(F.slice(up, F.lit(1), F.greatest(F.lit(0), F.size(up) - F.greatest(F.lit(0), dots - 1))), "/")
    relative = _python_at(normal_path(F.concat_ws("/", base, rest)), names)
    tops = F.concat(F.array(F.lit("")), F.coalesce(roots, F.array().cast("array<string>")))
    absolute = _bound(rest, lambda x: F.flatten(F.transform(tops, lambda r: _python_at(normal_path(F.concat_ws("/", r, x)), names))))
    return F.when(dots > 0, relative).otherwise(absolute)


def script_candidates_at(path: Column) -> Column:
    ends = [F.lit(""), *map(F.lit, fixed.JS_CANDIDATE_SUFFIXES), *(F.lit("/index" + e) for e in fixed.JS_CANDIDATE_SUFFIXES)]
    return _bound(path, lambda p: F.array(*(F.concat(p, e) for e in ends)))


def script_candidates(module: Column, source: Column, aliases: Column) -> Column:
    """Paths to try in order: relative to the file, or below each alias whose prefix is the module or a part of it. aliases: array<struct<prefix, dest>>."""
    relative = script_candidates_at(normal_path(F.concat_ws("/", parent_of(source), module)))
    hit = F.filter(F.coalesce(aliases, F.array().cast("array<struct<prefix: string, dest: string>>")), lambda a: (a["prefix"] != "") & ((module == a["prefix"]) | module.startswith(F.concat(a["prefix"], F.lit("/")))))
    below = F.flatten(F.transform(hit, lambda a: script_candidates_at(normal_path(F.concat_ws("/", a["dest"], F.substring(module, F.length(a["prefix"]) + 1, F.lit(10**6)))))))
    return F.when(module.startswith("."), relative).otherwise(below)


def first_existing(rows: DataFrame, candidates: Column, files: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with target: the first of its candidate paths that is a file of the repository, or null. ``keys`` tell rows apart."""
    # Of an inner explode, Spark also filters by the array's size, and computes the array once more for each mention.
    tried = rows.select("repo", *keys, F.posexplode_outer(candidates).alias("pos", "path")).where("path IS NOT NULL")
    hit = tried.join(files.select("repo", "path").distinct(), ["repo", "path"]).groupBy("repo", *keys).agg(F.min_by("path", "pos").alias("target"))
    return rows.join(hit, ["repo", *keys], "left")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """Imports (repo, file, ord, module, names, ...) with target and external (nothing found, and not relative).

    ``aliases`` has (repo, aliases) in the order they are tried. One join for both languages: rows bring their own candidates.
    """
    rows = imports.join(package_roots(files), "repo", "left").join(aliases, "repo", "left")
    python = ends_with_any(F.col("file"), fixed.PY_SUFFIXES)
    tried = F.when(python, python_candidates(F.col("module"), F.col("names"), F.col("file"), F.col("roots"))).otherwise(script_candidates(F.col("module"), F.col("file"), F.col("aliases")))
    out = first_existing(rows.drop("target").withColumn("__c", tried), F.col("__c"), files, ["file", "ord"])
    return out.drop("roots", "aliases", "__c").withColumn("external", F.col("target").isNull() & ~F.col("module").startswith("."))


#: Calls, symbols and imports of a repository that are resolved in one task; those of larger ones are joined.
RESOLVE_ROWS = 200_000


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, most: int = RESOLVE_ROWS) -> DataFrame:
    """Calls with target and confidence, by the first tier that holds.

    1. dotted, and the only symbol of that name in an imported file (the least such file); 2. the only one in the same file; 3. the only one
    in the repository, dotted or bare; else open.

    The names that a call may mean through all imports of its file outnumber the calls by far, so they are looked up and not shuffled: calls, symbols and
    imports of a repository of at most ``most`` rows in all meet in one task. Larger ones go by joins (``resolve_by_joins``). Calls, and pairs of
    files, are written once, since they are counted first.
    """
    bound_batches(calls.sparkSession)
    rows = kept(calls.drop("target", "confidence"))
    named = symbols.where("type <> 'module'").select("repo", "file", "name", "id")
    reach = kept(imports.where("target IS NOT NULL").select("repo", "file", F.col("target").alias("to")))
    # Rows without a repository match nothing.
    named, reach = named.where("repo IS NOT NULL"), reach.where("repo IS NOT NULL")
    counts = [df.groupBy("repo").agg(F.count("*").alias("n")) for df in (rows, named, reach)]
    large = cut(counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("repo").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("repo"))
    kind = dict(symbols.dtypes)["id"]
    schema = T.StructType([*rows.schema, T.StructField("target", T._parse_datatype_string(kind)), T.StructField("confidence", T.DoubleType())])
    some = bool(large.limit(1).count())
    few = [df.join(small(large, 64), "repo", "left_anti") if some else df for df in (rows, named, reach)]
    facts = few[1].select("repo", F.lit(None).cast("string").alias("from"), "file", "name", "id").unionByName(few[2].select("repo", F.col("file").alias("from"), F.col("to").alias("file"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(kind).alias("id")))
    out = few[0].select("repo", *(c for c in rows.columns if c != "repo")).groupBy("repo").cogroup(facts.groupBy("repo")).applyInArrow(_resolved, T.StructType([schema["repo"], *(f for f in schema if f.name != "repo")]))
    if not some:
        return out.select(schema.names)
    big = resolve_by_joins(*(df.join(small(large, 64), "repo", "left_semi") for df in (rows, named, reach.distinct())))
    return out.select(schema.names).unionByName(big)


def resolve_calls_to(hit: DataFrame, calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Those of ``resolve_calls`` that may mean a symbol of ``hit`` (a part of ``symbols``): of a name that a symbol with the id of a hit has.

    What a call means depends on the symbols of its name and on the files that have them alone, so all else is left out before the calls are resolved.
    """
    by_id = small(cut(hit.select("repo", "id").distinct()), 64)
    names = small(cut(symbols.join(by_id, ["repo", "id"], "left_semi").select("repo", "name").distinct()), 40)
    few = calls.withColumn("__name", F.substring_index("callee", ".", -1)).join(names.withColumnRenamed("name", "__name"), ["repo", "__name"], "left_semi").drop("__name")
    same = kept(symbols.join(names, ["repo", "name"], "left_semi").select("repo", "file", "name", "type", "id"))
    ends = small(cut(same.select("repo", F.col("file").alias("target")).distinct()), 64)
    return resolve_calls(few, same, imports.join(ends, ["repo", "target"], "left_semi"))


def _resolved(calls: pa.Table, facts: pa.Table) -> pa.Table:
    """One repository's calls with target and confidence; ``facts`` are its symbols (file, name, id) and pairs of files (from, file)."""
    in_file: dict[tuple[str, str], str | None] = {}
    in_repo: dict[str, str | None] = {}
    reach: dict[str, set[str]] = {}
    holders: dict[str, set[str]] = {}
    for begin, file, name, i in zip(*(facts[c].to_pylist() for c in ("from", "file", "name", "id")), strict=True):
        if begin is not None:
            reach.setdefault(begin, set()).add(file)
        elif name is not None:
            in_repo[name] = None if name in in_repo else i
            if file is not None:
                in_file[file, name] = None if (file, name) in in_file else i
                holders.setdefault(name, set()).add(file)
    imported: dict[tuple[str, str], str | None] = {}
    targets, confidence = [], []
    for file, callee in zip(calls["file"].to_pylist(), calls["callee"].to_pylist(), strict=True):
        dotted = callee is not None and "." in callee
        name = callee.rsplit(".", 1)[-1] if dotted else callee
        here = in_file.get((file, name))
        to = None
        if dotted and name in holders:
            if (file, name) not in imported:
                way, held = reach.get(file, ()), holders[name]
                few, many = (way, held) if len(way) < len(held) else (held, way)
                least = min((f for f in few if f in many and in_file[f, name] is not None), default=None)
                imported[file, name] = None if least is None else in_file[least, name]
            to = imported[file, name]
        everywhere = in_repo.get(name)
        tiers = ((to, fixed.CALL_IMPORTED), (here, fixed.CALL_LOCAL), (everywhere, fixed.CALL_DOTTED if dotted else fixed.CALL_BARE), (None, fixed.CALL_OPEN))
        target, sure = next((x for x in tiers if x[0] is not None), tiers[-1])
        targets.append(target)
        confidence.append(sure)
    return calls.append_column("target", pa.array(targets, facts.schema.field("id").type)).append_column("confidence", pa.array(confidence, pa.float64()))


def resolve_by_joins(rows: DataFrame, named: DataFrame, reach: DataFrame) -> DataFrame:
    """The same for calls, symbols other than modules, and distinct pairs of files (repo, file, to), by joins alone. Tables of unique names are
    aggregated first, so joins stay one to one."""
    in_file = named.groupBy("repo", "file", "name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
    in_repo = named.groupBy("repo", "name").agg(F.count("*").alias("n"), F.min("id").alias("everywhere")).where("n = 1").drop("n")
    rows = rows.withColumn("name", F.substring_index("callee", ".", -1)).withColumn("dotted", F.instr("callee", ".") > 0)
    wanted = rows.where("dotted").select("repo", "file", "name").distinct().join(named.select("repo", "name").distinct(), ["repo", "name"], "left_semi")
    far = wanted.join(reach, ["repo", "file"]).join(in_file.withColumnRenamed("file", "to"), ["repo", "to", "name"]).groupBy("repo", "file", "name").agg(F.min_by("id", "to").alias("imported"))
    out = rows.join(far, ["repo", "file", "name"], "left").join(in_file.withColumnRenamed("id", "here"), ["repo", "file", "name"], "left").join(in_repo, ["repo", "name"], "left")
    imported = F.when(F.col("dotted"), F.col("imported"))
    confidence = F.when(imported.isNotNull(), fixed.CALL_IMPORTED).when(F.col("here").isNotNull(), fixed.CALL_LOCAL).when(F.col("everywhere").isNotNull() & F.col("dotted"), fixed.CALL_DOTTED).when(F.col("everywhere").isNotNull(), fixed.CALL_BARE).otherwise(fixed.CALL_OPEN)
    return out.withColumn("target", F.coalesce(imported, "here", "everywhere")).withColumn("confidence", confidence).drop("imported", "here", "everywhere", "name", "dotted")


_PATHS_IN_TEXT = r"([A-Za-z0-9_./-]+\.(?:py|js|mjs|cjs|ts|tsx|jsx))"


def manifest_entries(files: DataFrame) -> DataFrame:
    """(repo, file, ord, reason): files that package.json fields and scripts or a Dockerfile start."""
    name = F.substring_index("path", "/", -1)
    package = "struct<main: string, module: string, scripts: map<string, string>>"
    p = files.where(name == "package.json").select("repo", "path", F.from_json("content", package).alias("p"))
    fields = F.array(*(F.struct(F.col(f"p.{f}").alias("candidate"), F.lit(f"package {f} points here").alias("reason")) for f in ("main", "module")))

    def started(script: str) -> Column:
        found = F.regexp_extract_all(F.col("p.scripts")[script], F.lit(_PATHS_IN_TEXT), F.lit(1))
        return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.struct(x.alias("candidate"), F.lit(f"package {script} script starts this file").alias("reason")))

    scripts = F.flatten(F.array(*map(started, ("start", "dev", "serve"))))
    from_package = p.select("repo", "path", F.posexplode(F.concat(fields, scripts)).alias("ord", "c"))
    docker = files.where(name == "Dockerfile").select("repo", "path", F.posexplode(F.transform(F.regexp_extract_all("content", F.lit(_PATHS_IN_TEXT), F.lit(1)), lambda x: F.struct(x.alias("candidate"), F.lit("Docker CMD or ENTRYPOINT references this file").alias("reason")))).alias("ord", "c"))
    rows = from_package.unionByName(docker).select("repo", F.col("path").alias("manifest"), "ord", "c.candidate", "c.reason").where("candidate IS NOT NULL")
    clean = F.regexp_replace(F.regexp_replace("candidate", "^['\"]+|['\"]+$", ""), r"^(?:\./)+", "")
    joined = F.regexp_replace(F.concat_ws("/", parent_of(F.col("manifest")), clean), "^/+", "")
    bare = suffix_of(joined) == ""
    ends = F.when(bare, F.array(*map(F.lit, ["", ".js", ".ts", ".tsx", ".py", "/index.js", "/index.ts", "/index.tsx"]))).otherwise(F.array(F.lit("")))
    hit = first_existing(rows, F.transform(ends, lambda e: F.concat(joined, e)), files, ["manifest", "ord"]).where("target IS NOT NULL")
    return hit.groupBy("repo", F.col("target").alias("file"), "reason").agg(F.min(F.struct("manifest", "ord")).alias("o")).select("repo", "file", (F.col("o.ord") + 2 * 10**6).alias("ord"), "reason")


def tsconfig_aliases(files: DataFrame) -> DataFrame:
    """(repo, aliases: array<struct<prefix, dest>>) of tsconfig.json, or of jsconfig.json where that has none. Comments and trailing commas are allowed."""
    clean = F.regexp_replace(F.regexp_replace("content", r"//.*?\n|/\*.*?\*/", "\n"), r",\s*([\]}])", "$1")
    schema = "struct<compilerOptions: struct<baseUrl: string, paths: map<string, array<string>>>>"
    c = files.where(F.col("path").isin("tsconfig.json", "jsconfig.json")).select("repo", "path", F.from_json(clean, schema).alias("c")).select("repo", "path", F.regexp_replace(F.coalesce("c.compilerOptions.baseUrl", F.lit(".")), "/+$", "").alias("base"), F.map_entries("c.compilerOptions.paths").alias("paths"))
    cut = lambda x: F.regexp_replace(F.regexp_replace(x, r"\*+$", ""), "/+$", "")
    lead = lambda x: F.regexp_replace(x, "^[./]+", "")

    def one(e: Column) -> Column:
        dest = cut(e["value"][0])
        return F.struct(cut(e["key"]).alias("prefix"), lead(F.when(F.col("base").isin("", "."), dest).otherwise(F.concat_ws("/", "base", dest))).alias("dest"))

    found = c.withColumn("aliases", F.transform(F.filter("paths", lambda e: F.size(e["value"]) > 0), one)).where(F.size("aliases") > 0)
    return found.groupBy("repo").agg(F.max_by("aliases", "path").alias("aliases"))
