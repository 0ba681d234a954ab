"""Router mounts: their targets, the prefixes that reach a file through nested mounts, expanded routes, and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import join_routes, parent_of
from ..functions.scratch import cut

_ROUTE_DIR = r"(?i)(^|/)(?:routes?|routers?)(?:/|$)"


def looks_like_router() -> Column:
    return (
        F.col("target_expression").rlike(r"(?i)router|routes?|require\s*\(|import\s*\(")
        | F.coalesce(F.col("prefix_expression"), F.lit("")).rlike("(?i)route|prefix|path")
        | F.coalesce(F.col("target_module"), F.lit("")).rlike("(?i)routes?|router")
    )


def with_targets(mounts: DataFrame, imports: DataFrame, routes: DataFrame) -> DataFrame:
    """Mounts with target (a file), and state: resolved, unresolved, or null for middleware.

    The target is that of the file's first import of the required module, or that binds the identifier. It counts if the file has
    Express routes or mounts of its own, and the prefix is static.
    """
    own = imports.where("target IS NOT NULL").select("repo", "file", F.col("ord").alias("i_ord"), "module", "names", F.col("target").alias("t"))
    fits = F.when(F.col("target_module").isNotNull(), F.col("module") == F.col("target_module")).otherwise(F.array_contains("names", F.col("target_identifier")))
    found = mounts.select("repo", "file", "ord", "target_module", "target_identifier").join(own, ["repo", "file"]).where(fits).groupBy("repo", "file", "ord").agg(F.min_by("t", "i_ord").alias("target"))
    surface = routes.where("framework = 'Express'").select("repo", "file").union(mounts.select("repo", "file")).distinct().select("repo", F.col("file").alias("target"), F.lit(True).alias("surface"))
    m = mounts.join(found, ["repo", "file", "ord"], "left").join(surface, ["repo", "target"], "left")
    state = F.when(F.col("surface") & F.col("prefix").isNotNull(), "resolved").when(F.col("prefix").isNull() | looks_like_router(), "unresolved")
    return m.withColumn("state", state).drop("surface")


def prefixes(resolved: DataFrame) -> DataFrame:
    """(repo, file, prefix), distinct: the prefixes under which mounts (repo, file, ord, target, prefix) reach a file, from files that no mount targets.

    A fixpoint over pairs of file and prefix, not over ways: each round joins the mounts with the pairs that are new since the round before, so
    any number of ways to the same pair cost one row. Mounts in a circle lengthen prefixes as long as passes over a repository's mounts, in
    the order of files and mounts, go on: one more pass than it has mounts. So a pair carries the least (pass, mount) that makes it: a later mount
    takes it up in the same pass, any other in the next; a pair that is found again earlier is taken up again.
    """
    at = F.struct("file", "ord")
    edges = cut(resolved.select("repo", "file", "target", F.col("prefix").alias("more"), at.alias("at")))
    edges = edges.join(edges.groupBy("repo").agg(F.count("*").alias("passes")), "repo")
    edges = cut(edges)

    def part(x: Column) -> Column:
        return F.when(x.isin("/", ""), "").otherwise(F.concat(F.lit("/"), F.regexp_replace(x, "^/+|/+$", "")))

    top = edges.select("repo", "file").distinct().join(edges.select("repo", F.col("target").alias("file")).distinct(), ["repo", "file"], "left_anti")
    first = F.struct(F.lit(1).alias("pass"), F.lit(None).cast(edges.schema["at"].dataType).alias("at"))
    new = cut(top.select("repo", "file", F.lit("").alias("prefix"), first.alias("when"), F.lit(True).alias("top")))
    known = new
    while new.limit(1).count():
        joined = F.concat(part(F.col("prefix")), part(F.col("more")))
        met = new.join(edges, ["repo", "file"]).withColumn("pass", F.col("when.pass") + F.coalesce(F.col("when.at") >= F.col("at"), F.lit(False)).cast("int"))
        made = met.where(F.col("pass") <= F.col("passes") + 1).groupBy("repo", F.col("target").alias("file"), F.when(joined == "", "/").otherwise(joined).alias("prefix")).agg(F.min(F.struct("pass", "at")).alias("when"))
        before = known.select("repo", "file", "prefix", F.col("when").alias("old"))
        new = cut(made.join(before, ["repo", "file", "prefix"], "left").where(F.col("old").isNull() | (F.col("when") < F.col("old"))).drop("old").withColumn("top", F.lit(False)))
        known = cut(known.unionByName(new).groupBy("repo", "file", "prefix").agg(F.min("when").alias("when"), F.max("top").alias("top")))
    return known.where("NOT top").select("repo", "file", "prefix")


def expand_routes(routes: DataFrame, resolved: DataFrame, ways: DataFrame) -> DataFrame:
    """Routes (repo, file, ord, ...) under every prefix of their file; equal (method, path, handler, file, line) once, the first."""
    targeted = resolved.select("repo", F.col("target").alias("file")).distinct().withColumn("targeted", F.lit(True))
    r = routes.join(targeted, ["repo", "file"], "left").withColumn("mounted", F.coalesce(F.col("targeted"), F.lit(False)) & (F.col("framework") == "Express")).drop("targeted")
    out = r.join(ways, ["repo", "file"], "left")
    out = out.withColumn("prefix", F.when(F.col("mounted"), F.coalesce("prefix", F.lit(""))).otherwise(""))
    full = F.when(F.col("prefix") != "", join_routes(F.col("prefix"), F.col("path"))).otherwise(F.col("path"))
    out = out.withColumn("full", full)
    n = F.row_number().over(W.partitionBy("repo", "method", "full", "handler", "file", "line").orderBy("ord", "prefix"))
    out = out.withColumn("n", n).where("n = 1")
    key = F.concat_ws(":", F.lit("route"), "file", "line", "method", "full")
    return out.withColumn("id", F.when(F.col("full") == F.col("path"), F.col("id")).otherwise(key)).withColumn("path", F.col("full")).drop("full", "n", "mounted", "prefix")


def _call() -> Column:
    return F.concat(F.col("receiver"), F.lit(".use("), F.concat_ws(", ", F.nullif("prefix_expression", F.lit("")), F.nullif("target_expression", F.lit(""))), F.lit(")"))


def diagnostics(targeted: DataFrame, routes: DataFrame, ways: DataFrame) -> DataFrame:
    """(repo, severity, code, file, message), distinct: mounts that could not be followed, routes that may lie below them, and mounts
    without a way from the top."""
    open_ = targeted.where("state = 'unresolved'")
    loose = F.col("dynamic") | F.col("prefix").isNull()
    # The codes and the texts of the messages in this function.
    dynamic = F.concat(F.lit('Could not resolve dynamic Express mount "'), _call(), F.lit('" at line '), "line", F.lit("; routes beneath this mount may be missing or have incomplete paths."))
    static = F.concat(F.lit('Could not resolve Express router target "'), "target_expression", F.lit('" mounted at "'), F.coalesce(F.nullif("prefix", F.lit("")), F.lit("/")), F.lit('" on line '), "line", F.lit("; routes beneath this mount may be missing."))
    first = open_.select("repo", F.when(loose, "DYNAMIC_ROUTE_MOUNT_UNRESOLVED").otherwise("EXPRESS_ROUTE_MOUNT_UNRESOLVED").alias("code"), "file", F.when(loose, dynamic).otherwise(static).alias("message"))
    # Candidate routes: other files that no resolved mount targets; near route directories first, then any, then all.
    done = targeted.where("state = 'resolved'").select("repo", F.col("target").alias("file")).distinct()
    free = routes.where("framework = 'Express'").join(done, ["repo", "file"], "left_anti").select("repo", F.col("file").alias("r_file"), "method", "path", F.col("line").alias("r_line"))
    # Which tier a mount has is found by counting files, by directory and by repository; only then do mounts meet the routes of their tier.
    slashed = F.when(F.instr("file", "/") > 0, F.concat(parent_of(F.col("file")), F.lit("/"))).otherwise("")
    free = free.withColumn("in_dir", F.col("r_file").rlike(_ROUTE_DIR))
    parts = F.split("r_file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    near = free.where("in_dir").withColumn("base", F.explode(above))

    def others(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.min("r_file").alias(f"{name}_min"), F.max("r_file").alias(f"{name}_max"))

    def some(name: str) -> Column:  # a file other than the mount's own
        return F.coalesce((F.col(f"{name}_min") != F.col("file")) | (F.col(f"{name}_max") != F.col("file")), F.lit(False))

    m = open_.withColumn("base", slashed).withColumn("call", _call()).join(others(near.groupBy("repo", "base"), "one"), ["repo", "base"], "left")
    m = m.join(others(free.where("in_dir").groupBy("repo"), "two"), "repo", "left").withColumn("tier", F.when(some("one"), 1).when(some("two"), 2).otherwise(3))
    routes_of = ["r_file", "method", "path", "r_line"]
    met = m.where("tier = 1").join(near.select("repo", "base", *routes_of), ["repo", "base"])
    met = met.unionByName(m.where("tier = 2").join(free.where("in_dir").select("repo", *routes_of), "repo")).unionByName(m.where("tier = 3").join(free.select("repo", *routes_of), "repo")).where("file <> r_file")
    incomplete = F.concat(F.lit("Full mounted path unresolved for "), "method", F.lit(" "), "path", F.lit("; this is the router-local path from "), "r_file", F.lit(":"), "r_line", F.lit('. Runtime mount "'), "call", F.lit('" at '), "file", F.lit(":"), "line", F.lit(" could not be followed statically."))
    second = met.select("repo", F.lit("EXPRESS_ROUTE_PATH_INCOMPLETE").alias("code"), F.col("r_file").alias("file"), incomplete.alias("message"))
    lost = targeted.where("state = 'resolved'").join(ways.select("repo", F.col("file").alias("target")).distinct(), ["repo", "target"], "left_anti")
    third = lost.select("repo", F.lit("EXPRESS_ROUTE_MOUNT_UNRESOLVED").alias("code"), "file", F.concat(F.lit('Resolved router "'), "target_expression", F.lit('" but could not establish a root mount path; routes beneath it may be incomplete.')).alias("message"))
    return first.unionByName(second).unionByName(third).distinct().withColumn("severity", F.lit("warning"))


def incomplete_routes(routes: DataFrame, diags: DataFrame) -> DataFrame:
    """Routes whose full path a diagnostic calls unresolved."""
    d = diags.where("code = 'EXPRESS_ROUTE_PATH_INCOMPLETE'").select("repo", "file", "message")
    met = routes.join(d, ["repo", "file"]).where(F.col("message").startswith(F.concat(F.lit("Full mounted path unresolved for "), "method", F.lit(" "), "path", F.lit(";"))))
    return routes.join(met.select("repo", "id").distinct(), ["repo", "id"], "left_semi")
