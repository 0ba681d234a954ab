"""Technologies: manifests, environment variables, SQL text, unions and evidence."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.columns import ends_with_any, fixed_table, matches, name_of, suffix_of, unordered


def package_tags(files: DataFrame) -> DataFrame:
    """(repo, category, tech) from the root package.json: dependencies by name or else scope, and npm scripts."""
    dim = fixed_table(files.sparkSession, [(k, c, t) for k, (c, t) in fixed.PACKAGE_TECH.items()], "package string, category string, tech string")
    deps = "struct<dependencies: map<string, string>, devDependencies: map<string, string>, scripts: map<string, string>>"
    p = files.where("path = 'package.json'").select("repo", F.from_json("content", deps).alias("p"))
    none = F.array().cast("array<string>")
    names = F.array_distinct(F.concat(F.coalesce(F.map_keys("p.dependencies"), none), F.coalesce(F.map_keys("p.devDependencies"), none)))
    n = p.select("repo", F.explode(names).alias("package"))
    exact = n.join(F.broadcast(dim), "package").select("repo", "category", "tech")
    scoped = n.where(F.col("package").startswith("@")).join(F.broadcast(dim), "package", "left_anti").select("repo", F.substring_index("package", "/", 1).alias("package")).join(F.broadcast(dim), "package").select("repo", "category", "tech")
    scripts = p.where(F.size("p.scripts") > 0).select("repo", F.lit("tooling").alias("category"), F.lit("npm scripts").alias("tech"))
    return exact.unionByName(scoped).unionByName(scripts).distinct()


def _toml(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def names(source: str | None) -> list[str] | None:
        try:
            data = tomllib.loads(source or "")
            project = data.get("project", {})
            found = [*project.get("dependencies", []), *(d for g in project.get("optional-dependencies", {}).values() if isinstance(g, list) for d in g), *data.get("tool", {}).get("poetry", {}).get("dependencies", {})]
            return [re.split(r"[><=~!;\[]", str(d))[0].strip().lower() for d in found]
        except (tomllib.TOMLDecodeError, AttributeError, TypeError):
            return None

    for column in batches:
        yield pa.array([names(x) for x in column.to_pylist()], pa.list_(pa.string()))


def python_manifest_tags(files: DataFrame) -> DataFrame:
    """(repo, category, tech) from pyproject.toml (parsed; as text where that fails), requirements.txt and Pipfile (as text)."""
    dim = fixed_table(files.sparkSession, [(k, c, t) for k, (c, t) in fixed.PYTHON_TECH.items()], "package string, category string, tech string")
    parse = F.arrow_udf(_toml, "array<string>")
    project = files.where("path = 'pyproject.toml'").select("repo", "content", parse(F.col("content")).alias("names"))
    parsed = project.select("repo", F.explode("names").alias("package")).join(F.broadcast(dim), "package").select("repo", "category", "tech")
    plain = files.where(F.col("path").isin("requirements.txt", "Pipfile")).select("repo", "content").unionByName(project.where("names IS NULL").select("repo", "content"))
    # Package names in a text are its runs of letters, digits, '_' and '-': those of the list are joined, not searched one by one.
    words = plain.select("repo", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("([a-z0-9_-]+)"), F.lit(1)))).alias("package"))
    found = words.join(F.broadcast(dim), "package").select("repo", "category", "tech")
    return parsed.unionByName(found).distinct()


def presence_tags(files: DataFrame) -> DataFrame:
    """(repo, category, tech) of files that are there: Docker, Compose, Actions, Prisma, Next.js, Vite, Tailwind."""
    p, n = F.col("path"), name_of(F.col("path"))
    tag = lambda c, t: F.struct(F.lit(c).alias("category"), F.lit(t).alias("tech"))
    found = F.array_compact(
        F.array(
            F.when((p == "Dockerfile") | p.startswith("Dockerfile."), tag("infrastructure", "Docker")),
            F.when(p.isin("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"), tag("infrastructure", "Docker Compose")),
            F.when(p.startswith(".github/workflows/"), tag("infrastructure", "GitHub Actions")),
            F.when(p.endswith("schema.prisma"), tag("database", "Prisma")),
            F.when(n.startswith("next.config."), tag("framework", "Next.js")),
            F.when(n.startswith("vite.config."), tag("build", "Vite")),
            F.when(n.startswith("tailwind.config."), tag("tooling", "Tailwind CSS")),
        )
    )
    return files.select("repo", F.inline(found)).distinct()


def environment_evidence(files: DataFrame) -> DataFrame:
    """(repo, tech, file, line, kind): uses of known environment variables outside documentation, each with its line.

    One scan finds all of them; which technology a hit shows is decided by its text.
    """
    body = "|".join(p[2:-2] for p in fixed.ENVIRONMENT.values())
    wanted = files.where(~ends_with_any(F.lower("path"), fixed.ENVIRONMENT_SKIPS)).where(F.col("content").rlike(rf"\b(?:{body})\b"))
    m = matches(wanted.select("repo", F.col("path").alias("file"), "content"), "content", rf"\b(?:{body})\b", 0, ["repo", "file"])
    tech = F.lit(None).cast("string")
    for name, pattern in reversed(fixed.ENVIRONMENT.items()):
        tech = F.when(F.col("m").rlike(f"^{pattern}$"), name).otherwise(tech)
    return m.select("repo", tech.alias("tech"), "file", "line", F.lit("environment_variable").alias("kind"))


def sql_tags(files: DataFrame) -> DataFrame:
    return files.where((suffix_of(F.col("path")) == ".sql") | F.col("content").rlike(fixed.SQL_WORDS)).select("repo", F.lit("database").alias("category"), F.lit("SQL database").alias("tech")).distinct()


def technologies(manifest: DataFrame, used: DataFrame, environment: DataFrame, sql: DataFrame) -> DataFrame:
    """(repo, category, tech): the union of manifests, use in sources, SQL texts and environment. An environment name counts as a database if
    it is one of three, and as external unless it is a database; 'SQL database' gives way to a named one."""
    env = environment.select("repo", "tech").distinct()
    db = env.where(F.col("tech").isin("PostgreSQL", "MongoDB", "Supabase")).select("repo", F.lit("database").alias("category"), "tech")
    base = manifest.select("repo", "category", "tech").unionByName(used.select("repo", "category", "tech")).unionByName(sql).unionByName(db).distinct()
    external = env.join(base.where("category = 'database'").select("repo", "tech"), ["repo", "tech"], "left_anti").select("repo", F.lit("external").alias("category"), "tech")
    full = base.unionByName(external).distinct()
    named = full.where((F.col("category") == "database") & F.col("tech").isin("PostgreSQL", "MySQL", "SQLite")).select("repo").distinct().withColumn("category", F.lit("database")).withColumn("tech", F.lit("SQL database"))
    return full.join(named, ["repo", "category", "tech"], "left_anti")


def stack(tech: DataFrame) -> DataFrame:
    """(repo, technologies): sorted names of all categories but tooling."""
    return tech.where("category <> 'tooling'").groupBy("repo").agg(unordered("tech").alias("technologies"))


def boundaries(tech: DataFrame, used: DataFrame, environment: DataFrame, top: int = 20) -> DataFrame:
    """(repo, name, type, confidence, evidence): databases and external systems with up to ``top`` places, uses in sources first."""
    t = tech.where(F.col("category").isin("database", "external")).select("repo", "category", "tech")
    by_use = used.select("repo", "category", "tech", F.lit(0).alias("late"), "file", F.lit(None).cast("int").alias("line"), F.lit("source_usage").alias("kind"))
    by_env = t.join(environment, ["repo", "tech"]).select("repo", "category", "tech", F.lit(1).alias("late"), "file", "line", "kind")
    e = by_use.unionByName(by_env).withColumn("n", F.row_number().over(W.partitionBy("repo", "category", "tech").orderBy("late", "file", "line"))).where(F.col("n") <= top)
    places = e.groupBy("repo", "category", "tech").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "file", "line", "kind"))), lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), x["kind"].alias("kind"))).alias("evidence"))
    kind = F.when(F.col("category") == "database", "database").otherwise("external_system")
    return t.join(places, ["repo", "category", "tech"], "left").select("repo", F.col("tech").alias("name"), kind.alias("type"), F.when(F.col("evidence").isNotNull(), 0.95).otherwise(0.72).cast("double").alias("confidence"), "evidence")


def codebase_size(source_files: Column) -> Column:
    return F.when(source_files <= 25, "Small codebase").when(source_files <= 150, "Medium codebase").otherwise("Large codebase")


def map_quality(incomplete_paths: Column) -> Column:
    return F.when(incomplete_paths > 0, "Mostly mapped").otherwise("Fully mapped")


def summary(totals: DataFrame, warnings: DataFrame, tech: DataFrame, shares: DataFrame) -> DataFrame:
    """(repo, size, quality, primary): what a repository's page says first. The primary technology is the first one, else the first language."""
    first = stack(tech).select("repo", F.get("technologies", 0).alias("tech"))
    language = shares.groupBy("repo").agg(F.min("language").alias("language"))
    t = totals.join(warnings, "repo", "left").join(first, "repo", "left").join(language, "repo", "left")
    return t.select("repo", codebase_size(F.col("source_files")).alias("size"), map_quality(F.coalesce("paths", F.lit(0))).alias("quality"), F.coalesce("tech", "language", F.lit("Custom application")).alias("primary"))
