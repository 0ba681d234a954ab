"""Quality: references between tables, value ranges, and a gate that fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unordered

#: (table, column, referenced table, referenced column) of all references between fact tables.
REFERENCES = [
    ("symbols", "file", "files", "path"),
    ("routes", "file", "files", "path"),
    ("entrypoints", "file", "files", "path"),
    ("imports", "file", "files", "path"),
    ("imports", "target", "files", "path"),
    ("component_files", "file", "files", "path"),
    ("component_files", "component", "components", "id"),
    ("connections", "source", "components", "id"),
    ("connections", "target", "components", "id"),
    ("flow_nodes", "file", "files", "path"),
    ("flow_edges", "source", "flow_nodes", "id"),
    ("flow_edges", "target", "flow_nodes", "id"),
]
#: (table, column, condition that each value meets).
RANGES = [
    ("files", "lines", "lines >= 1"),
    ("files", "bytes", "bytes >= 0"),
    ("symbols", "line", "line >= 1"),
    ("routes", "confidence", "confidence BETWEEN 0 AND 1"),
    ("calls", "confidence", "confidence BETWEEN 0 AND 1"),
    ("entrypoints", "confidence", "confidence BETWEEN 0 AND 1"),
    ("connections", "weight", "weight >= 1"),
    ("totals", "parse_rate", "parse_rate BETWEEN 0 AND 100"),
]
#: (table, columns that are unique together).
KEYS = [("files", ["path"]), ("files", ["id"]), ("flow_nodes", ["flow", "id"])]


def _tagged(tables: dict[str, DataFrame]) -> DataFrame | None:
    """(repo, space, scope, key, own, rule): all keys and all references as rows. A space is a column that others refer to or whose values are unique; keys of flow nodes
    are scoped by their flow; own is 1 for a key; rule has the bit of the reference's rule."""
    spaces = list(dict.fromkeys([(o, k) for _, _, o, k in REFERENCES] + [(t, k[-1]) for t, k in KEYS]))

    def scope(table: str) -> Column:
        return F.col("flow") if table in ("flow_edges", "flow_nodes") else F.lit(None).cast("string")

    rows = []
    for i, (table, column) in enumerate(spaces):
        wanted = (table, column) in [(t, k[-1]) for t, k in KEYS] or any((o, k) == (table, column) and t in tables for t, _, o, k in REFERENCES)
        if table in tables and wanted and column in tables[table].columns:
            scoped = table == "flow_nodes"
            rows.append(tables[table].select("repo", F.lit(i).alias("space"), (scope(table) if scoped else F.lit(None).cast("string")).alias("scope"), F.col(column).cast("string").alias("key"), F.lit(1).cast("long").alias("own"), F.lit(0).cast("long").alias("rule")))
    for i, (table, column, other, key) in enumerate(REFERENCES):
        if table in tables and other in tables:
            refs = tables[table].where(F.col(column).isNotNull())
            rows.append(refs.select("repo", F.lit(spaces.index((other, key))).alias("space"), (scope(table) if other == "flow_nodes" else F.lit(None).cast("string")).alias("scope"), F.col(column).cast("string").alias("key"), F.lit(0).cast("long").alias("own"), F.lit(1 << i).cast("long").alias("rule")))
    return _union(rows) if rows else None


def keys_and_references(tables: dict[str, DataFrame]) -> DataFrame:
    """(repo, rule, key, kind): references without their row (``reference``) and keys on several rows (``key``), for all rules whose tables and columns are given.

    One aggregate over one union: rows meet by (repo, space, key) once, whatever the number of rules, and counts and bits are combined before the
    shuffle, so a key that very many rows refer to costs one row a task.
    """
    spaces = list(dict.fromkeys([(o, k) for _, _, o, k in REFERENCES] + [(t, k[-1]) for t, k in KEYS]))
    met = _tagged(tables).groupBy("repo", "space", "scope", "key").agg(F.sum("own").alias("own"), F.bit_or("rule").alias("rules"))
    names = [f"{t}.{c} -> {o}.{k}" for t, c, o, k in REFERENCES]
    lost = F.array_compact(F.array(*(F.when((F.col("own") == 0) & (F.col("rules").bitwiseAND(F.lit(1 << i)) != 0), F.struct(F.lit(n).alias("rule"), F.lit("reference").alias("kind"))) for i, n in enumerate(names))))
    again = F.array_compact(F.array(*(F.when((F.col("own") > 1) & (F.col("space") == spaces.index((t, k[-1]))), F.struct(F.lit(f"{t} unique ({', '.join(k)})").alias("rule"), F.lit("key").alias("kind"))) for t, k in KEYS)))
    out = met.select("repo", "scope", "key", F.explode(F.concat(lost, again)).alias("x"))
    return out.select("repo", "x.rule", F.when(F.col("x.kind") == "key", F.concat_ws("/", "scope", "key")).otherwise(F.col("key")).alias("key"), "x.kind")


def dangling(tables: dict[str, DataFrame]) -> DataFrame:
    """(repo, rule, key): values of reference columns without their row. Flow edges refer to nodes of the same flow."""
    return keys_and_references(tables).where("kind = 'reference'").drop("kind").distinct()


def out_of_range(tables: dict[str, DataFrame]) -> DataFrame:
    """(repo, rule, key): values outside their range, missing ones included."""
    return _union([tables[t].where(f"NOT coalesce({rule}, false)").select("repo", F.lit(f"{t}.{rule}").alias("rule"), F.col(c).cast("string").alias("key")) for t, c, rule in RANGES if t in tables])


def repeated_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(repo, rule, key): keys on several rows."""
    return keys_and_references(tables).where("kind = 'key'").drop("kind")


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(repo, rule, key) of all rules: references (each value once, for flow edges once a flow), keys, and values out of range (each row)."""
    return keys_and_references(tables).drop("kind").unionByName(out_of_range(tables))


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(repo, issues, first): number of violations and the first four rules that fail."""
    return violations(tables).groupBy("repo").agg(F.count("*").alias("issues"), F.slice(unordered("rule"), 1, 4).alias("first"))


def gate(df: DataFrame, issues: Column) -> DataFrame:
    """``df``, failing with ANALYSIS_SCHEMA_ERROR on the first row that has issues."""
    return df.where(F.assert_true(issues == 0, F.lit("ANALYSIS_SCHEMA_ERROR")).isNull())


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
