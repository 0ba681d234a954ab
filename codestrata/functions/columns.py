"""Column functions over paths and texts, all in the JVM, and matches of patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bound_batches


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """Directory of a path, '' at the top."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def suffix_of(path: Column) -> Column:
    """Lower-cased suffix with its dot; '' for names without one, or with a leading or final dot alone."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1))


def normal_path(path: Column) -> Column:
    """Without empty parts and '.', with '..' taking the part before it (at the top it is dropped)."""
    def step(done: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def join_routes(prefix: Column, path: Column) -> Column:
    """Two parts of a URL path as one: '/' adds nothing, and an empty result is '/'."""
    def part(x: Column) -> Column:
        return F.when(x == "/", "").otherwise(F.concat(F.lit("/"), F.regexp_replace(x, "^/+|/+$", "")))

    joined = F.concat(part(prefix), part(path))
    return F.when(joined == "", "/").otherwise(joined)


def ends_with_any(x: Column, endings: list[str]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | x.endswith(e)
    return out


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of fixed values, as a literal in the plan (it folds, and it broadcasts at a size known from the code)."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    structs = F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, fields, strict=True))) for r in rows))
    return spark.range(1).select(F.inline(structs))


#: Characters that ``before`` keeps of either end of what stands left of a match.
BEFORE = 2000
#: Matches that are sent on at once.
_ROWS = 20_000


def find_all(df: DataFrame, text: str, patterns: list[str], keep: list[str], left: bool = False) -> DataFrame:
    """All matches of several patterns in a text column: ``keep``, kind (number of the pattern), ord, line, m, groups, and with ``left`` before.

    One pass over each text in Arrow batches, without a shuffle. Lines are counted from match to match, so the pass is linear in the text.
    ``before`` is what stands left of the match on its line; of more than twice BEFORE characters, both ends. Groups that take no part are ''.
    Patterns are those of ``re``: letters, digits and word boundaries of all scripts.
    """
    bound_batches(df.sparkSession)
    columns = {"kind": pa.int32(), "ord": pa.int32(), "line": pa.int32(), "m": pa.string(), "groups": pa.list_(pa.string())} | ({"before": pa.string()} if left else {})

    def found(source: str, compiled: list[re.Pattern]) -> Iterator[tuple]:
        for kind, pattern in enumerate(compiled):
            line, at, edge = 1, 0, 0
            for n, m in enumerate(pattern.finditer(source)):
                start = m.start()
                breaks = source.count("\n", at, start)
                if breaks:
                    line, edge = line + breaks, source.rfind("\n", at, start) + 1
                at = start
                row = (kind, n, line, m[0], [g or "" for g in m.groups()])
                if left:
                    row += (source[edge:start] if start - edge <= 2 * BEFORE else source[edge : edge + BEFORE] + source[start - BEFORE : start],)
                yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(p) for p in patterns]
        for batch in batches:
            owners: list[int] = []
            rows: list[tuple] = []

            def out() -> pa.RecordBatch:
                taken = [batch.column(k).take(pa.array(owners, pa.int64())) for k in keep]
                return pa.RecordBatch.from_arrays([*taken, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), columns.values(), strict=True))], names=[*keep, *columns])

            for i, x in enumerate(batch.column("__text")):
                for row in found(x.as_py() or "", compiled):
                    owners.append(i)
                    rows.append(row)
                    if len(rows) == _ROWS:
                        yield out()
                        owners, rows = [], []
            if rows:
                yield out()

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keep), "kind int, ord int, line int, m string, groups array<string>", *(["before string"] if left else [])])
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def matches(df: DataFrame, text: str, pattern: str, groups: int, keep: list[str], left: bool = False) -> DataFrame:
    """All matches of one pattern (see ``find_all``): ``keep``, ord, line, m, g1 ..., and with ``left`` before."""
    found = find_all(df, text, [pattern], keep, left)
    return found.select(*keep, "ord", "line", "m", *(F.col("groups")[g].alias(f"g{g + 1}") for g in range(groups)), *(["before"] if left else []))


def unordered(c: str | Column) -> Column:
    """Distinct values as a sorted array, for aggregates."""
    return F.array_sort(F.collect_set(c))
