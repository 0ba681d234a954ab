"""Table functions for SQL: the facts of one Python text, to be used with LATERAL.

    tables.register(spark)
    spark.sql("SELECT f.repo, f.path, t.* FROM files f, LATERAL python_imports(f.content) t")
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def _facts(text: str | None, texts: bool = False) -> dict:
    from ..operators.python_facts import facts_of  # functions are imported by operators

    return facts_of(text or "", texts)


@udtf(returnType="ord int, line int, module string, names array<string>")
class PythonImports:
    """Imports of a Python text, a row for each module; none for a text that cannot be parsed, or null."""

    def eval(self, text: str):
        for x in _facts(text)["imports"]:
            yield x["ord"], x["line"], x["module"], x["names"]


@udtf(returnType="ord int, kind string, name string, line int, end_line int, parents array<string>, bases array<string>")
class PythonDefinitions:
    """Classes and functions of a Python text in visiting order, with the names that they stand in."""

    def eval(self, text: str):
        for x in _facts(text)["defs"]:
            yield x["ord"], x["kind"], x["name"], x["line"], x["end_line"], x["parents"], x["bases"]


@udtf(returnType="ord int, owner string, callee string, line int, nargs int, receiver string, arguments string, assigned_to string")
class PythonCalls:
    """Calls of a Python text, with the definition that they stand in and what was written."""

    def eval(self, text: str):
        for x in _facts(text, texts=True)["calls"]:
            yield x["ord"], x["owner"], x["callee"], x["line"], x["nargs"], x["receiver"], x["arguments"], x["assigned_to"]


FUNCTIONS = {"python_imports": PythonImports, "python_definitions": PythonDefinitions, "python_calls": PythonCalls}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
