"""The whole analysis of source trees as named lazy tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import suffix_of
from ..functions.scratch import cut
from ..operators import artifact, derive, graphs, languages, mounts, python_facts, python_patterns, quality, resolve, script_facts, technology


class Analysis:
    """Tables derived from files (repo, path, content, bytes). Each property is a DataFrame; nothing runs before it is asked for.

    Facts that feed many tables are checkpointed when first asked for, so that plans stay short; all else is one lazy plan per table.
    """

    def __init__(self, files: DataFrame, parser: str | None = None):
        self.files = files
        self.parser = languages.parser_mode(parser)

    def _more(self, base: DataFrame, table: str) -> DataFrame:
        """``base`` and the facts of registered languages."""
        for found in languages.extracted(self.files, table):
            base = base.unionByName(found.select(base.columns))
        return base

    @cached_property
    def python(self) -> DataFrame:
        return cut(python_facts.syntax(self.files))

    @cached_property
    def scripts(self) -> DataFrame:
        return script_facts.scripts(self.files)

    @cached_property
    def records(self) -> DataFrame:
        return derive.file_records(self.files)

    @cached_property
    def symbols(self) -> DataFrame:
        found = python_patterns.symbols(self.lines) if self.parser == "pattern" else python_facts.symbols(self.python)
        return self._more(found.unionByName(self.script_symbols), "symbols")

    @cached_property
    def lines(self) -> DataFrame:
        """Lines of Python files, for the parser mode 'pattern'."""
        return cut(python_patterns.lines(self.files))

    @cached_property
    def script_symbols(self) -> DataFrame:
        return cut(script_facts.symbols(self.scripts))

    @cached_property
    def script_imports(self) -> DataFrame:
        return cut(script_facts.imports(self.scripts))

    @cached_property
    def imports(self) -> DataFrame:
        found = python_patterns.imports(self.lines) if self.parser == "pattern" else python_facts.imports(self.python)
        found = self._more(found.unionByName(self.script_imports), "imports")
        return cut(resolve.resolve_imports(found, self.files, resolve.tsconfig_aliases(self.files)))

    @cached_property
    def local_routes(self) -> DataFrame:
        """Routes as their files state them, before mounts."""
        js, syms = self.scripts, self.script_symbols
        parts = [script_facts.express_routes(js, syms), script_facts.nest_routes(js), script_facts.next_routes(js, syms)]
        out = python_patterns.routes(self.lines) if self.parser == "pattern" else python_facts.routes(self.python)
        for p in parts:
            out = out.unionByName(p)
        return cut(self._more(out, "routes"))

    @cached_property
    def mounts(self) -> DataFrame:
        return cut(mounts.with_targets(script_facts.mounts(self.scripts), self.imports, self.local_routes))

    @cached_property
    def mount_ways(self) -> DataFrame:
        return cut(mounts.prefixes(self.mounts.where("state = 'resolved'")))

    @cached_property
    def routes(self) -> DataFrame:
        return cut(mounts.expand_routes(self.local_routes, self.mounts.where("state = 'resolved'"), self.mount_ways))

    @cached_property
    def diagnostics(self) -> DataFrame:
        return mounts.diagnostics(self.mounts, self.local_routes, self.mount_ways)

    @cached_property
    def calls(self) -> DataFrame:
        found = python_patterns.calls(self.lines) if self.parser == "pattern" else python_facts.calls(self.python)
        found = self._more(found.unionByName(script_facts.calls(self.scripts, self.script_symbols)), "calls")
        return cut(resolve.resolve_calls(found, self.symbols, self.imports))

    @cached_property
    def call_texts(self) -> DataFrame:
        """Calls of Python files with receiver, arguments and assigned name."""
        return python_facts.call_texts(self.files)

    @cached_property
    def used(self) -> DataFrame:
        """(repo, file, category, tech) that sources use."""
        js = script_facts.tags(self.scripts, self.script_imports, self.local_routes.where("framework IN ('Express', 'NestJS', 'Next.js')"))
        found = python_patterns.tags(self.lines, self.files) if self.parser == "pattern" else python_facts.tags(self.python, self.files)
        return cut(found.unionByName(js))

    @cached_property
    def manifest(self) -> DataFrame:
        return technology.package_tags(self.files).unionByName(technology.python_manifest_tags(self.files)).unionByName(technology.presence_tags(self.files)).distinct()

    @cached_property
    def environment(self) -> DataFrame:
        return cut(technology.environment_evidence(self.files))

    @cached_property
    def technologies(self) -> DataFrame:
        return cut(technology.technologies(self.manifest, self.used, self.environment, technology.sql_tags(self.files)))

    @cached_property
    def boundaries(self) -> DataFrame:
        return technology.boundaries(self.technologies, self.used, self.environment)

    @cached_property
    def layers(self) -> DataFrame:
        return derive.layers(self.files, self.routes, self.symbols)

    @cached_property
    def components(self) -> DataFrame:
        return derive.components(self.layers)

    @cached_property
    def connections(self) -> DataFrame:
        return derive.connections(self.imports, self.layers)

    @cached_property
    def evidence(self) -> DataFrame:
        found = python_patterns.entry_evidence(self.lines) if self.parser == "pattern" else python_facts.entry_evidence(self.python)
        return found.unionByName(script_facts.entry_evidence(self.scripts)).unionByName(resolve.manifest_entries(self.files))

    @cached_property
    def entrypoints(self) -> DataFrame:
        return derive.entrypoints(self.files, self.evidence)

    @cached_property
    def degrees(self) -> DataFrame:
        return derive.degrees(self.files, self.imports)

    @cached_property
    def important(self) -> DataFrame:
        return derive.important_files(self.degrees, self.routes, self.entrypoints)

    @cached_property
    def tour(self) -> DataFrame:
        return derive.tour(self.entrypoints, self.components, self.important)

    @cached_property
    def cycles(self) -> DataFrame:
        return graphs.dependency_cycles(self.imports)

    @cached_property
    def metrics(self) -> DataFrame:
        return derive.metrics(self.files, self.symbols, self.imports, self.cycles)

    @cached_property
    def flows(self) -> tuple[DataFrame, DataFrame]:
        return graphs.flows(self.routes, self.calls, cut(self.symbols))

    @cached_property
    def totals(self) -> DataFrame:
        python = self.files.where(suffix_of(F.col("path")).isin(fixed.PY_SUFFIXES)).select("repo", "path") if self.parser == "pattern" else self.python.where("error IS NULL").select("repo", F.col("file").alias("path"))
        parsed = python.unionByName(self.scripts.select("repo", F.col("file").alias("path")))
        return derive.repository_totals(self.records, parsed)

    def tables(self) -> dict[str, DataFrame]:
        """Fact tables under the names that the audit knows."""
        nodes, edges = self.flows
        return {
            "files": self.records, "symbols": self.symbols, "imports": self.imports, "calls": self.calls, "routes": self.routes, "entrypoints": self.entrypoints,
            "components": self.components, "component_files": self.layers.select("repo", F.col("path").alias("file"), "component"), "connections": self.connections,
            "flow_nodes": nodes, "flow_edges": edges, "totals": self.totals,
        }

    def audit(self) -> DataFrame:
        return quality.audit(self.tables())

    def artifact(self) -> DataFrame:
        """(repo, json): the whole analysis of each repository as JSON."""
        return artifact.artifacts(self)

    def register(self, prefix: str = "") -> None:
        """Temporary views of all tables, for SQL."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)


def analyse(files: DataFrame) -> Analysis:
    return Analysis(files)
