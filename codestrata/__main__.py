"""Command line: python -m codestrata analyse|trace|impact|export SOURCE [...]. SOURCE is a folder or a zip archive."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.scratch import cut
from .operators import artifact, graphs, views
from .plans.analysis import Analysis
from .sources import repository


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codestrata", description="Analyses source trees without running them.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("analyse", "write the artifact, as lines and as one document"), ("trace", "routes' traces that hold a text"), ("impact", "what depends on what a text names"), ("export", "the architecture as a diagram")):
        c = sub.add_parser(name, help=text)
        c.add_argument("source")
        c.add_argument("--name", help="the repository's name; else the source's last part")
        c.add_argument("--parser", choices=("syntax", "pattern"))
        if name == "analyse":
            c.add_argument("--out", required=True, help="folder for the artifact's lines; the document goes to <out>.json")
        elif name == "export":
            c.add_argument("--format", choices=("mermaid", "dot", "json"), default="mermaid")
        else:
            c.add_argument("query")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("codestrata").getOrCreate()
    files, skipped = repository.discover(repository.load(spark, args.source, args.name))
    a = Analysis(cut(files), args.parser)
    if args.command == "analyse":
        artifact.write_lines(artifact.artifact_lines(a), args.out)
        names = [r.repo for r in a.totals.select("repo").collect()]  # one source has one repository
        for name in names:
            with open(f"{args.out.rstrip('/')}.json", "w", encoding="utf-8") as out:
                artifact.write_document(artifact.read_lines(spark, args.out, name), out)
        for r in a.totals.collect():
            print(f"{r.repo}: {r.files} files, {r.source_files} of source, {r.lines} lines, {skipped.count()} skipped")
    elif args.command == "trace":
        for r in graphs.trace(a.flows[0], args.query).orderBy("flow", "n").toLocalIterator():
            print(f"{r.flow}\t{r.n}\t{r.type}\t{r.label}\t{r.file}:{r.line}")
    elif args.command == "impact":
        for r in graphs.impact(args.query, a.symbols, a.imports, a.calls).orderBy("dependent").toLocalIterator():
            print(r.dependent)
    else:
        make = {"mermaid": views.mermaid, "dot": views.dot, "json": views.architecture_json}[args.format]
        for r in make(a.components, a.connections).select(F.col(args.format)).collect():
            print(r[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
