"""The artifact, its guard and gate, the registry of languages, patterns of Python files, sources and views."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from codestrata.functions import telemetry
from codestrata.functions.columns import find_all
from codestrata.operators import artifact, languages, technology, views
from codestrata.plans.analysis import Analysis
from codestrata.sources import repository
from codestrata.streaming import admission

FILES = [
    ("r", "api/main.py", "from fastapi import FastAPI\nfrom core.db import load\napp = FastAPI()\n@app.get('/items')\ndef items():\n    return load()\n"),
    ("r", "core/db.py", "import psycopg2\nURL = 'postgresql://x'\ndef load():\n    return 1\n"),
    ("r", "web/a.ts", "export function show() { return 1 }\n"), ("r", "bad.py", "def broken(:\n"), ("q", "README.md", "hello\n"),
]


def made(spark, rows=FILES):
    return spark.createDataFrame(rows, "repo string, path string, content string").withColumn("bytes", F.octet_length("content").cast("long"))


def test_artifact_is_valid_and_passes_the_gate(spark, tmp_path):
    a = Analysis(made(spark)).artifact()
    rows = {r.repo: json.loads(r.json) for r in a.collect()}
    r = rows["r"]
    assert set(rows) == {"r", "q"} and r["schemaVersion"] == artifact.VERSION
    assert {c[1] for c in artifact.CONSTRAINTS if not c[0] and "." not in c[1]} <= set(r)
    assert [(f["path"], f["parsed"]) for f in r["files"]] == [("api/main.py", True), ("bad.py", False), ("core/db.py", True), ("web/a.ts", True)]
    assert r["routes"][0]["path"] == "/items" and r["repository"]["fileCount"] == 4 and rows["q"]["symbols"] == []
    assert r["metadata"]["fileComponents"]["api/main.py"] == "api" and r["imports"][1]["target"] == "core/db.py"
    made_rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()], "repo string, json string")
    assert artifact.violations(made_rows).collect() == [] and artifact.gated(made_rows).count() == 2
    artifact.write_artifacts(made_rows, f"{tmp_path}/a")
    assert [x.shape_ok for x in artifact.read_artifacts(spark, f"{tmp_path}/a").collect()] == [True, True]
    broken = {**r, "routes": [{**r["routes"][0], "confidence": 2, "line": 0}], "files": [{"id": 1}], "metrics": None}
    del broken["flows"]
    bad = spark.createDataFrame([("b", json.dumps(broken)), ("n", "no json"), ("e", None)], "repo string, json string")
    found = {(x.repo, x.rule) for x in artifact.violations(bad).collect()}
    assert {("b", "routes[].confidence: at most 1"), ("b", "routes[].line: at least 1"), ("b", "files[].id: string"), ("b", "files[].path: required"), ("b", "flows: required"), ("b", "metrics: object"), ("n", "object"), ("e", "object")} <= found
    assert [x.shape_ok for x in artifact.guarded(bad).collect()] == [False, False, False]
    with pytest.raises(Exception, match="ANALYSIS_SCHEMA_ERROR"):
        artifact.gated(bad).collect()


def test_registered_languages_take_part(spark):
    def extract(files):
        m = find_all(files, "content", [r"(?m)^sub\s+(\w+)"], ["repo", "path"])
        none = F.array().cast("array<string>")
        return {"symbols": m.select("repo", F.col("path").alias("file"), "ord", F.concat("path", F.lit("::"), F.col("groups")[0]).alias("id"), F.lit("function").alias("type"), F.col("groups")[0].alias("name"), "line", F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("parent"), none.alias("evidence"), F.lit(False).alias("exported"))}

    files = made(spark, [*FILES, ("r", "lib/x.PL", "sub one {\n}\nsub two {\n}\n")])
    languages.register("perl", [".pl"], extract)
    try:
        assert [r[0] for r in files.select(languages.language_of(F.col("path"))).collect()] == ["python", "python", "javascript", "python", None, "perl"]
        assert {r.name for r in Analysis(files).symbols.where("file = 'lib/x.PL'").collect()} == {"one", "two"}
        with pytest.raises(ValueError):
            languages.register("other", [".py"])
    finally:
        languages.unregister("perl")
    assert "perl" not in [x.name for x in languages.registered()]


def test_pattern_mode_finds_facts_of_files_that_do_not_parse(spark, monkeypatch):
    source = "import os, sys as s\nfrom a.b import c as d, e\nbp = Blueprint('x', url_prefix='/api/')\n# import no\nclass M(models.Model):\n    def get(self):\n        run(self)\n\n@bp.route('/items', methods=['GET', 'POST'])\n@cached\ndef items(:\n    helper.load()\n@app.get('/')\nclass K:\n    pass\nif x: go()\n"
    a = Analysis(made(spark, [("r", "m.py", source)]), parser="pattern")
    assert {(r.name, r.type, r.parent, r.line) for r in a.symbols.collect()} == {("m.py", "module", None, 1), ("M", "database_model", None, 5), ("get", "method", "m.py::M", 6), ("items", "function", None, 11), ("K", "class", None, 14)}
    assert [(r.module, r.names, r.line) for r in a.imports.orderBy("ord").collect()] == [("os", ["os"], 1), ("sys", ["sys"], 1), ("a.b", ["c", "e"], 2)]
    assert [(r.method, r.path, r.handler, r.line) for r in a.routes.collect()] == [("GET,POST", "/api/items", "m.py::items", 11)]
    assert [(r.source, r.callee) for r in a.calls.orderBy("ord").collect()] == [("m.py", "Blueprint"), ("m.py::M::get", "run"), ("m.py::items", "helper.load"), ("m.py::K", "go")]
    assert {tuple(r)[2:] for r in a.used.collect()} == {("framework", "Django"), ("database", "Django ORM"), ("framework", "Flask")}
    more = "import redis.client, os\nfrom sqlalchemy.orm import x\nfrom .beanie import y\napp = FastAPI()\ne = create_engine('PostgreSQL://h')\nclass D(Document): pass\n# app = Flask()\ndef main(): Flask()\nif __name__ == \"__main__\": main()\nif __name__=='__main__': main()\ndef (\n"
    b = Analysis(made(spark, [("r", "n.py", more), ("r", "empty.py", ""), ("r", "url.py", "# mongodb+srv://h\n")]), parser="pattern")
    assert {tuple(r)[1:] for r in b.used.collect()} == {("n.py", "external", "Redis"), ("n.py", "framework", "SQLAlchemy"), ("n.py", "database", "SQL database"), ("n.py", "database", "PostgreSQL"), ("n.py", "framework", "FastAPI"), ("n.py", "database", "MongoDB"), ("url.py", "database", "MongoDB")}
    assert [(r.file, r.reason) for r in b.evidence.orderBy("ord").collect()] == [("n.py", "creates a FastAPI application"), ("n.py", "contains a __main__ execution guard")]
    assert b.totals.collect() and Analysis(made(spark, [("r", "n.py", more)])).evidence.collect() == []
    # Over files that do parse, both modes find the same tags and evidence.
    from codestrata.sources import corpus

    files = corpus.code_files(spark, "/root/testdata/sf0.001").where("repo IN ('src1/1', 'src2/2') AND path NOT LIKE '%broken%'")
    both = [{(*r,) for r in x.used.collect()} | {(r.repo, r.file, r.reason) for r in x.evidence.collect()} for x in (Analysis(files), Analysis(files, parser="pattern"))]
    assert both[0] == both[1] and len(both[0]) > 10
    monkeypatch.setenv("CODESTRATA_PARSER", "pattern")
    assert languages.parser_mode() == "pattern" and languages.parser_mode("syntax") == "syntax"
    with pytest.raises(ValueError):
        languages.parser_mode("other")


def test_sources_links_archives_and_samples(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "d").mkdir(parents=True)
    (root / "a.py").write_text("x = 1\n")
    (root / "d" / "b.py").write_text("y = 2\n")
    os.symlink(root / "a.py", root / "link.py")
    os.symlink(root / "d", root / "away")
    files, skipped = repository.discover(repository.load(spark, str(root)))
    assert {(r.repo, r.path) for r in files.collect()} == {("tree", "a.py"), ("tree", "d/b.py")} and {(r.path, r.reason) for r in skipped.collect()} == {("link.py", "symlink"), ("away", "symlink")}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("top/a.py", "x = 1\n" * 50)
        z.writestr("top/b.py", "y = 1\n" * 50)
    (tmp_path / "pack.zip").write_bytes(data.getvalue())
    assert {(r.repo, r.path) for r in repository.load(spark, str(tmp_path / "pack.zip")).collect()} == {("pack", "a.py"), ("pack", "b.py")}
    with pytest.raises(Exception, match="EXTRACTED_TOO_LARGE"):
        repository.load(spark, str(tmp_path / "pack.zip"), limits=repository.Limits(extracted_bytes=400)).collect()
    asked = spark.createDataFrame([("Acme/Thing",), ("other/thing",), (None,)], "url string")
    samples = spark.createDataFrame([("acme/thing", "/samples/thing.json")], "url string, artifact string")
    assert sorted((str(r.url), r.artifact) for r in repository.with_samples(asked, samples).collect()) == [("Acme/Thing", "/samples/thing.json"), ("None", None), ("other/thing", None)]


def test_versions_of_stored_facts(spark, tmp_path):
    assert admission.stored_facts(spark, f"{tmp_path}/c") is None
    old = spark.createDataFrame([("r", "a", "1"), ("r", "gone", "2")], "repo string, path string, hash string")
    admission.store_facts(old, f"{tmp_path}/c")
    files = spark.createDataFrame([("r", "a", "1"), ("r", "b", "3")], old.schema)
    _, misses = admission.split_by_cache(files, admission.stored_facts(spark, f"{tmp_path}/c"))
    admission.store_facts(admission.refreshed(admission.stored_facts(spark, f"{tmp_path}/c"), files, misses), f"{tmp_path}/c")
    assert {tuple(r) for r in admission.stored_facts(spark, f"{tmp_path}/c").collect()} == {("r", "a", "1"), ("r", "b", "3")}


def test_views_of_a_repository(spark):
    d = spark.createDataFrame([("r", "DYNAMIC_ROUTE_MOUNT_UNRESOLVED"), ("r", "EXPRESS_ROUTE_PATH_INCOMPLETE"), ("q", "other")], "repo string, code string")
    warnings = views.warning_counts(d)
    assert {tuple(r) for r in warnings.collect()} == {("r", 1, 1), ("q", 0, 0)}
    totals = spark.createDataFrame([("r", 26), ("q", 25)], "repo string, source_files long")
    tech = spark.createDataFrame([("r", "framework", "Flask")], "repo string, category string, tech string")
    shares = spark.createDataFrame([("q", "Python")], "repo string, language string")
    assert {tuple(r) for r in technology.summary(totals, warnings, tech, shares).collect()} == {("r", "Medium codebase", "Mostly mapped", "Flask"), ("q", "Small codebase", "Fully mapped", "Python")}
    rows = spark.createDataFrame([("r", "f", 1, "GET /x"), ("r", "f", 2, "go"), ("r", "g", 1, "PUT /x")], "repo string, flow string, n int, label string")
    assert {(r.flow, r.n) for r in views.flow_named(rows, "GET", "/x").collect()} == {("f", 1), ("f", 2)}
    assert views.shown(spark.range(30).select(F.lit("r").alias("repo"), "id"), "impacts", ["id"]).count() == 12
    e = spark.createDataFrame([("a", {"kind": "x", "path": "y"}, "granted"), ("b", {}, "denied")], "name string, props map<string, string>, consent string")
    assert [(r.name, r.props) for r in telemetry.captured(e).collect()] == [("a", {"kind": "x"})]


def test_hot_key_and_one_line_file_take_linear_time(spark):
    """A hundred thousand requests of one key, and a script of two megabytes on one line, in seconds."""
    import time

    r = spark.range(100_000).select(F.lit("k").alias("key"), "id", (F.col("id") * 40).alias("ms"), F.lit(20).alias("max_n"))
    began = time.time()
    assert admission.admit(r, 60_000).where("allowed").count() == 20 * 67 and time.time() - began < 30
    line = "".join(f"function f{i}(a){{return g{i}(a)}};" for i in range(60_000))
    began = time.time()
    assert Analysis(made(spark, [("r", "m.js", line)])).script_symbols.count() == 60_001 and time.time() - began < 60
