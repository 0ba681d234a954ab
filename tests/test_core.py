"""Facts, resolution, graphs and admission on small inputs; queries against their SQL on the smallest tables."""

import hashlib
import hmac
import io
import os
import random
import tempfile
import zipfile
from collections import deque
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codestrata.functions import telemetry
from codestrata.functions.columns import matches, normal_path
from codestrata.operators import graphs, python_facts, resolve, script_facts
from codestrata.plans import catalog
from codestrata.plans.analysis import Analysis
from codestrata.sources import corpus, repository
from codestrata.streaming import admission

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Those that are run here; the rest take longer and are left to the driver's own comparison.
CHECKED = ["file_records", "language_shares", "discovered_files", "architecture_connections", "call_resolution", "short_dependency_cycles", "export_mermaid", "rate_limit_admission", "import_resolution", "mounted_routes", "onboarding_tour", "repository_listing", "dependency_cycles", "graph_metrics", "artifact_violations", "artifact_guard", "request_log", "error_responses", "sample_lookup", "ignored_files", "audit_whole", "incremental_stream", "event_time_admission", "sql_imports", "call_texts", "sql_calls", "pseudonymous_ids"]


def plain(x):
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "shape", ()) != ():
        return tuple(plain(v) for v in x)
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return None
    return round(x, 9) if isinstance(x, float) else x.item() if hasattr(x, "item") else x


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    both = [sorted((tuple(plain(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False)), key=repr) for f in (got, want)]
    assert both[0] == both[1]


def test_queries_stand_in_the_entry_file():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLE_SQL) <= set(entry.oracle_sql())


def test_matches_equal_finditer(spark):
    import re

    texts = ["a1 b22\n\nc333 d4", "", "no match", "x9", "\n\n7", "q1q2\nzz3 4 5\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = sorted((r.id, r.ord, r.line, r.before, r.m, r.g1) for r in matches(df, "text", r"(\d)\d*", 1, ["id"], left=True).collect())
    want = [(i, n, t.count("\n", 0, m.start()) + 1, t[t.rfind("\n", 0, m.start()) + 1 : m.start()], m[0], m[1]) for i, t in enumerate(texts) for n, m in enumerate(re.finditer(r"(\d)\d*", t))]
    assert got == sorted(want)


def test_normal_path(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../x",), ("",), ("a//b",), ("a/b/../../..",)], "p string")
    assert [r[0] for r in df.select(normal_path(F.col("p"))).collect()] == ["a/c", "x", "", "a/b", ""]


def test_python_facts_of_odd_files():
    assert python_facts.facts_of("def f(:")["error"] == "parse_error:SyntaxError:1"
    f = python_facts.facts_of("import a.b as c, d\nclass M(models.Model):\n    def m(self):\n        def inner(): g()\n@app.route('/x', methods=['GET', 'PUT'])\ndef h(): pass\npath('p/', v.w)\n")
    assert [(i["module"], i["names"]) for i in f["imports"]] == [("a.b", ["c"]), ("d", ["d"])]
    assert [(d["name"], d["parents"]) for d in f["defs"]] == [("M", []), ("m", ["M"]), ("inner", ["M", "m"]), ("h", [])]
    assert f["defs"][3]["decorators"] == [{"name": "app.route", "path": "/x", "methods": ["GET", "PUT"]}]
    assert [(c["callee"], c["owner"], c["first"], c["second"]) for c in f["calls"] if c["callee"] in ("g", "path")] == [("g", "M::m::inner", None, None), ("path", None, "p/", "v.w")]


def test_call_texts(spark):
    import ast

    found = lambda source: [(c["callee"], c["receiver"], c["arguments"], c["assigned_to"], c["argument_count"]) for c in python_facts.facts_of(source, texts=True)["calls"]]
    cases = {
        "x = f(1, b=2)": [("f", None, "1, b=2", "x", 2)],
        "a = b = f()": [("f", None, "", "b", 0)],
        "a.b = f()\ny: int = g ( )": [("f", None, "", None, 0), ("g", None, " ", "y", 0)],
        "x = f(g(*a, **k))": [("f", None, "g(*a, **k)", "x", 1), ("g", None, "*a, **k", None, 2)],
        "x = await_(f)(1)": [("await_", None, "1", "x", 1), ("await_", None, "f", None, 1)],
        "é = 'ß'; z = é.ü(\r\n 'ö',\r\n)": [("é.ü", "é", "\n 'ö',\n", "z", 1)],
        "(a\n .b\n .c (1))": [("a.b.c", "a\n .b", "1", None, 1)],
        "(f)(1)": [("f", None, None, None, 1)],
        "f \\\n (1)": [("f", None, "1", None, 1)],
        "x = f(i for i in y)": [("f", None, "i for i in y", "x", 1)],
        "(a + b).c()": [("c", "(a + b)", "", None, 0)],
        "@d(1)\ndef h(): return k('(', \")\")": [("d", None, "1", None, 1), ("k", None, "'(', \")\"", None, 2)],
        "def (": [], "": [],
    }
    for source, want in cases.items():
        assert sorted(found(source), key=str) == sorted(want, key=str), source
    # The parser's own texts of nodes, over the library's files.
    for path in sorted((Path(__file__).parent.parent / "codestrata/operators").glob("*.py")):
        source = path.read_text()
        own = [(c["receiver"], c["arguments"]) for c in python_facts.facts_of(source, texts=True)["calls"]]
        for node in ast.walk(ast.parse(source)):
            if isinstance(node, ast.Call) and python_facts.dotted(node.func):
                whole, f = ast.get_source_segment(source, node), ast.get_source_segment(source, node.func)
                receiver = f[: -len(node.func.attr)].rstrip()[:-1].rstrip() if isinstance(node.func, ast.Attribute) else None
                own.remove((receiver, whole[len(f) :].strip()[1:-1]))
        assert not own
    files = spark.createDataFrame([("r", "a.py", "def f():\n    x = g(1)\n"), ("r", "b.py", None), ("r", "c.py", ""), ("r", "d.py", "def ("), ("r", "e.js", "f()"), ("r", "long.py", "f(1)\n" * 2000)], "repo string, path string, content string")
    got = python_facts.call_texts(files).collect()
    assert len(got) == 2001 and [tuple(r)[3:] for r in got if r.file == "a.py"] == [("a.py::f", "g", None, "1", "x", 1, 2)]
    assert python_facts.call_texts(files.limit(0)).collect() == []


def test_python_routes_and_models(spark):
    source = "bp = Blueprint('x', __name__, url_prefix='/api/')\n@bp.route('/items/', methods=['POST'])\ndef f(): pass\n@bp.get('/')\ndef g(): pass\nclass A(SQLModel): pass\nclass B(pydantic.BaseModel): pass\nclass C(Plain): pass\nurlpatterns = [re_path('^a$', view)]\n"
    files = spark.createDataFrame([("r", "m.py", source)], "repo string, path string, content string")
    facts = python_facts.syntax(files)
    assert {(r.method, r.path, r.framework) for r in python_facts.routes(facts).collect()} == {("POST", "/api/items", "Flask"), ("GET", "/api", "FastAPI"), ("ANY", "/^a$", "Django")}
    assert {(r.name, r.type) for r in python_facts.symbols(facts).where("type <> 'function'").collect()} == {("m.py", "module"), ("A", "database_model"), ("B", "class"), ("C", "class")}


@pytest.mark.parametrize("call,want", [("use('/a', b)", ["'/a'", "b"]), ("use()", []), ("use(f(1, [2, 3]), {a: 1, b: ')'})", ["f(1, [2, 3])", "{a: 1, b: ')'}"]), ("use(`x,${y}`, // c, d\n z)", ["`x,${y}`", "// c, d\n z"]), ("use('open", None), ("use((1)", None)])
def test_split_arguments(call, want):
    assert script_facts.split_arguments(call, call.index("(")) == want


def test_import_candidates(spark):
    files = spark.createDataFrame([("r", p) for p in ("src/pkg/__init__.py", "src/pkg/a.py", "src/pkg/sub/b.pyi", "web/x/index.ts", "web/y.tsx")], "repo string, path string")
    rows = [("src/pkg/sub/c.py", 1, "..a", ["z"]), ("src/pkg/sub/c.py", 2, ".b", ["z"]), ("main.py", 3, "pkg.a", ["z"]), ("main.py", 4, "pkg", ["a"]), ("main.py", 5, "os", ["p"]), ("web/m.ts", 6, "./x", []), ("web/m.ts", 7, "~/y", []), ("web/m.ts", 8, "./none", []), ("web/m.ts", 9, "react", [])]
    imports = spark.createDataFrame([("r", *r) for r in rows], "repo string, file string, ord int, module string, names array<string>")
    aliases = spark.createDataFrame([("r", [("~", "web")])], "repo string, aliases array<struct<prefix: string, dest: string>>")
    got = {r.ord: (r.target, r.external) for r in resolve.resolve_imports(imports, files, aliases).collect()}
    assert got == {1: ("src/pkg/a.py", False), 2: ("src/pkg/sub/b.pyi", False), 3: ("src/pkg/a.py", False), 4: ("src/pkg/__init__.py", False), 5: (None, True), 6: ("web/x/index.ts", False), 7: ("web/y.tsx", False), 8: (None, False), 9: (None, True)}


def recursive_cycles(edges):
    graph, done, found = {}, set(), set()
    for a, b in edges:
        graph.setdefault(a, set()).add(b)

    def walk(node, path):
        if node in path:
            ring = path[path.index(node) :]
            found.add(min(tuple(ring[i:] + ring[:i]) for i in range(len(ring))))
        elif node not in done:
            done.add(node)
            for b in sorted(graph.get(node, ())):
                walk(b, [*path, node])

    for node in sorted(graph):
        walk(node, [])
    return [list(c) for c in sorted(found)]


def test_import_candidates_are_computed_once(spark):
    """An inner explode is filtered by the size of its array, which is then computed in each place; and a trace walks its flows once."""
    files = spark.createDataFrame([("r", "a/b.py")], "repo string, path string")
    rows = spark.createDataFrame([("r", "a/c.py", 1, "a.b", ["x"], None), ("r", "a/c.ts", 1, "react", [], None)], "repo string, file string, ord int, module string, names array<string>, target string")
    none = spark.createDataFrame([], "repo string, aliases array<struct<prefix: string, dest: string>>")
    out = resolve.resolve_imports(rows, files, none)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(regexp_replace(module") <= 2  # once for relative, once for absolute modules
    assert sorted((r.module, r.target, r.external) for r in out.collect()) == [("a.b", "a/b.py", False), ("react", None, True)]
    nodes = spark.range(4).select(F.lit("r").alias("repo"), (F.col("id") % 2).cast("string").alias("flow"), F.format_string("n%d", "id").alias("label"))
    found = graphs.trace(nodes.withColumn("label", F.upper("label")), "N3")
    assert "upper" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 2


def test_cycles_equal_recursive_walk():
    r = random.Random(4)
    for n in range(2, 40):
        edges = [(f"f{r.randrange(n):02d}", f"f{r.randrange(n):02d}") for _ in range(2 * n)]
        assert graphs.cycles_of(edges) == recursive_cycles(edges)


def test_flows_equal_queue_walk(spark):
    r = random.Random(6)
    symbols = [("r", f"f{i % 7}.py", i, f"s{i}", "function", f"n{i}", i + 1) for i in range(60)]
    calls = [("r", f"f{i % 7}.py", i, f"s{r.randrange(60)}", f"s{r.randrange(60)}" if r.random() < 0.9 else None) for i in range(260)]
    routes = [("r", "f0.py", f"route{i}", "GET", f"/p{i}", f"s{r.randrange(60)}" if i else "gone", 1) for i in range(25)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    nodes, edges = graphs.flows(df(routes, "repo string, file string, id string, method string, path string, handler string, line int"), df(calls, "repo string, file string, ord int, source string, target string"), df(symbols, "repo string, file string, ord int, id string, type string, name string, line int"))
    got = {}
    for x in sorted(nodes.collect(), key=lambda x: x.n):
        got.setdefault(x.flow, []).append(x.id)
    for _, _, flow, _, _, handler, _ in routes:
        want, seen, queue = [flow], {handler}, deque([(handler, 0)])
        want += [handler] if handler.startswith("s") else []
        while queue and len(want) < 12:
            at, depth = queue.popleft()
            for _, _, _, source, target in sorted(calls, key=lambda c: (c[1], c[2])) if depth < 5 else ():
                if source == at and target and target not in seen and len(want) < 12:
                    seen.add(target)
                    want.append(target)
                    queue.append((target, depth + 1))
        assert got[flow] == want
    assert all(e.type in ("handles", "calls") for e in edges.collect())


def test_known_flows_and_audit(spark):
    files = corpus.code_files(spark, SF).where("repo = 'src1/1'")
    a = Analysis(files)
    nodes, _ = a.flows
    labels = {r.flow: [x.label for x in sorted(r.rows, key=lambda x: x.n)] for r in nodes.groupBy("flow").agg(F.collect_list(F.struct("n", "label")).alias("rows")).collect()}
    want = {name: tuple(row[-1]) for row in catalog._FLOWS for name in [row[-1][0].replace("$ID", "1")]}
    assert {v[0] for v in labels.values()} == set(want)
    assert labels["route:backend/api/orders_1.py:9:GET:/v1/orders/{key}"][:2] == ["GET /v1/orders/{key}", "read_order"]
    assert a.audit().collect() == []
    assert a.totals.first().parse_rate > 0 and a.tour.count() == 6 and a.metrics.first().complexity > 0


def test_discovery_and_gitignore(spark):
    rows = [("a.py", b"x"), ("big.py", b"x" * 50), ("bin.py", b"a\0b"), ("node_modules/m.js", b"x"), ("pic.png", b"x"), ("out/gen.py", b"x"), ("keep/gen.py", b"x"), ("logs/deep/l.py", b"x"), ("sub/t.py", b"x"), ("sub/u.py", b"x"), (".gitignore", b"# c\ngen.py\n!keep/gen.py\nlogs/\n"), ("sub/.gitignore", b"/t.py\n"), ("Dockerfile", b"FROM x\r\n")]
    raw = spark.createDataFrame([("r", p, bytearray(c), len(c), False) for p, c in rows] + [("r", "node_modules/l", bytearray(), 0, True)], "repo string, path string, content binary, bytes long, symlink boolean")
    files, skipped = repository.discover(raw, repository.Limits(file_bytes=40))
    assert [r.path for r in files.orderBy("path").collect()] == ["Dockerfile", "a.py", "keep/gen.py", "sub/u.py"]
    assert files.where("path = 'Dockerfile'").first().content == "FROM x\n"
    assert sorted((r.path, r.reason) for r in skipped.collect()) == [("big.py", "file_size_limit"), ("bin.py", "binary"), ("node_modules/l", "symlink")]
    files, skipped = repository.discover(raw, repository.Limits(files=2, file_bytes=40))
    assert files.count() == 2 and ("*", "file_count_limit") in {(r.path, r.reason) for r in skipped.collect()}


def test_trees_and_archives(spark):
    root = tempfile.mkdtemp(dir="/tmp")
    os.makedirs(f"{root}/p/q")
    for p, text in (("p/a b.py", "1"), ("p/q/c.js", "2")):
        with open(f"{root}/{p}", "w") as f:
            f.write(text)
    assert sorted(r.path for r in repository.read_tree(spark, root, "r").collect()) == ["p/a b.py", "p/q/c.js"]

    def archive(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, n)
        return spark.createDataFrame([("r", bytearray(out.getvalue()))], "repo string, content binary")

    assert sorted(r.path for r in repository.read_zip(archive(["top/a.py", "top/d/b.py"])).collect()) == ["a.py", "d/b.py"]
    assert sorted(r.path for r in repository.read_zip(archive(["a.py", "d/b.py"])).collect()) == ["a.py", "d/b.py"]
    for bad in ("../x.py", "/abs.py", "C:/x.py", "a/../../b.py"):
        with pytest.raises(Exception, match="PATH_TRAVERSAL_DETECTED"):
            repository.read_zip(archive([bad, "ok.py"])).collect()
    with pytest.raises(Exception, match="ARCHIVE_TOO_LARGE"):
        repository.read_zip(archive(["a.py"]), repository.Limits(archive_bytes=10)).collect()


def test_admission(spark):
    times = [0, 1, 2, 3, 4, 5, 600_000, 600_001, 600_001]
    df = spark.createDataFrame([("k", i, t, 5) for i, t in enumerate(times)], "key string, id long, ms long, max_n int")
    got = [(r.allowed, r.remaining, r.retry_after) for r in admission.admit(df).orderBy("id").collect()]
    assert got == [(True, 4, None), (True, 3, None), (True, 2, None), (True, 1, None), (True, 0, None), (False, 0, 600), (True, 0, None), (True, 0, None), (False, 0, 1)]


def test_admission_stream_equals_batch(spark):
    folder = tempfile.mkdtemp(dir="/tmp")
    r = random.Random(3)
    rows = [(f"k{r.randrange(4)}", i, i * 40_000, 5) for i in range(120)]
    spark.createDataFrame(rows, "key string, id long, ms long, max_n int").coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("key string, id long, ms long, max_n int").parquet(f"{folder}/in")
    q = admission.admit_stream(stream).writeStream.format("memory").queryName("admitted").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(x) for x in spark.sql("SELECT id, allowed, remaining FROM admitted").collect())
    want = admission.admit(spark.createDataFrame(rows, "key string, id long, ms long, max_n int"))
    assert got == sorted(tuple(x) for x in want.select("id", "allowed", "remaining").collect())


def test_incremental(spark):
    files = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], "repo string, path string, hash string")
    cached = spark.createDataFrame([("r", "a", "1"), ("r", "b", "old"), ("r", "gone", "9")], "repo string, path string, hash string")
    hits, misses = admission.split_by_cache(files, cached)
    assert [x.path for x in hits.collect()] == ["a"] and [x.path for x in misses.collect()] == ["b"]
    assert sorted(x.path for x in admission.refreshed(cached, files, misses).collect()) == ["a", "b"]


def test_keyed_hash(spark):
    df = spark.createDataFrame([("x",), (None,)], "v string")
    assert [r[0] for r in df.select(telemetry.keyed_hash(F.col("v"), "s", 12)).collect()] == [hmac.new(b"s", b"x", hashlib.sha256).hexdigest()[:12], None]
