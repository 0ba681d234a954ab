"""Algorithms that must not put a whole repository into one task, against plain versions and at sizes that one task would not take."""

import fnmatch
import random
import time

from pyspark.sql import functions as F

from codestrata.functions.prefix import running_total
from codestrata.operators import graphs, mounts, resolve
from codestrata.sources import repository


def test_cycles_by_component_equal_the_walk(spark):
    """Random graphs of many shapes, each a repository: the entry of every component decides which cycles are closed."""
    r = random.Random(9)
    rows = []
    for g in range(80):
        n = r.randint(2, 9)
        rows += [(f"g{g}", f"n{r.randrange(n):02d}", f"n{r.randrange(n):02d}") for _ in range(int(n * r.choice([0.8, 1.2, 1.6, 2.5])))]
    imports = spark.createDataFrame(rows, "repo string, file string, target string")
    got = sorted((x.repo, tuple(x.cycle)) for x in graphs.dependency_cycles(imports, most=0).collect())
    want = sorted((g, tuple(c)) for g in {x[0] for x in rows} for c in graphs.cycles_of([x[1:] for x in rows if x[0] == g]))
    assert got == want and len(want) > 100
    assert sorted((x.repo, tuple(x.cycle)) for x in graphs.dependency_cycles(imports).collect()) == want


def test_cycles_of_a_repository_of_many_files(spark):
    """10^5 files: groups are components, here of 3 files, whatever hangs above and below them."""
    n = 100_000
    ring = [("r", f"f{i:06d}", f"f{i - i % 3 + (i + 1) % 3:06d}") for i in range(0, 3000)]
    down = [("r", f"f{i:06d}", f"f{i % 3000 + 3000 * (i > 50_000):06d}") for i in range(3000, n)]
    imports = spark.createDataFrame(ring[:2998] + down, "repo string, file string, target string")
    found = graphs.dependency_cycles(imports, most=50_000).collect()
    assert sorted(tuple(x.cycle) for x in found) == [tuple(f"f{i + k:06d}" for k in range(3)) for i in range(0, 2997, 3)]
    sizes = graphs.strong_components(imports.select("repo", F.col("file").alias("a"), F.col("target").alias("b"))).groupBy("component").count()
    assert sizes.agg(F.max("count")).first()[0] == 3


def test_short_cycles_of_dense_repositories_move_edges_alone(spark):
    """Both ways against plain search, and a repository of 40 000 edges in which 2 million paths of three files would be shuffled."""
    r = random.Random(8)
    edges = [(g, f"é{r.randrange(9)}", f"é{r.randrange(9)}") for g in "xyz" for _ in range(40)] + [("x", "b", None)]
    want = set()
    for g in "xyz":
        out = {}
        for _, a, b in {e for e in edges if e[0] == g and e[2]}:
            out.setdefault(a, set()).add(b)
        todo = [(a,) for a in out]
        while todo:
            p = todo.pop()
            want |= {(g, p)} if p[0] in out.get(p[-1], ()) else set()
            todo += [(*p, b) for b in out.get(p[-1], ()) if len(p) < 4 and b > p[0] and b not in p]
    e = spark.createDataFrame(edges, "repo string, file string, target string")
    for most in (1, 50, 100_000):
        got = [(x.repo, tuple(x.cycle)) for x in graphs.short_cycles(e, 4, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    n = F.col("id")
    dense = spark.range(40_000).select(F.lit("r").alias("repo"), F.format_string("f%03d", n % 200).alias("file"), F.format_string("f%03d", F.floor(n / 200)).alias("target")).where("hash(file, target) % 4 = 0")
    plan = graphs.short_cycles(dense, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "FlatMapGroupsInArrow" in plan
    assert graphs.short_cycles(dense, 3).count() == graphs.short_cycles(dense, 3, 1).count() > 10_000


def test_calls_resolve_alike_within_a_task_and_by_joins(spark):
    """Both ways against each other, with null names and repositories, repeated symbols and modules; the pairs of calls and imports are not shuffled."""
    r = random.Random(12)
    pick = lambda *x: r.choice(x)
    repos = lambda: pick("x", "y", "z", None)
    symbols = [(repos(), f"f{r.randrange(8)}", pick("a", "b", "c", "d", f"n{i}", None), pick("function", "class", "module"), f"s{i}") for i in range(120)]
    imports = [(repos(), f"f{r.randrange(8)}", pick(f"f{r.randrange(8)}", None)) for _ in range(60)]
    calls = [(repos(), f"f{r.randrange(9)}", i, pick("a", "o.a", "b", "p.q.b", "c", "o.c", "o.d", f"n{r.randrange(120)}", f"o.n{r.randrange(120)}", "", "o.", None), "old") for i in range(600)]
    s = spark.createDataFrame(symbols, "repo string, file string, name string, type string, id string")
    i = spark.createDataFrame(imports, "repo string, file string, target string")
    c = spark.createDataFrame(calls, "repo string, file string, ord long, callee string, target string")
    got = [sorted(map(tuple, resolve.resolve_calls(c, s, i, most).select("repo", "file", "ord", "callee", "target", "confidence").collect()), key=repr) for most in (10**6, 200, 0)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 600 and len({x[-1] for x in got[0]}) == 5
    found = []
    for query, ids in (("N", True), ("a", False), ("s1", True)):
        hit = graphs.hits(query, s, ids)
        few = resolve.resolve_calls_to(hit, c, s, i)
        wanted = {(x.repo, x.id) for x in hit.collect()}
        want = [x for x in got[0] if (x[0], x[4]) in wanted]
        assert [x for x in sorted(map(tuple, few.select("repo", "file", "ord", "callee", "target", "confidence").collect()), key=repr) if (x[0], x[4]) in wanted] == want and few.count() < 600
        found += want
    assert len(found) > 5
    assert "SortMergeJoin" not in resolve.resolve_calls(c, s, i)._jdf.queryExecution().executedPlan().toString()


def test_running_total_of_giant_and_small_groups(spark):
    r = random.Random(1)
    rows = [("giant" if r.random() < 0.7 else f"g{r.randrange(40)}", i, r.choice([None, 0, 5, 17])) for i in range(5000)]
    df = spark.createDataFrame(rows, "repo string, n int, v long").repartition(7)
    total, want = {}, {}
    for g, i, v in rows:
        total[g] = total.get(g, 0) + (v or 0)
        want[i] = total[g]
    out = running_total(df, "repo", ["n"], "v")
    assert {x.n: x.total for x in out.collect()} == want and out.columns == ["repo", "n", "v", "total"] or set(out.columns) == {"repo", "n", "v", "total"}


def test_caps_move_no_contents(spark):
    """The running total and the caps of a repository leave contents where they lie."""
    files = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "big").otherwise(F.concat(F.lit("r"), F.col("id") % 11)).alias("repo"), F.format_string("d/f%05d.py", "id").alias("path"), F.repeat(F.lit("x"), 50).alias("content"), F.lit(50).cast("long").alias("bytes"), F.col("id").alias("file_ord"))
    out = repository.capped(files, 20_000)
    assert {x.repo: x.n for x in out.groupBy("repo").agg(F.count("*").alias("n")).collect()}["big"] == 400
    assert out.where("repo = 'big'").agg(F.max("file_ord")).first()[0] == sorted(i for i in range(3000) if i % 3)[399]
    assert repository.capped(files, 10**9).count() == 3000
    plans = [out._jdf.queryExecution().executedPlan().toString()]
    raw = files.select("repo", "path", F.col("content").cast("binary").alias("content"), "bytes", F.lit(False).alias("symlink"))
    kept, skipped = repository.discover(raw, repository.Limits(files=100), gitignore=False)
    assert kept.where("repo = 'big'").count() == 100 and kept.where("repo = 'big'").agg(F.max("path")).first()[0] == f"d/f{sorted(i for i in range(3000) if i % 3)[99]:05d}.py"
    assert {(x.repo, x.reason) for x in skipped.collect()} == {("big", "file_count_limit")}
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert all("Window" not in p and "hashpartitioning" not in p for p in plans)


def plain_prefixes(found):
    """{file: prefixes} by passes over (file, target, prefix) in order, one more than there are mounts."""
    at = {f: {""} for f, _, _ in found if f not in {t for _, t, _ in found}}
    tops = set(at)
    for _ in range(len(found) + 1):
        for f, t, p in found:
            for own in list(at.get(f, ())):
                parts = [x.strip("/") for x in (own, p) if x not in ("", "/")]
                at.setdefault(t, set()).add("/" + "/".join(parts))
    return {(f, p) for f, ps in at.items() if f not in tops for p in ps}


def _resolved(spark, repos):
    rows = [(g, f, i, t, p) for g, found in repos.items() for i, (f, t, p) in enumerate(found)]
    return spark.createDataFrame(rows, "repo string, file string, ord int, target string, prefix string")


def test_prefixes_equal_passes_over_the_mounts(spark):
    r = random.Random(12)
    repos = {"circle": [("a", "b", "/b"), ("b", "c", "/c"), ("c", "b", "/d")], "back": [("a", "c", "/x"), ("b", "c", "/c"), ("c", "b", "/d")], "alone": [("a", "b", "/"), ("b", "a", "/q")]}
    for g in range(25):
        n = r.randint(2, 6)
        # Mounts are in the order of their files.
        repos[f"g{g}"] = sorted(((f"f{r.randrange(n)}", f"f{r.randrange(n)}", r.choice(["/", "/a", "/b/", "/c"])) for _ in range(r.randint(1, 5))), key=lambda x: x[0])
        repos[f"g{g}"] = [x for x in repos[f"g{g}"] if x[0] != x[1]]
    got = {(x.repo, x.file, x.prefix) for x in mounts.prefixes(_resolved(spark, repos)).collect()}
    assert got == {(g, *x) for g, found in repos.items() for x in plain_prefixes(found)}


def test_diamonds_of_mounts_cost_a_row_a_file(spark):
    """20 diamonds at '/' have 2^20 ways and 60 files."""
    found = [x for i in range(20) for side in "bc" for x in ((f"a{i:02d}", f"{side}{i:02d}", "/"), (f"{side}{i:02d}", f"a{i + 1:02d}", "/"))]
    got = mounts.prefixes(_resolved(spark, {"r": sorted(found)})).collect()
    assert len(got) == 60 and {x.prefix for x in got} == {"/"}


def plain_ignored(paths, rules):
    """Paths whose last matching rule (base, line), in the order of depth, base and place, is no exception."""
    out = set()
    for path in paths:
        verdict = None
        for _, base, _, line in sorted((len([p for p in b.split("/") if p]), b, n, x) for n, (b, x) in enumerate(rules)):
            if base and not path.startswith(base + "/"):
                continue
            negated, body = line.startswith("!"), line.lstrip("!").strip()
            of_dirs, body = body.endswith("/"), body.rstrip("/")
            anchored, pattern = "/" in body, body.lstrip("/")
            parts = (path[len(base) + 1 :] if base else path).split("/")
            dirs = ["/".join(parts[:i]) for i in range(1, len(parts))]
            tried = dirs if of_dirs else ["/".join(parts)]
            if anchored:
                hit = any(fnmatch.fnmatchcase(t, pattern) or fnmatch.fnmatchcase(t, "**/" + pattern) for t in tried)
            else:
                hit = any(fnmatch.fnmatchcase(p, pattern) for p in (parts[:-1] if of_dirs else parts))
            verdict = negated if hit else verdict
        if verdict is False:
            out.add(path)
    return out


def test_ignore_rules_equal_trying_all(spark):
    r = random.Random(3)
    names = ["a", "b", "lib", "x.py", "y.py", "x.min.js", "gen", ".env", "z"]
    paths = sorted({"/".join(r.choice(names) for _ in range(r.randint(1, 5))) for _ in range(250)})
    shapes = ["{n}", "{n}/", "/{n}", "{n}/{m}", "{n}/{m}/", "*.py", "*.js/", "*.p?", "/*/{n}", "{n}/*", "[ab]", "**/{n}", "*", "{n}*/", "*.min.js", "*.env"]
    want, rows, trees = set(), [], []
    for g in range(12):
        rules = []
        for _ in range(r.randint(1, 9)):
            line = r.choice(shapes).format(n=r.choice(names), m=r.choice(names))
            rules.append((r.choice(["", "", "a", "lib/a", "b"]), ("!" if r.random() < 0.3 else "") + line))
        # Within a file the order of lines counts, between files depth and name.
        for base in {b for b, _ in rules}:
            rows.append((f"g{g}", f"{base}/.gitignore".lstrip("/"), bytearray("\n".join(x for b, x in rules if b == base).encode())))
        trees += [(f"g{g}", p) for p in paths]
        want |= {(f"g{g}", p) for p in plain_ignored(paths, [x for b in sorted({b for b, _ in rules}) for x in rules if x[0] == b])}
    rules = repository.gitignore_rules(spark.createDataFrame(rows, "repo string, path string, content binary"))
    kept = repository.apply_gitignore(spark.createDataFrame(trees, "repo string, path string"), rules)
    assert {tuple(x) for x in kept.collect()} == set(trees) - want and len(want) > 300


def test_ten_thousand_ignore_rules(spark):
    """Plain names, endings and paths are met by equality: no pair of a path and a rule that does not fit is made."""
    lines = [f"f{i}.py" if i % 3 == 0 else f"d{i % 50}/f{i}.py" if i % 3 == 1 else f"*.e{i}" for i in range(10_000)]
    raw = spark.createDataFrame([("r", ".gitignore", bytearray("\n".join(lines).encode()))], "repo string, path string, content binary")
    files = spark.range(20_000).select(F.lit("r").alias("repo"), F.format_string("d%d/f%d.%s", F.col("id") % 50, "id", F.when(F.col("id") % 2 == 0, F.lit("py")).otherwise(F.concat(F.lit("e"), F.col("id")))).alias("path"))
    kept = {x.path for x in repository.apply_gitignore(files, repository.gitignore_rules(raw)).collect()}
    want = {f"d{i % 50}/f{i}.{'py' if i % 2 == 0 else f'e{i}'}" for i in range(20_000) if i >= 10_000 or not (i % 2 == 0 and i % 3 in (0, 1) or i % 2 and i % 3 == 2)}
    assert kept == want


def test_wild_ignore_rules_are_met_by_their_literal_pieces(spark):
    """Ten thousand rules with wildcards against twenty thousand paths: pairs are made of equal pieces alone, whichever piece a rule has."""
    lines = [(f"f{i}.*", f"d{i % 50}/f{i}.*", f"*_{i}_?", f"/d?/*{i}.md")[i % 4] for i in range(10_000)] + ["!*[7]*.x", "f1[0-2]*.y*/"]
    raw = spark.createDataFrame([("r", ".gitignore", bytearray("\n".join(lines).encode()))], "repo string, path string, content binary")
    rules = repository.gitignore_rules(raw)
    names = spark.range(20_000).select(F.lit("r").alias("repo"), F.format_string("d%d/f%d.x", F.col("id") % 50, "id").alias("path"))
    names = names.unionByName(spark.createDataFrame([("r", p) for p in ("a/b_6_c", "a/b_6_cc", "d1/x7.md", "d11/x7.md", "e/d1/q/007.md", "f11.yz/a", "f13.yz/a", "a/f14.y", "[a/x")], "repo string, path string"))
    began = time.time()
    got = {x.path for x in repository.apply_gitignore(names, rules).collect()}
    assert time.time() - began < 60
    ignored = lambda i: i < 10_000 and i % 4 in (0, 1) and "7" not in f"f{i}"
    want = {f"d{i % 50}/f{i}.x" for i in range(20_000) if not ignored(i)} | {"a/b_6_cc", "d11/x7.md", "f13.yz/a", "a/f14.y", "[a/x"}
    assert got == want


def test_audit_of_all_rules_equals_joins(spark):
    """All 23 rules at once against a plain look-up, with null keys, repeated rows and flows of equal node names."""
    from codestrata.operators import quality

    r = random.Random(2)
    text = lambda pool, null=0.1: None if r.random() < null else r.choice(pool)
    data, schema = {}, {}
    columns = {}
    for t, c, o, k in quality.REFERENCES:
        columns.setdefault(t, set()).add(c)
        columns.setdefault(o, set()).add(k)
    for t, c, _ in quality.RANGES:
        columns.setdefault(t, set()).add(c)
    for t, ks in quality.KEYS:
        columns.setdefault(t, set()).update(ks)
    columns["flow_edges"].add("flow")
    numbers = {c for _, c, _ in quality.RANGES}
    for t, cs in columns.items():
        cs = sorted(cs)
        schema[t] = ", ".join(["repo string"] + [f"{c} {'double' if c in numbers else 'string'}" for c in cs])
        data[t] = [{"repo": r.choice("rs")} | {c: r.choice([-1.0, 0.0, 0.5, 1.0, 200.0, None]) if c in numbers else text([f"k{i}" for i in range(8)]) for c in cs} for _ in range(12)]
    got = {t: spark.createDataFrame([tuple(x.values()) for x in rows], schema[t]) for t, rows in data.items()}
    found = sorted(tuple(x) for x in quality.violations(got).select("repo", "rule", "key").where("rule NOT LIKE '%>=%' AND rule NOT LIKE '%BETWEEN%'").collect())
    want = []
    for t, c, o, k in quality.REFERENCES:
        flow = (lambda x: x["flow"]) if t == "flow_edges" else (lambda x: None)
        there = {(x["repo"], flow(x), x[k]) for x in data[o]}
        want += [(g, f"{t}.{c} -> {o}.{k}", v) for g, f, v in {(x["repo"], flow(x), x[c]) for x in data[t] if x[c] is not None} if (g, f, v) not in there]
    for t, ks in quality.KEYS:
        keys = [(x["repo"], *(x[k] for k in ks)) for x in data[t]]
        want += [(k[0], f"{t} unique ({', '.join(ks)})", "/".join(v for v in k[1:] if v is not None)) for k in set(keys) if keys.count(k) > 1]
    assert found == sorted(want) and len(want) > 20
    ranges = quality.violations(got).where("rule LIKE '%>=%' OR rule LIKE '%BETWEEN%'").count()
    assert ranges == quality.out_of_range(got).count() > 10
