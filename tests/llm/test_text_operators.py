"""Decontamination, substring dedup and Jaccard classes against brute force, and their edge cases."""

import hashlib
import os
import pathlib
import random
import re
import subprocess
import sys
from collections import Counter

import pyarrow as pa
import pytest

from codestrata.llm import common, decontam, jaccard, substrings

DOCS = "doc_id long, text string, source string"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    base = words(150, 1)
    rows = [(i, " ".join(words(60 + i, 100 + i)), "s") for i in range(30)]
    for i in range(40):  # near copies with edits
        w = list(base)
        for k in range(i % 5):
            w[(17 * k + 7 * i) % 150] = f"edit{i}_{k}"
        rows.append((100 + i, " ".join(w), "hot"))
    rows += [(200, " ".join(base), None), (201, None, "s"), (202, "", "s"), (203, " \n\t ", "s"), (204, "just three words", "s"), (205, "just three words", "s")]
    rows += [(206, " ".join(words(5000, 9, 50000)), "long"), (207, "é " * 80, "s"), (None, "no id here but text " * 3, "s")]
    rows += [(300, "the same row " * 20, "s")] * 2
    passage = " ".join(words(45, 77))
    rows += [(400 + i, f"{' '.join(words(30, 500 + i))} {passage} {' '.join(words(20, 600 + i))}", "s") for i in range(12)]
    return rows


def brute_components(rows, n=5, percent=80):
    sets = []
    for _, text, _ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (key, _, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(s), least.get(find(i)) if s else key) for i, ((key, _, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def test_jaccard_classes_equal_brute_force(spark, docs):
    got = jaccard.classes(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_components(docs)


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_group_of_near_copies(spark, seed):
    """Many copies with few or many edits around one text, so that some link to the centre and others only among themselves."""
    r = random.Random(seed)
    base = words(80, seed, 5000)
    rows = []
    for i in range(120):
        w = list(base)
        for at in r.sample(range(80), r.choice([0, 1, 1, 2, 2, 3, 4, 5])):
            w[at // (1 + seed) * (1 + seed) % 80] = r.choice([f"x{at}", f"y{i}"])
        rows.append((i, " ".join(w), "s"))
    got = jaccard.classes(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_components(rows)


def test_jaccard_links_are_all_pairs_of_sets(spark, docs):
    member, pairs = jaccard.links(spark.createDataFrame(docs, DOCS))
    of = {r.k: r.key for r in member.where("size > 0 AND key IS NOT NULL").collect()}
    text = {k: t for k, t, _ in docs}
    got = {frozenset((r.a, r.b)) for r in pairs.collect()}
    shingles = {k: {tuple(text[i].split()[j : j + 5]) for j in range(max(1, len(text[i].split()) - 4))} for k, i in of.items()}
    want = {frozenset((a, b)) for a in shingles for b in shingles if a < b and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])}
    assert {p for p in got if all(x in of for x in p)} == want


def test_jaccard_empty_table_and_string_keys(spark):
    assert jaccard.classes(spark.createDataFrame([], DOCS)).collect() == []
    df = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), ("c", None)], "doc_id string, text string")
    assert sorted(tuple(r) for r in jaccard.classes(df).collect()) == [("a", 2, "a"), ("b", 2, "a"), ("c", 0, "c")]


def brute_kept(rows, window):
    texts = [(t or "").encode().split() for _, t, _ in rows]
    count = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (key, _, _), w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [60, 35, 3])
def test_substrings_equal_brute_force(spark, docs, window):
    # Clashing and extra columns stay as they are; rows come out once each.
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], DOCS + ", key int, places string")
    got = substrings.remove_repeats(df, window=window)
    assert set(df.columns) < set(got.columns)
    found = sorted(((r.doc_id, r.repeats.n_words, r.repeats.n_removed, hashlib.sha256(b" ".join(r.repeats.kept.encode().split())).hexdigest()) for r in got.collect()), key=repr)
    assert found == brute_kept(docs, window)


def test_substrings_keep_layout_and_handle_nothing(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    long = " ".join(f"p{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"keep\n\nthis  line {long}\ntail", "s"), (2, long, "s")], DOCS)
    kept = {r.doc_id: r.repeats.kept for r in substrings.remove_repeats(df).collect()}
    assert kept == {1: "keep\n\nthis  line tail", 2: ""}
    with pytest.raises(ValueError):
        substrings.levels_of(2)
    assert substrings.levels_of(35) == [9, 18, 35] and substrings.levels_of(100) == [7, 13, 25, 50, 100]
    same = spark.createDataFrame([(1, long, "s")] * 50 + [(None, None, "s")] * 50, DOCS)
    assert {(r.doc_id, r.repeats.kept) for r in substrings.remove_repeats(same).collect()} == {(1, ""), (None, "")}
    alone = spark.createDataFrame([(1, long, "s"), (2, "a " * 5, "s")], DOCS)  # no candidate survives the first level
    assert {r.repeats.n_removed for r in substrings.remove_repeats(alone).collect()} == {0}


def brute_hits(text, items, window=10):
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    w, hit, ids = find(text), set(), set()
    for key, item in items:
        v = find(item)
        for i in range(max(1, len(v) - window + 1)) if v else ():
            x = v[i : i + window]
            for j in range(len(w) - len(x) + 1):
                if w[j : j + len(x)] == x:
                    hit.update(range(j, j + len(x)))
                    ids.add(str(key))
    return len(w), len(hit), sorted(ids)


def test_decontamination_equals_brute_force(spark, docs):
    base = docs[3][1].split()
    items = [(1, " ".join(base[5:25]).upper()), (2, "Just three WORDS!"), (3, None), (4, "?!"), (5, "no match anywhere in these texts at all my dear friend yes"), (11, "just, three; words"), (6, "É é")]
    texts = docs + [(500, f"x.{'-'.join(base[5:16])}", "s"), (501, "Just   three\nwords just three words", "s")]
    df = spark.createDataFrame([(*t, 5) for t in texts], DOCS + ", hits int")  # a clashing column is replaced
    got = decontam.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in got:
        assert (r.hits.n_words, r.hits.n_hit, r.hits["items"]) == brute_hits(r.text, items)
        for s in r.hits.spans:  # offsets are those of the original text
            assert decontam.words_of(r.text.encode()[s.start : s.end])
    spans = {r.doc_id: r.text.encode()[r.hits.spans[0].start : r.hits.spans[-1].end].decode() for r in got if r.hits.n_hit}
    assert spans[501] == "Just   three\nwords just three words" and spans[500] == "-".join(base[5:16])


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b", "s"), (2, None, "s")], DOCS)
    assert [tuple(r.hits)[:2] for r in decontam.decontaminate(df, none).orderBy("doc_id").collect()] == [(2, 0), (0, 0)]
    assert decontam.decontaminate(spark.createDataFrame([], DOCS), none).collect() == []
    machine = decontam.Machine([(str(i), f"item number {i} has some words of its own here and there".encode()) for i in range(50)], 10)
    assert decontam.scan(b"item number 7 has some words of its own here", machine)[2] == ["7"]


def test_decontamination_with_many_words_and_long_items():
    """More words than single letters, and items in parts: as one item says without parts."""
    rng = random.Random(7)
    items = [(str(i), " ".join(f"w{min(rng.randrange(3000), rng.randrange(3000))}" for _ in range(rng.choice((3, 9, 10, 400))))) for i in range(40)]
    texts = [" ".join(items[i][1].split()[3:k] + ["unseen", "w1"] + items[-1 - i][1].split()[-12:]) for i in range(40) for k in (9, 14, 200)]
    parts = [(k, p) for k, t in items for p, _ in decontam.parts_of(t.encode(), 10, most=50)]
    assert len(parts) > len(items)
    whole, cut = decontam.Machine([(k, t.encode()) for k, t in items], 10), decontam.Machine(parts, 10)
    assert len(whole.letters) > decontam.SHORT and len(whole.ids) == len(cut.ids)
    for t in texts:
        assert decontam.scan(t.encode(), whole) == decontam.scan(t.encode(), cut)
        assert decontam.scan(t.encode(), whole)[:3] == brute_hits(t, items)


def test_decontamination_bounds_memory_by_nodes(spark, tmp_path):
    """A benchmark of 20 MB is dealt into blocks; the automaton of a block takes under a gigabyte, its text and words included."""
    lines = spark.range(2000).selectExpr("cast(id as string) AS id", "array_join(transform(sequence(0, 1299), i -> hex(xxhash64(id, i) % 3000000)), ' ') AS t").selectExpr("id", "cast(t as binary) AS text")
    assert lines.selectExpr("sum(octet_length(text))").first()[0] > 20e6
    blocks = decontam.blocks_of(lines, 10, decontam.NODES)
    assert len(blocks) > 4
    first = f"{tmp_path}/block"
    blocks[0].coalesce(1).write.parquet(first)
    code = (
        "import resource, sys, pyarrow.parquet as pq\nfrom codestrata.llm import decontam\n"
        "t = pq.read_table(sys.argv[1]).to_pydict()\nm = decontam.Machine(list(zip(t['id'], t['text'])), 10)\n"
        "assert decontam.scan(b'x ' + t['text'][0], m)[2] == [t['id'][0]]\n"
        "print(m.automaton.get_stats()['nodes_count'], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    )
    root = pathlib.Path(__file__).parents[2]
    nodes, kilobytes = map(int, subprocess.run([sys.executable, "-c", code, first], cwd=root, capture_output=True, text=True, check=True).stdout.split())
    assert nodes < 1.2 * decontam.NODES and kilobytes < 1 << 20


def test_decontamination_of_a_large_benchmark_in_blocks(spark, docs):
    """A benchmark beyond the limit, taken in blocks, gives what one automaton gives."""
    items = [(i, " ".join(docs[i][1].split()[j : j + 14])) for i in range(12) for j in (3, 9, 15)] + [(None, "just three words")]
    df, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    one, many = decontam.decontaminate(df, b), decontam.decontaminate(df, b, limit=900)
    assert len(decontam.blocks_of(b.selectExpr("cast(item_id as string)", "cast(text as binary)").toDF("id", "text"), 10, 900)) > 2
    assert sorted(map(repr, many.collect())) == sorted(map(repr, one.collect()))


def test_decontamination_counts_items_without_id(spark):
    """Items whose id is null hit, as in the SQL: counted, and left out of the joined ids."""
    long = " ".join(f"b{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"x {long} y"), (2, f"z {long} short item"), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, long), (None, "b1 b2"), (7, "short item")], "item_id long, text string")
    got = {r.doc_id: r.hits for r in decontam.decontaminate(docs, items).collect()}
    assert {k: (h.n_hit, h["items"], len(h.spans)) for k, h in got.items()} == {1: (12, [None], 1), 2: (14, ["7", None], 1), 3: (0, [], 0)}


def test_decontamination_query_equals_sql_with_null_ids(spark, tmp_path):
    import duckdb

    from codestrata.llm import queries

    long = " ".join(f"b{i}" for i in range(12))
    spark.createDataFrame([(1, f"x {long} y"), (2, f"z {long} short item"), (3, "clean")], DOCS[: DOCS.index(", source")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, long), (7, "short item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.op1_decontamination(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.OP1_SQL})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_tasks_give_their_memory_back():
    """A worker that loads a tokenizer and counts in several tasks keeps little of what they took (some 70 MB when it is left to the C heap)."""
    code = """
import re
import pyarrow as pa
import public_tokenizers
from codestrata.llm import common, tokens

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

@common.tidy
def run(batches):
    tokenizer = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    for texts in batches:
        yield tokens.count_tokens(tokenizer, texts)

import tokenizers
before = held()
for _ in range(2):
    assert sum(map(sum, run([["one two %d three" % i for i in range(2000)]] * 5))) > 0
print(held() - before)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": os.pathsep.join([root, *sys.path])}, capture_output=True, text=True, check=True)
    assert float(out.stdout.split()[-1]) < 40


def test_every_task_of_texts_gives_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.record_batch({"__key": pa.array([1]), "__text": pa.array([b"a b c"])})
    assert list(jaccard._batches(2, lambda *_: None)([batch])) == [] and len(calls) == 1
    assert list(substrings.anchor_rows(35)([batch])) == [] and len(calls) == 2
