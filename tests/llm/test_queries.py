"""Queries against their SQL on the smallest tables, and the pipeline against a plain version of its stages."""

import hashlib
import re
import sys

import duckdb
import pytest

sys.path.insert(0, ".")
import corpus_pipeline
from codestrata.llm import queries

SF = "/root/testdata/sf0.001"


def result(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
    want = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)  # not through pandas, where a null is NA in some columns
    assert result(queries.QUERIES[name](spark, SF)) == want


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    """Every stage over the smallest tables and odd rows (repeated ids, nulls, copies, planted passages) against plain Python."""
    import public_tokenizers
    from tests.llm.test_text_operators import brute_components, brute_hits, brute_kept

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = [(r.doc_id, r.text) for r in docs.collect() if r.lang == "en" and r.text][:12]
    words = plain[3][1].split()[:60] + [f"own{i}" for i in range(40)]
    odd = [(9001, None), (9002, ""), (9003, "1234 ++ 77"), (plain[0][0], f"unlike text under a known id {' '.join(words[40:90])}"), (None, " ".join(words)), (None, " ".join([*words[:-1], "edit"]))]
    odd += [(9004, f"The start of it. {items[0][1]} And the end of it."), (9005, " ".join(words)), (9005, " ".join(words))]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in odd], docs.schema))

    def pairs(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    def stage(i, docs):
        out = corpus_pipeline.STAGES[i][1](spark, docs, SF)
        path = f"{tmp_path}/{corpus_pipeline.STAGES[i][0]}"
        out.write.parquet(path)
        assert out.columns == columns or i == 4
        return spark.read.parquet(path)

    before, known = pairs(docs), stage(0, docs)
    kept = pairs(known)
    lost = [x for x in before if x not in kept]
    assert {9001, 9002, 9003} <= {i for i, _ in lost} and all(x in before for x in kept)
    assert all(not re.search(r"[^\W\d_]", t or "") or len(t) < 200 for _, t in lost)  # clean texts stay

    unique = stage(1, known)
    numbered = [(n, t) for n, (_, t) in enumerate(sorted(kept, key=lambda x: (x[0] is None, x[0] or 0)))]
    lowered = [(n, re.sub("[A-Z]", lambda m: m[0].lower(), t), "s") for n, t in numbered]
    of = {n: c for n, _, c in brute_components(lowered)}
    ids = [x[0] for x in sorted(kept, key=lambda x: (x[0] is None, x[0] or 0))]
    left = pairs(unique)
    assert len(left) == len(set(of.values())) and all(x in kept for x in left)
    assert sorted((ids[c] for c in set(of.values())), key=repr) == sorted((i for i, _ in left), key=repr)

    cut = stage(2, unique)
    want = {(i, n - gone, digest) for i, n, gone, digest in brute_kept([(i, t, "s") for i, t in left], 35) if not gone or gone < n}
    got = {(i, len(t.split()), hashlib.sha256(b" ".join(t.encode().split())).hexdigest()) for i, t in pairs(cut)}
    assert got == want

    clean = stage(3, cut)
    assert pairs(clean) == sorted((x for x in pairs(cut) if not brute_hits(x[1], items)[1]), key=repr)
    assert 9004 not in {i for i, _ in pairs(clean)} and len(pairs(clean)) > 50

    packed = stage(4, clean).collect()
    t = queries.tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in packed) == sum(len(t.encode(x, add_special_tokens=False)) + 1 for _, x in pairs(clean) if x)


def test_pipeline_stages_of_nothing_and_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", "en", "s", 15), (3, "some other words here", "en", "s", 21), (3, "some other words here", "en", "s", 21)], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == []
        stage(spark, odd, SF).collect()
    assert corpus_pipeline.near_duplicates(spark, odd, SF).where("doc_id = 3").count() == 1


def test_near_duplicates_decide_by_row(spark):
    """Null ids and ids on rows of different texts: near copies go, and only they."""
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")

    def near(words, at):
        return " ".join([*words[:at], "EDIT", *words[at + 1 :]])

    rows = [(None, near(a, 0)), (None, near(a, 59)), (5, " ".join(a)), (7, " ".join(b)), (7, near(a, 1)), (9, " ".join(c)), (9, near(c, 0)), (None, "alone without any id"), (None, near(b, 59)), (None, None), (11, "twice the same"), (11, "twice the same")]
    rows += [(None, near([f"d{i}" for i in range(60)], at)) for at in (0, 59)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    plain = [x for x in got if x[0] != 9 and " d5 " not in (x[1] or "")]
    assert sorted(plain, key=repr) == sorted([(5, " ".join(a)), (7, " ".join(b)), (None, "alone without any id"), (None, None), (11, "twice the same")], key=repr)
    assert [x[0] for x in got if x not in plain] in ([9, None], [None, 9])


def test_stages_keep_columns_of_the_names_that_operators_add(spark):
    """A corpus with columns named like the operators' results keeps their values through every filtering stage."""
    words = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").select("text").first().text
    docs = spark.createDataFrame([(1, words, "en", "s", 5, "mine", 0.25, "h", "r", "k"), (2, words + " and more of it", "en", "s", 5, "yours", 0.5, "i", "t", "l")], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, hits string, repeats string, kept string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        for r in out.collect():
            assert (r.lang_pred, r.score, r.hits, r.repeats, r.kept) == (("mine", 0.25, "h", "r", "k") if r.doc_id == 1 else ("yours", 0.5, "i", "t", "l")), name
