"""Periodic runs, the quality classifier and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from codestrata.llm import periodic, quality, queries, spelling

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=12):
    """{(start, end): least period} by comparing every word with that p before it."""
    out = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_random_words_equal_all_comparisons():
    r = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(r.randint(1, 5)):
            words = [r.choice("ab" if r.random() < 0.7 else "abcdefgh") for _ in range(r.randint(0, 40))]
            if r.random() < 0.6:
                k = r.randint(1, 9)
                words += words[:k] * r.randint(1, 8) + words
            texts.append(" ".join(words).encode())
        least = r.choice([2, 5, 12, 20])
        for text, (n, rows, _) in zip(texts, periodic.found_in(texts, least), strict=True):
            assert n == len(text.split())
            assert sorted((s, e - s, p) for s, e, p in rows.tolist()) == brute_runs(text.split(), least)


def test_runs_across_blocks_and_slices(monkeypatch):
    texts = [b"", b"x " * 500, " ".join(f"w{i % 37}" for i in range(900)).encode(), b"\tone\x0btwo  three\n"]
    want = periodic.found_in(texts)
    monkeypatch.setattr(periodic, "BLOCK", 64)
    monkeypatch.setattr(periodic, "SLICE", 16)
    got = periodic.found_in(texts)
    assert [(n, r.tolist(), c) for n, r, c in got] == [(n, r.tolist(), c) for n, r, c in want]
    assert [r.tolist() for _, r, _ in got] == [[], [[0, 500, 1]], [[0, 900, 37]], []] and got[3][2] == b"one two three"


def test_colliding_hashes_are_found_out(monkeypatch):
    """Hashes that call everything equal fail verification, and others take their place."""
    real, drawn = periodic.Prefixes.equal, []

    class Blind(periodic.Prefixes):
        def __init__(self, words, kinds, seed):
            super().__init__(words, kinds, seed)
            drawn.append(seed)

        def equal(self, i, p, n):
            return np.ones(len(i), bool) if len(drawn) < 3 else real(self, i, p, n)

    monkeypatch.setattr(periodic, "Prefixes", Blind)
    text = b"a b c d e f a b c d e f a b c d e x y a b z"
    assert [tuple(x) for x in periodic.found_in([text])[0][1].tolist()] == [(0, 17, 6)] and len(drawn) == 3


def test_op11_query_equals_a_plain_version(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["aa", "bb", "c"] if i % 3 else [f"w{j}" for j in range(50)]) for _ in range(r.randint(0, 60)))) for i in range(120)]
    rows += [(None, "k " * 30), (500, None), (501, ""), (502, " \n\t "), (7, "dd " * 12), (7, "dd " * 12), (-11, "é ö é ö " * 9), (16, "one"), (59, None), (83, "")]
    assert sum(i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = queries.op11_periodic_runs(spark, str(tmp_path)).select(names)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((brute_row(*x) for x in rows), key=repr)


def test_op11_query_over_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = {d.doc_id for d in docs if len((d.text or "").split()) < 700}
    got = sorted(tuple(r) for r in queries.op11_periodic_runs(spark, SF).select(names).collect())
    assert len(got) == len(docs)
    assert [x for x in got if x[0] in short] == sorted(brute_row(*d) for d in docs if d.doc_id in short)


def test_runs_keep_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 20, "mine", 5)], "doc_id long, text string, runs string, n_words int")
    out = periodic.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "runs", "n_words"] and out.first().n_words == 5
    assert [tuple(x) for x in out.first().runs.runs] == [(0, 20, 1)] and out.first().runs.collapsed == "a"
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def plain_score(model, row):
    total = model.prior
    for t in range(len(model.feature)):
        node = 0
        while node < model.feature.shape[1]:
            node = 2 * node + (2 if row[model.feature[t, node]] > model.threshold[t, node] else 1)
        total += model.leaf[t, node - model.feature.shape[1]]
    return 1 / (1 + np.exp(-total))


def test_trees_learn_and_score_like_a_walk_from_node_to_node():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.train(x[:1000], y[:1000])
    score = model.score(x)
    assert np.allclose(score, [plain_score(model, r) for r in x])
    assert ((score[1000:] >= 0.5) == y[1000:]).mean() > 0.95
    assert quality.train(x[:0], y[:0]) is None
    assert (quality.train(x[:30], np.ones(30)).score(x) > 0.9).all()  # one label only


def test_statistics_by_hand():
    text = b"The cat. The cat!\nA dog | 42\nA dog | 42"
    got = dict(zip(quality.STATISTICS, quality.statistics([b"other", text, b""])[1], strict=True))
    words = text.split()
    assert got["log_words"] == pytest.approx(np.log1p(12)) and got["log_lines"] == pytest.approx(np.log1p(3)) and got["log_bytes"] == pytest.approx(np.log1p(len(text)))
    assert got["distinct_lines"] == pytest.approx(2 / 3) and got["distinct_words"] == pytest.approx(len(set(words)) / 12)
    assert got["commonest_word"] == pytest.approx(max(Counter(words).values()) / 12)
    assert got["distinct_pairs"] == pytest.approx(len(set(zip(words, words[1:], strict=False))) / 11)
    assert got["share_digit"] == pytest.approx(4 / len(text)) and got["share_newline"] == pytest.approx(2 / len(text))
    assert got["word_max"] == 4 and got["word_mean"] == pytest.approx(np.mean([len(w) for w in words]))
    p = np.array(list(Counter(text).values())) / len(text)
    assert got["byte_entropy"] == pytest.approx(-(p * np.log2(p)).sum())
    assert (quality.statistics([b""]) == 0).all() and quality.statistics([]).shape == (0, len(quality.STATISTICS))


def test_statistics_do_not_depend_on_neighbours(spark):
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    assert np.allclose(quality.statistics(texts), np.concatenate([quality.statistics([t]) for t in texts]))


def test_op12_is_right_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op12_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) >= 0.95
    bad = [a for a, b in held if b == 0]
    assert sum(a == 0 for a in bad) / len(bad) >= 0.85


def test_op12_does_not_learn_from_held_out_labels(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs.withColumn("lang", docs.source).write.parquet(f"{tmp_path}/documents.parquet")
    held = queries.quality_held_out()
    labels.withColumn("quality", queries.F.when(held, 1 - labels.quality).otherwise(labels.quality)).write.parquet(f"{tmp_path}/labels.parquet")
    a, b = (sorted(map(tuple, queries.op12_quality_classifier(spark, d).collect())) for d in (SF, str(tmp_path)))
    assert a == b


def test_quality_of_odd_rows(spark):
    good, bad = "These are plain words in a row of sentences. ", "BUY!! NOW!! $$$ ### "
    docs = spark.createDataFrame(
        [(i, (good if i % 2 else bad) * (1 + i % 5), 0.1, "x") for i in range(200)] + [(None, good, 0.1, None), (300, None, 0.2, None), (301, "", 0.2, None), (1, bad, 0.1, None), (1, good, 0.1, None)],
        "doc_id long, text string, score double, extra string",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(0, 0), (0, None), (None, 0), (9999, 1), (3, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.classify(docs, model).collect()
    assert len(out) == 205 and out[0].extra == "x" and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None and 150 <= r.doc_id < 200)
    assert {r.score for r in out if r.doc_id in (300, 301)} == {next(r.score for r in out if r.doc_id == 301)}
    assert quality.fit(docs, labels.limit(0)) is None and {(r.score, r.predicted) for r in quality.classify(docs, None).collect()} == {(0.5, 1)}
    assert quality.classify(docs.limit(0), model).collect() == []
    small = quality.fit(docs, labels, max_rows=20)  # a bounded draw, the same at every run
    assert np.array_equal(small.leaf, quality.fit(docs, labels, max_rows=20).leaf)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(count, times=5):
    """Every pair of words compared."""
    close = {w: sorted((v for v in count if near(w, v)), key=lambda v: (-count[v], v)) for w in count}
    form = {w: c[0] if c and count[c[0]] >= times * count[w] else None for w, c in close.items()}
    out = []
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, count[w], len(close[w]), count[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("seed,letters,most", [(1, "ab", 7), (2, "abc", 6), (3, "aàÿz", 5), (4, "a", 12)])
def test_variants_equal_all_comparisons(spark, seed, letters, most):
    r = random.Random(seed)
    count = {"".join(r.choice(letters) for _ in range(r.randint(1, most))): 5 ** r.randint(0, 5) for _ in range(160)}
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    got = spelling.variants(words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute_variants(count)


def test_light_edges_are_few(spark):
    """A word leaves the heavy way at log2(V) nodes at most, besides that where it ends."""
    r = random.Random(3)
    words = spark.createDataFrame([(w, 1) for w in {"".join(r.choice("abcd") for _ in range(r.randint(6, 12))) for _ in range(2000)}], "word string, n long")
    per_word = spelling.light_edges(words).where("c <> ''").groupBy("word").count().agg({"count": "max"}).first()[0]
    assert per_word <= np.log2(words.count())


def brute_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def test_op13_query_equals_a_plain_version(spark, tmp_path):
    r = random.Random(8)
    pool = ["letter", "Letters", "lettre", "LETTERED", "étagère", "étagères", "ÉTAGÈRE", "bookkeeper", "bokkeeper", "short", "xx×÷yyzz", "word_with", "abcdef1ghijkl"]
    rows = [(i, " ".join(r.choices(pool, [50, 9, 2, 3, 30, 5, 5, 40, 1, 9, 9, 9, 9], k=40))) for i in range(150)]
    rows += [(None, "letter letter Letters"), (None, None), (200, ""), (201, None), (3, rows[3][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_spelling_variants(spark, str(tmp_path)).collect()))
    assert got == brute_variants(brute_words(rows)) and any(w[1] for w in got)


def test_variants_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_spelling_variants(spark, str(tmp_path)).collect() == []
    assert queries.op11_periodic_runs(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts_of_short_and_long_texts_equal_the_library(name):
    """Texts below, at and above one chunk, in one batch."""
    import public_tokenizers
    from codestrata.llm import tokens

    t = tokens.load(public_tokenizers.path(name))
    n = tokens.CHUNK
    texts = ["A b  c", "", "<|startoftext|> x", "word " * (n // 5), "x" * n, "x y" * n, "é ö\n" * (n // 2), "one two three " * n]
    assert tokens.count_tokens(t, texts) == [len(t.encode(x, add_special_tokens=False)) for x in texts]


def test_unlike_texts_under_one_id_take_linear_time(spark):
    """5 000 unlike texts under one id, and two near ones: the same classes as under ids of their own, by hashes of id and text."""
    import time

    from codestrata.llm import jaccard

    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(12)) for _ in range(5000)]
    texts += [texts[7] + " " + " ".join(f"v{i}" for i in range(40)), texts[7] + " " + " ".join(f"v{i}" for i in range(39)) + " end"]
    began = time.time()
    found = jaccard.classes(spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")).collect()
    assert len(found) == len(texts) and {x.component_id for x in found} == {1} and time.time() - began < 150
    links = jaccard.links(spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string"))[1]
    assert links.count() == 1
