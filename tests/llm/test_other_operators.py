"""Licences, language ID, shards, packing, token counts, audio and HTML."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codestrata.llm import audio, html, langid, licenses, packing, queries, shards, tokens
from codestrata.llm.common import connected_components

SF = "/root/testdata/sf0.001"


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (7, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10} | {100 + i: 100 for i in range(41)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_licenses(spark):
    files = [
        (1, "r/a/LICENSE", "Released under the MIT License.\nmore"), (2, "r/a/b/c.txt", "plain text"), (3, "r/a/b/d.txt", "x\nLicensed under the Apache License, Version 2.0."),
        (4, "r/e.txt", "nothing"), (5, "r/LICENSE-1", "All rights reserved."), (6, None, "Licensed under CC BY-NC 4.0."), (7, "r/a/n.txt", None), (8, "top.txt", ""),
        (9, "q/LICENSE", "no licence in here"), (10, "q/x.txt", "the of and " * 5000), (10, "q/x.txt", "the of and " * 5000),
    ]
    got = {r.doc_id: (r.own_license, r.inherited_from, r.license, r.own_line) for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got[1] == ("mit", None, "mit", 1) and got[2] == (None, "r/a", "mit", 0) and got[3] == ("apache-2.0", None, "apache-2.0", 2)
    assert got[4] == (None, "r", "proprietary", 0) and got[6] == ("cc-by-nc-4.0", None, "cc-by-nc-4.0", 1) and got[7] == (None, "r/a", "mit", 0)
    assert got[8] == (None, None, None, 0) and got[10] == (None, None, None, 0)
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, path string, text string")).collect() == []


def test_license_search_leaves_nothing_out():
    """Scoring every line gives what scoring lines with a telling term gives."""
    s = licenses.Scorer(1000, {t: (900 if len(t) < 4 else 3) for t in licenses.VOCABULARY}, 0.75)
    r = random.Random(5)
    pool = sorted(licenses.VOCABULARY) + ["other", "words"]
    for _ in range(3000):
        line = " ".join(r.choices(pool, k=r.randint(1, 9)))
        assert (s.line(line) is not None) == (s.text(line)[0] is not None)
    for licence, statement in licenses.TEMPLATES:
        assert s.text(statement)[0] == licence


def test_license_terms_outside_templates_weigh_by_frequency(spark):
    """Words that most texts hold hardly count, wrapped statements are found, and the search equals scoring with all frequencies known."""
    files = [(i, f"a/{i}.txt", f"project by all of us number n{i}") for i in range(300)]
    files += [
        (300, "b/x", "Released under the MIT License by project"), (301, "c/x", "intro\n# Released under\n#\n# the MIT\n# License\nrest of it"),
        (302, "d/x", "Released under the MIT License q1 q2 q3 q4"), (303, "e/LICENSE", "\n".join(licenses.TEMPLATES[2][1].split())), (304, "f/x", "Released under the MIT License n7"),
    ]
    got = {r.doc_id: (r.own_license, r.own_line, r.own_score) for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got[300][:2] == ("mit", 1) and got[301][:2] == ("mit", 2) and got[302] == (None, 0, 0.0) and got[303][:2] == ("bsd", 1)  # the sentence that all BSD licences share
    frequency: dict = {}
    for *_, text in files:
        for t in set(licenses.terms_of(text)):
            frequency[t] = frequency.get(t, 0) + 1
    s = licenses.Scorer(len(files), frequency, 0.75)
    for i, path, text in files:
        licence, score, line = s.text(text, "LICENSE" in path)
        assert got[i] == (licence, line, pytest.approx(score, abs=1e-6))


def test_license_texts_titles_headers_and_names(spark):
    """Whole licences with a copyright line, wrapped at 72 characters, title pages, headers in comments, SPDX lines; versions are told apart."""
    import textwrap

    gnu = "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU {} as published by\n// the Free Software Foundation, either version {} of the License, or\n// (at your option) any later version.\n"
    bsd = dict(licenses.TEXTS)["bsd-3-clause"]
    want = [(f"{x}/LICENSE", x, f"Copyright (c) 2021, Some Body\nAll rights reserved.\n\n{textwrap.fill(text, 72)}\n") for x, text in licenses.TEXTS]
    want += [
        ("gpl3/COPYING", "gpl-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy\n"),
        ("gpl2/COPYING", "gpl-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.\n Everyone is permitted to copy\n"),
        ("apache/LICENSE.txt", "apache-2.0", "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n"),
        ("s/a.cc", "gpl-2.0", gnu.format("General Public License", 2)), ("s/b.cc", "gpl-3.0", gnu.format("General Public License", 3)),
        ("s/c.cc", "lgpl-2.1", gnu.format("Lesser General Public License", 2.1)), ("s/d.cc", "agpl-3.0", gnu.format("Affero General Public License", 3)),
        ("s/e.py", "mit", "# SPDX-License-Identifier: MIT\nimport os\n"), ("s/f.c", "gpl-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;\n"), ("s/g.c", None, "/* SPDX-License-Identifier: Unheard-Of */\nint x;\n"),
        ("s/h.go", "bsd", "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n"),
        ("s/i.c", "bsd-3-clause", textwrap.indent(textwrap.fill(bsd, 72), " * ")),
    ]
    plain = [(f"p/{i}.txt", None, f"the story of a copy and its use in this work by any person number n{i}") for i in range(200)]
    files = spark.createDataFrame([(i, p, t) for i, (p, _, t) in enumerate(want + plain)], "doc_id long, path string, text string")
    got = {r.path: r.own_license for r in licenses.scan_licenses(files).collect()}
    assert got == {p: x for p, x, _ in want + plain}


def test_license_inheritance_walks_up_to_the_nearest_directory(spark):
    """A plain walk from each file up to the first directory with a licence file."""
    r = random.Random(3)
    lines = {"mit": "Released under the MIT License.", "apache-2.0": "Licensed under the Apache License, Version 2.0.", None: "nothing to say"}
    files, speaks = [], {}
    for i in range(400):
        folder = "/".join(r.choice("ab") for _ in range(r.randint(0, 6)))
        licence = r.choice(list(lines)) if i % 8 == 0 else None
        name = f"LICENSE-{i:03}" if i % 8 == 0 else f"{i}.txt"
        files.append((i, f"{folder}/{name}" if folder else name, lines[licence]))
        if licence:
            speaks.setdefault(folder, licence)  # equal scores: the least path, which is the first
    want = {}
    for i, path, text in files:
        own = next((x for x, line in lines.items() if x and text.startswith(line)), None)
        at = path.rpartition("/")[0]
        while at and at not in speaks:
            at = at.rpartition("/")[0]
        want[i] = (own, own or speaks.get(at), None if own or at not in speaks else at)
    got = {x.doc_id: (x.own_license, x.license, x.inherited_from) for x in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == want


def test_language_id_held_out(spark):
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    r = got.join(d, "doc_id").collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 for x in r)
    held = [x for x in r if x.held_out]
    assert len(r) == d.count() and sum(x.lang_pred == x.lang for x in held) >= 0.95 * len(held)


def test_language_id_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog " * 9, "en"), (2, "le chat et le chien " * 9, "fr"), (3, None, "en"), (4, "12 + 3 ?", "en"), (5, "", None), (1, "the cat and the dog " * 9, "en"), (6, "the " * 90000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, docs).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[1][0] == "en" and got[2][0] == "fr" and got[6][0] in ("en", "fr")
    assert langid.identify(docs, docs.limit(0)).where("lang_pred <> 'und'").collect() == []
    assert langid.identify(docs.limit(0), docs).collect() == []


def test_language_sample_is_bounded_and_even(spark):
    """At most so many rows of each label, and no more than twice as many windows drawn."""
    df = spark.createDataFrame([(i, f"text number {i} " * 5, "ab"[i % 10 == 0]) for i in range(4000)] + [(None, None, "a"), (None, "x y z", None)], "doc_id long, text string, lang string")
    got = langid.sample(df, "doc_id", "text", "lang", 50, 1)
    assert sum(x[1] == "a" for x in got) == 50 and sum(x[1] == "b" for x in got) == 50
    assert got == langid.sample(df.repartition(5), "doc_id", "text", "lang", 50, 1)


def test_language_sample_holds_every_label(spark, monkeypatch):
    """Labels are learned however many there are; a bound on rows leaves fewer rows of each, and never none."""
    df = spark.range(6000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 300) AS lang")
    count = lambda: Counter(label for _, label in langid.sample(df, "doc_id", "text", "lang", 50, 1))
    assert len(c := count()) == 300 and set(c.values()) == {20}
    monkeypatch.setattr(langid, "MOST_ROWS", 900)
    assert len(c := count()) == 300 and 1 <= min(c.values()) and max(c.values()) == 3
    monkeypatch.setattr(langid, "MOST_ROWS", 10)
    assert len(c := count()) == 300 and sum(c.values()) == 300


def test_convolution_tables_equal_convolution():
    net = langid.train([(b"abcabc abc", "x"), (b"zzyyxx zyx", "y")] * 20, window=32, epochs=1)
    data, _, _ = langid.windows_of([bytes(range(40, 200))], 32)
    pooled = []
    for w, f in zip(langid.WIDTHS, net.filters, strict=True):
        z = net.embed[data]
        pooled.append(np.stack([np.concatenate([z[:, i + j] for j in range(w)], axis=1) @ f for i in range(32 - w + 1)]).max(axis=0))
    h = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.out_bias
    want = np.exp(h - h.max(1, keepdims=True))
    assert np.allclose(langid.window_probabilities(net, net.tables(), data), want / want.sum(1, keepdims=True), atol=1e-4)


@pytest.mark.parametrize("n", [0, 5, 1000])
def test_shards(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("copy")).alias("text"), F.lit(1).alias("slot"), F.lit(2).alias("count"))
    got = shards.hypergeometric_shuffle(df, 16, identity=["doc_id", "text"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(r.doc_id for r in got) == list(range(n)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    again = shards.hypergeometric_shuffle(df.repartition(3), 16, identity=["doc_id", "text"]).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}
    assert any(r.doc_id % 3 and r.shard == s for r in got for s in range(8, 16)) or n < 100  # copies are spread


def test_shards_spread_rows_alike(spark):
    """A table of equal rows falls into blocks like any other."""
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = shards.hypergeometric_shuffle(df, 16).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(by) == 16 and all(sorted(x) == list(range(len(x))) for x in by.values()) and {len(x) for x in by.values()} <= {187, 188}


def test_sharding_query_keeps_its_law(spark):
    got = queries.op6_sharding(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == want and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(16)) and all(sorted(x) == list(range(len(x))) for x in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_hypergeometric_draws():
    rng = random.Random(1)
    x = [shards.hypergeometric(rng, 300, 700, 100) for _ in range(4000)]
    assert abs(np.mean(x) - 30) < 0.5 and abs(np.var(x) - 100 * 0.3 * 0.7 * 900 / 999) < 1.5
    m = shards.communication_matrix([0, 17, 400, 3], 16, 7)
    assert [sum(r) for r in m] == [0, 17, 400, 3] and sorted({sum(c) for c in zip(*m, strict=True)}) == [26, 27]
    assert 0 <= shards.hypergeometric(rng, 10**12, 10**13, 10**9) <= 10**9


def test_packing_round_trip(spark):
    r = random.Random(2)
    lengths = [(i if i else None, r.choice([0, 5, 400, 900, 1500, 5000, 12000])) for i in range(300)] + [(7, 900)]
    df = spark.createDataFrame(lengths, "doc_id long, n int")
    got = packing.pack(df, F.col("n")).collect()
    whole = {}
    for x in got:
        whole.setdefault((x.doc_id, x.start), []).append(x.length)
    assert sum(x.length for x in got) == sum(n for _, n in lengths)
    bins = {}
    for x in got:
        assert (x.bin is None) == (x.length == 0)
        if x.bin is not None:
            bins.setdefault((x.bin, x.capacity), []).append((x.offset, x.length))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), pieces in bins.items():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False))  # side by side
        used = sum(n for _, n in pieces)
        assert pieces[0][0] == 0 and used <= capacity == min(c for c in packing.CAPACITIES if c >= used)
    fill = sum(sum(n for _, n in p) for p in bins.values()) / sum(c for _, c in bins)
    assert fill > 0.9 and packing.pack(df.limit(0), F.col("n")).collect() == []


def test_packing_groups_are_bounded_by_pieces(spark, monkeypatch):
    """Long documents, null keys and repeated rows make no group larger than a few times GROUP_PIECES."""
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    monkeypatch.setattr(packing, "LOT", 64)
    long = [(i, 4096 * 50) for i in range(40)]
    for rows in (long, [(None, 700)] * 3000, [(None, 600 + i % 50) for i in range(3000)]):
        got = packing.pack(spark.createDataFrame(rows, "piece long, n int"), F.col("n"), key="piece") if rows is not long else packing.pack(spark.createDataFrame(rows, "doc_id long, n int"), F.col("n"))
        found = got.collect()
        assert sum(r.length for r in found) == sum(n for _, n in rows)
        bins: dict = {}
        groups = -(-sum(-(-n // 4096) for _, n in rows) // 100)
        for r in found:
            bins.setdefault(r.bin % groups, []).append(r)
        assert len(bins) >= groups - 1 and max(map(len, bins.values())) < 250


def test_packing_query_against_plain_counts(spark):
    """The query's pieces cover each document's words and separator exactly, and lie side by side in bins of the least size that holds them."""
    got = queries.op7_best_fit_packing(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    whole: dict = {}
    bins: dict = {}
    for r in got:
        whole.setdefault(r.doc_id, []).append((r.start, r.length))
        if r.bin is not None:
            bins.setdefault((r.bin, r.capacity), []).append((r.offset, r.length))
    for i, text in docs.items():
        n = len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w])
        parts = sorted(whole[i])
        assert sum(x for _, x in parts) == (n + 1 if n else 0) and all(a + x == b for (a, x), (b, _) in zip(parts, parts[1:], strict=False))
    for (_, capacity), parts in bins.items():
        parts.sort()
        used = sum(n for _, n in parts)
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and capacity == min(c for c in packing.CAPACITIES if c >= used)


def test_best_fit_takes_the_tightest_bin():
    bins, sizes = packing.best_fit([600, 500, 400, 100], (512, 1024))
    assert bins[0] != bins[1] and bins[2] == bins[0] and sizes[bins[1]] in (512, 1024)


def test_tokens_equal_the_library(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokens.load(path)
    r = random.Random(3)
    texts = [None, "", " ", "a", " a", "a ", "a  b", "\n a\t b", "it's  we'll", "<|endoftext|>x <|endoftext|>", "日本 語 " * 50, "a  b  c", "x" * 3000, "12 345,6  78"]
    texts += ["".join(r.choices("ab 1é\n.'s　", k=200)) for _ in range(200)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in tokens.with_token_counts(df, path).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False))
        assert got[i] == (len((x or "").encode()), n, n > 1024)
    assert tokens.with_token_counts(df.limit(0), path).collect() == []


@pytest.mark.parametrize("chunk,overlap,guard", [(400, 80, 16), (1000, 200, 64), (300, 40, 16), (tokens.CHUNK, tokens.OVERLAP, None)])
def test_chunks_resynchronise(chunk, overlap, guard):
    """Texts of many chunks, with special strings, long runs and single words longer than a chunk, count as the library counts them whole."""
    import public_tokenizers

    t = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(chunk)
    n = 3 * chunk
    texts = ["".join(r.choices(["word", " word", "  ", "\n", "é", "<|endoftext|>", "'s", "12", "?!", "日本"], k=n)) for _ in range(4)]
    texts += ["x" * 6 * chunk, " " * 4 * chunk + "a", "日本" * 2 * chunk, "a b " * n, "<|endoftext|>" * n, "one two " * n + "y" * 4 * chunk + " three four" * n, "", "short"]
    assert tokens.count_tokens(t, texts, chunk, overlap, guard) == [len(t.encode(x, add_special_tokens=False)) for x in texts]


def test_long_texts_of_the_table_resynchronise(spark):
    """Documents longer than a chunk, at production settings: every one is spliced, and all counts are the library's."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokens.load(path)
    long = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text") > tokens.CHUNK).select("doc_id", "text")
    got = tokens.with_token_counts(long, path).collect()
    assert len(got) > 5 and all(r.n_tokens == len(t.encode(r.text, add_special_tokens=False)) for r in got)


def brute_error(a, b):
    """Least bit error of two prints over all offsets with enough overlap."""
    best = 1.0
    least = min(audio.MIN_OVERLAP, len(a), len(b))
    for offset in range(least - len(a), len(b) - least + 1):
        first, last = max(0, -offset), min(len(a), len(b) - offset)
        x = np.bitwise_xor(a[first:last], b[first + offset : last + offset]).astype(np.uint32)
        best = min(best, np.unpackbits(x.view(np.uint8)).sum() / (32 * (last - first)))
    return best


def test_audio_aligns_shifted_copies(spark):
    rng = np.random.default_rng(4)
    tunes = rng.normal(0, 0.1, (6, 64))
    wave = [audio.melody(v) for v in tunes]
    late = audio.recorded(tunes[0], audio.STEP * 10, 0.3, 0.0, 0)
    noisy = audio.recorded(tunes[1], 0, 1.0, 0.02, 5)
    short = wave[2][: audio.FRAME + audio.STEP * 24]
    rows = [(i, w.astype(float).tolist()) for i, w in enumerate(wave)] + [(50, wave[0].tolist()), (51, late.tolist()), (52, noisy.tolist()), (53, None), (54, []), (55, [0.0] * 100), (56, short.tolist()), (57, short.tolist()), (58, [0.0] * 9000), (59, [0.0] * 20000)]
    df = spark.createDataFrame(rows, "id long, samples array<float>").select("id", audio.fingerprints(F.col("samples")).alias("print"))
    got = {(r.id, r.match_id): (r.class_size, r.offset, r.bit_error) for r in audio.search(df, df, "id").collect()}
    assert got[(0, 0)] == (2, 0, 0.0) and got[(50, 0)] == (2, 0, 0.0)
    assert got[(0, 51)][1] == -10 and got[(51, 0)][1] == 10 and got[(0, 51)][2] < 0.02
    assert got[(1, 52)][1] == 0 and got[(1, 52)][2] < audio.MAX_ERROR and (0, 1) not in got and (53, 53) not in got
    assert got[(57, 56)] == (2, 0, 0.0) and got[(58, 59)][2] == 0.0  # equal short ones, and silences of two lengths
    assert audio.search(df.limit(0), df.limit(0), "id").collect() == []


def test_audio_recall_and_precision_of_the_query_against_brute_force(spark):
    """Every reported error is the true one; at least nine tenths of all pairs of a query and another class within MAX_ERROR at some offset are found,
    matches of queries with themselves not counted; lightly changed copies all are."""
    sf = "/root/testdata/sf0.01"
    e = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    prints = {}
    for i in e:
        of = e.get(i - i % 10)
        how = {3: (1317, 0.4, 0.0), 7: (0, 1.0, 0.02), 9: (0, 1.0, 0.2)}.get(i % 10) if of is not None else None
        prints[i] = audio.fingerprint(audio.recorded(of if how else e[i], *(how or (0, 1.0, 0.0)), abs(i)))
    least = {}
    for i in sorted(prints):
        least.setdefault(prints[i].tobytes(), i)
    want = {}
    for q in (i for i in prints if i % 50 == 0):
        for c in least.values():
            if c != least[prints[q].tobytes()] and (error := brute_error(prints[q], prints[c])) <= audio.MAX_ERROR:
                want[(q, c)] = error
    own = {(q, least[prints[q].tobytes()]) for q in prints if q % 50 == 0}
    found = {(r.vec_id, r.match_id): r.bit_error for r in queries.op9_audio_fingerprints(spark, sf).collect()}
    assert own <= set(found)
    got = {k: v for k, v in found.items() if k not in own}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 0.05 for k in got)
    assert len(got) >= 0.9 * len(want) and sum(error > 0.12 for error in want.values()) >= 5
    assert all((q, q + 3) in got and (q, q + 7) in got for q, _ in own if q + 7 in prints)


def test_audio_recall_by_bit_error(spark):
    """Recordings whose error lies between 0.12 and 0.2: at least nine tenths are found."""
    rng = np.random.default_rng(11)
    tunes = rng.normal(0, 0.1, (60, 64))
    rows, want = [], {}
    for i, v in enumerate(tunes):
        clean, noisy = audio.melody(v), audio.recorded(v, 0, 1.0, (0.18, 0.21, 0.24)[i % 3], i)
        error = brute_error(audio.fingerprint(clean), audio.fingerprint(noisy))
        rows += [(i, clean.tolist()), (100 + i, noisy.tolist())]
        if 0.12 < error <= audio.MAX_ERROR:
            want[(i, 100 + i)] = error
    df = spark.createDataFrame(rows, "id long, samples array<float>").select("id", audio.fingerprints(F.col("samples")).alias("print"))
    got = {(r.id, r.match_id): r.bit_error for r in audio.search(df, df.where("id < 100"), "id").collect()}
    assert len(want) >= 40 and len(set(got) & set(want)) >= 0.9 * len(want)
    assert all(a == c or a + 100 == c for a, c in got)


def test_audio_hot_codes_meet_every_pair_once(spark):
    """A code in a third of the rows on both sides, shuffled over a grid of parts."""
    postings = spark.range(30000).selectExpr("id AS c", "id % 7 AS pos", "IF(id % 3 = 0, 5, id) AS code")
    own = spark.range(600).selectExpr("-id AS q", "10 AS q_size", "id % 5 AS q_pos", "IF(id % 3 = 0, 5, id) AS code")
    way = lambda limit: audio.met(postings, own, limit).groupBy().agg(F.count("*"), F.sum(F.xxhash64("c", "pos", "q", "q_pos", "code").cast("decimal(38,0)"))).first()
    assert way(0) == way(1 << 30) and way(0)[0] == 10001 * 201 + 399


def test_audio_votes_are_those_of_all_pairs_of_keys(monkeypatch):
    """Votes of groups against a plain loop over all pairs of keys, in runs shorter than one query's pairs; bit errors against all integers."""
    rng = np.random.default_rng(9)
    table = lambda n: pa.chunked_array([pa.array([rng.integers(0, 3, rng.integers(0, 40)).astype(np.int64) * 0x10001 for _ in range(n)], pa.list_(pa.int64())) for _ in range(2)])
    part, block = audio.Prints(table(6)), audio.Prints(table(4))

    def keys(p):
        for i, (begin, size) in enumerate(zip(p.begin.tolist(), p.size.tolist(), strict=True)):
            x = p.flat[begin : begin + size].tolist()
            for half in (0, 16):
                code = [(x[f] >> half & 0xFFFF, x[f + audio.HOP] >> half & 0xFFFF) for f in range(size - audio.HOP)]
                yield from ((i, f, half, c) for f, c in enumerate(code) if not f or c != code[f - 1])

    bits = lambda a, b: sum((u ^ v).bit_count() for u, v in zip(a, b, strict=True))
    want = Counter((q, c, f - g) for q, g, h, a in keys(block) for c, f, k, b in keys(part) if h == k and bits(a, b) <= 1)
    for most in (7, 1 << 20):
        monkeypatch.setattr(audio, "PAIRS", most)
        got = [tuple(map(int, x)) for columns in audio.voted(part, block) for x in zip(*columns, strict=True)]
        assert len(got) == len(want) > 100 and {x[:3]: x[3] for x in got} == want
        q, c, offset = np.array([x[:3] for x in got if max(0, -x[2]) < min(block.size[x[0]], part.size[x[1]] - x[2])]).T
        plain = []
        for i, j, o in zip(q.tolist(), c.tolist(), offset.tolist(), strict=True):
            a, b = (p.flat[p.begin[k] : p.begin[k] + p.size[k]].tolist() for p, k in ((block, i), (part, j)))
            both = [(x, b[f + o]) for f, x in enumerate(a) if 0 <= f + o < len(b)]
            plain.append(bits(*zip(*both, strict=True)) / (32 * len(both)))
        assert np.allclose(audio.errors(part, block, q, c, offset), plain)


def test_audio_keys_are_searched_only_where_they_may_be(monkeypatch):
    """Equal to trying all 33 codes of each key; of these, few are searched for among a part's codes."""
    r = np.random.default_rng(6)
    code = np.sort(r.integers(0, 1 << 33, 3000))
    near = code[r.integers(0, 3000, 200)] ^ (1 << r.integers(1, 33, 200))
    asked = np.concatenate((r.integers(0, 1 << 33, 2000), near, near[:50], code[:20]))
    want = set()
    for bit in (0, *(1 << b for b in range(1, 33))):
        low, high = np.searchsorted(code, asked ^ bit, "left"), np.searchsorted(code, asked ^ bit, "right")
        want |= {(int(i), int(low[i]), int(high[i] - low[i])) for i in np.flatnonzero(high > low)}
    searched, search = [], np.searchsorted
    monkeypatch.setattr(audio.np, "searchsorted", lambda a, v, side="left": searched.append(np.size(v)) or search(a, v, side))
    got = [tuple(map(int, x)) for x in zip(*audio.looked_up(code, asked), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and sum(searched) < 2 * len(asked)


def test_audio_votes_are_not_shuffled(spark):
    """Prints that share most keys: what is shuffled grows with the prints, not with the votes (some 400 000 here)."""
    sc = spark.sparkContext
    none = lambda: sc._jvm.java.util.ArrayList()
    shuffled = lambda: sum(x.shuffleWriteRecords() for x in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())))
    rng = np.random.default_rng(12)
    few = rng.integers(0, 1 << 32, 4)
    df = spark.createDataFrame([(i, few[rng.integers(0, 4, 60)].tolist()) for i in range(200)], "id long, print array<long>")
    before = shuffled()
    got = audio.search(df, df.where("id % 10 = 0"), "id").collect()
    assert sum(r.id == r.match_id for r in got) == 20
    assert shuffled() - before < 20_000


def test_html(spark):
    cases = {
        "<p>One<p>Two<br>three": "One\n\nTwo\nthree",
        "<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>end": "- a\n- b\n  3. x\n  4. y\n\nend",
        "<table><tr><th>K<th>Long<tr><td>aaaa<td>1</table>": "K    | Long\naaaa | 1",
        "<div hidden>no</div><p style='display: none'>no</p><script>var a='<p>'</script>yes &amp; <b>so</b>": "yes & so",
        "<pre>\n a\n  b\n</pre>": " a\n  b",
        "<title>t</title><body><img alt='pic'> x": "pic x",
        "a < b <unclosed": "a < b <unclosed",
        "<!-- c --><b>x": "x",
        "": "",
        "</p></div>ok": "ok",
        "<table>" * 200 + "deep": "deep",
        "<div>" * 5000 + "deep": "deep",
    }
    for source, want in cases.items():
        assert html.to_text(source) == want, source
    df = spark.createDataFrame([(1, None), (2, "<p>x")], "page_id long, html string")
    assert sorted((r.page_id, r.text) for r in html.extract_text(df).collect()) == [(1, None), (2, "x")]


def test_html_shows_formulas_drawings_and_fields():
    math = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>x=\\frac</annotation></semantics></math>"
    cases = {
        f"<p>So {math} holds": "So x= 1 2 holds",
        f"a <span class=katex><span class='katex-mathml'>{math}</span><span class='katex-html' aria-hidden='true'><span>x</span><span>=</span></span></span> b": "a x= b",
        "<div aria-hidden='true'>seen</div>": "seen",
        "<svg><title>t</title><defs><text>no</text></defs><g>no<text x=1>one <tspan>two</tspan></text><text display=none>no</text></g></svg>": "one two",
        "x<textarea>\n a &lt; b\n  c</textarea>y": "x\n a < b\n  c\ny",
        "Pick <select><option disabled>no<option>first<option selected>second</select> now": "Pick second now",
        "Pick <select><option disabled>no<option>first<option>second</select> now": "Pick first now",
        "<select multiple><optgroup label=G><option>a<option>b</select>": "G a b",
        "<pre>p <select><option>a<option selected>b</select></pre>": "p  b",
    }
    for source, want in cases.items():
        assert html.to_text(source) == want, source


def test_html_visibility():
    sheet = lambda rules, body: f"<head><style>{rules}</style></head><body>{body}"
    cases = {
        "a <input type=submit value=Send> <input value='typed'><input type=password value=no><input type=checkbox value=no><input type=hidden value=no>": "a Send typed",
        "<input type=image alt=Go value=no>": "Go",
        "<details><summary>Head</summary>body</details>x": "Head\nx",
        "<details>body</details>x": "x",
        "<details open><summary>Head</summary>body</details>x": "Head\nbody\nx",
        "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
        "<div popover>no</div>x": "x",
        "<div hidden style='display:block'>shown</div>": "shown",
        "<div style='visibility:hidden'>no <b>no <i style='visibility:visible'>yes <u>yes</u></i> no</b></div>": "yes yes",
        "<div style='display:none'>no <b style='visibility:visible;display:block'>no</b></div>x": "x",
        "<ul style='visibility:hidden'><li>no<li><b style='visibility:visible'>yes</b></ul>": "  yes",
        "<table><tr><td>a<td>b<td>c<tr><td>1<td style='visibility:hidden'>no<td>3</table>": "a | b | c\n1 |   | 3",
        "<table><tr style='visibility:collapse'><td>no<tr><td>seen</table>": "seen",
        sheet(".h{display:none}", "<p class='x h'>no<p class=x>yes"): "yes",
        sheet("#h, p.k { color:red; visibility: hidden }", "<p id=h>no<p class=k>no<div class=k>yes</div><p id=H>yes"): "yes\n\nyes",
        sheet(".h{display:none} .h{display:block}", "<p class=h>yes"): "yes",
        sheet(".a{display:none} .b{display:block}", "<p class='b a'>yes"): "yes",
        sheet(".b{display:block} .a{display:none}", "<p class='b a'>no"): "",
        sheet("#i{display:block} .a{display:none} p{display:none}", "<p class=a id=i>yes<p>no"): "yes",
        sheet(".a{display:none !important}", "<p class=a style='display:block'>no"): "",
        sheet("*{visibility:hidden} b{visibility:visible}", "no <b>yes</b>"): "yes",
        sheet("@media print{.p{display:none}} @media screen{.s{display:none}} @import x; .t{display:none}", "<p class=p>yes<p class=s>no<p class=t>no"): "yes",
        sheet("@font-face{src:x} @keyframes k{from{display:none} to{top:0}} .t{display:none}", "<p class=t>no<p>yes"): "yes",
        sheet("/* .c{display:none} */ .d .e{display:none} .f:hover{display:none} .g{xdisplay:none", "<p class=c>c<p class=e>e<p class=f>f<p class=g>g"): "c\n\ne\n\nf\n\ng",
        "<style media=print>.h{display:none}</style><p class=h>yes": "yes",
        "<p class=h>no</p><style>.h{display:none}</style>x": "x",
        "<svg><g style='visibility:hidden'><text>no<tspan visibility=visible style='visibility:visible'>yes</tspan></text></g></svg>": "yes",
        "<select><option style='display:none'>no<option>yes</select><select style='visibility:hidden'><option>no</select>": "yes",
    }
    for source, want in cases.items():
        assert html.to_text(source) == want, source


def test_html_tables_nested_through_lists():
    got = html.to_text("<table><tr><td><ul><li>" * 500 + "deep")
    assert got.strip("- |").endswith("deep")


def test_html_quotes_rows_spans_and_values():
    cases = {
        'before <a title="x>link</a> after': "before link after",
        "x <a title='a>b'>link</a>": "x link",
        "a <b 'c>d": "a d",
        "<table><tr hidden>stray<td>no</tr><tr><td>seen</table>": "seen",
        "<table><tr><td>|</table>x": "|\n\nx",
        "<table><tr><td colspan=2>AA<td>B<tr><td>1<td>2<td>3</table>": "AA    | B\n1 | 2 | 3",
        "<table><tr><td rowspan=2>AA<td>1<tr><td>2<tr><td>b<td>3</table>": "AA | 1\n   | 2\nb  | 3",
        "<table><tr><td colspan=1000>a<td>b</table>": "a | b",
        "<ol><li value=4>x<li>y<li value=q>z</ol>": "4. x\n5. y\n6. z",
        "<select><option>a<select><option>b</select>": "a b",
        "<![CDATA[raw <b>]]>x": "raw <b>x",
        "<!-->x": "x",
    }
    for source, want in cases.items():
        assert html.to_text(source) == want, source


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '>", '<a b="', "<", "<!--", "<!-- -->", "</", "<div>", "<p><button><div>", "<ul><li>x", "<blockquote>x", "<table><tr><td>", "<select><option>", "<td rowspan=9999>", "<tr><td>", "<b>x</b>", "</script ", "<title>x", "<a =/ >", "&amp", "<table><tr><td colspan=1000>x", "<svg><text>", "<style>.a{display:none}", "<style>.a{</style>", "<style>a{display:none}b{visibility:hidden}</style>", "<i style='visibility:hidden'>x", "<p style=';display:;display:'>", "<details>", "<details><summary>x", "{", "}", ".a{display:none}", "@media print{", "/*", ".a,", "display:none;"])
@pytest.mark.parametrize("wrap", ["{}", "<style>{}"])
def test_html_takes_linear_time(piece, wrap):
    """A megabyte of any markup is done in seconds, and four times as much takes about four times as long."""
    import time

    def took(n):
        began = time.process_time()
        html.to_text(wrap.format("") + piece * (n // len(piece)))
        return time.process_time() - began

    assert took(1 << 20) < 20 and took(1 << 20) < 8 * max(0.2, took(1 << 18))


def test_html_query_keeps_every_visible_word_of_the_pages(spark):
    """The query's words against those that the standard library's parser finds outside unseen elements."""
    from collections import Counter
    from html.parser import HTMLParser

    class Seen(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.words = [], []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag == "img":
                self.words += [w for w in (a.get("alt") or "").split() if not any(self.stack)]
            if tag not in html.VOID:
                self.stack.append(tag in html.UNSEEN or "hidden" in a or "none" in (a.get("style") or ""))
                self.tags = [*getattr(self, "tags", []), tag]

        def handle_endtag(self, tag):
            tags = getattr(self, "tags", [])
            if tag in tags:
                at = len(tags) - 1 - tags[::-1].index(tag)
                del tags[at:], self.stack[at:]

        def handle_data(self, data):
            self.words += data.split() if not any(self.stack) else []

    got = {r.page_id: r.text for r in queries.op10_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    assert len(got) == len(pages) > 100
    for r in pages:
        seen = Seen()
        seen.feed((r.html or "").decode() if isinstance(r.html, bytes) else r.html or "")
        seen.close()
        want, have = Counter("".join(seen.words)), Counter("".join((got[r.page_id] or "").split()))
        assert not want - have, (r.page_id, want - have)  # nothing visible is lost
        assert set(have - want) <= set("-|.0123456789"), (r.page_id, have - want)  # only markers are added


def test_html_keeps_every_visible_word():
    """All words outside hidden elements come out, in order, for random markup of well-formed blocks."""
    r = random.Random(8)
    for _ in range(300):
        want, source = [], []
        for i in range(12):
            tag = r.choice(["p", "div", "li", "h2", "span", "blockquote", "td", "b"])
            text = f"w{i} v{i} "
            hidden = r.random() < 0.2
            source.append(f"<{tag}{' hidden' if hidden else ''}>{text}</{tag}>")
            want += [] if hidden else text.split()
        assert [w for w in html.to_text("".join(source)).split() if w != "-"] == want
