"""Grouping of spelling variants: all pairs of words one edit apart, by merging subtrees of the words' trie.

An edit is one inserted, deleted or replaced character. At the trie node where two such words part, one goes on by another character than the other
and the rests agree once that character is replaced or skipped. Each node calls its child with most words heavy and its others light. Only light
subtrees move: into the heavy sibling's place (``replace``), into that of all light siblings (``replace`` by a wildcard), up into
the node itself (``skip``), and below the heavy child (the heavy character inserted). Where a moved word's end coincides with the end of
a word, the two are one edit apart. A word lies in at most log2(V) light subtrees of a trie of V words, so moving them all takes V log V rows; no pair of
words within a subtree is ever formed, and every near pair is met exactly once, at the node where its words part (of a doubled letter, its last
place counts).

The trie is a table: nodes are prefixes, edges are rows (prefix, character), and a moved subtree is the set of its moved words, so
coinciding ends are an equi-join. The prefixes that many words share are spread over tasks.

Edge cases: a null or empty text has no words; words keep their case and accents but for A-Z; equal counts go to the word that sorts first by code
point; an empty table gives an empty result; texts' other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, written

#: Maximal runs of Latin letters and the characters from U+00C0 to U+00FF. Shorter runs than asked for are never words.
LETTERS = r"[A-Za-zÀ-ÿ]"


def letter_runs(text: Column, min_chars: int) -> Column:
    """The runs of ``min_chars`` letters or more of a text, as an array, A-Z lower-cased."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(f"{LETTERS}{{{min_chars},}}"), F.lit(0))


def counted(words: DataFrame, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of the words of at least so many characters and occurrences."""
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def light_edges(words: DataFrame) -> DataFrame:
    """(word, n, x, c, h, r): for each word and each node x on its way where it does not take the heavy child h: its character c and the rest r;
    at the node where the word ends (if that has children), c and r are empty."""
    d = F.col("d")
    steps = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("d"))
    edges = steps.select("word", F.col("n").alias("own"), "d", F.expr("left(word, d)").alias("x"), F.substring("word", d + 1, F.lit(1)).alias("c"))
    children = edges.groupBy("x", "c").agg(F.count("*").alias("m"))
    inner = F.col("c") != ""
    heavy = children.groupBy("x").agg(F.max(F.when(inner, F.struct("m", "c"))).alias("best"), F.sum("m").alias("n"), F.count("*").alias("ways")).where("best IS NOT NULL AND ways > 1")
    met = spread_join(edges, heavy.select("x", "n", F.col("best.c").alias("h")), ["x"], ["word"])
    return met.where("c <> h").select("word", F.col("own").alias("n"), "x", "c", "h", F.expr("substring(word, d + 2)").alias("r"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are one edit away, and of these that of largest n (then the first by code point) as (-n, word).

    ``words`` is a written table (word, n) of distinct words."""
    light = written(light_edges(words), "light-edges")
    x, c, h, r = (F.col(k) for k in "xchr")
    inner = c != ""
    moved = F.array(
        F.when(inner, F.concat(x, h, r)).otherwise(F.concat(x, h)),  # in the heavy sibling's place; or a word's end, below the heavy child
        F.when(inner, F.concat(x, h, c, r)),  # below the heavy child
        F.when(inner & ~r.startswith(c), F.concat(x, r)),  # up into the node, unless the letter is doubled
    )
    ends = light.select("word", "n", F.explode(F.array_compact(moved)).alias("end"))
    pairs = written(ends.join(words.select(F.col("word").alias("end"), F.col("n").alias("end_n")), "end").select("word", "n", "end", "end_n"), "near-pairs")

    def rank(n: str, word: str) -> Column:
        return F.struct((-F.col(n)).alias("n"), F.col(word).alias("word"))

    one = F.lit(1).cast("long").alias("k")
    met = pairs.select("word", one, rank("end_n", "end").alias("best")).unionByName(pairs.select(F.col("end").alias("word"), one, rank("n", "word").alias("best")))
    # Light siblings under a wildcard: as many as there are characters at most, all near to each other.
    group = light.where(inner).groupBy("x", "r").agg(F.sort_array(F.collect_list(rank("n", "word"))).alias("g")).where(F.size("g") > 1)
    member = group.select("g", F.explode("g").alias("own"))
    others = member.select(F.col("own.word").alias("word"), (F.size("g") - 1).cast("long").alias("k"), F.when(F.col("own") == F.col("g")[0], F.col("g")[1]).otherwise(F.col("g")[0]).alias("best"))
    return met.unionByName(others).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that (word, form) leads to. A form is commoner than its word, so there are no circles; every round doubles the steps taken."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        after = written(now.join(ahead, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")), "roots")
        discard(now)
        now = after
        if not now.where("__moved").limit(1).count():
            return now.select("word", "root")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """Every word of (word, n) with its form (the near word of largest n, where that is ``times`` its own n or more), its root (the form of the form and so on, or itself),
    n, the number of near words and the form's n."""
    words = written(words.select("word", "n"), "words")
    found = words.join(near_words(words), "word", "left")
    formed = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.n") >= times * F.col("n"), F.col("best")).alias("f"))
    formed = written(formed.select("word", F.col("f.word").alias("form"), "n", "n_near", (-F.col("f.n")).alias("form_n")), "forms")
    root = roots(formed.where("form IS NOT NULL"))
    return formed.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
