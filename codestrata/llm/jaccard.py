"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes its links form.

A text is the set of its distinct word ``n``-grams (a shorter text: its whole word sequence as one). Two sets link when
100 * |intersection| >= percent * |union|.

Prefixes. All sets order their grams alike, rarest first. With overlap bound ``need`` = ceil(percent * size / 100), two linked sets share at
least ``l`` grams within their prefixes of ``size - need + l`` grams, for any l up to need. Each set lengthens its prefix on its own: it takes
the l of least estimated cost (postings read, plus candidates left, which fall as 1/l, times the cost of verifying one). A pair is a
candidate if its prefixes share at least the smaller of its two l; candidates are verified on whole sets.

Steps, all distributed:

1. In the order of hashes, prefixes of ``size - need + l`` grams with l = 1 + size // SLACK are counted over all texts, with partial sums before
   the shuffle. Partners share l grams of these, l the smaller of their two; so a text with fewer prefix grams that stand in other prefixes
   than any partner could ask for has no partner. Most texts end here.
2. The rest are collapsed to distinct sets. One shuffle of their grams gives the frequencies, by which the grams are ordered, rarest first.
   Sets with fewer than ``need`` grams that occur elsewhere go too; the others choose their prefixes. A gram in very many sets (seen in a part
   of the sets) has an estimate as its frequency and is spread over the tasks: any fixed order of grams is right, whatever their frequency.
3. For classes, sets are linked to a centre, one of their posting lists' sets. Two sets with one centre that do not both link to it are
   compared by their differences from it (``near_candidates``): there, the overlap that a link asks for is counted within the differences, and
   the prefixes are as long as one shared gram of them takes. Pairs with different centres are compared by their adaptive prefixes
   (``far_candidates``). Sets that link to one centre are in one class without being compared. So no link between classes is lost, and no list
   is capped; yet a group of thousands of near copies costs its size, not its square. ``links`` verifies every candidate pair of distinct
   sets instead.

Joins on a key that may be hot (a class, a centre, a gram, a text's set) go through ``spread_join``. Hash collisions can only add candidates in
step 1; later, sets are compared by 64-bit hashes of their grams.

Edge cases: null, empty and blank texts have no grams and link with nothing; repeated rows and equal texts share a set; a null id is
its own smallest id only if no other is there; ties between centres go to the least hash; an empty table gives an empty result; other columns are
left out; a long text is a long set, held by one task at a time, and texts go through numpy in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bound_batches, connected_components, discard, gram_hashes, mix, pieces, signed, small, spread_join, tidy, union_all, word_hashes, written

#: In step 1, partners share one prefix gram more for each so many grams.
SLACK = 16
#: One in so many sets is looked at for very frequent grams, and those with more than one in so many of the looked-at postings are such.
LOOK, FREQUENT = 32, 16384
#: A set is compared by its difference from a centre if that is at most so many times what a link to the centre allows.
NEAR = 3
#: Verifying a candidate costs about this many postings, and so many more for each gram.
VERIFY = 8.0
VERIFY_GRAM = 0.05


def need_of(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def gram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each text."""
    words, counts = word_hashes(texts)
    grams = gram_hashes(words, n)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(grams[at : at + c - n + 1]))
        elif c:
            whole = gram_hashes(words[at : at + c], c) ^ mix(np.array([c], np.uint64))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def signature(grams: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(grams.tobytes()) - 2**63 if len(grams) else 0


def _batches(n: int, emit: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs ``emit(batch, first row, sets)`` over runs of texts of a batch with a column __text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch.column("__text")):
                out = emit(batch, first, gram_sets(texts, n))
                if out is not None and out.num_rows:
                    yield out

    return run


def signatures(texts: DataFrame, n: int) -> DataFrame:
    """(id, key, __text) to (id, key, k, size): signature and size of each text's set."""

    def emit(batch: pa.RecordBatch, first: int, sets: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(sets)), batch.column("key").slice(first, len(sets)), pa.array([signature(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())], names=["id", "key", "k", "size"])

    return texts.mapInArrow(_batches(n, emit), f"id long, key {dict(texts.dtypes)['key']}, k long, size int")


def slack_of(size: int, percent: int) -> int:
    """l of step 1; it never falls with the size."""
    return min(1 + size // SLACK, max(1, need_of(size, percent)))


def first_grams(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, __text) to (h, id): the grams of each set's prefix in the order of hashes."""

    def emit(batch: pa.RecordBatch, first: int, sets: list) -> pa.RecordBatch:
        own = [s[: len(s) - need_of(len(s), percent) + slack_of(len(s), percent)] for s in sets]
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in own])
        ids = batch.column("id").slice(first, len(sets)).take(pa.array(rows))
        return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(own))), ids], names=["h", "id"])

    return texts.mapInArrow(_batches(n, emit), "h long, id long")


def grams_of(texts: DataFrame, n: int) -> DataFrame:
    """(id, k, __text) to (h, k): all grams of texts whose signature is k."""

    def emit(batch: pa.RecordBatch, first: int, sets: list) -> pa.RecordBatch:
        keys = batch.column("k").slice(first, len(sets)).to_numpy(zero_copy_only=False)
        sets = [s if signature(s) == k else s[:0] for s, k in zip(sets, keys, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sets))), pa.array(np.repeat(keys, [len(s) for s in sets]))], names=["h", "k"])

    return texts.mapInArrow(_batches(n, emit), "h long, k long")


def choose_prefix(df: np.ndarray, size: int, need: int) -> tuple[int, int]:
    """(l, postings): the l of least cost and how many of the grams that others have too fall into its prefix. df: their frequencies, rising."""
    others, alone = len(df), size - len(df)
    total = np.concatenate(([0.0], np.cumsum(df - 1.0)))
    best = (np.inf, 1, 0)
    l = 1
    while l <= need:
        m = size - need + l - alone
        if m >= l:
            m = min(m, others)
            cost = total[m] + total[m] / l * (VERIFY + VERIFY_GRAM * size)
            if cost < best[0]:
                best = (cost, l, m)
        l = l + 1 if l < 4 else l + l // 2
    return best[1], best[2]


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(k, size, pairs: rising (df, h) of grams that others have) to (k, size, l, grams, m): m of the ordered grams are the prefix."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, sizes, pairs = batch.column("k").to_pylist(), batch.column("size").to_pylist(), batch.column("pairs")
            rows = []
            for k, size, p in zip(ks, sizes, pairs, strict=True):
                df, h = (p.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                if len(df) >= need_of(size, percent):
                    l, m = choose_prefix(df, size, need_of(size, percent))
                    rows.append((k, size, l, h, m))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32()), strict=True)], names=["k", "size", "l", "grams", "m"])

    return sets.mapInArrow(run, "k long, size int, l int, grams array<long>, m int")


def _linked(common: Column, a: Column, b: Column, percent: int) -> Column:
    return F.lit(100).cast("long") * common >= F.lit(percent).cast("long") * (a + b - common)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of set keys whose whole sets link. The pairs list is broadcast if its size allows it."""
    s = sets.select("k", "size", "grams")
    left = s.select(F.col("k").alias("a"), F.col("size").alias("sa"), F.col("grams").alias("ga")).join(small(pairs, 24), "a")
    both = left.join(s.select(F.col("k").alias("b"), F.col("size").alias("sb"), F.col("grams").alias("gb")), "b")
    return both.where(_linked(F.size(F.array_intersect("ga", "gb")), F.col("sa"), F.col("sb"), percent)).select("a", "b")


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return F.lit(100).cast("long") * F.least(a, b) >= F.lit(percent).cast("long") * F.greatest(a, b)


def row_ids(docs: DataFrame, key: str, text: str, hashed: bool = False) -> Column:
    """A long for each row: the key itself if it is an integer (small ids shuffle small), else, or if ``hashed``, a hash of key and text. It may repeat."""
    whole = not hashed and dict(docs.dtypes)[key] in ("bigint", "int", "smallint", "tinyint")
    return F.coalesce(F.col(key).cast("long"), F.xxhash64(F.col(text))) if whole else F.xxhash64(F.col(key), F.col(text))


def prepare(docs: DataFrame, key: str, text: str, n: int, percent: int, number: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows: id, k, size, key of every text; sets: k, size, l, grams, m of each distinct set that may have a partner), written tables."""
    bound_batches(docs.sparkSession)

    def numbered(hashed: bool) -> tuple[DataFrame, DataFrame]:
        texts = docs.select(row_ids(docs, number or key, text, hashed).alias("id"), F.col(key).alias("key"), F.col(text).cast("binary").alias("__text"))
        return texts, written(signatures(texts, n), "signatures")

    texts, rows = numbered(False)
    # Texts are met by id below: unlike texts under one id would meet in the square of their number.
    if rows.groupBy("id").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").limit(1).count():
        discard(rows)
        texts, rows = numbered(True)
    size = F.col("size").cast("long")
    need = F.ceil(size * percent / F.lit(100))

    def slack(size: Column) -> Column:
        return F.least(1 + F.floor(size / SLACK), F.ceil(size * percent / F.lit(100)))

    alone = first_grams(texts, n, percent).groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count("*").alias("alone"))
    # The least partner has ``need`` grams. An id on several rows proves nothing about any of them.
    done = rows.groupBy("id").agg(F.count("*").alias("rows"), F.max("size").alias("size")).join(alone, "id").where((F.col("rows") == 1) & (F.col("alone") > size - need + slack(size) - slack(need)))
    reps = written(rows.where("size > 0").join(done.select("id"), "id", "left_anti").groupBy("k", "size").agg(F.min("id").alias("id")), "representatives")
    found = grams_of(texts.select("id", "__text").join(small(reps.select("id", "k"), 24), "id"), n)
    if rows.groupBy("k", "id").count().where("count > 1").limit(1).count():
        found = found.dropDuplicates(["h", "k"])
    looked = written(grams_of(texts.select("id", "__text").join(small(reps.select("id", "k").where(F.pmod("k", F.lit(LOOK)) == 0), 24), "id"), n).groupBy("h").agg(F.countDistinct("k").alias("n")), "looked")
    bound = max(8, (looked.agg(F.sum("n")).first()[0] or 0) // FREQUENT)
    frequent = looked.where(F.col("n") > bound).select("h", (F.col("n") * LOOK).alias("estimate"))  # at most FREQUENT rows
    # A frequent gram's rows go to tasks by set, all others by gram; one shuffle serves for the count and what follows.
    hot = F.col("estimate").isNotNull()
    postings = found.join(F.broadcast(frequent), "h", "left").select(F.when(hot, F.xxhash64("h", "k")).otherwise(F.col("h")).alias("at"), "k", F.when(hot, F.struct("h", "estimate")).alias("hot"))
    counted = postings.select("k", F.coalesce("hot.h", "at").alias("h"), F.coalesce("hot.estimate", F.count("*").over(W.partitionBy("at"))).alias("df")).where("df > 1")
    pairs = counted.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("pairs"))
    sets = written(prefixes(pairs.join(small(reps.select("k", "size"), 24), "k").select("k", "size", "pairs"), percent), "prefixes")
    discard(reps, looked)
    return rows, sets


def _postings(sets: DataFrame) -> DataFrame:
    """(k, size, l, own, h) for every gram of every prefix; own is the number of grams that no other set has."""
    return sets.select("k", "size", "l", (F.col("size") - F.size("grams")).alias("own"), F.explode(F.slice("grams", 1, F.col("m"))).alias("h"))


def stars(sets: DataFrame, percent: int) -> DataFrame:
    """(k, size, c, c_size, c_own, d, linked, delta) for every set: its centre and the difference from it.

    The centre of a posting list is its set with the fewest grams of its own (then the least key); a set's centre is that of most of its
    lists. d is the size of the symmetric difference, delta those of its grams that two sets have at all; the c_own grams that the centre
    alone has are in the difference of every set. A set that differs by more than NEAR times what a link allows is its own centre.
    """
    p = _postings(sets)
    centres = written(p.groupBy("h").agg(F.min(F.struct("own", F.col("k").alias("c"))).alias("m"), F.count("*").alias("n")).where("n > 1").select("h", "m.c", "n"), "lists")
    most = spread_join(p.select("h", "k"), centres, ["h"], ["k"]).groupBy("k", "c").agg(F.count("*").alias("n")).groupBy("k").agg(F.max_by("c", F.struct("n", "c")).alias("c"))
    pairs = written(most.where("k <> c"), "centres")
    s = sets.select("k", "size", "grams")
    members = pairs.groupBy("c").agg(F.count("*").alias("n"))
    of = written(members.join(s.select(F.col("k").alias("c"), F.col("size").alias("c_size"), F.col("grams").alias("c_grams")), "c"), "centre-sets")
    both = spread_join(s.join(small(pairs, 24), "k"), of, ["c"], ["k"], rows=pairs.count())
    d = (F.col("size") + F.col("c_size") - 2 * F.size(F.array_intersect("grams", "c_grams"))).cast("long")
    allowed = (F.col("size") + F.col("c_size")).cast("long") * (100 - percent)
    near = both.withColumn("d", d).where(F.col("d") * (100 + percent) <= NEAR * allowed)
    delta = F.concat(F.array_except("grams", "c_grams"), F.array_except("c_grams", "grams"))
    out = written(near.select("k", "size", "c", "c_size", (F.col("c_size") - F.size("c_grams")).alias("c_own"), "d", (F.col("d") * (100 + percent) <= allowed).alias("linked"), delta.alias("delta")), "stars")
    discard(centres, pairs, of)
    return out


def near_candidates(star: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets with one centre that may link although not both link to the centre.

    With centre c, x and y differ by d(x) + d(y) - 2 * |delta(x) & delta(y)|, which a link bounds by e * (|x| + |y|), e = (100 - percent) /
    (100 + percent). If x does not link to c, they must share more than half of d(y) - e * (|y| - |c|) grams of their deltas, and at least
    d(x) - |x| * (100 - percent) / percent. So prefixes of the deltas, rarest grams first, find all such pairs. The centre's own grams, which
    all deltas share, come last; one mark stands for them in a prefix that is long enough to reach them. Deltas of near copies are short
    and mostly their own, so a group of many thousands around one text meets in few of them.
    """
    grams = star.select("k", "c", F.explode("delta").alias("h"))
    frequent = written(grams.groupBy("c", "h").agg(F.count("*").alias("n"), F.count("*").alias("df")).where("n > 1"), "differences")
    lists = spread_join(grams, frequent, ["c", "h"], ["k"]).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("list"))
    full = star.drop("delta").join(lists, "k", "left").withColumn("list", F.coalesce(F.col("list.h"), F.array().cast("array<long>")))
    n = F.size("list")
    outer = F.col("d") - F.floor(F.col("size").cast("long") * (100 - percent) / F.lit(percent))
    inner = F.ceil((F.col("d") * (100 + percent) - (100 - percent) * (F.col("size") - F.col("c_size"))) / F.lit(2.0 * (100 + percent)))

    def first(t: Column) -> Column:
        t = F.greatest(F.lit(1).cast("long"), t)
        marked = F.when(t <= F.col("c_own"), F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<long>"))
        return F.concat(F.slice("list", F.lit(1), F.least(n, F.greatest(F.lit(0).cast("long"), n + F.col("c_own") - t + 1)).cast("int")), marked)

    left = full.where("NOT linked").select("c", F.col("k").alias("x"), F.col("size").alias("x_size"), F.explode(first(outer)).alias("h"))
    right = full.select("c", F.col("k").alias("y"), F.col("size").alias("y_size"), F.explode(first(inner)).alias("h"))
    left, right = (side.select("*", F.coalesce(F.xxhash64("c", "h"), F.lit(0)).alias("at"), F.col("h").isNull().alias("mark")).drop("h") for side in (left, right))
    met = left.join(right.withColumnRenamed("c", "c2"), ["at", "mark"]).where("c = c2 AND x <> y").where(_sizes_fit("x_size", "y_size", percent))
    return written(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")


def far_candidates(sets: DataFrame, star: DataFrame, percent: int) -> DataFrame:
    """Every pair of sets with different centres and classes that shares as many prefix grams as the smaller of its two l.

    In a posting list, only sets of other centres than the list's commonest meet the rest: two of the commonest have one centre.
    """
    p = _postings(sets).join(small(star.select("k", "c", "linked"), 32), "k", "left")
    p = p.select("k", "size", "l", "h", F.coalesce("c", "k").alias("c"), F.when(F.col("linked"), F.col("c")).otherwise(F.col("k")).alias("label"))
    lists = p.groupBy("h", "c").agg(F.count("*").alias("n")).groupBy("h").agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.count("*").alias("centres"), F.sum("n").alias("n")).where("centres > 1")
    lists = written(lists.select("h", "most", "n"), "lists")
    p = written(spread_join(p, lists, ["h"], ["k"]), "postings")
    b = p.select("h", *(F.col(x).alias(f"{x}2") for x in ("k", "size", "l", "c", "label")))
    met = p.where("c <> most").join(b, "h").where("c <> c2 AND label <> label2 AND (c2 = most OR k < k2)").where(_sizes_fit("size", "size2", percent))
    pairs = met.groupBy(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")).agg(F.count("*").alias("n"), F.min(F.least("l", "l2")).alias("least")).where("n >= least")
    return written(pairs.select("a", "b"), "pairs")


def all_candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Every pair of sets that shares as many prefix grams as the smaller of its two l: as many as there are such pairs."""
    p = _postings(sets)
    b = p.select("h", *(F.col(x).alias(f"{x}2") for x in ("k", "size", "l")))
    met = p.join(b, "h").where("k < k2").where(_sizes_fit("size", "size2", percent))
    return written(met.groupBy(F.col("k").alias("a"), F.col("k2").alias("b")).agg(F.count("*").alias("n"), F.min(F.least("l", "l2")).alias("least")).where("n >= least").select("a", "b"), "pairs")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(membership: key, k, size of every row; every linked pair (a, b) of distinct sets k, once)."""
    rows, sets = prepare(docs, key, text, n, percent)
    return rows, verify(all_candidates(sets, percent), sets, percent)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, number: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: key, n_shingles and component_id, the least key reachable over links.

    ``number`` is a column of short ids, which may repeat or be null, that stand for rows in shuffles instead of a hash of a wide key.
    """
    rows, sets = prepare(docs, key, text, n, percent, number)
    star = stars(sets, percent)
    pairs = written(near_candidates(star, percent).unionByName(far_candidates(sets, star, percent)).distinct(), "pairs")
    found = [star.where("linked").select(F.col("k").alias("a"), F.col("c").alias("b")), verify(pairs, sets, percent)]
    component = written(connected_components(union_all(found)).select(F.col("node").alias("k"), F.col("component").alias("c")), "set-classes")
    discard(star, pairs, sets)
    whole = rows.where("size > 0")
    own = written(whole.groupBy("k").agg(F.min("key").alias("least"), F.count("*").alias("n")), "least-keys")
    parts = written(component.join(own, "k").select("k", "c", "least"), "parts")
    of = written(parts.groupBy("c").agg(F.min("least").alias("of"), F.count("*").alias("n")), "least-of-classes")
    least = own.join(spread_join(parts.select("k", "c"), of, ["c"], ["k"]).select("k", "of"), "k", "left").where("n > 1 OR of IS NOT NULL")
    least = written(least.select("k", F.struct(F.coalesce("of", "least").alias("v")).alias("least"), "n"), "least-of-sets")
    discard(component, own, parts, of)
    shown = spread_join(whole, least, ["k"], [F.monotonically_increasing_id()], "left").select("key", "size", F.when(F.col("least").isNull(), F.col("key")).otherwise(F.col("least.v")).alias("component_id"))
    out = shown.unionByName(rows.where("size = 0").select("key", "size", F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), F.col("size").cast("long").alias("n_shingles"), "component_id")
