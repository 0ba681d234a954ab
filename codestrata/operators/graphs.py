"""Traversals over edge tables: route traces, dependency cycles, impact."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scratch import BATCH_ROWS, bound_batches, cut, kept, small


def flows(routes: DataFrame, calls: DataFrame, symbols: DataFrame, nodes: int = 12, depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """(nodes: repo, flow, n, id, type, label, file, line; edges: repo, flow, source, target, type) of the trace of each route.

    A trace is a breadth-first walk over resolved calls from the handler, at most ``depth`` calls deep and ``nodes`` long with the route.
    Level by level: a node is found by the least (place of its caller, file and place of the call), unless an earlier level has it.
    """
    last = symbols.groupBy("repo", "id").agg(F.max_by(F.struct("type", F.col("name").alias("label"), "file", "line"), F.struct("file", "ord")).alias("s"))
    out = calls.where("target IS NOT NULL").join(last.select("repo", F.col("id").alias("target")), ["repo", "target"]).groupBy("repo", "source", "target").agg(F.min(F.struct("file", "ord")).alias("first"))
    start = routes.select("repo", F.col("id").alias("flow"), F.col("handler").alias("node")).distinct()
    frontier = start.withColumn("level", F.lit(0)).withColumn("place", F.lit(1)).withColumn("source", F.lit(None).cast("string"))
    seen = frontier
    for level in range(1, depth + 1):
        met = frontier.join(out, [frontier.repo == out.repo, frontier.node == out.source]).select(frontier.repo, "flow", frontier.node.alias("source"), F.col("target").alias("node"), F.struct(F.col("place"), F.col("first")).alias("key"))
        new = met.groupBy("repo", "flow", "node").agg(F.min("key").alias("key"), F.min_by("source", "key").alias("source")).join(seen.select("repo", "flow", "node"), ["repo", "flow", "node"], "left_anti")
        place = F.row_number().over(W.partitionBy("repo", "flow").orderBy("key"))
        frontier = new.select("repo", "flow", "node", F.lit(level).alias("level"), place.alias("place"), "source").where(F.col("place") <= nodes)
        frontier = cut(frontier) if level < depth else frontier
        seen = seen.unionByName(frontier)
    named = seen.join(last.withColumnRenamed("id", "node"), ["repo", "node"])
    n = 1 + F.row_number().over(W.partitionBy("repo", "flow").orderBy("level", "place"))
    named = named.withColumn("n", n).where(F.col("n") <= nodes)
    top = routes.select("repo", F.col("id").alias("flow"), F.lit(1).alias("n"), "id", F.lit("route").alias("type"), F.concat_ws(" ", "method", "path").alias("label"), "file", "line")
    rows = top.unionByName(named.select("repo", "flow", "n", F.col("node").alias("id"), "s.type", "s.label", "s.file", "s.line"))
    edges = named.select("repo", "flow", F.coalesce("source", "flow").alias("source"), F.col("node").alias("target"), F.when(F.col("level") == 0, "handles").otherwise("calls").alias("type"))
    return rows, edges


def flow_summaries(rows: DataFrame) -> DataFrame:
    """(repo, flow, name, confidence, nodes): 0.86 for a trace of several nodes, else 0.6."""
    g = rows.groupBy("repo", "flow").agg(F.count("*").alias("nodes"), F.min_by("label", "n").alias("name"))
    return g.withColumn("confidence", F.when(F.col("nodes") > 1, 0.86).otherwise(0.6).cast("double"))


def trace(rows: DataFrame, query: str) -> DataFrame:
    """Nodes of the flows of which any label (the route's name is one) contains the query, in any case of letters. The nodes are walked once, and written."""
    rows = kept(rows)
    return rows.join(rows.where(F.lower("label").contains(query.lower())).select("repo", "flow").distinct(), ["repo", "flow"], "left_semi")


def hits(query: str, symbols: DataFrame, ids: bool = True) -> DataFrame:
    """Symbols whose name (or id) contains the query, in any case of letters."""
    found = F.lower("name").contains(query.lower())
    return symbols.where(found | F.lower("id").contains(query.lower()) if ids else found)


def impact(query: str, symbols: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """(repo, dependent): files that import, and symbols that call, what the query names; distinct. Of the calls, those to ``hits`` are enough."""
    hit = hits(query, symbols)
    a = imports.join(hit.select("repo", F.col("file").alias("target")).distinct(), ["repo", "target"], "left_semi").select("repo", F.col("file").alias("dependent"))
    b = calls.join(hit.select("repo", F.col("id").alias("target")).distinct(), ["repo", "target"], "left_semi").select("repo", F.col("source").alias("dependent"))
    return a.union(b).distinct()


def impact_by_name(query: str, symbols: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """(repo, dependent, relation), one row for each edge; only names are searched. Of the calls, those to ``hits`` are enough."""
    hit = hits(query, symbols, ids=False)
    a = imports.join(hit.select("repo", F.col("file").alias("target")).distinct(), ["repo", "target"], "left_semi").select("repo", F.col("file").alias("dependent"), F.lit("imports").alias("relation"))
    b = calls.join(hit.select("repo", F.col("id").alias("target")).distinct(), ["repo", "target"], "left_semi").select("repo", F.col("source").alias("dependent"), F.lit("calls").alias("relation"))
    return a.unionByName(b)


def walk(graph: dict[str, list[str]], root: str, done: set[str], inside: set[str] | None = None) -> tuple[set[tuple[str, ...]], list[str]]:
    """(rings, exits) of a depth-first walk from ``root``, neighbours in order: a back edge closes a ring, turned to its least node. Nodes outside of
    ``inside`` are not entered; ``exits`` has them in the order in which they are first met."""
    path, place, todo = [root], {root: 0}, [iter(graph.get(root, ()))]
    done.add(root)
    found: set[tuple[str, ...]] = set()
    exits: dict[str, None] = {}
    while todo:
        for b in todo[-1]:
            if inside is not None and b not in inside:
                exits.setdefault(b)
            elif b in place:
                ring = path[place[b] :]
                k = ring.index(min(ring))
                found.add(tuple(ring[k:] + ring[:k]))
            elif b not in done:
                done.add(b)
                place[b] = len(path)
                path.append(b)
                todo.append(iter(graph.get(b, ())))
                break
        else:
            todo.pop()
            place.pop(path.pop())
    return found, list(exits)


def _adjacent(edges: Iterable[tuple[str, str]]) -> dict[str, list[str]]:
    graph: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        graph.setdefault(a, []).append(b)
    return graph


def cycles_of(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Cycles closed by back edges of a depth-first walk from each node in order, neighbours in order; each turned to its least node, sorted."""
    graph, done = _adjacent(edges), set()
    found: set[tuple[str, ...]] = set()
    for root in sorted(graph):
        if root not in done:
            found |= walk(graph, root, done)[0]
    return [list(c) for c in sorted(found)]


def strong_components(edges: DataFrame) -> DataFrame:
    """(repo, node, component) of all nodes of (repo, a, b) in a strongly connected component of two or more, named by one of its nodes.

    Rounds of joins: edges whose begin has no way in or whose end has no way out are trimmed until none is left to trim. Then every node takes
    the least node that reaches it (its colour); of a colour, what reaches its own least node back is a component. It is taken out, with all edges
    between colours, and the rest goes round again. The number of rounds grows with the longest way, not with the number of nodes.
    """
    live = cut(edges.where("a <> b").select("repo", "a", "b").distinct())
    out = None
    while True:
        left = -1
        while (n := live.count()) != left:
            left = n
            kept = live.join(live.select("repo", F.col("b").alias("a")).distinct(), ["repo", "a"], "left_semi").join(live.select("repo", F.col("a").alias("b")).distinct(), ["repo", "b"], "left_semi")
            live = cut(kept.select("repo", "a", "b"))
        if not left:
            return out if out is not None else live.select("repo", F.col("a").alias("node"), F.col("b").alias("component"))
        colour = cut(live.select("repo", F.col("a").alias("node"), F.col("a").alias("colour")).distinct())
        changed = colour
        while changed.limit(1).count():
            sent = changed.join(live.withColumnRenamed("a", "node"), ["repo", "node"]).groupBy("repo", F.col("b").alias("node")).agg(F.min("colour").alias("sent"))
            changed = cut(sent.join(colour, ["repo", "node"]).where("sent < colour").select("repo", "node", F.col("sent").alias("colour")))
            colour = cut(colour.unionByName(changed).groupBy("repo", "node").agg(F.min("colour").alias("colour")))
        of = lambda end, name: colour.select("repo", F.col("node").alias(end), F.col("colour").alias(name))
        live = cut(live.join(of("a", "colour"), ["repo", "a"]).join(of("b", "other"), ["repo", "b"]).where("colour = other").drop("other"))
        reached = cut(colour.where("node = colour"))
        frontier = reached
        while frontier.limit(1).count():
            back = live.join(frontier.select("repo", F.col("node").alias("b"), "colour"), ["repo", "b", "colour"]).select("repo", F.col("a").alias("node"), "colour").distinct()
            frontier = cut(back.join(reached, ["repo", "node", "colour"], "left_anti"))
            reached = cut(reached.unionByName(frontier))
        ends = reached.select("repo", "node")
        found = reached.join(reached.groupBy("repo", "colour").count().where("count > 1"), ["repo", "colour"], "left_semi").select("repo", "node", F.col("colour").alias("component"))
        out = cut(found if out is None else out.unionByName(found))
        live = cut(live.drop("colour").join(ends.withColumnRenamed("node", "a"), ["repo", "a"], "left_anti").join(ends.withColumnRenamed("node", "b"), ["repo", "b"], "left_anti"))


RINGS = "repo string, component string, cycle array<string>, node string, place string"


def _component_walks(edges: DataFrame) -> DataFrame:
    """For each component (repo, component, entry, a, b, inside): its rings, and the nodes outside in the order in which its walk meets them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        repo, component, entry = (pdf[c].iloc[0] for c in ("repo", "component", "entry"))
        rings, exits = walk(_adjacent(zip(pdf["a"], pdf["b"], strict=True)), entry, set(), set(pdf["a"]))
        rows = [(repo, component, list(r), None, None) for r in sorted(rings)] + [(repo, component, None, x, f"{i:010d}") for i, x in enumerate(exits)]
        return pd.DataFrame(rows, columns=["repo", "component", "cycle", "node", "place"], dtype=object)

    return edges.groupBy("repo", "component").applyInPandas(run, RINGS)


def cycles_by_component(edges: DataFrame) -> DataFrame:
    """(repo, cycle): the same cycles as ``cycles_of`` for edges (repo, a, b), where only one component's edges reach a task.

    Which node of a component the walk over the whole repository enters first decides which cycles it closes there, so components are walked in
    topological rounds. Each carries as its key the places at which the walk left the components before it, the root's name first: the entry is the
    end of the edge of least key, or the least node where no edge comes earlier. Rounds stop once all components with a cycle are done.
    """
    e = cut(edges.select("repo", "a", "b").distinct())
    strong = strong_components(e)
    every = e.select("repo", F.col("a").alias("node")).union(e.select("repo", "b")).distinct()
    of = cut(every.join(strong, ["repo", "node"], "left").withColumn("component", F.coalesce("component", "node")))
    side = lambda end, name: of.select("repo", F.col("node").alias(end), F.col("component").alias(name))
    e = cut(e.join(side("a", "component"), ["repo", "a"]).join(side("b", "into"), ["repo", "b"]))
    between = cut(e.where("component <> into").select("repo", "component", "into", "b").distinct())
    ringed = cut(e.where("component = into").select("repo", "component").distinct())
    todo = cut(of.groupBy("repo", "component").agg(F.min("node").alias("least")))
    met = out = None
    while todo.join(ringed, ["repo", "component"], "left_semi").limit(1).count():
        waits = between.join(todo.select("repo", "component"), ["repo", "component"], "left_semi").select("repo", F.col("into").alias("component")).distinct()
        ready = todo.join(waits, ["repo", "component"], "left_anti").select("repo", "component", F.struct(F.array("least").alias("key"), F.col("least").alias("entry")).alias("k"))
        if met is not None:
            ready = ready.unionByName(met.join(ready.select("repo", "component"), ["repo", "component"], "left_semi"))
        ready = cut(ready.groupBy("repo", "component").agg(F.min("k").alias("k")))
        own = e.join(ready, ["repo", "component"]).select("repo", "component", "a", "b", F.col("k.entry").alias("entry"))
        walked = cut(_component_walks(own.join(ringed, ["repo", "component"], "left_semi")))
        rings = walked.where("cycle IS NOT NULL").select("repo", "cycle")
        # The walk leaves a node without a cycle by its neighbours in order, so their names are the places.
        left = walked.where("node IS NOT NULL").select("repo", "component", "node", "place").unionByName(own.join(ringed, ["repo", "component"], "left_anti").select("repo", "component", F.col("b").alias("node"), F.col("b").alias("place")))
        left = left.join(ready, ["repo", "component"]).select("repo", "node", F.struct(F.concat("k.key", F.array("place")).alias("key"), F.col("node").alias("entry")).alias("k"))
        left = cut(left.join(of, ["repo", "node"]).groupBy("repo", "component").agg(F.min("k").alias("k")))
        met = left if met is None else cut(met.unionByName(left).groupBy("repo", "component").agg(F.min("k").alias("k")))
        out = rings if out is None else out.unionByName(rings)
        todo = cut(todo.join(ready, ["repo", "component"], "left_anti"))
    return out if out is not None else edges.limit(0).select("repo", F.array("a").alias("cycle"))


#: Edges of a repository that are walked in one task; the cycles of larger ones are found by component.
WALK_EDGES = 100_000


def dependency_cycles(imports: DataFrame, most: int = WALK_EDGES) -> DataFrame:
    """(repo, cycle) of each repository's local imports: the cycles that a depth-first walk over its files in order closes.

    A repository of at most ``most`` edges is one group. Larger ones go by strongly connected components (``cycles_by_component``), with the same
    result, so the largest group is the largest component, or ``most`` edges.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = cycles_of(list(zip(pdf["file"], pdf["target"], strict=True)))
        return pd.DataFrame({"repo": [pdf["repo"].iloc[0]] * len(found), "cycle": found}, dtype=object)

    edges = imports.where("target IS NOT NULL").select("repo", "file", "target").distinct()
    large = cut(edges.groupBy("repo").count().where(F.col("count") > most).select("repo"))
    few = lambda df: df.groupBy("repo").applyInPandas(run, "repo string, cycle array<string>")
    if not large.limit(1).count():
        return few(edges)
    big = cycles_by_component(edges.join(small(large, 64), "repo", "left_semi").select("repo", F.col("file").alias("a"), F.col("target").alias("b")))
    return few(edges.join(small(large, 64), "repo", "left_anti")).unionByName(big)


#: Steps of paths that are taken at once in a task.
STEPS = 1 << 20


def short_cycles_of(a: np.ndarray, b: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rows of nodes) of the simple cycles of at most ``longest`` nodes over edges a -> b of numbered nodes, each from its least node on.

    Paths are grown from all edges at once, as far as a path's nodes stay above its first; at most STEPS steps (or those of one path) are held for each length.
    """
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    yield 1, a[a == b][:, None]
    first = np.searchsorted(a, np.arange(max(a.max(initial=-1), b.max(initial=-1)) + 2))
    edge = a * len(first) + b

    def grown(paths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        at = paths[:, -1]
        back = at * len(first) + paths[:, 0]
        place = np.minimum(np.searchsorted(edge, back), len(edge) - 1)
        yield paths.shape[1], paths[edge[place] == back]
        if paths.shape[1] == longest:
            return
        steps = first[at + 1] - first[at]
        ends = np.cumsum(steps)
        begin = 0
        while begin < len(paths):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + STEPS, "right")))
            n = steps[begin:end]
            of = np.repeat(np.arange(begin, end), n)
            new = b[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[at[of]]]
            good = (new > paths[of, 0]) & (new[:, None] != paths[of, 1:]).all(axis=1)
            if good.any():
                yield from grown(np.column_stack((paths[of[good]], new[good])))
            begin = end

    for begin in range(0, len(a), STEPS):
        some = slice(begin, begin + STEPS)
        up = b[some] > a[some]
        if longest > 1 and up.any():
            yield from grown(np.column_stack((a[some][up], b[some][up])))


def short_cycles(imports: DataFrame, longest: int = 4, most: int = WALK_EDGES) -> DataFrame:
    """(repo, cycle): all simple cycles of at most ``longest`` files, from their least file on.

    Paths outnumber edges by far, so they are not shuffled: a repository of at most ``most`` imports is one group, whose task grows the paths in bounded
    steps. Larger ones go by joins alone, in which the last step is a join on both of its ends.
    """
    bound_batches(imports.sparkSession)

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(group))
        names, codes = np.unique(np.concatenate([table[c].to_numpy() for c in ("a", "b")]), return_inverse=True)  # by code points, as strings are compared
        edges = np.unique(codes.reshape(2, -1), axis=1).astype(np.int64)
        text, repo = pa.array(names, pa.string()), table["repo"][0].as_py()
        for length, cycles in short_cycles_of(*edges, longest):
            for at in range(0, len(cycles), BATCH_ROWS * 20):
                some = cycles[at : at + BATCH_ROWS * 20]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, some.size + 1, length), pa.int32()), text.take(pa.array(some.reshape(-1))))
                yield pa.RecordBatch.from_arrays([pa.array([repo] * len(some), pa.string()), lists], names=["repo", "cycle"])

    edges = kept(imports.where("target IS NOT NULL").select("repo", F.col("file").alias("a"), F.col("target").alias("b")))
    large = cut(edges.groupBy("repo").count().where(F.col("count") > most).select("repo"))
    few = lambda df: df.groupBy("repo").applyInArrow(run, "repo string, cycle array<string>")
    if not large.limit(1).count():
        return few(edges)
    big = short_cycles_by_joins(edges.join(small(large, 64), "repo", "left_semi").distinct(), longest)
    return few(edges.join(small(large, 64), "repo", "left_anti")).unionByName(big)


def short_cycles_by_joins(e: DataFrame, longest: int) -> DataFrame:
    """The same for distinct edges (repo, a, b), by joins alone."""
    paths = e.where("b >= a").select("repo", F.col("a").alias("start"), F.col("b").alias("at"), F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b")).alias("path"))
    out = paths.where("start = at").select("repo", F.col("path").alias("cycle"))
    paths = paths.where("start < at")
    back = e.select("repo", F.col("a").alias("at"), F.col("b").alias("start"))
    for length in range(2, longest + 1):
        out = out.unionByName(paths.join(back, ["repo", "at", "start"], "left_semi").select("repo", F.col("path").alias("cycle")))
        if length < longest:
            step = paths.join(e.withColumnRenamed("a", "at"), ["repo", "at"])
            paths = step.where((F.col("b") > F.col("start")) & ~F.array_contains("path", F.col("b"))).select("repo", "start", F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"))
    return out
