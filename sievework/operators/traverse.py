"""Bounded traversal from weighted seeds, and strongly connected components."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

MAX_DEPTH, MAX_LIMIT, MAX_SEEDS, MAX_VISITED = 5, 1000, 50, 5000


@dataclass(frozen=True)
class Seed:
    id: str
    position: int
    weight: float


def normalise_seeds(start: str | None = None, seeds: list[str] | None = None, weights: list[float] | None = None) -> list[Seed]:
    """Exactly one of ``start`` and ``seeds``; at most 50; a repeated seed keeps its first place and largest weight."""
    if bool(start) == bool(seeds):
        raise ValueError("give either a start or seeds")
    ids = [start] if start else list(seeds or [])
    if len(ids) > MAX_SEEDS:
        raise ValueError(f"at most {MAX_SEEDS} seeds")
    if weights and len(weights) != len(ids):
        raise ValueError("one weight for each seed")
    best: dict[str, float] = {}
    for i, w in zip(ids, weights or [1.0] * len(ids)):
        if not i:
            raise ValueError("an empty seed")
        best[i] = max(best.get(i, w), w)
    return [Seed(i, n, float(w)) for n, (i, w) in enumerate(best.items())]


@dataclass
class Traversal:
    rows: DataFrame
    seed_scores: DataFrame
    truncated: bool
    visited: int


def traverse(relations: dict[str, DataFrame | Callable[[DataFrame], DataFrame]], seeds: list[Seed], follow: list[str], depth: int = 2, limit: int = 100, keep: Column | None = None, locatable: DataFrame | None = None) -> Traversal:
    """Breadth-first steps over the relations (src, dst), step t following ``follow[t mod len]``.

    A hit at depth d scores weight / (1 + d). Within a step a target keeps its best hit (ties: the earlier seed, then the
    smaller source). Targets not seen before expand, if ``locatable`` (id) has them, and become rows if ``keep`` (over
    columns dst and those of the relation) holds; a later, better hit improves a row's score. ``limit`` bounds rows, and
    the edges of one node in a step, smallest dst first. At 5000 expanded nodes the current step is dropped.
    Rows: target, edge_kind, source, seed, depth, via, score, in order of score, depth, target.

    Each step is one join of the frontier, at most 5000 rows, with a relation, whose repeated rows count once; they are dropped after the join, so that no
    whole relation is made distinct. Both results of a step go to the shared folder. A relation that must first be joined from others may be a function
    from the nodes (id) that expand to the rows of these nodes, so that a step makes no edges of other nodes.
    """
    if not 1 <= depth <= MAX_DEPTH or not 1 <= limit <= MAX_LIMIT or not follow:
        raise ValueError("depth is 1 to 5, limit 1 to 1000, and something must be followed")
    for kind in follow:
        if kind not in relations:
            raise ValueError(f"no relation {kind!r}")
    spark = SparkSession.active()
    frontier = spark.createDataFrame([(s.id, s.id, s.position, s.weight) for s in seeds], "node string, seed string, position int, weight double")
    seen = frontier.select(F.col("node").alias("target"))
    rows, bests, hits_all = None, None, None
    truncated, visited, emitted, size = False, 0, 0, len(seeds)
    for t in range(depth):
        kind = follow[t % len(follow)]
        if visited + size > MAX_VISITED:
            truncated, visited = True, MAX_VISITED
            break
        visited += size
        rel = relations[kind]
        if not isinstance(rel, DataFrame):
            rel = rel(frontier.select(F.col("node").alias("id")).distinct())
        edges = F.broadcast(frontier).join(rel.withColumnRenamed("src", "node"), "node").distinct()
        edges = edges.withColumn("__k", F.row_number().over(W.partitionBy("seed", "node").orderBy("dst"))).where(F.col("__k") <= limit).drop("__k")
        hits = edges.withColumns({"depth": F.lit(t + 1), "score": F.col("weight") / F.lit(float(t + 2)), "edge_kind": F.lit(kind)})
        one = W.partitionBy("dst").orderBy(F.desc("score"), "position", "node")
        best = stored(hits.withColumn("__k", F.row_number().over(one)), "hits")
        scores = best.groupBy("seed").agg(F.max("score").alias("score"))
        hits_all = scores if hits_all is None else hits_all.unionAll(scores)
        best = best.where("__k = 1").drop("__k")
        new = best.join(seen, best["dst"] == seen["target"], "left_anti")
        passes = new if keep is None else new.where(keep)
        step = passes.select(F.col("dst").alias("target"), "edge_kind", F.col("node").alias("source"), "seed", "depth", F.array("edge_kind").alias("via"), "score")
        count = step.count()
        if emitted + count > limit:
            truncated = True
        step = stored(step.orderBy(F.desc("score"), "target").limit(max(0, limit - emitted)), "rows") if count else step
        emitted = min(limit, emitted + count)
        again = best.select(F.col("dst").alias("target"), F.col("score").alias("later"))
        bests = again if bests is None else bests.unionAll(again)
        rows = step if rows is None else rows.unionAll(step)
        if truncated:
            break
        grown = new if locatable is None else new.join(locatable.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
        frontier = stored(grown.select(F.col("dst").alias("node"), "seed", "position", "weight"), "frontier")
        seen = seen.unionAll(new.select(F.col("dst").alias("target")))
        size = frontier.count()
        if not size:
            break
    if rows is None:
        empty = "target string, edge_kind string, source string, seed string, depth int, via array<string>, score double"
        return Traversal(spark.createDataFrame([], empty), spark.createDataFrame([], "seed string, score double"), truncated, visited)
    top = bests.groupBy("target").agg(F.max("later").alias("later"))
    out = rows.join(top, "target", "left").withColumn("score", F.greatest("score", "later")).drop("later")
    return Traversal(out.orderBy(F.desc("score"), "depth", "target"), hits_all.groupBy("seed").agg(F.max("score").alias("score")), truncated, visited)


def reachable(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) for all paths of one edge or more, by squaring: the number of rounds is the logarithm of the longest path."""
    cur, n = stored(edges.select("src", "dst").distinct(), "closure"), -1
    for _ in range(max_rounds):
        m = cur.count()
        if m == n:
            return cur
        n = m
        a, b = cur.alias("a"), cur.alias("b")
        longer = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        cur = stored(cur.unionAll(longer).distinct(), "closure")
    raise RuntimeError(f"the closure did not settle in {max_rounds} rounds")


#: Edges that one task takes: what is left of a graph by then is decided there.
ONE_TASK_EDGES = 500_000


def strong_components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) of nodes on cycles: those that reach each other share their smallest node. Self-loops count; null ends do not.

    Large graphs shrink in rounds: nodes without a way in or out are trimmed as long as that takes a tenth of the edges, and a node with a single way
    out (or in) becomes part of the node at its other end, as long as that takes a tenth (see ``_merge``); then every node takes the
    smallest node that reaches it as its colour, and what reaches that node within the colour is its component. Components and edges between
    colours go, and the rest goes on. No round has more rows than edges. Once ``one_task`` edges are left, one task finishes. At last merged nodes
    find out, from the last merge to the first, whether they are on a cycle with what they became part of. Paths without branches
    shrink by merging, so that the number of coloured rounds grows with the longest shortest path between branches alone.
    """
    edges = stored(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    rest, found, merges = edges.where("src <> dst"), None, []
    n, stuck = rest.count(), 0
    while n:
        if n <= one_task:
            part = _components_in_one_task(rest)
            found = part if found is None else found.unionAll(part)
            break
        trimmed = stored(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "trimmed")
        before, n = n, trimmed.count()
        rest = trimmed
        if n < 0.9 * before or n <= one_task:
            continue
        if stuck < 2:  # once by ways out, once by ways in
            merge = _merge(rest, len(merges), len(merges) % 2 == 1)
            merges.append(merge)
            rest, before, n = merge[2], n, merge[2].count()
            stuck = stuck + 1 if n >= 0.9 * before else 0
            continue
        colours = _colours(rest)
        one = _roots(rest, colours)
        found = one if found is None else found.unionAll(one)
        ends = rest.join(colours.selectExpr("node AS src", "colour AS a"), "src").join(colours.selectExpr("node AS dst", "colour AS b"), "dst").where("a = b")
        done = one.select("node")
        rest = stored(ends.select("src", "dst").join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "left")
        n, stuck = rest.count(), 0
    for merge in reversed(merges):
        found = _unmerge(found, *merge[:2], merge[3])
    alone = loops.withColumn("component", F.col("node"))
    if found is None:
        return alone
    named = found.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    several = stored(found.join(named, "component").select("node", F.col("least").alias("component")), "components")
    return several.unionAll(alone.join(several.select("node"), "node", "left_anti"))


def _merge(edges: DataFrame, turn: int, ways_in: bool) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """(steps, edges as they were, edges between what is left, ways_in) after nodes became part of others.

    A node with a single way out is on a cycle only with the node it leads to, so what reaches one through it reaches the other. It becomes part of that one
    if its hash is smaller: so steps make no circle, and are few in a row. Steps (node, to, k) lead 2^k nodes on or to the last one, up to the k at which all are there.
    """
    e = edges.selectExpr("dst AS src", "src AS dst") if ways_in else edges
    single = e.groupBy("src").agg(F.min("dst").alias("to"), F.count("*").alias("n")).where("n = 1")
    rank = lambda c: F.xxhash64(F.lit(turn), c)
    step = stored(single.where(rank("src") < rank("to")).select(F.col("src").alias("node"), "to", F.lit(0).alias("k")), "steps")
    steps = step
    while True:
        on = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        nxt = stored(step.join(on, "to", "left").select("node", F.coalesce("further", "to").alias("to"), (F.col("k") + 1).alias("k"), F.col("further").isNotNull().alias("moved")), "steps")
        if nxt.where("moved").isEmpty():
            break
        step = nxt.drop("moved")
        steps = steps.unionAll(step)
    root = step.select("node", "to")
    # a merged node's way out is gone with it
    left = e.join(root.select(F.col("node").alias("src")), "src", "left_anti").join(root.withColumnRenamed("node", "dst"), "dst", "left").select("src", F.coalesce("to", "dst").alias("dst")).where("src <> dst").distinct()
    left = stored(left.selectExpr("dst AS src", "src AS dst") if ways_in else left, "merged")
    return steps, e, left, ways_in


def _unmerge(found: DataFrame | None, steps: DataFrame, edges: DataFrame, ways_in: bool) -> DataFrame:
    """(node, component) with merged nodes: those on a way from their last node, or another of its component, back to it.

    Such a way enters the merged nodes by an edge from one that was not merged; from there all steps up to the last node are on it.
    """
    node = edges.schema["src"].dataType.simpleString()
    if found is None:
        found = edges.sparkSession.createDataFrame([], f"node {node}, component {node}")
    last = steps.agg(F.max("k")).first()[0]
    if last is None:
        return found
    root = steps.where(F.col("k") == last).select("node", "to")
    label = found.withColumnRenamed("node", "of")
    roots = stored(root.join(label, F.col("to") == F.col("of"), "left").select("node", "to", F.coalesce("component", "to").alias("component")), "roots")
    enter = edges.join(root.select(F.col("node").alias("src")), "src", "left_anti").join(roots.withColumnRenamed("node", "dst"), "dst")
    enter = enter.join(label, F.col("src") == F.col("of"), "left").where(F.coalesce(label["component"], F.col("src")) == roots["component"])
    marked = stored(enter.select(F.col("dst").alias("node")).distinct(), "marked")
    for k in range(last + 1):
        further = steps.where(F.col("k") == k).join(marked, "node", "left_semi").select(F.col("to").alias("node"))
        marked = stored(marked.unionAll(further).distinct(), "marked")
    # the last nodes are marked too, and those that had no component are one with what is merged into them
    inner = roots.join(marked, "node", "left_semi")
    ends = inner.select(F.col("to").alias("node"), "component")
    return stored(found.unionAll(inner.select("node", "component")).unionAll(ends).distinct(), "unmerged")


def _colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches each; only nodes whose colour has changed pass it on."""
    colours = stored(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("colour", F.col("node")).withColumn("fresh", F.lit(True)), "colours")
    while True:
        sent = edges.join(colours.where("fresh").selectExpr("node AS src", "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("got"))
        step = colours.join(sent, "node", "left")
        better = F.coalesce(F.col("got") < F.col("colour"), F.lit(False))
        colours = stored(step.select("node", F.least("colour", "got").alias("colour"), better.alias("fresh")), "colours")
        if colours.where("fresh").isEmpty():
            return colours.select("node", "colour")


def _roots(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(node, component) of all nodes that reach the node their colour is named after, within the colour."""
    within = edges.join(colours.selectExpr("node AS src", "colour"), "src").join(colours.selectExpr("node AS dst", "colour AS other"), "dst").where("colour = other").select("src", "dst", "colour")
    within = stored(within, "within")
    last = stored(colours.where("node = colour").selectExpr("node", "colour AS component"), "reached")
    reached = last
    while True:
        back = within.join(last.selectExpr("node AS dst"), "dst", "left_semi").selectExpr("src AS node", "colour AS component").distinct()
        last = stored(back.join(reached.select("node"), "node", "left_anti"), "reached")
        if last.isEmpty():
            return stored(reached, "reached")
        reached = reached.unionAll(last)


def _components_in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of the components with two nodes or more, by a depth-first walk (Tarjan's) over bounded edges."""
    import pyarrow as pa

    kind = edges.schema["src"].dataType.simpleString()

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.concat_tables(tables)
        names = pa.concat_arrays(t["src"].chunks + t["dst"].chunks).unique()
        number = {v: k for k, v in enumerate(names.to_pylist())}
        out: list[list[int]] = [[] for _ in number]
        for a, b in zip(t["src"].to_pylist(), t["dst"].to_pylist()):
            out[number[a]].append(number[b])
        label = walk(out)
        values = names.to_pylist()
        groups: dict[int, list] = {}
        for k, c in enumerate(label):
            groups.setdefault(c, []).append(values[k])
        rows = [(v, min(g)) for g in groups.values() if len(g) > 1 for v in g]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], names.type) for k in (0, 1)], ["node", "component"])

    def walk(out: list[list[int]]) -> list[int]:
        n = len(out)
        order, low, label, at, stack = [-1] * n, [0] * n, [-1] * n, [0] * n, []
        clock = 0
        for start in range(n):
            if order[start] >= 0:
                continue
            path = [start]
            while path:
                v = path[-1]
                if order[v] < 0:
                    order[v] = low[v] = clock
                    clock += 1
                    stack.append(v)
                if at[v] < len(out[v]):
                    w = out[v][at[v]]
                    at[v] += 1
                    if order[w] < 0:
                        path.append(w)
                    elif label[w] < 0:
                        low[v] = min(low[v], order[w])
                    continue
                path.pop()
                if path:
                    low[path[-1]] = min(low[path[-1]], low[v])
                if low[v] == order[v]:
                    while label[v] < 0:
                        label[stack.pop()] = v
        return label

    return stored(edges.repartition(1).mapInArrow(run, f"node {kind}, component {kind}"), "components")
