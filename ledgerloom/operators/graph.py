"""Graphs of dependencies: edges (src, dst), from what depends to what it depends on; nodes (node).

Longest paths, cycles and reachability run inside tasks that hold whole components (see `local_graph`): all edges in one
task where there are at most LOCAL of them, else whole components dealt out over tasks, which take about PACK edges at a
time. The edges of a component that alone has more than LOCAL stay in DataFrames, and rounds of joins give the same results.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.operators import local_graph
from ledgerloom.storage import importable, settled

#: Edges of one component that a task may hold: some hundred bytes for each.
LOCAL = 1_000_000
#: Edges of smaller components that a task takes together, so that its memory doesn't grow with its share of all edges.
PACK = 100_000


def last_creators(creates: DataFrame) -> DataFrame:
    """creates: (name, file_name, file_ord, create_ord): the last file to create each name."""
    return creates.groupBy("name").agg(F.max_by("file_name", F.struct("file_ord", "create_ord")).alias("creator"))


def reference_edges(references: DataFrame, creators: DataFrame, own: DataFrame) -> DataFrame:
    """references: (file_name, name, ord); own: (file_name, name) tables that a file creates. Edges by name, not to itself."""
    outside = references.join(own, ["file_name", "name"], "left_anti").join(creators, "name").where(F.col("creator") != F.col("file_name"))
    return outside.select(F.col("file_name").alias("src"), F.col("creator").alias("dst"), F.col("name").alias("via"), F.lit(0).alias("priority"), "ord")


def declared_edges(declared: DataFrame, nodes: DataFrame, via: str, priority: int) -> DataFrame:
    """declared: (src, dst, ord): those to nodes that exist, not to itself."""
    known = declared.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").where(F.col("src") != F.col("dst"))
    return known.select("src", "dst", F.lit(via).alias("via"), F.lit(priority).alias("priority"), "ord")


def first_edges(edges: DataFrame, *keep: str) -> DataFrame:
    """One edge for each (src, dst): the first by priority, then order. edges: (src, dst, priority, ord, ...)."""
    top = edges.groupBy("src", "dst").agg(F.min(F.struct("priority", "ord", *keep)).alias("top"))
    return top.select("src", "dst", *(F.col(f"top.{c}").alias(c) for c in keep))


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing depends on."""
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that depend on nothing."""
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, leaves."""
    parts = ((nodes, "nodes"), (edges, "edges"), (leaves(nodes, edges), "leaves"))
    kinds = None
    for df, name in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        kinds = one if kinds is None else kinds.union(one)
    return kinds.agg(*(F.sum(F.when(F.col("kind") == name, F.col("n"))).alias(name) for _, name in parts))


def packs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows in the order of their column `component`, whole components together: as many as it takes to have `size` rows."""
    held, last = [], []  # rows of components that are whole, those of the last one so far
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("component")
        begin = pc.index(names, names[-1]).as_py()
        if last and (begin or names[0] != last[0].column("component")[0]):
            # the last component ends in this batch, or did before it
            held, last = held + last, []
        if begin:
            held.append(batch.slice(0, begin))
        if sum(b.num_rows for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
        last.append(batch.slice(begin))
    if held or last:
        yield pa.Table.from_batches(held + last)


def _in_tasks(edges: DataFrame, run: Callable[[pa.Array, np.ndarray, np.ndarray], Iterator[dict]], schema: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows that `run` gives from whole components, edges of the components that are too large for a task, if any).

    run: nodes, and the ends of edges as places among them; gives columns. schema: of its rows, {node} the nodes' type.
    """
    spark = edges.sparkSession
    importable(spark)
    seen = Observation()
    own = settled(edges.select("src", "dst").where("src is not null and dst is not null").distinct().observe(seen, F.count("*").alias("n")))
    schema = schema.replace("{node}", own.schema["src"].dataType.simpleString())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            table = pa.Table.from_batches(held)
            for columns in run(*local_graph.numbered(table.column("src"), table.column("dst"))):
                yield pa.RecordBatch.from_pydict(columns)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in packs(batches, PACK):
            yield from whole(table.to_batches())

    if seen.get["n"] <= LOCAL:
        return own.coalesce(1).mapInArrow(whole, schema), None
    found = components(own.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    labelled = settled(own.join(found, own["src"] == found["node"], "left").select("src", "dst", F.coalesce("component", "src").alias("component")))
    sizes = settled(labelled.groupBy("component").count().where(F.col("count") > LOCAL).select("component"))
    small = labelled.join(sizes, "component", "left_anti").repartition("component").sortWithinPartitions("component").mapInArrow(packed, schema)
    return small, None if sizes.isEmpty() else settled(labelled.join(sizes, "component", "left_semi").select("src", "dst"))


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) joined by a path. Cycles are fine."""

    def run(nodes, src, dst):
        for a, b in local_graph.pairs(len(nodes), src, dst):
            yield {"src": nodes.take(pa.array(a)), "dst": nodes.take(pa.array(b))}

    small, large = _in_tasks(edges, run, "src {node}, dst {node}")
    return small if large is None else small.union(_closure_in_rounds(large))


def _closure_in_rounds(edges: DataFrame) -> DataFrame:
    """Each round joins paths with paths, so lengths double: as many rounds as the longest shortest path has binary digits."""
    now = settled(edges.distinct())
    size = now.count()
    while True:
        longer = now.join(now.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst"))
        now = settled(now.union(longer).distinct())
        if (grown := now.count()) == size:
            return now
        size = grown


def _cycles_in_rounds(edges: DataFrame) -> DataFrame:
    """(node, label): nodes on cycles, with the smallest that they share cycles with. Edges that no cycle has go first."""
    now, size = edges, edges.count()
    while size:
        kept = now.join(now.select(F.col("dst").alias("src")), "src", "left_semi").join(now.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
        now = settled(kept)
        if (left := now.count()) == size:
            break
        size = left
    paths = _closure_in_rounds(now)
    both = paths.join(paths.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"])
    return settled(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("label")))


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): edges on the longest path down from each node; those between nodes of one cycle don't count."""

    def run(names, src, dst):
        yield {"node": names, "depth": pa.array(local_graph.depths(len(names), src, dst))}

    small, large = _in_tasks(edges, run, "node {node}, depth long")
    found = small if large is None else small.union(_depths_in_rounds(large))
    return nodes.join(found, "node", "left").select("node", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def _depths_in_rounds(edges: DataFrame) -> DataFrame:
    """Level by level: what depends on nothing that is left has its depth. Cycles are taken together first."""
    label = _cycles_in_rounds(edges)
    ends = edges.join(label.select(F.col("node").alias("src"), F.col("label").alias("a")), "src", "left").join(label.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst", "left")
    left = settled(ends.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).where("src <> dst").distinct())
    known = left.select(F.col("dst").alias("node")).distinct().join(left.select(F.col("src").alias("node")), "node", "left_anti").withColumn("depth", F.lit(0).cast("long"))
    found, level = [settled(known)], 0
    while not left.isEmpty():
        level += 1
        # what waits for nothing but nodes that have their depth gets the next one
        rest = settled(left.join(found[-1].select(F.col("node").alias("dst")), "dst", "left_anti"))
        ready = left.select(F.col("src").alias("node")).distinct().join(rest.select(F.col("src").alias("node")), "node", "left_anti")
        found.append(settled(ready.withColumn("depth", F.lit(level).cast("long"))))
        left = rest
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    own = every.join(label.select("label").distinct(), every["node"] == F.col("label"), "left_anti")
    lone = label.select(F.col("node"), F.col("label")).join(every.select(F.col("node").alias("label"), "depth"), "label", "left")
    return own.union(lone.select("node", F.coalesce("depth", F.lit(0)).cast("long")))


def primary_parents(edges: DataFrame, depth: DataFrame) -> DataFrame:
    """(child, parent): of what a node depends on, the deepest; of equals the smallest."""
    known = edges.select(F.col("src").alias("child"), F.col("dst").alias("node")).join(depth, "node")
    top = known.groupBy("child").agg(F.min(F.struct((-F.col("depth")).alias("less"), "node")).alias("top"))
    return top.select("child", F.col("top.node").alias("parent"))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that depend on themselves by some path."""

    def run(names, src, dst):
        yield {"node": names.filter(pa.array(local_graph.cyclic(len(names), src, dst)))}

    small, large = _in_tasks(edges, run, "node {node}")
    return small if large is None else small.union(_cycles_in_rounds(large).select("node"))


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes that depend, by some path, on one of `start` (node); one of those too, if it depends on one."""
    spark = edges.sparkSession
    importable(spark)
    # which nodes to start from goes along as edges of their own kind: loops, none of which counts otherwise
    marked = edges.select("src", "dst").where("src <> dst").withColumn("starts", F.lit(False))
    marked = marked.union(start.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("starts")))
    loops = edges.where("src = dst").select(F.col("src").alias("node")).join(start, "node", "left_semi").distinct()

    def run(names, src, dst):
        own = src == dst
        out = local_graph.reached(len(names), src[~own], dst[~own], np.unique(src[own]))
        yield {"node": names.filter(pa.array(out))}

    small, large = _in_tasks(marked.select("src", "dst"), run, "node {node}")
    found = small if large is None else small.union(_reached_in_rounds(large))
    return found.union(loops).distinct()


def _reached_in_rounds(marked: DataFrame) -> DataFrame:
    """A frontier that moves along the edges; marked: loops are where to start from."""
    ways = marked.where("src <> dst")
    found = None
    now = marked.where("src = dst").select("dst")
    while True:
        step = ways.join(now.distinct(), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        new = settled(step if found is None else step.join(found, "node", "left_anti"))
        if new.isEmpty():
            return new if found is None else found
        found = new if found is None else settled(found.union(new))
        now = new.select(F.col("node").alias("dst"))


def blocked(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Nodes that depend, by some path, on a failed one, and haven't failed themselves."""
    return reached(edges, failed).join(failed, "node", "left_anti")


def components(edges: DataFrame, local: int | None = None) -> DataFrame:
    """Connected components, edges (a, b) either way: (node, component) for all their nodes, component the smallest.

    At most `local` edges (LOCAL) are joined in one task. For more, the large-star and small-star steps alternate
    (Kiveris et al., 2014): O(log^2 n) rounds at most, and a component is never gathered in one place. A round that
    changes nothing (by the number of edges and the sums of two hashes of them, found while it is written) is the last.
    """
    marks = [F.count("*").alias("n"), *(F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(38, 0)")).alias(f"h{k}") for k in range(2))]
    seen = Observation()
    now = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().observe(seen, *marks))
    before = seen.get
    if before["n"] <= (LOCAL if local is None else local):
        importable(edges.sparkSession)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if held := [b for b in batches if b.num_rows]:
                table = pa.Table.from_batches(held)
                names, a, b = local_graph.numbered(table.column("u"), table.column("v"))
                order = pc.sort_indices(names)
                names, rank = names.take(order), np.argsort(order.to_numpy())
                label = local_graph.joined(len(names), rank[a], rank[b])
                yield pa.RecordBatch.from_pydict({"node": names, "component": names.take(pa.array(label))})

        kind = now.schema["u"].dataType.simpleString()
        return settled(now.coalesce(1).mapInArrow(whole, f"node {kind}, component {kind}"))
    while True:
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        seen = Observation()
        now = settled(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct().observe(seen, *marks))
        if (found := seen.get) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = found


def trunk(parents: DataFrame, depth: DataFrame) -> DataFrame:
    """(node, step): from the deepest node (of equals the smallest) along primary parents to a root, or to where a cycle
    closes. parents: (child, parent). Nothing without parents."""
    spark = parents.sparkSession
    kind = depth.select("node").schema
    first = depth.agg(F.min(F.struct((-F.col("depth")).alias("less"), "node")).alias("top")).first().top
    if first is None:
        return spark.createDataFrame([], kind.add("step", "long"))
    begin = first.node

    def run(names, child, parent):
        places = np.flatnonzero(names.to_numpy(zero_copy_only=False) == begin)
        if len(places):
            path = local_graph.chain(len(names), child, parent, int(places[0]))
            yield {"node": names.take(pa.array(path)), "step": pa.array(range(len(path)), pa.int64())}

    small, large = _in_tasks(parents.select(F.col("child").alias("src"), F.col("parent").alias("dst")), run, "node {node}, step long")
    if large is None or not large.where(F.col("src") == F.lit(begin)).head(1):
        return small
    path, seen = [begin], {begin}
    while (up := large.where(F.col("src") == F.lit(path[-1])).head()) and up.dst not in seen:
        path.append(up.dst)
        seen.add(up.dst)
    return spark.createDataFrame([(n, k) for k, n in enumerate(path)], kind.add("step", "long"))


def topological_order(nodes: list[str], edges: list[tuple[str, str]]) -> list[str] | None:
    """Dependencies first, the smallest name of those that are ready; None if there is a cycle. For the driver, over
    the scripts of one project."""
    waiting = {n: 0 for n in nodes}
    dependents: dict[str, list[str]] = {n: [] for n in nodes}
    for src, dst in set(edges):
        if src in waiting and dst in waiting:
            waiting[src] += 1
            dependents[dst].append(src)
    ready = [n for n, k in waiting.items() if not k]
    heapq.heapify(ready)
    out = []
    while ready:
        out.append(node := heapq.heappop(ready))
        for d in dependents[node]:
            waiting[d] -= 1
            if not waiting[d]:
                heapq.heappush(ready, d)
    return out if len(out) == len(waiting) else None


def cycle_paths(nodes: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """A path for each edge that closes a cycle, its first node again at the end: depth first from the nodes in order.
    For the driver, over the scripts of one project."""
    ways: dict[str, list[str]] = {n: [] for n in nodes}
    for src, dst in sorted(set(edges)):
        ways.setdefault(src, []).append(dst)
        ways.setdefault(dst, [])
    out, done = [], set()
    for root in sorted(ways):
        path, place, left = [], {}, []
        if root not in done:
            path, place, left = [root], {root: 0}, [iter(ways[root])]
        while left:
            to = next(left[-1], None)
            if to is None:
                left.pop()
                done.add(node := path.pop())
                del place[node]
            elif to in place:
                out.append([*path[place[to] :], to])
            elif to not in done:
                place[to] = len(path)
                path.append(to)
                left.append(iter(ways[to]))
    return out


def tree_lines(parents: dict[str, str], names: list[str]) -> list[str]:
    """A forest as text, children in order. Nodes that lead to no root, on or below a cycle, are left out."""
    return [line for _, line in _lines(parents, names)]


def _lines(parents: dict[str, str], names: list[str]) -> Iterator[tuple[str, str]]:
    """(root, line) of each node, in order."""
    children: dict[str | None, list[str]] = {}
    for n in sorted(names):
        children.setdefault(parents.get(n), []).append(n)
    # (root, node, what stands before its line, what stands before those of its children)
    waiting = [(r, r, "", "") for r in reversed(children.get(None, []))]
    while waiting:
        root, node, lead, below = waiting.pop()
        yield root, lead + node
        own = children.get(node, [])
        waiting += [(root, c, below + ("└── " if k == len(own) - 1 else "├── "), below + ("    " if k == len(own) - 1 else "│   ")) for k, c in reversed(list(enumerate(own)))]


def tree(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(pos, line): what `tree_lines` gives. parents: (child, parent), one of each child at most."""

    def run(names, child, parent):
        known = names.to_pylist()
        above = {known[c]: known[p] for c, p in zip(child.tolist(), parent.tolist())}
        out, held = [], 0
        for place, (root, line) in enumerate(_lines(above, known)):
            out.append((root, place, line))
            held += len(line) + 50
            if held > 10_000_000:
                yield dict(zip(("root", "place", "line"), map(list, zip(*out))))
                out, held = [], 0
        if out:
            yield dict(zip(("root", "place", "line"), map(list, zip(*out))))

    ways = settled(parents)
    lone = nodes.join(ways.select(F.col("child").alias("node")), "node", "left_anti").join(ways.select(F.col("parent").alias("node")), "node", "left_anti")
    small, large = _in_tasks(ways.select(F.col("child").alias("src"), F.col("parent").alias("dst")), run, "root string, place long, line string")
    every = small.withColumn("path", F.array("root")).union(lone.select(F.col("node").alias("root"), F.lit(0).cast("long"), F.col("node").alias("line"), F.array("node")))
    if large is not None:
        every = every.union(_tree_in_rounds(large))
    # places in the order of all: those in a part, and the rows of the parts before
    part, row = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = settled(every.orderBy("root", "path", "place").select(part.alias("part"), row.alias("row"), "line"))
    before, bases = 0, []
    for r in placed.groupBy("part").count().orderBy("part").collect():
        bases.append((r["part"], before))
        before += r["count"]
    known = F.broadcast(nodes.sparkSession.createDataFrame(bases, "part int, base long"))
    return placed.join(known, "part").select((F.col("base") + F.col("row")).alias("pos"), "line")


def _tree_in_rounds(ways: DataFrame) -> DataFrame:
    """(root, place, line, path) level by level; names from the root on, `path`, give the order."""
    last = ways.groupBy("dst").agg(F.max("src").alias("last"))
    ways = settled(ways.join(last, "dst").select("src", "dst", (F.col("src") == F.col("last")).alias("ends")))
    roots_ = ways.select(F.col("dst").alias("node")).distinct().join(ways.select(F.col("src").alias("node")), "node", "left_anti")
    now = settled(roots_.select("node", F.col("node").alias("root"), F.col("node").alias("line"), F.lit("").alias("below"), F.array("node").alias("path")))
    every = now
    while not now.isEmpty():
        own = ways.join(now.withColumnRenamed("node", "dst"), "dst")
        lead = F.concat("below", F.when(F.col("ends"), "└── ").otherwise("├── "), "src")
        below = F.concat("below", F.when(F.col("ends"), "    ").otherwise("│   "))
        now = settled(own.select(F.col("src").alias("node"), "root", lead.alias("line"), below.alias("below"), F.concat("path", F.array("src")).alias("path")))
        every = every.union(now)
    return every.select("root", F.lit(0).cast("long").alias("place"), "line", "path")
