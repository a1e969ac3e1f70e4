"""From parsed scripts to their graph: what each creates, refers to and declares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.ddl import parsed
from ledgerloom.functions.naming import short_name
from ledgerloom.functions.sqltext import declared_dependencies
from ledgerloom.operators import graph
from ledgerloom.storage import settled


@dataclass
class Dependencies:
    """nodes (node), edges (src, dst, via), from what depends to what it depends on."""

    nodes: DataFrame
    edges: DataFrame

    def leaves(self) -> DataFrame:
        return graph.leaves(self.nodes, self.edges)

    def order(self) -> list[str] | None:
        return graph.topological_order([r.node for r in self.nodes.collect()], [(r.src, r.dst) for r in self.edges.collect()])

    def cycles(self) -> DataFrame:
        return graph.cycle_nodes(self.edges)

    def cycle_paths(self) -> list[list[str]]:
        """A path for each edge that closes a cycle."""
        return graph.cycle_paths([r.node for r in self.nodes.collect()], [(r.src, r.dst) for r in self.edges.collect()])

    def counts(self) -> DataFrame:
        """One row: nodes, edges, leaves."""
        return graph.counts(self.nodes, self.edges)

    def dependents(self, file: str) -> DataFrame:
        """What depends on a file, by some path."""
        return graph.reached(self.edges, self.nodes.where(F.col("node") == file)).where(F.col("node") != file)

    def depths(self) -> DataFrame:
        return graph.depths(self.nodes, self.edges)

    def tree_rows(self) -> DataFrame:
        """(pos, line): the forest of primary parents as text."""
        return graph.tree(self.nodes, graph.primary_parents(self.edges, self.depths()))

    def tree(self) -> list[str]:
        return [r.line for r in self.tree_rows().orderBy("pos").collect()]

    def trunk(self) -> list[str]:
        depth = self.depths()
        return [r.node for r in graph.trunk(graph.primary_parents(self.edges, depth), depth).orderBy("step").collect()]

    def html(self) -> str:
        """A page with the graph (columns by depth, editable files marked), the tree and the edges, without anything from
        elsewhere."""
        from html import escape

        edges = self.edges.orderBy("src", "dst").collect()
        depth = {r.node: r.depth for r in self.depths().collect()}
        short = {r.node: r.short for r in self.nodes.select("node", short_name(F.col("node")).alias("short")).collect()}
        editable = {r.node for r in self.leaves().collect()}
        rows: dict[int, int] = {}
        place = {}
        for node in sorted(depth, key=lambda n: (depth[n], n)):
            rows[depth[node]] = rows.get(depth[node], 0) + 1
            place[node] = (20 + 260 * depth[node], 30 * rows[depth[node]])
        lines = "".join(f'<line x1="{place[e.src][0]}" y1="{place[e.src][1]}" x2="{place[e.dst][0] + 8}" y2="{place[e.dst][1]}" stroke="#999"><title>{escape(e.via)}</title></line>' for e in edges if e.src in place and e.dst in place)
        dots = "".join(f'<circle cx="{x}" cy="{y}" r="6" fill="{"#2a2" if n in editable else "#888"}"/><text x="{x + 10}" y="{y + 4}" font-size="12"><title>{escape(n)}</title>{escape(short[n])}</text>' for n, (x, y) in place.items())
        size = f'width="{300 + 260 * max(rows, default=0)}" height="{40 + 30 * max(rows.values(), default=0)}"'
        table = "".join(f"<tr><td>{escape(e.src)}</td><td>{escape(e.dst)}</td><td>{escape(e.via)}</td></tr>" for e in edges)
        tree = escape("\n".join(self.tree()))
        return f"<!doctype html><meta charset=utf-8><title>Dependencies</title><svg {size}>{lines}{dots}</svg><pre>{tree}</pre><table><tr><th>script<th>depends on<th>through</tr>{table}</table>\n"


def build(files: DataFrame, declared: dict[str, list[str]] | None = None, tool: str = "loom") -> Dependencies:
    """`files` (file_name, sort_key, dir_index, sql); declared: dependencies by file, from the settings."""
    spark = files.sparkSession
    rows = settled(parsed(files).where("error is null").select("file_name", "ord", "creates", "refs"))
    nodes = files.select(F.col("file_name").alias("node")).distinct()
    order = files.select("file_name", F.struct("sort_key", "dir_index", "file_name").alias("file_ord"))
    created = rows.select("file_name", F.col("ord").alias("create_ord"), F.explode("creates").alias("c")).select("file_name", "create_ord", F.col("c.type").alias("type"), F.col("c.name").alias("name"))
    creators = graph.last_creators(created.join(order, "file_name"))
    references = rows.select("file_name", "ord", F.posexplode("refs").alias("n", "r")).select("file_name", F.col("r.name").alias("name"), (F.col("ord") * 1000 + F.col("n")).alias("ord"))
    own = created.where("type = 'table'").select("file_name", "name").distinct()
    found = graph.reference_edges(references, creators, own)
    in_text = files.select(F.col("file_name").alias("src"), F.posexplode(declared_dependencies(F.col("sql"), tool)).alias("ord", "dst")).select("src", "dst", "ord")
    given = spark.createDataFrame([(f, d, k) for f, ds in (declared or {}).items() for k, d in enumerate(ds)], "src string, dst string, ord int").join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    every = found.union(graph.declared_edges(in_text, nodes, "explicit", 1)).union(graph.declared_edges(given.select("src", "dst", "ord"), nodes, "config", 2))
    return Dependencies(nodes, settled(graph.first_edges(every, "via")))
