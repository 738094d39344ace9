"""Graphs as DOT lines, JSON and one HTML page. Lines and rows are DataFrames; only files for people are collected."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions import paths
from lodeline.operators import graph

#: Nodes of a page; a browser draws no more.
PAGE_NODES = 20_000


def _quoted(name) -> F.Column:
    return F.concat(F.lit('"'), F.regexp_replace(name, r'(["\\])', r"\\$1"), F.lit('"'))


def edge_lines(edges: DataFrame) -> DataFrame:
    """``"src" -> "dst";`` as line."""
    return edges.select(F.concat(_quoted(F.col("src").cast("string")), F.lit(" -> "), _quoted(F.col("dst").cast("string")), F.lit(";")).alias("line"))


def node_lines(nodes: DataFrame, dead: str = "dead") -> DataFrame:
    """Nodes (id, dead) as lines, green or coral, with short labels."""
    name = F.col("id").cast("string")
    colour = F.when(F.col(dead), "lightcoral").otherwise("lightgreen")
    label = F.regexp_replace(paths.short_label(name), r'(["\\])', r"\\$1")
    return nodes.select(F.concat(_quoted(paths.dot_id(name)), F.lit(' [label="'), label, F.lit('", style=filled, fillcolor='), colour, F.lit("];")).alias("line"))


def dot(nodes: DataFrame, edges: DataFrame, title: str = "modules") -> str:
    """A whole DOT file: sorted nodes, then edges."""
    body = [r["line"] for r in node_lines(nodes).orderBy("line").collect()]
    ends = edges.select(paths.dot_id(F.col("src").cast("string")).alias("src"), paths.dot_id(F.col("dst").cast("string")).alias("dst"))
    body += [r["line"] for r in edge_lines(ends).orderBy("line").collect()]
    return "\n".join([f"digraph {title} {{", "  rankdir=LR;", *("  " + line for line in body), "}"])


def viz_nodes(nodes: DataFrame, dead: DataFrame, name: str = "name") -> DataFrame:
    """(number, name, dead): nodes by name with numbers and flags."""
    marks = dead.select("id", F.lit(True).alias("__d"))
    numbered = graph.numeric_ids(nodes)
    return numbered.join(marks, "id", "left").select("number", F.col(name).alias("name"), F.coalesce("__d", F.lit(False)).alias("dead"))


def clusters_of(nodes: DataFrame, path: str = "path") -> DataFrame:
    """(module): the different top clusters of the nodes' paths, sorted; a page gives each a colour by its place."""
    return nodes.select(paths.top_cluster(F.col(path)).alias("module")).distinct().orderBy("module")


def graph_json(nodes: DataFrame, edges: DataFrame, dead: DataFrame) -> str:
    """Nodes with numbers, names, clusters and flags; edges by number; counts."""
    marks = dead.select("id", F.lit(True).alias("__d"))
    numbered = graph.numeric_ids(nodes)
    flagged = numbered.join(marks, "id", "left").withColumn("dead", F.coalesce("__d", F.lit(False)))
    shown = flagged.orderBy("number").select("number", "id", "path", paths.top_cluster(F.col("path")).alias("cluster"), "dead").collect()
    pairs = sorted((r["src"], r["dst"]) for r in graph.numeric_edges(edges, numbered).collect())
    gone = sum(r["dead"] for r in shown)
    return json.dumps(
        {
            "nodes": [{"id": r["number"], "name": str(r["id"]), "file": r["path"], "module": r["cluster"], "dead": r["dead"]} for r in shown],
            "edges": [{"from": a, "to": b} for a, b in pairs],
            "stats": {"nodes": len(shown), "edges": len(pairs), "dead": gone, "reachable": len(shown) - gone},
        }
    )


def named_graph_json(nodes: DataFrame, edges: DataFrame) -> str:
    """Nodes and edges by their own names: for tools that know functions by path. Every node names what it calls and how many call it."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("calls"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    rows = nodes.select("id", "name", "file").join(out, "id", "left").join(into, "id", "left").orderBy("id")
    return json.dumps({"functions": [{"id": r["id"], "name": r["name"], "file": r["file"], "calls": r["calls"] or [], "callers": r["callers"] or 0} for r in rows.toLocalIterator()]})


_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title>
<style>body{{margin:0;font:13px sans-serif}}#side{{position:fixed;right:0;top:0;width:260px;padding:10px;background:#fffd}}canvas{{display:block}}</style></head>
<body><canvas id="view"></canvas><div id="side"><input id="find" placeholder="find a node"><p id="told"></p></div>
<script id="data" type="application/json">{data}</script>
<script>
const graph = JSON.parse(document.getElementById("data").textContent);
const view = document.getElementById("view"), pen = view.getContext("2d"), told = document.getElementById("told");
view.width = innerWidth; view.height = innerHeight;
const clusters = [...new Set(graph.nodes.map(n => n.module))];
// Each cluster is a ring; a node's place on it follows its number, so a page looks the same each time.
graph.nodes.forEach((n, i) => {{
  const c = clusters.indexOf(n.module), turn = 2 * Math.PI * c / clusters.length, own = i * 2.399963;
  n.x = view.width / 2 + Math.cos(turn) * view.width / 4 + Math.cos(own) * (20 + 4 * Math.sqrt(i));
  n.y = view.height / 2 + Math.sin(turn) * view.height / 4 + Math.sin(own) * (20 + 4 * Math.sqrt(i));
}});
const byId = new Map(graph.nodes.map(n => [n.id, n]));
function draw(lit) {{
  pen.clearRect(0, 0, view.width, view.height);
  for (const e of graph.edges) {{
    const a = byId.get(e.from), b = byId.get(e.to);
    pen.strokeStyle = lit && (a === lit || b === lit) ? "#06c" : "#0002";
    pen.beginPath(); pen.moveTo(a.x, a.y); pen.lineTo(b.x, b.y); pen.stroke();
  }}
  for (const n of graph.nodes) {{
    pen.fillStyle = n.dead ? "lightcoral" : "lightgreen";
    pen.beginPath(); pen.arc(n.x, n.y, n === lit ? 9 : 5, 0, 7); pen.fill();
  }}
}}
function inspect(n) {{
  if (!n) return draw();
  const out = graph.edges.filter(e => e.from === n.id).map(e => byId.get(e.to)), into = graph.edges.filter(e => e.to === n.id).map(e => byId.get(e.from));
  told.textContent = `${{n.name}} (${{n.dead ? "dead" : "live"}}): uses ${{out.length}}, of them dead ${{out.filter(x => x.dead).length}}; used by ${{into.length}}, of them dead ${{into.filter(x => x.dead).length}}`;
  draw(n);
}}
view.onclick = e => inspect(graph.nodes.reduce((m, n) => Math.hypot(n.x - e.x, n.y - e.y) < Math.hypot(m.x - e.x, m.y - e.y) ? n : m));
document.getElementById("find").oninput = e => inspect(graph.nodes.find(n => e.target.value && n.name.includes(e.target.value)));
draw();
</script></body></html>
"""


def html_page(nodes: DataFrame, edges: DataFrame, dead: DataFrame, title: str = "modules") -> str:
    """A page that needs no other file. More than PAGE_NODES nodes are refused, not cut."""
    if nodes.limit(PAGE_NODES + 1).count() > PAGE_NODES:
        raise ValueError(f"more than {PAGE_NODES} nodes; export JSON or DOT lines")
    data = graph_json(nodes, edges, dead).replace("</", "<\\/")
    return _PAGE.format(title=html.escape(title), data=data)


def save(text: str, path: str) -> None:
    """Written beside and then put in place."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    part.write_text(text)
    part.replace(target)
