"""What a dashboard and a report show: bounded, ordered parts of a graph."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..runtime import stage

VISUAL_LIMIT, REPORT_ROWS = 5000, 25


def visual(g: CodeGraph, limit: int = VISUAL_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, type, file), the first by (type, id), and links (source, target, type, seq) with both ends among them;
    parallel links stay."""
    nodes = stage(g.symbols.orderBy("type", "id").limit(limit).select("id", "name", "type", F.coalesce("file", F.lit("")).alias("file")), "visual")
    ids = nodes.select("id")
    links = g.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, links.select("source", "target", "type", "seq")


def dashboard(g: CodeGraph, title: str, limit: int = VISUAL_LIMIT) -> str:
    """A page that lists and searches the exported nodes, with every link between them; bounded by ``limit`` nodes, of parallel
    links each is there. Links come to the driver partition by partition."""
    nodes, links = visual(g, limit)
    payload = {"nodes": [r.asDict() for r in nodes.collect()], "links": [{k: r[k] for k in ("source", "target", "type")} for r in links.orderBy("seq").toLocalIterator()]}
    data = json.dumps(payload, ensure_ascii=False, sort_keys=True).replace("</", "<\\/")
    return f"""<!doctype html>
<meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:2em}}.dim{{opacity:.2}}td{{padding:2px 10px}}</style>
<h1>{title}</h1><input id="q" placeholder="name or id"><table id="t"></table>
<script type="application/json" id="data">{data}</script>
<script>
const g = JSON.parse(document.getElementById("data").textContent), out = {{}};
for (const l of g.links) (out[l.source] ??= []).push(l.type + " " + l.target);
const t = document.getElementById("t");
const rows = g.nodes.map(n => {{
  const r = t.insertRow();
  for (const x of [n.type, n.name, n.id, n.file, (out[n.id] || []).length]) r.insertCell().textContent = x;
  r.title = (out[n.id] || []).slice(0, 40).join("\\n");
  return [r, (n.name + "\\0" + n.id).toLowerCase()];
}});
document.getElementById("q").oninput = e => {{
  const q = e.target.value.toLowerCase();
  for (const [r, s] of rows) r.className = s.includes(q) ? "" : "dim";
}};
</script>
"""


def bounded_table(df: DataFrame, columns: list[str], rows: int = REPORT_ROWS) -> str:
    """A markdown table of the first rows and, if there are more, how many there are."""
    shown, total = df.select(*columns).limit(rows).collect(), df.count()
    if not total:
        return "None.\n"
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in shown)]
    if total > len(shown):
        lines.append(f"\nShowing {len(shown)} of {total}.")
    return "\n".join(lines) + "\n"
