"""Compositions: the token-budgeted context pack and the graph report. The parts are Spark plans;
the assembly handles a few hundred bounded rows on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import search as S


def _estimate(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


#: Said last in every pack.
NOTES = "- Prefer the code found above to new code of the same purpose.\n- Test what changes.\n"


def context_pack(
    chunks: DataFrame | S.StoredIndex, task: str, max_tokens: int = 12_000, nodes: DataFrame | None = None, edges: DataFrame | None = None,
    depth: int = 1, files: DataFrame | None = None, project: str = "", warning: str = "", notes: str = NOTES,
) -> tuple[str, list[str]]:
    """Markdown under the budget, and the paths it refers to (P1): direct matches with their snippets, one a file; files
    of every related node, by the best of them; symbols; edges around the seeds; the heads of related files; notes. A
    section ends at its first fragment that does not fit; later sections are still tried. A path counts before its
    fragment is weighed. Without files, a related file's head comes from its first chunk."""
    direct = S.ranked(chunks, task, 20)
    hits = direct.collect()
    out, used, paths = [], 0, []

    def add(fragment: str) -> bool:
        nonlocal used
        if used + _estimate(fragment) > max_tokens:
            return False
        out.append(fragment)
        used += _estimate(fragment)
        return True

    def section(title: str, rows: list[tuple[str | None, str]]) -> None:
        add(f"\n## {title}\n\n")
        for path, fragment in rows or [(None, "None.\n")]:
            if path and path not in paths:
                paths.append(path)
            if not add(fragment):
                break

    add(f"# Context: {task}\n" + (f"\nProject: {project}\n" if project else ""))
    if warning:
        add(f"\n> {warning}")
    first = {}
    for r in hits:
        first.setdefault(r.path, r)
    section("Direct matches", [(p, f"### {p}, lines {r.start_line} to {r.end_line}\n{r.reason}\n\n```\n{r.snippet}\n```\n") for p, r in first.items()])
    related, between = [], []
    if nodes is not None and edges is not None:
        scored = spark_rows(direct.sparkSession, hits)
        related = G.expand_related(nodes, edges, scored, task, depth).collect()
        between = G.expansion_edges(nodes, edges, scored, task, depth).collect()
    beyond = {}
    for r in related:
        if r.file_path not in first:
            beyond.setdefault(r.file_path, r)
    section("Related files", [(p, f"- {p}: {r.type} {r.name} ({r.score:.2f})\n") for p, r in beyond.items()])
    section("Symbols", [(None, f"- {r.type} {r.name} in {r.file_path}:{r.start_line} ({r.reason})\n") for r in related if r.type != "file"][:20])
    section("Relationships", [(None, f"- {e.from_name} {e.type} {e.to_name}\n") for e in between])
    if beyond:
        rows = files if files is not None else (chunks.chunks if isinstance(chunks, S.StoredIndex) else chunks).where("start_line = 1")
        heads = {r.path: r.head for r in rows.where(F.col("path").isin(list(beyond))).select("path", T.first_lines(F.col("content"), 80).alias("head")).collect()}
        section("Heads of related files", [(None, f"### {p}\n\n```\n{heads[p]}\n```\n") for p in beyond if p in heads])
    section("Notes", [(None, notes)])
    return "".join(out), paths


def spark_rows(spark, hits) -> DataFrame:
    """A search's rows (20 at most) as a table, so that the search is not run again."""
    return spark.createDataFrame([(r.path, r.score) for r in hits], "path string, score double")


def stats(nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> dict:
    """Bounded lists and counts. Nodes and edges are written down first: a dozen small queries read them."""
    nodes, edges = G.written(nodes, "nodes"), G.written(edges, "edges")
    rows = lambda df: [r.asDict() for r in df.collect()]
    top = rows(G.top_connected(nodes, edges, True))
    return {
        "languages": {r["language"]: r["count"] for r in rows(files.groupBy("language").count())} if files is not None else {},
        "node_types": {r["type"]: r["count"] for r in rows(nodes.groupBy("type").count())},
        "edge_types": {r["type"]: r["count"] for r in rows(edges.groupBy("type").count())},
        "top_files": top, "top_symbols": rows(G.top_connected(nodes, edges, False)),
        **{f"{t}s": rows(G.nodes_of_type(nodes, t)) for t in ("route", "service", "model", "job", "command", "test")},
        "hotspots": rows(G.hotspots(nodes, edges)), "orphans": rows(G.orphans(nodes, edges)), "high_coupling": top,
    }


#: Sections of the report, in their fixed order.
SECTIONS = {
    "languages": "Languages", "node_types": "Node types", "edge_types": "Edge types", "top_files": "Most connected files", "top_symbols": "Most connected symbols", "routes": "Routes", "services": "Services", "models": "Models",
    "jobs": "Jobs", "commands": "Commands", "tests": "Tests", "hotspots": "Call hotspots", "orphans": "Orphan files", "high_coupling": "Files with high coupling",
}


def report(nodes: DataFrame, edges: DataFrame, project: str, indexed_files: int | None = None, files: DataFrame | None = None) -> str:
    """Markdown in fixed order; maps are sorted by key."""
    s = stats(nodes, edges, files)
    graphed = s["node_types"].get("file", 0)
    out = [f"# Graph report: {project}\n\n{graphed} files, {sum(s['node_types'].values()) - graphed} symbols, {sum(s['edge_types'].values())} edges.\n"]
    if indexed_files is not None and indexed_files != graphed:
        out.append(f"\n> Warning: {indexed_files} indexed files, {graphed} in the graph. Rebuild it.\n")
    for key, title in SECTIONS.items():
        value = s[key]
        lines = [f"- {k}: {v}" for k, v in sorted(value.items())] if isinstance(value, dict) else [f"- {r.get('name') or r['file_path']}" + (f" ({r.get('degree') or r.get('incoming')})" if "degree" in r or "incoming" in r else "") for r in value]
        out.append(f"\n## {title}\n\n" + ("\n".join(lines) if lines else "None") + "\n")
    return "".join(out)


def export_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K9 as datasets: one JSON object a line, nodes and edges apart."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def export_html(nodes: DataFrame, edges: DataFrame, title: str, most: int = 500) -> str:
    """A page with the most connected nodes as a table and their data embedded; no script from elsewhere."""
    top = G.degrees(nodes, edges).orderBy(F.desc("degree"), "node_id").limit(most).select("node_id", "type", "name", "file_path", "degree").collect()
    data = json.dumps([r.asDict() for r in top]).replace("</", "<\\/")
    cells = "".join(f"<tr><td>{r.type}</td><td>{(r.name or '').replace('&', '&amp;').replace('<', '&lt;')}</td><td>{r.degree}</td></tr>" for r in top)
    return f"<!doctype html><meta charset=utf-8><title>{title}</title><table>{cells}</table><script type=application/json id=graph>{data}</script>"




