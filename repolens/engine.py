"""The engine's facade: one object for a corpus of files, with the tools a caller names."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import extract, graph, search
from .plans import context
from .sources import files as sources


class Engine:
    """files: path, language, content, and project, file_id where known."""

    def __init__(self, files: DataFrame, project: str = ""):
        self.project = project
        missing = {"file_id": F.xxhash64("path"), "project": F.lit(project)}
        self.files = files.withColumns({k: v for k, v in missing.items() if k not in files.columns})

    @classmethod
    def from_directory(cls, spark, root: str, project: str = "") -> Engine:
        return cls(sources.scan_directory(spark, root), project or root.rstrip("/").rsplit("/", 1)[-1])

    @cached_property
    def chunks(self) -> DataFrame:
        return search.chunk_files(self.files)

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.written(graph.graph_nodes(self.files), "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return graph.written(graph.graph_edges(self.files, self.nodes), "edges")

    def search(self, query: str, limit: int = 20, mode: str = "compact", **options) -> DataFrame:
        found = search.ranked(self.chunks, query, limit)
        if mode == "raw":
            return found
        if mode == "summary":
            return extract.summaries(self.files.join(found.select("path").distinct(), "path", "left_semi"), T.query_terms(query))
        return search.compact(found, **options)

    def context(self, task: str, max_tokens: int = 12_000, graph_: bool | None = None, depth: int = 1) -> dict:
        use = graph_ if graph_ is not None else not self.edges.isEmpty()
        text, paths = context.context_pack(self.chunks, task, max_tokens, self.nodes if use else None, self.edges if use else None, depth, self.files, self.project)
        size = max(1, len(text) // 4)
        return {"markdown": text, "paths": paths, "token_estimate": size, "truncated": size >= max_tokens}

    def read_files(self, paths: list[str]) -> list[dict]:
        """Whole files by path; a path that leaves the root, or is unknown, is an error."""
        for p in paths:
            if p.startswith(("/", "\\")) or ":" in p.split("/")[0] or ".." in p.replace("\\", "/").split("/"):
                raise ValueError(f"path leaves the project: {p}")
        found = {r.path: r.content for r in self.files.where(F.col("path").isin(paths)).select("path", "content").collect()}
        if gone := [p for p in paths if p not in found]:
            raise KeyError(gone[0])
        return [{"path": p, "content": found[p]} for p in paths]

    def neighbors(self, query: str, depth: int = 1, max_nodes: int = 40, max_edges: int = 80, types: list[str] | None = None):
        near, edges = graph.neighbors(self.nodes, self.edges, graph.find_node(self.nodes, query), depth)
        return graph.neighbors_compact(near, edges, types, max_nodes, max_edges)

    def neighbors_truncated(self, query: str, depth: int = 1, max_nodes: int = 40, max_edges: int = 80, types: list[str] | None = None) -> bool:
        near, edges = graph.neighbors(self.nodes, self.edges, graph.find_node(self.nodes, query), depth)
        return graph.neighbors_truncated(near, edges, types, max_nodes, max_edges)

    def path(self, start: str, goal: str) -> list[str]:
        ends = [graph.find_node(self.nodes, q).first() for q in (start, goal)]
        if None in ends:
            raise KeyError(start if ends[0] is None else goal)
        steps = [n for n, _ in graph.shortest_path(self.edges, ends[0].node_id, ends[1].node_id)]
        names = {r.node_id: r.qualified_name for r in self.nodes.where(F.col("node_id").isin(steps)).collect()} if steps else {}
        return [names[n] for n in steps]

    def stats(self) -> dict:
        return context.stats(self.nodes, self.edges)

    def report(self) -> str:
        return context.report(self.nodes, self.edges, self.project, self.files.count(), self.files)

    def health(self) -> dict[str, bool]:
        return {name: not getattr(self, name).isEmpty() for name in ("files", "chunks", "nodes")}

    def project_map(self) -> list[str]:
        return [r[0] for r in self.files.select("project").distinct().orderBy("project").collect()]

    def graph_rebuild(self) -> dict:
        """Nodes and edges anew, written down; the counts of both."""
        for name in ("nodes", "edges"):
            self.__dict__.pop(name, None)
        return {"status": "ok", "graph_rebuilt": True} | graph.stats_row(self.nodes, self.edges).first().asDict()

    def reindex_project(self, files: DataFrame | None = None, graph_: bool = True) -> dict:
        """Takes files as the corpus, if given, and computes chunks (and the graph) anew."""
        if files is not None:
            self.__init__(files, self.project)
        self.chunks = search.chunk_files(self.files)
        out = {"status": "ok", "indexed_files": self.files.count(), "indexed_chunks": self.chunks.count(), "graph_rebuilt": graph_}
        return out | (self.graph_rebuild() if graph_ else {})

    def call(self, tool: str, **args):
        """Tools by name or alias, as a protocol adapter would call them."""
        tool = {"list_projects": "project_map", "search_code": "search", "get_context": "context"}.get(tool, tool)
        tools = {"project_map": self.project_map, "reindex_project": self.reindex_project, "graph_rebuild": self.graph_rebuild, "search": self.search, "context": self.context, "read_files": self.read_files, "graph_neighbors": self.neighbors, "graph_path": self.path, "graph_stats": self.stats, "graph_report": self.report, "health": self.health}
        if tool not in tools:
            raise ValueError(f"unknown tool: {tool}")
        return tools[tool](**args)
