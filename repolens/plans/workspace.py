"""Stored projects: files, chunks, symbols, imports, graph and usage as tables in a shared folder, and their refresh by
snapshot diff (SURVEY S7-S10, S14, K1-K8, G1, A13, F6, F7).

Each table is a folder of numbered versions; a version counts once its writer has marked it complete, and readers take
the last complete one. A refresh writes the next version from the last (rows of unchanged files are copied, not computed
again), so a writer that dies leaves the table as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import extract as X
from ..operators import graph as G
from ..operators import search as S
from ..operators import usage as U
from ..sources import files as FS
from . import context

TABLES = {
    "projects": schemas.PROJECTS, "files": schemas.FILES, "chunks": schemas.CHUNKS, "symbols": schemas.SYMBOLS, "imports": schemas.IMPORTS,
    "nodes": "project string, " + schemas.NODES + ", ordinal int", "edges": "project string, " + schemas.EDGES, "usage": schemas.USAGE,
}
#: Versions that stay, so that a reader of the last one is not cut short.
KEEP = 2


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Tables ---------------------------------------------------------------------------------------------------------

    def _folder(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[int]:
        fs, p = self._folder(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        found = [int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName()[1:].isdigit()]
        return sorted(n for n in found if fs.exists(self._folder(f"{self.root}/{name}/v{n}/_SUCCESS")[1]))

    def read(self, name: str) -> DataFrame:
        known = self._versions(name)
        if not known:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/v{known[-1]}")

    def _write(self, name: str, df: DataFrame) -> None:
        known = self._versions(name)
        kinds = self.spark.createDataFrame([], TABLES[name]).schema
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds])
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{(known[-1] if known else 0) + 1}")
        for n in known[: 1 - KEEP]:
            fs, p = self._folder(f"{self.root}/{name}/v{n}")
            fs.delete(p, True)

    # Projects -------------------------------------------------------------------------------------------------------

    def add_project(self, name: str, root_path: str) -> None:
        """K1: a new project, or a new root for one of that name."""
        old, now = self.read("projects"), F.date_trunc("second", F.current_timestamp())
        same = old.where(F.col("name") == name)
        known = same.limit(1).collect()
        created = F.lit(known[0].created_at) if known else now
        built = F.lit(known[0].graph_built_at if known else None).cast("timestamp")
        row = self.spark.range(1).select(F.xxhash64(F.lit(name)).alias("project_id"), F.lit(name).alias("name"), F.lit(root_path).alias("root_path"), created.alias("created_at"), now.alias("updated_at"), built.alias("graph_built_at"))
        self._write("projects", FS.upsert(old, row, ["name"]))

    def projects(self) -> DataFrame:
        return self.read("projects").orderBy("name")

    def project(self, name_or_path: str) -> str:
        """The name of a project, given it or (with a leading . or /) a path at or below its root."""
        if name_or_path in ("", ".") or name_or_path.startswith(("/", "./", "../")):
            path = self.spark.createDataFrame([(name_or_path.rstrip("/") or "/",)], "path string")
            found = FS.longest_prefix(path, self.read("projects").select("name", "root_path")).collect()
            if not found:
                raise KeyError(f"no project at {name_or_path}")
            return found[0].name
        return FS.project_named(self.read("projects"), name_or_path).first().name

    # Refresh --------------------------------------------------------------------------------------------------------

    def _replace(self, name: str, gone: DataFrame, new: DataFrame, path: str = "path") -> None:
        """Rows of other files stay; gone: (project, path) whose rows go."""
        old = self.read(name)
        old = old.join(gone.select("project", F.col("path").alias(path)), ["project", path], "left_anti")
        self._write(name, old.unionByName(new.select(*old.columns)))

    def reindex(self, project: str, scanned: DataFrame, graph: bool = True) -> dict:
        """Refresh from a scan (path, language, size_bytes, mtime, hash, content): only new and changed files are chunked
        and parsed, touched files get their new time, vanished files go. Returns the run's counters."""
        scanned = scanned.select("path", "language", "size_bytes", "mtime", "hash", "content")
        old = self.read("files")
        mine = old.where(F.col("project") == project)
        plan = G.written(FS.incremental_plan(mine.select("path", "mtime", "hash"), scanned.select("path", "mtime", "hash")), "plan")
        counts = {r.action: r.n for r in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        of = lambda *kinds: plan.where(F.col("action").isin(*kinds)).select(F.lit(project).alias("project"), "path")
        fresh = scanned.join(of("add", "reindex"), "path", "left_semi").select(F.xxhash64(F.lit(project), "path").alias("file_id"), F.lit(project).alias("project"), "*")
        fresh = G.written(fresh, "fresh")
        gone, chunks = of("reindex", "delete"), None
        if any(counts.get(k) for k in ("add", "reindex", "delete", "touch")):
            times = scanned.join(of("touch"), "path", "left_semi").select(F.lit(project).alias("project"), "path", F.col("mtime").alias("new_time"))
            kept = old.join(gone, ["project", "path"], "left_anti").join(times, ["project", "path"], "left").withColumn("mtime", F.coalesce("new_time", "mtime"))
            self._write("files", kept.select(*old.columns).unionByName(fresh.select(*old.columns)))
        if any(counts.get(k) for k in ("add", "reindex", "delete")):
            chunks = S.chunk_files(fresh)
            self._replace("chunks", gone, chunks)
            self._replace("symbols", gone, X.symbols(fresh).withColumn("project", F.lit(project)))
            self._replace("imports", gone, X.imports(fresh).withColumn("project", F.lit(project)))
        out = {"indexed_files": counts.get("add", 0) + counts.get("reindex", 0), "changed_files": counts.get("add", 0) + counts.get("reindex", 0) + counts.get("delete", 0), "deleted_files": counts.get("delete", 0), "touched_files": counts.get("touch", 0)}
        out["indexed_chunks"] = chunks.count() if chunks is not None else 0
        if graph and (out["changed_files"] or not self.built(project)):
            self.rebuild(project, fresh, gone)
        return out

    def rebuild(self, project: str, fresh: DataFrame | None = None, gone: DataFrame | None = None) -> dict:
        """G1: nodes of changed files are made anew, others are reused; all edges are; the build is stamped (K7)."""
        files = self.read("files").where(F.col("project") == project)
        if fresh is None or gone is None or not self.built(project):
            fresh, gone = files, self.read("nodes").where(F.col("project") == project).select("project", F.col("file_path").alias("path")).distinct()
        self._replace("nodes", gone, G.graph_nodes(fresh).withColumn("project", F.lit(project)), "file_path")
        edges = G.graph_edges(files, self.nodes(project)).withColumn("project", F.lit(project))
        self._write("edges", self.read("edges").where(F.col("project") != project).unionByName(edges.select("project", *[c for c in edges.columns if c != "project"])))
        old = self.read("projects")
        stamp = F.when(F.col("name") == project, F.date_trunc("second", F.current_timestamp())).otherwise(F.col("graph_built_at"))
        self._write("projects", old.withColumn("graph_built_at", stamp))
        return G.stats_row(self.nodes(project), self.edges(project)).first().asDict()

    def built(self, project: str):
        row = self.read("projects").where(F.col("name") == project).select("graph_built_at").first()
        return row and row[0]

    def nodes(self, project: str) -> DataFrame:
        return self.read("nodes").where(F.col("project") == project).drop("project")

    def edges(self, project: str) -> DataFrame:
        return self.read("edges").where(F.col("project") == project).drop("project")

    def warning(self, project: str) -> str:
        """whether the graph was never built, or files changed since."""
        at = self.built(project)
        if not at:
            return "The graph was never built.\n"
        n = FS.stale(self.read("files").where(F.col("project") == project), F.lit(at)).first()[0]
        return f"{n} files changed after the graph was built.\n" if n else ""

    # Questions ------------------------------------------------------------------------------------------------------

    def search(self, project: str, query: str, limit: int = 20) -> DataFrame:
        return S.ranked(self.read("chunks"), query, limit, project)

    def context(self, project: str, task: str, max_tokens: int = 12_000, depth: int = 1) -> tuple[str, list[str]]:
        chunks = self.read("chunks").where(F.col("project") == project)
        files = self.read("files").where(F.col("project") == project)
        return context.context_pack(chunks, task, max_tokens, self.nodes(project), self.edges(project), depth, files, project, self.warning(project))

    def record(self, tool: str, project: str, tokens_without: int, tokens_actual: int) -> None:
        """K8: one usage fact more."""
        now = F.date_trunc("second", F.current_timestamp())
        row = self.spark.range(1).select(F.xxhash64(F.expr("uuid()")).alias("usage_id"), F.lit(tool).alias("tool"), F.lit(project).alias("project"), now.alias("called_at"), F.lit(tokens_without).cast("long").alias("tokens_without"), F.lit(tokens_actual).cast("long").alias("tokens_actual"))
        row.write.mode("append").parquet(f"{self.root}/usage/v1")

    def usage(self, **conditions) -> DataFrame:
        return U.savings(U.usage_filter(self.read("usage"), **conditions)).orderBy(F.desc("called_at"))


def graph_document(project: str, nodes: DataFrame, edges: DataFrame, at: Column | None = None) -> DataFrame:
    """K9 as one row, one JSON document: project, generated_at, nodes, edges, in the order of an export. For graphs that
    fit a row; larger ones are written as datasets."""
    rows = lambda df, order: df.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("row")))), lambda x: x["row"]).alias("x"))
    n = rows(nodes, ["file_path", "start_line", "type", "name", "node_id"]).select(F.col("x").alias("nodes"))
    e = rows(edges, ["type", "edge_id"]).select(F.col("x").alias("edges"))
    at = F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return n.join(e).select(F.to_json(F.struct(F.lit(project).alias("project"), at.alias("generated_at"), "nodes", "edges")).alias("value"))  # one row each
