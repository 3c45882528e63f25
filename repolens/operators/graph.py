"""The property graph: building, statistics, traversal. OR-joins over edge ends are written as
equi-joins on exploded ends."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import extract as X


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder that the cluster names; one of our own only in local mode and where none is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, set as the checkpoint folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = getattr(spark, "_repolens_graph", None) or "file://" + tempfile.mkdtemp(prefix="repolens-")
        spark._repolens_graph = found
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again, for tables that several steps read."""
    path = f"{shared_folder(df.sparkSession)}/repolens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def graph_nodes(files: DataFrame) -> DataFrame:
    """All nodes, routes included; node_id is a hash of what identifies the node."""
    r = X.routes(files)
    uri = F.concat_ws(" ", "method", "uri")
    route = r.select(F.lit("route").alias("type"), uri.alias("name"), uri.alias("qualified_name"), F.col("path").alias("file_path"), F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.lit(9).alias("ordinal"), F.col("raw").alias("signature"))
    first = Window.partitionBy("file_path", "qualified_name").orderBy("start_line")
    route = route.withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_")
    nodes = X.file_nodes(files).unionByName(X.code_nodes(files)).unionByName(route)
    return nodes.select(F.xxhash64("type", "file_path", "qualified_name", "start_line", "ordinal").alias("node_id"), *[c for c in nodes.columns if c != "ordinal"], "ordinal")


def canonical(nodes: DataFrame) -> DataFrame:
    """Of nodes with equal (type, file, qualified name) the last."""
    w = Window.partitionBy("type", "file_path", "qualified_name").orderBy(F.desc("start_line"), F.desc("ordinal"))
    return nodes.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def symbol_keys(nodes: DataFrame) -> DataFrame:
    """Key, rank, node: qualified name, name, and every dotted end of the qualified name."""
    parts = F.split("qualified_name", r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("key"), F.lit(2).alias("rank")))
    keys = F.concat(F.array(F.struct(F.col("qualified_name").alias("key"), F.lit(0).alias("rank")), F.struct(F.col("name").alias("key"), F.lit(1).alias("rank"))), F.when(F.size(parts) > 1, ends).otherwise(F.array().cast("array<struct<key:string,rank:int>>")))
    rows = canonical(nodes).where("type NOT IN ('file', 'route')").select("node_id", "file_path", "start_line", "type", F.explode(keys).alias("k")).where("k.key <> ''")
    best = F.min(F.struct(F.col("k.rank").alias("rank"), "file_path", "start_line", "type", "node_id"))
    # one row a key: the match that resolution picks, so later joins are one to one
    return rows.groupBy(F.col("k.key").alias("key")).agg(best.alias("best")).select("key", F.col("best.node_id").alias("node_id"))


def resolve(rows: DataFrame, key: str, keys: DataFrame, out: str) -> DataFrame:
    return rows.join(keys.select(F.col("key").alias("key_"), F.col("node_id").alias(out)), F.trim(F.col(key)) == F.col("key_"), "left").drop("key_")


def import_base(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(T.basename(path), r"\.[^.]*$", "")


def graph_edges(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """G1: defines, imports, route_to, calls, uses, depends_on, extends, implements; self edges are dropped."""
    # five kinds of edges read these: written once, not computed for each
    nodes = written(nodes, "nodes")
    one, keys = canonical(nodes), written(symbol_keys(nodes), "symbol-keys")
    file_ids = one.where("type = 'file'").select(F.col("file_path").alias("path"), F.col("node_id").alias("file_id"))
    none = F.lit("")
    defines = one.where("type <> 'file'").join(file_ids, F.col("file_path") == F.col("path")).select(F.col("file_id").alias("from_id"), F.col("node_id").alias("to_id"), F.lit("defines").alias("type"), F.lit(1.0).alias("confidence"), none.alias("raw"), F.col("start_line").alias("line_no"))
    imp = resolve(X.imports(files).withColumn("base", import_base(F.col("imported_path"))), "base", keys, "to_id").join(file_ids, "path")
    imp = imp.select(F.col("file_id").alias("from_id"), "to_id", F.lit("imports").alias("type"), F.lit(0.8).alias("confidence"), F.col("imported_path").alias("raw"), F.lit(0).alias("line_no"))
    r = X.routes(files).withColumn("target", F.concat_ws(".", "controller", "action"))
    r = resolve(resolve(r, "target", keys, "t1"), "action", keys, "t2").join(
        one.where("type = 'route'").select(F.col("file_path").alias("path"), F.col("qualified_name").alias("q_"), F.col("node_id").alias("from_id")), ["path"]
    ).where(F.col("q_") == F.concat_ws(" ", "method", "uri"))
    r = r.select("from_id", F.coalesce("t1", "t2").alias("to_id"), F.lit("route_to").alias("type"), F.lit(1.0).alias("confidence"), F.col("target").alias("raw"), "line_no")
    sites = X.calls(files).withColumn("type", F.lit("calls")).withColumn("confidence", F.lit(0.65)).unionByName(X.uses(files).withColumn("confidence", F.lit(0.8)))
    sites = resolve(resolve(sites, "from_name", keys, "f1"), "to_name", keys, "to_id").join(file_ids, "path")
    sites = sites.select(F.coalesce("f1", "file_id").alias("from_id"), "to_id", "type", "confidence", "raw", "line_no")
    edges = defines.unionByName(imp).unionByName(r).unionByName(sites).where("to_id IS NOT NULL AND from_id <> to_id")
    return edges.select(F.xxhash64("from_id", "to_id", "type", "raw", "line_no").alias("edge_id"), "from_id", "to_id", "type", "confidence", "raw")


def page_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A link graph: a `file` node a page, a `route` node for each other link target, an `imports` edge a link."""
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")
    links = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "target"))
    page_nodes = pages.select("url").distinct().select(number(F.col("url")).alias("node_id"), F.lit("file").alias("type"), T.basename(F.col("url")).alias("name"), F.col("url").alias("qualified_name"), F.col("url").alias("file_path"), F.lit(1).alias("start_line"))
    targets = links.select("target").distinct().join(pages.select("url").distinct(), F.col("target") == F.col("url"), "left_anti")
    other = targets.select(number(F.col("target")).alias("node_id"), F.lit("route").alias("type"), T.basename(F.col("target")).alias("name"), F.col("target").alias("qualified_name"), F.col("target").alias("file_path"), F.lit(1).alias("start_line"))
    edges = links.where("url <> target").select(number(F.concat_ws("|", "url", "target", "pos")).alias("edge_id"), number(F.col("url")).alias("from_id"), number(F.col("target")).alias("to_id"), F.lit("imports").alias("type"), F.lit(0.8).alias("confidence"))
    return page_nodes.unionByName(other), edges


def ends(edges: DataFrame) -> DataFrame:
    return edges.select("edge_id", F.explode(F.array("from_id", "to_id")).alias("node_id"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their number of edge ends; counted before the join."""
    d = ends(edges).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(d, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def top_connected(nodes: DataFrame, edges: DataFrame, files: bool, limit: int = 10) -> DataFrame:
    kind = F.col("type") == "file" if files else F.col("type") != "file"
    return degrees(nodes.where(kind), edges).orderBy(F.desc("degree"), "name", "node_id").limit(limit).select("node_id", "type", "name", "file_path", "degree")


def hotspots(nodes: DataFrame, edges: DataFrame, type_: str = "calls", limit: int = 10) -> DataFrame:
    """Nodes by incoming edges of a type."""
    d = edges.where(F.col("type") == type_).groupBy(F.col("to_id").alias("node_id")).agg(F.count(F.lit(1)).alias("incoming"))
    return nodes.join(d, "node_id").orderBy(F.desc("incoming"), "name", "node_id").limit(limit).select("node_id", "name", "incoming")


def orphans(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """Files without any edge."""
    return nodes.where("type = 'file'").join(ends(edges), "node_id", "left_anti").orderBy("file_path").limit(limit).select("node_id", "file_path")


def nodes_of_type(nodes: DataFrame, type_: str, limit: int = 50) -> DataFrame:
    return nodes.where(F.col("type") == type_).orderBy("file_path", "start_line", "node_id").limit(limit).select("node_id", "name", "file_path", "start_line")


def stats_row(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A9's counts as one row: files, symbols, edges, node_types, edge_types, orphans. Nodes and edges are read once each."""
    n = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    n = n.agg(F.coalesce(F.sum(F.when(F.col("type") == "file", F.col("n"))), F.lit(0)).alias("files"), F.coalesce(F.sum(F.when(F.col("type") != "file", F.col("n"))), F.lit(0)).alias("symbols"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n"))))).alias("node_types"))
    e = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n"))))).alias("edge_types"))
    o = nodes.where("type = 'file'").join(ends(edges), "node_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return n.join(e).join(o)  # one row each


def find_node(nodes: DataFrame, query: str) -> DataFrame:
    """T5: exact name or qualified name, then exact path, then a substring of one of them (files first, shortest name)."""
    exact = F.when((F.col("name") == query) | (F.col("qualified_name") == query), 0).when(F.col("file_path") == query, 1)
    like = F.coalesce(F.col("name").ilike(f"%{query}%"), F.lit(False)) | F.coalesce(F.col("qualified_name").ilike(f"%{query}%"), F.lit(False)) | F.coalesce(F.col("file_path").ilike(f"%{query}%"), F.lit(False))
    rank = F.coalesce(exact, F.when(like, F.when(F.col("type") == "file", 2).otherwise(3)))
    return nodes.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", F.length("name"), "node_id").limit(1).select("node_id", "type", "name", "file_path", "rank")


def symbol_matches(nodes: DataFrame, terms: list[str], limit: int = 10) -> DataFrame:
    """T4: for each term at most limit symbols by length of name."""
    named = nodes.where("type <> 'file'").select("node_id", "name", "qualified_name", F.explode(F.array(*[F.lit(t) for t in terms]).cast("array<string>")).alias("term"))
    named = named.where(F.expr("lower(name) LIKE concat('%', term, '%') OR lower(qualified_name) LIKE concat('%', term, '%')"))
    w = Window.partitionBy("term").orderBy(F.length("name"), "node_id")
    return named.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= limit).select("term", "node_id", "name")


def seed_nodes(nodes: DataFrame, paths: DataFrame, terms: list[str], limit: int = 25) -> DataFrame:
    """The first limit nodes of each path, files first; of these, file nodes and those that hold a term."""
    w = Window.partitionBy("file_path").orderBy(F.col("type") != "file", "start_line", "node_id")
    s = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= limit)
    low = F.lower(F.concat_ws(" ", "name", "qualified_name", "file_path"))
    held = F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t)) if terms else F.lit(False)
    return s.where((F.col("type") == "file") | held).select("node_id", "type", "name", "qualified_name", "file_path", "start_line")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """G2 for many seeds at once: seed_id, node_id, distance (at most depth), undirected."""
    both = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).union(edges.select("to_id", "from_id")).distinct()
    seen = seeds.select("seed_id", F.col("seed_id").alias("node_id"), F.lit(0).alias("distance"))
    front = seen
    for hop in range(1, max(1, depth) + 1):
        step = front.join(both, F.col("node_id") == F.col("a")).select("seed_id", F.col("b").alias("node_id")).distinct()
        front = step.join(seen.select("seed_id", "node_id"), ["seed_id", "node_id"], "left_anti").withColumn("distance", F.lit(hop))
        if hop > 2:
            front = cut_lineage(front)
        seen = seen.unionByName(front)
    return seen


def neighbors(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within depth of start (node_id), with their distance, and every edge at a node that was expanded."""
    r = reach(edges, start.select(F.col("node_id").alias("seed_id")), depth).groupBy("node_id").agg(F.min("distance").alias("distance"))
    expanded = r.where(F.col("distance") < max(1, depth)).select("node_id")
    e = edges.join(ends(edges).join(expanded, "node_id", "left_semi").select("edge_id").distinct(), "edge_id", "left_semi")
    return nodes.join(r, "node_id"), e


def neighbors_compact(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, max_nodes: int = 40, max_edges: int = 80) -> tuple[DataFrame, DataFrame]:
    """At most max_nodes of the allowed types by distance, without their signature; edges between kept
    nodes only."""
    nodes = nodes.drop("signature")
    kept = (nodes.where(F.col("type").isin(types)) if types else nodes).orderBy("distance", "name", "node_id").limit(max_nodes)
    ids = kept.select("node_id")
    e = edges.join(ids.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi")
    return kept, e.orderBy("edge_id").limit(max_edges)


def neighbors_truncated(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, max_nodes: int = 40, max_edges: int = 80) -> bool:
    """Whether neighbors_compact leaves out a node of the allowed types or an edge; an edge that lost an end counts."""
    allowed = nodes.where(F.col("type").isin(types)) if types else nodes
    kept, kept_edges = neighbors_compact(nodes, edges, types, max_nodes, max_edges)
    return allowed.limit(max_nodes + 1).count() > max_nodes or kept_edges.count() < edges.count()


def shortest_path(edges: DataFrame, start: int, goal: int) -> list[tuple[int, int | None]]:
    """(node, edge that led there) from start to goal; [] if there is none. Of several edges to a node the least leads
    there. The search ends where goal is met or no node is left, not at 1000 nodes as the reference's does, which misses
    paths of two steps around a hub. A hop's new nodes are a table. Their neighbours lie in the same hop, the one before or
    the next, so a hop is compared with two others, not with all nodes seen."""
    if start == goal:
        return [(start, None)]
    one_way = written(edges.where("from_id <> to_id").select("edge_id", F.col("from_id").alias("a"), F.col("to_id").alias("b")), "edges")
    both = one_way.union(one_way.select("edge_id", "b", "a"))
    least = F.min(F.struct("edge_id", "a")).alias("m")
    hops = [edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("b"))]
    while True:
        steps = both.join(hops[-1].select(F.col("b").alias("a")), "a", "left_semi")
        # before the hop is built: the one that holds goal is the largest, and not needed
        met = steps.where(F.col("b") == goal).agg(least).first().m
        if met is not None:
            break
        seen = reduce(DataFrame.union, [hop.select("b") for hop in hops[-2:]])
        found = steps.join(seen, "b", "left_anti").groupBy("b").agg(least)
        hops.append(written(found.select("b", "m.a", "m.edge_id"), "hop"))
        if hops[-1].isEmpty():
            return []
    out, at = [(goal, met.edge_id)], met.a
    for hop in hops[:0:-1]:
        came = hop.where(F.col("b") == at).first()
        out.append((at, came.edge_id))
        at = came.a
    return [(start, None), *out[::-1]]


def expand_related(nodes: DataFrame, edges: DataFrame, direct: DataFrame, task: str, depth: int = 1, limit: int = 50) -> DataFrame:
    """Nodes around the seeds of direct hits (path, score) and around symbols that hold a term of the task, each with
    its best score."""
    terms = T.query_terms(task)
    hits = direct.groupBy(F.col("path").alias("file_path")).agg(F.max("score").alias("hit"))
    seeds = seed_nodes(nodes, direct, terms).join(hits, "file_path")
    same = (F.lower("name") == task.lower()) | (F.lower("qualified_name") == task.lower())
    row = lambda df, score, why, dist: df.select("node_id", score.cast("double").alias("score"), F.lit(why).alias("reason"), dist.cast("int").alias("distance"))
    found = row(seeds, F.col("hit") + F.when(same, 10.0).otherwise(5.0), "direct FTS/symbol match", F.lit(0))
    around = reach(edges, seeds.select(F.col("node_id").alias("seed_id")).distinct(), depth).join(seeds.groupBy(F.col("node_id").alias("seed_id")).agg(F.max("hit").alias("hit")), "seed_id")
    at = F.least("distance", F.lit(1))
    found = found.unionByName(row(around, F.col("hit") + F.when(at == 0, 6.0).otherwise(3.5), "graph neighbor", at))
    named = symbol_matches(nodes, terms).select("node_id").distinct()
    found = found.unionByName(row(named, F.lit(8.0), "symbol match", F.lit(0)))
    found = found.unionByName(row(reach(edges, named.withColumnRenamed("node_id", "seed_id"), depth), F.lit(4.0), "symbol graph neighbor", F.lit(1)))
    best = found.groupBy("node_id").agg(F.max(F.struct(F.round("score", 6).alias("score"), "reason", "distance")).alias("m")).select("node_id", "m.score", "m.reason", "m.distance")
    return best.join(nodes.select("node_id", "type", "name", "file_path", "start_line"), "node_id").orderBy(F.desc("score"), "node_id").limit(limit)


def expansion_edges(nodes: DataFrame, edges: DataFrame, direct: DataFrame, task: str, depth: int = 1, limit: int = 30) -> DataFrame:
    """The edges that expand_related walks over, by edge_id, with the names of their ends: those at a node that is less
    than depth away from a seed or from a symbol that holds a term."""
    terms = T.query_terms(task)
    start = seed_nodes(nodes, direct, terms).select("node_id").unionByName(symbol_matches(nodes, terms).select("node_id")).distinct() if terms else seed_nodes(nodes, direct, terms).select("node_id")
    walked = neighbors(nodes, edges, start, depth)[1].orderBy("edge_id").limit(limit)
    name = lambda c, out: nodes.select(F.col("node_id").alias(c), F.col("name").alias(out))
    return walked.join(name("from_id", "from_name"), "from_id").join(name("to_id", "to_name"), "to_id").orderBy("edge_id")
