"""The engine on small code bases, and its operators against plain Python."""

import json
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from repolens import mini_repo
from repolens.engine import Engine
from repolens.functions import text as T
from repolens.operators import extract, graph, search, usage
from repolens.plans import context
from repolens.plans.workspace import Workspace, graph_document
from repolens.sources import files as sources
from repolens.streaming import usage as streams

FILES = "path string, language string, content string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), FILES)


def plain_chunks(text, max_lines=160, max_bytes=18_000):
    out, start, n, b = [], 1, 0, 0
    ls = text.split("\n")
    for i, line in enumerate(ls, 1):
        if n and (n >= max_lines or b >= max_bytes):
            out.append((start, i - 1))
            start, n, b = i, 0, 0
        n, b = n + 1, b + len(line.encode()) + 1
    return [*out, (start, len(ls))]


@pytest.mark.parametrize("text", ["", "a", "a\n", "x\n" * 200 + "x", "é" * 30_000 + "\nb\nc", "\n" * 500, ("y" * 9000 + "\n") * 5])
def test_chunks(spark, text):
    rows = search.chunk_files(Engine(frame(spark, ("a.md", "markdown", text))).files).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in rows] == plain_chunks(text)
    assert "\n".join(r.content for r in rows) == text


def test_token_estimate_terms_and_phrases(spark):
    rows = spark.createDataFrame([("",), ("abc",), ("é" * 9,)], "t string").select(T.token_estimate(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [0, 1, 2]
    assert T.query_terms("Where IS payment a handled? payment") == ["where", "is", "payment", "paid", "transaction", "wallet", "invoice", "billing", "balance", "handled"]
    assert T.phrase("__") == [] and T.phrase("check_out") == ["check", "out"]


def test_bm25_equals_sqlite(spark):
    docs = ["paid invoice paid", "check out the café now", "the Cafe is open", "nothing here", "check the out", "invoice invoice balance check out"]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(content)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    db.executemany("INSERT INTO f(rowid, content) VALUES (?, ?)", list(enumerate(docs)))
    want = dict(db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH 'cafe OR invoice OR \"check out\"'").fetchall())
    rows = spark.createDataFrame(list(enumerate(docs)), "chunk_id long, content string")
    found = {r.chunk_id: r.bm25 for r in search.bm25(rows, ["cafe", "invoice", "check_out", "_"]).collect()}
    assert found == pytest.approx(want)


def test_search_ranks_the_service_first(spark):
    e = Engine(frame(spark, ("src/PaymentService.php", "php", "<?php\nclass PaymentService { public function get() { return 'paid invoice'; } }\n"), ("src/Other.php", "php", "<?php\n// an invoice is paid, where?\n")))
    rows = e.search("where is payment handled?", mode="raw").collect()
    assert rows[0].path == "src/PaymentService.php" and rows[0].reason.startswith("path match")
    assert e.search("zzz_unknown", mode="raw").collect() == [] and e.search("?", mode="raw").collect() == []


def test_compact_caps(spark):
    rows = [(f"p{i % 4}", i, i, 10.0 - i, "r", "line\n" * 50) for i in range(8)]
    r = spark.createDataFrame(rows, "path string, start_line int, end_line int, score double, reason string, snippet string")
    got = search.compact(r).collect()
    # the first five results, of which p3 is a fourth file
    assert len(got) == 4 and len({x.path for x in got}) == 3 and all(x.snippet.endswith("\n...") for x in got)
    assert len(search.compact(r, max_chars=50).collect()) == 1


def test_ignore_rules_and_languages(spark):
    p = spark.createDataFrame([(x,) for x in mini_repo.PATHS], "path string")
    out = {r.path: (r.i, r.lang) for r in p.select("path", sources.ignored(F.col("path")).alias("i"), sources.language_of(F.col("path")).alias("lang")).collect()}
    assert out["src/main.go"] == (False, "go") and out["src/App.TSX"] == (False, "typescriptreact") and out["Makefile"] == (False, "")
    assert all(out[x][0] for x in (".git/config", "src/vendor/lib.php", "storage/logs/today.md", "a/b/logo.png", ".env"))
    assert not out["builder/out.js"][0] and not out["app/storage/logs.md"][0]
    assert sources.gitignore_patterns("# c\n\n!keep\n/dir/\n*.ext\n") == ["dir", "*.ext"]


def test_scan_directory(spark, tmp_path):
    for name, body in {"a.go": b"package a", "node_modules/b.js": b"x", "bad.go": b"\xff\xfe", "nul.go": b"a\0b", "big.md": b"x" * 1_500_001, "sub/c.md": b"# c"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = sources.scan_directory(spark, str(tmp_path)).collect()
    assert {(r.path, r.language) for r in rows} == {("a.go", "go"), ("sub/c.md", "markdown")}


def test_routes_and_edges(spark):
    e = Engine(spark.createDataFrame(mini_repo.FILES, FILES))
    assert e.nodes.where("type = 'route'").count() == 2
    kinds = {r["type"]: r["count"] for r in e.edges.groupBy("type").count().collect()}
    assert kinds["route_to"] == 2 and kinds["uses"] >= 1 and kinds["depends_on"] >= 2 and kinds["calls"] >= 1
    ids = {r.node_id for r in e.nodes.collect()}
    assert all(r.from_id in ids and r.to_id in ids and r.from_id != r.to_id for r in e.edges.collect())


def test_neighbors_path_and_pack(spark):
    e = Engine(frame(spark, ("kiln.go", "go", "package clay\nfunc FireKiln() { StackShelves(3) }\n"), ("shelf.go", "go", "package clay\nfunc StackShelves(n int) {}\n"), ("lone.md", "markdown", "alone\n")))
    near, between = e.neighbors("FireKiln")
    assert near.count() >= 2 and between.count() >= 1 and "signature" not in near.columns
    assert e.neighbors_truncated("FireKiln", max_nodes=1)
    assert e.path("FireKiln", "StackShelves") == ["FireKiln", "StackShelves"]
    assert e.path("StackShelves", "StackShelves") == ["StackShelves"]
    pack = e.context("fire kiln", 2000)
    text = pack["markdown"]
    assert "shelf.go" in text and "kiln.go" in pack["paths"] and not pack["truncated"]
    # the callee's file is related through its symbol, and its head is there
    assert text.index("## Direct matches") < text.index("## Related files") < text.index("## Symbols") < text.index("## Relationships") < text.index("## Heads of related files") < text.index("## Notes")
    assert "func StackShelves(n int)" in text[text.index("## Heads"):] and "FireKiln calls StackShelves" in text
    small = e.context("fire kiln", 30)
    # fragments are weighed one by one, each rounded down
    assert small["token_estimate"] <= 30 + small["markdown"].count("\n")
    assert [r.file_path for r in graph.orphans(e.nodes, e.edges).collect()] == ["lone.md"]
    assert "Warning" in context.report(e.nodes, e.edges, "x", 7) and "Warning" not in e.report() and "- go: 2" in e.report()
    assert e.call("list_projects") == [""] and e.call("reindex_project", graph_=False)["indexed_files"] == 3


def test_compact_cuts_results_before_files(spark):
    rows = [(p, 1, 2, float(9 - i), "r", "x") for i, p in enumerate("abcdeab")]
    r = spark.createDataFrame(rows, "path string, start_line int, end_line int, score double, reason string, snippet string")
    got = search.compact(r).orderBy("rn").collect()
    assert [x.path for x in got] == ["a", "b", "c"] and not got[0].truncated
    code = spark.createDataFrame([("k.go", 1, 2, 1.0, "r", "func A() {}\nfunc A() {}\ntype B struct {"), ("l.go", 1, 2, 0.5, "r", "z")], r.schema)
    one = search.compact(code, max_chars=150)
    top = one.collect()
    assert [x.path for x in top] == ["k.go"] and top[0].symbols == ["function A", "type B"] and top[0].truncated
    assert top[0].estimate == len("k.go") + 1 + len(top[0].snippet) + 100 + len("function A") + 3 + len("type B") + 3
    assert search.envelope(one).first().asDict() == {"results_count": 1, "files_count": 1, "truncated": True, "max_total_chars": 12000}


def test_seeds_keep_files_and_find_node_tests_each_field(spark):
    kind = "node_id long, type string, name string, qualified_name string, file_path string, start_line int"
    nodes = spark.createDataFrame([(1, "file", "p.go", "p.go", "p.go", 1), (2, "function", "alpha", "alpha", "p.go", 2), (3, "function", "beta", "beta", "p.go", 3), (4, "function", "xa", "pay", "q", 1)], kind)
    paths = spark.createDataFrame([("p.go",)], "path string")
    assert {r.node_id for r in graph.seed_nodes(nodes, paths, ["alph"]).collect()} == {1, 2}
    assert {r.node_id for r in graph.seed_nodes(nodes, paths, []).collect()} == {1}
    assert graph.find_node(nodes, "a pay").collect() == [] and graph.find_node(nodes, "PAY").first().node_id == 4


def test_scan_reads_the_root_gitignore(spark, tmp_path):
    for path, text in {".gitignore": "# none\n!keep\n/private/\n*.tmp.md\n", "private/a.md": "no", "x.tmp.md": "no", "node_modules/b.md": "no", "b.md": "yes", "c/d.go": "package c", "e.md": "nul\0"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    assert {r.path for r in sources.scan_directory(spark, str(tmp_path)).collect()} == {"b.md", "c/d.go"}


def test_stored_index_agrees_with_plain_chunks(spark, tmp_path):
    texts = ["alpha beta gamma alpha", "beta_gamma alpha", "gamma beta", "", "delta alpha beta gamma"]
    chunks = search.chunk_files(spark.createDataFrame([(i, "p", f"f{i}.md", t) for i, t in enumerate(texts)], "file_id long, project string, path string, content string"))
    index = search.StoredIndex(spark, str(tmp_path / "i"), 4).write(chunks)
    show = lambda df: sorted((r.chunk_id, r.term, r.tf) for r in df.collect())
    terms = ["alpha", "beta_gamma", "zzz", "_", "alpha_beta_gamma"]
    assert show(index.hits(terms)) == show(search.phrase_hits(chunks, terms)) != []
    assert index.hits(["_"]).count() == 0
    assert search.ranked(index, "alpha beta_gamma").collect() == search.ranked(chunks, "alpha beta_gamma").collect()


def test_terms_of_a_column_of_queries(spark):
    queries = ["Where is PAYMENT handled?", "sync a b", "", "x_y payment paid payment", "ünï"]
    rows = spark.createDataFrame([(q,) for q in queries], "q string").select("q", T.terms_of(F.col("q")).alias("ts")).collect()
    assert {r.q: list(r.ts) for r in rows} == {q: T.query_terms(q) for q in queries}


def test_workspace_refreshes_only_what_changed(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    w.add_project("clay", "/srv/clay")
    w.add_project("clay", "/srv/clay2")
    assert [(r.name, r.root_path) for r in w.projects().collect()] == [("clay", "/srv/clay2")]
    assert w.project("clay") == w.project("/srv/clay2/x/y") == "clay"
    for bad in ("none", "/elsewhere"):
        with pytest.raises(KeyError):
            w.project(bad)

    def scan(*rows):
        d = spark.createDataFrame(rows, "path string, mtime string, content string").withColumn("mtime", F.col("mtime").cast("timestamp"))
        return d.select("path", sources.language_of(F.col("path")).alias("language"), F.octet_length("content").cast("long").alias("size_bytes"), "mtime", F.sha2("content", 256).alias("hash"), "content")

    a, b, c = ("a.go", "2024-01-01 00:00:00", "package x\nfunc One() { Two() }\n"), ("b.go", "2024-01-01 00:00:00", "package x\nfunc Two() {}\n"), ("c.md", "2024-01-01 00:00:00", "words of clay\n")
    assert "never built" in w.warning("clay")
    assert w.reindex("clay", scan(a, b, c)) == {"indexed_files": 3, "changed_files": 3, "deleted_files": 0, "touched_files": 0, "indexed_chunks": 3}
    calls = lambda: w.edges("clay").where("type = 'calls'").count()
    assert calls() == 1 and w.built("clay") and w.warning("clay") == "" and w.read("symbols").count() == 2
    before = {r.qualified_name: r.node_id for r in w.nodes("clay").collect()}
    again = w.reindex("clay", scan(a, b, c))
    assert set(again.values()) == {0}
    b2, c2 = ("b.go", "2024-01-02 00:00:00", "package x\nfunc Three() {}\n"), ("c.md", "2024-01-02 00:00:00", c[2])
    assert w.reindex("clay", scan(a, b2, c2)) == {"indexed_files": 1, "changed_files": 1, "deleted_files": 0, "touched_files": 1, "indexed_chunks": 1}
    assert calls() == 0 and {r.name for r in w.read("symbols").collect()} == {"One", "Three"}
    assert {r.path: str(r.mtime) for r in w.read("files").collect()} == {"a.go": a[1], "b.go": b2[1], "c.md": c2[1]}
    after = {r.qualified_name: r.node_id for r in w.nodes("clay").collect()}
    assert after["One"] == before["One"] and "Two" not in after and "Three" in after
    assert w.reindex("clay", scan(a, c2))["deleted_files"] == 1
    assert {r.path for r in w.read("chunks").collect()} == {"a.go", "c.md"} and [r.path for r in w.search("clay", "clay words").collect()] == ["c.md"]
    assert "c.md" in w.context("clay", "clay words", 500)[1]
    w.record("search", "clay", 100, 20)
    w.record("context", "clay", 50, 60)
    assert sorted(r.saved for r in w.usage().collect()) == [-10, 80] and [r.saved for r in w.usage(tool="search").collect()] == [80]
    doc = json.loads(graph_document("clay", w.nodes("clay"), w.edges("clay")).first().value)
    assert doc["project"] == "clay" and len(doc["nodes"]) == w.nodes("clay").count() and doc["generated_at"].endswith("Z")


def test_disconnected_and_cyclic_paths(spark):
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 7, 8)], "edge_id long, from_id long, to_id long")
    assert [n for n, _ in graph.shortest_path(edges, 1, 3)] == [1, 3]
    assert graph.shortest_path(edges, 1, 8) == []
    r = {(x.node_id, x.distance) for x in graph.reach(edges, spark.createDataFrame([(1,)], "seed_id long"), 4).collect()}
    assert r == {(1, 0), (2, 1), (3, 1)}


def test_path_is_found_among_thousands_of_nodes(spark):
    """A star of 1,500 nodes around 1; beyond its last, whose edge is the largest, a ring of 40 and a pair apart."""
    star = [(i, 1, i) for i in range(2, 1502)]
    ring = [(5000 + i, 2000 + i, 2000 + (i + 1) % 40) for i in range(40)] + [(6000, 2000, 1501), (6001, 1501, 2000), (6002, 2000, 2000), (6003, None, 2000), (6004, 2005, None), (7000, 3000, 3001)]
    edges = spark.createDataFrame(star + ring, "edge_id long, from_id long, to_id long")
    assert graph.shortest_path(edges, 1, 2000) == [(1, None), (1501, 1501), (2000, 6000)]
    assert graph.shortest_path(edges, 2004, 2) == [(2004, None), (2003, 5003), (2002, 5002), (2001, 5001), (2000, 5000), (1501, 6000), (1, 1501), (2, 2)]
    assert graph.shortest_path(edges, 1, 3000) == [] and graph.shortest_path(edges, 4000, 1) == []


def test_read_files_refuses_to_leave_the_project(spark):
    e = Engine(frame(spark, ("a.go", "go", "package a")))
    assert e.read_files(["a.go"]) == [{"path": "a.go", "content": "package a"}]
    with pytest.raises(ValueError):
        e.read_files(["../outside"])
    with pytest.raises(KeyError):
        e.call("read_files", paths=["b.go"])
    with pytest.raises(ValueError):
        e.call("nothing")


def test_summaries(spark):
    rows = {r.path: r for r in extract.summaries(spark.createDataFrame(mini_repo.FILES, FILES), ["USERS"]).collect()}
    c = rows["app/Http/Controllers/UserController.php"]
    assert (c.type, c.namespace, c.class_name, c.purpose) == ("Controller", "App\\Http\\Controllers", "UserController", "Lists users.")
    assert [(m.visibility, m.name) for m in c.methods] == [("public", "index"), ("private", "helper")]
    assert c.matched_for == ["contains USERS"] and rows["a.go"].namespace == "main"


def test_incremental_plan_and_upsert(spark):
    kind = "path string, mtime int, hash string"
    old = spark.createDataFrame([("same", 1, "a"), ("touched", 1, "a"), ("changed", 1, "a"), ("gone", 1, "a")], kind)
    new = spark.createDataFrame([("same", 1, "b"), ("touched", 2, "a"), ("changed", 2, "b"), ("added", 1, "c")], kind)
    got = {r.path: r.action for r in sources.incremental_plan(old, new).collect()}
    assert got == {"same": "skip", "touched": "touch", "changed": "reindex", "gone": "delete", "added": "add"}
    assert {(r.path, r.hash) for r in sources.upsert(old, new, ["path"]).collect()} == {("same", "b"), ("touched", "a"), ("changed", "b"), ("gone", "a"), ("added", "c")}


def test_usage_day_bounds_and_zero(spark):
    rows = [(1, "t", "u1", "2024-01-02 23:59:59", 0, 5), (2, "t", "u1", "2024-01-03 00:00:00", 8, 2)]
    u = spark.createDataFrame(rows, "usage_id long, tool string, project string, called_at string, tokens_without long, tokens_actual long").withColumn("called_at", F.col("called_at").cast("timestamp"))
    assert [r.usage_id for r in usage.usage_filter(u, until="2024-01-02").collect()] == [1]
    assert [r.saved_pct for r in usage.savings(u).orderBy("usage_id").collect()] == [0.0, 75.0]
    assert usage.usage_filter(u).count() == 2


def test_streaming_usage(spark, tmp_path):
    rows = [("t", "u1", f"2024-01-01 00:{m:02d}:00", 1) for m in (0, 5, 59)] + [("t", "u1", "2024-01-01 05:00:00", 1)]
    spark.createDataFrame(rows, "tool string, project string, called_at string, tokens_actual long").withColumn("called_at", F.col("called_at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("tool string, project string, called_at timestamp, tokens_actual long").parquet(str(tmp_path / "in"))
    q = streams.windowed_usage(s).writeStream.format("memory").queryName("usage_w").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.calls, r.tokens_actual) for r in spark.table("usage_w").collect()] == [(3, 3)]


def test_exports(spark, tmp_path):
    e = Engine(spark.createDataFrame(mini_repo.FILES, FILES))
    context.export_json(e.nodes, e.edges, str(tmp_path))
    assert spark.read.json(str(tmp_path / "nodes")).count() == e.nodes.count()
    page = context.export_html(e.nodes, e.edges, "x")
    assert re.search("<script type=application/json id=graph>", page) and "src=" not in page
