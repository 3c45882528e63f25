"""Registered queries of the engine and their DuckDB equivalents. Names follow SURVEY 7.4."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mini_repo as M
from .engine import Engine
from .functions import text as T
from .operators import extract as X
from .operators import graph as G
from .operators import search as S
from .operators import usage as U
from .plans import context
from .sources import files as FS
from .streaming import usage as SU

QUERY = "the heention apache_license payment src1"
TERMS = T.query_terms(QUERY)
PHRASE = "apache_license"

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _files(spark, sf) -> DataFrame:
    return FS.document_files(_t(spark, sf, "documents"))


def _chunks(spark, sf) -> DataFrame:
    return S.chunk_files(_files(spark, sf))


_INDEXES: dict = {}


def _index(spark, sf) -> S.StoredIndex:
    """The stored index of the documents, written on first use by a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = S.StoredIndex(spark, f"{G.shared_folder(spark)}/repolens-index-{uuid.uuid4().hex}").write(_chunks(spark, sf))
    return _INDEXES[key]


def _mini(spark) -> DataFrame:
    return spark.createDataFrame(M.FILES, "path string, language string, content string")


# Documents as files. ----------------------------------------------------------------------------------------------

FILES_SQL = """files AS (
  SELECT doc_id AS file_id, coalesce(source, '') AS project,
    coalesce(source, '') || '/' || coalesce(lang, '') || '/doc_' || doc_id || '.md' AS path, coalesce(lang, '') AS language,
    CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes, coalesce(text, '') AS content
  FROM documents)"""
LINES_SQL = """l0 AS (SELECT *, string_split(content, chr(10)) AS ls FROM files),
ll AS (SELECT path, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n FROM l0)"""
# A recursive walk over the lines: the chunk's lines and bytes so far, before line n.
CHUNKS_SQL = f"""RECURSIVE {FILES_SQL}, {LINES_SQL},
walk(path, n, start_line, k, b) AS (
  SELECT path, n, n, 1, strlen(line) + 1 FROM ll WHERE n = 1
  UNION ALL
  SELECT ll.path, ll.n, CASE WHEN k >= {T.MAX_LINES} OR b >= {T.MAX_BYTES} THEN ll.n ELSE start_line END,
    CASE WHEN k >= {T.MAX_LINES} OR b >= {T.MAX_BYTES} THEN 1 ELSE k + 1 END,
    CASE WHEN k >= {T.MAX_LINES} OR b >= {T.MAX_BYTES} THEN 0 ELSE b END + strlen(line) + 1
  FROM walk JOIN ll ON ll.path = walk.path AND ll.n = walk.n + 1
), chunks AS (
  SELECT path, start_line, max(n) AS end_line, string_agg(line, chr(10) ORDER BY n) AS content
  FROM walk JOIN ll USING (path, n) GROUP BY path, start_line
)"""
TOKENS_SQL = f"regexp_extract_all(translate(lower(content), '{T.MARKED}', '{T.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


@query("SELECT DISTINCT coalesce(source, '') AS name FROM documents ORDER BY name")
def list_projects(spark, sf):
    return _files(spark, sf).select(F.col("project").alias("name")).distinct().orderBy("name")


@query(f"WITH {FILES_SQL} SELECT file_id, project, path, language, size_bytes FROM files")
def list_files(spark, sf):
    return _files(spark, sf).drop("content").orderBy("path")


@query(f"WITH {FILES_SQL} SELECT language, count(*) AS files FROM files GROUP BY language")
def files_by_language(spark, sf):
    return _files(spark, sf).groupBy("language").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def content_hash(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


@query(f"""WITH {M.values("p", "path", [(x,) for x in M.PATHS])}
SELECT path, regexp_matches(path, '(^|/)({"|".join(x.replace(".", "[.]") for x in FS.IGNORED if "*" not in x and "/" not in x)})(/|$)')
  OR regexp_matches(path, '([.]lock|[.]min[.]js|[.]map|[.]png|[.]jpe?g|[.]gif|[.]webp|[.]svg|[.]pdf|[.]zip|[.]tar|[.]gz)(/|$)')
  OR path = 'storage/logs' OR starts_with(path, 'storage/logs/') AS ignored FROM p""")
def ignore_filter(spark, sf):
    return spark.createDataFrame([(x,) for x in M.PATHS], "path string").select("path", FS.ignored(F.col("path")).alias("ignored"))


def _language_sql(table: dict[str, str]) -> str:
    return "CASE lower(regexp_extract(path, '[.]([^./]*)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " ELSE '' END"


@query(f"WITH {M.values('p', 'path', [(x,) for x in M.PATHS])} SELECT path, {_language_sql(FS.LANGUAGES)} AS language, {_language_sql(FS.OUTPUT_LANGUAGES)} AS output_language FROM p")
def language_of(spark, sf):
    p = spark.createDataFrame([(x,) for x in M.PATHS], "path string")
    return p.select("path", FS.language_of(F.col("path")).alias("language"), FS.output_language(F.col("path")).alias("output_language"))


@query(f"""WITH {M.values("p", "path", [(x,) for x in M.LOOKUPS])}, {M.values("r", "name, root_path", M.PROJECTS)}
SELECT path, arg_max(name, length(root_path)) AS name, max_by(root_path, length(root_path)) AS root_path
FROM p JOIN r ON path = root_path OR starts_with(path, root_path || '/') GROUP BY path""")
def longest_prefix(spark, sf):
    return FS.longest_prefix(spark.createDataFrame([(x,) for x in M.LOOKUPS], "path string"), spark.createDataFrame(M.PROJECTS, "name string, root_path string"))


@query(f"WITH {CHUNKS_SQL} SELECT path, start_line, end_line, sha256(content) AS content_hash, greatest(1, length(content) // 4) * CAST(content <> '' AS BIGINT) AS token_estimate FROM chunks")
def chunk_documents(spark, sf):
    return _chunks(spark, sf).select("path", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"), "token_estimate")


@query(f"WITH {FILES_SQL} SELECT path, CASE WHEN content = '' THEN 0 ELSE greatest(1, length(content) // 4) END AS token_estimate, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END AS lines FROM files")
def token_estimate(spark, sf):
    c = F.col("content")
    return _files(spark, sf).select("path", T.token_estimate(c).alias("token_estimate"), T.line_count(c).alias("lines"))


@query(f"""WITH {FILES_SQL}, t AS (SELECT unnest({TOKENS_SQL}) AS token FROM files)
SELECT token, count(*) AS n FROM t GROUP BY token""")
def tokenize(spark, sf):
    return _files(spark, sf).select(F.explode(T.tokens(F.col("content"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHUNKS_SQL} SELECT count(*) AS n, round(avg(len({TOKENS_SQL})), 6) AS avgdl FROM chunks")
def corpus_stats(spark, sf):
    return S.corpus_stats(_chunks(spark, sf)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"""WITH {M.values("syn", "head, k, word", [(h, k + 1, w) for h, ws in T.SYNONYMS.items() for k, w in enumerate(ws)])},
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '') || ' payment sync'), '[a-z0-9_]+') AS ws FROM documents)),
t AS (SELECT doc_id, word AS term, pos * 100 AS pos FROM w WHERE length(word) > 1 UNION ALL SELECT doc_id, syn.word, pos * 100 + k FROM w JOIN syn ON head = w.word),
f AS (SELECT doc_id, term, min(pos) AS pos FROM t GROUP BY doc_id, term)
SELECT doc_id, count(*) AS terms, sha256(string_agg(term, ' ' ORDER BY pos)) AS terms_hash FROM f GROUP BY doc_id""")
def query_terms(spark, sf):
    """The terms of a batch of queries: every document's text with two words that have synonyms."""
    terms = T.terms_of(F.concat(F.coalesce("text", F.lit("")), F.lit(" payment sync")))
    t = _t(spark, sf, "documents").select("doc_id", terms.alias("ts"))
    return t.select("doc_id", F.size("ts").cast("long").alias("terms"), F.sha2(F.array_join("ts", " "), 256).alias("terms_hash"))


def _bm25_sql(terms: list[str]) -> str:
    spans = [(t, T.phrase(t)) for t in terms if T.phrase(t)]
    tf = " UNION ALL ".join(
        f"SELECT path, start_line, dl, '{t}' AS term, len(list_filter(range(1, dl + 1), lambda i: {' AND '.join(f'''coalesce(ts[i + {j}] = '{w}', false)''' for j, w in enumerate(p))})) AS tf FROM k" for t, p in spans
    )
    return f"""{CHUNKS_SQL}, k AS (SELECT path, start_line, {TOKENS_SQL} AS ts, CAST(len({TOKENS_SQL}) AS BIGINT) AS dl FROM chunks),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM k),
h AS (SELECT * FROM ({tf}) WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
w AS (SELECT path, start_line, tf, dl, avgdl, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM h JOIN df USING (term), st),
bm AS (SELECT path, start_line, round(-sum(CASE WHEN idf <= 0 THEN 1e-6::DOUBLE ELSE idf END * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS bm25
  FROM w GROUP BY path, start_line)"""


@query(f"WITH {_bm25_sql(TERMS)} SELECT path, start_line, round(bm25, 6) AS bm25 FROM bm")
def search_bm25(spark, sf):
    i = _index(spark, sf)
    return S.bm25(i, TERMS).join(i.chunks.select("chunk_id", "path", "start_line"), "chunk_id").select("path", "start_line", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {_bm25_sql([PHRASE])} SELECT path, start_line, tf FROM h")
def search_phrase(spark, sf):
    i = _index(spark, sf)
    return i.hits([PHRASE]).join(i.chunks.select("chunk_id", "path", "start_line"), "chunk_id").select("path", "start_line", "tf")


@query(f"WITH {_bm25_sql(TERMS)} SELECT path, start_line, term, tf, dl FROM h")
def phrase_hits(spark, sf):
    """Without an index: one pass over the chunks."""
    c = _chunks(spark, sf)
    return S.phrase_hits(c, TERMS).join(c.select("chunk_id", "path", "start_line"), "chunk_id").select("path", "start_line", "term", "tf", "dl")


def _ranked_sql() -> str:
    low, base = "lower(path)", "lower(split_part(path, '/', -1))"
    boost = " + ".join(f"CASE WHEN contains({low}, '{t}') THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN contains({base}, '{t}') THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN contains(lower(content), '{t}') THEN 0.3::DOUBLE ELSE 0 END" for t in TERMS)
    any_in = lambda where: " OR ".join(f"contains({where}, '{t}')" for t in TERMS)
    return f"""{_bm25_sql(TERMS)}, c4 AS (SELECT * FROM bm JOIN chunks USING (path, start_line) ORDER BY bm25, path, start_line LIMIT 80),
rk AS (SELECT path, start_line, end_line, bm25, content AS snippet,
  round(-bm25 + {boost} + CASE WHEN contains(lower(content), '{QUERY.lower()}') THEN 2.5::DOUBLE ELSE 0 END, 6) AS score,
  coalesce(nullif(concat_ws(' + ', CASE WHEN {any_in(low)} THEN 'path match' END, CASE WHEN {any_in('lower(content)')} THEN 'FTS match' END, CASE WHEN contains(lower(content), '{QUERY.lower()}') THEN 'exact phrase' END), ''), 'FTS rank') AS reason
  FROM c4 ORDER BY score DESC, bm25, path, start_line LIMIT 20)"""


@query(f"WITH {_ranked_sql()} SELECT path, start_line, end_line, score, reason FROM rk")
def search_ranked(spark, sf):
    return S.ranked(_index(spark, sf), QUERY, 20).drop("snippet")


_TRIM_SQL = """CASE WHEN length(s1) > {most} THEN substr(s1, 1, {most}) || chr(10) || '...' ELSE s1 END"""
_CUT_SQL = """CASE WHEN len(string_split({c}, chr(10))) > {n} THEN array_to_string(string_split({c}, chr(10))[1:{n}], chr(10)) || chr(10) || '...' ELSE {c} END"""


@query(f"""WITH {_ranked_sql()}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, start_line) AS rn FROM rk),
f AS (SELECT *, min(rn) OVER (PARTITION BY path) AS fr FROM o WHERE rn <= 5), d AS (SELECT *, dense_rank() OVER (ORDER BY fr) AS fno FROM f),
r2 AS (SELECT * EXCLUDE (rn), row_number() OVER (ORDER BY rn) AS rn FROM d WHERE fno <= 3),
c1 AS (SELECT *, {_CUT_SQL.format(c="snippet", n=40)} AS s1 FROM r2),
c2 AS (SELECT *, {_TRIM_SQL.format(most=3200)} AS s2 FROM c1),
e AS (SELECT *, strlen(path) + strlen(reason) + strlen(s2) + 100 AS estimate FROM c2),
u AS (SELECT *, sum(estimate) OVER (ORDER BY rn) AS used FROM e)
SELECT rn, path, start_line, end_line, score, reason, estimate, (SELECT bool_or(rn > 1 AND used > 12000) FROM u) AS truncated, sha256(s2) AS snippet_hash FROM u WHERE rn = 1 OR used <= 12000""")
def compact_results(spark, sf):
    return S.compact(S.ranked(_index(spark, sf), QUERY, 20)).withColumn("snippet_hash", F.sha2("snippet", 256)).drop("snippet", "symbols")


@query(f"WITH {FILES_SQL}, c AS (SELECT path, {_CUT_SQL.format(c='content', n=3)} AS s1 FROM files) SELECT path, {_TRIM_SQL.format(most=800)} AS snippet FROM c")
def trim_snippet(spark, sf):
    return _files(spark, sf).select("path", T.trim_snippet(F.col("content"), 3).alias("snippet"))


@query(f"""WITH {FILES_SQL}, {LINES_SQL}, one AS (SELECT * FROM ll WHERE path = (SELECT path FROM files WHERE file_id = 5)),
c AS (SELECT coalesce(min(n) FILTER (contains(lower(line), 'anin')), 1) AS m FROM one)
SELECT path, min(n) AS start_line, max(n) AS end_line, sha256(string_agg(line, chr(10) ORDER BY n)) AS content_hash
FROM one, c WHERE n >= greatest(1, m - 3) AND n < greatest(1, m - 3) + 6 GROUP BY path""")
def expand_window(spark, sf):
    f = _files(spark, sf)
    path = f.where("file_id = 5").first().path
    return S.expand_window(f, path, "anin", 6).select("path", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


def _snapshots(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every file before and after: some move, some get a new time, some a new time and text."""
    snap = lambda path, mtime, text: files.select(F.expr(path).alias("path"), F.expr(mtime).alias("mtime"), F.sha2(F.expr(text), 256).alias("hash"))
    moved = "CASE WHEN file_id % 5 = 0 THEN concat('moved/', path) ELSE path END"
    return snap("path", "file_id", "content"), snap(moved, "file_id + (file_id % 3)", "CASE WHEN file_id % 3 = 2 THEN concat(content, '!') ELSE content END")


@query(f"""WITH {FILES_SQL},
o AS (SELECT path, file_id AS m, sha256(content) AS h FROM files),
n AS (SELECT CASE WHEN file_id % 5 = 0 THEN 'moved/' || path ELSE path END AS path, file_id + file_id % 3 AS m, sha256(CASE WHEN file_id % 3 = 2 THEN content || '!' ELSE content END) AS h FROM files)
SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'add' WHEN n.path IS NULL THEN 'delete' WHEN n.m = o.m THEN 'skip' WHEN n.h = o.h THEN 'touch' ELSE 'reindex' END AS action
FROM n FULL JOIN o ON n.path = o.path""")
def incremental_plan(spark, sf):
    return FS.incremental_plan(*_snapshots(_files(spark, sf)))


@query(f"""WITH {_ranked_sql()} SELECT CAST(coalesce(sum(greatest(1, length(content) // 4)), 0) AS BIGINT) AS tokens_without, CAST(3000 AS BIGINT) AS tokens_actual
FROM files WHERE path IN (SELECT path FROM rk)""")
def token_accounting(spark, sf):
    f = _files(spark, sf).withColumn("token_estimate", T.token_estimate(F.col("content")))
    return U.token_accounting(S.ranked(_index(spark, sf), QUERY, 20), f, 3000)


# The mini code base. ----------------------------------------------------------------------------------------------

MINI_SQL = f"""{M.values("files", "path, lang0, content", M.FILES)}, {LINES_SQL},
code AS (SELECT ll.path, CASE lang0 WHEN 'javascriptreact' THEN 'javascript' ELSE lang0 END AS language, n AS line_no, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS sig FROM ll JOIN files USING (path))"""


def _q(p: str) -> str:
    return p.replace("'", "''")


def _symbol_sql(lang: str, kind: str, p: str, g: int) -> str:
    return f"SELECT path, regexp_extract(line, '{_q(p)}', {g}) AS name, '{kind}' AS kind, line_no, sig AS signature FROM code WHERE language = '{lang}' AND regexp_matches(line, '{_q(p)}')"


@query(f"WITH {MINI_SQL} " + " UNION ALL ".join(_symbol_sql(*x) for x in [("php", "class", X.PHP_CLASS_OR_ENUM, 2), ("php", "function", X.PHP_FUNCTION, 1), ("go", "function", X.GO_FUNCTION, 2), ("go", "type", X.GO_TYPE, 1), ("javascript", "function", X.JS_NAMED_FUNCTION, 1), ("javascript", "class", X.JS_PLAIN_CLASS, 1), ("typescript", "function", X.JS_NAMED_FUNCTION, 1), ("typescript", "class", X.JS_CLASS, 2)]))
def symbols_extract(spark, sf):
    return X.symbols(_mini(spark))


@query(f"WITH {MINI_SQL} SELECT path, unnest(regexp_extract_all(content, '{_q(X.IMPORT)}', 1)) AS imported_path FROM files")
def imports_extract(spark, sf):
    return X.imports(_mini(spark))


@query(f"WITH {MINI_SQL} SELECT 'file' AS type, split_part(path, '/', -1) AS name, path AS file_path, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END AS end_line FROM files")
def file_nodes(spark, sf):
    return X.file_nodes(_mini(spark)).select("type", "name", "file_path", "end_line")


_CARRY = "coalesce(last_value(nullif(cur, '') IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING), '')"


def _class_sql(kind: str, name: str) -> str:
    return f"""CASE WHEN {kind} <> 'class' THEN {kind} WHEN suffix({name}, 'Controller') THEN 'service' WHEN suffix({name}, 'Job') THEN 'job'
  WHEN suffix({name}, 'Command') OR contains(lower(path), '/console/commands/') THEN 'command' WHEN suffix({name}, 'Service') THEN 'service'
  WHEN contains(lower({name}), 'test') OR contains(lower(path), 'test') THEN 'test' WHEN contains(path, 'Models/') THEN 'model' ELSE 'class' END"""


PHP_SQL = f"""php0 AS (SELECT *, regexp_extract(line, '{X.PHP_CLASS}', 2) AS cur, regexp_extract(line, '{X.PHP_CLASS}', 1) AS kind, regexp_extract(line, '{X.PHP_FUNCTION}', 1) AS fn FROM code WHERE language = 'php'),
php1 AS (SELECT *, {_CARRY} AS cls FROM php0),
php AS (SELECT {_class_sql("kind", "cur")} AS type, cur AS name, cur AS qualified_name, path AS file_path, line_no AS start_line, 1 AS ordinal FROM php1 WHERE cur <> ''
UNION ALL SELECT CASE WHEN cls <> '' THEN 'method' ELSE 'function' END, fn, CASE WHEN cls <> '' THEN cls || '.' || fn ELSE fn END, path, line_no, 2 FROM php1 WHERE fn <> '')"""
GO_SQL = f"""go0 AS (SELECT *, regexp_extract(line, '{X.GO_TYPE}', 1) AS ty, regexp_extract(line, '{X.GO_TYPE}', 2) AS kind, regexp_extract(line, '{X.GO_FUNCTION}', 2) AS fn, regexp_extract(replace(regexp_extract(line, '{X.GO_FUNCTION}', 1), '*', ' '), '([^\\s.]+)\\s*$', 1) AS rcv FROM code WHERE language = 'go'),
go AS (SELECT CASE kind WHEN 'interface' THEN 'interface' ELSE 'class' END AS type, ty AS name, ty AS qualified_name, path AS file_path, line_no AS start_line, 1 AS ordinal FROM go0 WHERE ty <> ''
UNION ALL SELECT CASE WHEN rcv <> '' THEN 'method' ELSE 'function' END, fn, CASE WHEN rcv <> '' THEN rcv || '.' || fn ELSE fn END, path, line_no, 2 FROM go0 WHERE fn <> '')"""
JS_SQL = f"""js0 AS (SELECT *, regexp_extract(line, '{X.JS_CLASS}', 2) AS cur, regexp_extract(line, '{X.JS_CLASS}', 1) AS kind, regexp_extract(line, '{X.JS_FUNCTION}', 1) AS fn, regexp_extract(line, '{X.JS_METHOD}', 1) AS me FROM code WHERE language IN ('javascript', 'typescript')),
js1 AS (SELECT *, {_CARRY} AS cls FROM js0),
js AS (SELECT CASE kind WHEN 'interface' THEN 'interface' ELSE 'class' END AS type, cur AS name, cur AS qualified_name, path AS file_path, line_no AS start_line, 1 AS ordinal FROM js1 WHERE cur <> ''
UNION ALL SELECT 'function', fn, fn, path, line_no, 2 FROM js1 WHERE fn <> ''
UNION ALL SELECT 'method', me, cls || '.' || me, path, line_no, 3 FROM js1 WHERE fn = '' AND cls <> '' AND me <> '' AND me NOT IN ({", ".join(f"'{x}'" for x in X.NO_CALLS)}))"""
OTHER_SQL = f"""other AS (SELECT 'function' AS type, name, name AS qualified_name, path AS file_path, line_no AS start_line, 1 AS ordinal FROM (
  SELECT *, coalesce(nullif(regexp_extract(line, '{X.PHP_FUNCTION}', 1), ''), nullif(regexp_extract(line, '{X.JS_FUNCTION}', 1), ''), regexp_extract(line, '{X.GO_FUNCTION}', 2)) AS name FROM code WHERE language NOT IN ('php', 'go', 'javascript', 'typescript')) WHERE name <> '')"""
NODES_SQL = f"{MINI_SQL}, {PHP_SQL}, {GO_SQL}, {JS_SQL}, {OTHER_SQL}, nodes AS (SELECT * FROM php UNION ALL SELECT * FROM go UNION ALL SELECT * FROM js UNION ALL SELECT * FROM other)"
_NODE = ["type", "name", "qualified_name", "file_path", "start_line"]


@query(f"WITH {MINI_SQL}, {PHP_SQL} SELECT {', '.join(_NODE)} FROM php")
def php_symbols(spark, sf):
    return X.php_nodes(X.lines_of(_mini(spark))).select(*_NODE)


@query(f"WITH {MINI_SQL}, {GO_SQL} SELECT {', '.join(_NODE)} FROM go")
def go_symbols(spark, sf):
    return X.go_nodes(X.lines_of(_mini(spark))).select(*_NODE)


@query(f"WITH {MINI_SQL}, {JS_SQL} SELECT {', '.join(_NODE)} FROM js")
def js_symbols(spark, sf):
    return X.js_nodes(X.lines_of(_mini(spark))).select(*_NODE)


@query(f"WITH {MINI_SQL}, {OTHER_SQL} SELECT {', '.join(_NODE)} FROM other")
def fallback_symbols(spark, sf):
    return X.fallback_nodes(X.lines_of(_mini(spark))).select(*_NODE)


@query(f"WITH {MINI_SQL}, {PHP_SQL} SELECT name, type FROM php WHERE ordinal = 1")
def classify_nodes(spark, sf):
    return X.php_nodes(X.lines_of(_mini(spark))).where("ordinal = 1").select("name", "type")


NEAR_SQL = f"""{NODES_SQL}, marked AS (SELECT file_path AS path, start_line AS line_no, arg_max(qualified_name, ordinal) AS cur FROM nodes GROUP BY 1, 2),
near AS (SELECT path, line_no, line, sig, {_CARRY} AS symbol FROM code LEFT JOIN marked USING (path, line_no))"""
CALLS_SQL = f"""calls AS (SELECT path, symbol AS from_name, to_name, line_no FROM (
  SELECT *, coalesce(nullif(b, ''), a) AS to_name FROM (SELECT *, unnest(regexp_extract_all(line, '{X.CALL}', 1)) AS a, unnest(regexp_extract_all(line, '{X.CALL}', 2)) AS b FROM near))
  WHERE to_name NOT IN ({", ".join(f"'{x}'" for x in X.NO_CALLS)}) AND lower(to_name) <> 'function' AND to_name <> symbol)"""


@query(f"WITH {NEAR_SQL}, {CALLS_SQL} SELECT * FROM calls")
def call_sites(spark, sf):
    return X.calls(_mini(spark)).drop("raw")


_SHORT = "regexp_extract({c}, '([^\\\\]*)$', 1)"


@query(f"""WITH {MINI_SQL}, r AS (SELECT * FROM code WHERE starts_with(path, 'routes/') AND suffix(path, '.php'))
""" + " UNION ALL ".join(f"SELECT path, upper(regexp_extract(line, '{_q(p)}', 1)) AS method, regexp_extract(line, '{_q(p)}', 2) AS uri, {_SHORT.format(c=f'''regexp_extract(line, '{_q(p)}', 3)''')} AS controller, regexp_extract(line, '{_q(p)}', 4) AS action, line_no FROM r WHERE regexp_matches(line, '{_q(p)}')" for p in (X.ROUTE_ARRAY, X.ROUTE_AT)))
def routes(spark, sf):
    return X.routes(_mini(spark)).drop("raw")


USES_SQL = f"""SELECT path, symbol AS from_name, unnest(regexp_extract_all(line, '{X.MODEL}', 1)) AS to_name, 'uses' AS type, line_no FROM near
UNION ALL SELECT path, symbol, {_SHORT.format(c=f"unnest(regexp_extract_all(line, '{X.CONTAINER}', 1))")}, 'depends_on', line_no FROM near
UNION ALL SELECT * FROM (SELECT path, symbol, coalesce(nullif(a, ''), b) AS job, 'depends_on', line_no FROM (SELECT *, unnest(regexp_extract_all(line, '{X.DISPATCH}', 1)) AS a, unnest(regexp_extract_all(line, '{X.DISPATCH}', 2)) AS b FROM near)) WHERE job <> ''
UNION ALL SELECT path, cur, {_SHORT.format(c=f"regexp_extract(line, '{X.EXTENDS}', 1)")}, 'extends', line_no FROM php1 WHERE cur <> '' AND regexp_matches(line, '{X.EXTENDS}')
UNION ALL SELECT path, cur, {_SHORT.format(c="trim(part)")}, 'implements', line_no FROM (SELECT *, unnest(string_split(regexp_extract(line, '{X.IMPLEMENTS}', 1), ',')) AS part FROM php1 WHERE cur <> '') WHERE trim(part) <> ''"""


@query(f"WITH {NEAR_SQL} {USES_SQL}")
def uses_sites(spark, sf):
    return X.uses(_mini(spark)).drop("raw")


@query(rf"""WITH {M.values("files", "path, language, content", M.FILES)}, s AS (SELECT *, language = 'php' AS php, language = 'go' AS go FROM files)
SELECT path, CASE WHEN php THEN regexp_extract(content, 'namespace ([A-Za-z\\]+);', 1) WHEN go THEN split_part(split_part(content, chr(10), 1), ' ', 2) ELSE '' END AS namespace,
  CASE WHEN php AND regexp_matches(content, '(^|\n)(final )?class ') THEN 'class' ELSE '' END AS class_kind,
  CASE WHEN php THEN regexp_extract(content, '(?:^|\n)(?:final )?class ([A-Za-z]+)', 1) ELSE '' END AS class_name,
  CASE WHEN php THEN len(regexp_extract_all(content, '\n *(public|private|protected)( static)? function ')) WHEN go THEN len(regexp_extract_all(content, '\nfunc ')) ELSE 0 END AS methods,
  CAST(contains(lower(content), 'users') AS INT) + CAST(contains(lower(content), 'save') AS INT) AS matched FROM s""")
def summaries(spark, sf):
    s = X.summaries(_mini(spark), ["users", "save", "nothing"])
    return s.select("path", "namespace", "class_kind", "class_name", F.size("methods").alias("methods"), F.size("matched_for").alias("matched"))


def _role_sql() -> str:
    out = []
    for (inside, start, end), name in X.ROLES:
        tests = [f"contains(lower(path), '{inside}')"] * bool(inside) + [f"starts_with(lower(path), '{start}')"] * bool(start) + [f"suffix(lower(path), '{end}')"] * bool(end)
        out.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return "CASE " + " ".join(out) + " ELSE 'PHP' END"


@query(f"WITH {M.values('p', 'path', [(x[0],) for x in M.FILES])} SELECT path, {_role_sql()} AS role FROM p")
def file_roles(spark, sf):
    return _mini(spark).select("path", X.role(F.col("path"), F.lit("")).alias("role"))


RESOLVE_SQL = """keys AS (SELECT key, arg_min(qualified_name, (rank, file_path, start_line, type)) AS q, arg_min(file_path, (rank, file_path, start_line, type)) AS f FROM (
  SELECT *, qualified_name AS key, 0 AS rank FROM nodes UNION ALL SELECT *, name, 1 FROM nodes
  UNION ALL SELECT *, regexp_extract(qualified_name, '^[^.]*[.](.*)$', 1), 2 FROM nodes WHERE contains(qualified_name, '.')) GROUP BY key)"""


@query(f"WITH {NODES_SQL}, {RESOLVE_SQL}, {M.values('w', 'name', [(x,) for x in ('Save', 'UserController.index', 'index', 'nothing', 'Cart', 'list')])} SELECT name, q AS qualified_name, f AS file_path FROM w LEFT JOIN keys ON key = name")
def resolve_symbol(spark, sf):
    nodes = G.graph_nodes(_mini(spark))
    rows = spark.createDataFrame([(x,) for x in ("Save", "UserController.index", "index", "nothing", "Cart", "list")], "name string")
    got = G.resolve(rows.withColumnRenamed("name", "word"), "word", G.symbol_keys(nodes), "node_id")
    return got.join(nodes.select("node_id", "qualified_name", "file_path"), "node_id", "left").select(F.col("word").alias("name"), "qualified_name", "file_path")


@query(f"""WITH {NODES_SQL}, {RESOLVE_SQL}, i AS (SELECT path, unnest(regexp_extract_all(content, '{_q(X.IMPORT)}', 1)) AS imported_path FROM files)
SELECT path, imported_path, q AS qualified_name FROM i LEFT JOIN keys ON key = regexp_replace(split_part(imported_path, '/', -1), '[.][^.]*$', '')""")
def resolve_import(spark, sf):
    nodes = G.graph_nodes(_mini(spark))
    rows = X.imports(_mini(spark)).withColumn("base", G.import_base(F.col("imported_path")))
    got = G.resolve(rows, "base", G.symbol_keys(nodes), "node_id")
    return got.join(nodes.select("node_id", "qualified_name"), "node_id", "left").select("path", "imported_path", "qualified_name")


@query(f"""WITH {NODES_SQL} SELECT {', '.join(_NODE)} FROM nodes UNION ALL SELECT 'file', split_part(path, '/', -1), path, path, 1 FROM files
UNION ALL SELECT 'route', r, r, 'routes/web.php', n FROM (VALUES ('GET /users', 3), ('POST /pay', 4)) v(r, n)""")
def graph_nodes(spark, sf):
    return G.graph_nodes(_mini(spark)).select(*_NODE)


@query(f"WITH {NEAR_SQL}, {RESOLVE_SQL}, {CALLS_SQL} SELECT f.path AS from_file, coalesce(k1.q, f.path) AS from_name, k2.q AS to_name FROM calls f LEFT JOIN keys k1 ON k1.key = from_name JOIN keys k2 ON k2.key = to_name WHERE NOT (coalesce(k1.q, f.path) = k2.q AND coalesce(k1.f, f.path) = k2.f)")
def edges_calls(spark, sf):
    mini = _mini(spark)
    nodes = G.graph_nodes(mini)
    keys, ids = G.symbol_keys(nodes), nodes.where("type = 'file'").select(F.col("file_path").alias("path"), F.col("node_id").alias("own_id"))
    e = G.resolve(G.resolve(X.calls(mini), "from_name", keys, "f1"), "to_name", keys, "to_id").join(ids, "path").withColumn("from_id", F.coalesce("f1", "own_id"))
    name = lambda c: nodes.select(F.col("node_id").alias(c), F.col("qualified_name").alias(c.replace("_id", "_name_")))
    e = e.where("to_id IS NOT NULL AND from_id <> to_id").join(name("from_id"), "from_id").join(name("to_id"), "to_id")
    return e.select(F.col("path").alias("from_file"), F.col("from_name_").alias("from_name"), F.col("to_name_").alias("to_name"))


@query(f"""WITH {NODES_SQL} SELECT file_path AS from_name, qualified_name AS to_name FROM nodes
UNION ALL SELECT 'routes/web.php', unnest(['GET /users', 'POST /pay'])""")
def edges_defines(spark, sf):
    nodes = G.graph_nodes(_mini(spark))
    e = G.graph_edges(_mini(spark), nodes).where("type = 'defines'")
    name = lambda c, out: nodes.select(F.col("node_id").alias(c), F.col("qualified_name").alias(out))
    return e.join(name("from_id", "from_name"), "from_id").join(name("to_id", "to_name"), "to_id").select("from_name", "to_name")


@query(f"""WITH {NEAR_SQL}, {RESOLVE_SQL}, {CALLS_SQL}, uses AS ({USES_SQL}),
sites AS (SELECT path, from_name, to_name, 'calls' AS type, 0.65::DOUBLE AS confidence FROM calls UNION ALL SELECT path, from_name, to_name, type, 0.8::DOUBLE FROM uses)
SELECT 'defines' AS type, file_path AS from_name, qualified_name AS to_name, 1.0::DOUBLE AS confidence FROM nodes
UNION ALL SELECT 'defines', 'routes/web.php', unnest(['GET /users', 'POST /pay']), 1.0::DOUBLE
UNION ALL SELECT 'imports', path, q, 0.8::DOUBLE FROM (SELECT path, unnest(regexp_extract_all(content, '{_q(X.IMPORT)}', 1)) AS i FROM files) JOIN keys ON key = regexp_replace(split_part(i, '/', -1), '[.][^.]*$', '')
UNION ALL SELECT 'route_to', r, q, 1.0::DOUBLE FROM (VALUES ('GET /users', 'UserController.index'), ('POST /pay', 'PayController.store')) v(r, target) JOIN keys ON key = target
UNION ALL SELECT type, coalesce(k1.q, path), k2.q, confidence FROM sites LEFT JOIN keys k1 ON k1.key = trim(from_name) JOIN keys k2 ON k2.key = trim(to_name)
  WHERE NOT (coalesce(k1.q, path) = k2.q AND coalesce(k1.f, path) = k2.f)""")
def graph_edges(spark, sf):
    nodes = G.written(G.graph_nodes(_mini(spark)), "nodes")
    name = lambda c, out: nodes.select(F.col("node_id").alias(c), F.col("qualified_name").alias(out))
    e = G.graph_edges(_mini(spark), nodes)
    return e.join(name("from_id", "from_name"), "from_id").join(name("to_id", "to_name"), "to_id").select("type", "from_name", "to_name", "confidence")


# The link graph of pages. -----------------------------------------------------------------------------------------

GRAPH_SQL = """lk AS (SELECT url, unnest(h) AS target, unnest(range(0, len(h))) AS pos FROM (SELECT url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)),
nd AS (SELECT CAST('0x' || substr(md5(u), 1, 15) AS BIGINT) AS node_id, type, split_part(u, '/', -1) AS name, u AS qualified_name, u AS file_path, 1 AS start_line FROM (
  SELECT DISTINCT url AS u, 'file' AS type FROM pages UNION ALL SELECT DISTINCT target, 'route' FROM lk WHERE target NOT IN (SELECT url FROM pages))),
ed AS (SELECT CAST('0x' || substr(md5(url || '|' || target || '|' || pos), 1, 15) AS BIGINT) AS edge_id, CAST('0x' || substr(md5(url), 1, 15) AS BIGINT) AS from_id, CAST('0x' || substr(md5(target), 1, 15) AS BIGINT) AS to_id, 'imports' AS type FROM lk WHERE url <> target),
en AS (SELECT edge_id, from_id AS node_id FROM ed UNION ALL SELECT edge_id, to_id FROM ed),
dg AS (SELECT nd.*, (SELECT count(*) FROM en WHERE en.node_id = nd.node_id) AS degree FROM nd)"""


def _graph(spark, sf):
    return G.page_graph(_t(spark, sf, "pages"))


@query(f"WITH {GRAPH_SQL} SELECT type, count(*) AS n FROM nd GROUP BY type")
def nodes_by_type(spark, sf):
    return _graph(spark, sf)[0].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GRAPH_SQL} SELECT type, count(*) AS n FROM ed GROUP BY type")
def edges_by_type(spark, sf):
    return _graph(spark, sf)[1].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GRAPH_SQL} SELECT node_id, type, name, file_path, degree FROM dg WHERE type = 'file' ORDER BY degree DESC, name, node_id LIMIT 10")
def top_connected_files(spark, sf):
    return G.top_connected(*_graph(spark, sf), True)


@query(f"WITH {GRAPH_SQL} SELECT node_id, type, name, file_path, degree FROM dg WHERE type <> 'file' ORDER BY degree DESC, name, node_id LIMIT 10")
def top_connected_symbols(spark, sf):
    return G.top_connected(*_graph(spark, sf), False)


@query(f"WITH {GRAPH_SQL} SELECT to_id AS node_id, name, count(*) AS incoming FROM ed JOIN nd ON to_id = node_id GROUP BY 1, 2 ORDER BY incoming DESC, name, node_id LIMIT 10")
def call_hotspots(spark, sf):
    return G.hotspots(*_graph(spark, sf), "imports")


@query(f"WITH {GRAPH_SQL} SELECT node_id, file_path FROM nd WHERE type = 'file' AND node_id NOT IN (SELECT node_id FROM en) ORDER BY file_path LIMIT 50")
def orphan_files(spark, sf):
    return G.orphans(*_graph(spark, sf))


@query(f"WITH {GRAPH_SQL} SELECT node_id, name, file_path, start_line FROM nd WHERE type = 'route' ORDER BY file_path, start_line, node_id LIMIT 50")
def nodes_of_type(spark, sf):
    return G.nodes_of_type(_graph(spark, sf)[0], "route")


@query("SELECT count(*) AS indexed, count(DISTINCT url) AS graphed, count(*) <> count(DISTINCT url) AS drift FROM pages")
def graph_drift(spark, sf):
    p = _t(spark, sf, "pages")
    n = p.agg(F.count(F.lit(1)).alias("indexed"))
    g = G.page_graph(p)[0].where("type = 'file'").agg(F.count(F.lit(1)).alias("graphed"))
    return n.join(g).select("indexed", "graphed", (F.col("indexed") != F.col("graphed")).alias("drift"))


@query("SELECT count(*) AS stale FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01 00:00:00'")
def graph_staleness(spark, sf):
    return FS.stale(_t(spark, sf, "orders").select(F.col("o_orderdate").alias("mtime")), F.lit("1997-01-01").cast("timestamp_ntz"))


@query(f"""WITH {GRAPH_SQL}, r AS (SELECT *, CASE WHEN name = 'The' OR qualified_name = 'The' THEN 0 WHEN file_path = 'The' THEN 1 WHEN name ILIKE '%The%' OR qualified_name ILIKE '%The%' OR file_path ILIKE '%The%' THEN CASE type WHEN 'file' THEN 2 ELSE 3 END END AS rank FROM nd)
SELECT node_id, type, name, file_path, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, length(name), node_id LIMIT 1""")
def find_node(spark, sf):
    return G.find_node(_graph(spark, sf)[0], "The")


@query(f"""WITH {GRAPH_SQL}, {M.values("t", "term", [("the",), ("an",), ("zzz",)])}, m AS (SELECT term, node_id, name, row_number() OVER (PARTITION BY term ORDER BY length(name), node_id) AS k
FROM nd, t WHERE type <> 'file' AND (lower(name) LIKE '%' || term || '%' OR lower(qualified_name) LIKE '%' || term || '%')) SELECT term, node_id, name FROM m WHERE k <= 10""")
def symbol_matches(spark, sf):
    return G.symbol_matches(_graph(spark, sf)[0], ["the", "an", "zzz"])


@query(f"""WITH {GRAPH_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY type <> 'file', start_line, node_id) AS k FROM nd WHERE file_path IN (SELECT target FROM lk UNION ALL SELECT url FROM pages))
SELECT node_id, type, name, qualified_name, file_path, start_line FROM m WHERE k <= 25 AND (type = 'file' OR contains(lower(name || ' ' || qualified_name || ' ' || file_path), 'th'))""")
def seed_nodes(spark, sf):
    """Seeds of every page and link target."""
    nodes = _graph(spark, sf)[0]
    return G.seed_nodes(nodes, nodes.select(F.col("file_path").alias("path")), ["th"])


def _near_sql(depth: int) -> str:
    return f"""RECURSIVE {GRAPH_SQL}, both_ends AS (SELECT from_id AS a, to_id AS b FROM ed UNION SELECT to_id, from_id FROM ed),
w(node_id, d) AS (SELECT CAST('0x' || substr(md5(url), 1, 15) AS BIGINT), 0 FROM pages WHERE page_id = 0 UNION SELECT b, d + 1 FROM w JOIN both_ends ON a = node_id WHERE d < {depth}),
near AS (SELECT node_id, min(d) AS distance FROM w GROUP BY node_id)"""


def _near(spark, sf, depth):
    nodes, edges = _graph(spark, sf)
    start = _t(spark, sf, "pages").where("page_id = 0").join(nodes, F.col("url") == F.col("qualified_name")).select("node_id")
    return G.neighbors(nodes, edges, start, depth)


@query(f"WITH {_near_sql(1)} SELECT node_id, name, type, distance FROM near JOIN nd USING (node_id)")
def neighbors_d1(spark, sf):
    return _near(spark, sf, 1)[0].select("node_id", "name", "type", "distance")


@query(f"WITH {_near_sql(2)} SELECT node_id, name, type, distance FROM near JOIN nd USING (node_id)")
def neighbors_d2(spark, sf):
    return _near(spark, sf, 2)[0].select("node_id", "name", "type", "distance")


@query(f"WITH {_near_sql(2)} SELECT DISTINCT edge_id, from_id, to_id FROM ed WHERE from_id IN (SELECT node_id FROM near WHERE distance < 2) OR to_id IN (SELECT node_id FROM near WHERE distance < 2)")
def neighbor_edges_d2(spark, sf):
    return _near(spark, sf, 2)[1].select("edge_id", "from_id", "to_id")


@query(f"""WITH {_near_sql(2)}, k AS (SELECT node_id, name, type, distance FROM near JOIN nd USING (node_id) WHERE type IN ('route') ORDER BY distance, name, node_id LIMIT 40)
SELECT * FROM k""")
def neighbors_compact(spark, sf):
    near, edges = _near(spark, sf, 2)
    return G.neighbors_compact(near, edges, ["route"])[0].select("node_id", "name", "type", "distance")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, both_ends AS (SELECT from_id AS a, to_id AS b FROM ed UNION SELECT to_id, from_id FROM ed),
s AS (SELECT from_id FROM ed GROUP BY from_id ORDER BY count(*) DESC, from_id LIMIT 1),
w(node_id, d) AS (SELECT from_id, 0 FROM s UNION SELECT b, d + 1 FROM w JOIN both_ends ON a = node_id WHERE d < 2),
near AS (SELECT node_id, min(d) AS distance FROM w GROUP BY node_id)
SELECT from_id AS start, node_id AS goal, distance AS hops, true AS joined FROM near, s ORDER BY distance DESC, node_id LIMIT 1""")
def graph_path(spark, sf):
    """Hops of a shortest path, and whether each step's edge joins its nodes."""
    kind = "start long, goal long, hops int, joined boolean"
    edges = G.written(_graph(spark, sf)[1], "page-edges")  # the steps below read links, not pages
    row = edges.groupBy(F.col("from_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node_id").limit(1).first()
    if row is None:  # no links
        return spark.createDataFrame([], kind)
    far = G.reach(edges, spark.createDataFrame([(row.node_id,)], "seed_id long"), 2).orderBy(F.desc("distance"), "node_id").limit(1).first()
    steps = G.shortest_path(edges, row.node_id, far.node_id)
    used = {r.edge_id: {r.from_id, r.to_id} for r in edges.where(F.col("edge_id").isin([e for _, e in steps if e is not None])).collect()}
    joined = all(used[e] == {steps[i][0], n} for i, (n, e) in enumerate(steps[1:]))
    return spark.createDataFrame([(steps[0][0], steps[-1][0], len(steps) - 1, joined)], kind)


@query(f"""WITH {GRAPH_SQL}, both_ends AS (SELECT from_id AS a, to_id AS b FROM ed UNION SELECT to_id, from_id FROM ed),
hit AS (SELECT url AS file_path, max(strlen(html) % 97)::DOUBLE AS hit FROM pages GROUP BY url),
m AS (SELECT nd.*, hit, row_number() OVER (PARTITION BY file_path ORDER BY type <> 'file', start_line, node_id) AS k FROM nd JOIN hit USING (file_path)),
seed AS (SELECT * FROM m WHERE k <= 25 AND (type = 'file' OR contains(lower(name || ' ' || qualified_name || ' ' || file_path), 'example') OR contains(lower(name || ' ' || qualified_name || ' ' || file_path), 'the'))),
t AS (SELECT unnest(['example', 'the']) AS term),
sy AS (SELECT DISTINCT node_id FROM (SELECT node_id, row_number() OVER (PARTITION BY term ORDER BY length(name), node_id) AS k FROM nd, t WHERE type <> 'file' AND (contains(lower(name), term) OR contains(lower(qualified_name), term))) WHERE k <= 10),
f AS (SELECT node_id, hit + CASE WHEN lower(name) = 'example the' OR lower(qualified_name) = 'example the' THEN 10 ELSE 5 END AS score, 'direct FTS/symbol match' AS reason, 0 AS distance FROM seed
  UNION ALL SELECT node_id, hit + 6, 'graph neighbor', 0 FROM seed UNION ALL SELECT b, hit + 3.5, 'graph neighbor', 1 FROM seed JOIN both_ends ON a = node_id
  UNION ALL SELECT node_id, 8, 'symbol match', 0 FROM sy UNION ALL SELECT node_id, 4, 'symbol graph neighbor', 1 FROM sy UNION ALL SELECT b, 4, 'symbol graph neighbor', 1 FROM sy JOIN both_ends ON a = node_id),
b AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, reason DESC, distance DESC) AS k FROM f)
SELECT node_id, round(score, 6) AS score, reason, distance, type, name, file_path FROM b JOIN nd USING (node_id) WHERE k = 1 ORDER BY score DESC, node_id LIMIT 50""")
def expand_related(spark, sf):
    """Around every page, each with a score of its own."""
    nodes, edges = _graph(spark, sf)
    direct = _t(spark, sf, "pages").select(F.col("url").alias("path"), (F.octet_length(F.coalesce("html", F.lit(""))) % 97).cast("double").alias("score"))
    return G.expand_related(nodes, edges, direct, "example the").drop("start_line")


@query(f"""WITH {GRAPH_SQL} SELECT count(*) FILTER (type = 'file') AS files, count(*) FILTER (type <> 'file') AS symbols, (SELECT count(*) FROM ed) AS edges,
  '{{"file":' || count(*) FILTER (type = 'file') || ',"route":' || count(*) FILTER (type = 'route') || '}}' AS node_types, '{{"imports":' || (SELECT count(*) FROM ed) || '}}' AS edge_types,
  count(*) FILTER (type = 'file' AND node_id NOT IN (SELECT node_id FROM en)) AS orphans FROM nd""")
def graph_stats(spark, sf):
    return G.stats_row(*_graph(spark, sf))


@query(f"""WITH {FILES_SQL} SELECT path, language, size_bytes, sha256(content) AS hash FROM files WHERE size_bytes <= 1500000 AND NOT contains(content, chr(0))""")
def scan_files(spark, sf):
    """The guards of a scan over the documents as files."""
    f = _files(spark, sf).where(FS.admitted(F.col("path"), F.col("size_bytes")) & (F.instr("content", "\0") == 0))
    return f.select("path", "language", "size_bytes", F.sha2("content", 256).alias("hash"))


# Usage. -----------------------------------------------------------------------------------------------------------

USAGE_SQL = "us AS (SELECT event_id AS usage_id, event_type AS tool, 'u' || (user_id % 10) AS project, date_trunc('second', ts) AS called_at, CAST(ceil(value * 4) AS BIGINT) AS tokens_without, CAST(floor(value) AS BIGINT) AS tokens_actual FROM events)"
_PCT = "round(CASE WHEN tokens_without > 0 THEN (tokens_without - tokens_actual) * 100.0::DOUBLE / tokens_without ELSE 0.0 END, 6)"


def _usage(spark, sf):
    return U.usage_facts(_t(spark, sf, "events"))


@query(f"WITH {USAGE_SQL} SELECT usage_id, tool, project, tokens_actual FROM us WHERE tool = 'click' AND called_at >= TIMESTAMP '2024-01-05' AND called_at < TIMESTAMP '2024-01-21' AND tokens_actual >= 10 AND tokens_actual <= 400")
def usage_filter(spark, sf):
    return U.usage_filter(_usage(spark, sf), tool="click", since="2024-01-05", until="2024-01-20", least=10, most=400).orderBy(F.desc("called_at")).select("usage_id", "tool", "project", "tokens_actual")


@query(f"WITH {USAGE_SQL} SELECT usage_id, tool, tokens_without - tokens_actual AS saved, {_PCT} AS saved_pct FROM us")
def usage_savings(spark, sf):
    return U.savings(_usage(spark, sf)).select("usage_id", "tool", "saved", "saved_pct")


@query(f"WITH {USAGE_SQL}, g AS (SELECT tool, count(*) AS calls, CAST(sum(tokens_without) AS BIGINT) AS tokens_without, CAST(sum(tokens_actual) AS BIGINT) AS tokens_actual FROM us GROUP BY ROLLUP (tool)) SELECT *, tokens_without - tokens_actual AS saved, {_PCT} AS saved_pct FROM g")
def usage_totals(spark, sf):
    return U.totals(_usage(spark, sf))


@query("SELECT DISTINCT event_type AS tool FROM events ORDER BY tool")
def usage_tools(spark, sf):
    return _usage(spark, sf).select("tool").distinct().orderBy("tool")


@query(f"WITH {USAGE_SQL} SELECT strftime(date_trunc('hour', called_at), '%Y-%m-%d %H') AS hour, tool, count(*) AS calls, CAST(sum(tokens_actual) AS BIGINT) AS tokens_actual FROM us GROUP BY 1, 2")
def usage_windows(spark, sf):
    u = _usage(spark, sf).withColumn("called_at", F.col("called_at").cast("timestamp"))
    return SU.windowed_usage(u).select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "tool", "calls", "tokens_actual")


# Compositions. ----------------------------------------------------------------------------------------------------


@query()
def context_pack(spark, sf):
    text, paths = context.context_pack(_index(spark, sf), QUERY, 12_000)
    return spark.createDataFrame([(len(text), len(paths), text)], "chars long, files long, markdown string")


@query()
def context_pack_graph(spark, sf):
    """A pack with its graph part, over the mini code base."""
    e = Engine(_mini(spark))
    pack = e.context("user list save", 4000, True)
    return spark.createDataFrame([(pack["token_estimate"], len(pack["paths"]), pack["markdown"])], "tokens long, files long, markdown string")


@query(f"""WITH {GRAPH_SQL}, s(title) AS (SELECT unnest(['Languages', 'Node types', 'Edge types', 'Most connected files', 'Most connected symbols', 'Routes', 'Services', 'Models', 'Jobs', 'Commands', 'Tests', 'Call hotspots', 'Orphan files', 'Files with high coupling']))
SELECT title, CASE title WHEN 'Node types' THEN (SELECT count(DISTINCT type) FROM nd) WHEN 'Edge types' THEN (SELECT count(DISTINCT type) FROM ed)
  WHEN 'Most connected files' THEN least(10, (SELECT count(*) FROM nd WHERE type = 'file')) WHEN 'Files with high coupling' THEN least(10, (SELECT count(*) FROM nd WHERE type = 'file'))
  WHEN 'Most connected symbols' THEN least(10, (SELECT count(*) FROM nd WHERE type <> 'file')) WHEN 'Routes' THEN least(50, (SELECT count(*) FROM nd WHERE type = 'route'))
  WHEN 'Orphan files' THEN least(50, (SELECT count(*) FROM nd WHERE type = 'file' AND node_id NOT IN (SELECT node_id FROM en))) ELSE 0 END AS lines FROM s""")
def graph_report(spark, sf):
    """Sections of the report and the lines in each."""
    parts = context.report(*_graph(spark, sf), "pages").split("\n## ")[1:]
    return spark.createDataFrame([(p.split("\n")[0], sum(x.startswith("- ") for x in p.split("\n"))) for p in parts], "title string, lines long")
