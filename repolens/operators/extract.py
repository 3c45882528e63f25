"""Structural extraction from code, line by line: symbols, imports, graph nodes, calls, routes, uses,
summaries. Regular expressions run JVM-side; "current" names are window functions within a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The shapes of declarations, imports, calls and routes that are recognised, and words that are no calls.
ID, JS_ID, NS = r"[A-Za-z_]\w*", r"[A-Za-z_$][\w$]*", r"[A-Za-z_\\][\w\\]*"
PHP_CLASS = rf"\b(class|interface|trait)\s+({ID})"
PHP_CLASS_OR_ENUM = rf"\b(class|interface|trait|enum)\s+({ID})"
PHP_FUNCTION = rf"\bfunction\s+({ID})\s*\("
GO_FUNCTION = rf"\bfunc\s+(?:\(([^)]*)\)\s*)?({ID})\s*\("
GO_TYPE = rf"\btype\s+({ID})\s+(struct|interface)"
JS_CLASS = rf"\b(class|interface|type)\s+({JS_ID})"
JS_PLAIN_CLASS = rf"\bclass\s+({JS_ID})"
JS_NAMED_FUNCTION = rf"\bfunction\s+({JS_ID})\s*\("
JS_FUNCTION = rf"\b(?:function|const|let|var)\s+({JS_ID})\s*(?:=|\()"
JS_METHOD = rf"^\s*(?:public|protected|private|static|async|\*)*\s*({JS_ID})\s*\([^;]*\)"
IMPORT = r"(?m)^\s*(?:use|import|require|from)\s+[\"']?([^\"';\s]+)"
CALL = rf"\b({ID})\s*(?:::|->|\.)?\s*({ID})?\s*\("
ROUTE_ARRAY = rf"Route::([A-Za-z]+)\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*\[\s*({NS})::class\s*,\s*['\"]({ID})['\"]"
ROUTE_AT = rf"Route::([A-Za-z]+)\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"]({NS})@({ID})['\"]"
MODEL = r"\b([A-Z]\w*)::(?:query|where|find|create|update|first|get)\s*\("
CONTAINER = rf"\bapp\s*\(\s*({NS})::class\s*\)"
DISPATCH = rf"\b(?:dispatch\s*\(\s*new\s+|({ID})::dispatch\s*\()({ID})?"
EXTENDS = rf"\bextends\s+({NS})"
IMPLEMENTS = r"\bimplements\s+([A-Za-z_\\][\w\\, ]+)"
NO_CALLS = ["if", "for", "switch", "return", "while", "catch", "foreach", "function", "class", "new", "make", "array"]
ROLES = [
    (("", "", ".blade.php"), "Blade View"), (("/controllers/", "", "controller.php"), "Controller"), (("/services/", "", "service.php"), "Service"),
    (("/models/", "", "model.php"), "Model"), (("/repositories/", "", "repository.php"), "Repository"), (("/middleware/", "", "middleware.php"), "Middleware"),
    (("/jobs/", "", "job.php"), "Job"), (("/events/", "", "event.php"), "Event"), (("/listeners/", "", "listener.php"), "Listener"),
    (("migrations/", "", ""), "Migration"), (("/routes/", "routes/", "routes.php"), "Route file"), (("/tests/", "tests/", ""), "Test"),
]

_trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
_group = lambda pattern, n: F.regexp_extract("line", pattern, n)


def lines_of(files: DataFrame) -> DataFrame:
    """path, language (tsx and jsx as their plain forms), line_no from 1, line."""
    lang = F.when(F.col("language") == "typescriptreact", "typescript").when(F.col("language") == "javascriptreact", "javascript").otherwise(F.col("language"))
    return files.select("path", lang.alias("language"), F.posexplode(T.lines(F.col("content"))).alias("n", "line")).select("path", "language", (F.col("n") + 1).alias("line_no"), "line")


def symbols(files: DataFrame) -> DataFrame:
    """Path, name, kind, line_no, signature; each pattern once a line. Go types are named by their identifier."""
    rules = [("php", "class", PHP_CLASS_OR_ENUM, 2), ("php", "function", PHP_FUNCTION, 1), ("go", "function", GO_FUNCTION, 2), ("go", "type", GO_TYPE, 1), ("javascript", "function", JS_NAMED_FUNCTION, 1), ("javascript", "class", JS_PLAIN_CLASS, 1), ("typescript", "function", JS_NAMED_FUNCTION, 1), ("typescript", "class", JS_CLASS, 2)]
    found = F.array(*[F.when((F.col("language") == lang) & F.col("line").rlike(p), F.struct(_group(p, g).alias("name"), F.lit(kind).alias("kind"))) for lang, kind, p, g in rules])
    rows = lines_of(files).select("path", "line_no", "line", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("s"))
    return rows.select("path", "s.name", "s.kind", "line_no", _trim(F.col("line")).alias("signature"))


def imports(files: DataFrame) -> DataFrame:
    """Path, imported_path."""
    return files.select("path", F.explode(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1))).alias("imported_path"))


def file_nodes(files: DataFrame) -> DataFrame:
    """X3."""
    return files.select(F.lit("file").alias("type"), T.basename(F.col("path")).alias("name"), F.col("path").alias("qualified_name"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"), T.line_count(F.col("content")).alias("end_line"), F.lit(0).alias("ordinal"), F.lit("").alias("signature"))


def class_type(kind: Column, name: Column, path: Column) -> Column:
    """The first rule that holds; only classes are told apart."""
    low = F.lower(path)
    rule = (
        F.when(name.endswith("Controller"), "service").when(name.endswith("Job"), "job").when(name.endswith("Command") | F.contains(low, F.lit("/console/commands/")), "command").when(name.endswith("Service"), "service")
        .when(F.contains(F.lower(name), F.lit("test")) | F.contains(low, F.lit("test")), "test").when(F.contains(path, F.lit("Models/")), "model").otherwise("class")
    )
    return F.when(kind == "class", rule).otherwise(kind)


def _carried(rows: DataFrame, name: str) -> DataFrame:
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(F.when(F.col(name) != "", F.col(name)), ignorenulls=True).over(w), F.lit("")))


def _node(type_: Column, name: Column, qualified: Column, ordinal: int) -> Column:
    return F.struct(type_.alias("type"), name.alias("name"), qualified.alias("qualified_name"), F.lit(ordinal).alias("ordinal"))


def _emit(rows: DataFrame, *nodes: Column) -> DataFrame:
    out = rows.select("path", "line_no", "line", F.explode(F.filter(F.array(*nodes), lambda x: x.isNotNull())).alias("n"))
    return out.select("n.type", "n.name", "n.qualified_name", F.col("path").alias("file_path"), F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), "n.ordinal", _trim(F.col("line")).alias("signature"))


def php_nodes(rows: DataFrame) -> DataFrame:
    """X4."""
    rows = _carried(rows.where("language = 'php'").withColumn("current", _group(PHP_CLASS, 2)), "current")
    fn = _group(PHP_FUNCTION, 1)
    return _emit(
        rows,
        F.when(F.col("line").rlike(PHP_CLASS), _node(class_type(_group(PHP_CLASS, 1), _group(PHP_CLASS, 2), F.col("path")), _group(PHP_CLASS, 2), _group(PHP_CLASS, 2), 1)),
        F.when(F.col("line").rlike(PHP_FUNCTION), _node(F.when(F.col("current") != "", "method").otherwise("function"), fn, F.when(F.col("current") != "", F.concat("current", F.lit("."), fn)).otherwise(fn), 2)),
    )


def go_nodes(rows: DataFrame) -> DataFrame:
    """X5; a method is named after the last word of its receiver."""
    rows = rows.where("language = 'go'")
    receiver = T.short_name(F.regexp_extract(F.translate(_group(GO_FUNCTION, 1), "*", " "), r"(\S+)\s*$", 1))
    fn, has = _group(GO_FUNCTION, 2), _group(GO_FUNCTION, 1) != ""
    return _emit(
        rows,
        F.when(F.col("line").rlike(GO_TYPE), _node(F.when(_group(GO_TYPE, 2) == "interface", "interface").otherwise("class"), _group(GO_TYPE, 1), _group(GO_TYPE, 1), 1)),
        F.when(F.col("line").rlike(GO_FUNCTION), _node(F.when(has, "method").otherwise("function"), fn, F.when(has, F.concat(receiver, F.lit("."), fn)).otherwise(fn), 2)),
    )


def js_nodes(rows: DataFrame) -> DataFrame:
    """X6; a line that declares a function is not tried as a method."""
    rows = _carried(rows.where("language IN ('javascript', 'typescript')").withColumn("current", _group(JS_CLASS, 2)), "current")
    method, fn = _group(JS_METHOD, 1), F.col("line").rlike(JS_FUNCTION)
    return _emit(
        rows,
        F.when(F.col("line").rlike(JS_CLASS), _node(F.when(_group(JS_CLASS, 1) == "interface", "interface").otherwise("class"), _group(JS_CLASS, 2), _group(JS_CLASS, 2), 1)),
        F.when(fn, _node(F.lit("function"), _group(JS_FUNCTION, 1), _group(JS_FUNCTION, 1), 2)),
        F.when(~fn & (F.col("current") != "") & (method != "") & ~method.isin(NO_CALLS), _node(F.lit("method"), method, F.concat("current", F.lit("."), method), 3)),
    )


def fallback_nodes(rows: DataFrame) -> DataFrame:
    """Other languages; the first function shape of a line."""
    rows = rows.where("language NOT IN ('php', 'go', 'javascript', 'typescript')")
    name = F.when(F.col("line").rlike(PHP_FUNCTION), _group(PHP_FUNCTION, 1)).when(F.col("line").rlike(JS_FUNCTION), _group(JS_FUNCTION, 1)).otherwise(_group(GO_FUNCTION, 2))
    return _emit(rows, F.when(name != "", _node(F.lit("function"), name, name, 1)))


def code_nodes(files: DataFrame) -> DataFrame:
    rows = lines_of(files)
    return php_nodes(rows).unionByName(go_nodes(rows)).unionByName(js_nodes(rows)).unionByName(fallback_nodes(rows))


def with_symbol(files: DataFrame) -> DataFrame:
    """Lines with the nearest symbol at or before them (W2, W3): the last one of the latest line that has any."""
    own = code_nodes(files).groupBy(F.col("file_path").alias("path"), F.col("start_line").alias("line_no")).agg(F.max_by("qualified_name", "ordinal").alias("symbol"))
    return _carried(lines_of(files).join(own, ["path", "line_no"], "left").withColumn("symbol", F.coalesce("symbol", F.lit(""))), "symbol")


def calls(files: DataFrame) -> DataFrame:
    """Path, from_name, to_name, line_no, raw."""
    both = F.arrays_zip(F.regexp_extract_all("line", F.lit(CALL), F.lit(1)).alias("a"), F.regexp_extract_all("line", F.lit(CALL), F.lit(2)).alias("b"))
    rows = with_symbol(files).select("path", "symbol", "line_no", "line", F.explode(both).alias("m"))
    rows = rows.withColumn("to_name", F.when(F.coalesce("m.b", F.lit("")) != "", F.col("m.b")).otherwise(F.col("m.a")))
    rows = rows.where(~F.col("to_name").isin(NO_CALLS) & (F.lower("to_name") != "function") & (F.col("to_name") != F.col("symbol")))
    return rows.select("path", F.col("symbol").alias("from_name"), "to_name", "line_no", _trim(F.col("line")).alias("raw"))


def routes(files: DataFrame) -> DataFrame:
    """Path, method, uri, controller, action, line_no, raw."""
    rows = lines_of(files.where(F.col("path").startswith("routes/") & F.col("path").endswith(".php")))
    one = lambda p: F.when(F.col("line").rlike(p), F.struct(F.upper(_group(p, 1)).alias("method"), _group(p, 2).alias("uri"), T.short_name(_group(p, 3)).alias("controller"), _group(p, 4).alias("action")))
    rows = rows.select("path", "line_no", "line", F.explode(F.filter(F.array(one(ROUTE_ARRAY), one(ROUTE_AT)), lambda x: x.isNotNull())).alias("r"))
    return rows.select("path", "r.*", "line_no", _trim(F.col("line")).alias("raw"))


def uses(files: DataFrame) -> DataFrame:
    """X9b and X4's extends and implements: path, from_name, to_name, type, line_no, raw."""
    every = lambda p, g=1: F.regexp_extract_all("line", F.lit(p), F.lit(g))
    tag = lambda names, kind: F.transform(names, lambda x: F.struct(x.alias("to_name"), F.lit(kind).alias("type")))
    jobs = F.zip_with(every(DISPATCH), every(DISPATCH, 2), lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(F.coalesce(b, F.lit(""))))
    found = F.concat(tag(every(MODEL), "uses"), tag(F.transform(every(CONTAINER), T.short_name), "depends_on"), tag(F.filter(jobs, lambda x: x != ""), "depends_on"))
    inner = with_symbol(files).select("path", F.col("symbol").alias("from_name"), "line_no", "line", F.explode(found).alias("u"))
    php = lines_of(files).where("language = 'php'").where(F.col("line").rlike(PHP_CLASS))
    parents = F.concat(
        tag(F.filter(F.array(T.short_name(_group(EXTENDS, 1))), lambda x: x != ""), "extends"),
        tag(F.transform(F.filter(F.split(_group(IMPLEMENTS, 1), ","), lambda x: F.trim(x) != ""), lambda x: T.short_name(F.trim(x))), "implements"),
    )
    outer = php.select("path", _group(PHP_CLASS, 2).alias("from_name"), "line_no", "line", F.explode(parents).alias("u"))
    return inner.unionByName(outer).select("path", "from_name", "u.to_name", "u.type", "line_no", _trim(F.col("line")).alias("raw"))


def role(path: Column, class_name: Column) -> Column:
    """X13."""
    low = F.lower(path)
    out = F.when(class_name != "", "PHP Class").otherwise("PHP")
    for (inside, start, end), name in reversed(ROLES):
        hit = F.lit(False)
        for word, test in ((inside, lambda w: F.contains(low, F.lit(w))), (start, low.startswith), (end, low.endswith)):
            hit = hit | test(word) if word else hit
        if name == "Test":
            hit = hit | F.lower(class_name).startswith("test")
        out = F.when(hit, name).otherwise(out)
    return out


def summaries(files: DataFrame, terms: list[str]) -> DataFrame:
    """Path, type, namespace, class_kind, class_name, purpose, methods (visibility, name, signature),
    matched_for."""
    c = F.col("content")
    php, go = F.col("language") == "php", F.col("language") == "go"
    kind = r"(?m)^\s*(?:abstract\s+|final\s+)?(class|interface|trait)\s+(\w+)"
    method = r"(?m)^\s*(public|protected|private)(?:\s+static)?\s+function\s+(\w+)(\s*\([^)]*\))(?:\s*:\s*([\w\\?|\[\]]+))?"
    func = r"(?m)^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(([^)]*)\)"
    every = lambda p, g: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    class_name = F.when(php, F.regexp_extract(c, kind, 2)).otherwise("")
    doc = F.regexp_extract(c, r"(?s)\A.*/\*\*(.*?)\*/(?:(?!/\*\*).)*?^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+\w+".replace("(?s)", "(?sm)"), 1)
    doc_lines = F.filter(F.transform(F.split(doc, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\*", ""))), lambda x: (x != "") & ~x.startswith("@"))
    purpose = F.array_join(doc_lines, " ")
    purpose = F.when(F.length(purpose) > 200, F.concat(F.substring(purpose, 1, 200), F.lit("..."))).otherwise(purpose)
    pub = lambda n: F.when(n.rlike("^[A-Z]"), "public").otherwise("private")
    shape = lambda v, n, s: F.struct(v.alias("visibility"), n.alias("name"), s.alias("signature"))
    php_methods = F.transform(F.arrays_zip(every(method, 1).alias("v"), every(method, 2).alias("n"), every(method, 3).alias("p"), every(method, 4).alias("r")), lambda m: shape(m["v"], m["n"], F.concat(m["n"], m["p"], F.when(F.coalesce(m["r"], F.lit("")) != "", F.concat(F.lit(": "), m["r"])).otherwise(""))))
    go_methods = F.transform(F.arrays_zip(every(func, 1).alias("n"), every(func, 2).alias("p")), lambda m: shape(pub(m["n"]), m["n"], F.concat(m["n"], F.lit("("), m["p"], F.lit(")"))))
    none = F.array().cast("array<struct<visibility:string,name:string,signature:string>>")
    return files.select(
        "path",
        F.when(php, role(F.col("path"), class_name)).when(go, "Go").otherwise("file").alias("type"),
        F.when(php, F.regexp_extract(c, r"(?m)^\s*namespace\s+([\w\\]+)\s*;", 1)).when(go, F.regexp_extract(c, r"(?m)^package\s+(\w+)", 1)).otherwise("").alias("namespace"),
        F.when(php, F.regexp_extract(c, kind, 1)).otherwise("").alias("class_kind"), class_name.alias("class_name"),
        F.when(php & (class_name != ""), purpose).otherwise("").alias("purpose"),
        F.when(php, php_methods).when(go, go_methods).otherwise(none).alias("methods"),
        F.transform(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(c), F.lower(t))), lambda t: F.concat(F.lit("contains "), t)).alias("matched_for"),
    )
