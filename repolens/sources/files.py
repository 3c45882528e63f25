"""Sources: directory trees and document tables as `files`, ignore rules, languages, snapshot diffs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Default ignore patterns, size limit, languages by extension.
IGNORED = [
    ".git", "node_modules", "vendor", "dist", "build", ".next", ".nuxt", ".cache", "coverage", "storage/logs", ".env",
    "*.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "composer.lock", "*.min.js", "*.map", "*.png",
    "*.jpg", "*.jpeg", "*.gif", "*.webp", "*.svg", "*.pdf", "*.zip", "*.tar", "*.gz",
]
MAX_FILE_BYTES = 1_500_000
LANGUAGES = {
    "php": "php", "js": "javascript", "ts": "typescript", "tsx": "typescriptreact", "jsx": "javascriptreact",
    "go": "go", "py": "python", "md": "markdown", "json": "json", "yml": "yaml", "yaml": "yaml", "env": "env",
}
OUTPUT_LANGUAGES = {
    "go": "go", "php": "php", "js": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescriptreact",
    "jsx": "javascriptreact",
}


def gitignore_patterns(text: str) -> list[str]:
    """Lines of a .gitignore that count: neither blank nor comment nor negation, outer slashes trimmed."""
    kept = (line.strip() for line in text.split("\n"))
    return [x.strip("/") for x in kept if x and x[0] not in "#!"]


def _glob(pattern: str) -> str:
    out = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern)
    return f"^{out}$"


def ignored(path: Column, patterns: list[str] = IGNORED) -> Column:
    """S2 with pruning: a path is out if any of its ancestors or the path itself is ignored. Globs match base names."""
    plain = [p for p in patterns if p and "*" not in p]
    globs = [_glob(p) for p in patterns if "*" in p and "/" not in p]
    parts = F.split(path, "/")
    by_name = F.exists(parts, lambda x: x.isin([p for p in plain if "/" not in p]) | (x.rlike("|".join(globs)) if globs else F.lit(False)))
    for p in (p for p in plain if "/" in p):
        by_name = by_name | (path == p) | path.startswith(p + "/")
    return by_name


def _language(path: Column, table: dict[str, str]) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    out = F.lit("")
    for name, lang in table.items():
        out = F.when(ext == name, lang).otherwise(out)
    return out


def language_of(path: Column) -> Column:
    """S3: '' means not indexed."""
    return _language(path, LANGUAGES)


def output_language(path: Column) -> Column:
    """S3b."""
    return _language(path, OUTPUT_LANGUAGES)


def admitted(path: Column, size: Column, patterns: list[str] = IGNORED) -> Column:
    """Whether path and size let a file in."""
    return (size <= MAX_FILE_BYTES) & ~ignored(path, patterns) & (language_of(path) != "")


def root_patterns(spark: SparkSession, root: str) -> list[str]:
    """The patterns of the .gitignore in root, if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    stream = fs.open(path)  # Spark's readers pass over names that begin with a dot
    try:
        return gitignore_patterns(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


#: Kept paths are named to the second scan in groups of so many.
PATHS_AT_ONCE = 20_000


def scan_directory(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """Files below root; default patterns and those of the root's .gitignore. The first scan lists paths and sizes
    without content; the second reads the kept paths only, as long as they are few enough to be named one by one."""
    patterns = [*IGNORED, *root_patterns(spark, root)] if patterns is None else patterns
    scan = lambda *paths: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")) + "/", "")
    fits = admitted(F.col("rel"), F.col("length"), patterns)
    kept = scan(root).select("path", "length", rel.alias("rel")).where(fits).select("path").limit(PATHS_AT_ONCE + 1).collect()
    raw = scan(*[r.path for r in kept]) if 0 < len(kept) <= PATHS_AT_ONCE else scan(root)
    raw = raw.withColumn("rel", rel).where(fits).withColumn("language", language_of(F.col("rel")))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return raw.withColumn("text", text).where(F.col("text").isNotNull() & (F.instr("text", "\0") == 0)).select(
        F.col("rel").alias("path"), "language", F.col("length").alias("size_bytes"), F.date_trunc("second", "modificationTime").alias("mtime"), F.sha2(F.col("content"), 256).alias("hash"), F.col("text").alias("content")
    )


def document_files(documents: DataFrame) -> DataFrame:
    """A document table as files: project = source, path = source/lang/doc_<id>.md; a null id is written `none`, so
    that no path is null."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.col("doc_id").alias("file_id"), F.coalesce("source", F.lit("")).alias("project"),
        F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/doc_"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".md")).alias("path"),
        F.coalesce("lang", F.lit("")).alias("language"), F.octet_length(text).cast("long").alias("size_bytes"), text.alias("content"),
    )


def incremental_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """Path, action. old and new: path, mtime, hash. Unlike a walk that only upserts, vanished files are deleted."""
    o = old.select(F.col("path").alias("p0"), F.col("mtime").alias("m0"), F.col("hash").alias("h0"))
    action = (
        F.when(F.col("p0").isNull(), "add").when(F.col("path").isNull(), "delete").when(F.col("mtime") == F.col("m0"), "skip").when(F.col("hash") == F.col("h0"), "touch").otherwise("reindex")
    )
    return new.join(o, F.col("path") == F.col("p0"), "full_outer").select(F.coalesce("path", "p0").alias("path"), action.alias("action"))


def longest_prefix(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """The project whose root is the longest ancestor of each path. A path is joined to roots by equality with
    each of its prefixes, not by a range."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    p = paths.select("path", F.explode(prefixes).alias("root_path")).join(projects, "root_path")
    w = Window.partitionBy("path").orderBy(F.length("root_path").desc(), "name")
    return p.withColumn("n_", F.row_number().over(w)).where("n_ = 1").select("path", "name", "root_path")


def stale(files: DataFrame, built: Column) -> DataFrame:
    """one row, the files that changed after the graph was built; all of them if it never was."""
    return files.where(built.isNull() | (F.col("mtime") > built)).agg(F.count(F.lit(1)).alias("stale"))


def project_named(projects: DataFrame, name: str) -> DataFrame:
    """The project of that name; an error if there is none."""
    found = projects.where(F.col("name") == name).limit(1)
    if found.isEmpty():
        raise KeyError(f"no project: {name}")
    return found


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K1, K2: rows of new replace those of old with equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
