"""Column functions on text: lines, chunks, tokens, estimates, query terms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and word lists that results depend on.
MAX_LINES, MAX_BYTES = 160, 18_000
SYNONYMS = {
    "payment": ["paid", "transaction", "wallet", "invoice", "billing", "balance"],
    "checkout": ["check_out", "departure", "end_date"],
    "anomaly": ["issue", "ticket", "missing", "unresolved", "not_done"],
    "sync": ["synchronize", "import", "fetch", "pull", "push"],
}
#: Letters with marks and what full-text tokens fold them to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüý"
PLAIN = "aaaaaaceeeeiiiinooooouuuuy"


def lines(text: Column) -> Column:
    """All lines; a trailing newline gives a last empty one."""
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    """0 for empty text."""
    return F.when(text == "", 0).otherwise(F.size(lines(text)))


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, 1 at least for any text."""
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def chunk_starts(text_lines: Column, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> Column:
    """First lines (from 1) of the chunks: a chunk takes lines while it has under max_lines and its lines so far, with
    their ends, hold under max_bytes; the last line may overshoot. Only starts are gathered in the fold."""
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"), F.lit(max_lines).alias("n"), F.lit(0).cast("long").alias("b"))

    def step(acc: Column, line: Column) -> Column:
        new = (acc["n"] >= max_lines) | (acc["b"] >= max_bytes)
        cost = (F.octet_length(line) + 1).cast("long")
        return F.struct(
            F.when(new, F.concat(acc["starts"], F.array(acc["at"] + 1))).otherwise(acc["starts"]).alias("starts"),
            (acc["at"] + 1).alias("at"),
            F.when(new, 1).otherwise(acc["n"] + 1).alias("n"),
            F.when(new, cost).otherwise(acc["b"] + cost).alias("b"),
        )

    return F.aggregate(text_lines, zero, step, lambda acc: acc["starts"])


def chunks(text: Column, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> Column:
    """Array of (start_line, end_line, content)."""
    def cut(ls: Column) -> Column:
        starts = chunk_starts(ls, max_lines, max_bytes)
        return F.element_at(
            F.transform(
                F.array(starts),
                lambda s: F.transform(
                    s,
                    lambda a, i: F.struct(
                        a.alias("start_line"),
                        (F.coalesce(F.get(s, i + 1), F.size(ls) + 1) - 1).alias("end_line"),
                        F.array_join(F.slice(ls, a, F.coalesce(F.get(s, i + 1), F.size(ls) + 1) - a), "\n").alias("content"),
                    ),
                ),
            ),
            1,
        )

    return F.element_at(F.transform(F.array(lines(text)), cut), 1)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case, without marks."""
    return F.regexp_extract_all(F.translate(F.lower(text), MARKED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: str, synonyms: dict[str, list[str]] = SYNONYMS) -> list[str]:
    """Lower-case ASCII words of two characters or more, first seen first, each followed by its synonyms."""
    out: dict[str, None] = {}
    for word in re.findall(r"[a-z0-9_]+", query.lower()):
        if len(word) > 1:
            for term in (word, *synonyms.get(word, ())):
                out.setdefault(term)
    return list(out)


def terms_of(query: Column, synonyms: dict[str, list[str]] = SYNONYMS) -> Column:
    """query_terms for a column of queries."""
    words = F.filter(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: F.length(w) > 1)
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))))


def phrase(term: str) -> list[str]:
    """The adjacent tokens a term stands for; none for a term of underscores only."""
    return [x for x in term.split("_") if x]


def basename(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(-1))


def first_lines(text: Column, n: int) -> Column:
    """C14."""
    return F.array_join(F.slice(lines(text), 1, n), "\n")


def trim_snippet(text: Column, max_lines: int) -> Column:
    """At most max_lines lines, then max(800, 80 * max_lines) code points, each cut marked by '...'."""
    ls = lines(text)
    cut = F.when(F.size(ls) > max_lines, F.concat(F.array_join(F.slice(ls, 1, max_lines), "\n"), F.lit("\n..."))).otherwise(text)
    most = max(800, 80 * max_lines)
    return F.when(F.length(cut) > most, F.concat(F.substring(cut, 1, most), F.lit("\n..."))).otherwise(cut)


def short_name(name: Column) -> Column:
    """C11: after the last backslash, else after the last dot."""
    trimmed = F.trim(F.regexp_replace(name, r"^\\+|\\+$", ""))
    return F.when(F.instr(trimmed, "\\") > 0, F.regexp_extract(trimmed, r"([^\\]*)$", 1)).otherwise(F.regexp_extract(trimmed, r"([^.]*)$", 1))
