"""Operator 9: chat formatting with typed content parts, in DataFrame functions only.

A message is an ordered array of parts (type, text, uri, amount). Text parts are escaped; image, audio and document
parts become numbered placeholders, with an attachment entry (kind, uri, place, tokens) for each, in order. Turns are
joined under one template:

    #<role>: <body></turn>\\n

The template's control characters are '#', '<' and the escape '\\'. Inside roles and texts they are written \\h, \\l
and \\b, so no text can open, close or forge a turn or a placeholder, and every text comes back unchanged.

Defined cases: null text is empty; a null role is the empty role; turns are ordered by turn (null first), then role,
then text, so ties and repeated rows have one order; an empty table formats to nothing; unknown part types are kept
as text if they have one and as a `file` attachment if not; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

END = "</turn>\n"
#: Tokens an attachment counts for: tokens per unit of `amount` (pixels, seconds, pages) and the least.
EXPANSION = {"image": (1.0 / 784.0, 1), "audio": (25.0, 1), "document": (512.0, 1)}
PART = "struct<type:string,text:string,uri:string,amount:double>"


def escape(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def flatten_parts(parts: Column, first: Column | int = 0) -> Column:
    """Visit an array of PART in order: struct(body, attachments, tokens). Placeholders are numbered from first."""
    first = F.lit(first) if isinstance(first, int) else first
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")).isin("text") | (~p["type"].isin(*EXPANSION) & p["text"].isNotNull())
    kind = lambda p: F.when(p["type"].isin(*EXPANSION), p["type"]).otherwise(F.lit("file"))

    def tokens(p: Column) -> Column:
        out = F.lit(1)
        for name, (rate, least) in EXPANSION.items():
            out = F.when(p["type"] == name, F.greatest(F.ceil(F.coalesce(p["amount"], F.lit(0.0)) * rate), F.lit(least)).cast("int")).otherwise(out)
        return out

    def visit(parts: Column) -> Column:
        files = F.filter(parts, lambda p: ~is_text(p))
        attachments = F.transform(files, lambda p, i: F.struct(kind(p).alias("kind"), p["uri"].alias("uri"), (i + first).cast("int").alias("place"), tokens(p).alias("tokens")))
        # the place of a placeholder is the number of attachments before its part
        body = F.aggregate(
            parts,
            F.struct(F.lit("").alias("body"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(
                F.concat(acc["body"], F.when(is_text(p), escape(p["text"])).otherwise(F.concat(F.lit("<"), kind(p), F.lit(" "), (acc["n"] + first).cast("string"), F.lit(">")))).alias("body"),
                (acc["n"] + F.when(is_text(p), 0).otherwise(1)).alias("n"),
            ),
            lambda acc: acc["body"],
        )
        spread = F.aggregate(attachments, F.lit(0), lambda n, a: n + a["tokens"])
        return F.struct(body.alias("body"), attachments.alias("attachments"), spread.alias("attachment_tokens"))

    return let(parts, visit)


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("double").alias("amount")))


def format_conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """conv, formatted, attachments (array), attachment_tokens, loss_spans (start and length in code points of each
    assistant body in formatted)."""
    m = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), flatten_parts(F.col(parts)).alias("flat"))
    m = m.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("flat.body").alias("body"), F.col("flat.attachments").alias("attachments"), F.col("flat.attachment_tokens").alias("tokens")))).alias("turns"))
    head = lambda t: F.concat(F.lit("#"), escape(t["role"]), F.lit(": "))
    m = m.withColumn("pieces", F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["body"].alias("body"), (t["role"] == "assistant").alias("loss"))))
    lengths = F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END))
    m = m.withColumn("lengths", lengths)
    # starts by a running sum; the fold keeps (spans so far, place)
    spans = F.aggregate(
        F.arrays_zip("pieces", "lengths"),
        F.struct(F.array().cast("array<struct<start:int,length:int>>").alias("spans"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.when(x["pieces"]["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["pieces"]["head"])).alias("start"), F.length(x["pieces"]["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
            (acc["at"] + x["lengths"]).alias("at"),
        ),
        lambda acc: acc["spans"],
    )
    return m.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("turns", F.lit(0), lambda n, t: n + t["tokens"]).alias("attachment_tokens"),
        spans.alias("loss_spans"),
    )


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, turns (array of role, text) parsed from the formatted text alone, and loss_text: the unescaped text under
    the loss mask, cut out of formatted by its spans."""
    # '#' and '<' never stand inside a body, but for placeholders, which never equal END
    raw = F.split("formatted", END)
    turns = F.transform(F.slice(raw, 1, F.size(raw) - 1), lambda t: F.struct(unescape(F.regexp_extract(t, r"(?s)\A#(.*?): ", 1)).alias("role"), unescape(F.regexp_replace(t, r"(?s)\A#.*?: ", "")).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.select(conv, "formatted", turns.alias("turns"), loss.alias("loss_text"))


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    back = read_back(format_conversations(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h'))
    + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h')) + 11 AS n,
    replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS body
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
