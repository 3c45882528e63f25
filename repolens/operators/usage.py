"""Usage facts: filter, savings, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_facts(events: DataFrame) -> DataFrame:
    """Events as usage facts."""
    return events.select(
        F.col("event_id").alias("usage_id"), F.col("event_type").alias("tool"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("project"),
        F.date_trunc("second", "ts").alias("called_at"), F.ceil(F.col("value") * 4).cast("long").alias("tokens_without"), F.floor("value").cast("long").alias("tokens_actual"),
    )


def usage_filter(usage: DataFrame, tool: str | None = None, project: str | None = None, since: str | None = None, until: str | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """F1 with F2's day bounds: until counts to the last second of its day. Conditions that are not given don't count."""
    c = {
        "tool": tool and (F.col("tool") == tool), "project": project and (F.col("project") == project),
        "since": since and (F.col("called_at") >= F.lit(since).cast("timestamp")), "until": until and (F.col("called_at") < F.lit(until).cast("timestamp") + F.expr("INTERVAL 1 DAY")),
        "least": least and (F.col("tokens_actual") >= least), "most": most and (F.col("tokens_actual") <= most),
    }
    for condition in c.values():
        if condition is not None and not isinstance(condition, (str, int)):
            usage = usage.where(condition)
    return usage


def savings(usage: DataFrame) -> DataFrame:
    saved = F.col("tokens_without") - F.col("tokens_actual")
    return usage.select("*", saved.alias("saved"), F.round(F.when(F.col("tokens_without") > 0, saved * 100.0 / F.col("tokens_without")).otherwise(0.0), 6).alias("saved_pct"))


def totals(usage: DataFrame) -> DataFrame:
    """A row a tool and one over all (tool null), in one pass by grouping sets."""
    g = usage.rollup("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_without").alias("tokens_without"), F.sum("tokens_actual").alias("tokens_actual"))
    return savings(g)


def token_accounting(results: DataFrame, files: DataFrame, actual: int) -> DataFrame:
    """A10: what reading the found files whole would have cost, against the answer."""
    whole = files.join(results.select("path").distinct(), "path", "left_semi").agg(F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens_without"))
    return whole.withColumn("tokens_actual", F.lit(actual).cast("long"))
