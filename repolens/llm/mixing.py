"""Operator 7: mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same expected number of copies (target / source size). Documents are
ordered by size class, a spreading key, size and id; prefix sums of the expected copies plus one offset per
source cross an integer once for each copy emitted. As neighbours have like sizes, the words taken stay close
to the target.

Prefix sums are made in two levels: documents are counted in cells (source, size class, spread), cells are summed within
their source, and documents are numbered within their cell only. Keys are spread over `SPREAD` cells at least, more for
larger tables. No task holds a whole source. Cells are written down, and so are the short rows (key, source, size) where
no more columns are asked for, so words are counted once (twice with more columns).

Defined cases: a null or blank text has size 0 and is never counted as words (it may get copies, which take 0);
a null source is a source of its own, last in order; repeated rows are numbered one by one; an empty table gives
no rows; clashing extra columns are kept (the operator's own names are taken from the parameters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Cells of a source and size class at least, and the documents for which the whole table gets one more.
SPREAD, CELL_ROWS = 16, 50_000
_PRIME = 1_000_003


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> also source_rank, weight, target. Sources stand in code point order, null last, and
    weigh the cycle of weights. Where shares would exceed most * size, the excess goes to the others by weight
    until none is above: the level x with sum(min(most * size, x * weight)) = share * total, found from the
    sources sorted by most * size / weight. One row a source goes into the two windows here, not the documents."""
    by_code = Window.orderBy(F.col("source").isNull(), "source")
    full = Window.orderBy("cap_level", "source_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    out = sizes.withColumn("source_rank", F.row_number().over(by_code) - 1).withColumn("weight", w)
    out = out.withColumn("cap_level", F.col("source_size") * F.lit(float(most)) / F.col("weight"))
    out = out.withColumns({
        "total": F.sum("source_size").over(every) * F.lit(float(share)),
        "weights": F.sum("weight").over(every),
        "size_below": F.sum("source_size").over(full) - F.col("source_size"),
        "weight_below": F.sum("weight").over(full) - F.col("weight"),
    })
    level = (F.col("total") - F.col("size_below") * F.lit(float(most))) / (F.col("weights") - F.col("weight_below"))
    out = out.withColumn("level", level).withColumn("open", F.col("cap_level") > F.col("level"))
    out = out.withColumn("first_level", F.min(F.when(F.col("open"), F.struct("cap_level", "source_rank", "level"))).over(every)["level"])
    target = F.when(
        F.col("first_level").isNull() | (F.col("cap_level") <= F.col("first_level")), F.col("source_size") * F.lit(float(most))
    ).otherwise(F.col("first_level") * F.col("weight"))
    return out.select("source", "source_size", "source_rank", "weight", target.alias("target"))


def size_class(size: Column) -> Column:
    """Eight classes an octave, in order of size."""
    bits = F.length(F.bin(size))
    return bits * 8 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0))).bitwiseAND(7).cast("int")


def systematic_copies(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, size, source_size, target, copies, taken for each row of docs, with the columns in keep under their names."""
    spread = max(SPREAD, -(-docs.count() // CELL_ROWS))
    d = docs.select(
        F.col(key).alias("m_key"), F.col(source).alias("source"), word_count(F.col(text)).alias("m_size"), *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)]
    ).withColumns({"m_class": size_class(F.col("m_size")), "m_spread": F.pmod(F.pmod(F.coalesce("m_key", F.lit(0)), F.lit(_PRIME)), F.lit(spread)).cast("int")})
    d = d if keep else materialise(d, "mix-sizes")  # short rows, unless more columns are asked for
    cell = ["source", "m_class", "m_spread"]
    cells = materialise(d.groupBy(*cell).agg(F.count(F.lit(1)).alias("m_rows"), F.sum("m_size").alias("m_words")), "mix-cells")
    sizes = cells.groupBy("source").agg(F.sum("m_words").alias("source_size"))
    before = Window.partitionBy("source").orderBy("m_class", "m_spread").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("m_before", F.coalesce(F.sum("m_rows").over(before), F.lit(0))).drop("m_rows", "m_words")
    goals = targets(sizes, weights, share, most)
    # joins on null-safe keys: a null source is a source
    known = offsets.join(goals.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    known = known.select(*[F.col(c).alias(f"o_{c}") for c in cell], "m_before", "source_size", "source_rank", "target")
    inner = Window.partitionBy(*cell).orderBy("m_size", "m_key")
    d = d.withColumn("m_row", F.row_number().over(inner))
    on = F.col("source").eqNullSafe(F.col("o_source")) & (F.col("m_class") == F.col("o_m_class")) & (F.col("m_spread") == F.col("o_m_spread"))
    d = d.join(known, on)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    offset = F.pmod(F.lit(float(seed)) + F.col("source_rank") * F.lit(0.6180339887498949), F.lit(1.0))
    at = (F.col("m_before") + F.col("m_row")).cast("double")
    copies = (F.floor(rate * at + offset) - F.floor(rate * (at - 1) + offset)).cast("long")
    return d.select(
        F.col("m_key").alias(key), F.col("m_size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("m_size")).alias("taken"),
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)],
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as its copies."""
    columns = docs.columns
    own = docs.select(F.struct(*columns).alias("m_whole"), F.col(options.get("key", "doc_id")).alias("doc_id"), F.col(options.get("source", "source")).alias("source"), F.col(options.get("text", "text")).alias("text"))
    options = {k: v for k, v in options.items() if k not in ("key", "source", "text")}
    out = systematic_copies(own, keep=("m_whole",), **options)
    return out.where("copies > 0").select("m_whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("m_copy")).select("m_whole.*")


def op7_systematic_mix(spark, sf_dir: str) -> DataFrame:
    return systematic_copies(table(spark, sf_dir, "documents")).drop("copies")


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), c AS (
  SELECT *, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) AS class, ((coalesce(doc_id, 0) % {_PRIME}) + {_PRIME}) % {_PRIME} % (SELECT greatest({SPREAD}, (count(*) + {CELL_ROWS - 1}) // {CELL_ROWS}) FROM documents) AS spread FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS source_rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE source_rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), l AS (
  SELECT *, source_size * 2.0::DOUBLE / weight AS cap_level FROM w
), m AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
    - CAST(sum(source_size) OVER f - source_size AS DOUBLE) * 2.0::DOUBLE) / (sum(weight) OVER () - (sum(weight) OVER f - weight)) AS level
  FROM l WINDOW f AS (ORDER BY cap_level, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), t AS (
  SELECT source, source_size, source_rank,
    CASE WHEN first_level IS NULL OR cap_level <= first_level THEN source_size * 2.0::DOUBLE ELSE first_level * weight END AS target
  FROM (SELECT *, arg_min(level, cap_level * 1e6::DOUBLE + source_rank) FILTER (cap_level > level) OVER () AS first_level FROM m)
), n AS (
  SELECT c.*, source_size, target, source_rank,
    CAST(row_number() OVER (PARTITION BY c.source ORDER BY class, spread, size, doc_id) AS DOUBLE) AS place,
    CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(floor(rate * place + u) - floor(rate * (place - 1) + u) AS BIGINT) * size AS taken
FROM (SELECT *, (0.5::DOUBLE + source_rank * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS u FROM n)
"""
