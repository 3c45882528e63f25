"""The corpus pipeline: the stages of a training-data clean-up, each over all rows that the last one kept.

Every stage but the last returns the columns of its input, whatever their names, and an empty table for an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm import decontaminate, jaccard, mixing, suffix, toxicity
from repolens.llm.common import ROW_KEY, materialise, row_key


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a toxicity score under the cut. Labels held out in op3 are not learned from here either.

    Null and empty texts get the score of a text without any voter and stay; rows without an id are scored like others;
    texts of any length are scored whole; repeated rows have equal scores, so all stay or all go."""
    labels = _table(spark, sf_dir, "labels").where(~toxicity.held_out())
    scorer = toxicity.learn(docs.where(~toxicity.held_out()), labels)
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole_"))
    return toxicity.score(rows, scorer, keep=("whole_",)).where(F.col("score") < toxicity.CUT).select("whole_.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the least id stays.

    Rows without an id stand last; of rows of one id and different texts in a component, the one of least text hash stays.
    Repeated rows (equal id and text) are one document and one row stays. Null and empty texts are near copies of none:
    a row of each id stays. Texts of any length are compared whole."""
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 that also start elsewhere go; documents of which only white space is left go, too.
    Documents that lose nothing stay as they are, null and empty texts included. Strings are judged on the stage's input:
    of two texts that are equal from end to end, both go, as the stage before keeps one of them. Repeated rows (equal id
    and text) are one document and repeat nothing of each other; rows without an id are cut like others; of very long
    texts, every byte is looked at; n_chars, if there, follows the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("blank_"), F.struct(F.lit(0), *rest).alias("rest_")).alias("extra_"))
    out = suffix.suffix_dedup(rows, with_text=True, keep=("extra_",))
    out = out.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    made = {c: F.col("extra_")["rest_"][c] for c in rest} | {"doc_id": F.col("doc_id"), "text": F.when(~F.col("extra_")["blank_"], F.col("kept_text"))}
    if "n_chars" in rest:
        made["n_chars"] = F.when(F.col("n_removed") == 0, made["n_chars"]).otherwise(F.length("kept_text").cast("long"))
    return out.select(*[made[c].alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, at whatever place of a text of any length. Null and empty texts hold none
    and stay; repeated rows go or stay together; rows of one id and different texts, and rows without an id, are judged
    each by their text; an empty benchmark lets all stay."""
    found = decontaminate.leaks(docs, _table(spark, sf_dir, "benchmark")).select(*ROW_KEY).distinct()
    rows = docs.select(*row_key("doc_id", "text"), F.struct(*docs.columns).alias("whole_"))
    return rows.join(found, list(ROW_KEY), "left_anti").select("whole_.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks for, at most twice. A null source is a source of its
    own, last in order; null and empty texts have no words, so they may come or not without effect on the targets; repeated
    rows, and rows of equal id, are drawn one by one; order among equal sizes is by id."""
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
]

#: Neither a trained classifier nor latent retrieval can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again, as a stage's input is read more than once."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
