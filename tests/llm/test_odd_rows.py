"""Odd rows for every operator on documents or pages and every stage: nulls in any column, repeats, names that clash."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repolens.llm import decontaminate, jaccard, langid, mixing, omh, suffix, toxicity, units, warc

SF = "/root/testdata/sf0.001"
NAMES = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "key_ string, body_ string, id_ long, whole_ int, extra_ string, rest_ int, score string, kept_text string, n_removed string, marks_ int, node int, least_ int, c int, m_key int, z_ int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["lan", "mer", "tio", "sen", "qua"]) + str(r.randint(0, 10**6)) for _ in range(n))


TEXTS = [prose(1, 120), prose(2, 120), prose(3, 200_000), "", None, "x", prose(4, 4)]


def rows():
    whole = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    without = [(None, prose(1, 120), None, None, None)] * 2 + [(None, prose(9, 80), None, None, None), (None, None, None, None, None)]
    return whole + [whole[1]] * 2 + without


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame([(*r, *["odd"] * 2, 7, 1, "e", 1, "q", "k", "n", *[1] * 6) for r in rows()], f"{NAMES}, {CLASH}")
    return d.repartition(3).cache()


def test_repeat_removal(odd):
    for op in (units.unit_dedup, suffix.suffix_dedup):
        got = op(odd).collect()
        assert len(got) == len(rows())
        by = {(r.doc_id, r.n_bytes): r.n_removed for r in got}
        size = len(TEXTS[0])
        # a text that stands with an id and without: repeats are judged across both; rows without an id stand last
        assert by[None, size] == size and by[0, size] in (0, size) and by[None, 0] == by[3, 0] == by[4, 0] == 0
        assert by[1, len(TEXTS[1])] == by[2, len(TEXTS[2])] == by[None, len(prose(9, 80))] == 0
    assert by[0, size] == size


def test_components(odd):
    got = [tuple(r) for r in jaccard.jaccard_components(odd).collect()]
    assert len(got) == len(rows())
    assert got.count((None, 116, 0)) == 2 and (0, 116, 0) in got and got.count((1, 116, 1)) == 3
    assert (None, 76, None) in got and (None, 0, None) in got and (3, 0, 3) in got and (6, 1, 6) in got
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == [*[(False, i) for i in range(7)], (True, 0), (True, 0)]


def test_row_wise_operators(spark, odd):
    n = len(rows())
    assert omh.fingerprints(odd).count() == n
    mixed = mixing.systematic_copies(odd).collect()
    assert len(mixed) == n and sum(r.taken for r in mixed) > 0 and mixing.mix_documents(odd).columns == odd.columns
    scorer = toxicity.learn(odd, spark.createDataFrame([(None, 1), (0, None), (1, 0), (2, 1)], "doc_id long, toxic int"))
    assert toxicity.score(odd, scorer, keep=("key_",)).where("score BETWEEN 0 AND 1").count() == n
    tagger = langid.learn(odd, "text", "lang", "doc_id")
    assert langid.predict(odd, tagger, "doc_id", "text", ("c",)).where("lang_pred IN ('en', 'und')").count() == n


def test_leaks_without_ids(spark, odd):
    b = spark.createDataFrame([(5, prose(9, 80)[100:600]), (6, None), (None, None)], "item_id long, text string")
    got = decontaminate.contamination(odd, b).where("contaminated").collect()
    assert [(r.doc_id, r.item_ids) for r in got] == [(None, [5])]


def test_pages_without_ids_and_repeated_pages(spark, tmp_path):
    big = "<p>%s</p>" % prose(5, 9000)
    pages = [(3, "u", big), (3, "u", big), (2, "u", big), (None, None, big), (None, None, "small"), (None, None, "y" * 40_000), (4, None, None)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest_", F.lit(1))
    (tmp_path / "sf").mkdir()
    d.write.parquet(str(tmp_path / "sf" / "pages.parquet"))
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem) for r in warc.op5_warc(spark, str(tmp_path / "sf")).collect()), key=repr)
    sha = lambda t: (len(t or ""), hashlib.sha1((t or "").encode()).hexdigest())
    want = [(i or 0, *sha(t), *(("revisit", 3) if t == big and i != 3 else ("response", None)), None) for i, _, t in pages]
    assert got == sorted(want, key=repr)


def test_stages_keep_columns_and_clean_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema], name
        got = [(r.doc_id, r.text) for r in out.collect()]
        if name != "source_mixing":
            assert (2, TEXTS[2]) in got and (1, TEXTS[1]) in got and (None, prose(9, 80)) in got and (4, None) in got, name
        assert stage(spark, odd.where("false"), SF).count() == 0, name
