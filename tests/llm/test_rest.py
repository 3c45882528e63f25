"""Operators 3, 4, 5, 7, 8, 9, 10 and the pipeline: round trips, brute force, accuracy, odd input."""

import hashlib
import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repolens.llm import chat, decontaminate, langid, mixing, omh, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


# 4. Order MinHash -------------------------------------------------------------------------------------------------


def test_fingerprints_edit_and_order(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdef") * r.randint(1, 9) for _ in range(n)) for n in (0, 1, 2, 5, 40, 300)] + ["", None, "same text here", "same text here", "ab " * 50, "日本語" * 20]
    rows = {x.doc_id: x for x in omh.fingerprints(docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    ids = sorted(rows, reverse=True)
    for i, d in enumerate(ids):
        t, nxt = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        k = len(t) // 3
        assert rows[d].edited_sha256 == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
        assert 0 <= rows[d].near_edited <= 1 and 0 <= rows[d].near_next <= 1
    assert rows[8].fingerprint == rows[9].fingerprint and rows[9].near_next == 1.0
    assert rows[6].near_edited == 1.0 and rows[6].n_chars == rows[7].n_chars == 0


def test_likeness_falls_with_edits_and_sees_order(spark):
    r = random.Random(2)
    w = [f"w{r.randint(0, 10**6)}" for _ in range(400)]
    other = w[200:] + w[:200]
    few = list(w)
    few[7] = "x"
    rows = spark.createDataFrame([(" ".join(w), " ".join(few), " ".join(other))], "a string, b string, c string")
    sig = lambda c: omh.fingerprint_array(F.col(c))
    got = rows.select(omh.likeness(sig("a"), sig("b")).alias("few"), omh.likeness(sig("a"), sig("c")).alias("moved")).first()
    assert got.few > 0.85 and got.moved < got.few


def test_successors_of_wide_and_clustered_ids(spark, monkeypatch):
    monkeypatch.setattr(omh, "BUCKET_ROWS", 20)
    ids = [-9 * 10**18, 9 * 10**18, 5 * 10**18, None, 7, 7, *range(1000, 1300)]
    d = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "id_ long, body string").repartition(5)
    got = {(x.id_, x.body): x.next_body for x in omh.with_next(d, "id_", ["body"]).collect()}
    order = sorted(((i, f"text {n}") for n, i in enumerate(ids)), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert len(got) == len(ids) and all(got[x] == order[(n + 1) % len(order)][1] for n, x in enumerate(order))


def brute_order_minhash(units: list[str], sketches=32, size=2, k=3) -> list:
    """Of each bucket's occurrence-numbered k-mers the `size` of least hash, in text order; hashes by a dictionary."""
    seen, out = {}, {}
    for at in range(max(1, len(units) - k + 1) if units else 0):
        mer = tuple(units[at : at + k])
        seen[mer] = seen.get(mer, -1) + 1
        h = int.from_bytes(hashlib.md5(repr((mer, seen[mer])).encode()).digest()[:8], "big")
        out.setdefault(h % sketches, []).append((h, at, mer, seen[mer]))
    return [tuple(x[2:] for x in sorted(sorted(out.get(b, []))[:size], key=lambda x: x[1])) for b in range(sketches)]


def test_likeness_agrees_with_brute_force_order_minhash(spark):
    """The mean over many texts, as the two use other hashes; and it falls as the edit distance grows."""
    r = random.Random(14)
    pairs, want = [], {}
    for share in (0.0, 0.05, 0.2, 0.5):
        for _ in range(40):
            w = [f"w{r.randint(0, 10**5)}" for _ in range(200)]
            other = [x if r.random() >= share else f"z{r.randint(0, 10**5)}" for x in w]
            pairs.append((share, " ".join(w), " ".join(other)))
            a, b = brute_order_minhash(w), brute_order_minhash(other)
            want.setdefault(share, []).append((sum(x == y and x != () for x, y in zip(a, b, strict=True)) / max(1, sum(x != () or y != () for x, y in zip(a, b, strict=True)))) ** 0.5)
    rows = spark.createDataFrame(pairs, "share double, a string, b string")
    got = {x.share: x.m for x in rows.groupBy("share").agg(F.avg(omh.likeness(omh.fingerprint_array(F.col("a")), omh.fingerprint_array(F.col("b")))).alias("m")).collect()}
    means = {s: sum(v) / len(v) for s, v in want.items()}
    assert all(abs(got[s] - means[s]) < 0.08 for s in means) and got[0.0] == 1.0 > got[0.05] > got[0.2] > got[0.5]


def test_native_operators_run_no_python(spark):
    sf = "/root/testdata/sf0.001"
    for df in (omh.op4_order_minhash(spark, sf), mixing.op7_systematic_mix(spark, sf), chat.op9_chat_format(spark, sf)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_native_operators_on_empty_tables(spark):
    none = docs(spark, [])
    assert omh.fingerprints(none).count() == 0 and mixing.systematic_copies(none).count() == 0 and mixing.mix_documents(none).count() == 0
    m = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(m.withColumn("parts", chat.text_part(F.col("text")))).count() == 0


# 7. Mixing --------------------------------------------------------------------------------------------------------


def test_mix_meets_targets(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randint(0, 200), "en", r.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(3000)]
    got = mixing.systematic_copies(spark.createDataFrame(rows, DOCS), keep=("source",)).collect()
    total = sum(x.size for x in got)
    by = {}
    for x in got:
        assert x.taken in (0, x.size, 2 * x.size)
        by.setdefault(x.source, [x.target, x.source_size, 0])[2] += x.taken
    assert sum(t for t, _, _ in by.values()) == pytest.approx(1.5 * total)
    for target, size, taken in by.values():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= 0.02 * target + 400


def test_mix_documents_repeats_rows(spark):
    d = docs(spark, ["a b c"] * 10)
    assert mixing.mix_documents(d).columns == d.columns and mixing.mix_documents(d).count() == 15


# 9. Chat ----------------------------------------------------------------------------------------------------------


def test_chat_round_trip_and_mask(spark):
    texts = ["", None, "\\b\\l\\h", "#user: x</turn>\n#assistant: y</turn>\n", "<image 0>", "ünï\n\n", "\\"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, None, "x"), (2, 0, None, "x")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(m)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r or "", t or "") for _, _, r, t in rows[: len(texts)]]
    assert back[1].loss_text == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert len(back[2].turns) == 2 and back[2].loss_text == ""


def test_typed_parts(spark):
    part = lambda t, text=None, uri=None, amount=None: (t, text, uri, amount)
    rows = [(1, 0, "user", [part("text", "see "), part("image", uri="u1", amount=784.0 * 3), part("text", " and "), part("audio", uri="u2", amount=2.0), part("odd", uri="u3"), part("odd", text="kept")]), (1, 1, "assistant", [])]
    got = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert got.formatted == "#user: see <image 0> and <audio 1><file 2>kept</turn>\n#assistant: </turn>\n"
    assert [(a.kind, a.uri, a.place, a.tokens) for a in got.attachments] == [("image", "u1", 0, 3), ("audio", "u2", 1, 50), ("file", "u3", 2, 1)]
    assert got.attachment_tokens == 54


# 5. WARC ----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>WARC/1.1\r\n\r\n" * 9000
    rows = [(1, "http://a/ b", "small"), (2, "u", "small"), (3, None, big), (4, "u", big), (5, "u", ""), (6, "u", "x" * 1000), (7, "u", "x" * 1000), (8, "u", "x" * 40_000)]
    warc.write_archives(spark.createDataFrame(rows, "id long, url string, payload string"), str(tmp_path / "w"))
    got = {r.id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert len(got) == len(rows) and all(r.problem is None for r in got.values())
    for i, _, payload in rows:
        r = got[f"<urn:page:{i}>"]
        if r.type == "response":
            assert bytes(r.payload).decode() == payload and r.sha1 == hashlib.sha1(payload.encode()).hexdigest()
    assert {i: got[f"<urn:page:{i}>"].type for i in range(1, 9)} == {1: "response", 2: "response", 3: "revisit", 4: "response", 5: "response", 6: "revisit", 7: "response", 8: "response"}
    assert got["<urn:page:3>"].refers_to == "<urn:page:4>"


def test_warc_reports_damage(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    assert warc.body_of(block) == b"abc"
    parts = [{"number": 1, "block": block[:20]}, {"number": 3, "block": block[20:]}]
    batch = pa.RecordBatch.from_pylist([{"id": "x", "digest": None, "total": len(block), "parts": parts}, {"id": "y", "digest": None, "total": 5, "parts": [{"number": 1, "block": block}]}, {"id": "z", "digest": "0", "total": len(block), "parts": [{"number": 1, "block": block}]}])
    problems = next(warc._rejoin([batch])).column("problem").to_pylist()
    assert problems == ["segments are missing or repeated", f"segments hold {len(block)} of 5 bytes", "digest"]


def test_warc_damaged_files_are_problem_rows(spark, tmp_path):
    import gzip

    head = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    good = head % (1, len(block)) + block + b"\r\n\r\n"
    files = {"part-cut": good + head % (2, 5) + b"ab", "part-junk": b"junk", "part-gz.gz": gzip.compress(good) + gzip.compress(good)[:-9], "part-fine": good, "part-empty": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = sorted(((r.id, r.type, r.bytes, r.problem) for r in warc.read_archives(spark, str(tmp_path)).collect()), key=repr)
    fine = ("<urn:page:1>", "response", 5, None)
    # the last member lacks its end only: its record is whole, and the loss is told
    assert got == sorted([fine] * 4 + [("<urn:page:2>", "response", None, "cut short: 2 of 5 bytes"), (None, "damaged", None, "no record at byte 0"), (None, "damaged", None, "gzip: cut short")], key=repr)


# 3, 8, 10 ---------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = [r.choice(base) for _ in range(60)]
        if toxic:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["vilewordx", "grimstem" + r.choice("abcdef") * 3, "idiot"])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scorer = toxicity.learn(d.where("doc_id < 400"), lab.where("doc_id < 400"))
    got = {x.doc_id: x.score for x in toxicity.score(d.unionByName(spark.createDataFrame([(900, None, None, None, None), (901, "", None, None, None)], DOCS)), scorer).collect()}
    assert all((got[i] >= toxicity.CUT) == (i % 5 == 0) for i in range(400, 600))
    assert got[900] == got[901] < toxicity.CUT
    assert toxicity.score(docs(spark, []), scorer).count() == 0
    unlabelled = toxicity.fit(pa.table({"text": pa.array([], pa.string()), "toxic": pa.array([], pa.int32())}))
    insult, fine = unlabelled.score(*toxicity.text_view(pa.array(["you idiot, you moron", "fine"])))
    assert insult > toxicity.CUT > fine


def test_gradients_of_the_network():
    import numpy as np

    t = langid.ByteTagger(["a", "b", "c"], hidden=3, seed=1)
    t.w = {k: v.astype(np.float64) for k, v in t.w.items()}
    data = np.frombuffer(b"hello worldly you", np.uint8)
    x, length, order = langid.grid_of(data, np.array([0, 6, 14]), np.array([5, 13, 17]))
    target = np.array([0, 1, 2])[order]
    _, g = t.gradients(x, length, target)
    for name, at in (("Uf", (1, 2)), ("Vb", (0, 1)), ("Ef", (ord("l"), 4)), ("Eb", (ord("o"), 7)), ("O", (4, 1)), ("b", (2,))):
        old = t.w[name][at]
        losses = []
        for d in (1e-3, -1e-3):
            t.w[name][at] = old + d
            losses.append(t.gradients(x, length, target)[0])
        t.w[name][at] = old
        assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=2e-2, abs=1e-4)


def test_language_id_accuracy_and_odd_texts(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    d = spark.read.parquet(f"{sf}/documents.parquet")
    tagger = langid.learn(d, "text", "lang", "doc_id", sample=50)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs(spark, [None, "", "12 34 !?", "the " * 9, "x" * 100_000]), tagger, "doc_id", "text").collect()}
    assert [odd[i] for i in range(3)] == [("und", 0.0)] * 3 and odd[3][0] in tagger.labels and 0 < odd[3][1] <= 1 and odd[4][0] in tagger.labels
    assert langid.predict(docs(spark, []), tagger, "doc_id", "text").count() == 0
    assert langid.learn(docs(spark, [], None), "text", "lang", "doc_id") is None


def test_every_letter_is_in_one_core():
    import numpy as np

    r = random.Random(3)
    texts = ["x" * n for n in (0, 1, 63, 64, 65, 66, 96, 97, 200)] + ["日本語" * 40, "aé" * 90 + " b", "a b " * 9, "".join(r.choice("aéß語😀") for _ in range(500))]
    data, off = toxicity.text_view(pa.array(texts))
    starts, ends, doc, lead, core = langid.cut_words(data, off)
    hit = np.zeros(len(data), int)
    for a, b, n, c in zip(starts, ends, lead, core, strict=True):
        hit[a + n : a + n + c] += 1
        assert b - a <= langid.CORE + 2 * langid.MARGIN + 8
        data[a:b].tobytes().decode()  # whole characters only
    assert (hit == (data != 32)).all()


def test_a_rare_language_is_learned(spark):
    rows = [(i, "the and of it was " * 5, "aa", "s", 0) for i in range(900)] + [(1000 + i, "zhu qix wuv zaq " * 5, "zz", "s", 0) for i in range(3)]
    d = spark.createDataFrame(rows, DOCS)
    tagger = langid.learn(d, "text", "lang", "doc_id", sample=100)
    assert tagger.labels == ["aa", "zz"]
    got = langid.predict(docs(spark, ["zaq wuv zhu", "of the it"]), tagger, "doc_id", "text").orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["zz", "aa"]


def test_decontamination(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(40) for _ in range(20)]
    texts = [prose(r.randint(5, 400)) for _ in range(60)]
    for i in range(20):
        texts[i] += " " + items[i].upper() + " " + prose(50)
    w = items[3].split()
    w[5], w[17] = "changed", "also"
    texts += [" ".join(w), " ".join(items[4].split()[:12]), None, "", "one"]
    b = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.contamination(docs(spark, texts), b).collect()}
    assert [i for i, x in got.items() if x.contaminated] and {i for i, x in got.items() if x.contaminated} == {*range(20), 60}
    assert all(list(got[i].item_ids) == [i] for i in range(20)) and got[60].item_id == 3
    none = b.where("false")
    assert decontaminate.contamination(docs(spark, texts), none).where("contaminated").count() == 0
    assert decontaminate.contamination(docs(spark, []), b).count() == 0


def all_leaks(texts, items, lcs_share=0.6, answer_share=0.5):
    """Brute force: every passage's window against every passage of the benchmark."""
    q = decontaminate.Query(pa.table({"item_id": list(range(len(items))), "text": items}))
    q.weigh(decontaminate.np.zeros(len(q.terms), int), 1, 1.0, lcs_share)
    h, first = decontaminate.tokens(*decontaminate.text_view(pa.array(texts)))
    found = set()
    for d in range(len(texts)):
        own = h[first[d] : first[d + 1]].tolist()
        for at in range(0, max(1, len(own) - 32), 32):
            window = own[max(0, at - 16) : at + 80]
            for c, w in enumerate(q.words):
                bits = decontaminate.common_subsequence(q.masks[c], len(w), q.numbers(decontaminate.np.array(window, decontaminate.np.uint64)).tolist())
                if bits.bit_count() >= lcs_share * len(w) and (bits & q.answers[c]).bit_count() >= answer_share * q.answers[c].bit_count():
                    found.add((d, q.item[c]))
    return found


@pytest.mark.parametrize("n", [500, 2000])
def test_decontamination_with_many_items(spark, n):
    r = random.Random(n)
    vocabulary = [f"v{i}" for i in range(3000)]
    prose = lambda k: [vocabulary[int(3000 * r.random() ** 2)] for _ in range(k)]
    items = [prose(r.randint(15, 71)) for _ in range(n)]
    texts, planted = [], set()
    for d in range(60):
        w = prose(r.randint(0, 90))
        if d % 6:
            i = r.randrange(n)
            copy = [x if d % 6 < 4 or r.random() < 0.8 else "other" for x in items[i]]
            w[(at := r.randint(0, len(w))) : at] = copy
            planted |= {(d, i)} if d % 6 < 4 else set()
        texts.append(" ".join(w))
    items = [" ".join(x) for x in items]
    want = all_leaks(texts, items)
    texts += [" ".join(prose(r.randint(100, 200))) for _ in range(1500)]  # draw the latent space away from the items
    got = {(x.k1_, x.item_id) for x in decontaminate.leaks(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert planted <= got and {x for x in got if x[0] < 60} == want


class Here:
    """Rows of one Arrow batch whose mapInArrow runs in this process."""

    def __init__(self, batch):
        self.batch = batch
        self.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v)))

    def where(self, *_):
        return self

    select = where

    def mapInArrow(self, run, _):
        return [x for b in run(iter([self.batch])) for x in b.to_pylist()]


def test_decontamination_takes_subsequences_of_few_pairs(monkeypatch):
    """Pairs of texts and items that share too few words take no subsequence, and every leak is found."""
    np, r = decontaminate.np, random.Random(21)
    vocabulary = [f"v{i}" for i in range(3000)]
    prose = lambda k: [vocabulary[int(3000 * r.random() ** 4)] for _ in range(k)]
    items = [prose(r.randint(15, 71)) for _ in range(200)]
    texts = [prose(r.randint(0, 300)) for _ in range(200)]
    for d in range(0, 200, 20):
        at = r.randint(0, len(texts[d]))
        texts[d][at:at] = [x if r.random() < 0.9 else "other" for x in items[d]]
    items, texts = [" ".join(x) for x in items], [" ".join(x) for x in texts]
    q = decontaminate.Query(pa.table({"item_id": list(range(200)), "text": items}))
    h, first = decontaminate.tokens(*decontaminate.text_view(pa.array(texts)))
    h, start = q.numbers(h), decontaminate.blocks_of(first)
    block = [(start[d] + i // decontaminate.STRIDE, x) for d in range(200) for i, x in enumerate(h[first[d] : first[d + 1]])]
    q.weigh(np.bincount([x for _, x in set(block)], minlength=len(q.terms) + 1)[:-1], int(start[-1]), 0.02, 0.6)
    packed = [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
    rows = Here(pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([0] * 200), pa.array(packed, pa.binary())], names=["k1_", "k2_", "words"]))
    basis = np.ascontiguousarray(np.linalg.svd(q.rows(), full_matrices=False)[2][:160].T)
    calls, plain = [], decontaminate.common_subsequence
    monkeypatch.setattr(decontaminate, "common_subsequence", lambda *x: calls.append(1) or plain(*x))
    got = {(x["k1_"], x["item_id"]) for x in decontaminate.search(rows, q, basis, 0.4, 0.6, 0.5)}
    taken = len(calls)
    assert len(got) >= 10 and got == all_leaks(texts, items)
    assert taken <= 300


def test_products_of_passages():
    """Sparse passages times a matrix, and their transpose, are those of the dense ones; frequent terms, rare ones, none."""
    np = decontaminate.np
    rng = np.random.default_rng(4)
    a = (rng.random((300, 90)) < np.r_[np.full(10, 0.7), np.full(70, 0.02), np.zeros(10)]) * rng.random((300, 90)).astype(np.float32)
    row, term = np.nonzero(a)
    part = decontaminate.Sparse(row, term, a[row, term], 300)
    assert 10 <= len(part.common) < 80
    g, y, z = (rng.normal(size=(n, 16)).astype(np.float32) for n in (90, 300, 90))
    want = z + a.T @ y
    part.add_transposed(y, z)
    assert np.allclose(part.times(g), a @ g, atol=1e-4) and np.allclose(z, want, atol=1e-4)
    assert not decontaminate.Sparse(row[:0], term[:0], a[row, term][:0], 3).times(g).any()


def test_decontamination_of_an_item_in_a_third_of_all_rows(spark):
    r = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    prose = lambda k: [vocabulary[int(3000 * r.random() ** 2)] for _ in range(k)]
    items = [prose(r.randint(15, 59)) for _ in range(200)]
    items[7] = prose(59)
    texts = []
    for d in range(900):
        w = prose(r.randint(0, 200))
        if d % 3 == 0:
            w[(at := r.randint(0, len(w))) : at] = items[7]
        texts.append(" ".join(w))
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {x.k1_: x.cosine for x in decontaminate.leaks(docs(spark, texts), b).where("item_id = 7").collect()}
    assert set(got) == set(range(0, 900, 3))
    q = decontaminate.Query(pa.table({"item_id": list(range(200)), "text": [" ".join(x) for x in items]}))
    mine = next(w for w, i in zip(q.words, q.item, strict=True) if i == 7)
    df = decontaminate.np.ones(len(q.terms), int)
    df[mine] = 300
    q.weigh(df, 900, 0.02, 0.6)
    assert (q.idf[mine] > 0).all()


def test_long_items_need_their_answer_or_a_verbatim_part(spark):
    r = random.Random(12)
    w = [f"q{i}" for i in range(200)]
    noise = lambda k: [f"n{r.randrange(4000)}" for _ in range(k)]
    some = lambda part: [x if r.random() < 0.75 else "other" for x in part]  # noqa: E731  reworded, not verbatim
    texts = [noise(80) + w + noise(80), noise(80) + w[:50] + noise(80), noise(80) + some(w[:50]) + noise(300), noise(80) + some(w[:50]) + noise(200) + w[150:] + noise(9), noise(400)]
    b = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    got = {x.doc_id: x.contaminated for x in decontaminate.contamination(docs(spark, [" ".join(x) for x in texts]), b).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False}


@pytest.mark.parametrize("change", ["replace", "insert", "swap"])
def test_reworded_items_are_found(spark, change):
    """Recall on items with a quarter of their words replaced, as many inserted, or neighbours swapped."""
    r = random.Random(13)
    vocabulary = [f"v{i}" for i in range(2000)]
    prose = lambda k: [vocabulary[int(2000 * r.random() ** 2)] for _ in range(k)]
    items = [prose(r.randint(30, 60)) for _ in range(40)]
    texts = []
    for item in items:
        w = list(item)
        for at in r.sample(range(len(w) - 1), len(w) // 4):
            if change == "replace":
                w[at] = r.choice(vocabulary)
            elif change == "insert":
                w.insert(at, r.choice(vocabulary))
            else:
                w[at], w[at + 1] = w[at + 1], w[at]
        texts.append(" ".join(prose(r.randint(0, 200)) + w + prose(r.randint(0, 200))))
    texts += [" ".join(prose(r.randint(50, 300))) for _ in range(200)]
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(x.k1_, x.item_id) for x in decontaminate.leaks(docs(spark, texts), b).collect()}
    assert len(got & {(i, i) for i in range(40)}) >= 36 and not any(d >= 40 for d, _ in got)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    twice = d.unionByName(d.where("doc_id < 3")).unionByName(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", None, None, 0)], d.schema))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, twice, sf)
        assert out.columns == d.columns and out.count() > 0
    assert corpus_pipeline.run(spark, sf).count() > 0
