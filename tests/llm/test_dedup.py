"""Operators 1 and 2 against brute force."""

import hashlib
import random

import pytest

from repolens.llm import suffix, units

SCHEMA = "doc_id long, text string, source string, body_ string"


def corpus(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() + (r.choice(".\n") if r.random() < 0.1 else "") for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    docs = [prose(r.randint(1, 200)) for _ in range(40)]
    for i in range(0, 30):
        w = docs[i].split(" ")
        w.insert(r.randint(0, len(w)), r.choice(shared))
        docs[i] = " ".join(w)
    base = prose(150)
    for _ in range(12):  # near copies
        w = base.split(" ")
        w[r.randrange(len(w))] = word()
        docs.append(" ".join(w))
    docs += [docs[0], docs[0], "", None, "a" * 700, "ab" * 400, "x", "a b\n" * 300]
    return [(i, t, None, "clash") for i, t in enumerate(docs)]


def brute(rows, length):
    seen: dict[bytes, int] = {}
    data = {i: (t or "").encode() for i, t, *_ in rows}
    for b in data.values():
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(gone[j] and (j == 0 or not gone[j - 1]) for j in range(len(b)))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("many", [2000, 1])
def test_suffix_dedup_is_exact(spark, many, monkeypatch):
    monkeypatch.setattr(suffix, "MANY", many)
    rows = corpus()
    found = suffix.suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute(rows, 200)


def test_suffix_dedup_other_length_and_text(spark):
    rows = corpus(2)
    found = suffix.suffix_dedup(spark.createDataFrame(rows, SCHEMA), length=60, gram=24, with_text=True).collect()
    want = brute(rows, 60)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want
    for r in found:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_empty_and_repeated_rows(spark):
    for op in (suffix.suffix_dedup, units.unit_dedup):
        assert op(spark.createDataFrame([], SCHEMA)).collect() == []
        twice = [(1, " ".join(hashlib.sha1(bytes([i])).hexdigest() for i in range(20)) + ".", None, "")] * 2
        assert [r.n_removed for r in op(spark.createDataFrame(twice, SCHEMA)).collect()] == [0, 0]


def test_suffix_family_levels():
    import numpy as np

    r = np.random.default_rng(0)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    family, places = suffix.SuffixFamily(8), np.arange(len(data) - 7)
    for part in np.array_split(places, 13):
        family.add(data, part)
    keys = [data[p : p + 8].tobytes() for p in places]
    count = {k: keys.count(k) for k in set(keys)}
    assert family.repeated.tolist() == [count[k] > 1 for k in keys]
    sizes = [len(k) for k, _ in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_unit_dedup_keeps_the_earliest(spark):
    long = "this passage of more than eight words stands in two documents. And so does its second sentence, which is long."
    rows = [
        (1, f"Own start here. {long} Own end.", None, ""),
        (2, f"Another beginning of it. {long.upper()} Its end.", None, ""),
        (3, "Nothing here repeats at all in any other document, it is clean. Own end.", None, ""),
        (4, None, None, ""),
        (5, "", None, ""),
    ]
    found = {r.doc_id: r for r in units.unit_dedup(spark.createDataFrame(rows, SCHEMA), with_text=True).collect()}
    assert [found[i].n_removed > 0 for i in range(1, 6)] == [False, True, False, False, False]
    s = found[2].removed[0]
    assert rows[1][1].encode()[s.start : s.end].decode() == long.upper()
    assert found[2].kept_text == "Another beginning of it.  Its end."
    assert found[2].kept_sha256 == hashlib.sha256(found[2].kept_text.encode()).hexdigest()
    assert found[4].n_bytes == found[5].n_bytes == 0


def test_unit_dedup_removes_whole_lines_of_any_length(spark):
    rows = [
        (1, "Own words of one.\nAll rights reserved.\nYes. No.\n}\nMore own words here.", None, ""),
        (2, "Own words of two.\r\n  ALL rights\treserved. \r\nOther own words here.\n}\n}", None, ""),
        (3, "All rights reserved. It goes on in this line.\nYes. No.\nYes.\nNo. And on.", None, ""),
        (4, "All rights reserved.", None, ""),
    ]
    found = {r.doc_id: r for r in units.unit_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), with_text=True).collect()}
    assert found[1].n_removed == 0
    assert found[2].kept_text == "Own words of two.\r\n   \r\nOther own words here.\n\n"
    assert found[3].kept_text == "All rights reserved. It goes on in this line.\n\nYes.\nNo. And on."
    assert found[4].kept_text == ""


def test_unit_dedup_leaves_no_repeated_line(spark):
    r = random.Random(8)
    line = lambda: " ".join(r.choice("ab") + r.choice(["", ".", "c"]) for _ in range(r.randint(1, 12)))
    rows = [(i, "\n".join(line() for _ in range(r.randint(0, 12))), None, "") for i in range(80)]
    seen, again = set(), set()
    for i, text, *_ in rows:
        at = 0
        for x in text.split("\n"):
            if x in seen:
                again.add((i, at, at + len(x)))
            seen.add(x)
            at += len(x) + 1
    gone = {x.doc_id: [(s.start, s.end) for s in x.removed] for x in units.unit_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert again and all(any(s <= a and b <= e for s, e in gone[i]) for i, a, b in again if b > a)
