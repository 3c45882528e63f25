"""Operator 6 against brute force."""

import random
import re

import numpy as np
import pytest

from repolens.llm import jaccard

SCHEMA = "doc_id long, text string, node string"


def corpus(seed: int, docs: int = 60) -> list[tuple]:
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("aeiou") + r.choice("xyz")
    out = [[word() for _ in range(r.choice([0, 1, 3, 4, 5, 6, 8, 9, 12, 30, 90, 200]))] for _ in range(docs)]
    for size, copies, edits in ((9, 8, 1), (12, 10, 1), (40, 15, 1), (120, 30, 4), (300, 30, 8), (8, 6, 1)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w)) if r.random() < 0.7 else -1] = word()
            if r.random() < 0.4:
                w += [word() for _ in range(r.randint(0, max(1, size // 8)))]
            out.append(w)
    passage = [word() for _ in range(40)]
    out += [passage + [word() for _ in range(r.randint(4, 60))] for _ in range(30)]
    texts = [r.choice([" ", "  ", "\n"]).join(w) for w in out]
    texts += [texts[-1].upper(), None, "", " \t", "Ä b c", "ä b c"]
    return [(i * 3, t, "clash") for i, t in enumerate(texts)]


def sets(text):
    w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    s = {i: sets(t) for i, t, _ in rows}
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_are_exact(spark, seed):
    rows = corpus(seed)
    found = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows)


def test_every_linked_pair_shares_a_signature():
    """The pigeonhole itself, for random pairs at the threshold, in every band."""
    r = np.random.default_rng(5)
    bands = jaccard.Bands(1000)
    for s in list(range(1, 60)) + [100, 333, 700]:
        for _ in range(20):
            total = r.integers(0, 1 << 63, 3 * s, dtype=np.uint64)
            n = int(r.integers(-(-8 * s // 10), s + 1))
            common = -(-80 * (n + s) // 180)
            a, b = total[:s], np.r_[total[:common], total[s : s + n - common]]
            tok, at = np.r_[np.sort(a), np.sort(b)], np.array([0, s, s + n])
            sig, owner = jaccard.signatures(tok, at, bands)
            assert set(sig[owner == 0]) & set(sig[owner == 1]), (s, n)


def test_empty_table_and_repeated_rows(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(5, "a b c d e f", ""), (5, "a b c d e f", ""), (2, "A b c d e f", ""), (1, None, "")]
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(1, 0, 1), (2, 2, 2), (5, 2, 2), (5, 2, 2)]


def test_large_hubs_in_pairs_of_blocks(spark, monkeypatch):
    """The same components whatever the size of a block."""
    rows = corpus(4)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    found = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows)


def test_one_id_with_two_texts_and_wide_ids(spark):
    word = lambda n: [f"w{n}x{i}" for i in range(60)]
    near = lambda n: " ".join(["other", *word(n)[1:]])
    a, b = " ".join(word(1)), " ".join(word(2))
    rows = [(5, a, ""), (5, b, ""), (6, near(1), ""), (7, near(2), ""), (5 * 10**18, " ".join(word(3)), ""), (-9 * 10**18, near(3), ""), (9 * 10**18, " ".join(word(4)), ""), (None, near(4), "")]
    d = spark.createDataFrame(rows, SCHEMA)
    found = sorted(((r.doc_id or 0, r.component_id) for r in jaccard.jaccard_components(d).collect()))
    assert found == sorted([(5, 5), (5, 5), (6, 5), (7, 5), (5 * 10**18, -9 * 10**18), (-9 * 10**18, -9 * 10**18), (9 * 10**18, 9 * 10**18), (0, 9 * 10**18)])
    kept = sorted((r.doc_id, r.text) for r in jaccard.one_of_each(d).collect())
    assert kept == sorted([(5, a), (5, b), (-9 * 10**18, near(3)), (9 * 10**18, " ".join(word(4)))])


def test_counters_never_say_more_than_the_difference():
    r = np.random.default_rng(6)
    for _ in range(200):
        s = r.integers(0, 1 << 63, int(r.integers(1, 400)), dtype=np.uint64)
        p, q = s[: int(r.integers(1, len(s) + 1))], s[int(r.integers(0, len(s))) :]
        one, two = (np.bincount((x & np.uint64(c - 1)).astype(int), minlength=c).astype(np.uint8) for x in (p, q) for c in [int(jaccard.cells(np.array([len(x)]))[0])])
        assert jaccard.difference_bound(one, two) <= len(np.setxor1d(p, q))
