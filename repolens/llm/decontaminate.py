"""Operator 8: benchmark decontamination by latent semantic retrieval.

1. *Words.* The corpus is cut into words once; each becomes its number among the benchmark's terms (or none), and these
   short rows are written down: all that follows reads them, not the texts. The same pass counts in how many blocks of
   `STRIDE` words each term occurs. Terms in more than `max_share` of all blocks say little and get no weight in the
   latent space; an item that would lose over half of its terms so, as one that is copied widely does, keeps them all
   with their low weights, and any keeps its three rarest. This decides what the cosine says, not what is found: see 3.
2. *Distributed randomised SVD.* The rows of A are TF-IDF passages (two neighbouring blocks) of the corpus, over the
   benchmark's terms, and the benchmark's own passages, weighted as heavily as the corpus. One pass makes A'(A G) for
   a random G in partial sums by term; its orthonormal basis Q spans the latent space (one power iteration included).
3. *Candidates.* Every passage of the corpus is projected and held against every item (a stated query set, in blocks
   of `ITEMS`) by cosine; the passage's length counts in full, also outside of the latent space. A space of low rank
   loses items, the more of them the larger the benchmark, so a bound adds what the cosine leaves out: a passage that
   can pass the check below holds at least `least` of the item's rarest words. This bound misses no leak.
4. *Checks.* Candidates whose window shares too few words with the item for the next check, in whatever order, end here;
   so few subsequences are computed. Any other is a leak if the longest common subsequence of the item's words with the
   passage (and half a block around it) holds `lcs_share` of the item, and half of the item's answer (its last quarter)
   among them. An item of 72 words or more is sought in parts of about `PIECE` words: a part is a leak if the document
   also holds half of the item's answer, wherever, or if the part is there nearly verbatim (`VERBATIM`): then it needs
   no answer.

Defined cases: null and empty texts have no passages; items without words are never found; equal items are all
reported; a text shorter than a passage is one passage; repeated rows get equal results; an empty corpus gives no
rows and an empty benchmark no leaks; extra columns are ignored; rows with a null id keep it; rows of one id and
different texts are judged apart.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, ROW_KEY, lower_ascii, materialise, pieces, prefix_hash, row_key, span_hash, table, text_view, words

STRIDE = 32
RANK = 160
#: Benchmark items in one pass over the corpus; further items take further passes.
ITEMS = 2000
PIECE = 48
#: Share of a part of a long item that counts as verbatim.
VERBATIM = 0.9
#: An item's words are counted by their number modulo this.
BUCKETS = 4096
#: Passages in one product: few stay in the processor's cache.
ROWS = 1024
#: A term in more of these passages has a dense column.
FREQUENT = 16


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Word hashes of all documents and where each document's words begin."""
    low = lower_ascii(data)
    starts, ends, first = words(low, offsets, NOT_ALNUM)
    return span_hash(prefix_hash(low), starts, ends), first


class Query:
    """The benchmark's passages over their own terms. Items longer than PIECE words are several passages."""

    def __init__(self, rows: pa.Table):
        data, off = text_view(rows["text"])
        h, first = tokens(data, off)
        self.item, self.words, self.last = [], [], []  # last: the number of the item's last part
        for i, name in enumerate(rows["item_id"].to_pylist()):
            own = h[first[i] : first[i + 1]]
            parts = max(1, round(len(own) / PIECE))
            for part in np.array_split(own, parts) if len(own) else []:
                self.item.append(name)
                self.words.append(part)
            self.last += [len(self.words) - 1] * (parts if len(own) else 0)
        self.terms = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]))
        self.kind = np.dtype("<u2" if len(self.terms) < 65_000 else "<u4")
        self.words = [np.searchsorted(self.terms, w) for w in self.words]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The numbers of words among the terms; unknown words get the one after."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, len(self.terms)).astype(self.kind)

    def weigh(self, df: np.ndarray, blocks: int, max_share: float, lcs_share: float) -> None:
        """Keeps the telling terms; sets idf (0: left out), masks for the subsequence check and the rare words."""
        self.idf = np.log((blocks + 1) / (df + 1)) + 1e-3
        telling = df <= max(2.0, max_share * blocks)
        keep = telling.copy()
        for w in self.words:
            t = np.unique(w)
            keep[t if telling[t].mean() < 0.5 else t[np.argsort(df[t], kind="stable")[:3]]] = True
        self.idf[~keep] = 0
        self.idf = np.r_[self.idf, 0.0]  # of unknown words
        self.masks, self.answers, self.has = [], [], np.zeros((len(self.words), BUCKETS + 1), np.uint8)
        length = np.bincount(self.last, [len(w) for w in self.words], len(self.words)).astype(int)  # of the items
        for p, w in enumerate(self.words):
            mask: dict[int, int] = {}
            for i, x in enumerate(w.tolist()):
                mask[x] = mask.get(x, 0) | 1 << i
            self.masks.append(mask)
            self.has[p, :-1] = np.minimum(np.bincount(w % BUCKETS, minlength=BUCKETS), 255)
            n = min(len(w), max(min(3, len(w)), math.ceil(length[self.last[p]] / 4)))
            self.answers.append(((1 << n) - 1) << (len(w) - n))
        self.size = np.array([len(w) for w in self.words])
        self.index_rare(df, lcs_share)

    def index_rare(self, df: np.ndarray, lcs_share: float) -> None:
        """The rarest places of each passage, by term: (passage, how often). A subsequence of `need` places leaves out
        len - need of all places, so of any `rare` places it takes rare - (len - need) = `least`."""
        term, passage, times, self.least = [], [], [], np.zeros(len(self.words), np.int64)
        for i, w in enumerate(self.words):
            need = max(1, math.ceil(lcs_share * len(w)))
            self.least[i] = (need + 1) // 2
            rare = w[np.argsort(df[w], kind="stable")[: len(w) - need + self.least[i]]]
            t, n = np.unique(rare, return_counts=True)
            term.append(t)
            passage.append(np.full(len(t), i))
            times.append(n)
        term = np.concatenate(term)
        order = np.argsort(term, kind="stable")
        self.rare = np.concatenate(passage)[order], np.concatenate(times)[order]
        self.rare_at = np.searchsorted(term[order], np.arange(len(self.terms) + 2))  # unknown words have none

    def rows(self) -> np.ndarray:
        """Dense unit rows: passage x term."""
        a = np.zeros((len(self.words), len(self.terms)), np.float32)
        for i, w in enumerate(self.words):
            t, n = np.unique(w, return_counts=True)
            a[i, t] = (1 + np.log(n)) * self.idf[t]
        return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)


def common_subsequence(mask: dict[int, int], n: int, window: list[int]) -> int:
    """Bits of the item's places that a longest common subsequence takes up."""
    v = full = (1 << n) - 1
    for x in window:
        u = v & mask.get(x, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return ~v & full


def enough_words(h: np.ndarray, begin: np.ndarray, end: np.ndarray, c: np.ndarray, q: Query, lcs_share: float) -> np.ndarray:
    """Whether h[begin:end] shares as many words with passage c of the benchmark as a leak's common subsequence takes; each
    counts as often as both hold it. With over BUCKETS terms some count as others, so more pass; no leak is left out."""
    out = np.zeros(len(c), bool)
    for a in range(0, len(c), 4096):
        lo, hi, item = begin[a : a + 4096, None], end[a : a + 4096, None], c[a : a + 4096, None]
        place = np.arange((hi - lo).max())
        word = h[np.minimum(lo + place, len(h) - 1)]
        word = np.where((lo + place < hi) & (word < len(q.terms)), word % BUCKETS, BUCKETS).astype(np.uint16)
        word.sort(axis=1)
        fresh = np.zeros(word.shape, np.int64)
        fresh[:, 1:] = np.where(word[:, 1:] != word[:, :-1], place[1:], 0)
        before = place - np.maximum.accumulate(fresh, axis=1)
        out[a : a + 4096] = (before < q.has[item, word]).sum(1) >= lcs_share * q.size[item[:, 0]]
    return out


def blocks_of(first: np.ndarray):
    """Block numbers over all documents: first block of each document, and how many there are."""
    n = -(-np.diff(first) // STRIDE)
    return np.r_[0, np.cumsum(n)]


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each place."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def passages(h: np.ndarray, first: np.ndarray, idf: np.ndarray):
    """Sparse TF-IDF rows (passage, term, weight), sorted, of numbered words; a passage is a block and the one after it.
    Passages bear the number of their first block; a document's last block is a passage only if it is its first, too."""
    place = np.flatnonzero(idf[h] > 0)
    at = h[place].astype(np.int64)
    doc = rows_of(first)[place]
    start = blocks_of(first)
    block = start[doc] + (place - first[doc]) // STRIDE
    last = np.maximum(start[doc + 1] - 2, start[doc])
    here, before = block <= last, block > start[doc]
    p = np.r_[block[here], block[before] - 1]
    t = np.r_[at[here], at[before]]
    key, n = np.unique(p * len(idf) + t, return_counts=True)
    p, t = key // len(idf), key % len(idf)
    return p, t, ((1 + np.log(n)) * idf[t]).astype(np.float32)


def rare_matches(h: np.ndarray, first: np.ndarray, q: Query) -> tuple[np.ndarray, np.ndarray]:
    """(passage of the text, passage of the benchmark) wherever the four blocks that cover a passage's window hold
    enough of the rare words; sorted."""
    n_terms, n_items, (item, times) = len(q.terms), len(q.words), q.rare
    place = np.flatnonzero(np.diff(q.rare_at)[h] > 0)
    doc = rows_of(first)[place]
    start = blocks_of(first)
    key, n = np.unique((start[doc] + (place - first[doc]) // STRIDE) * n_terms + h[place], return_counts=True)
    block, t = key // n_terms, key % n_terms
    step, found = max(32, (1 << 18) // n_items), []
    for a in range(0, int(start[-1]), step):
        i, j = np.searchsorted(block, (a - 1, a + step + 2))
        if i == j:
            continue
        many = q.rare_at[t[i:j] + 1] - q.rare_at[t[i:j]]
        entry = np.arange(many.sum()) + np.repeat(q.rare_at[t[i:j]] - np.cumsum(many) + many, many)
        cell = np.repeat((block[i:j] - a + 1) * n_items, many) + item[entry]
        held = np.bincount(cell, np.minimum(np.repeat(n[i:j], many), times[entry]), (step + 3) * n_items).reshape(-1, n_items)
        b, c = np.nonzero(held[:-3] + held[1:-2] + held[2:-1] + held[3:] >= q.least)
        found.append((b + a, c))
    b, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
    d = np.searchsorted(start, b, side="right") - 1
    whole = (d < len(start) - 1) & (b <= np.maximum(start[np.minimum(d + 1, len(start) - 1)] - 2, start[d]))
    return b[whole], c[whole]


def _heads(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)


def _add_runs(out: np.ndarray, to: np.ndarray, w: np.ndarray, source: np.ndarray, at: np.ndarray) -> None:
    """out[to] += w * source[at] for sorted `to`: the first of every run of equal `to`, then the second, and so on, whole
    rows at a time (reduceat goes down each column by itself)."""
    head = _heads(to)
    n = np.diff(np.r_[head, len(to)])
    order = np.argsort(-n, kind="stable")
    head, n = head[order], n[order]
    total = np.zeros((len(head), out.shape[1]), out.dtype)
    for j in range(n[0] if len(n) else 0):
        i = head[: np.searchsorted(-n, -j)] + j
        part = source[at[i]]
        part *= w[i, None]
        total[: len(i)] += part
    out[to[head]] += total


class Sparse:
    """Passages (row, term, weight), sorted by row, for products with narrow matrices. The terms that are frequent here
    are dense columns, so neither the rounds by row (words of a passage) nor those by term (FREQUENT) are many."""

    def __init__(self, row: np.ndarray, term: np.ndarray, w: np.ndarray, n_rows: int):
        n = np.bincount(term)
        self.common = np.flatnonzero(n > FREQUENT)
        column = np.full(len(n), -1)
        column[self.common] = np.arange(len(self.common))
        column = column[term]
        dense = column >= 0
        self.dense = np.zeros((n_rows, len(self.common)), np.float32)
        self.dense[row[dense], column[dense]] = w[dense]
        self.row, self.term, self.w = row[~dense], term[~dense], w[~dense]

    def times(self, g: np.ndarray) -> np.ndarray:
        out = self.dense @ g[self.common]
        _add_runs(out, self.row, self.w, g, self.term)
        return out

    def add_transposed(self, y: np.ndarray, z: np.ndarray) -> None:
        """z += A' y."""
        z[self.common] += self.dense.T @ y
        order = np.argsort(self.term, kind="stable")
        _add_runs(z, self.term[order], self.w[order], y, self.row[order])


def unit_rows(p: np.ndarray, t: np.ndarray, w: np.ndarray):
    """(first and last of the passages, their unit rows) of ROWS passages at a time."""
    head = _heads(p)
    ends, n = np.r_[head, len(p)], np.diff(np.r_[head, len(p)])
    for a in range(0, len(head), ROWS):
        b = min(a + ROWS, len(head))
        lo, hi = ends[a], ends[b]
        norm = np.sqrt(np.add.reduceat(w[lo:hi] ** 2, head[a:b] - lo))
        yield a, b, Sparse(np.repeat(np.arange(b - a), n[a:b]), t[lo:hi], w[lo:hi] / np.repeat(norm, n[a:b]), b - a)


def numbered(docs: DataFrame, q: Query) -> DataFrame:
    """own_, k1_, k2_, words (packed numbers) of each row, written down; and, where words is null, a task's counts:
    (term, blocks that hold it) packed, with the number of terms for all blocks."""
    keys, pair = ("own_", *ROW_KEY), np.dtype([("term", "<i8"), ("n", "<i8")])
    shared = docs.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        q = shared.value
        df, n_terms, last = np.zeros(len(q.terms) + 1, np.int64), len(q.terms), None
        for batch in batches:
            last, packed = batch, []
            data, off = text_view(batch.column("t_"))
            for i, j in pieces(off):
                h, first = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                h = q.numbers(h) if len(h) else h.astype(q.kind)
                packed += [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                start = blocks_of(first)
                df[-1] += start[-1]
                place = np.flatnonzero(h < n_terms)
                doc = rows_of(first)[place]
                key = np.sort((start[doc] + (place - first[doc]) // STRIDE) * n_terms + h[place])
                df[:-1] += np.bincount(key[_heads(key)] % n_terms, minlength=n_terms)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array(packed, pa.binary()), pa.nulls(len(packed), pa.binary())], names=[*keys, "words", "counts"])
        if last is not None:
            some = np.zeros(len(found := np.flatnonzero(df)), pair)
            some["term"], some["n"] = found, df[found]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, last.column(c).type) for c in keys], pa.nulls(1, pa.binary()), pa.array([some.tobytes()], pa.binary())], names=[*keys, "words", "counts"])

    kinds = dict(docs.dtypes)
    out = materialise(docs.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", words binary, counts binary"), "leak-words")
    shared.destroy()
    return out


def term_counts(rows: DataFrame, q: Query) -> tuple[np.ndarray, int]:
    """Blocks that hold each term, and blocks in all; summed by term in the cluster."""

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], names=["term", "n"])

    found = rows.where("words IS NULL").select("counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(q.terms) + 1, np.int64)
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    return df[:-1], int(df[-1])


def _words(batch, kind: np.dtype):
    """(first and last row, numbered words, where each row's begin) of the pieces of an Arrow batch."""
    data, off = text_view(batch.column("words"))
    for i, j in pieces(off):
        yield i, j, np.frombuffer(data[off[i] : off[j]].tobytes(), kind), (off[i : j + 1] - off[i]) // kind.itemsize


def latent_basis(rows: DataFrame, q: Query, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """Q: terms x rank."""
    n_terms, rank = len(q.terms), min(rank, len(q.terms))
    g = np.random.default_rng(seed).normal(size=(n_terms, rank)).astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast((q.kind, q.idf, g))

    def run(batches):
        kind, idf, g = shared.value
        z = np.zeros(g.shape, np.float32)
        for batch in batches:
            for _, _, h, first in _words(batch, kind):
                for _, _, part in unit_rows(*passages(h, first, idf)):
                    part.add_transposed(part.times(g), z)
        some = np.flatnonzero(np.abs(z).sum(1))
        for i in range(0, len(some), 4096):
            part = some[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([x.tobytes() for x in z[part]], pa.binary())], names=["term", "row"])

    def add(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("term"), pa.array([np.sum([np.frombuffer(x, np.float32) for x in rows], axis=0, dtype=np.float64).astype(np.float32).tobytes() for rows in b.column("rows").to_pylist()], pa.binary())], names=["term", "row"])

    # partial sums meet by term: one row a task each
    found = rows.select("words").mapInArrow(run, "term long, row binary").groupBy("term").agg(F.collect_list("row").alias("rows")).mapInArrow(add, "term long, row binary").toArrow()
    shared.destroy()
    z = np.zeros((n_terms, rank))
    for term, row in zip(found["term"].to_pylist(), found["row"].to_pylist(), strict=True):
        z[term] = np.frombuffer(row, np.float32)
    own = q.rows().astype(np.float64)
    mine = own.T @ (own @ g)
    z = z / max(np.linalg.norm(z), 1e-9) + mine / max(np.linalg.norm(mine), 1e-9)
    return np.linalg.qr(z)[0].astype(np.float32)


def search(rows: DataFrame, q: Query, basis: np.ndarray, least_cosine: float, lcs_share: float, answer_share: float) -> DataFrame:
    """k1_, k2_, item_id, cosine, lcs for every leak."""
    unit = q.rows() @ basis
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    shared = rows.sparkSession.sparkContext.broadcast((q, basis, unit))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches):
        q, basis, unit = shared.value
        answered = lambda bits, c: (bits & q.answers[c]).bit_count() >= answer_share * q.answers[c].bit_count()
        for batch in batches:
            k1, k2 = (batch.column(c).to_pylist() for c in ROW_KEY)
            out = []
            for i, _, h, first in _words(batch, q.kind):
                start = blocks_of(first)

                def window(d, block):
                    begin = first[d] + block * STRIDE
                    return np.maximum(first[d], begin - STRIDE // 2), np.minimum(first[d + 1], begin + 2 * STRIDE + STRIDE // 2)

                def common(d: int, block: int, c: int) -> int:
                    lo, hi = window(d, block)
                    return common_subsequence(q.masks[c], len(q.words[c]), h[lo:hi].tolist())

                def check(d: int, block: int, c: int, cosine: float) -> None:
                    n, last = len(q.words[c]), q.last[c]
                    bits = common(d, block, c)
                    if bits.bit_count() < lcs_share * n:
                        return
                    alone = last == c and (c == 0 or q.last[c - 1] != c)
                    if not (answered(bits, c) if last == c else False) and (alone or bits.bit_count() < VERBATIM * n):
                        # of a long item, the answer may stand elsewhere in the document
                        if alone or not any(answered(common(d, b, last), last) for b in range(start[d + 1] - start[d])):
                            return
                    out.append((k1[i + d], k2[i + d], q.item[c], cosine, bits.bit_count() / n))

                def check_all(block: np.ndarray, c: np.ndarray, cosine: np.ndarray) -> None:
                    d = np.searchsorted(start, block, side="right") - 1
                    able = enough_words(h, *window(d, block - start[d]), c, q, lcs_share)
                    for x in zip(*(y[able].tolist() for y in (d, block - start[d], c, cosine)), strict=True):
                        check(*x)

                near, near_c = rare_matches(h, first, q)
                p, t, w = passages(h, first, q.idf)
                head = _heads(p)
                at = np.searchsorted(p[head], near)
                blank = np.r_[p[head], -1][at] != near
                check_all(near[blank], near_c[blank], np.zeros(blank.sum()))
                at, near_c = at[~blank], near_c[~blank]
                for a, b, part in unit_rows(p, t, w):
                    cos = part.times(basis) @ unit.T
                    close = cos >= least_cosine
                    mine = slice(*np.searchsorted(at, (a, b)))
                    close[at[mine] - a, near_c[mine]] = True
                    r, c = np.divmod(np.flatnonzero(close), close.shape[1])
                    check_all(p[head[a + r]], c, cos[r, c])
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, kinds, strict=True)], names=[*ROW_KEY, "item_id", "cosine", "lcs"])

    return rows.where("words IS NOT NULL").select(*ROW_KEY, "words").mapInArrow(run, "k1_ long, k2_ long, item_id long, cosine double, lcs double")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("own_"), *row_key(key, text), F.col(text).alias("t_"))


def _found(docs: DataFrame, benchmark: DataFrame, key: str, text: str, max_share: float = 0.02, least_cosine: float = 0.4, lcs_share: float = 0.6, answer_share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """A row (own_, k1_, k2_) for each row of docs, and the leaks."""
    spark, own = docs.sparkSession, _keyed(docs, key, text)
    rows, found = own, spark.createDataFrame([], "k1_ long, k2_ long, item_id long, cosine double, lcs double")
    parts = max(1, -(-benchmark.count() // ITEMS))
    for part in range(parts):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        q = Query(mine.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text").toArrow())
        if len(q.words) == 0:
            continue
        rows = numbered(own, q)
        q.weigh(*term_counts(rows, q), max_share, lcs_share)
        hits = search(rows, q, latent_basis(rows.where("words IS NOT NULL"), q), least_cosine, lcs_share, answer_share)
        found = hits if part == 0 else found.unionByName(hits)
    found = found.groupBy(*ROW_KEY, "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"))
    return (rows.where("words IS NOT NULL") if "words" in rows.columns else rows).select("own_", *ROW_KEY), found


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """k1_, k2_ (as from row_key), item_id, cosine, lcs: every item (item_id, text) found in a document, with its best passage."""
    return _found(docs, benchmark, key, text, **options)[1]


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, contaminated, item_ids (ascending), item_id (of the longest match), lcs, cosine: one row a row of docs."""
    rows, hits = _found(docs, benchmark, key, text, **options)
    hits = hits.groupBy(*ROW_KEY).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max(F.struct("lcs", "cosine", -F.col("item_id"))).alias("top_"))
    out = rows.join(hits, list(ROW_KEY), "left")
    return out.select(F.col("own_").alias(key), F.col("top_").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), (-F.col("top_.col3")).alias("item_id"), F.coalesce("top_.lcs", F.lit(0.0)).alias("lcs"), F.coalesce("top_.cosine", F.lit(0.0)).alias("cosine"))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
