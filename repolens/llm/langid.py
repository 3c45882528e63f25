"""Operator 10: language identification by a bidirectional gated recurrent network over bytes.

The network (numpy, trained here by backpropagation through time) reads a word's bytes from both ends and gives each
letter's byte a probability for each language; a document's probabilities are the mean over all of its letters. The
state starts anew at each word, so equal words get equal outputs: each distinct word is computed once and kept in a
table of bounded size. Words over `CORE` + 2 * `MARGIN` bytes, as in scripts without spaces, are read in windows that
overlap by `MARGIN` bytes on either side and begin at whole characters; each byte counts in the one window whose core
holds it, so it is read with context from both sides wherever it stands.

Languages are those of all labelled rows. Learning uses at most `SAMPLE` documents of each (by hash of the id), and of
each document the `SAMPLE_WORDS` windows of least hash, so that what reaches the one task that learns is bounded; every
document is then labelled from its whole text.

Defined cases: a null text, or one without any letter, is `und` with score 0; so is every text if there is nothing to
learn from; equal probabilities go to the language first in order; repeated rows get equal results; an empty table
gives no rows; extra columns are ignored; a null id counts as no characters in held_out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialise, mix, pieces, prefix_hash, span_hash, table, text_view, words

CORE, MARGIN = 32, 16
HIDDEN = 10
#: Documents of a language, and windows of a document, that are learned from at most.
SAMPLE, SAMPLE_WORDS = 800, 250
#: Distinct words whose outputs a task keeps.
MEMORY = 400_000

LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


class ByteTagger:
    """Weights: per direction E (256 x 3H, the input's share of update, reset and candidate), U (H x 2H), V (H x H);
    output O (2H x L), bias b."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        self.w = {}
        for d in "fb":
            self.w["E" + d] = r.normal(0, 0.3, (256, 3 * hidden))
            self.w["U" + d] = r.normal(0, 0.3, (hidden, 2 * hidden))
            self.w["V" + d] = r.normal(0, 0.3, (hidden, hidden))
        self.w["O"] = r.normal(0, 0.3, (2 * hidden, len(labels)))
        self.w["b"] = np.zeros(len(labels))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, live: np.ndarray, d: str, keep: bool = False):
        """x: T x N bytes, words sorted by falling length; live[t]: how many have a t-th byte."""
        h, e, u, v = self.h, self.w["E" + d], self.w["U" + d], self.w["V" + d]
        state, out, kept = np.zeros((x.shape[1], h), np.float32), [], []
        for t in range(len(x)):
            n = live[t]
            s, i = state[:n], e[x[t, :n]]
            zr = _sigmoid(i[:, : 2 * h] + s @ u)
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(i[:, 2 * h :] + (r * s) @ v)
            new = s + z * (c - s)
            if keep:
                kept.append((s.copy(), z, r, c))
            state[:n] = new
            out.append(new)
        return out, kept

    @staticmethod
    def _flip(x: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = length[None, :] - 1 - np.arange(len(x))[:, None]
        return np.where(at >= 0, np.take_along_axis(x, np.maximum(at, 0), 0), 0)

    def forward(self, x: np.ndarray, length: np.ndarray, keep: bool = False):
        """Probabilities of each byte (list over t of n_t x L)."""
        live = (length[None, :] > np.arange(len(x))[:, None]).sum(1)
        f, kf = self._run(x, live, "f", keep)
        b, kb = self._run(self._flip(x, length), live, "b", keep)
        # the backward state of byte t of word i was made at step length[i] - 1 - t
        grid = np.zeros((len(x), x.shape[1], self.h), np.float32)
        for t in range(len(x)):
            grid[t, : live[t]] = b[t]
        both = []
        for t in range(len(x)):
            n = live[t]
            both.append(np.concatenate([f[t], grid[length[:n] - 1 - t, np.arange(n)]], 1))
        probs = []
        for s in both:
            y = s @ self.w["O"] + self.w["b"]
            y = np.exp(y - y.max(1, keepdims=True))
            probs.append(y / y.sum(1, keepdims=True))
        return probs, (live, both, kf, kb)

    def _back(self, x, live, kept, grads, d, g):
        h, u, v = self.h, self.w["U" + d], self.w["V" + d]
        ds = np.zeros((x.shape[1], h), np.float32)
        for t in reversed(range(len(x))):
            n = live[t]
            s, z, r, c = kept[t]
            dn = ds[:n] + grads[t]
            dc = dn * z * (1 - c * c)
            dz = dn * (c - s) * z * (1 - z)
            drs = dc @ v.T
            dr = drs * s * r * (1 - r)
            dzr = np.concatenate([dz, dr], 1)
            g["V" + d] += (r * s).T @ dc
            g["U" + d] += s.T @ dzr
            np.add.at(g["E" + d], x[t, :n], np.concatenate([dzr, dc], 1))
            ds[:n] = dn * (1 - z) + drs * r + dzr @ u.T

    def gradients(self, x, length, target):
        """Mean cross entropy over letters and its gradient. target: language of each word."""
        probs, (live, both, kf, kb) = self.forward(x, length, True)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        n_all = max(1, sum(int(LETTER[x[t, : live[t]]].sum()) for t in range(len(x))))
        loss, gf, gb = 0.0, [], np.zeros((len(x), x.shape[1], self.h), np.float32)
        for t, p in enumerate(probs):
            n = live[t]
            m = LETTER[x[t, :n]][:, None] / np.float32(n_all)
            loss -= float((np.log(p[np.arange(n), target[:n]] + 1e-9)[:, None] * m).sum())
            dy = p.copy()
            dy[np.arange(n), target[:n]] -= 1
            dy = (dy * m).astype(np.float32)
            g["O"] += both[t].T @ dy
            g["b"] += dy.sum(0)
            ds = dy @ self.w["O"].T
            gf.append(ds[:, : self.h])
            gb[length[:n] - 1 - t, np.arange(n)] = ds[:, self.h :]
        self._back(x, live, kf, gf, "f", g)
        self._back(self._flip(x, length), live, kb, [gb[t, : live[t]] for t in range(len(x))], "b", g)
        return loss, g

    def fit(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, target: np.ndarray, steps: int = 500, batch: int = 512, rate: float = 0.02, seed: int = 11):
        """Adam on batches of words drawn evenly from the languages."""
        r = np.random.default_rng(seed)
        pools = [p for p in (np.flatnonzero(target == i) for i in range(len(self.labels))) if len(p)]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([r.choice(p, -(-batch // len(pools))) for p in pools])
            x, length, order = grid_of(data, starts[pick], ends[pick])
            _, g = self.gradients(x, length, target[pick][order])
            norm = float(np.sqrt(sum((v * v).sum() for v in g.values())))
            for k, v in g.items():
                v *= min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                self.w[k] = (self.w[k] - rate * min(1.0, 2.0 - 2.0 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def word_sums(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray, core: np.ndarray) -> np.ndarray:
        """Per word: the summed probabilities of the letters in its core (core bytes from lead on), and their number in
        the last column."""
        out = np.zeros((len(starts), len(self.labels) + 1), np.float32)
        for i in range(0, len(starts), 16384):
            x, length, order = grid_of(data, starts[i : i + 16384], ends[i : i + 16384])
            part = np.zeros((len(length), out.shape[1]), np.float32)
            for t, p in enumerate(self.forward(x, length)[0]):
                own = order[: len(p)] + i
                letter = LETTER[x[t, : len(p)]] & (t >= lead[own]) & (t < lead[own] + core[own])
                part[: len(p), :-1] += p * letter[:, None]
                part[: len(p), -1] += letter
            out[i + order] = part
        return out


def grid_of(data, starts, ends):
    """Bytes of words as a T x N grid, longest word first; their lengths; the order taken."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    length = length[order]
    at = starts[order][None, :] + np.arange(length[0])[:, None]
    return np.where(np.arange(length[0])[:, None] < length[None, :], data[np.minimum(at, len(data) - 1)], 0), length, order


def cut_words(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of windows, their documents, and where each window's core begins and how long it is."""
    starts, ends, first = words(data, offsets, SPACE)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    parts = np.where(ends - starts > CORE + 2 * MARGIN, -(-(ends - starts) // CORE), 1)
    if not (parts > 1).any():
        return starts, ends, doc, np.zeros(len(starts), np.int64), ends - starts
    # a byte that continues a character moves a border to the character's start; damaged text moves it 3 bytes at most
    whole = np.arange(len(data) + 1)
    inner = np.r_[(data & 0xC0) == 0x80, False]
    for _ in range(3):
        whole = np.where(inner[whole], np.maximum(whole - 1, 0), whole)
    owner = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    last = nth == parts[owner] - 1
    low, high = starts[owner], ends[owner]
    begin = np.where(nth == 0, low, np.maximum(low, whole[np.minimum(low + nth * CORE, high)]))
    stop = np.where(last, high, np.maximum(low, whole[np.minimum(low + (nth + 1) * CORE, high)]))
    left = np.maximum(low, whole[np.maximum(begin - MARGIN, low)])
    right = np.maximum(stop, whole[np.minimum(stop + MARGIN, high)])
    return left, right, doc[owner], begin - left, stop - begin


def learn(docs: DataFrame, text: str, label: str, key: str, sample: int = SAMPLE) -> ByteTagger | None:
    """A tagger for all labels of docs, from at most sample rows of each, the least by hash of the key. It is trained in
    one task of an executor; its weights alone come to the driver."""
    known = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    # ids first: texts of other rows never meet in one task; the ids are few by the bound, so they are broadcast
    least = Window.partitionBy("l_").orderBy(F.xxhash64("k_"), "k_")
    ids = known.select(F.col(key).alias("k_"), F.col(label).alias("l_"))
    # of a large language, about four times as many rows as needed go on to the task that orders them
    rows_of = ids.groupBy("l_").agg(F.count(F.lit(1)).alias("rows_"))
    some = F.pmod(F.xxhash64("k_", F.lit(5)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * F.lit(4.0 * max(sample, 100)) / F.col("rows_")
    few = ids.join(F.broadcast(rows_of), "l_").where(some)  # a row a label, for each of which the network has an output
    few = few.withColumn("n_", F.row_number().over(least)).where(F.col("n_") <= sample).select("k_", "l_").distinct()
    few = materialise(few, "language-keys")
    rows = known.join(F.broadcast(few), (F.col(key) == F.col("k_")) & (F.col(label) == F.col("l_"))).select(F.xxhash64(key).alias("h_"), F.col(text).alias("t_"), "l_")

    def parts(batches):
        for batch in batches:
            data, off = text_view(batch.column("t_"))
            h, l = batch.column("h_").to_pylist(), batch.column("l_").to_pylist()
            out = {"h_": [], "l_": [], "w_": []}
            for i, j in pieces(off):
                part = data[off[i] : off[j]]
                starts, ends, doc, _, _ = cut_words(part, off[i : j + 1] - off[i])
                if len(starts) == 0:
                    continue
                mark = span_hash(prefix_hash(part), starts, ends) ^ (starts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                order = np.lexsort((mark, doc))
                rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
                for x in order[rank < SAMPLE_WORDS].tolist():
                    out["h_"].append(h[i + doc[x]])
                    out["l_"].append(l[i + doc[x]])
                    out["w_"].append(part[starts[x] : ends[x]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["h_"], pa.int64()), pa.array(out["l_"], pa.string()), pa.array(out["w_"], pa.binary())], names=["h_", "l_", "w_"])

    def train(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h_", "ascending"), ("l_", "ascending"), ("w_", "ascending")])
        labels = sorted(set(group["l_"].to_pylist()))
        data, off = text_view(group["w_"])
        tagger = ByteTagger(labels).fit(data, off[:-1], off[1:], np.searchsorted(np.array(labels), np.array(group["l_"].to_pylist())))
        names = [*tagger.w, *(f"label:{x}" for x in labels)]
        values = [tagger.w[k].tobytes() for k in tagger.w] + [b""] * len(labels)
        return pa.table({"name": pa.array(names), "value": pa.array(values, pa.binary())})

    made = rows.mapInArrow(parts, "h_ long, l_ string, w_ binary").groupBy(F.lit(1).alias("one")).applyInArrow(train, "name string, value binary").collect()
    labels = sorted(r.name[6:] for r in made if r.name.startswith("label:"))
    if not labels:
        return None
    tagger = ByteTagger(labels)
    for r in made:
        if r.name in tagger.w:
            tagger.w[r.name] = np.frombuffer(bytes(r.value), np.float32).reshape(tagger.w[r.name].shape)
    return tagger


def predict(docs: DataFrame, tagger: ByteTagger | None, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep..., lang_pred, score."""
    d = docs.select(F.col(key), *keep, F.col(text).alias("t_"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("some_"))
    if tagger is None:
        return d.select(key, *keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    names = np.array([*tagger.labels, "und"], object)

    def run(batches):
        known, sums = np.zeros(0, np.uint64), np.zeros((0, len(tagger.labels) + 1), np.float32)
        for batch in batches:
            data, off = text_view(batch.column("t_"))
            total = np.zeros((batch.num_rows, sums.shape[1]))
            for i, j in pieces(off):
                part = data[off[i] : off[j]]
                starts, ends, doc, lead, core = cut_words(part, off[i : j + 1] - off[i])
                if len(starts) == 0:
                    continue
                spans = span_hash(prefix_hash(part), starts, ends)
                parted = core != ends - starts  # of equal bytes, windows with another core are other windows
                spans[parted] = mix(spans[parted] + (lead[parted] * 256 + core[parted]).astype(np.uint64))
                h, where, back = np.unique(spans, return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                new = known[at] != h if len(known) else np.ones(len(h), bool)
                value = np.zeros((len(h), sums.shape[1]), np.float32)
                value[~new] = sums[at[~new]] if len(known) else value[~new]
                value[new] = tagger.word_sums(part, *(x[where[new]] for x in (starts, ends, lead, core)))
                if len(known) + new.sum() > MEMORY:
                    known, sums = h, value
                else:
                    known, sums = np.r_[known, h[new]], np.concatenate([sums, value[new]])
                    order = np.argsort(known, kind="stable")
                    known, sums = known[order], sums[order]
                weight = value[back]
                for c in range(sums.shape[1]):
                    total[i:j, c] += np.bincount(doc, weights=weight[:, c], minlength=j - i)
            p = total[:, :-1] / np.maximum(total[:, -1:], 1)
            some = batch.column("some_").to_numpy(zero_copy_only=False).astype(bool) & (total[:, -1] > 0)
            best = np.where(some, p.argmax(1), len(tagger.labels))
            score = np.where(some, np.clip(p.max(1), 0.0, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (key, *keep)], pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=[key, *keep, "lang_pred", "score"])

    kinds = dict(d.dtypes)
    return d.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep)) + ", lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    tagger = learn(docs.where(~F.col("held_out")), "text", "lang", "doc_id")
    return predict(docs, tagger, "doc_id", "text", ("held_out",))
