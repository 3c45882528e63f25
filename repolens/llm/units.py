"""Operator 1: substring deduplication by hashing lines and sentences.

A text is cut into units: lines, cut further after sentence ends and, so that passages without any are caught too,
at word pairs chosen by their hash (one in `cut_every`). A unit is normalised (ASCII lower case, white space dropped
to single gaps) and hashed to 128 bits. Over the whole table each digest's earliest occurrence, by (id, place), is
kept; every other occurrence is a repeat. Runs of consecutive repeats with at least `min_words` words together are
removed, so that a short sentence that recurs by chance stays where its neighbours are new. A whole line is removed
wherever it repeats a whole line: one of fewer words is a unit of its own besides, which only matches such lines (of a
longer one all units repeat). Removed runs are reported as byte offsets of the original.

Each Arrow batch keeps only the first occurrence of a digest for the exchange and marks the rest at once, so a
digest has one entry a batch at most, however many documents hold it; entries travel in packed buckets whose number
follows the input.

Defined cases: null text is empty; text without words has no units; rows of equal id and text count as one
document (they are no repeats of each other), rows of one id and different texts as two; an empty table gives no rows;
extra columns are ignored. Rows with a null id stand last, and those with equal texts count as one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, by_bucket, longs, lower_ascii, mix, pieces, powers, prefix_hash, row_key, span_hash, table, text_view, words
from .spans import bytes_in, cut

MIN_WORDS = 8
CUT_EVERY = 24
BUCKET_BYTES = 4 << 20

ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("place", "<i4"), ("start", "<i4"), ("end", "<i4"), ("words", "<i4")])
#: A whole line under min_words has its digest under another key and 0 words, here and in marks.
LINE = np.uint64(0xA0761D6478BD642F)
MARK = np.dtype([("place", "<i4"), ("start", "<i4"), ("end", "<i4"), ("words", "<i4")])


def units(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, cut_every: int = CUT_EVERY, min_words: int = MIN_WORDS) -> np.ndarray:
    """ENTRY rows of all units, in order, and of whole lines under min_words; start and end are bytes within their
    document. A line's place is that of its first unit. keys: the two longs of each document's key."""
    starts, ends, first = words(data, offsets)
    if len(starts) == 0:
        return np.zeros(0, ENTRY)
    h = span_hash(prefix_hash(lower_ascii(data)), starts, ends)
    doc = np.repeat(np.arange(len(keys)), np.diff(first))
    lines = np.r_[0, np.cumsum(data == 10)]
    pair = np.r_[mix(h[:-1] + h[1:] * np.uint64(3)), np.uint64(1)]
    last = data[ends - 1]
    close = (last == 46) | (last == 33) | (last == 63) | (pair % np.uint64(cut_every) == 0)
    line = np.r_[(lines[ends[:-1]] != lines[starts[1:]]) | (doc[:-1] != doc[1:]), True]
    stop = np.flatnonzero(close | line) + 1
    begin = np.r_[0, stop[:-1]]
    line_stop = np.flatnonzero(line) + 1
    line_begin = np.r_[0, line_stop[:-1]]
    short = line_stop - line_begin < min_words
    line_stop, line_begin, n = line_stop[short], line_begin[short], len(begin)
    first_unit = np.searchsorted(begin, line_begin)
    begin, stop = np.r_[begin, line_begin], np.r_[stop, line_stop]
    up, _ = powers(len(h) + 1)
    out = np.zeros(len(begin), ENTRY)
    for name, x in (("a", h), ("b", mix(h ^ np.uint64(0xD6E8FEB86659FD93)))):
        p = np.r_[np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)])]
        out[name] = span_hash(p, begin, stop)
    d = doc[begin]
    (out["k1"], out["k2"]), out["words"] = keys[d].T, stop - begin
    out["start"], out["end"] = starts[begin] - offsets[d], ends[stop - 1] - offsets[d]
    out["a"][n:], out["b"][n:], out["words"][n:] = mix(out["a"][n:] ^ LINE), mix(out["b"][n:] ^ LINE), 0
    at, d = np.arange(n), d[:n]
    out["place"][:n] = at - np.maximum.accumulate(np.where(np.r_[True, d[1:] != d[:-1]], at, 0))
    out["place"][n:] = out["place"][first_unit]
    return out


def repeats(e: np.ndarray) -> np.ndarray:
    """Which entries are no first occurrence of their digest; entries of equal digest, key and place count as one.
    Documents without an id (k2 < 0) stand last."""
    order = np.lexsort((e["place"], e["k2"], e["k1"], e["k2"] < 0, e["b"], e["a"]))
    s = e[order]
    head = np.r_[True, (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))
    out = np.zeros(len(e), bool)
    out[order] = (s["k1"] != s["k1"][lead]) | (s["k2"] != s["k2"][lead]) | (s["place"] != s["place"][lead])
    return out


def _marks(e: np.ndarray):
    """Both longs of the keys in e, and the packed MARK rows of each."""
    e = e[np.lexsort((e["k2"], e["k1"]))]
    m = np.zeros(len(e), MARK)
    for n in MARK.names:
        m[n] = e[n]
    at = np.flatnonzero(np.r_[True, (e["k1"][1:] != e["k1"][:-1]) | (e["k2"][1:] != e["k2"][:-1])]) if len(e) else np.zeros(0, int)
    return e["k1"][at], e["k2"][at], [m[i:j].tobytes() for i, j in zip(at, np.r_[at[1:], len(e)], strict=True)] if len(e) else []


def to_spans(min_words: int):
    def spans(marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        m = np.unique(np.concatenate([np.frombuffer(x, MARK) for x in marks]))
        lines, m = m[m["words"] == 0], m[m["words"] > 0]
        if len(m) == 0:
            return lines["start"].astype(np.int64), lines["end"].astype(np.int64)
        run = np.cumsum(np.r_[True, m["place"][1:] != m["place"][:-1] + 1]) - 1
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        last = np.r_[first[1:], len(m)] - 1
        keep = np.add.reduceat(m["words"], first) >= min_words
        return np.r_[m["start"][first][keep], lines["start"]].astype(np.int64), np.r_[m["end"][last][keep], lines["end"]].astype(np.int64)

    return spans


def unit_marks(docs: DataFrame, key: str = "doc_id", text: str = "text", cut_every: int = CUT_EVERY, min_words: int = MIN_WORDS) -> DataFrame:
    """k1_, k2_, mark: the repeated units of each document."""
    buckets = max(16, -(-bytes_in(docs, text) // BUCKET_BYTES))

    def emit(batches):
        schema = pa.schema([("bucket", pa.int32()), ("done", pa.bool_()), ("blob", pa.binary())])
        for batch in batches:
            data, off = text_view(batch.column("body_"))
            keys = np.stack(longs(batch, *ROW_KEY), 1)
            found = [units(data[off[i] : off[j]], off[i : j + 1] - off[i], keys[i:j], cut_every, min_words) for i, j in pieces(off)]
            e = np.concatenate(found) if found else np.zeros(0, ENTRY)
            if len(e) == 0:
                continue
            again = repeats(e)
            rows = [(int(keys[0, 0] % buckets), True, e[again].tobytes())] if again.any() else []
            e = e[~again]
            rows += [(k, False, blob) for k, blob in zip(*by_bucket(e, (e["a"] % np.uint64(buckets)).astype(np.int64)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], schema=schema)

    def settle(group: pa.Table) -> pa.Table:
        done = [np.frombuffer(x, ENTRY) for d, x in zip(group["done"].to_pylist(), group["blob"].to_pylist(), strict=True) if d]
        open_ = [np.frombuffer(x, ENTRY) for d, x in zip(group["done"].to_pylist(), group["blob"].to_pylist(), strict=True) if not d]
        if open_:
            e = np.concatenate(open_)
            done.append(e[repeats(e)])
        k1, k2, marks = _marks(np.concatenate(done))
        return pa.table({"k1_": pa.array(k1, pa.int64()), "k2_": pa.array(k2, pa.int64()), "mark": pa.array(marks, pa.binary())})

    packed = docs.select(*row_key(key, text), F.col(text).alias("body_")).mapInArrow(emit, "bucket int, done boolean, blob binary")
    return packed.groupBy("bucket").applyInArrow(settle, "k1_ long, k2_ long, mark binary")


def unit_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, cut_every: int = CUT_EVERY, with_text: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, removed, and kept_text on request."""
    return cut(docs, unit_marks(docs, key, text, cut_every, min_words), to_spans(min_words), key, text, with_text)


def op1_unit_dedup(spark, sf_dir: str) -> DataFrame:
    return unit_dedup(table(spark, sf_dir, "documents"))
