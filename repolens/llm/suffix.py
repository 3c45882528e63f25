"""Operator 2: suffix-array deduplication with a logarithmic family of indexes.

Every byte that lies in a string of `length` bytes which also starts elsewhere, in the same document or another, is
removed. The string starting at a place is its suffix, cut at `length` bytes. A `SuffixFamily` holds suffixes in sorted
arrays of doubling size: a new batch is sorted, compared with its own neighbours and merge-scanned against each level,
then joins the family, and levels of equal size merge geometrically.

One family for a whole corpus would be one task, so suffixes are dealt out so that equal ones meet:

1. Each window of `length` bytes names an anchor: of the `gram`-byte strings in it, the one of least hash (the leftmost
   of equals). Equal windows have the same anchor at the same offset, and neighbouring windows mostly share theirs, so
   the windows of a document form runs. A run travels as 48 bytes: anchor hash, hash of its whole text, place. Copies
   of a run within an Arrow batch are settled at once and leave one entry.
2. In an anchor's bucket, runs that occur twice are repeats as they stand; anchors with a single run are no repeats.
   What is left, runs whose anchor has several different texts, is compared suffix by suffix.
3. The texts of those runs are cut from the documents and go to families by anchor; where an anchor has very many
   different runs, by anchor and the bytes to its right or left, whichever half of the window is the longer.
4. Verdicts go back to the documents.

Defined cases: null text is empty; documents under `length` bytes lose nothing; rows of equal id and text count as
one document, rows of one id and different texts as two; an empty table gives no rows; extra columns are ignored; rows with a null id count as one document
if their texts are equal, and keep their null id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, ROW_KEY, by_bucket, longs, materialise, pieces, prefix_hash, row_key, span_hash, table, text_view
from .spans import bytes_in, cut

LENGTH = 200
GRAM = 80
BUCKET_BYTES = 4 << 20
#: Different runs of one anchor beyond which its suffixes are dealt out by their halves.
MANY = 2000

RUN = np.dtype([("anchor", "<u8"), ("text", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("start", "<i4"), ("windows", "<u2"), ("at", "<u2"), ("copies", "<u4")])
#: state: 1 the whole run repeats, 2 to be compared, 3 as 1 and also needed in comparisons; +4: dealt out by halves.
MARK = np.dtype([("start", "<i4"), ("windows", "<u2"), ("at", "<u2"), ("state", "u1")])


class SuffixFamily:
    """Suffixes of `length` bytes in sorted arrays of geometrically growing size. repeated[i] tells whether the i-th
    suffix added so far has an equal elsewhere in the family."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (sorted keys, their numbers), largest first
        self.repeated = np.zeros(0, bool)

    def _keys(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        rows = np.lib.stride_tricks.sliding_window_view(data, self.length)[places]
        return np.ascontiguousarray(rows).view(f"S{self.length}").ravel()

    def add(self, data: np.ndarray, places: np.ndarray) -> None:
        if len(places) == 0:
            return
        numbers = np.arange(len(places)) + len(self.repeated)
        self.repeated = np.r_[self.repeated, np.zeros(len(places), bool)]
        keys = self._keys(data, places)
        order = np.argsort(keys, kind="stable")
        keys, numbers = keys[order], numbers[order]
        same = keys[1:] == keys[:-1]
        self.repeated[numbers[1:][same]] = self.repeated[numbers[:-1][same]] = True
        for known, theirs in self.levels:
            self._scan(known, theirs, keys, numbers)
        self.levels.append((keys, numbers))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (b, bn), (a, an) = self.levels.pop(), self.levels.pop()
            at = np.searchsorted(a, b, side="right") + np.arange(len(b))
            keys, numbers = np.empty(len(a) + len(b), a.dtype), np.empty(len(a) + len(b), np.int64)
            rest = np.ones(len(keys), bool)
            rest[at] = False
            keys[at], keys[rest], numbers[at], numbers[rest] = b, a, bn, an
            self.levels.append((keys, numbers))

    def _scan(self, known: np.ndarray, theirs: np.ndarray, keys: np.ndarray, numbers: np.ndarray) -> None:
        left = np.searchsorted(known, keys, side="left")
        hit = known[np.minimum(left, len(known) - 1)] == keys
        self.repeated[numbers[hit]] = True
        # one of equal suffixes in a level was marked when it met another; a lone one is marked here
        self.repeated[theirs[left[hit]]] = True


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by block-wise running minima."""
    n = len(key) - w + 1
    blocks = -(-len(key) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """RUN rows of the documents that lie in data (keys: both longs of each); a document longer than PIECE_BYTES is taken in overlapping parts."""
    found = []
    for a in range(0, max(1, len(data) - length + 1), PIECE_BYTES):
        part = data[a : a + PIECE_BYTES + length - 1]
        if len(part) >= length:
            found.append(_runs(part, a, offsets, keys, length, gram))
    return np.concatenate(found) if found else np.zeros(0, RUN)


def _runs(data, base, offsets, keys, length, gram):
    prefix = prefix_hash(data)
    place = np.arange(len(data) - gram + 1)
    h = span_hash(prefix, place, place + gram)
    w = length - gram + 1
    low = np.uint64((1 << 22) - 1)  # PIECE_BYTES + length < 2^22
    least = _least((h & ~low) | place.astype(np.uint64), w)
    window = np.arange(len(least))
    doc = np.searchsorted(offsets, window + base, side="right") - 1
    inside = window + base + length <= offsets[np.minimum(doc + 1, len(offsets) - 1)]
    window, doc, anchor = window[inside], doc[inside], (least[inside] & low).astype(np.int64)
    if len(window) == 0:
        return np.zeros(0, RUN)
    head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[head[1:], len(window)] - 1
    out = np.zeros(len(head), RUN)
    start, a, d = window[head], anchor[head], doc[head]
    out["anchor"], out["text"] = h[a], span_hash(prefix, start, window[last] + length)
    (out["k1"], out["k2"]), out["start"], out["windows"], out["at"], out["copies"] = keys[d].T, start + base - offsets[d], window[last] - start + 1, a - start, 1
    return out


def _grouped(r: np.ndarray):
    """r sorted by (anchor, text, key, start); the heads of anchors, of equal runs and of rows of one occurrence."""
    r = r[np.lexsort((r["start"], r["k2"], r["k1"], r["text"], r["anchor"]))]
    new_anchor = np.r_[True, r["anchor"][1:] != r["anchor"][:-1]]
    new_run = new_anchor | np.r_[True, r["text"][1:] != r["text"][:-1]]
    new = new_run | np.r_[True, (r["k1"][1:] != r["k1"][:-1]) | (r["k2"][1:] != r["k2"][:-1]) | (r["start"][1:] != r["start"][:-1])]
    return r, new_anchor, new_run, new


def _pack(r: np.ndarray, state: np.ndarray):
    order = np.lexsort((r["k2"], r["k1"]))
    r, m = r[order], np.zeros(len(r), MARK)
    m["start"], m["windows"], m["at"], m["state"] = r["start"], r["windows"], r["at"], state[order]
    at = np.flatnonzero(np.r_[True, (r["k1"][1:] != r["k1"][:-1]) | (r["k2"][1:] != r["k2"][:-1])]) if len(r) else np.zeros(0, int)
    return pa.table({"k1_": pa.array(r["k1"][at], pa.int64()), "k2_": pa.array(r["k2"][at], pa.int64()), "mark": pa.array([m[i:j].tobytes() for i, j in zip(at, np.r_[at[1:], len(r)], strict=True)] if len(r) else [], pa.binary())})


def run_marks(docs: DataFrame, buckets: int, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """k1_, k2_, mark: the runs of each document that repeat or must be compared."""

    def emit(batches):
        schema = pa.schema([("bucket", pa.int32()), ("done", pa.bool_()), ("blob", pa.binary())])
        for batch in batches:
            data, off = text_view(batch.column("body_"))
            keys = np.stack(longs(batch, *ROW_KEY), 1)
            found = [runs(data[off[i] : off[j]], off[i : j + 1] - off[i], keys[i:j], length, gram) for i, j in pieces(off)]
            r = np.concatenate(found) if found else np.zeros(0, RUN)
            if len(r) == 0:
                continue
            r, _, new_run, new = _grouped(r)
            r, new_run = r[new], new_run[new]
            group = np.cumsum(new_run) - 1
            count = np.bincount(group)
            again = ~new_run
            rows = [(int(keys[0, 0] % buckets), True, r[again].tobytes())] if again.any() else []
            r["copies"] = count[group]
            r = r[new_run]
            rows += [(k, False, blob) for k, blob in zip(*by_bucket(r, (r["anchor"] % np.uint64(buckets)).astype(np.int64)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows]), pa.array([x[2] for x in rows], pa.binary())], schema=schema)

    def settle(group: pa.Table) -> pa.Table:
        blobs = list(zip(group["done"].to_pylist(), group["blob"].to_pylist(), strict=True))
        done = np.concatenate([np.zeros(0, RUN), *[np.frombuffer(x, RUN) for d, x in blobs if d]])
        r = np.concatenate([np.zeros(0, RUN), *[np.frombuffer(x, RUN) for d, x in blobs if not d]])
        state = np.zeros(0, np.uint8)
        if len(r):
            r, new_anchor, new_run, new = _grouped(r)
            # equal rows of two batches are the same occurrence in a repeated row
            run, anchor = np.cumsum(new_run) - 1, np.cumsum(new_anchor) - 1
            copies = np.bincount(run, weights=np.where(new, r["copies"], 0))[run]
            kinds = np.bincount(anchor, weights=new_run)[anchor]
            whole, mixed = copies > 1, kinds > 1
            state = np.where(whole, np.where(mixed & new_run, 3, 1), np.where(mixed, 2, 0)).astype(np.uint8)
            state[(state > 1) & (kinds > MANY)] += 4
            r, state = r[state > 0], state[state > 0]
        return _pack(np.concatenate([done, r]), np.r_[np.ones(len(done), np.uint8), state])

    packed = docs.select(*ROW_KEY, "body_").mapInArrow(emit, "bucket int, done boolean, blob binary")
    return packed.groupBy("bucket").applyInArrow(settle, "k1_ long, k2_ long, mark binary")


TEXT = [("shard", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("needs", pa.bool_()), ("body", pa.binary())]


def _texts(shards: int, length: int, gram: int):
    """The texts of the runs to be compared, by shard."""
    half = (length - gram) // 2

    def run(batches):
        schema = pa.schema(TEXT)
        for batch in batches:
            data, off = text_view(batch.column("body_"))
            rows = {name: [] for name, _ in TEXT}
            k1, k2 = (x.tolist() for x in longs(batch, *ROW_KEY))
            held = 0
            for i, marks in enumerate(batch.column("marks_").to_pylist()):
                m = np.unique(np.concatenate([np.frombuffer(x, MARK) for x in marks]))
                body = data[off[i] : off[i + 1]]
                m = m[m["state"] > 1]
                if len(m) == 0:
                    continue
                prefix = prefix_hash(body)
                start = m["start"].astype(np.int64)
                at = start + m["at"]
                anchor = span_hash(prefix, at, at + gram)
                # windows that start at most `half` before the anchor hold `half` bytes after it; the others, before
                far = np.maximum(0, np.minimum(m["windows"].astype(np.int64), m["at"].astype(np.int64) - (length - gram - half)))
                for j in range(len(m)):
                    parts = [(int(start[j]), int(m["windows"][j]), int(anchor[j]))]
                    if m["state"][j] & 4:
                        parts, f, n = [], int(far[j]), int(m["windows"][j])
                        if f:
                            parts.append((int(start[j]), f, int(anchor[j]) ^ xxhash.xxh3_64_intdigest(body[at[j] - half : at[j]].tobytes())))
                        if n > f:
                            parts.append((int(start[j]) + f, n - f, int(anchor[j]) ^ xxhash.xxh3_64_intdigest(body[at[j] + gram : at[j] + gram + length - gram - half].tobytes(), seed=1)))
                    for s, n, k in parts:
                        rows["shard"].append(k % shards)
                        rows["k1"].append(k1[i])
                        rows["k2"].append(k2[i])
                        rows["start"].append(s)
                        rows["windows"].append(n)
                        rows["needs"].append(bool(m["state"][j] & 3 == 2))
                        rows["body"].append(body[s : s + n + length - 1].tobytes())
                        held += n + length
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)
                    rows, held = {name: [] for name, _ in TEXT}, 0
            if rows["k1"]:
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return run


def _compare(length: int, batch_windows: int = 50_000):
    """Feeds a shard's runs, in batches, to a family; gives MARK rows (state 1) for the windows that repeat."""

    def run(group: pa.Table) -> pa.Table:
        # the same occurrence may stand in repeated rows
        group = group.combine_chunks()
        k1, k2, start, windows = (group[c].to_numpy().astype(np.int64) for c in ("k1", "k2", "start", "windows"))
        needs = group["needs"].to_numpy(zero_copy_only=False)
        order = np.lexsort((start, k2, k1))
        k1, k2, start, windows, needs = k1[order], k2[order], start[order], windows[order], needs[order]
        first = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (start[1:] != start[:-1])]
        k1, k2, start, windows, needs, order = k1[first], k2[first], start[first], windows[first], needs[first], order[first]
        body = group["body"].take(pa.array(order))
        family = SuffixFamily(length)
        done, total = 0, np.cumsum(windows)
        while done < len(k1):
            stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + batch_windows, side="right")))
            data, off = text_view(body.slice(done, stop - done))
            n = windows[done:stop]
            at = np.repeat(off[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            family.add(data, at)
            done = stop
        hit = family.repeated & np.repeat(needs, windows)
        owner = np.repeat(np.arange(len(k1)), windows)
        place = np.arange(len(owner)) - np.repeat(total - windows, windows) + np.repeat(start, windows)
        owner, place = owner[hit], place[hit]
        if len(owner) == 0:
            return pa.table({"k1_": pa.array([], pa.int64()), "k2_": pa.array([], pa.int64()), "mark": pa.array([], pa.binary())})
        head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)])
        last = np.r_[head[1:], len(owner)] - 1
        r = np.zeros(len(head), RUN)
        r["k1"], r["k2"], r["start"], r["windows"] = k1[owner[head]], k2[owner[head]], place[head], place[last] - place[head] + 1
        return _pack(r, np.ones(len(r), np.uint8))

    return run


def to_spans(length: int):
    def spans(marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        m = np.concatenate([np.frombuffer(x, MARK) for x in marks])
        m = m[(m["state"] & 1) == 1]
        start = m["start"].astype(np.int64)
        return start, start + m["windows"] + (length - 1)

    return spans


def suffix_marks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """k1_, k2_, mark of the windows that repeat; docs: k1_, k2_, body_."""
    buckets = max(16, -(-bytes_in(docs, "body_") // BUCKET_BYTES))
    marks = materialise(run_marks(docs, buckets, length, gram), "suffix-runs")
    open_ = marks.groupBy(*ROW_KEY).agg(F.collect_list("mark").alias("marks_"))
    texts = docs.join(open_, list(ROW_KEY)).select(*ROW_KEY, "body_", "marks_")
    texts = texts.mapInArrow(_texts(buckets, length, gram), "shard long, k1 long, k2 long, start int, windows int, needs boolean, body binary")
    verdicts = texts.groupBy("shard").applyInArrow(_compare(length), "k1_ long, k2_ long, mark binary")
    return marks.unionByName(verdicts)


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, removed; kept_text on request; the columns in keep."""
    own = docs.select(*row_key(key, text), F.col(text).alias("body_"))
    return cut(docs, suffix_marks(own, length, gram), to_spans(length), key, text, with_text, keep)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
