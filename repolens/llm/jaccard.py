"""Operator 6: exact Jaccard self-join on word shingles by universe partition, and its connected components.

A document's set holds the 64-bit hashes of its distinct shingles; documents of equal sets are one node of the link
graph. Two sets of r <= s shingles reach the threshold t only if their difference is at most (1-t)/(1+t) * (r+s).

*Size bands.* Pairs whose larger set lies in a band are sought in that band's key space, with the number of segments
that its largest size asks for. A document joins the key space of its own band and, if its size allows, the next.

*Pigeonhole.* Hash ranges divide the universe into segments; what a set has in a segment is a subset of it that is
indexed by its hash. If segment i may differ by d_i (0, or 1 through the one-deletion neighbourhood) and the sum of
(d_i + 1) exceeds the largest difference, some segment of a linked pair matches. `allocate` divides segments between
d = 0 and d = 1 by expected cost: signatures written, and the chance that unlike documents meet. Deletions multiply the
signatures by a segment's size, so they pay for small sets, whose few segments would match too often. Bands with d = 0
get some spare segments, so that a pair shares more than one; documents with no more empty segments than that leave
empty ones, which match too often, out of the index.

*Candidates.* The nodes of a signature's group are filed under the least of them and under their size, in classes of
which linked nodes share one (`by_size`); once for a node, whatever the number of signatures. A hub's nodes are compared
there twice, by counters (a lower bound of the difference) and, those that are left with a possible partner, by their
full sets. Each time a block of nodes meets the hub's least node first; only nodes that this doesn't settle, far from it
or not linked to it, meet all others, in pairs of blocks that are rows of their own (`under_hubs`). So copies cost a
comparison each, no group is one task, and what a task returns is at most proportional to its nodes: links that span
a component, not all of its pairs.

*Verification* intersects the full sets. Texts are read again for nodes with candidates only; a Bloom filter of fixed
size thins the documents before the join that decides.

Defined cases: null and blank texts have no set and link with nothing; a text of fewer words than a shingle is one
shingle; rows of one id and different texts are told apart; repeated rows fall into the same component; an empty table
gives no rows; extra columns are ignored. Rows with a null id link like others; they name no component: it is null where
no row of it has an id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, by_bucket, longs, lower_ascii, materialise, mix, pieces, prefix_hash, row_key, span_hash, table, text_view, words

WORDS = 5
THRESHOLD = 80  # per cent
BUCKET_BYTES = 4 << 20
BLOOM_BITS = 1 << 25
SKETCH = 64
#: Nodes of a hub that are compared in one task; more are dealt out in pairs of blocks.
BLOCK = 512
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def most_difference(total, threshold: int = THRESHOLD):
    """Largest symmetric difference of linked sets whose sizes sum to total: (1-t)/(1+t) * total, in integers."""
    return (100 - threshold) * total // (100 + threshold)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, one after the other, and where each document's begin."""
    n_docs = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    h = span_hash(prefix_hash(lower_ascii(data)), starts, ends)
    n = np.diff(first)
    step = np.arange(1, 2 * k, 2, dtype=np.uint64)
    pad = np.r_[h, np.zeros(k, np.uint64)]
    acc = np.zeros(len(h), np.uint64)
    for i in range(k):
        acc = acc + mix(pad[i : i + len(h)] + (_K[i % len(_K)] ^ step[i]))
    acc = mix(acc)
    out, size = [], np.zeros(n_docs, np.int64)
    for d in np.flatnonzero(n):
        a = first[d]
        if n[d] < k:
            s = mix(np.array([int(n[d])], np.uint64) * _K[4] + np.add.reduce(mix(h[a : a + n[d]] + _K[1] * np.arange(1, n[d] + 1, dtype=np.uint64))))
        else:
            s = np.sort(acc[a : a + n[d] - k + 1])
            s = s[np.r_[True, s[1:] != s[:-1]]]
        out.append(s)
        size[d] = len(s)
    return np.concatenate(out), np.r_[0, np.cumsum(size)]


def nodes_of(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 63-bit number for each document's set; -1 for the empty one."""
    out = np.full(len(at) - 1, -1, np.int64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = (mix(np.add.reduceat(mix(sets ^ _K[2]), at[full]) + np.diff(at)[full].astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
    return out


def allocate(largest: int, docs: int, threshold: int = THRESHOLD) -> tuple[int, int, int]:
    """(segments with d = 1, segments with d = 0, spare) for a band of sets of up to `largest` shingles, of which
    there are about docs. The cheapest by signatures plus expected meetings of unlike documents; sets that share
    nothing meet in a segment only if it is empty in both (or, with d = 1, holds one shingle between them)."""
    need = most_difference(2 * largest, threshold) + 1
    best = None
    for ones in range(0, min((need + 1) // 2, 4) + 1):
        zeros = max(0, need - 2 * ones)
        spare = 0
        if zeros > 4:  # as many as the smallest sets of the key space leave empty, most of the time
            least = threshold / 150 * largest
            for _ in range(20):
                empty = (ones + zeros + spare) * math.exp(-least / (ones + zeros + spare))
                spare = math.ceil(empty + 2 * math.sqrt(empty))
        mean = 0.8 * largest / (ones + zeros + spare)
        signatures = ones * (mean + 1) + zeros + spare
        # a few empty segments are left out where spare ones are there
        meetings = docs * (ones * math.exp(-2 * mean) * (1 + 2 * mean) + (0 if spare else zeros) * math.exp(-2 * mean))
        if best is None or signatures + meetings < best[0]:
            best = signatures + meetings, ones, zeros + spare, spare
    return best[1:]


class Bands:
    def __init__(self, docs: int, threshold: int = THRESHOLD, largest: int = 1 << 26):
        self.threshold, low = threshold, [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, math.ceil(low[-1] * 1.5)))
        self.low = np.array(low, np.int64)
        plan = np.array([allocate(int(b) - 1, max(1, docs // 16), threshold) for b in self.low[1:]], np.int64)
        self.ones, self.zeros, self.spare = plan.T

    def spaces(self, size: np.ndarray):
        """(documents, key space) to index: each document's own band, and the next if a set of that band can link."""
        own = np.searchsorted(self.low, size, side="right") - 1
        yield np.flatnonzero(size > 0), own
        yield np.flatnonzero((size > 0) & (100 * size >= self.threshold * self.low[np.minimum(own + 1, len(self.low) - 1)])), own + 1


def signatures(sets: np.ndarray, at: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """48-bit signatures and their documents."""
    size = np.diff(at)
    sigs, owners = [], []
    for chosen, space in bands.spaces(size):
        if len(chosen) == 0:
            continue
        keep = np.zeros(len(size), bool)
        keep[chosen] = True
        doc = np.repeat(np.arange(len(size)), size)
        mine = keep[doc]
        tok, doc = sets[mine], doc[mine]
        ones, total = bands.ones[space], (bands.ones + bands.zeros)[space]
        seg = (((tok >> np.uint64(32)) * total[doc].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (seg[1:] != seg[:-1])])
        value = mix(tok ^ _K[3])
        inner = np.add.reduceat(value, head)
        d, s = doc[head], seg[head]
        place = lambda d, s: mix(space[d].astype(np.uint64) * np.uint64(1 << 32) + s.astype(np.uint64) + np.uint64(1))
        sigs.append(mix(inner + place(d, s)))
        owners.append(d)
        # one-deletion neighbourhoods of the first segments
        near = s < ones[d]
        if near.any():
            length = np.diff(np.r_[head, len(tok)])
            group = np.repeat(np.arange(len(head)), length)
            pick = near[group]
            sigs.append(mix(inner[group[pick]] - value[pick] + place(d[group[pick]], s[group[pick]])))
            owners.append(doc[pick])
        # empty segments: always those with d = 1; the others where there are more of them than spare ones
        filled = np.bincount(d, minlength=len(size))
        filled_ones = np.bincount(d[near], minlength=len(size))
        empty_zero = total - ones - (filled - filled_ones)
        weak = chosen[(filled_ones[chosen] < ones[chosen]) | (empty_zero[chosen] > bands.spare[space][chosen])]
        if len(weak):
            bounds = np.searchsorted(d, np.r_[weak, weak + 1])
            for j, x in enumerate(weak):
                have = s[bounds[j] : bounds[len(weak) + j]]
                lack = np.setdiff1d(np.arange(total[x]), have, assume_unique=True)
                if empty_zero[x] <= bands.spare[space][x]:
                    lack = lack[lack < ones[x]]
                sigs.append(mix(place(np.full(len(lack), x), lack)))
                owners.append(np.full(len(lack), x))
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs) >> np.uint64(16), np.concatenate(owners)


ENTRY = np.dtype([("low", "<u4"), ("high", "<u2"), ("node", "<i8")])


def _batches(batch, k: int):
    """(first and last row, sets, at, nodes) of the pieces of an Arrow batch."""
    data, off = text_view(batch.column("body_"))
    for i, j in pieces(off):
        sets, at = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
        yield i, j, sets, at, nodes_of(sets, at)


def node_table(docs: DataFrame, k: int) -> DataFrame:
    """own_, k1_, k2_, n, node, sketch (counts of a byte each: their distance is at most the sets' difference)."""
    keys = ("own_", *ROW_KEY)

    def run(batches):
        for batch in batches:
            for i, j, sets, at, nodes in _batches(batch, k):
                n = np.diff(at)
                doc = np.repeat(np.arange(j - i), n)
                c = cells(n)
                edge = np.r_[0, np.cumsum(c)]
                cell = edge[doc] + (sets & (c[doc] - 1).astype(np.uint64)).astype(np.int64)
                counts = np.minimum(np.bincount(cell, minlength=edge[-1]), 255).astype(np.uint8)
                made = [pa.array(n), pa.array(nodes, mask=n == 0), pa.array([counts[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[batch.column(x).slice(i, j - i) for x in keys], *made], names=[*keys, "n", "node", "sketch"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"{x} {kinds[x]}" for x in keys) + ", n long, node long, sketch binary")


def candidates(docs: DataFrame, buckets: int, bands: Bands, k: int) -> DataFrame:
    """(hub, node): nodes that share a signature with the hub, the least node of its group; distinct within a bucket."""

    def emit(batches):
        schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
        for batch in batches:
            found = []
            for _, _, sets, at, nodes in _batches(batch, k):
                sig, owner = signatures(sets, at, bands)
                e = np.zeros(len(sig), ENTRY)
                e["low"], e["high"], e["node"] = sig & np.uint64(0xFFFFFFFF), sig >> np.uint64(32), nodes[owner]
                found.append(e)
            e = np.concatenate(found) if found else np.zeros(0, ENTRY)
            if len(e) == 0:
                continue
            e = e[np.lexsort((e["node"], e["low"]))]
            e = e[np.r_[True, e[1:] != e[:-1]]]  # copies within the batch
            full, blobs = by_bucket(e, e["low"] % buckets)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    def settle(group: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x, ENTRY) for x in group["blob"].to_pylist()])
        sig = e["low"].astype(np.uint64) | (e["high"].astype(np.uint64) << np.uint64(32))
        node = e["node"].copy()
        order = np.argsort(sig, kind="stable")
        sig, node = sig[order], node[order]
        some = np.r_[False, sig[1:] == sig[:-1]]
        some[:-1] |= some[1:]
        sig, node = sig[some], node[some]
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        head = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, int)
        hub = np.repeat(node[head], np.diff(np.r_[head, len(sig)]))
        pairs = np.unique(np.stack([hub, node], 1)[hub != node], axis=0)
        return pa.table({"hub": pa.array(pairs[:, 0].copy()), "node": pa.array(pairs[:, 1].copy())})

    packed = docs.mapInArrow(emit, "bucket int, blob binary")
    return packed.groupBy("bucket").applyInArrow(settle, "hub long, node long")


def cells(n: np.ndarray) -> np.ndarray:
    """Counters of a set of n: a power of two, half of n and SKETCH at least."""
    return np.left_shift(1, np.ceil(np.log2(np.maximum(SKETCH, n / 2))).astype(np.int64))


def difference_bound(p: np.ndarray, q: np.ndarray) -> int:
    """A lower bound of the difference of two sets from their counters; the longer list is folded."""
    c = min(len(p), len(q))
    return int(np.abs(p.astype(np.int32).reshape(-1, c).sum(0) - q.astype(np.int32).reshape(-1, c).sum(0)).sum())


def by_size(pairs: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """(hub, node): each hub's nodes (hub, node and the hub itself) split by size. A class spans a factor of 1/t, so linked
    nodes are of the same or neighbouring classes; a node is filed under its own and the next. sizes: node, n."""
    every = pairs.unionByName(pairs.select("hub", F.col("hub").alias("node")).distinct())
    own = F.floor(F.log("n") / F.log(F.lit(max(100 / threshold, 1.01)))).cast("int")
    filed = every.join(sizes, "node").select("hub", "node", F.explode(F.array(own, own + 1)).alias("size"))
    return filed.select(F.xxhash64("hub", "size").alias("hub"), "node")


def under_hubs(pairs: DataFrame, payload: DataFrame, compare, name: str) -> DataFrame:
    """(a, b) that compare finds among the nodes of each hub. pairs: hub, node, distinct; payload: node and what compare
    needs. compare(rows, apart) gets the hub's least node (lead) and a block of the others, and returns (a, b) rows
    and the nodes that the lead doesn't settle; these then meet the nodes of the other blocks: compare(rows, apart) with
    apart telling which rows are of which side, only pairs of both sides count."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("node").alias("least"), F.count(F.lit(1)).alias("n_")).where("n_ > 1").drop("n_")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    own = pairs.join(sizes, "hub").where("node <> least").select("hub", "node", place("blocks").alias("i"), F.lit(0).alias("j"), F.lit(False).alias("lead"), "blocks")
    lead = sizes.select("hub", F.col("least").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("lead"), "blocks")

    def tasks(apart: bool):
        def run(group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            a, b, open_ = compare(group, apart)
            hub = group["hub"][0].as_py()
            if apart or group["blocks"][0].as_py() == 1:
                open_ = open_[:0]
            return pa.table({"hub": pa.array(np.full(len(a) + len(open_), hub)), "a": pa.array(np.r_[a, open_]), "b": pa.array(np.r_[b, np.zeros(len(open_), np.int64)]), "open": pa.array(np.r_[np.zeros(len(a), bool), np.ones(len(open_), bool)])})

        return run

    schema = "hub long, a long, b long, open boolean"
    first = materialise(own.unionByName(lead).join(payload, "node").groupBy("hub", "i").applyInArrow(tasks(False), schema), name)
    found, rest = first.where("NOT open").select("hub", "a", "b"), first.where("open").select("hub", F.col("a").alias("node")).distinct()
    if rest.limit(1).count():
        wide = rest.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("rest")).join(sizes, "hub")
        other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rest.join(wide, "hub").select("hub", "node", place("rest").alias("i"), other("blocks").alias("j"), F.lit(True).alias("lead"), "blocks")
        right = pairs.join(wide, "hub").select("hub", "node", other("rest").alias("i"), place("blocks").alias("j"), F.lit(False).alias("lead"), "blocks")
        cross = left.unionByName(right).join(payload, "node").groupBy("hub", "i", "j").applyInArrow(tasks(True), schema)
        found = found.unionByName(materialise(cross, name).select("hub", "a", "b"))
    return found


def _folded(raw: np.ndarray, off: np.ndarray, width: np.ndarray):
    """For each width that occurs: rows of that width and their counters."""
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        yield int(w), rows, raw[off[rows][:, None] + np.arange(w)]


def hopeful(threshold: int):
    """Compares counters: (node, 0) for each node with a partner that sizes and counters allow. Open: nodes far from the
    lead."""

    def compare(group: pa.Table, apart: bool):
        node, n, lead = group["node"].to_numpy(), group["n"].to_numpy(), group["lead"].to_numpy(zero_copy_only=False)
        raw, off = text_view(group["sketch"])
        classes = list(_folded(raw, off, cells(n)))
        hit = np.zeros(len(n), bool)

        def meet(of: np.ndarray, others: np.ndarray) -> None:
            """Marks rows of both sides with a near one in the other; widths of near sizes are equal or neighbours."""
            for w, rows, counts in classes:
                for w2, rows2, counts2 in classes:
                    if w2 not in (w, 2 * w, w // 2):
                        continue
                    p, q = of[rows], others[rows2]
                    x, y, rx, ry = counts[p], counts2[q], rows[p], rows2[q]
                    if len(rx) == 0 or len(ry) == 0:
                        continue
                    c = min(w, w2)
                    x, y = (v if v.shape[1] == c else v.reshape(len(v), -1, c).sum(1, dtype=np.int16) for v in (x, y))
                    x, y = (x, y) if w == w2 else (x.astype(np.int16), y.astype(np.int16))
                    order = np.argsort(n[ry], kind="stable")
                    ry, y = ry[order], y[order]
                    for at in range(len(rx)):
                        m = n[rx[at]]
                        lo, hi = np.searchsorted(n[ry], -(-m * threshold // 100)), np.searchsorted(n[ry], m * 100 // threshold, side="right")
                        if lo == hi:
                            continue
                        far = (np.maximum(x[at], y[lo:hi]) - np.minimum(x[at], y[lo:hi])).sum(1, dtype=np.int32)
                        ok = (far <= most_difference(m + n[ry[lo:hi]], threshold)) & (ry[lo:hi] != rx[at]) & (node[ry[lo:hi]] != node[rx[at]])
                        hit[ry[lo:hi][ok]] = True
                        hit[rx[at]] |= ok.any()

        if apart:
            meet(lead, ~lead)
            open_ = node[:0]
        else:
            meet(lead, ~lead)
            away = ~hit & ~lead
            meet(away, ~lead)
            open_ = node[away]
        found = np.unique(node[hit])
        return found, np.zeros(len(found), np.int64), open_

    return compare


def linked(threshold: int):
    """Compares full sets: links that join the nodes of each component. Open: nodes that are not in the lead's."""

    def compare(group: pa.Table, apart: bool):
        node, lead = group["node"].to_numpy(), group["lead"].to_numpy(zero_copy_only=False)
        raw, off = text_view(group["tokens"])
        at = off[:-1] // 8
        size = np.diff(off) // 8
        number, token = np.unique(np.frombuffer(raw.tobytes(), np.uint64), return_inverse=True)
        parent, mark = np.arange(len(node)), np.zeros(len(number), np.int32)
        a, b = [], []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def meet(x: int) -> None:
            own = token[at[x] : at[x] + size[x]]
            mark[own] = 1
            common = np.add.reduceat(mark[token], at)
            mark[own] = 0
            ok = (100 * common >= threshold * (size + size[x] - common)) & (node != node[x])
            if apart:
                ok &= ~lead
            for y in np.flatnonzero(ok).tolist():
                p, q = root(x), root(y)
                if p != q:
                    parent[q] = p
                    a.append(node[x])
                    b.append(node[y])

        # the lead first; then whatever is not in its component meets all
        if apart:
            for x in np.flatnonzero(lead).tolist():
                meet(x)
            open_ = node[:0]
        else:
            first = int(np.flatnonzero(lead)[0])
            meet(first)
            for x in [x for x in range(len(node)) if root(x) != root(first)]:
                meet(x)
            open_ = node[[x for x in range(len(node)) if root(x) != root(first)]]
        return np.array(a, np.int64), np.array(b, np.int64), open_

    return compare


def bloom(keys: DataFrame, columns: tuple[str, ...]) -> np.ndarray:
    """A Bloom filter of BLOOM_BITS bits, whatever the number of keys."""
    spots = keys.select(F.explode(F.array(*spots_of(columns))).alias("x"))
    cells = spots.groupBy(F.shiftright("x", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, int(x & 63))")).alias("bits")).toArrow()
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return out


def spots_of(columns: tuple[str, ...]):
    return [F.pmod(F.xxhash64(*columns, F.lit(i)), F.lit(BLOOM_BITS)) for i in range(2)]


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, tokens of the wanted nodes, written down. Each node's set comes from one document that has it."""
    spark = docs.sparkSession
    holders = nodes.where("node IS NOT NULL").join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(*ROW_KEY)).alias("m"))
    holders = materialise(holders.select(*[F.col(f"m.{c}").alias(c) for c in ROW_KEY]), "jaccard-holders")
    bits = spark.sparkContext.broadcast(bloom(holders, ROW_KEY))

    def thin(batches):
        for batch in batches:
            x = longs(batch, "x0", "x1")
            hit = np.logical_and.reduce([(bits.value[v >> 6] >> (v & 63)) & 1 == 1 for v in x])
            yield batch.select([*ROW_KEY, "body_"]).filter(pa.array(hit))

    some = docs.select(*ROW_KEY, "body_", *[x.alias(f"x{i}") for i, x in enumerate(spots_of(ROW_KEY))]).mapInArrow(thin, "k1_ long, k2_ long, body_ string")

    def sets(batches):
        for batch in batches:
            for i, j, tokens, at, found in _batches(batch, k):
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([tokens[at[x] : at[x + 1]].tobytes() for x in range(j - i)], pa.binary())], names=["node", "tokens"])

    held = some.join(holders, list(ROW_KEY)).dropDuplicates(list(ROW_KEY)).select("body_").mapInArrow(sets, "node long, tokens binary")
    held = materialise(held, "jaccard-sets")
    bits.destroy()
    return held


def components(links: DataFrame) -> DataFrame:
    """v, c: each linked node and the least node it reaches: least neighbour's label, then the label's label, until
    nothing changes (rounds grow with the logarithm of a component's diameter)."""
    both = materialise(links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select("b", "a")).distinct(), "links")
    labels = materialise(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), F.col("c").alias("cw")), "w").groupBy("v").agg(F.min("cw").alias("cw"))
        step = labels.join(near, "v").select("v", "c", F.least("c", "cw").alias("c1"))
        jump = labels.select(F.col("v").alias("c1"), F.col("c").alias("c2"))
        done = materialise(step.join(jump, "c1", "left").select("v", F.least("c1", F.coalesce("c2", "c1")).alias("c"), (F.least("c1", F.coalesce("c2", "c1")) != F.col("c")).alias("moved")), "labels")
        labels = done.select("v", "c")
        if done.where("moved").limit(1).count() == 0:
            return labels


def members(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """own_ (the key), k1_, k2_ (as from row_key), n, node, c: a row for each row of docs; equal c for one component, null
    without shingles."""
    own = docs.select(F.col(key).alias("own_"), *row_key(key, text), F.col(text).alias("body_"))
    nodes = materialise(node_table(own, k), "jaccard-nodes")
    size = nodes.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).first()
    bands = Bands(size["docs"], threshold)
    buckets = max(16, -(-(size["n"] or 0) * 8 // BUCKET_BYTES))
    pairs = materialise(candidates(own, buckets, bands, k).distinct(), "jaccard-candidates")
    info = nodes.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    pairs = materialise(by_size(pairs, info.select("node", "n"), threshold).distinct(), "jaccard-filed")
    some = materialise(under_hubs(pairs, info, hopeful(threshold), "jaccard-near").select("hub", F.col("a").alias("node")).distinct(), "jaccard-hopeful")
    held = sets_of(own, nodes, some.select("node").distinct(), k)
    links = under_hubs(some, held, linked(threshold), "jaccard-links").select("a", "b")
    labels = components(links)
    none = nodes.where("node IS NULL").withColumn("c", F.lit(None).cast("long"))  # not joined: their nulls would meet in one task
    placed = nodes.where("node IS NOT NULL").join(labels, F.col("node") == F.col("v"), "left").select(*nodes.columns, F.coalesce("c", "node").alias("c"))
    return placed.unionByName(none).drop("sketch")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """key, n_shingles, component_id: one row for each row of docs."""
    found = members(docs, key, text, k, threshold)
    full = found.where("c IS NOT NULL")
    least = full.groupBy("c").agg(F.min("own_").alias("least_"))
    out = full.join(least, "c").unionByName(found.where("c IS NULL").withColumn("least_", F.col("own_")))
    return out.select(F.col("own_").alias(key), F.col("n").alias("n_shingles"), F.col("least_").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one row of each component, that of its least id; of documents without shingles, one row of each."""
    found = members(docs, key, text, k, threshold)
    first = F.min(F.struct(F.col("own_").isNull(), "own_", *ROW_KEY)).alias("m")
    kept = found.where("c IS NOT NULL").groupBy("c").agg(first).select("m.k1_", "m.k2_").unionByName(found.where("c IS NULL").select(*ROW_KEY).distinct())
    rows = docs.select(*row_key(key, text), F.struct(*docs.columns).alias("whole_"))
    return rows.join(kept, list(ROW_KEY), "left_semi").dropDuplicates(list(ROW_KEY)).select("whole_.*")


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
