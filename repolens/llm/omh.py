"""Operator 4: document fingerprints by Order MinHash, in DataFrame functions only.

A text is cut into units of at most eight characters (pieces of words); k consecutive units make a k-mer. The o-th
occurrence of a k-mer is an element of its own, so repeats count. One permutation hashing deals the elements into
`sketches` buckets by hash; in each bucket the `tuple_size` elements of least priority are selected, put back into
text order and hashed as a tuple. Two texts agree in a bucket only if the same elements are least and stand in the
same order, which is what makes the likeness follow edit distance rather than set overlap. Likeness is the share of
agreeing buckets among those that either text fills.

Everything happens within the row: sorts of arrays of packed 64-bit values (40 bits of hash above 24 bits of
position; beyond 2^24 units, which is over 2^25 bytes of text, places are kept modulo 2^24, so order is then seen only
within each such stretch); the only exchange is the one that brings a document's successor to it.

Defined cases: null text is empty; two texts without any unit are alike (1.0), one without and one with are not
(0.0); a text of fewer than k units is one k-mer; equal texts have equal fingerprints; the last row of the order is
followed by the first, a single row by itself; rows with equal ids stand in the order of their texts; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, table

SKETCHES = 32
TUPLE = 2
K = 3
UNIT = r"[^\x20\x09-\x0D]{1,8}"
#: Documents in a bucket of the successor search, and the most buckets (a table of 24 bytes each is broadcast).
BUCKET_ROWS = 2000
MOST_BUCKETS = 200_000

_PLACE = (1 << 24) - 1


def fingerprint_array(text: Column, sketches: int = SKETCHES, tuple_size: int = TUPLE, k: int = K) -> Column:
    """array<bigint> of tuple hashes, null where a bucket is empty; sketches must be a power of two."""
    shift = 64 - (sketches.bit_length() - 1)
    bucket = lambda x: F.shiftrightunsigned(x, shift)
    hash40 = lambda h: h.bitwiseAND(~_PLACE)

    def kmers(units: Column) -> Column:
        # hash of k units from each place on, with its place in the low bits; one k-mer where there are fewer
        last = F.greatest(F.size(units) - (k - 1), F.lit(1))
        h = lambda i: F.xxhash64(*[F.get(units, i + j) for j in range(k)])
        return F.when(F.size(units) > 0, F.transform(F.sequence(F.lit(0), last - 1), lambda i: hash40(h(i)).bitwiseOR(i.cast("bigint").bitwiseAND(_PLACE)))).otherwise(F.array().cast("array<bigint>"))

    def numbered(packed: Column) -> Column:
        # packed is sorted: equal k-mers stand together, by place; the o-th gets the hash of (k-mer, o)
        starts = F.filter(
            F.transform(packed, lambda x, i: F.when((i == 0) | (F.shiftright(F.get(packed, i - 1), 24) != F.shiftright(x, 24)), i).otherwise(F.lit(-1))),
            lambda i: i >= 0,
        )
        again = lambda x, o: hash40(F.xxhash64(F.shiftright(x, 24), o)).bitwiseOR(x.bitwiseAND(_PLACE))
        runs = let(
            starts,
            lambda s: F.flatten(F.transform(s, lambda at, j: F.transform(F.slice(packed, at + 1, F.coalesce(F.get(s, j + 1), F.size(packed)) - at), again))),
        )
        plain = let(starts, lambda s: F.size(s) == F.size(packed))
        return F.when(plain, F.transform(packed, lambda x: again(x, F.lit(0)))).otherwise(runs)

    def chosen(keys: Column) -> Column:
        # the first tuple_size of each bucket; sorting signed values keeps buckets together
        return F.filter(keys, lambda x, i: (i < tuple_size) | (bucket(F.get(keys, i - tuple_size)) != bucket(x)))

    def tuples(picked: Column) -> Column:
        def one(j: Column) -> Column:
            # in text order: place above, element below (the 40 bits of hash are folded; ties are equal anyway)
            own = F.array_sort(F.transform(F.filter(picked, lambda x: bucket(x) == j), lambda x: F.struct(x.bitwiseAND(_PLACE).alias("at"), F.shiftright(x, 24).alias("h"))))
            return let(own, lambda o: F.when(F.size(o) > 0, F.xxhash64(*[F.get(o, i)["h"] for i in range(tuple_size)])))

        return F.transform(F.sequence(F.lit(0), F.lit(sketches - 1)), lambda j: one(j.cast("bigint")))

    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))
    steps = let(units, lambda u: F.array_sort(kmers(u)))
    steps = let(steps, lambda p: F.array_sort(numbered(p)))
    return let(let(steps, chosen), tuples)


def fingerprint_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x)), 16, "0"), F.lit("-"))), "")


def likeness(a: Column, b: Column, tuple_size: int = TUPLE) -> Column:
    """Of the buckets that either side fills, the share that agrees, to the power 1 / tuple_size: a bucket agrees if
    each of tuple_size elements does, so this estimates the share of common, equally ordered elements. Two empty
    signatures are alike."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    filled = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda e: e))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.pow(same / filled, F.lit(1.0 / tuple_size))).cast("double")


def _range_of(c: Column, bounds: list) -> Column:
    """How many bounds a key exceeds, by halving; no key goes below all others."""
    if not bounds:
        return F.lit(0).cast("long")
    table = F.lit([int(b) for b in bounds]).cast("array<bigint>")
    steps = F.lit([1 << i for i in reversed(range(len(bounds).bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda lo, step: lo + F.when(F.coalesce(F.get(table, lo + step - 1) < c, F.lit(False)), step).otherwise(0)).cast("long")


def with_next(docs: DataFrame, key: str, columns: list[str], prefix: str = "next_", derived: dict[str, Column] | None = None) -> DataFrame:
    """docs with the columns of the next row in descending key order (after the last: the first), without a global
    sort: keys are dealt into ranges of about BUCKET_ROWS rows, each range also gets the top row of the next lower
    one, and lead() runs within ranges. Ranges end at quantiles of the keys, so clustered or far-off ids make no large
    one; all rows of one id, or without any, share a range, as they follow each other. The table of ranges is bounded by
    MOST_BUCKETS rows, so it is broadcast. Costly columns go into derived: they are made once a row, after the few rows
    that stand in two ranges are known."""
    derived = derived or {}
    n = docs.count()
    ranges = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(docs.agg(F.percentile_approx(key, shares, max(10_000, 4 * ranges)).alias("q")).first()["q"] or [])) if shares else []
    at = lambda c: _range_of(c, bounds)
    order = [F.col(key).desc_nulls_last(), *[F.col(c).asc() for c in columns]]
    d = docs.withColumn("r_", at(F.col(key)))
    # the top row of each range, by key alone; among equal keys the window below puts the same one first
    tops = d.groupBy("r_").agg(F.max(key).alias("top_"))
    upper = Window.orderBy(F.col("r_"))
    tops = tops.select("r_", "top_", F.lead("r_").over(upper).alias("above_"), F.max("r_").over(Window.partitionBy()).alias("most_"), F.min("r_").over(Window.partitionBy()).alias("least_"))
    # the top range's first row follows the very last row of the lowest range
    tops = tops.select(F.col("r_").alias("t_"), F.col("top_"), F.coalesce("above_", "least_").alias("to_"))
    guests = d.join(F.broadcast(tops), (F.col("r_") == F.col("t_")) & F.col(key).eqNullSafe(F.col("top_"))).select(*docs.columns, F.col("to_").alias("r_"), F.lit(True).alias("guest_")).withColumns(derived)
    one = d.select(*docs.columns, "r_", F.lit(False).alias("guest_")).withColumns(derived)
    w = Window.partitionBy("r_").orderBy(F.col("guest_"), *order)
    both = one.unionByName(guests)
    return both.select("*", *[F.lead(c).over(w).alias(prefix + c) for c in [*columns, *derived]]).where(~F.col("guest_")).drop("r_", "guest_")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each text against the
    same with its last third replaced by the head of its successor, and against the successor."""
    d = docs.select(F.col(key).alias("id_"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    d = with_next(d, "id_", ["body"], derived={"sig": fingerprint_array(F.col("body"), **options)})
    third = F.floor(F.length("body") / 3).cast("int")
    d = d.select("*", F.concat(F.substring("body", F.lit(1), F.length("body") - third), F.substring("next_body", F.lit(1), third)).alias("edited"))
    d = d.select("id_", "body", "sig", "next_sig", "edited", fingerprint_array(F.col("edited"), **options).alias("edited_sig"))
    return d.select(
        F.col("id_").alias(key),
        F.length("body").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("sig")).alias("fingerprint"),
        fingerprint_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op4_order_minhash(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
