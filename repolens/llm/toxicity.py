"""Operator 3: toxicity by weak supervision.

Voters are lexicon entries (whole words) and patterns (word beginnings), found in a bounded sample of labelled rows by
how much oftener toxic documents hold them; documents that share their least word hashes count once, so copies of one
text elect nobody. A few general insults are voters in any case; so are some patterns of style. A generative label
model then takes the votes on that sample and on a bounded sample of rows without labels: starting from whether any
lexicon voter fires and from the label, if there is one, it estimates by expectation maximisation how often each voter fires in toxic and in clean documents,
and how voters correlate once the label is given; correlated voters share their weight. The given labels are one weak
source among them, with an accuracy of its own, which abstains on rows without a label. A linear (logistic) classifier is
fitted to the posterior labels of all sampled rows, over the presence of voters and of further terms, and scores every
document from its whole text.

Learning runs in one task of an executor, on at most `TOXIC_ROWS` + `CLEAN_ROWS` + `OTHER_ROWS` whole texts of
`SAMPLE_BYTES` together, the least by hash of their keys; only the classifier (some kilobytes) comes to the driver.

Defined cases: null text is scored like empty text; texts without any voter get the classifier's base score; without
labelled rows the general insults alone decide; repeated rows get equal scores; rows without labels are scored like
others; an empty table gives no rows; extra columns are ignored; a null id counts as no characters in held_out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import NOT_ALNUM, lower_ascii, materialise, mix, pieces, prefix_hash, span_hash, table, text_view, words

#: At most this many labelled rows of either kind, and rows without a label, are learned from, of so many bytes in all.
TOXIC_ROWS, CLEAN_ROWS, OTHER_ROWS = 3000, 6000, 3000
SAMPLE_BYTES = 48 << 20
#: Size of the classifier: voters, and terms with them.
VOTERS, TERMS = 160, 400
STEMS = (4, 5, 6, 7, 8)
#: A term is chosen for as many toxic documents at least: fewer of some 10^5 terms' chance meetings look telling.
LEAST = 5
CUT = 0.3
#: Texts are taken in pieces of about so many bytes.
PIECE = 1 << 19
#: General insults, voters without any labels.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown", "bastard", "dumb", "freak")


def term_hash(term: str) -> int:
    b = np.frombuffer(term.encode(), np.uint8)
    return int(span_hash(prefix_hash(lower_ascii(b)), np.array([0]), np.array([len(b)]))[0])


def term_rows(data: np.ndarray, offsets: np.ndarray):
    """(document, term) of all words and word beginnings, as hashes; beginnings are salted by their length; and the
    words of each document."""
    low = lower_ascii(data)
    starts, ends, first = words(low, offsets, NOT_ALNUM)
    prefix = prefix_hash(low)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    docs, terms = [doc], [span_hash(prefix, starts, ends)]
    for n in STEMS:
        long = ends - starts > n
        docs.append(doc[long])
        terms.append(mix(span_hash(prefix, starts[long], starts[long] + n) + np.uint64(n)))
    return docs, terms, np.diff(first)


@dataclass
class Scorer:
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray  # of each term's presence, then of log(1 + distinct voters), then the base
    voters: np.ndarray  # which terms are voters

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = np.zeros((len(offsets) - 1, len(self.terms)), bool)
        for i, j in pieces(offsets, PIECE):
            docs, terms, _ = term_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for d, t in zip(docs, terms, strict=True):
                at = np.minimum(np.searchsorted(self.terms, t), len(self.terms) - 1)
                hit = self.terms[at] == t
                x[i + d[hit], at[hit]] = True
        return x

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.log1p(x[:, self.voters].sum(1)), np.ones(len(x))]).astype(np.float64, copy=False)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(self.features(data, offsets)) @ self.weights, -30, 30)))


def label_model(votes: np.ndarray, given: np.ndarray, start: np.ndarray, rounds: int = 10, trust: float = 50.0) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row of votes (0/1), from a first guess; and the voters' residual correlations.
    given: labels, nan where there is none; its accuracy is estimated like a voter's, from `trust` rows in its favour. A
    voter's weight is divided by 1 plus its correlations with others, given the label."""
    q, v = start.astype(float), votes.astype(float)
    known = ~np.isnan(given)
    g = np.nan_to_num(given)
    for _ in range(rounds):
        prior = np.clip(q.mean(), 0.01, 0.99)
        fire = (q @ v + 0.5) / (q.sum() + 1)
        false = ((1 - q) @ v + 0.5) / ((1 - q).sum() + 1)
        rest = v - (q[:, None] * fire + (1 - q)[:, None] * false)
        scale = np.sqrt((rest * rest).mean(0)) + 1e-6
        corr = (rest.T @ rest) / len(v) / scale[:, None] / scale[None, :]
        np.fill_diagonal(corr, 0)
        share = 1 / (1 + np.where(np.abs(corr) > 0.2, np.abs(corr), 0).sum(1))
        on, off = np.log(fire / false), np.log((1 - fire) / (1 - false))
        odds = np.log(prior / (1 - prior)) + (v * (on - off) + off) @ share
        right = (q[known] @ g[known] + 0.98 * trust) / (q[known].sum() + trust)
        wrong = ((1 - q[known]) @ g[known] + 0.02 * trust) / ((1 - q[known]).sum() + trust)
        odds += known * np.where(g > 0.5, np.log(right / wrong), np.log((1 - right) / (1 - wrong)))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q, corr


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Newton's method on soft labels; the base is not shrunk."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        w = w + np.linalg.solve(h, x.T @ (y - p) - penalty * w)
    return w


def tally_of(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The terms of the chosen documents, sorted, and in how many of them each occurs; of known terms only, if given."""
    key, count = np.zeros(0, np.uint64), np.zeros(0)
    for i, j in pieces(offsets, PIECE):
        if not chosen[i:j].any():
            continue
        docs, terms, _ = term_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        take = [chosen[i + d] & (True if known is None else np.isin(t, known)) for d, t in zip(docs, terms, strict=True)]
        d, t = (np.concatenate([x[m] for x, m in zip(xs, take, strict=True)]) for xs in (docs, terms))
        own, at = np.unique(t, return_inverse=True)
        pair = np.unique(at.astype(np.int64) * (j - i) + d)
        n = np.bincount(pair // (j - i), minlength=len(own))
        key, at = np.unique(np.r_[key, own], return_inverse=True)
        count = np.bincount(at, weights=np.r_[count, n], minlength=len(key))
    return key, count


def fit(rows: pa.Table) -> Scorer:
    """rows: text, toxic (null: no label)."""
    given = np.array(rows["toxic"].to_pylist(), float)  # null: nan
    data, off = text_view(rows["text"])
    insults = np.array(sorted({term_hash(x) for x in INSULTS}), np.uint64)
    fixed = Scorer(insults, np.r_[np.full(len(insults), 2.5), 1.0, -3.0], np.ones(len(insults), bool))
    y, known = np.nan_to_num(given), ~np.isnan(given)
    if not (y > 0.5).any() or (y[known] > 0.5).all():
        return fixed
    # copies of one text share their least word hashes: one group, of which one document is counted
    group = np.arange(len(y), dtype=np.uint64)
    for i, j in pieces(off, PIECE):
        docs, terms, count = term_rows(data[off[i] : off[j]], off[i : j + 1] - off[i])
        h = mix(terms[0])
        order = np.lexsort((h, docs[0]))
        h, d = h[order], docs[0][order]
        new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])][: len(h)]
        h, d = h[new], d[new]
        at = np.searchsorted(d, np.arange(j - i))
        wide = np.flatnonzero(count >= 20)
        wide = wide[at[wide] + 2 < len(h)]
        wide = wide[d[at[wide] + 2] == wide]
        group[i + wide] = mix(h[at[wide]] + mix(h[at[wide] + 1] + mix(h[at[wide] + 2])))
    _, one, group = np.unique(group * np.uint64(4) + 2 * known.astype(np.uint64) + (y > 0.5).astype(np.uint64), return_index=True, return_inverse=True)
    counted = np.zeros(len(y), bool)
    counted[one] = True
    counted &= known
    n1, n0 = len(np.unique(group[known & (y > 0.5)])), len(np.unique(group[known & (y <= 0.5)]))
    # only terms of enough toxic documents can be chosen, so clean documents are searched for those alone
    key, toxic = tally_of(data, off, counted & (y > 0.5))
    often = toxic >= max(LEAST, 0.01 * n1)
    key, toxic = key[often], toxic[often]
    seen, clean = tally_of(data, off, counted & (y <= 0.5), key)
    tally = [np.zeros(len(key)), toxic]
    tally[0][np.searchsorted(key, seen)] = clean
    p1, p0 = (tally[1] + 0.5) / (n1 + 1), (tally[0] + 0.5) / (n0 + 1)
    lift = np.log(p1 / p0)
    # signed root of the likelihood ratio: favours terms that are both frequent and telling
    strength = np.sqrt(np.maximum(tally[1], 0)) * lift
    voter = (tally[1] >= max(LEAST, 0.01 * n1)) & (lift > np.log(6))
    order = np.argsort(-strength, kind="stable")
    chosen = order[voter[order]][:VOTERS]
    extra = order[(~voter & (tally[1] >= max(LEAST, 0.02 * n1)) & (lift > np.log(1.5)))[order]][: TERMS - len(chosen)]
    all_terms = np.unique(np.r_[key[chosen], key[extra], insults])
    is_voter = np.isin(all_terms, np.r_[key[chosen], insults])
    s = Scorer(all_terms, np.zeros(0), is_voter)
    x = s.features(data, off)
    total = x[:, is_voter].sum(1)
    upper = np.add.reduceat(np.r_[(data >= 65) & (data <= 90), False].astype(np.int64), off[:-1]) if len(data) else np.zeros(len(y))
    style = np.column_stack([total >= 1, total >= 2, total >= 4, total == 0, upper > 0.5 * np.maximum(np.diff(off), 1)])
    votes = np.column_stack([x[:, is_voter], style])
    # first guess: whether any lexicon voter fires counts as much as a label
    guess = 2.0 * (total > 0) - 1.5 + np.where(known, 4.0 * y - 2.0, 0.0)
    posterior, _ = label_model(votes, given, 1 / (1 + np.exp(-guess)))
    s.weights = logistic(s.design(x), posterior)
    return s


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, other_rows: int = OTHER_ROWS) -> Scorer:
    """docs: key, text; labels: key, toxic. The rows learned from are the least by hash of the key of each kind; as
    their number is bounded, their keys are broadcast to the documents."""
    h = F.xxhash64(F.col(key))
    part = lambda v, n: labels.where(F.col("toxic") == v).select(key, F.col("toxic").cast("int").alias("toxic")).dropDuplicates([key]).orderBy(h, key).limit(n)
    # twice as many as needed, as some have labels
    other = docs.select(key).where(F.col(key).isNotNull()).dropDuplicates([key]).orderBy(F.xxhash64(key, F.lit(1)), key).limit(2 * other_rows)
    other = other.join(labels.select(key).distinct(), key, "left_anti").orderBy(F.xxhash64(key, F.lit(1)), key).limit(other_rows)
    few = part(1, toxic_rows).unionByName(part(0, clean_rows)).unionByName(other.withColumn("toxic", F.lit(None).cast("int")))
    few = materialise(few, "toxicity-keys")
    body = F.coalesce(F.col(text), F.lit(""))
    # whole texts, as many of each kind as its part of the bytes allows; the window holds the sampled keys only
    size = docs.select(key, F.octet_length(body).alias("bytes")).join(F.broadcast(few), key)
    ahead = Window.partitionBy("toxic").orderBy(h, "bytes", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = size.withColumn("upto", F.sum("bytes").over(ahead)).where(F.col("upto") <= SAMPLE_BYTES // 3).select(key, "toxic").distinct()
    rows = docs.select(F.col(key), body.alias("text")).join(F.broadcast(few), key).select(h.alias("h"), "text", "toxic")

    def train(group: pa.Table) -> pa.Table:
        s = fit(group.sort_by([("h", "ascending"), ("text", "ascending")]))
        return pa.table({"terms": pa.array([s.terms.tobytes()], pa.binary()), "weights": pa.array([s.weights.tobytes()], pa.binary()), "voters": pa.array([s.voters.tobytes()], pa.binary())})

    made = rows.groupBy(F.lit(1).alias("one")).applyInArrow(train, "terms binary, weights binary, voters binary").collect()
    if not made:
        return fit(pa.table({"text": pa.array([], pa.string()), "toxic": pa.array([], pa.int32())}))
    return Scorer(*(np.frombuffer(bytes(x), kind) for x, kind in zip(made[0], (np.uint64, np.float64, bool), strict=True)))


def score(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep..., score."""

    def run(batches):
        for batch in batches:
            data, off = text_view(batch.column("t_"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (key, *keep)], pa.array(scorer.score(data, off))], names=[key, *keep, "score"])

    d = docs.select(key, *keep, F.col(text).alias("t_"))
    return d.mapInArrow(run, StructType([*d.schema.fields[:-1], StructField("score", DoubleType())]))


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scorer = learn(docs.where(~F.col("held_out")), labels)
    return score(docs, scorer, keep=("held_out",)).withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0).cast("int"))
