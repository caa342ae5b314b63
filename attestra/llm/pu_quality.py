"""Quality scores by positive-unlabelled learning.

A linear score over measures and hashed n-grams of the whole text minimises the non-negative unbiased
risk: trusted positives, all documents as the unlabelled sample, and a class prior estimated from these
two alone. Negative labels are not used.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import arrow_map, free, slices, small, written

#: Newton steps over the whole table at most, ridge, and the largest change of a weight that ends them.
STEPS, RIDGE, SETTLED = 12, 1e-3, 1e-3
#: Shares of a Newton step that are tried, largest first, where the whole of it won't do.
SHARES = (0.5, 0.25, 0.1, 0.03)
#: The prior without positives, the prior under which texts are first put in order, and the least and greatest estimate.
PRIOR, FIRST_PRIOR, LEAST_PRIOR, MOST_PRIOR = 0.5, 0.3, 0.02, 0.98
#: Bins of the first scores, and the share of positives that a bound on the prior must rest on.
BINS, POSITIVES = 400, 0.5
#: Buckets of hashed n-grams, bytes of one, and bytes of text worked on at once.
BUCKETS, GRAM, PIECE = 48, 4, 1 << 18
MARKS = b"*#$%&!|<>{}[]()_=+~^@/\\\"'.,;:?-"


def gram_shares(data: bytes) -> np.ndarray:
    """Square roots of the shares of all byte n-grams of ``data`` by bucket, a piece at a time."""
    got = np.zeros(BUCKETS)
    for at in range(0, max(0, len(data) - GRAM + 1), PIECE):
        b = np.frombuffer(data[at : at + PIECE + GRAM - 1], np.uint8).astype(np.uint32)
        key = np.zeros(len(b) - GRAM + 1, np.uint32)
        for i in range(GRAM):
            key = key * np.uint32(0x01000193) ^ b[i : len(b) - GRAM + 1 + i]
        key = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        got += np.bincount((key >> np.uint32(12)) % np.uint32(BUCKETS), minlength=BUCKETS)
    return np.sqrt(got / max(1.0, got.sum()))


def measures(text: str | None) -> list[float]:
    """Measures of the whole text, each from 0 to about 3. A null text counts as empty; an empty one has the first measure only."""
    out = np.zeros(N_MEASURES)
    if not text:
        out[0] = 1.0
        return out.tolist()
    data = text.encode()
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    size = n.sum()
    upper, lower, digit = n[65:91].sum(), n[97:123].sum(), n[48:58].sum()
    wide = n[128:].sum()
    words = text.split()
    lines = text.split("\n")
    many = max(1, len(words))
    kinds = Counter(words)
    lens = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    line_kinds = Counter(x for x in lines if x.strip())
    n_lines = max(1, sum(line_kinds.values()))
    out[1] = math.log1p(many) / 5
    out[2] = upper / max(1.0, upper + lower)
    out[3] = digit / size
    out[4] = min(1.0, n[10] / size * 10)
    out[5] = n[32] / size
    out[6] = wide / size
    out[7] = lens.mean() / 10
    out[8] = min(3.0, lens.std() / 10)
    out[9] = len(kinds) / many
    out[10] = max(kinds.values(), default=0) / many
    out[11] = len(line_kinds) / n_lines
    out[12] = max(line_kinds.values(), default=0) / n_lines
    out[13] = sum(w.isalpha() for w in words) / many
    out[14] = sum(c for w, c in kinds.items() if not any(x.isalpha() for x in w)) / many
    out[15] = sum(c for w, c in kinds.items() if len(w) > 1 and not w[-1].isalnum() and not w[-2].isalnum()) / many
    out[16] = (upper + lower + wide) / size
    out[17 : 17 + len(MARKS)] = np.sqrt(n[list(MARKS)] / size)
    out[17 + len(MARKS) :] = gram_shares(data.lower())
    return out.tolist()


N_MEASURES = 17 + len(MARKS) + BUCKETS


@dataclass
class Scorer:
    weights: list[float]  # the last is the intercept
    prior: float
    steps: int
    risk: tuple[float, float] = (0.0, 0.0)  # of positives, and of negatives: the latter is never below 0


def measured(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``(*keep, x array<float>)`` for each row."""
    own = [f"c{i}" for i in range(len(keep))]  # in Python and Arrow, where no name of the caller's may clash

    def run(b: pa.RecordBatch):
        x = [measures(t) for t in b.column(0).to_pylist()]
        yield pa.record_batch([*[b.column(i) for i in range(1, b.num_columns)], pa.array(x, pa.list_(pa.float32()))], [*own, "x"])

    fields = ", ".join(f"{o} {docs.schema[c].dataType.simpleString()}" for o, c in zip(own, keep, strict=True))
    return arrow_map(docs.select(docs[text], *[docs[c] for c in keep]).toDF("text", *own), run, f"{fields}, x array<float>").toDF(*keep, "x")


def _rows(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The positives' mask and the measures, with a 1 for the intercept."""
    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d - 1).astype(float)
    return b.column(0).to_numpy(zero_copy_only=False).astype(bool), np.hstack([x, np.ones((len(x), 1))])


def losses(x: np.ndarray, pos: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows and positives, the loss of all rows as negatives, of the positives as such, and of the positives as negatives."""
    z = np.clip(x @ w, -40, 40)
    return np.array([len(x), pos.sum(), np.logaddexp(0, z).sum(), np.logaddexp(0, -z[pos]).sum(), np.logaddexp(0, z[pos]).sum()])


def slopes(x: np.ndarray, pos: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums for the gradient and the Hessian, as one vector."""
    s = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
    return np.concatenate([s @ x, x[pos].sum(0), ((x * (s * (1 - s))[:, None]).T @ x).ravel()])


def half_of(x: Column) -> Column:
    """0 or 1, the same for equal texts."""
    return F.pmod(F.xxhash64(x), F.lit(2)).cast("int")


def _sums(table: DataFrame, d: int, f) -> np.ndarray:
    """The sum of ``f(x, positives)`` over all rows of ``table(pos, x)``. One short row per task and entry is added up by Spark."""

    def run(batches):
        total = 0.0
        for b in batches:
            for part in slices(b):
                if part.num_rows:
                    pos, x = _rows(part, d)
                    total = total + f(x, pos)
        if not np.isscalar(total):
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    got = table.select("pos", "x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(1 + max((r["i"] for r in got), default=-1))
    for r in got:
        out[r["i"]] = r["v"]
    return out


def risks(sums: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk of positives, and the unbiased estimate of the negatives': all rows' less the positives' share of it."""
    n, n_pos, unlabelled, pos, as_negative = sums
    return prior * pos / n_pos, unlabelled / n - prior * as_negative / n_pos


def minimise(total, d: int, prior: float) -> Scorer:
    """Newton's method on the logistic PU risk, where ``total(f)`` sums ``f(x, positives)`` over all rows.

    The unbiased risk is convex with logistic loss. Every weight vector on the way, the last one too, has
    a negatives' part of at least zero: of shares of a step the largest is taken that keeps to that and
    lowers the objective, and where none does the way ends. There the non-negative risk, which counts a
    part below zero as zero, is the unbiased one. Without positives all scores equal the prior.
    """
    both = lambda v: total(lambda x, pos: np.concatenate([losses(x, pos, v), slopes(x, pos, v)]))
    w = np.zeros(d)
    got = both(w)
    if not len(got) or not got[1]:
        w[-1] = math.log(prior / (1 - prior))
        return Scorer(w.tolist(), prior, 0)
    n, n_pos = got[:2]
    flat = np.full(d, RIDGE)
    flat[-1] = 1e-9
    here = risks(got[:5], prior)

    def lower(v: np.ndarray, sums: np.ndarray) -> bool:
        there = risks(sums, prior)
        return there[1] >= 0 and sum(there) + (flat * v * v).sum() / 2 < sum(here) + (flat * w * w).sum() / 2

    step = 0
    while step < STEPS:
        step += 1
        t = got[5:]
        slope = t[:d] / n - prior * t[d : 2 * d] / n_pos + flat * w
        move = np.linalg.solve(t[2 * d :].reshape(d, d) / n + np.diag(flat), slope)
        move *= min(1.0, 4.0 / max(1e-9, np.abs(move).max()))
        v = w - move
        got = both(v)
        if not lower(v, got[:5]):
            tried = [w - s * move for s in SHARES]
            some = total(lambda x, pos, tried=tried: np.concatenate([losses(x, pos, y) for y in tried])).reshape(len(tried), -1)
            v = next((y for y, sums in zip(tried, some, strict=True) if lower(y, sums)), None)
            if v is None:
                break
            got = both(v)
        done = np.abs(v - w).max() < SETTLED
        w, here = v, risks(got[:5], prior)
        if done:
            break
    return Scorer(w.tolist(), prior, step, here)


def histogram(x: np.ndarray, pos: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Counts of all rows, then of the positives, by bin of the score."""
    at = np.minimum(BINS - 1, (BINS / (1 + np.exp(-np.clip(x @ w, -40, 40)))).astype(int))
    return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[pos], minlength=BINS)]).astype(float)


def prior_bound(counts: np.ndarray) -> float:
    """The share of positives among all rows, from ``histogram``.

    Whatever the negatives are, the rows scored above a bin hold at least the prior times the positives'
    share above it. So each ratio of the two shares bounds the prior, closely where few negatives are
    scored so high; the least over all bins with at least POSITIVES of the positives above is taken.
    """
    rows, pos = (np.cumsum(c[::-1]) / max(1.0, c.sum()) for c in counts.reshape(2, BINS))
    enough = pos >= POSITIVES
    bound = (rows[enough] / pos[enough]).min() if enough.any() else PRIOR
    return float(min(MOST_PRIOR, max(LEAST_PRIOR, bound)))


def learn(total, d: int) -> Scorer:
    """Scores under a first prior put the texts in order; the prior follows from that order, and the scorer from the prior.

    ``total(f, half)`` sums ``f(x, positives)`` over all rows, or over one half of them. The first scores
    are learned from one half and read on the other, as positives that were learned from stand too high.
    """
    first = minimise(lambda f: total(f, 0), d, FIRST_PRIOR)
    if not first.steps:
        return minimise(total, d, PRIOR)
    counts = total(lambda x, pos: histogram(x, pos, np.array(first.weights)), 1)
    return minimise(total, d, prior_bound(counts) if len(counts) else PRIOR)


def learn_and_score(docs: DataFrame, labels: DataFrame, may_learn, text: str = "text", id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """``(<id>, score double)`` per row of ``docs``; 0 to 1, higher: label 1 likelier.

    ``labels(<id>, <label>)`` marks some rows; only rows with label 1 whose id ``may_learn(id)`` allows are
    learned from, as positives. The unlabelled sample is every row of ``docs``, and the share of positives
    in it is estimated from both. Null, empty, very long and repeated texts are scored like any other, by
    measures of the whole text; equal texts score alike. An id labelled twice is positive if any label is
    1, and all rows of that id are; a null id is never labelled. Without a positive every score is PRIOR;
    an empty table gives an empty result. Labels and ids are no measures, and other columns are not read,
    whatever their names. The rows are never collected.
    """
    known = labels.select(F.col(id_col).alias("id_"), F.col(label).alias("y_")).where(may_learn(F.col("id_")) & (F.col("y_") == 1)).select("id_").distinct()
    table = written(measured(docs.select(docs[id_col].alias("id"), docs[text].alias("text")), "text", ["id"]), "measures")
    marked = written(table.join(small(known), table["id"] == known["id_"], "left").select(F.col("id_").isNotNull().alias("pos"), "x", half_of(F.col("x")).alias("half")), "marked")
    d = N_MEASURES + 1
    scorer = learn(lambda f, half=None: _sums(marked if half is None else marked.where(F.col("half") == half), d, f), d)
    free(docs.sparkSession, marked)
    at = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in scorer.weights[:-1]]), lambda a, b: a * b), F.lit(float(scorer.weights[-1])), lambda acc, v: acc + v)
    return table.select(F.col("id").alias(id_col), (F.lit(1.0) / (F.lit(1.0) + F.exp(-at))).alias("score"))
