"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier over hashed byte n-grams predicts each bit; a text
gets the language whose codeword costs least under a loss on the bits' margins, and is flagged when
the second codeword costs nearly as little.
"""

from __future__ import annotations

import itertools
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import arrow_map

#: Buckets for each order of n-gram.
BUCKETS = 1 << 14
ORDERS = (1, 2, 3, 4)
#: Texts of each language, as a mean, that the classifiers are fitted on.
TRAIN_PER_LANGUAGE = 250
#: Texts that the classifiers are fitted on altogether, at least one of each language; languages that may be learned.
TRAIN_TEXTS, MOST_LANGUAGES = 5000, 5000
#: Columns of the training matrix that the driver holds at once.
COLUMNS = 1 << 12
#: Bytes of text worked on at once.
PIECE = 1 << 18
#: A text is ambiguous if the two best codewords' losses differ by less than this share of the worst possible difference.
MARGIN = 0.05
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Names of the columns that ``identify`` makes.
MADE = ("lang_pred", "score", "ambiguous", "lettered")


def codewords(k: int) -> np.ndarray:
    """``k`` rows of +1 and -1, at least a quarter of their places apart.

    Up to 7 classes: every split of the classes, once. More: rows drawn by a fixed seed one after the
    other, each far enough from those before; where some draws in a row fail the code gets longer, so
    this ends for any ``k``.
    """
    if k < 2:
        return np.ones((k, 1), np.int8)
    if k <= 7:
        cols = [(1, *c) for c in itertools.product((1, -1), repeat=k - 1) if -1 in c]
        return np.array(cols, np.int8).T
    width = 63
    while True:
        draw = np.random.default_rng(width)
        code = np.zeros((k, width), np.int8)
        for i in range(k):
            some = np.where(draw.random((32, width)) < 0.5, 1, -1).astype(np.int8)
            far = (width - some.astype(np.float32) @ code[:i].T.astype(np.float32)).min(1, initial=2 * width) >= 2 * -(-width // 4)
            if not far.any():
                break
            code[i] = some[far.argmax()]
        else:
            if (abs(code.sum(0, dtype=int)) < k).all():
                return code
        width += 16


def grams(data: bytes) -> list[np.ndarray]:
    """The bucket of every n-gram of ``data``, one array for each order; the orders' buckets are apart."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out, key = [], np.zeros(len(b) + 1, np.uint32)
    for order in ORDERS:
        if len(b) < order:
            break
        key = (key[: len(b) - order + 1] * np.uint32(0x01000193)) ^ b[order - 1 :]
        mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append(((mixed >> np.uint32(12)) % np.uint32(BUCKETS)).astype(np.int32) + np.int32((order - 1) * BUCKETS))
    return out


def pieces(text: str):
    """The UTF-8 bytes of ``text`` in lower case between spaces, in parts of bounded size that overlap by an n-gram less one byte."""
    data = b" " + text.lower().encode() + b" "
    for at in range(0, max(1, len(data) - max(ORDERS) + 1), PIECE):
        yield data[at : at + PIECE + max(ORDERS) - 1]


def lettered(text: str | None) -> bool:
    return bool(text and LETTER.search(text))


def histogram(text: str) -> np.ndarray:
    """Shares of all n-grams of the whole text by bucket; each order sums to 1 (short overlaps aside)."""
    h = np.zeros(len(ORDERS) * BUCKETS)
    for p in pieces(text):
        for g in grams(p):
            h += np.bincount(g, minlength=len(h))
    return h / max(1.0, h.sum() / len(ORDERS))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for p in pieces(text):
            for g in grams(p):
                total += self.weights[g].sum(0, dtype=np.float64)
                n += len(g)
        return total / max(1, n / len(ORDERS)) + self.bias

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the second codeword is nearly as near."""
        if not lettered(text) or not self.languages:
            return UNDETERMINED, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        z = 4.0 * self.code * np.clip(self.margins(text), -1.5, 1.5)
        loss = np.logaddexp(0.0, -z).sum(1)
        order = np.argsort(loss, kind="stable")
        p = np.exp(loss[order[0]] - loss)
        worst = 4.0 * 2 * (self.code[order[0]] != self.code[order[1]]).sum()
        return self.languages[order[0]], float(p[order[0]] / p.sum()), bool(loss[order[1]] - loss[order[0]] < MARGIN * worst)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of ``labelled``: about ``per_language`` different texts of each language, picked by a hash of the text.

    Rows without language or text are left out; copies of a text count once, and every language that
    has a row is learned. Histograms of the sampled texts are made by the executors and only these reach
    the driver, at most a quarter more than ``per_language`` a language and, where there are many
    languages, fewer of each, so that about TRAIN_TEXTS come in all. No rows: a model that knows no language and answers
    `und`. More than MOST_LANGUAGES different values is an error: such a column doesn't hold languages.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # copies count once, so a language of few texts with many copies has all of its texts picked
    counts = {r["lang"]: r["count"] for r in rows.select("lang", "hash").distinct().groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], codewords(0), np.zeros((1, 1)), np.zeros(1))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} different values of {lang}, over the bound of {MOST_LANGUAGES}")
    each = max(1, min(per_language, TRAIN_TEXTS // len(languages)))
    # at least some twenty texts of each language are let through, so that none is lost to its hashes
    rate = F.from_json(F.lit(json.dumps({k: min(1.0, max(each, 20) / n) for k, n in counts.items()})), "map<string,double>")
    some = rows.where(F.abs(F.col("hash") % 1_000_003) < 1_000_003 * rate[F.col("lang")]).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.abs(F.col("hash") % 1_000_003), "hash", "text"))
    picked = some.withColumn("place", place).where(F.col("place") <= each + each // 4).select("lang", "text")

    def run(b: pa.RecordBatch):
        at, val, names = [], [], []
        for lang_, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            h = histogram(t)
            nz = np.flatnonzero(h)
            names.append(lang_)
            at.append(nz.astype("<i4").tobytes())
            val.append(h[nz].astype("<f4").tobytes())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(at, pa.binary()), pa.array(val, pa.binary())], ["lang", "at", "val"])

    got = arrow_map(picked, run, "lang string, at binary, val binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["val"])))
    rows = [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["val"], "<f4")) for r in got]
    y = np.array([languages.index(r["lang"]) for r in got], int)
    languages, y = [languages[i] for i in np.unique(y)], np.unique(y, return_inverse=True)[1]
    code = codewords(len(languages))
    share = 1.0 / (len(languages) * np.bincount(y, minlength=1))
    mean = np.zeros(len(ORDERS) * BUCKETS)
    for (at, val), k in zip(rows, y, strict=True):
        mean[at] += val * share[k]
    scale = 1.0 / np.sqrt(mean + 1e-4)
    weight = np.sqrt(share * len(y))[y][:, None]

    def block(first: int) -> np.ndarray:
        """Centred and scaled columns from ``first``; the whole matrix never exists."""
        out = np.zeros((len(rows), COLUMNS))
        for i, (at, val) in enumerate(rows):
            lo, hi = np.searchsorted(at, (first, first + COLUMNS))
            out[i, at[lo:hi] - first] = val[lo:hi]
        out -= mean[first : first + COLUMNS]
        out *= scale[first : first + COLUMNS]
        out *= weight
        return out

    # each language weighs the same: regularised least squares on the bits, solved in the dual
    firsts = range(0, len(mean), COLUMNS)
    k = sum(a @ a.T for a in map(block, firsts))
    dual = np.linalg.solve(k + np.eye(len(k)) * (0.02 * np.trace(k) / len(k) + 1e-9), weight * code[y])
    w = np.concatenate([block(first).T @ dual for first in firsts]) * scale[:, None]
    return Model(languages, code, w.astype(np.float32), -(mean @ w))


def identify(docs: DataFrame, train_on: Column | None = None, text: str = "text", lang: str = "lang", id_col: str = "doc_id", keep: tuple[str, ...] = (), made: tuple[str, str, str, str] = MADE) -> DataFrame:
    """``(<id>, *keep, lang_pred, score, ambiguous, lettered)`` per row, from its whole text alone.

    The classifiers are fitted on rows of ``docs`` where ``train_on`` holds (all, if None). A text that
    is null, or has no letter, is `und` with score 0 and ambiguous; so is every text if no row could be
    learned from. Repeated rows get equal answers, as do equal texts; of codewords that cost the same the
    first language in order of its name is taken, and the answer is ambiguous. Texts of any length are
    read whole, a piece at a time; an empty table gives an empty result. ``keep`` names
    columns to hand on; the others are not read, whatever their names. The score is the best
    codeword's share of exp(-loss) over all codewords; ``lettered`` says that the text has a letter,
    whatever was learned. ``made`` names the last four columns otherwise.
    """
    model = fit(docs if train_on is None else docs.where(train_on), text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS, ORDERS and the code's length
    cols = [docs[id_col], docs[text], *[docs[c] for c in keep]]
    own = [f"c{i}" for i in range(len(cols) - 1 + len(made))]  # in Python and Arrow, where no name of the caller's may clash

    def run(b: pa.RecordBatch):
        m = shared.value
        texts = b.column(1).to_pylist()
        got = [m.decide(t) for t in texts]
        new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_()), pa.array([lettered(t) for t in texts], pa.bool_())]
        yield pa.record_batch([b.column(0), *[b.column(i) for i in range(2, b.num_columns)], *new], own)

    kinds = [*[docs.schema[c].dataType.simpleString() for c in (id_col, *keep)], "string", "double", "boolean", "boolean"]
    return arrow_map(docs.select(*cols), run, ", ".join(map(" ".join, zip(own, kinds, strict=True)))).toDF(id_col, *keep, *made)


__all__ = ["Model", "codewords", "fit", "identify"]
