"""Toxicity by a factorization machine over hashed terms.

A document's terms are its words and the beginnings of its words, hashed to a
fixed number of features. The machine adds a bias, a weight per term and the
inner products of the terms' factors, so that two terms together may count
for more than each by itself. It is fitted to a bounded sample of labelled
documents and scores all documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, alone, batch, blocks, fields, remainder, trimmed, unused
from .license_scan import words_of

BITS, RANK = 18, 4
#: Most labelled documents that the fit may use: those whose ids hash lowest.
SAMPLE = 12_000
#: Lengths of word beginnings that are terms.
PREFIXES = (4, 5, 6)
#: So many documents of the sample show what a term tells, alone (from so many standard deviations on) or with another.
LEAST_DOCUMENTS, TERM_DEVIATIONS = 8, 3.0
#: Documents of each class on which pairs of terms are counted, the least share of toxic ones that a term of a pair is in, and from how many standard deviations on a pair tells.
PAIR_ROWS, PAIR_SHARE, PAIR_DEVIATIONS = 1000, 0.03, 3.5
#: Terms that don't show to tell stay in the machine, and learn at this share of the rate, in one step for so many epochs.
SLOW, SLOW_EPOCHS = 0.003, 6
#: Documents of a step of the fit.
BATCH = 64
THRESHOLD = 0.7


@dataclass
class FactorizationMachine:
    """score = logistic(bias + sum w + sum of inner products of factor pairs), over a document's set of terms."""

    bias: float
    weights: np.ndarray  # (features,)
    factors: np.ndarray  # (features, rank)

    def logits(self, terms: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of documents whose terms stand one after the other, each up to its end."""
        starts = np.concatenate([[0], ends[:-1]])
        w, v = self.weights[terms], self.factors[terms]
        sums = [np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0, dtype=np.float64)]) for x in (w, v, (v * v).sum(1))]
        lin, vec, own = (s[ends] - s[starts] for s in sums)
        return self.bias + lin + 0.5 * ((vec * vec).sum(1) - own)


def word_features(word: bytes) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    mask = (1 << BITS) - 1
    text = word.decode("utf-8", "replace")
    return [zlib.crc32(b"w:" + word) & mask, *[zlib.crc32(f"p{n}:{text[:n]}".encode()) & mask for n in PREFIXES if len(text) > n]]


def terms_of(text: bytes, memo: Memo) -> np.ndarray:
    """The set of features of a text, ascending."""
    out: set[int] = set()
    for w in set(words_of(text)):
        out.update(memo[w])
    return np.array(sorted(out), np.int32)


def pair_terms(docs: list[np.ndarray], labels: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Terms that tell together with another one, by more than both tell alone: a log-linear interaction of PAIR_DEVIATIONS or more.

    Counted on the first PAIR_ROWS documents of each class at most, over terms among ``candidates`` (a mask).
    """
    chosen = [np.flatnonzero(labels > 0)[:PAIR_ROWS], np.flatnonzero(labels <= 0)[:PAIR_ROWS]]
    counts = [np.bincount(np.concatenate([docs[r] for r in rows]), minlength=len(candidates)) for rows in chosen]
    terms = np.flatnonzero(candidates & (counts[0] >= max(LEAST_DOCUMENTS, PAIR_SHARE * len(chosen[0]))))
    place = np.full(len(candidates), -1)
    place[terms] = np.arange(len(terms))
    tables = []
    for rows in chosen:
        x = np.zeros((len(rows), len(terms)), np.float32)
        for i, r in enumerate(rows):
            at = place[docs[r]]
            x[i, at[at >= 0]] = 1
        tables.append(x)
    n, single = [len(r) for r in chosen], [c[terms] for c in counts]
    ratio = np.log((single[0] + 0.5) / (n[0] + 1)) - np.log((single[1] + 0.5) / (n[1] + 1))
    tells = np.zeros(len(terms), bool)
    for at in range(0, len(terms), 256):
        both = [x[:, at : at + 256].T @ x for x in tables]
        own = np.log((both[0] + 0.5) / (n[0] + 1)) - np.log((both[1] + 0.5) / (n[1] + 1)) - ratio[at : at + 256, None] - ratio
        strong = (own / np.sqrt(1 / (both[0] + 0.5) + 1 / (both[1] + 0.5)) >= PAIR_DEVIATIONS) & (both[0] >= LEAST_DOCUMENTS)
        strong[np.arange(len(strong)), at + np.arange(len(strong))] = False
        tells[at : at + 256] |= strong.any(1)
    return terms[tells]


def fit(docs: list[np.ndarray], labels: np.ndarray, epochs: int = 30, rate: float = 0.1, penalty: float = 5e-3, seed: int = 7) -> FactorizationMachine:
    """Mini-batch AdaGrad on the logistic loss; classes weigh alike."""
    size = 1 << BITS
    rng = np.random.default_rng(seed)
    model = FactorizationMachine(0.0, np.zeros(size, np.float32), np.zeros((size, RANK), np.float32))
    labels = np.asarray(labels, np.float64)
    if not len(docs) or labels.min() == labels.max():
        model.bias = (8.0 if labels.min() else -8.0) if len(docs) else -8.0
        return model
    seen = np.bincount(np.concatenate(docs), minlength=size)
    toxic = np.bincount(np.concatenate([d for d, y in zip(docs, labels) if y]), minlength=size)
    rate_toxic = (toxic + 0.5) / (labels.sum() + 1)
    rate_clean = (seen - toxic + 0.5) / (len(labels) - labels.sum() + 1)
    common = seen >= LEAST_DOCUMENTS
    ratio, deviation = np.abs(np.log(rate_toxic / rate_clean)), np.sqrt(1 / (toxic + 0.5) + 1 / (seen - toxic + 0.5))
    tells = common & (seen <= 0.5 * len(docs)) & (ratio > 1.0) & (ratio > TERM_DEVIATIONS * deviation)
    tells[pair_terms(docs, labels, common)] = True
    model.factors[seen > 0] = rng.normal(0, 0.01, (int((seen > 0).sum()), RANK))
    importance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    fast, slow = np.flatnonzero(tells), (seen > 0) & ~tells
    place = np.full(size, -1)
    place[fast] = np.arange(len(fast))
    order = rng.permutation(len(docs))
    batches = [(order[at : at + BATCH], _bits(docs, order[at : at + BATCH], place, len(fast))) for at in range(0, len(order), BATCH)]
    w, v = np.zeros(len(fast), np.float32), model.factors[fast]
    g_b, g_w, g_v = 1e-6, np.full(len(fast), 1e-6, np.float32), np.full((len(fast), RANK), 1e-6, np.float32)
    slow_w, slow_v = np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    rest, told = _sums_of(docs, model, slow), np.zeros((len(docs), 1 + RANK))
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            rows, bits = batches[k]
            x = np.unpackbits(bits, axis=1, count=len(fast)).astype(np.float32)
            sums = rest[rows] + x @ np.concatenate([w[:, None], v, (v * v).sum(1)[:, None]], 1)
            vec = sums[:, 1:-1]
            z = model.bias + sums[:, 0] + 0.5 * ((vec * vec).sum(1) - sums[:, -1])
            error = (1 / (1 + np.exp(-np.clip(z, -80, 80))) - labels[rows]) * importance[rows] / len(rows)
            own = np.concatenate([error[:, None], error[:, None] * vec], 1).astype(np.float32)
            told[rows] = own
            back, used = x.T @ own, x.any(0)
            dw, dv = back[:, 0] + penalty * used * w, back[:, 1:] - back[:, :1] * v + penalty * used[:, None] * v
            db = float(error.sum())
            g_b += db * db
            g_w += dw * dw
            g_v += dv * dv
            model.bias -= rate * db / math.sqrt(g_b)
            w -= rate * dw / np.sqrt(g_w)
            v -= rate * dv / np.sqrt(g_v)
        if epoch % SLOW_EPOCHS == SLOW_EPOCHS - 1:
            back = _back_to_terms(docs, told)
            dw, dv = (back[:, 0] + penalty * model.weights) * slow, (back[:, 1:] - back[:, :1] * model.factors + penalty * model.factors) * slow[:, None]
            slow_w += dw * dw
            slow_v += dv * dv
            model.weights -= (rate * SLOW * dw / np.sqrt(slow_w)).astype(np.float32)
            model.factors -= (rate * SLOW * dv / np.sqrt(slow_v)).astype(np.float32)
            rest = _sums_of(docs, model, slow)
    model.weights[fast], model.factors[fast] = w, v
    return model


def _bits(docs: list[np.ndarray], rows: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """A bit for each row and each of ``n`` placed terms."""
    x = np.zeros((len(rows), n), np.uint8)
    for i, r in enumerate(rows):
        at = place[docs[r]]
        x[i, at[at >= 0]] = 1
    return np.packbits(x, axis=1)


def _parts(docs: list[np.ndarray], size: int = 1000) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Documents in parts: which, their terms one after the other, and how many each has."""
    for at in range(0, len(docs), size):
        rows = slice(at, at + size)
        yield rows, np.concatenate(docs[rows]), np.array([len(d) for d in docs[rows]])


def _sums_of(docs: list[np.ndarray], model: FactorizationMachine, terms: np.ndarray) -> np.ndarray:
    """Of each document: sums of the weights, factors and squared factors of those of its terms that are in a mask."""
    table = np.concatenate([model.weights[:, None], model.factors, (model.factors**2).sum(1)[:, None]], 1).astype(np.float32) * terms[:, None]
    out = np.zeros((len(docs), RANK + 2), np.float32)
    for rows, every, lengths in _parts(docs):
        some = np.flatnonzero(lengths)
        out[rows][some] = np.add.reduceat(table[every], (np.cumsum(lengths) - lengths)[some], axis=0) if len(some) else 0.0
    return out


def _back_to_terms(docs: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """Sums over the documents that hold each term."""
    out = np.zeros((1 << BITS, own.shape[1]))
    for rows, every, lengths in _parts(docs):
        for k in range(own.shape[1]):
            out[:, k] += np.bincount(every, np.repeat(own[rows, k], lengths), 1 << BITS)
    return out


def calibrated(docs: list[np.ndarray], labels: np.ndarray, prior: float = 1.0) -> FactorizationMachine:
    """Fitted to four fifths of the rows and scaled on the last fifth, which the fit hasn't seen.

    Scaling is logistic regression on the machine's own logit with a prior of
    no change; it stretches the gap that penalties shrink.
    """
    last = np.arange(len(docs)) % 5 == 4
    model = fit([d for d, l in zip(docs, last) if not l], labels[~last])
    y = np.asarray(labels[last], np.float64)
    if not len(y) or y.min() == y.max():
        return model
    held = [d for d, l in zip(docs, last) if l]
    z = np.clip(model.logits(np.concatenate(held), np.cumsum([len(d) for d in held])), -30, 30)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        slope = np.array([(g * z).sum() + prior * (a - 1), g.sum() + prior * b])
        curve = np.array([[(h * z * z).sum() + prior, (h * z).sum()], [(h * z).sum(), h.sum() + prior]])
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        a, b = max(0.1, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return FactorizationMachine(a * model.bias + b, (a * model.weights).astype(np.float32), (math.sqrt(a) * model.factors).astype(np.float32))


_TERMS, _TERMS_ARROW = fields("toxic:int times:long terms:binary")


def packed(terms: np.ndarray) -> bytes:
    """Ascending terms as compressed steps: a third of the room on the way to the driver."""
    return zlib.compress(np.diff(terms, prepend=np.int32(0)).astype("<i4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"), dtype=np.int32)


def _as_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone("toxicity")
    memo = Memo(word_features)
    for b in batches:
        texts = [t for block in blocks(b.column(0)) for t in block]
        yield batch(_TERMS_ARROW, b.column(1), b.column(2), [packed(terms_of(t, memo)) for t in texts])


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> FactorizationMachine:
    """Fitted to at most ``sample`` labelled rows whose crc32 of the id, modulo 3, is not 1.

    Null labels are left out. The rows are those with the lowest hash of their
    id and text, so that runs agree. Only hashed terms of the sample reach the
    driver: at most 2^BITS of a document, however long.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    known = known.where(remainder(F.col("id"), 3) != 1).groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("content"), F.col(f"`{text}`").alias("text"))
    slim = rows.select("doc", "content").join(known, F.col("doc") == F.col("id")).orderBy(F.xxhash64("doc"), "doc", "content").limit(sample)
    keys = slim.groupBy("doc", "content").agg(F.max("toxic").alias("toxic"), F.count("*").alias("times"))
    # at most ``sample`` rows: small enough for every worker; rows alike in id and text come once, with their number
    chosen = rows.join(F.broadcast(keys), ["doc", "content"]).dropDuplicates(["doc", "content"]).select("text", "toxic", "times")
    found = chosen.mapInArrow(_as_terms, _TERMS).toArrow()
    marks = np.repeat(found["toxic"].to_numpy(), found["times"].to_numpy())
    terms = [t for x, n in zip(found["terms"].to_pylist(), found["times"].to_pylist()) for t in [unpacked(x)] * n]
    order = sorted(range(len(marks)), key=lambda i: (marks[i], len(terms[i]), zlib.crc32(terms[i]), terms[i].tobytes() if len(terms[i]) < 64 else b""))
    model = calibrated([terms[i] for i in order], marks[order] if len(order) else marks)
    del found, terms
    trimmed()
    return model


def scorer(spark, model: FactorizationMachine):
    """An Arrow function: text to probability."""
    used = np.flatnonzero(model.weights)
    shared = spark.sparkContext.broadcast((model.bias, used, model.weights[used], model.factors[used]))
    held: dict = {}

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        alone("toxicity")
        if not held:
            bias, where, w, v = shared.value
            place = np.full(1 << BITS, -1, np.int32)
            place[where] = np.arange(len(where))
            held["machine"] = FactorizationMachine(bias, w.astype(np.float64), v.astype(np.float64))
            held["memo"] = Memo(lambda word: tuple(int(place[f]) for f in word_features(word) if place[f] >= 0))
        machine, memo, out = held["machine"], held["memo"], []
        for block in blocks(texts):
            docs = [terms_of(t, memo) for t in block]
            ends = np.cumsum([len(d) for d in docs])
            z = machine.logits(np.concatenate(docs) if docs else np.zeros(0, np.int32), ends)
            out.append(1 / (1 + np.exp(-np.clip(z, -700, 700))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic.

    A null or empty text has no terms: its score follows from the bias. With
    no usable label all scores are near 0. Rows and other columns stay; an
    existing column ``into`` is replaced.
    """
    score = scorer(docs.sparkSession, trained(docs, labels, doc_id, text))
    return docs.withColumn(into, score(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def toxicity_filter(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` below the threshold, with the columns they came with."""
    mark = unused("toxicity", docs)
    return toxicity_scores(docs, labels, doc_id, text, mark).where(F.col(mark) < threshold).drop(mark)
