"""Toxicity by non-negative positive-unlabelled learning.

A linear model on the words of a text is trained in numpy from confirmed toxic texts (P) and
texts of unknown kind (U).  With the class prior p and the logistic loss l, its risk is

    p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]),

the second part being the risk on clean texts, estimated without any; where that estimate falls
below zero the step is turned round, which keeps the model from learning U's toxic texts as clean.

Features are the distinct words (letters and non-ASCII bytes, lower case) that stand out in P.
The fit uses a bounded sample: at most `max_positive` and `max_unlabelled` texts, the first by a
hash of doc_id, one row of each doc_id.  Scoring reads every whole text, on the executors, with the small model.

Edge cases: null and empty texts have no words and score as such; very long texts are read whole; a
score of exactly 0.5 is predicted toxic, and goes in the pipeline; of rows that share a doc_id the first text
in order is learnt from, all are scored; without a confirmed toxic text
all scores are 0; label rows that are null, repeated or without a text count once or not at all;
an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaicore.llm.bytestext import Words, byte_class, text_arrays
from mosaicore.llm.common import bounded, first_by_hash, pick, tidied

NOT_LETTER = byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


@dataclass(frozen=True)
class Model:
    """Sorted 32-bit word features with their weights, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 32-bit feature) of each word of a slice of texts."""
    words = Words(data, offsets, NOT_LETTER)
    return words.doc, (words.hash >> np.uint64(32)).astype(np.uint32)


def score_arrays(column: pa.Array, model: Model) -> np.ndarray:
    """The scores of a column of texts."""
    out = np.full(len(column), model.bias)
    for row, data, offsets in text_arrays(column):
        doc, feature = word_features(data, offsets)
        if len(model.features):
            at = np.minimum(np.searchsorted(model.features, feature), len(model.features) - 1)
            hit = model.features[at] == feature
            pairs = np.unique(doc[hit] * len(model.features) + at[hit])
            np.add.at(out, row + pairs // len(model.features), model.weights[pairs % len(model.features)])
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learnt: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def nn_pu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (Adam on the whole sample)."""
    d = p.shape[1]
    w = np.zeros(d + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    logistic = lambda z: 1 / (1 + np.exp(-z))
    for t in range(1, steps + 1):
        fp, fu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        gp, gp_neg, gu_neg = -logistic(-fp), logistic(fp), logistic(fu)  # slopes of l(f), l(-f)
        clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        sp, su = prior * gp / len(p), np.zeros(len(u))
        if clean >= 0:
            sp, su = sp - prior * gp_neg / len(p), gu_neg / len(u)
        else:  # only the step that brings the clean risk back above zero
            sp, su = prior * gp_neg / len(p), -gu_neg / len(u)
        g = np.append(sp @ p + su @ u + l2 * w[:-1], sp.sum() + su.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def select_features(p: list[np.ndarray], u: list[np.ndarray], most: int, least_z: float) -> np.ndarray:
    """Features in more of P's texts than of U's, by z-score, the strongest `most` of them; the first 16 may fall short a little."""
    ids, counts = np.unique(np.concatenate(p), return_counts=True)
    other, other_counts = np.unique(np.concatenate(u), return_counts=True)
    in_u = np.zeros(len(ids))
    at = np.minimum(np.searchsorted(other, ids), len(other) - 1)
    same = other[at] == ids
    in_u[same] = other_counts[at[same]]
    pooled = np.clip((counts + in_u + 1) / (len(p) + len(u) + 2), 1e-9, 1 - 1e-9)
    z = (counts / len(p) - in_u / len(u)) / np.sqrt(pooled * (1 - pooled) * (1 / len(p) + 1 / len(u)))
    best = np.lexsort((ids, -z))[:most]
    good = (z[best] >= least_z) | (np.arange(len(best)) < 16) & (z[best] >= least_z - 0.5)
    good[:1] = True
    return np.sort(ids[best[good]])


def fit(docs: DataFrame, labels: DataFrame, *, max_positive: int = 4000, max_unlabelled: int = 8000, prior: float | None = None, most_features: int = 512, least_z: float = 4.5) -> Model:
    """The model learnt from labels.toxic = 1 (and the prior, if it is not given, from the labels' share of 1).

    Label rows and texts that `held_out` marks take no part.
    """
    labels = pick(labels, doc_id="doc_id", toxic="toxic").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    docs = pick(docs, doc_id="doc_id", text="text").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    if prior is None:
        prior = labels.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    positive, unlabelled = labels.where("toxic = 1").select("doc_id").distinct(), docs.select("doc_id")
    wanted: dict[int, int] = {}
    for bit, rows, most in ((1, positive, max_positive), (2, unlabelled, max_unlabelled)):
        for (doc,) in first_by_hash(rows, most, rows.count()):  # bounded by the two parameters
            wanted[doc] = wanted.get(doc, 0) | bit
    if not any(k & 1 for k in wanted.values()) or not any(k & 2 for k in wanted.values()):
        return Model(np.zeros(0, np.uint32), np.zeros(0), -500.0)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_arrays(batch.column(1)):
                doc, feature = word_features(data, offsets)
                pairs = np.unique(doc.astype(np.uint64) << np.uint64(32) | feature)
                bounds = np.searchsorted(pairs, np.arange(len(offsets), dtype=np.uint64) << np.uint64(32)).tolist()
                found = [(pairs[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[row : row + len(found)], batch.column(2)[row : row + len(found)], pa.array(found, pa.binary())], names=["doc_id", "part", "found"])

    sample = docs.sparkSession.createDataFrame(list(wanted.items()), "doc_id long, part int")
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "part").agg(F.min("text").alias("text")).select("doc_id", "text", "part")  # one text of each id
    rows = rows.mapInArrow(tidied(featurise), "doc_id long, part int, found binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.found))
    found = {bit: [np.frombuffer(r.found, "<u4") for r in rows if r.part & bit] for bit in (1, 2)}
    if not found[1] or not found[2] or not sum(map(len, found[1])) or not sum(map(len, found[2])):
        return Model(np.zeros(0, np.uint32), np.zeros(0), -500.0)
    features = select_features(found[1], found[2], most_features, least_z)

    def matrix(sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), len(features)), np.float32)
        for i, own in enumerate(sets):
            x[i] = np.isin(features, own, assume_unique=True)
        return x

    weights, bias = nn_pu(matrix(found[1]), matrix(found[2]), min(max(prior, 1e-3), 0.99))
    return Model(features, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_arrays(batch.column(1), model))], names=["doc_id", "score"])

    rows = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(tidied(each), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    text_at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.less(pa.array(score_arrays(batch.column(text_at), model)), threshold))

    return bounded(docs).mapInArrow(tidied(each), docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document, the model being fitted first."""
    return score(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
