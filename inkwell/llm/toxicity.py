"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words is trained in numpy from confirmed toxic texts (positives) and unlabelled texts with the
class-prior-corrected risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)); where the bracket is negative, its gradient is
taken the other way, as in the non-negative estimator of Kiryo et al. (2017).  Labels of clean texts are never used but
for the class prior pi.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.text import Words, below, map_texts, quoted, sampled, share_bound

#: Word hash buckets; the positives and the unlabelled rows that the model is fitted on at most (about).
BUCKETS, POSITIVE_ROWS, UNLABELLED_ROWS = 1 << 18, 3000, 9000


def word_features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every distinct hashed word of each whole text, sorted by text."""
    words = Words(texts)
    both = np.unique(words.doc.astype(np.int64) * buckets + (words.hash & np.uint64(buckets - 1)).astype(np.int64))
    return both // buckets, both % buckets


class NnPu:
    """score = sigmoid(bias + sum of the weights of a text's distinct words)."""

    def __init__(self, weight: np.ndarray, bias: float) -> None:
        self.weight, self.bias = weight, bias

    @staticmethod
    def fit(
        positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, buckets: int = BUCKETS, steps: int = 200, rate: float = 0.05,
        shrink: float = 2e-4, least_texts: int = 5,
    ) -> NnPu:
        """Adam on the risk with a soft-threshold step (L1) of ``shrink``; words of under ``least_texts`` texts get weight 0."""
        texts = [*positive, *unlabelled]
        n_p, n_u = len(positive), len(unlabelled)
        col = np.concatenate(texts).astype(np.int64) if texts else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        known = np.bincount(col, minlength=buckets) >= least_texts
        inside = known[col]
        used = np.flatnonzero(known)
        col, row = np.searchsorted(used, col[inside]), row[inside]
        w, b = np.zeros(len(used)), np.log(prior / (1 - prior))
        m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
        for t in range(1, steps + 1):
            f = np.clip(b + np.bincount(row, w[col], minlength=len(texts)), -30, 30)
            p = 1 / (1 + np.exp(-f))  # logistic loss: -log p for +, -log(1 - p) for -
            clean = -np.log1p(-np.minimum(p, 1 - 1e-12))
            bracket = clean[n_p:].mean() - prior * clean[:n_p].mean()
            g = np.empty(len(texts))
            if bracket >= 0:
                g[:n_p] = prior * ((p[:n_p] - 1) - p[:n_p]) / n_p
                g[n_p:] = p[n_p:] / n_u
            else:  # step back from the overfitted bracket
                g[:n_p] = prior * p[:n_p] / n_p
                g[n_p:] = -p[n_p:] / n_u
            gw, gb = np.bincount(col, g[row], minlength=len(used)), g.sum()
            m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            size = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w -= size * m / (1 - 0.9**t)
            w = np.sign(w) * np.maximum(np.abs(w) - size * shrink, 0)
            b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
        weight = np.zeros(buckets, np.float32)
        weight[used] = w
        return NnPu(weight, float(b))

    def score(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(doc, self.weight[bucket], minlength=n), -30, 30)))


def fitted(
    docs: DataFrame, labels: DataFrame, learn, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", toxic_col: str = "toxic",
    positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS,
) -> NnPu | None:
    """Fit on bounded deterministic samples of the rows for which ``learn(id column)`` holds; None without any positive.

    The prior is the share of label 1 among all those labels.  The unlabelled sample is of all learnable documents that
    are not among the sampled positives (of those, if there are no others).  Repeated ids count once; null ids, texts and
    labels, and labels of no document, take no part.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).cast("string").alias("__text")).where(F.col("__text").isNotNull() & F.col("__id").isNotNull())
    rows = rows.where(learn(F.col("__id")))
    tagged = labels.select(F.col(quoted(label_id_col)).alias("__id"), F.col(quoted(toxic_col)).cast("int").alias("__toxic"))
    tagged = tagged.where(F.col("__id").isNotNull() & F.col("__toxic").isNotNull() & learn(F.col("__id"))).join(rows.select("__id").distinct(), "__id", "left_semi")
    n, toxic = tagged.agg(F.count("*"), F.coalesce(F.sum((F.col("__toxic") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return None
    prior = float(np.clip(toxic / n, 0.01, 0.9))
    chosen = sampled(tagged.where(F.col("__toxic") == 1), positive_rows, F.col("__id")).select("__id").distinct()
    ids = F.broadcast(chosen.withColumn("__p", F.lit(True)))  # about positive_rows ids, however many there are
    total = rows.select(F.approx_count_distinct("__id", 0.02)).first()[0]
    rows = rows.join(ids, "__id", "left")
    rows = rows.where(F.col("__p") | below(share_bound(unlabelled_rows, total), F.col("__id"), F.lit("u")))
    rows = rows.groupBy("__id").agg(F.min("__text").alias("__text"), F.max("__p").alias("__p"))
    got = sorted(map(tuple, _featured(rows).collect()), key=lambda r: str(r[0]))
    positive = [np.frombuffer(r[2], np.int32) for r in got if r[1]]
    unlabelled = [np.frombuffer(r[2], np.int32) for r in got if not r[1]]
    if not positive:
        raise ValueError("there are toxic documents, but none is in the sample")
    return NnPu.fit(positive, unlabelled or positive, prior)


def _featured(rows: DataFrame) -> DataFrame:
    def make():
        def work(texts: list[bytes]) -> list:
            doc, bucket = word_features(texts)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            return [pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())]

        return work

    return map_texts(rows, "__text", ["__id", "__p"], [T.StructField("__x", T.BinaryType())], make)


def scored(docs: DataFrame, model: NnPu | None, *, keep: list[str] | None = None, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """``keep`` columns plus ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 if score >= ``cut``).

    A null or empty text gets the score of no words; without a model every score is 0.  Whole texts, read in place.
    """

    def make():
        def work(texts: list[bytes]) -> list:
            score = model.score(*word_features(texts), len(texts)) if model else np.zeros(len(texts))
            return [pa.array(score), pa.array((score >= cut).astype(np.int32))]

        return work

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_texts(docs, text_col, ["doc_id"] if keep is None else keep, fields, make)
