"""Language identification by error-correcting output codes.

Every language gets a codeword of bits; for each bit a binary logistic classifier over hashed character n-grams predicts
its value.  A text is decoded to the language whose codeword has the least total logistic loss against the real-valued
bit predictions (loss-weighted decoding); a small margin to the second-nearest codeword flags the text as ambiguous.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.text import map_texts, quoted, share_bound

#: n-gram hash buckets, and the rows that the classifiers are fitted on at most (about; shared out by language).
BUCKETS, SAMPLE_ROWS = 1 << 12, 3200
#: Languages learned at most, and sampled rows of each at least.
MOST_LANGUAGES, LEAST_EACH = 256, 12
#: Texts counted at once: each has a row of all buckets.
TEXTS_AT_ONCE = 512


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of +1/-1: the exhaustive code for up to 5 classes, else random bits, best of 50 draws by least distance."""
    if k <= 1:
        return np.ones((max(k, 1), 1), np.float32)
    if k <= 5:
        bits = [c for c in itertools.product([1, -1], repeat=k) if c[0] == 1 and -1 in c]
        return np.array(bits, np.float32).T.copy()
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, most = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (k, length))
        least = min(int((code[i] != np.delete(code, i, 0)).sum(1).min()) for i in range(k))
        if least > most:
            best, most = code, least
    return best


def ngram_counts(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Relative frequencies of hashed character 1- to 3-grams of each whole text, L2-normalised square roots; has-a-letter."""
    lowered = [t.decode("utf-8", "replace").lower() for t in texts]
    lettered = np.fromiter((any(map(str.isalpha, t)) for t in lowered), bool, len(texts))
    size = np.fromiter(map(len, lowered), np.int64, len(texts))
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), size)
    out = np.zeros(len(texts) * buckets, np.float32)
    h = np.zeros(len(code), np.uint64)
    for n in range(1, 4):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(1_000_003) + code[n - 1 :] + np.uint64(n)
        cell = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets
        inside = doc[:m] == doc[n - 1 :] if n > 1 else slice(None)
        out += np.bincount(doc[:m][inside] * buckets + cell[inside], minlength=len(out)).astype(np.float32)
    out = np.sqrt(out.reshape(len(texts), buckets))
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out, lettered


class Ecoc:
    def __init__(self, classes: list[str], code: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> None:
        self.classes, self.code, self.weight, self.bias = classes, code, weight, bias

    @staticmethod
    def fit(x: np.ndarray, labels: list[str], steps: int = 150, rate: float = 0.05, decay: float = 1e-5) -> Ecoc:
        """Adam on the logistic loss of each bit, classes weighted equally."""
        classes = sorted(set(labels))
        code = codewords(len(classes))
        at = np.array([classes.index(c) for c in labels])
        y, row = code[at], (1.0 / np.bincount(at, minlength=len(classes))[at] / len(classes)).astype(np.float32)[:, None]
        weight, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        m = [np.zeros_like(weight), np.zeros_like(bias)]
        v = [np.zeros_like(weight), np.zeros_like(bias)]
        for t in range(1, steps + 1):
            f = x @ weight + bias
            g = -y * row / (1 + np.exp(np.clip(y * f, -30, 30)))
            for i, (p, grad) in enumerate(((weight, x.T @ g + decay * weight), (bias, g.sum(0)))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                p -= rate * 10 ** (i == 0) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return Ecoc(classes, code, weight, bias)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest class, its score (softmax of the negated losses) and the margin in loss to the second nearest."""
        f = np.clip(x @ self.weight + self.bias, -30, 30)
        loss = np.log1p(np.exp(-self.code[None] * f[:, None, :])).sum(2)
        best = loss.argmin(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else loss[:, 0] + 30
        return best, p.max(1) / p.sum(1), second - loss.min(1)


def fitted(
    docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, most_languages: int = MOST_LANGUAGES
) -> Ecoc | None:
    """Fit on a deterministic sample of about ``sample_rows`` rows for which ``learn`` holds and lang and text are not null.

    The rows are shared out by language, LEAST_EACH at least.  The ``most_languages`` languages of the most documents are
    learned, so that a column of stray values makes neither the sample nor the code unbounded.  None if nothing can be
    learned.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).cast("string").alias("__text"), F.col(quoted(lang_col)).cast("string").alias("__lang"), learn.alias("__learn"))
    rows = rows.where(F.col("__learn") & F.col("__lang").isNotNull() & F.col("__text").isNotNull())
    counts = rows.groupBy("__lang").agg(F.approx_count_distinct(F.xxhash64("__id"), 0.02).alias("n")).orderBy(F.desc("n"), "__lang").limit(most_languages).collect()
    if not counts:
        return None
    each = max(LEAST_EACH, sample_rows // len(counts))
    bounds = docs.sparkSession.createDataFrame([(lang, share_bound(each, n)) for lang, n in counts], "__lang string, __below bigint")
    picked = rows.join(F.broadcast(bounds), "__lang").where(F.col("__below").isNull() | (F.xxhash64("__id") < F.col("__below")))
    # repeated rows count once, so that one hot id cannot fill the sample
    picked = picked.groupBy("__id", "__lang").agg(F.min("__text").alias("__text"))

    def make():
        def work(texts: list[bytes]) -> list:
            x, lettered = ngram_counts(texts)
            return [pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()), pa.array(lettered)]

        return work

    fields = [T.StructField("__x", T.BinaryType()), T.StructField("__lettered", T.BooleanType())]
    got = sorted(map(tuple, map_texts(picked, "__text", ["__id", "__lang"], fields, make, rows=TEXTS_AT_ONCE).where("__lettered").collect()), key=lambda r: (str(r[0]), r[1]))
    if not got:
        return None
    x = np.stack([np.frombuffer(r[2], np.float16).astype(np.float32) for r in got])
    return Ecoc.fit(x, [r[1] for r in got])


def identify(docs: DataFrame, model: Ecoc | None, *, keep: list[str] | None = None, text_col: str = "text", margin: float = 1.0) -> DataFrame:
    """``keep`` columns plus ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    ``und`` with score 0, flagged ambiguous, if the text is null, empty or has no letter, or if nothing could be learned.
    Whole texts of any length are read in place, without a shuffle.  Ties go to the first language by name.
    """

    def make():
        def work(texts: list[bytes]) -> list:
            if model is None:
                return [["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)]
            x, lettered = ngram_counts(texts)
            best, score, gap = model.decode(x)
            names = [model.classes[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
            return [names, pa.array(np.where(lettered, score, 0.0).astype(np.float64)), pa.array((gap < margin) | ~lettered)]

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return map_texts(docs, text_col, ["doc_id"] if keep is None else keep, fields, make, rows=TEXTS_AT_ONCE)
