import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import langid, toxicity
from inkwell.llm.queries import op6_toxicity, op7_language_id, table
from inkwell.llm.text import Words, learned_fold

SF = "/root/testdata/sf0.01"


def test_codewords_are_apart():
    for k in (2, 3, 5, 9, 40):
        code = langid.codewords(k)
        assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= (1 if k == 2 else code.shape[1] // 4)
    assert langid.codewords(1).shape == (1, 1)


def test_folds(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", learned_fold(F.col("doc_id")).alias("learn"))
    for r in rows.collect():
        assert r.learn == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 != 0)


def test_ngram_counts_by_hand():
    x, lettered = langid.ngram_counts(["Ab".encode(), b"", "12 3".encode(), "ab".encode()])
    assert lettered.tolist() == [True, False, False, True]
    assert np.allclose(x[0], x[3]) and np.isclose(np.linalg.norm(x[0]), 1) and not x[1].any()
    assert (x[0] > 0).sum() == 3  # a, b, ab


def test_language_query(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    rows = op7_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert 0.1 < len(held) / len(rows) < 0.3
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_by_brute_force(spark):
    """The query's rows, from features counted one by one and codewords decoded one by one."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.fitted(docs, learned_fold(F.col("doc_id")))
    rows = {r.doc_id: r for r in op7_language_id(spark, "/root/testdata/sf0.001").collect()}
    wrap = (1 << 64) - 1
    for d in docs.collect()[::4]:
        text, counts = (d.text or "").lower(), np.zeros(langid.BUCKETS)
        for i in range(len(text)):
            h = 0
            for n in range(1, min(3, len(text) - i) + 1):
                h = h * 1_000_003 + ord(text[i + n - 1]) + n & wrap
                counts[(h * 0x9E3779B97F4A7C15 & wrap) >> 40 & langid.BUCKETS - 1] += 1
        x = np.sqrt(counts) / max(np.sqrt(counts.sum()), 1e-9)
        bits = x @ model.weight + model.bias
        loss = [sum(np.log1p(np.exp(-y * f)) for y, f in zip(code, bits, strict=True)) for code in model.code]
        order = np.argsort(loss)
        r = rows[d.doc_id]
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)
        elif loss[order[1]] - loss[order[0]] > 1e-3:
            assert r.lang_pred == model.classes[order[0]]
            assert abs(r.score - 1 / sum(np.exp(loss[order[0]] - x) for x in loss)) < 1e-3
            assert r.ambiguous == (loss[order[1]] - loss[order[0]] < 1.0) or abs(loss[order[1]] - loss[order[0]] - 1.0) < 1e-3


def test_scores_by_brute_force(spark):
    """The query's scores, from the words that a pattern finds."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = toxicity.fitted(docs, table(spark, "/root/testdata/sf0.001", "labels"), learned_fold)
    rows = {r.doc_id: r for r in op6_toxicity(spark, "/root/testdata/sf0.001").collect()}
    for d in docs.collect():
        words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (d.text or "").translate({c: c + 32 for c in range(65, 91)})))
        buckets = {int(Words([w.encode()]).hash[0]) % toxicity.BUCKETS for w in words}
        wanted = 1 / (1 + np.exp(-np.clip(model.bias + sum(float(model.weight[b]) for b in buckets), -30, 30)))
        assert abs(rows[d.doc_id].score - wanted) < 1e-6


def test_many_languages_are_bounded(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3).alias("text"), F.when(F.col("id") % 2 == 0, "aa").otherwise(F.concat(F.lit("x"), "id")).alias("lang"))
    model = langid.fitted(docs, learned_fold(F.col("doc_id")), most_languages=7)
    assert len(model.classes) == 7 and "aa" in model.classes


def test_language_of_odd_rows(spark):
    docs = table(spark, SF, "documents")
    model = langid.fitted(docs, learned_fold(F.col("doc_id")))
    odd = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "123 !?", None), (3, "123 !?", None), (4, "the " * 200_000, None)], "doc_id long, text string, `lang.pred` string")
    found = langid.identify(odd, model, keep=odd.columns).collect()
    assert [(r.doc_id, r.lang_pred, r.score) for r in found if r.doc_id != 4] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (3, "und", 0.0)]
    assert [r.lang_pred for r in found if r.doc_id == 4] == ["en"]
    assert langid.identify(odd.limit(0), model).count() == 0
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.fitted(none, learned_fold(F.col("doc_id"))) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    one = langid.fitted(docs.where("lang = 'fr'"), learned_fold(F.col("doc_id")))
    assert {r.lang_pred for r in langid.identify(docs.limit(5), one).collect()} == {"fr"}


def test_toxicity_query(spark):
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    rows = op6_toxicity(spark, "/root/testdata/sf0.1").collect()
    labels = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [s for s, t, _ in held if t], [s for s, t, _ in held if not t]
    auc = np.mean([[(a > b) + (a == b) / 2 for b in clean] for a in toxic])
    assert auc > 0.9
    flagged = [t for _, t, p in held if p]
    assert sum(flagged) >= 0.9 * len(flagged) and sum(flagged) >= 0.7 * len(toxic)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_non_negative_risk_stays_finite():
    rng = np.random.default_rng(0)
    bad = [np.array(sorted({1, *rng.integers(10, 60, 8)})) for _ in range(40)]
    clean = [np.array(sorted(set(rng.integers(10, 60, 8).tolist()))) for _ in range(200)]
    hidden = [np.array(sorted({1, *rng.integers(10, 60, 8)})) for _ in range(20)]
    model = toxicity.NnPu.fit(bad, clean + hidden, 0.1, buckets=64)
    assert np.isfinite(model.weight).all() and model.weight[1] > 1.5 * np.abs(model.weight[10:60]).max()
    score = lambda x: model.score(np.zeros(len(x), np.int64), x, 1)[0]
    assert np.mean([score(x) for x in hidden]) > np.mean([score(x) for x in clean]) + 0.2


def test_toxicity_of_odd_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fitted(docs, labels, learned_fold)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "idiot idiot"), (2, "")], "doc_id long, text string")
    rows = toxicity.scored(odd, model, keep=["doc_id"]).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert toxicity.scored(odd.limit(0), model).count() == 0
    assert toxicity.fitted(docs, labels.limit(0), learned_fold) is None
    assert {r.predicted for r in toxicity.scored(odd, None).collect()} == {0}
    lost = spark.createDataFrame([(10**9 + i, 1, 1) for i in range(5000)], labels.schema)  # labels of no document
    assert np.allclose(toxicity.fitted(docs, labels.union(lost), learned_fold).weight, model.weight)
    assert toxicity.fitted(docs, lost, learned_fold) is None and toxicity.fitted(docs.limit(0), labels, learned_fold) is None
    twice = labels.union(labels).union(spark.createDataFrame([(None, 1, 1), (3, 1, None)], labels.schema))
    again = toxicity.fitted(docs.union(docs), twice, learned_fold)
    assert np.allclose(again.weight, model.weight, atol=0.2)


@pytest.mark.parametrize("query", [op6_toxicity, op7_language_id])
def test_same_answer_twice(spark, query):
    first, second = (sorted(map(tuple, query(spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert first == second
