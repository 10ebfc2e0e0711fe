import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import text
from inkwell.llm.text import Words

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))


@given(st.lists(st.text(alphabet="aB1 .é漢\x00\n", max_size=12), max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_and_grams(texts):
    words = Words([t.encode() for t in texts])
    wanted = [plain_words(t) for t in texts]
    assert [[words.word(i).decode() for i in range(words.first[d], words.first[d + 1])] for d in range(len(texts))] == wanted
    flat = [w for x in wanted for w in x]
    same = {}
    for w, h in zip(flat, words.hash.tolist(), strict=True):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)
    grams, at = words.grams(2)
    assert len(grams) == sum(max(0, len(x) - 1) for x in wanted)
    assert (np.diff(at) > 0).all()


def test_samples_hold_at_any_size():
    for total in (10**6, 10**8, 10**10, 10**12):
        for n in (400, 20_000):
            bound = text.share_bound(n, total)
            assert abs((bound + 2**63) / 2**64 * total - n) < 1e-6 * n
    assert text.share_bound(400, 400) is None and text.share_bound(400, 10) is None


def test_sample_of_distinct_values(spark):
    hot = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    found = text.sampled(hot, 1000, F.col("v"))
    assert 800 < found.where("v >= 0").count() < 1200
    assert text.sampled(hot.limit(50), 1000, F.col("v")).count() == 50
    assert text.sampled(hot.limit(0), 1000, F.col("v")).count() == 0


def test_no_local_folder_on_a_cluster():
    assert text._placed("hdfs://store/x/", "yarn", "w").startswith("hdfs://store/x/w-")
    for master in ("local", "local[*]", "local[8]"):
        assert text._placed(None, master, "w").startswith("file:///")
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            text._placed(None, master, "w")


def test_dealt_join(spark):
    left = text.saved(spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(1)).otherwise(F.col("id")).alias("k"), "id"), "left")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (5, "c"), (None, "d")], "k long, v string")
    for how in ("inner", "left", "left_semi"):
        dealt, plain = (sorted(map(str, x.collect())) for x in (text.dealt_join(left, right, "k", how), left.join(right, "k", how)))
        assert dealt == plain
    assert text.dealt_join(left.limit(0), right, "k").count() == 0


def test_chunks_by_bytes_and_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["", None, "abc"] * 30_000)], names=["t"])
    sizes = [len(texts) for _, texts in text.chunks(batch, "t")]
    assert sum(sizes) == 90_000 and max(sizes) <= text.CHUNK_ROWS < 1 << 16
    assert [len(x) for _, x in text.chunks(batch.slice(0, 9), "t", most=3, rows=2)] == [2, 2, 2, 2, 1]
