import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import winnow
from inkwell.llm.queries import OP9_SQL, op9_decontamination
from inkwell.llm.text import hash_bits
from tests.oracle import differences


@given(st.lists(st.integers(0, 20), max_size=60), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_window_minima(values, w):
    values = np.array(values, np.uint64)
    n = len(values)
    wanted = sorted({i for a in range(max(1, n - w + 1)) for i in range(a, min(n, a + w)) if values[i] == values[a : a + w].min()}) if n else []
    assert winnow.window_minima(values, w).tolist() == wanted


class Everything:
    def found(self, hashes):
        return np.ones(len(hashes), bool)


def joined(winnower, texts, items, seen):
    """The operator's join, with dictionaries."""
    theirs = winnower.of_items(items)
    at, found = {}, []
    for d, size, h, context in theirs:
        at.setdefault(h, []).append((d, size, context))
    count, mine = winnower.of_documents(texts, sorted({x[1] for x in theirs}), seen)
    for hits in mine:
        words, ids = set(), set()
        for (h, context), places in hits.items():
            for d, size, other in at.get(h, ()):
                if far := winnower.extended(context, other, size):
                    ids.add(d)
                    words.update(w for p in places for w in range(p - far[0], p + far[1]))
        found.append((words, ids))
    return count, found


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_hits_are_exact(texts, items):
    texts, items = [" ".join(t) for t in texts], [" ".join(t) for t in items]
    count, found = joined(winnow.Winnower(6, 3), [t.encode() for t in texts], [t.encode() for t in items], Everything())
    for text, n, (words, ids) in zip(texts, count, found, strict=True):
        assert n == len(text.split())
        assert words == winnow.hit_words(text, items, 6)
        assert ids == {i for i, t in enumerate(items) if winnow.hit_words(text, [t], 6)}


def test_bitmap_loses_no_hash(spark):
    hashes = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 3000)
    some = np.concatenate([hashes, [-1, 0, 1, -(1 << 63), (1 << 63) - 1]])
    bits = hash_bits(spark.createDataFrame([(int(h),) for h in some] + [(None,)], "h long"), "h", 20)
    assert bits.found(some.view(np.uint64)).all()
    others = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 3000)
    assert bits.found(others.view(np.uint64)).mean() < 0.02
    assert not hash_bits(spark.createDataFrame([], "h long"), "h", 20).found(some.view(np.uint64)).any()


def test_table_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, long.upper()), (3, long.upper()), (None, "w3, w4; w5!"), (5, "clean words only"), (6, "x " * 50000 + long)], "doc_id long, text string")
    items = spark.createDataFrame([(10, " ".join(f"w{i}" for i in range(5, 25))), (11, "W3 w4"), (11, "W3 w4"), (None, "w4 w5"), (12, None), (13, "..."), (14, "x " * 40000 + "y")], "item_id long, text string")
    found = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in winnow.contamination(docs, items).collect())
    assert found == [
        ("1", 0, 0, [], False), ("2", 0, 0, [], False), ("3", 30, 22, ["", "10", "11"], True), ("3", 30, 22, ["", "10", "11"], True), ("5", 3, 0, [], False),
        ("6", 50030, 50022, ["", "10", "11", "14"], True), ("None", 3, 3, ["", "11"], True),
    ]


def test_large_benchmark_and_hot_rows(spark):
    """Tens of thousands of items; one passage in a third of the items, in most documents, and in many copies of one of them."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    common = " ".join(rng.choice(vocabulary) for _ in range(15))
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 12, 14, 20)))) + (" " + common if i % 300 == 0 else "")) for i in range(30_000)]
    docs = []
    for i in range(1500):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        docs.append((i, " ".join(parts + [items[rng.randrange(30_000)][1]] * (i % 3 == 0) + [common] * (i % 2))))
    docs += [(2000 + i, "copy of " + common) for i in range(1200)]
    words = {i: t.split() for i, t in items}
    at = {}
    for i, w in words.items():
        n = min(13, len(w))
        for j in range(len(w) - n + 1):
            at.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    wanted = {}
    for d, t in docs:
        w, hit, ids = t.split(), set(), set()
        for n in (3, 12, 13):
            for j in range(len(w) - n + 1):
                if (own := at.get(tuple(w[j : j + n]))) is not None:
                    hit.update(range(j, j + n))
                    ids |= own
        wanted[d] = len(w), len(hit), sorted(ids)
    found = winnow.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(3)).collect()
    assert len(found) == len(docs)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found} == wanted


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "k", "m", 5, "n")], "doc_id long, text string, n_hit int, `x.y` string, __t string, __words int, __node string")
    none = spark.createDataFrame([], "item_id long, text string")
    for items in (none, spark.createDataFrame([(1, "b")], none.schema)):
        row = winnow.contamination(docs, items, keep=docs.columns).first()
        assert (row.doc_id, row.text, row["x.y"], row["__t"], row["__words"], row["__node"], row.n_words) == (1, "a b", "k", "m", 5, "n", 2)
        assert row.n_hit == items.count() and row.contaminated == bool(row.n_hit)
    assert winnow.contamination(docs.limit(0), none).count() == 0


def test_query(spark):
    assert differences(spark, "/root/testdata/sf0.001", op9_decontamination, OP9_SQL) == []
