import collections
import functools
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import near_dup
from inkwell.llm.queries import op4_near_duplicates, table
from inkwell.llm.text import dealt_join


def shingle_set(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def components_of(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def brute_classes(spark, docs, least=0.8):
    """Components of all pairs by weighted Jaccard similarity, from plain sets and the documents' shingle weights."""
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    weights = near_dup.shingle_weights(frame)
    of = {}
    for i, t in docs.items():
        _, gram, uses = near_dup.shingles([(t or "").encode()])
        of[i] = dict(zip(gram.tolist(), (uses * weights.of(gram)).tolist(), strict=True))
        assert len(of[i]) == len(shingle_set(t))
    pairs = []
    for a, b in itertools.combinations(docs, 2):
        same = of[a].keys() & of[b].keys()
        both = sum(min(of[a][g], of[b][g]) for g in same)
        if (docs[a] or "") == (docs[b] or "") or same and both >= (least - 1e-9) * (sum(of[a].values()) + sum(of[b].values()) - both):
            pairs.append((a, b))
    return components_of(docs, pairs)


def words(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def changed(rng, text, n):
    text = list(text)
    for _ in range(n):
        text[rng.randrange(len(text))] = f"x{rng.randint(0, 10**6)}"
    return text


def found_classes(spark, docs):
    rows = near_dup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(docs)
    return {r.doc_id: r.class_id for r in rows}


def test_icws_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    gram = np.sort(rng.choice(1 << 48, 3000, replace=False).astype(np.uint64))
    weight_a, weight_b = rng.uniform(1, 3, 3000), rng.uniform(1, 3, 3000)
    weight_b[:600], weight_a[600:900] = 0, 0
    wanted = np.minimum(weight_a, weight_b).sum() / np.maximum(weight_a, weight_b).sum()
    samples = [near_dup.icws(np.zeros((w > 0).sum(), np.int64), gram[w > 0], w[w > 0], 1)[0][0] for w in (weight_a, weight_b)]
    assert abs((samples[0] == samples[1]).mean() - wanted) < 0.15
    same, any_word = near_dup.icws(np.array([0, 0, 2]), gram[[0, 1, 0]], np.ones(3), 3)
    assert any_word.tolist() == [True, False, True] and (same[0] != 0).all()


def test_planted_copies(spark):
    rng = random.Random(4)
    docs, texts = {}, []
    for _ in range(40):
        base = words(rng, rng.randint(60, 300))
        texts += [base] + [changed(rng, base, max(1, len(base) // 200)) for _ in range(rng.randint(0, 3))]
    centre = words(rng, 250)  # a group whose members are alike only through its centre
    texts += [centre] + [changed(rng, centre, 3) for _ in range(60)]
    texts = [" ".join(t) for t in texts] + ["", None, "one two", "One, two!", "...", "same text here"] * 2
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    found = found_classes(spark, docs)
    assert found == brute_classes(spark, docs)
    group = [i for i, t in docs.items() if t and len(set(t.split()) & set(centre)) > 200]
    assert len(group) == 61 and len({found[i] for i in group}) == 1


def test_large_buckets_by_leaders_and_blocks(spark, monkeypatch):
    rng = random.Random(9)
    centre = words(rng, 200)
    texts = [" ".join(changed(rng, centre, rng.randint(1, 4))) for _ in range(70)] + [" ".join(centre[:150] + words(rng, 50)) for _ in range(40)]
    docs = dict(enumerate(texts))
    wanted = brute_classes(spark, docs)
    monkeypatch.setattr(near_dup, "BLOCK_OUTSIDE", 4)
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", 8)
    for small, few in ((2, 0), (2, 10**9), (10_000, 0)):  # leaders and blocks, blocks alone, or every pair of a bucket
        monkeypatch.setattr(near_dup, "SMALL", small)
        monkeypatch.setattr(near_dup, "FEW_COMPARISONS", few)
        assert found_classes(spark, docs) == wanted


def test_leaders_in_blocks_and_hot_keys(spark, monkeypatch):
    """A leader's members in many blocks, and joins whose keys are dealt out although the table is small."""
    rng = random.Random(12)
    centre = words(rng, 200)
    texts = [" ".join(changed(rng, centre, rng.randint(1, 4))) for _ in range(60)] * 2 + [" ".join(words(rng, 100)) for _ in range(20)]
    docs = dict(enumerate(texts))
    wanted = brute_classes(spark, docs)
    monkeypatch.setattr(near_dup, "HUB_MEMBERS", 7)
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "dealt_join", functools.partial(dealt_join, least=3))
    monkeypatch.setattr(near_dup, "BLOCKS_AT_ONCE", 1)
    assert found_classes(spark, docs) == wanted
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id for r in near_dup.deduplicated(frame).collect()} == set(wanted.values())


def test_filter_of_nodes(spark):
    rows = spark.range(4000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("node"), "id")
    some = rows.where("id % 4 = 0")
    inside, outside = ({r.id for r in near_dup._among(rows, some, there).collect()} for there in (True, False))
    assert inside | outside == set(range(4000)) and not inside & outside
    assert set(range(0, 4000, 4)) <= inside and len(inside) < 1010
    assert near_dup._among(rows, some.limit(0)).count() == 0


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, class_id int")
    assert near_dup.near_duplicates(empty).count() == 0
    assert near_dup.deduplicated(empty).columns == ["doc_id", "text", "class_id"]
    rows = [(1, "a b c d e f g", 5), (1, "a b c d e f g", 5), (None, "A b c d e f g", 6), (None, None, 7), (4, "z", 8)]
    docs = spark.createDataFrame(rows, empty.schema)
    found = sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in near_dup.near_duplicates(docs).collect())
    assert found == [("1", "1", 3), ("1", "1", 3), ("4", "4", 1), ("None", "1", 3), ("None", "None", 1)]
    kept = sorted((str(r.doc_id), str(r.text), r.class_id) for r in near_dup.deduplicated(docs).collect())
    assert kept == [("1", "a b c d e f g", 5), ("4", "z", 8), ("None", "None", 7)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 120 + i) for i in range(30)] + [(200, 201)]
    table = spark.createDataFrame([(bytes([0, a]), bytes([0, b])) for a, b in edges], "a binary, b binary")
    found = {r["node"][1]: r.label[1] for r in near_dup.components(table).collect()}
    assert found == {**{i: 0 for i in range(21)}, 100: 100, **{120 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert near_dup.components(table.limit(0)).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert {r.doc_id: r.class_id for r in op4_near_duplicates(spark, "/root/testdata/sf0.001").collect()} == brute_classes(spark, docs)


def test_recall_by_shingles_of_words(spark):
    """Whole table, with shingles as tuples of words, counted and weighted apart from the operator."""
    docs = {r.doc_id: r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    uses = {}
    for i, t in docs.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
        grams = [tuple(words[j : j + 5]) for j in range(len(words) - 4)] or ([tuple(words)] if words else [])
        uses[i] = collections.Counter(grams)
    df, n = collections.Counter(g for x in uses.values() for g in x), len(docs)
    weight = {g: 1 + np.log((n + 1) / (c + 1)) / np.log(n + 1) for g, c in df.items()}
    total = {i: sum(k * weight[g] for g, k in x.items()) for i, x in uses.items()}
    where = collections.defaultdict(list)
    for i, x in uses.items():
        for g, k in x.items():
            where[g].append((i, k))
    both = collections.Counter()
    for g, rows in where.items():
        for (a, x), (b, y) in itertools.combinations(rows, 2):
            both[a, b] += min(x, y) * weight[g]
    alike = {pair: s / (total[pair[0]] + total[pair[1]] - s) for pair, s in both.items()}
    found = {r.doc_id: r.class_id for r in op4_near_duplicates(spark, "/root/testdata/sf0.01").collect()}
    sure = [p for p, s in alike.items() if s >= 0.8]
    assert len(sure) > 100
    missed = [p for p in sure if found[p[0]] != found[p[1]]]
    assert len(missed) <= 0.005 * len(sure)
    # no two texts are in one class but for a chain of similar ones
    widest = components_of(docs, [p for p, s in alike.items() if s >= 0.79] + [(a, b) for a, b in itertools.combinations(docs, 2) if docs[a] == docs[b]])
    assert all(widest[i] == widest[c] for i, c in found.items())


def keys_of(gram, uses):
    """Band keys of texts with rows of shingles of the same weight a use."""
    doc = np.repeat(np.arange(len(gram)), gram.shape[1])
    order = np.lexsort((gram.ravel(), doc))
    keys, count = near_dup.text_bands(doc, gram.ravel()[order], np.tile(uses, len(gram))[order], np.full(len(doc), 1.9), len(gram), 0.8)
    return [set(k.tolist()) for k in np.split(keys, np.cumsum(count)[:-1])]


def test_similar_texts_become_candidates_at_every_length():
    rng = np.random.default_rng(3)
    # shared shingles and those of one text alone; similarity 0.8 to 0.84.  At 95 and 118 the texts have unlike kinds of samples
    for both, left, right in ((4, 1, 0), (8, 1, 1), (16, 2, 2), (20, 2, 2), (40, 5, 5), (95, 0, 20), (118, 0, 25), (200, 25, 25)):
        gram = rng.integers(0, 1 << 48, (500, both + left + right), dtype=np.uint64)
        a = keys_of(gram[:, : both + left], np.ones(both + left, np.int64))
        b = keys_of(np.concatenate([gram[:, :both], gram[:, both + left :]], axis=1), np.ones(both + right, np.int64))
        assert sum(x.isdisjoint(y) for x, y in zip(a, b, strict=True)) <= 2, (both, left, right)
    # a line many times over, with and without a header of more shingles than the line has
    gram = rng.integers(0, 1 << 48, (300, 30), dtype=np.uint64)
    a, b = keys_of(gram, np.repeat([60, 1], [6, 24])), keys_of(gram[:, :6], np.full(6, 60))
    assert not any(x.isdisjoint(y) for x, y in zip(a, b, strict=True))


def test_planted_short_copies(spark):
    rng = random.Random(21)
    texts = []
    for n in range(8, 31):
        for _ in range(12):
            base = words(rng, n)
            texts += [base, [*base, f"y{rng.randint(0, 10**6)}"]]
            if n >= 20:
                texts.append([f"z{rng.randint(0, 10**6)}", *base])
    docs = dict(enumerate(" ".join(t) for t in texts))
    assert found_classes(spark, docs) == brute_classes(spark, docs)
