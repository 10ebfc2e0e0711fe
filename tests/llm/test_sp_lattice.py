import collections

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import sp_lattice
from inkwell.llm.queries import op2_sentencepiece, table, tokenizer_path

PATH, SF = tokenizer_path("piece_bpe_32k.model"), "/root/testdata/sf0.001"
TEXTS = ["", "a", "the cats sat", "  two  blanks ", "Ж𐍈 漢\n\ttab", "x" * 300, "a▁b", "naïve café"]


@pytest.fixture(scope="module")
def pieces():
    with open(PATH, "rb") as f:
        return sp_lattice.Pieces(f.read())


def sampled(pieces, texts, k, keys=None):
    lattice = sp_lattice.Lattice(pieces)
    keys = np.arange(len(texts)) if keys is None else keys
    return sp_lattice.Samples([pieces.normalized(t) for t in texts], keys.astype(np.int64).view(np.uint64), lattice, k)


def test_without_replacement_probabilities(pieces):
    n, text = 8000, "the cat Ж"
    p = sp_lattice.segmentations(pieces.normalized(text), pieces)
    found = sampled(pieces, [text] * n, 3)
    assert all(len({tuple(x) for x in mine}) == len(mine) == 3 for mine in found.ids)
    first, two = collections.Counter(tuple(m[0]) for m in found.ids), collections.Counter(tuple(x) for m in found.ids for x in m[:2])
    for ids in sorted(p, key=p.get)[-5:]:
        assert abs(first[ids] / n - p[ids]) < 5 * (p[ids] * (1 - p[ids]) / n) ** 0.5 + 1e-3
        in_two = p[ids] + sum(q * p[ids] / (1 - q) for other, q in p.items() if other != ids)
        assert abs(two[ids] / n - in_two) < 5 * (in_two * (1 - in_two) / n) ** 0.5 + 2e-3
    for mine, scores in zip(found.ids[:200], found.log_prob, strict=False):
        assert all(abs(np.exp(s) - p[tuple(x)]) < 1e-9 for x, s in zip(mine, scores, strict=True))
    weight = [sum(np.exp(s) / q for s, q in zip(a, b, strict=True)) for a, b in zip(found.log_prob, found.inclusion, strict=True)]
    assert abs(np.mean(weight) - 1) < 0.02  # inclusion scores are inclusion probabilities


def test_all_segmentations_of_a_short_text(pieces):
    for text in ("a", "at", "𐍈"):
        p = sp_lattice.segmentations(pieces.normalized(text), pieces)
        found = sampled(pieces, [text] * 3, 50)
        for mine, scores, q in zip(found.ids, found.gumbel, found.inclusion, strict=True):
            assert {tuple(x) for x in mine} == set(p) and len(mine) == len(p)
            assert scores == sorted(scores, reverse=True) and set(q) == {1.0}


def test_odd_texts_round_trip(pieces):
    decoder = sp_lattice.Decoder(open(PATH, "rb").read())
    found = sampled(pieces, TEXTS * 2, 3)
    for text, mine in zip(TEXTS * 2, found.ids, strict=True):
        for ids in mine:
            assert decoder.text(ids) == text.replace("▁", " ")
            assert text.count("▁") or decoder.text(ids) == pieces.processor.decode(ids.tolist())
    assert [len(m) for m in found.ids][0] == 1 and len(found.ids[0][0]) == 0


def test_words_kept_or_not_make_no_difference(pieces, monkeypatch):
    texts = [f"some words {i} and others{i % 3}" for i in range(50)]
    wanted = [[x.tolist() for x in m] for m in sampled(pieces, texts, 2).ids]
    monkeypatch.setattr(sp_lattice.Lattice, "MOST_NODES", 20)
    monkeypatch.setattr(sp_lattice.Lattice, "BUILT_CHARS", 7)
    lattice = sp_lattice.Lattice(pieces)
    for i, t in enumerate(texts):
        found = sp_lattice.Samples([pieces.normalized(t)], np.array([i]).view(np.uint64), lattice, 2)
        assert [x.tolist() for x in found.ids[0]] == wanted[i]


def test_words_share_the_nodes_of_their_endings(pieces):
    texts = ["walking talking king", "a talking é🙂king", "", "king"]
    lattice, normal = sp_lattice.Lattice(pieces), [pieces.normalized(t) for t in texts]
    for _ in range(2):
        node, first = lattice.words(sp_lattice.cut_words(normal))
        words = ["▁" + w for t in texts for w in t.split()]
        assert len(lattice.first) == 1 + len({w[i:] for w in words for i in range(len(w))})
        assert len(set(node.tolist())) == len(set(words)) and first.tolist() == [0, 3, 6, 6, 7]


def test_decoded_texts_are_told_from_others(pieces):
    decoder = sp_lattice.Decoder(pieces.processor)
    ids = [pieces.processor.encode(t) for t in ("one two", "one two", "", "three")]
    flat, cuts = pa.array([i for x in ids for i in x], pa.int32()), np.cumsum([0, *map(len, ids)])
    same = lambda texts: decoder.same(flat, cuts, [pieces.normalized(t).encode() for t in texts], [2, 1, 1])
    assert same(["one two", "", "three"]) == [True] * 4
    assert same(["one twO", "", "three"]) == [False, False, True, True]
    assert same(["one two", "x", "thre"]) == [True, True, False, False]
    assert decoder.same(flat[:0], np.zeros(2, np.int64), [b""], [1]) == [True]


def test_few_words_at_once_make_no_difference(pieces, monkeypatch):
    texts = ["some words", "x" * 400 + "yz" * 100, "é🙂" * 80, "a", "internationalization"]
    wanted = sampled(pieces, texts, 3)
    for few in (0, 10**6):
        monkeypatch.setattr(sp_lattice.Lattice, "FEW", few)
        found = sampled(pieces, texts, 3)
        assert [[x.tolist() for x in m] for m in found.ids] == [[x.tolist() for x in m] for m in wanted.ids]
        assert found.gumbel == wanted.gumbel


def test_tables(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*TEXTS, None])] + [(2, TEXTS[2], 0), (None, "no id", 0)], "doc_id long, text string, sample int")
    rows = sp_lattice.sample(docs, PATH, k=2, keep=["doc_id", "text"]).collect()
    assert all(r.round_trip for r in rows)
    counts = collections.Counter(r.doc_id for r in rows)
    assert counts[0] == counts[8] == 1 and counts[2] == 4 and counts[None] == 2
    assert len({tuple(r.ids) for r in rows if r.doc_id == 2}) == 2  # equal rows, equal samples
    again = sp_lattice.sample(docs.repartition(3), PATH, k=2, keep=["doc_id", "text"]).collect()
    assert sorted((str(r.doc_id), r.sample, r.ids, r.gumbel) for r in rows) == sorted((str(r.doc_id), r.sample, r.ids, r.gumbel) for r in again)
    encoded = sp_lattice.encode(docs, PATH, keep=["doc_id", "text"])
    decoded = sp_lattice.decode(encoded, PATH, keep=["text"])
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in decoded.collect())
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 264])], "doc_id long, ids array<int>")
    assert [r.decoded for r in sp_lattice.decode(odd, PATH, keep=["doc_id"]).orderBy("doc_id").collect()] == [None, "", "a"]
    assert sp_lattice.sample(docs.limit(0), PATH).count() == 0


@given(st.lists(st.text(alphabet="aBthe \n▁,.é漢🙂\x00", max_size=25), max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoding_is_the_librarys(texts):
    texts = [t.replace("▁", "") for t in texts] + texts
    for most in (3, 1_000_000):
        encoder.MOST_WORDS = most
        ids, size = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == encoder.processor.encode(texts) if texts else not len(ids)


encoder = sp_lattice.Encoder(open(PATH, "rb").read())


def test_words_go_to_the_library_together(monkeypatch):
    texts = [f"one{i} twö{i * 7} 漢{i}  {i}🙂 " for i in range(2000)] + [" ", "  ", "x" * 5000, ""]
    wanted, given = encoder.processor.encode(texts), []
    for joined, told in ((sp_lattice.Encoder.JOINED_BYTES, True), (1, True), (1 << 30, True), (1 << 10, False)):
        mine = sp_lattice.Encoder(open(PATH, "rb").read())
        mine.JOINED_BYTES = joined
        if not told:
            mine.bytes[:] = -1
        monkeypatch.setattr(mine, "_encoded", lambda words, f=mine._encoded: (given.append(len(words)), f(words))[1])
        ids, size = mine.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == wanted
    assert sum(given[:2]) < 100 < 8000 < sum(given[-2:])


def test_a_worker_has_one_processor_and_small_tables(pieces):
    assert sp_lattice.Encoder(pieces.processor).processor is pieces.processor
    assert sum(held.nbytes + name.nbytes for _, held, name in pieces.tables) < 10e6
    assert sp_lattice.Decoder(pieces.processor).text(np.array(pieces.processor.encode("a ▁b"))) == "a  b"


def test_query(spark):
    """The library's own ids by a processor of its own, and the samples decoded by it."""
    rows = op2_sentencepiece(spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    counts = collections.Counter((r.doc_id, r.sample) for r in rows)
    assert set(counts.values()) == {1} and {i for i, _ in counts} == set(docs) and all(r.round_trip for r in rows)
    for r in rows:
        if r.sample == 0:
            assert r.n_tokens == len(encoder.processor.encode(docs[r.doc_id])) and r.log_prob is None
    samples = sp_lattice.sample(table(spark, SF, "documents"), PATH, k=2, own=True).collect()
    for r in samples:
        assert encoder.processor.decode(r.ids) == docs[r.doc_id]
        assert r.sample or r.ids == encoder.processor.encode(docs[r.doc_id])
    for i, text in docs.items():
        mine = [tuple(r.ids) for r in samples if r.doc_id == i and r.sample]
        assert len(set(mine)) == len(mine) == (2 if text else 1)
