import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwell.llm import repair_store, token_counts
from inkwell.llm.bpe import ByteBpe
from inkwell.llm.queries import op3_token_counts, op8_token_ids, table, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
SAMPLES = ["", "a", " a  b\n\nc \t", "l'été n'est pas don't I'll", "漢字 🙂 ×2", "x" * 3000, "\x00\x1c", "<|endoftext|>", "tab\tend\r\n", " é1.5--"]


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, encoding="utf-8") as f:
        return ByteBpe(f.read())


FRESH = {False: Tokenizer.from_file(PATH), True: Tokenizer.from_file(PATH)}
FRESH[True].encode_special_tokens = True


def wanted(bpe, texts, special_as_text=False):
    """By a tokenizer of its own, straight from the file."""
    return [e.ids for e in FRESH[special_as_text].encode_batch(texts, add_special_tokens=False)]


def test_special_tokens():
    text = "hello <|endoftext|> world"
    for as_text, ids in ((False, [31373, 220, 50256, 995]), (True, [31373, 1279, 91, 437, 1659, 5239, 91, 29, 995])):
        with open(PATH, encoding="utf-8") as f:
            bpe = ByteBpe(f.read(), as_text)
        texts = [text, "hello world", "<|endoftext|>" * 3, "a<|endoftext|>b <|endoftext|", ""]
        found, counts = bpe.encode([t.encode() for t in texts])
        assert found[: counts[0]].tolist() == ids
        assert found.tolist() == [i for x in wanted(bpe, texts, as_text) for i in x]
        assert bpe.lengths[found].sum() == sum(map(len, texts))


@given(st.lists(st.text(alphabet="aB \n\t.,'stl1é×Ω漢\x00", max_size=15) | st.sampled_from(["<|endoftext|>", "a <|endoftext|> b"]), max_size=8))
@settings(max_examples=200, deadline=None)
def test_ids_are_the_librarys(bpe, texts):
    ids, counts = bpe.encode([t.encode() for t in texts])
    cut = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == wanted(bpe, texts)


@given(st.lists(st.lists(st.integers(0, 6), max_size=80), max_size=8))
@settings(max_examples=150, deadline=None)
def test_blocks_round_trip(documents):
    ids = np.array([i for x in documents for i in x], np.int32)
    ends = np.cumsum([len(x) for x in documents]).astype(np.int64)
    block = repair_store.Block(repair_store.packed(ids, ends, 7))
    back, before = block.all()
    assert back.tolist() == ids.tolist()
    assert np.diff(before).tolist() == [len(x) for x in documents]
    for i, x in enumerate(documents):
        assert block.document(i).tolist() == x
    for a in range(0, len(ids), 7):
        assert block.run(a, min(len(ids), a + 5)).tolist() == ids[a : a + 5].tolist()


def test_grammar_shrinks_repeats_and_wide_vocabularies():
    ids = np.tile(np.arange(50, dtype=np.int32), 200)
    for terminals in (50, 70_000):
        blob = repair_store.packed(ids, np.array([len(ids)]), terminals)
        assert len(blob) < len(ids) * 2
        assert repair_store.Block(blob).all()[0].tolist() == ids.tolist()
    with pytest.raises(ValueError):
        repair_store.Block(b"nothing at all")


def test_copies_of_a_long_text_shrink_to_rules():
    text = np.random.default_rng(8).integers(0, 1000, 1000).astype(np.int32)
    ids, ends = np.tile(text, 400), np.arange(1, 401) * 1000
    blob = repair_store.packed(ids, ends, 1000)
    block = repair_store.Block(blob)
    assert len(block.symbols) <= 3 * 400 and block.grammar.length.max() >= 300
    assert block.all()[0].tolist() == ids.tolist() and block.document(399).tolist() == text.tolist()
    one = repair_store.Block(repair_store.packed(np.zeros(1 << 16, np.int32), np.array([1 << 16]), 1000))
    assert len(one.symbols) <= 16 and one.run(5, 900).tolist() == [0] * 895


def test_store(spark, bpe):
    rows = [(i * 3 % 41, t) for i, t in enumerate(SAMPLES * 4)] + [(None, "null id"), (50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = repair_store.store_path(spark)
    repair_store.write(docs, path, PATH, block_ids=64)
    found = sorted(map(tuple, repair_store.read(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    start = 0
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t)
    for doc_id, at, n, crc in found:
        options = {zlib.crc32(np.array([*wanted(bpe, [t or ""])[0], 0], "<u4").tobytes()) for t in by_id[doc_id]}
        assert at == start and crc in options
        start += n
    none = repair_store.store_path(spark)
    repair_store.write(docs.limit(0), none, PATH)
    assert repair_store.read(spark, none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 30])
def test_shard_numbers(spark, n):
    bounds = [3 * i for i in range(n)]
    rows = spark.range(-1, 95).select("id", repair_store._number_below(F.col("id"), bounds).alias("s")).collect()
    assert [r.s for r in rows] == [sum(b < r.id for b in bounds) for r in rows]


def test_op8_on_whole_table(spark, bpe):
    docs = table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").collect()
    found = {r.doc_id: r for r in op8_token_ids(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for d in docs:
        ids = np.array([*wanted(bpe, [d.text])[0], 0], "<u4")
        assert tuple(found[d.doc_id]) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def by_hand(bpe, text, bounds, rule):
    """Tokens of the sections [bounds[i], bounds[i + 1]) in bytes, token by token."""
    at, out = 0, [0.0] * (len(bounds) - 1)
    for i in wanted(bpe, [text])[0]:
        end = at + int(bpe.lengths[i])
        over = [max(0, min(end, b) - max(at, a)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        hit = [k for k, n in enumerate(over) if n]
        if rule == "split":
            for k in hit:
                out[k] += over[k] / (end - at)
        else:
            out[{"first": hit[0], "last": hit[-1], "most": over.index(max(over))}[rule]] += 1
        at = end
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution(bpe, rule):
    text = "one two\n\n\nthree  fourfour 漢字\n"
    size = len(text.encode())
    for bounds in ([0, size], [0, 2, 3, 5, size], [0, 0, 8, 9, 10, 10, size], [0, 9, 26, 27, 28, size]):
        ids, _ = bpe.encode([text.encode()])
        got, _ = token_counts.attributed(np.cumsum(bpe.lengths[ids]), np.array(bounds), rule)
        assert got.tolist() == pytest.approx(by_hand(bpe, text, bounds, rule))


def test_token_counts_table(spark, bpe):
    rows = [(1, None, "x"), (2, "a\nb\n", None), (2, "a\nb\n", None), (3, "é\n漢字", "zz\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, section string")
    found = token_counts.token_counts(docs, PATH, fields=("text", "section"))
    got = sorted((r.doc_id, r.section, r.char_start, r.char_end, r.field, r.n_tokens) for r in found.where("doc_id = 3").collect())
    assert [g[4:5] + g[2:4] for g in sorted(got, key=lambda g: g[2])] == [("text", 0, 2), ("text", 2, 5), ("section", 5, 8), ("section", 8, 9)]
    totals = {r[0]: r[1] for r in found.groupBy("doc_id").sum("n_tokens").collect()}
    joined = {1: ["\nx"], 2: ["a\nb\n\n"] * 2, 3: ["é\n漢字\nzz\ny"]}
    assert totals == {i: sum(map(len, wanted(bpe, t))) for i, t in joined.items()}
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0
    clash = spark.createDataFrame([(1, "a b", "j", "r", 7, "f")], "doc_id long, text string, __joined string, __rows string, __sizes int, field string")
    row = token_counts.token_counts(clash, PATH, keep=clash.columns).first()
    assert (row["__joined"], row["__rows"], row["__sizes"], row.field, row.text, row.n_tokens) == ("j", "r", 7, "text", "a b", 2)
    assert token_counts.token_counts(docs, PATH, sections=False).where("doc_id = 1").first().n_tokens == 0


def test_op3_adds_up(spark, bpe):
    totals = {r[0]: r[1] for r in op3_token_counts(spark, "/root/testdata/sf0.001").groupBy("doc_id").sum("n_tokens").collect()}
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    assert totals == {d.doc_id: len(wanted(bpe, [d.text])[0]) for d in docs}
