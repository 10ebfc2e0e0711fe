import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.functions import codecs


def be16(x):
    return x.to_bytes(2, "big")


def be32(x):
    return x.to_bytes(4, "big")


@pytest.mark.parametrize(
    ("packed", "plain"),
    [
        (b"", b""),
        (b"abc", b"abc"),
        (b"\x00a", b"\x00a"),
        (b"\x03\xff\xfe\xfdx", b"\xff\xfe\xfdx"),
        (b"\x08ab", b"ab"),  # a literal run that the record cuts short
        (b"\xe1", b" a"),
        (b"ab" + bytes((0x80, 2 << 3 | 1)), b"ab" + b"abab"),  # overlapping copy
        (b"a" + bytes((0x80, 9 << 3 | 0)), b"a" + b"   "),  # before the start: blanks
        (b"a\x80\x00b", b"a"),  # distance 0 ends the record
        (b"a\x80", b"a"),  # half a reference ends it
    ],
)
def test_lz77(packed, plain):
    assert codecs.lz77([packed]) == plain


def test_lz77_reaches_back_over_records():
    assert codecs.lz77([b"abc", bytes((0x80, 3 << 3))]) == b"abcabc"


@given(st.binary(max_size=400))
@settings(max_examples=150, deadline=None)
def test_lz77_round_trip(data):
    assert codecs.lz77(codecs.lz77_packed(data)) == codecs.lz77(codecs.lz77_packed(data, 5)) == data == codecs.lz77_single(codecs.lz77_packed(data)[0], len(data))
    repeated = data * 3
    assert codecs.lz77(codecs.lz77_packed(repeated)) == repeated


def exth(entries, count=None):
    body = b"".join(struct.pack(">II", tag, len(p) + 8 if n is None else n) + p for tag, p, n in entries)
    return b"EXTH" + be32(len(body) + 12) + be32(len(entries) if count is None else count) + body


def test_exth_records():
    block = exth([(503, b"title", None), (1, b"", None), (100, b"name", None)])
    assert codecs.exth_records(b"x" * 20 + block, 20) == [(503, 13, b"title"), (100, 12, b"name")]
    assert codecs.exth_records(block, 0) == []
    assert codecs.exth_records(b"x" * 20 + b"NOPE" + block, 20) == []
    assert codecs.exth_records(b"x" * 20 + exth([(503, b"title", 0)], count=2**32 - 1), 20) == []  # length 0 does not go on for ever


def test_text_start():
    block = exth([(503, b"title", None)])
    assert codecs.text_start(b"..." + block + b"text") == 3 + len(block)
    assert codecs.text_start(b"no block at all") == 15


def test_canonical_codes():
    codes = codecs.canonical_codes({7: 2, 1: 1, 3: 3, 2: 3})
    assert codes == {1: (0, 1), 7: (2, 2), 2: (6, 3), 3: (7, 3)}
    assert codecs.reversed_codes(codes) == {1: (0, 1), 7: (1, 2), 2: (3, 3), 3: (7, 3)}


def huff_flat(lengths):
    return b"HUFF" + bytes(4) + b"".join(be16(s) + bytes((n, 0)) for s, n in lengths.items())


def test_code_length_formats():
    wanted = {65: 1, 66: 2, 300: 2}
    assert codecs.code_lengths(huff_flat(wanted)) == wanted
    table = be16(3) + bytes((1, 2, 2)) + b"".join(map(be16, wanted))
    sub = b"HUFF" + bytes(4) + be32(1) + be32(1) + be32(40) + bytes(20) + table
    assert codecs.code_lengths(sub) == wanted
    scanned = b"HUFF" + bytes(4) + b"\x00\x00\xff\xff" + table + bytes(12)
    assert codecs.code_lengths(scanned) == wanted
    assert codecs.code_lengths(b"HUFF") is None


def test_dictionary_formats():
    entries = b"\x02ab\x01\xe9"
    wanted = {0: b"ab", 1: b"?"}
    assert codecs.dictionary(b"CDIC" + bytes(4) + be16(2) + entries) == wanted
    assert codecs.dictionary(b"CDIC" + bytes(4) + be16(0) + bytes(2) + be32(2) + entries) == wanted


def test_huffman_text():
    bits = {"<": "0", "a": "10", 256: "11"}
    lengths = {ord("<"): 1, ord("a"): 2, 256: 2}
    codes = codecs.canonical_codes(lengths)
    assert {chr(s) if s < 256 else s: format(c, f"0{n}b") for s, (c, n) in codes.items()} == bits
    stream = "0" * 8 + "1011" * 30
    body = bytes(16) + int(stream.ljust(-(-len(stream) // 8) * 8, "0"), 2).to_bytes(-(-len(stream) // 8), "big")
    cdic = b"CDIC" + bytes(4) + be16(1) + b"\x03xyz"
    text = codecs.huffman_text([huff_flat(lengths), cdic, body])
    assert text.startswith(b"<" * 8 + b"axyzaxyz")
    assert codecs.huffman_text([cdic, body]) is None


@given(st.dictionaries(st.integers(0, 270), st.integers(1, 9), min_size=1, max_size=12), st.lists(st.binary(max_size=30), max_size=3))
@settings(max_examples=300, deadline=None)
def test_decoding_by_table_is_decoding_by_bits(lengths, records):
    codes, entries = codecs.canonical_codes(lengths), {i: b"<%d>" % i for i in range(10)}
    spelt = {key: bytes((s,)) if s < 256 else entries.get(s - 256, b"") for s, key in codes.items()}
    wanted: list[bytes] = []
    for record in records:
        codecs._by_bits(record[codecs.data_start(record) :], wanted, spelt, max(lengths.values()))
    assert codecs.huffman_decoded(records, codes, entries) == b"".join(wanted)


def test_mixed_text():
    html = bytes(16) + b"<html><body>" + b"x" * 30
    image = b"\x89PNG" + bytes(30)
    assert codecs.mixed_text([html, image, b"unknown but long enough"]) == (html, "html")
    readable = bytes(16) + b"words and more words " * 10
    assert codecs.mixed_text([image, readable]) == (readable[16:], "direct")
    assert codecs.mixed_text([bytes(50)]) == (bytes(50), "raw")
    assert codecs.mixed_text([]) == (b"", "raw")


def test_html_tag_places():
    assert not codecs.has_html_tag(b"<html>" + b"." * 30)  # the first 16 bytes do not count
    assert codecs.has_html_tag(b"." * 16 + b"<p>....")
    assert not codecs.has_html_tag(b"." * 16 + b"< p>...")
    assert codecs.has_html_tag(b"." * 16 + b"\xef\xbb\xbf......")


def test_charsets():
    assert codecs.decoded_text("é".encode("cp1252"), 1252) == ("é", "cp1252")
    chinese = "中文书籍内容测试"
    assert codecs.decoded_text(chinese.encode("gb18030"), 65001) == (chinese, "gbk")
    assert codecs.decoded_text(chinese.encode("gb18030"), 65001, repair=False)[1] == "utf-8"
    assert codecs.decoded_text(b"\xff\xff ok", 65001) == ("�� ok", "utf-8")
    assert codecs.cleaned("junk\0<p>\0x</p> 　") == "<p>x</p>"
