"""Sequential byte machines, free of Spark: LZ77 and Huffman text records, the metadata walk, character sets.

They run once per book inside Arrow UDFs; every function takes and returns plain bytes, str and lists.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterable, Iterator

import numpy as np

#: Limits of the heuristics.
MOST_TABLE_SYMBOLS, MOST_SCANNED_SYMBOLS, MOST_ENTRIES, MOST_UNCOUNTED_ENTRIES, MOST_ENTRY_BYTES = 10_000, 5_000, 100_000, 50_000, 4096
PROBED_CHARS, PROBED_CJK_CHARS, FEW_REPLACEMENTS, LEAST_CJK = 10_000, 200, 5, 2


def u16(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 2], "big")


def u32(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "big")


def signed(x: int) -> int:
    """A 32-bit pattern as a signed number."""
    return x - (1 << 32) if x >= 1 << 31 else x


# ---- metadata ----


def exth_records(record0: bytes, at: int) -> list[tuple[int, int, bytes]]:
    """(tag, length, payload) of the EXTH block at ``at``; entries with bad lengths are stepped over by their length."""
    out: list[tuple[int, int, bytes]] = []
    if at == 0 or at + 12 > len(record0) or record0[at : at + 4] != b"EXTH":
        return out
    pos = at + 12
    for _ in range(u32(record0, at + 8)):
        if pos < 0 or pos + 8 > len(record0):
            break
        tag, length = struct.unpack_from(">II", record0, pos)
        payload = signed(length) - 8
        if 0 < payload <= len(record0) - pos - 8:
            out.append((tag, length, record0[pos + 8 : pos + 8 + payload]))
        elif length == 0:
            break  # such an entry would be read again for ever
        pos += signed(length)
    return out


def text_start(record0: bytes) -> int:
    """Where the first EXTH block found by its name ends: the text of record 0 begins there; its end without a block."""
    at = record0.find(b"EXTH")
    if at < 0 or at >= len(record0) - 12:
        return len(record0)
    pos = at + 12
    for _ in range(u32(record0, at + 8)):
        if pos < 0 or pos + 8 > len(record0):
            break
        step = signed(u32(record0, pos + 4))
        if step == 0:
            break
        pos += step
    return max(0, min(pos, len(record0)))


# ---- LZ77 ----


#: A blank and a letter in one code.
_SPACED = [bytes((0x20, code ^ 0x80)) for code in range(0xC0, 0x100)]


def lz77_into(data: bytes, out: bytearray) -> None:
    """Decode one record after what is already in ``out``; references reach back over records."""
    at, end = 0, len(data)
    while at < end:
        code = data[at]
        at += 1
        if 1 <= code <= 8:
            out += data[at : at + code]
            at += code
        elif code < 0x80:
            out.append(code)
        elif code >= 0xC0:
            out += _SPACED[code - 0xC0]
        else:
            if at >= end:
                return
            pair = code << 8 | data[at]
            at += 1
            back, size = pair >> 3 & 0x7FF, (pair & 7) + 3
            if back == 0:
                return
            start = len(out) - back
            if start < 0:
                out += b" " * size
            elif back >= size:
                out += out[start : start + size]
            else:  # the copy runs into itself
                out += (out[start:] * size)[:size]


def lz77(records: Iterable[bytes]) -> bytes:
    out = bytearray()
    for record in records:
        lz77_into(record, out)
    return bytes(out)


def lz77_single(data: bytes, size: int) -> bytes:
    """One record alone, cut off at ``size`` bytes."""
    return lz77([data])[:size]


def lz77_packed(data: bytes, record_bytes: int | None = None) -> list[bytes]:
    """An encoder for fixtures and for writing books: greedy matches of 3 to 10 bytes up to 2,047 back.

    The text of a record has about ``record_bytes`` bytes (default: all are one record); references reach back over records.
    """
    text = np.frombuffer(data, np.uint8).astype(np.int64)
    before = np.full(len(data), -1, np.int64)  # the last place before with the same three bytes
    if len(data) > 3:
        key = text[:-2] << 16 | text[1:-1] << 8 | text[2:]
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        before[order[same + 1]] = order[same]
    before[np.arange(len(data)) - before > 2047] = -1
    earlier = before.tolist()
    records, out, at, begun, end = [], bytearray(), 0, 0, len(data)
    while at < end:
        if record_bytes and at - begun >= record_bytes:
            records.append(bytes(out))
            out, begun = bytearray(), at
        if (place := earlier[at]) >= 0:
            size = 3
            while size < 10 and at + size < end and data[place + size] == data[at + size]:
                size += 1
            out += (0x8000 | at - place << 3 | size - 3).to_bytes(2, "big")
        elif data[at] == 0x20 and at + 1 < end and 0x40 <= data[at + 1] < 0x80:
            size = 2
            out.append(data[at + 1] ^ 0x80)
        else:
            size = 1
            if not (data[at] == 0 or 9 <= data[at] < 0x80):
                out.append(1)
            out.append(data[at])
        at += size
    return [*records, bytes(out)]


# ---- Huffman ----


def code_lengths(huff: bytes) -> dict[int, int] | None:
    """symbol -> code length from a HUFF record: sub-tables, else flat pairs, else the first table that a scan finds."""
    found: dict[int, int] = {}
    ok = _sub_tables(huff, found) or _flat_pairs(huff, found) or _scanned_table(huff, found)
    return found if ok and found else None


def _table(data: bytes, at: int, most: int, whole: bool, found: dict[int, int]) -> bool:
    """(count, lengths, symbols) at ``at``: whether any of its lengths is valid."""
    count = u16(data, at)
    if not 0 < count <= most:
        return False
    lengths = data[at + 2 : at + 2 + count]
    if whole and len(lengths) < count:
        return False
    lengths = lengths.ljust(count, b"\0")
    at, valid = min(at + 2 + count, len(data)), False
    for length in lengths:
        if at + 2 > len(data):
            break
        if 0 < length <= 32:
            found[u16(data, at)] = length
            valid = True
        at += 2
    return valid


def _sub_tables(data: bytes, found: dict[int, int]) -> bool:
    if len(data) < 40 or u32(data, 8) == 0 or u32(data, 12) == 0:
        return False
    places = [u32(data, 16 + 4 * i) for i in range(6)]
    return any([_table(data, p, MOST_TABLE_SYMBOLS, False, found) for p in places if 0 < p and p + 2 <= len(data)])


def _flat_pairs(data: bytes, found: dict[int, int]) -> bool:
    if len(data) < 12:
        return False
    for at in range(8, len(data) - 3, 4):
        symbol, length, rest = struct.unpack_from(">HBB", data, at)
        if not 0 < length <= 24 or rest and symbol >= 0x2000:
            break
        found[symbol] = length
    return bool(found)


def _scanned_table(data: bytes, found: dict[int, int]) -> bool:
    return len(data) >= 16 and any(_table(data, at, MOST_SCANNED_SYMBOLS, True, found) for at in range(8, len(data) - 10, 2))


def canonical_codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length): codes count up in order of length and symbol, in 32 bits."""
    out, code, size = {}, 0, 0
    for length, symbol in sorted((n, s) for s, n in lengths.items()):
        code = code << (length - size) & 0xFFFFFFFF
        size = length
        out[symbol] = code, length
        code = code + 1 & 0xFFFFFFFF
    return out


def reversed_codes(codes: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """The same with each code's bits in reverse order."""
    return {s: (int(format(code & (1 << n) - 1, f"0{n}b")[::-1], 2), n) for s, (code, n) in codes.items()}


def dictionary(cdic: bytes) -> dict[int, bytes]:
    """Entries of a CDIC record by number: four counted layouts are tried, then entries without a count."""
    for count_at, count_bytes, length_bytes, align in ((8, 2, 1, 1), (12, 4, 1, 1), (12, 2, 1, 1), (8, 2, 2, 2)):
        found = dict(_counted_entries(cdic, count_at, count_bytes, length_bytes, align))
        if found:
            return found
    return dict(_uncounted_entries(cdic))


def _ascii(data: bytes) -> bytes:
    return bytes(b if b < 0x80 else 0x3F for b in data)


def _counted_entries(data: bytes, count_at: int, count_bytes: int, length_bytes: int, align: int) -> Iterator[tuple[int, bytes]]:
    at = count_at + count_bytes
    count = signed(int.from_bytes(data[count_at:at], "big")) if len(data) >= at else 0
    if not 0 < count <= MOST_ENTRIES:
        return
    at += -at % align
    for i in range(count):
        size = int.from_bytes(data[at : at + length_bytes], "big")
        at += length_bytes
        if not 0 < size <= MOST_ENTRY_BYTES or at + size > len(data):
            return
        yield i, _ascii(data[at : at + size])
        at += size


def _uncounted_entries(data: bytes) -> Iterator[tuple[int, bytes]]:
    at, i = 12, 0
    while at < len(data) - 2 and i <= MOST_UNCOUNTED_ENTRIES:
        for width in (1, 2):
            size = int.from_bytes(data[at : at + width], "big")
            if 0 < size <= MOST_ENTRY_BYTES and at + width + size <= len(data):
                break
        else:
            return
        at += width
        yield i, _ascii(data[at : at + size])
        at, i = at + size, i + 1


def data_start(record: bytes) -> int:
    return 0 if len(record) < 4 else min(16, len(record) // 2)


def looks_like_image(record: bytes) -> bool:
    return len(record) >= 4 and record[:2] in (b"\xff\xd8", b"\x89\x50", b"\x47\x49")


def is_image(record: bytes) -> bool:
    return len(record) >= 4 and record.startswith((b"\xff\xd8", b"\x89PNG", b"GIF", b"BM"))


#: Codes up to this length are looked up in a table by the next bits; longer ones are followed bit by bit.
TABLE_BITS = 16


def huffman_decoded(records: Iterable[bytes], codes: dict[int, tuple[int, int]], entries: dict[int, bytes]) -> bytes:
    """Most significant bit first; each record starts anew and its padding bits are decoded as well.

    Bits that begin no code are given up as many at a time as the longest code has.
    """
    decode, out = _decoding(codes, entries), []
    for record in records:
        decode(record[data_start(record) :], out)
    return b"".join(out)


def _decoding(codes: dict[int, tuple[int, int]], entries: dict[int, bytes]):
    spelt = {key: bytes((s,)) if s < 256 else entries.get(s - 256, b"") for s, key in codes.items()}
    longest = max(n for _, n in codes.values())
    return _by_table(spelt, longest) if longest <= TABLE_BITS else lambda data, out: _by_bits(data, out, spelt, longest)


@functools.lru_cache(maxsize=8)
def _decoder(huff: bytes, cdic: bytes):
    """The decoder of a pair of records, kept for the books that share them; None if either does not read."""
    lengths, entries = code_lengths(huff), dictionary(cdic)
    return _decoding(canonical_codes(lengths), entries) if lengths and entries else None


def _by_bits(data: bytes, out: list[bytes], spelt: dict[tuple[int, int], bytes], longest: int) -> None:
    code = size = 0
    for byte in data:
        for shift in range(7, -1, -1):
            code, size = (code << 1 | byte >> shift & 1) & 0xFFFFFFFF, size + 1
            found = spelt.get((code, size))
            if found is not None:
                out.append(found)
            if found is not None or size >= longest:
                code = size = 0


def _by_table(spelt: dict[tuple[int, int], bytes], longest: int):
    """A decoder that looks up the next ``longest`` bits; of codes that fit, the shortest counts.

    What TABLE_BITS bits at once give is worked out when they are first met, and kept.
    """
    table: list[tuple[bytes, int] | None] = [None] * (1 << longest)
    for (code, size), found in sorted(spelt.items(), key=lambda item: item[0][1]):
        if code < 1 << size:
            free = longest - size
            for window in range(code << free, code + 1 << free):
                if table[window] is None:
                    table[window] = found, size
    met: dict[int, tuple[bytes, int]] = {}
    last = (1 << longest) - 1

    def several(bits: int) -> tuple[bytes, int]:
        parts, used = [], 0
        while used + longest <= TABLE_BITS:
            found = table[bits >> TABLE_BITS - longest - used & last]
            used += longest if found is None else found[1]
            parts.append(b"" if found is None else found[0])
        met[bits] = b"".join(parts), used
        return met[bits]

    def decode(data: bytes, out: list[bytes]) -> None:
        bits = held = 0
        for at in range(0, len(data), 6):
            part = data[at : at + 6]
            bits, held = bits << 8 * len(part) | int.from_bytes(part, "big"), held + 8 * len(part)
            while held >= TABLE_BITS:
                window = bits >> held - TABLE_BITS
                found, used = met.get(window) or several(window)
                out.append(found)
                held -= used
                bits &= (1 << held) - 1
        while held:
            found = table[(bits >> held - longest if held >= longest else bits << longest - held) & last]
            used = longest if found is None else found[1]
            if used > held:  # fewer bits are left than the code has
                return
            if found is not None:
                out.append(found[0])
            held -= used
            bits &= (1 << held) - 1

    return decode


def plausible(data: bytes) -> bool:
    """Whether the start reads like markup or like ASCII text."""
    if len(data) < 20:
        return False
    head = data[:200].decode("utf-8", "replace")
    return sum(c in "<>" for c in head) >= 2 or sum(" " <= c < "\x7f" for c in head) > 0.3 * len(head.encode("utf-16-le")) / 2


def huffman_text(records: list[bytes]) -> bytes | None:
    """The records decoded by the last HUFF and CDIC record among them; else their bytes as they are; None if neither reads."""
    huff = cdic = None
    for record in records:
        if record[:4] == b"HUFF":
            huff = record
        elif record[:4] == b"CDIC":
            cdic = record
    decode = _decoder(huff, cdic) if huff and cdic else None
    if decode is None:
        return None
    body = [r for r in records if len(r) >= 4 and r[:4] not in (b"HUFF", b"CDIC") and not looks_like_image(r)]
    out: list[bytes] = []
    for r in body:
        decode(r[data_start(r) :], out)
    decoded = b"".join(out)
    if plausible(decoded):
        return decoded
    plain = b"".join(r[data_start(r) :] for r in body)
    return plain if plausible(plain) else None


def content_start(record: bytes) -> int:
    """Where text seems to begin after the first bytes: a ``<`` or byte-order mark, else a letter; -1 without either."""
    first = min(16, len(record) // 2)
    end = min(first + 100, len(record))
    for i in range(first, end - 4):
        if record[i] == 0x3C:
            return i
        if i >= 2 and record[i - 2 : i + 1] == b"\xef\xbb\xbf":
            return i + 1
    for i in range(first, end - 2):
        if record[i] >= 0x80 or 65 <= record[i] <= 90 or 97 <= record[i] <= 122:
            return i
    return -1


def has_html_tag(record: bytes) -> bool:
    """A tag (or a byte-order mark) among bytes 16 to 500."""
    end = min(len(record), 500)
    for i in range(min(16, end), end - 4):
        following = record[i + 1]
        if record[i] == 0x3C and (65 <= following <= 90 or 97 <= following <= 122 or following in b"!?/"):
            return True
        if record[i - 2 : i + 1] == b"\xef\xbb\xbf":
            return i + 1 < end
    return False


def mixed_text(records: list[bytes]) -> tuple[bytes, str]:
    """Text of a Huffman book and how it was found: html records, huffman, direct html, or raw bytes of what is no image."""
    rest = [r for r in records if len(r) >= 4 and not is_image(r)]
    html = [r for r in rest if len(r) >= 10 and has_html_tag(r)]
    if html:
        return b"".join(html), "html"
    decoded, way = huffman_text(rest), "huffman"
    if decoded is None:
        starts = [(r, content_start(r)) for r in rest if len(r) >= 10 and not looks_like_image(r)]
        parts = [r[at:] for r, at in starts if at >= 0]
        decoded, way = b"".join(parts), "direct"
        if len(decoded) <= 100:
            decoded = b""
    return (decoded, way) if len(decoded) >= 100 else (b"".join(rest), "raw")


# ---- character sets ----


def decoded_text(data: bytes, encoding: int, repair: bool = True) -> tuple[str, str]:
    """The text and the character set: the header's, or GBK or GB18030 if that leaves replacement characters behind."""
    name = "cp1252" if encoding == 1252 else "utf-8"
    text = data.decode(name, "replace")
    if repair and text[:PROBED_CHARS].count("\ufffd") > FEW_REPLACEMENTS:
        for other in ("gbk", "gb18030"):
            tried = data.decode(other, "replace")
            if sum("\u4e00" <= c <= "\u9fff" for c in tried[:PROBED_CJK_CHARS]) >= LEAST_CJK:
                return tried, other
    return text, name


def cleaned(text: str) -> str:
    at = text.find("<")
    return (text[at:] if at > 0 else text).replace("\0", "").strip()
