"""Byte-level BPE by the tokenizers library, with a cache of words.

The library's byte-level pre-tokenizer cuts a text into words that are encoded each by itself, so the ids of a text are
the ids of its words in turn.  Texts of plain characters (printable ASCII, tab, line feed, carriage return and the letters
of Latin-1; no apostrophe that may begin a contraction) are cut here, all at once in numpy, and each distinct word goes to
the library once; any other text, any text with an added token of the vocabulary, and any vocabulary with another
pre-tokenizer, goes to the library whole.  Words are told apart by a 64-bit hash.

A special token's name in a text is that token, as the library has it; ``special_as_text`` makes it ordinary text.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

from inkwell.llm.text import span_hashes

#: Words kept; the cache starts anew beyond that, which bounds its memory.
CACHE_WORDS = 1_500_000

_END, _LETTER, _DIGIT, _MARK, _BLANK, _SPACE, _OTHER = range(7)


def _kind(b: int) -> int:
    if b == 0:
        return _END
    if chr(b).isalpha() and b < 128 or b == 0xC3 or 0x80 <= b < 0xC0:
        return _LETTER
    if 48 <= b < 58:
        return _DIGIT
    return _BLANK if b == 32 else _SPACE if b in b"\t\n\r" else _MARK if 32 < b < 127 else _OTHER


_KIND = np.array([_kind(b) for b in range(256)], np.uint8)
_AFTER_APOSTROPHE = np.array([chr(b) in "stmdlrv" for b in range(256)])


def cut_words(raw: np.ndarray, first: np.ndarray, whole: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie in ``raw``, and which texts are not plain (and so have none).

    Text i begins at ``first[i]`` and a zero byte follows it; those in ``whole`` are not plain.  A run of white space gives its last blank to the word that
    follows; its last character, if no blank, is a word of its own there; what comes before, and a run that ends the text,
    is one word.
    """
    kind = _KIND[raw]
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[0], before[1:], after[-1], after[:-1] = _END, kind[:-1], _END, kind[1:]
    odd = kind == _OTHER
    follows = raw >= 0x80
    lead = raw == 0xC3
    follows &= ~lead
    odd[1:] |= follows[1:] & ~lead[:-1]
    odd[1:] |= lead[:-1] & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    odd[:-1] |= (raw[:-1] == 39) & _AFTER_APOSTROPHE[raw[1:]]
    ends = first[1:] - 1
    zero = np.flatnonzero(kind == _END)
    if len(zero) != len(ends):
        inner = np.setdiff1d(zero, ends, assume_unique=True)
        odd[inner] = True
    strange = np.zeros(len(ends), bool)
    strange[whole] = True
    strange[np.searchsorted(first, np.flatnonzero(odd), side="right") - 1] = True
    white, white_before, wordy_after = kind >= _BLANK, before >= _BLANK, (after >= _LETTER) & (after <= _MARK)
    start = (kind >= _LETTER) & (kind <= _MARK) & (kind != before) & (before != _BLANK)
    start |= white & (~white_before | wordy_after)
    for i in np.flatnonzero(strange).tolist():
        start[first[i] : ends[i]] = False
    edge = start.copy()
    edge[ends] = True
    at = np.flatnonzero(edge)
    real = np.flatnonzero(start[at])
    return at[real], at[real + 1], strange


class WordTable:
    """Places by 64-bit hash, with open addressing; all of numpy's steps handle many hashes at once."""

    def __init__(self, bits: int = 18) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The places, -1 for unknown hashes."""
        mask = (1 << self.bits) - 1
        slot = self._slots(hashes)
        held = self.keys.take(slot)
        hit = held == hashes
        out = np.where(hit, self.values.take(slot), -1)
        go = np.flatnonzero(~hit & (held != 0))
        hashes, slot = hashes.take(go), slot.take(go)
        while len(go):
            slot = (slot + 1) & mask
            held = self.keys.take(slot)
            hit = held == hashes
            out[go[hit]] = self.values.take(slot[hit])
            on = np.flatnonzero(~hit & (held != 0))
            go, hashes, slot = go.take(on), hashes.take(on), slot.take(on)
        return out

    def add(self, hashes: np.ndarray) -> None:
        """New distinct hashes, which take the next places."""
        values = np.arange(self.used, self.used + len(hashes))
        self.used += len(hashes)
        if 2 * self.used > 1 << self.bits:
            old = self.keys != 0
            hashes, values = np.concatenate([self.keys[old], hashes]), np.concatenate([self.values[old], values])
            self.bits = max(self.bits + 1, (3 * self.used).bit_length())
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        mask = (1 << self.bits) - 1
        slot = self._slots(hashes)
        while len(hashes):
            free = np.flatnonzero(self.keys.take(slot) == 0)
            self.keys[slot.take(free)] = hashes.take(free)
            won = self.keys.take(slot) == hashes
            self.values[slot[won]] = values[won]
            go = np.flatnonzero(~won)
            hashes, values, slot = hashes.take(go), values.take(go), (slot.take(go) + 1) & mask


class ByteBpe:
    def __init__(self, config: str, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.tokenizer.encode_special_tokens = special_as_text
        parts = json.loads(config)
        added = [x for x in parts.get("added_tokens") or [] if x["content"]]
        self.added = [x["content"].encode() for x in added if not (special_as_text and x.get("special"))]
        pre = parts.get("pre_tokenizer") or {}
        # words of letters are encoded in a row, so an added token must not be able to lie in such a row
        self.plain = all(re.search(r"[^\w\s]", t.decode()) for t in self.added)
        self.plain &= pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not parts.get("normalizer")
        #: the bytes that each id stands for (byte-level vocabularies have a character per byte)
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        for x in added:
            self.lengths[x["id"]] = len(x["content"].encode())
        self._clear()

    def _clear(self) -> None:
        self.table = WordTable()
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _batch(self, texts: list[str]) -> list:
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return fast(texts, add_special_tokens=False)

    def _learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Encode new words.  Words of a blank and letters go to the library in a row, as it cuts them apart again."""
        first = self.table.used
        self.table.add(hashes)
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alone = []
        spaced = []
        for i, w in enumerate(words):
            (spaced if w[0] == 32 and len(w) > 1 and _KIND[w[1]] == _LETTER else alone).append(i)
        if spaced:
            texts = [words[i] for i in spaced]
            ids = np.array(self._batch([b"".join(texts).decode()])[0].ids, np.int32)
            upto = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(t) for t in texts]), side="right")
            begin[spaced], size[spaced] = self.used + np.concatenate([[0], upto[:-1]]), np.diff(upto, prepend=0)
            self._store(ids)
        if alone:
            lists = [e.ids for e in self._batch([words[i].decode() for i in alone])]
            size[alone] = [len(x) for x in lists]
            begin[alone] = self.used + np.cumsum(size[alone]) - size[alone]
            self._store(np.array([i for x in lists for i in x], np.int32))
        while len(self.begin) < self.table.used:
            self.begin, self.size = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.begin[first : self.table.used], self.size[first : self.table.used] = begin, size

    def _store(self, ids: np.ndarray) -> None:
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each."""
        if self.table.used > CACHE_WORDS:
            self._clear()
        if not self.plain:
            lists = [np.array(e.ids, np.int32) for e in self._batch([t.decode("utf-8", "replace") for t in texts])]
            return np.concatenate([np.empty(0, np.int32), *lists]), np.fromiter(map(len, lists), np.int64, len(lists))
        joined = b"\x00".join([*texts, b""])
        if not joined:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        raw = np.frombuffer(joined, np.uint8)
        there = [t for t in self.added if t in joined]
        start, end, strange = cut_words(raw, first, [i for i, x in enumerate(texts) if any(t in x for t in there)] if there else [])
        hashes = np.maximum(span_hashes(raw, start, end), np.uint64(1))
        at = self.table.find(hashes)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, where = np.unique(hashes[missing], return_index=True)
            where = missing[where]
            self._learn([joined[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)], new)
            at[missing] = self.table.find(hashes[missing])
        size = self.size[at]
        ids = self.flat[gathered(self.begin[at], size)]
        cut = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, first)]
        counts = np.diff(cut)
        if not strange.any():
            return ids, counts
        parts = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for n in np.flatnonzero(strange).tolist():
            parts[n] = np.array(self._batch([texts[n].decode("utf-8", "replace")])[0].ids, np.int32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


_of_worker: dict[tuple[str, bool], ByteBpe] = {}


def of_worker(config: str, special_as_text: bool = False) -> ByteBpe:
    """This Python worker's encoder for a vocabulary; its cache serves all the tasks that the worker runs."""
    key = config, special_as_text
    if key not in _of_worker:
        _of_worker.clear()
        _of_worker[key] = ByteBpe(*key)
    return _of_worker[key]


def gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the runs [begin, begin + size) in a row."""
    ends = np.cumsum(size)
    out = np.arange(int(ends[-1]) if len(ends) else 0)
    out += np.repeat(begin - ends + size, size)
    return out


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file's text for the executors; its size is that of the file, whatever the data."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())
