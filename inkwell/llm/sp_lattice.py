"""SentencePiece encoding, decoding, and sampling of distinct segmentations.

Sampling is Gumbel top-k without replacement.  The lattice of a whole text has a node per character and an edge per piece;
backward log-sums turn it into a tree of decisions with exact conditional probabilities.  A best-first (A*) search over
perturbed scores keeps one bound for every emitted path: the largest Gumbel-perturbed score of all segmentations that leave
this path somewhere and belong to no other emitted path's bound, drawn truncated at the score that the path was emitted
with.  The path with the largest bound gives the next segmentation: where it leaves the path, and which way, is drawn in
proportion to the probabilities left, and the rest is sampled down the tree.  So the first k are an exact sample without
replacement, in order.  With kappa the largest bound left after k, a segmentation of log-probability phi has the inclusion
score 1 - exp(-exp(phi - kappa)).

No piece goes over from other characters to a word mark, so the lattice falls apart into words; endings that many words share
are built once, and all words of a chunk's texts take their decisions together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.bpe import WordTable, gathered
from inkwell.llm.text import chunks, give_back, kept_columns, map_texts, mixed, quoted, span_hashes, tidied

MARK = "▁"
_STEP, _TOKEN = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)


def _uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((mixed(bits) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _uniform_of(bits: int) -> float:
    """The same for one number."""
    x = bits & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return ((x ^ x >> 31) >> 12) * 2.0**-52 + 2.0**-53


def _processor(model):
    """The library's processor of a model file's bytes, or one that is there already."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model) if isinstance(model, bytes) else model


class Pieces:
    """A SentencePiece model's pieces as a lattice vocabulary.

    The log-probabilities are the scores of a unigram model; a BPE model's scores are merge ranks, which are turned into
    log-probabilities by Zipf's law (-log(rank + 2)).  Both are scaled by ``alpha`` and normalised.
    """

    def __init__(self, proto: bytes, alpha: float = 1.0) -> None:
        self.processor = sp = _processor(proto)
        n = sp.get_piece_size()
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        texts = {i: sp.id_to_piece(i) for i in usable}
        if any(MARK in t and MARK in t.lstrip(MARK) for t in texts.values()):
            raise ValueError("pieces that go over from a word to a word mark are not supported")
        score = np.array([sp.get_score(i) for i in range(n)])
        ranks = all(float(s).is_integer() for s in score[usable])
        logp = -np.log(np.clip(-score, 0, n) + 2) if ranks else score.copy()
        logp = alpha * logp
        logp[usable] -= np.logaddexp.reduce(logp[usable])
        self.floor = float(logp[usable].min()) - 2.0 * alpha  # of each byte of a character without a piece
        self.size, self.logp, self.unknown = n, logp, sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.longest = max(map(len, texts.values()))
        # id of a piece, or -1 of a mere beginning of pieces, by the hash of its characters; a hash that meets another
        # one in a table goes on to the next table
        size = np.fromiter(map(len, texts.values()), np.int64, len(texts))
        code = np.frombuffer("".join(texts.values()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        own = np.fromiter(texts, np.int32, len(texts))
        at, h, parts = np.cumsum(size) - size, np.zeros(len(texts), np.uint64), []
        while len(at):
            h = h * np.uint64(_BASE) + code[at] + np.uint64(1)
            size = size - 1
            parts.append((h, np.where(size == 0, own, -1)))
            go = size > 0
            at, h, size, own = at[go] + 1, h[go], size[go], own[go]
        hashes, ids = mixed(np.concatenate([h for h, _ in parts])), np.concatenate([x for _, x in parts]).astype(np.int32)
        order = np.lexsort((ids, hashes))  # the last one of a hash: a piece, if it is one, before a mere beginning
        order = order[np.append(np.diff(hashes[order]) != 0, True)]
        hashes, ids = hashes[order], ids[order]
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        while len(ids):
            bits = max(12, (4 * len(ids)).bit_length())
            shift = np.uint64(64 - bits)
            slot = (hashes >> shift).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            held, name = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32)
            held[slot[first]], name[slot[first]] = hashes[first], ids[first]
            self.tables.append((shift, held, name))
            rest = np.setdiff1d(np.arange(len(ids)), first)
            hashes, ids = hashes[rest], ids[rest]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces, -1 for beginnings of pieces, -2 for anything else."""
        out, rest = np.full(len(hashes), -2, np.int32), None
        for shift, held, name in self.tables:
            at = (hashes >> shift).astype(np.int64)
            there = held.take(at)
            hit = there == hashes
            found = np.flatnonzero(hit)
            out[found if rest is None else rest.take(found)] = name.take(at.take(found))
            go = np.flatnonzero(~hit & (there != 0))  # another one's place
            hashes, rest = hashes.take(go), go if rest is None else rest.take(go)
        return out

    def normalized(self, text: str) -> str:
        return self.processor.normalize(text)


_BASE = 0x9E3779B97F4A7C15


def cut_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of normalised texts in a row, where their words start and end and what they hash to, and the words before each
    text (with the total).  A word is a run of word marks with what follows up to the next mark."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\xff".join([*parts, b""])  # a byte that no text has
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    raw = np.frombuffer(joined, np.uint8)
    lead = np.flatnonzero(raw[:-2] == 0xE2) if len(raw) > 2 else np.empty(0, np.int64)
    lead = lead[(raw[lead + 1] == 0x96) & (raw[lead + 2] == 0x81)]
    start = np.zeros(len(raw), bool)
    start[lead[np.diff(lead, prepend=-9) != 3]] = True  # a mark right after another one begins no word
    full = size > 0
    start[begin[:-1][full]] = True
    edge = start.copy()
    edge[begin[1:] - 1] = True
    at = np.flatnonzero(edge)
    real = np.flatnonzero(start[at])
    start, end = at[real], at[real + 1] if len(real) else at[real]
    hashes = np.maximum(span_hashes(raw, start, end), np.uint64(1))
    return raw, start, end, hashes, np.searchsorted(start, begin)


class Encoder:
    """The library's own encoding, with a cache of words.

    Where no piece goes over from a word to the next one and normalising does no more than to turn blanks into marks, the
    ids of a text are the ids of its words in turn, and each distinct word goes to the library once; else whole texts do.
    """

    #: Words kept; the cache starts anew beyond that.
    MOST_WORDS = 200_000

    #: Bytes of new words that go to the library in one text.
    JOINED_BYTES = 1 << 10

    def __init__(self, model) -> None:
        self.processor = sp = _processor(model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        # bytes that an id stands for; none are known of an unknown character's
        self.bytes = np.array([1 if sp.is_byte(i) else 0 if sp.is_control(i) else -(1 << 40) if sp.is_unknown(i) else len(t.encode()) for i, t in enumerate(pieces)], np.int64)
        self.by_words = sp.normalize(" a  b ") == f"{MARK}{MARK}a{MARK}{MARK}b{MARK}" and not any(MARK in t.lstrip(MARK) for t in pieces)
        self.blank = sp.encode("a ")[len(sp.encode("a")) :]  # of a mark alone
        self._clear()

    def _clear(self) -> None:
        self.table, self.cuts, self.ids = WordTable(), _Grown(np.int32), _Grown(np.int32)
        self.cuts.extend(np.zeros(1, np.int32))

    def encode(self, texts: list[str], words: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each; ``words`` are ``cut_words`` of the normalised texts, if
        at hand."""
        if not self.by_words:
            lists = [np.array(x, np.int32) for x in self.processor.encode(texts)]
            return np.concatenate([np.empty(0, np.int32), *lists]), np.fromiter(map(len, lists), np.int64, len(lists))
        if len(self.cuts) > self.MOST_WORDS:
            self._clear()
        raw, start, end, hashes, first_word = words or cut_words([self.processor.normalize(t) for t in texts])
        number = self.table.find(hashes)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            where, place = _distinct(hashes.take(missing))
            where = missing.take(where)
            ids, size = self._learnt(raw, start.take(where), end.take(where))
            self.cuts.extend(len(self.ids) + np.cumsum(size))
            self.ids.extend(ids)
            number[missing] = self.table.used + place
            self.table.add(hashes.take(where))
        found = pa.ListArray.from_arrays(pa.array(self.cuts.all()), pa.array(self.ids.all())).take(pa.array(number))
        cut = found.offsets.to_numpy()[first_word].astype(np.int64)
        return found.values.to_numpy()[cut[0] : cut[-1]], np.diff(cut)

    def _learnt(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of these words in a row, and the number of ids of each.  Words go to it several in one text, as no
        piece crosses them; they are told apart by the bytes that their ids stand for."""
        size = end - start
        bare = raw[end - 1] == 0x81
        bare &= (raw[end - 2] == 0x96) & (raw[end - 3] == 0xE2)  # of marks alone, which would run into the next word
        joined = np.flatnonzero(~bare)
        own = raw[gathered(start[joined], size[joined])].tobytes()
        ends = np.cumsum(size[joined])
        last = np.append(np.flatnonzero(np.diff((ends - 1) // self.JOINED_BYTES)), len(ends) - 1) if len(ends) else joined
        ids, _ = self._encoded([own[a:b] for a, b in zip([0, *ends[last].tolist()], ends[last].tolist(), strict=False)])
        upto = np.cumsum(self.bytes[ids])
        at = np.searchsorted(upto, ends)
        if len(ends) and (not len(ids) or upto[-1] != ends[-1] or self.bytes[ids].min() < 0 or (upto[at] != ends).any()):
            bare[:] = True  # ids that do not tell their bytes: each word by itself
            joined, at, ids = joined[:0], at[:0], ids[:0]
        alone = np.flatnonzero(bare)
        more, cut = self._encoded([raw[a:b].tobytes() for a, b in zip(start[alone].tolist(), end[alone].tolist(), strict=True)])
        counts = np.empty(len(size), np.int64)
        counts[joined], counts[alone] = np.diff(at + 1, prepend=0), np.diff(cut)
        if not len(alone):
            return ids, counts
        begin = np.empty(len(size), np.int64)
        begin[joined], begin[alone] = np.concatenate([[0], at + 1])[: len(joined)], len(ids) + cut[:-1]
        return np.concatenate([ids, more])[gathered(begin, counts)], counts

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of normalised texts in a row, and where each one's begin (with the end)."""
        # the library puts the first mark back, but for a text of nothing else
        own = [w.decode("utf-8", "surrogatepass")[1:].replace(MARK, " ") for w in words]
        lists = [x if t else self.blank for t, x in zip(own, self.processor.encode(own), strict=True)]
        return np.concatenate([np.empty(0, np.int32), *(np.array(x, np.int32) for x in lists)]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


class Lattice:
    """Lattices of distinct words; words are added as they come, and kept for later texts.

    What can follow a place of a word depends on the rest of the word alone, so a node stands for a rest, whatever words end
    in it; node 0 is the end of all words.  The edges that leave a node lie in a row from ``first[node]``, shorter pieces
    first; they lead to the nodes ``ahead``, which have smaller numbers; ``cum`` sums their conditional probabilities (2 at
    the last); ``beta`` is the log-sum of all ways from a node to the end.
    """

    #: Nodes kept; beyond that, the next chunk starts anew.
    MOST_NODES = 300_000
    #: So few words left are handled one by one instead of together.
    FEW = 2
    #: Characters of new words that are looked through at once.
    BUILT_CHARS = 1 << 16

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.first, self.beta = _Grown(np.int32), _Grown(np.float64)
        self.ahead, self.piece, self.logp, self.cum = _Grown(np.int32), _Grown(np.int32), _Grown(np.float64), _Grown(np.float64)
        self.clear()

    def clear(self) -> None:
        self.table = WordTable(20)  # sparse: look-ups end after few steps
        self.extra: list[list[int]] = []  # ids of the characters without a piece
        self.spelt: dict[int, int] = {}
        for mine in (self.first, self.beta):
            mine.replace(np.zeros(1))
        for mine in (self.ahead, self.piece, self.logp, self.cum):
            mine.replace(np.zeros(0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The nodes of rests by their hashes; 0 for those that have none yet."""
        return self.table.find(hashes) + 1

    def add(self, code: np.ndarray, place: np.ndarray, left: np.ndarray, node_at: np.ndarray) -> None:
        """New nodes, which take the next numbers: the rests that begin at these places of ``code`` and have ``left``
        characters, shorter ones first.  ``node_at`` has the nodes of all places, new ones with the numbers they will have."""
        pieces = self.pieces
        n, base = len(place), len(self.first)
        # all pieces at all places, by length; only places where a longer piece may begin go on
        parts: list[tuple[np.ndarray, int, np.ndarray]] = []
        who, at, h, size = np.arange(n), place, np.zeros(n, np.uint64), 0
        while len(who):
            h *= np.uint64(_BASE)
            h += code.take(at)
            h += np.uint64(1)
            size += 1
            found = pieces.find(mixed(h))
            whole = np.flatnonzero(found >= 0)
            if size == 1:  # characters without a piece: their bytes, as one edge
                alone = np.flatnonzero(found < 0)
                rare = code[place[alone]].tolist()
                for c in set(rare) - set(self.spelt):
                    self.spelt[c] = len(self.extra)
                    raw = chr(c).encode("utf-8", "surrogatepass")
                    self.extra.append([pieces.bytes.get(x, pieces.unknown) for x in raw] if pieces.bytes else [pieces.unknown])
                parts.append((alone, 1, np.array([pieces.size + self.spelt[c] for c in rare], np.int32)))
            parts.append((who.take(whole), size, found.take(whole)))
            go = np.flatnonzero((found > -2) & (left.take(who) > size))
            who, at, h = who.take(go), at.take(go) + 1, h.take(go)
        # edges by node, shorter pieces first
        choices = np.zeros(n, np.int64)
        for who, _, _ in parts:
            choices[who] += 1
        cut = np.concatenate([[0], np.cumsum(choices)])
        first = cut[:-1]
        upto = first.copy()
        total = int(cut[-1])
        ahead, piece = np.empty(total, np.int64), np.empty(total, np.int64)
        for who, length, ids in parts:
            mine = upto.take(who)
            upto[who] += 1
            ahead[mine] = np.where(left.take(who) == length, 0, node_at.take(place.take(who) + length, mode="clip"))
            piece[mine] = ids
        logp = np.concatenate([pieces.logp, [pieces.floor * len(x) for x in self.extra]])[piece]
        # log-sums from the end, all rests of one length at once
        self.beta.extend(np.zeros(n))
        beta = self.beta.all()
        steps = np.flatnonzero(np.diff(left, prepend=0, append=0))
        far = len(steps) - 1
        while far and steps[far] - steps[far - 1] <= self.FEW:  # the far ends of very long words
            far -= 1
        for a, b in zip(steps[:far].tolist(), steps[1 : far + 1].tolist(), strict=True):
            low, high = cut[a], cut[b]
            beta[base + a : base + b] = np.logaddexp.reduceat(logp[low:high] + beta.take(ahead[low:high]), first[a:b] - low)
        self._sum_back(base, int(steps[far]), n, cut, ahead, logp, beta)
        logp += beta.take(ahead)
        logp -= np.repeat(beta[base:], choices)
        logp[first[choices == 1]] = 0.0
        cum = np.exp(logp)
        at, many = first, choices
        for rank in range(1, int(choices.max(initial=0))):  # each node by itself, so that no word's sums depend on other words
            go = np.flatnonzero(many > rank)
            at, many = at.take(go), many.take(go)
            cum[at + rank] += cum.take(at + rank - 1)
        cum[cut[1:] - 1] = 2.0
        edges = len(self.piece)
        for mine, new in ((self.first, first + edges), (self.ahead, ahead), (self.piece, piece), (self.logp, logp), (self.cum, cum)):
            mine.extend(new)

    @staticmethod
    def _sum_back(base: int, start: int, stop: int, cut: np.ndarray, ahead: np.ndarray, logp: np.ndarray, beta: np.ndarray) -> None:
        """The same log-sums node by node, the operations in the same order."""
        low = int(cut[start])
        score, ahead, cut = logp[low : cut[stop]].tolist(), ahead[low : cut[stop]].tolist(), (cut[start : stop + 1] - low).tolist()
        for node, at, end in zip(range(base + start, base + stop), cut, cut[1:], strict=False):
            total = score[at] + beta[ahead[at]]
            for e in range(at + 1, end):
                total = np.logaddexp(total, score[e] + beta[ahead[e]])
            beta[node] = total

    def words(self, cut: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The node of every word of every normalised text in turn, and the words before each text (with the total); ``cut``
        are ``cut_words`` of the texts."""
        if len(self.first) > self.MOST_NODES:
            self.clear()
        raw, start, end, hashes, first_word = cut
        node = self.find(hashes)
        missing = np.flatnonzero(node == 0)
        if len(missing):
            where, number = _distinct(hashes.take(missing))
            where = missing.take(where)
            node[missing] = self._learn(raw, start.take(where), end.take(where)).take(number)
        return node, first_word

    def _learn(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The nodes of the words at these byte places, made a bounded number of characters at once."""
        size = end - start
        own = raw[gathered(start, size)]
        code = np.frombuffer(own.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        begin = np.flatnonzero((own & 0xC0) != 0x80)
        ends = np.cumsum(size)
        chars = np.concatenate([[0], np.searchsorted(begin, ends)])
        hashes = np.maximum(span_hashes(own, begin, np.repeat(ends, np.diff(chars))), np.uint64(1))
        left = np.repeat(chars[1:], np.diff(chars)) - np.arange(len(code))
        at, found = 0, np.empty(len(size), np.int64)
        while at < len(size):
            upto = max(at + 1, int(np.searchsorted(chars, chars[at] + self.BUILT_CHARS, side="right")) - 1)
            part = slice(chars[at], chars[upto])
            node = self.find(hashes[part])
            missing = np.flatnonzero(node == 0)
            if len(missing):
                where, number = _distinct(hashes[part].take(missing))
                new = missing.take(where)
                remain = left[part].take(new)
                order = np.argsort(remain.astype(np.uint16) if remain.max() < 1 << 16 else remain, kind="stable")
                new, remain = new.take(order), remain.take(order)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(self.first), len(self.first) + len(order))
                node[missing] = place.take(number)
                self.table.add(hashes[part].take(new))
                self.add(code[part], new, remain, node)
            found[at:upto] = node.take(chars[at:upto] - chars[at])
            at = upto
        return found

    def ways(self, edge: int) -> range:
        """All edges that leave the node that this one leaves."""
        first = self.first.all()
        after = int(np.searchsorted(first, np.int32(edge), side="right"))  # node 0 has none, any other some
        return range(int(first[after - 1]), int(first[after]) if after < len(first) else len(self.piece))

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample a path from each ``node`` to the end: its edges in turn, and the number of edges of each path."""
        first, cum, ahead = self.first.all(), self.cum.all(), self.ahead.all()
        active, steps = np.flatnonzero(node), []
        at, key = node[active], key[active]
        counts, t = np.zeros(len(node), np.int64), 0
        alone: list[tuple[int, list[int]]] = []
        while len(active):
            if len(active) <= self.FEW:
                alone = [(int(w), self._walk_on(int(a), int(k), t)) for w, a, k in zip(active, at, key, strict=True)]
                break
            u = _uniform(key + _STEP * np.uint64([t]))
            edge = first.take(at).astype(np.int64)
            wait = np.flatnonzero(cum.take(edge) <= u)
            more, above = edge.take(wait) + 1, u.take(wait)
            while len(wait):
                edge[wait] = more
                go = np.flatnonzero(cum.take(more) <= above)
                wait, more, above = wait.take(go), more.take(go) + 1, above.take(go)
            steps.append((active, edge))
            counts[active] += 1
            at = ahead.take(edge)
            go = np.flatnonzero(at)
            active, at, key = active.take(go), at.take(go), key.take(go)
            t += 1
        taken = counts.copy()
        for w, edges in alone:
            counts[w] += len(edges)
        offset = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for t, (who, edge) in enumerate(steps):
            out[offset[who] + t] = edge
        for w, edges in alone:
            at = int(offset[w] + taken[w])
            out[at : at + len(edges)] = edges
        return out, counts

    def _walk_on(self, node: int, key: int, t: int) -> list[int]:
        """The rest of one path, with the same random numbers."""
        first, cum, ahead, out = self.first.all(), self.cum.all(), self.ahead.all(), []
        while node:
            u = _uniform_of(key + int(_STEP) * t)
            edge = int(first[node])
            while cum[edge] <= u:
                edge += 1
            out.append(edge)
            node = int(ahead[edge])
            t += 1
        return out


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct hash is (once, anywhere), and the number of each hash among the distinct ones.  No hash is 0."""
    order = np.argsort(hashes)
    new = np.diff(hashes.take(order), prepend=np.uint64(0)) != 0
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order.take(np.flatnonzero(new)), number


class _Grown:
    """An array that grows at its end."""

    #: Bytes kept for new values; more were for a very long text.
    MOST_KEPT = 1 << 24

    def __init__(self, kind) -> None:
        self.array, self.used = np.empty(1 << 12, kind), 0

    def __len__(self) -> int:
        return self.used

    def extend(self, values: np.ndarray) -> None:
        need = self.used + len(values)
        if need > len(self.array):
            self.array = np.concatenate([self.array[: self.used], np.empty(max(need, 3 * len(self.array) // 2) - self.used, self.array.dtype)])
        self.array[self.used : need] = values
        self.used = need

    def replace(self, values: np.ndarray) -> None:
        if self.array.nbytes > self.MOST_KEPT:
            self.array = np.empty(1 << 12, self.array.dtype)
        self.used = 0
        self.extend(values)

    def all(self) -> np.ndarray:
        return self.array[: self.used]


class Samples:
    """k distinct segmentations of each normalised text of a chunk, best perturbed score first.

    ``ids[d]`` lists each sample's ids; ``log_prob``, ``gumbel`` and ``inclusion`` are lists alongside.  A text with fewer
    segmentations gives them all, with inclusion 1; an empty one gives one empty segmentation.
    """

    def __init__(self, texts: list[str], keys: np.ndarray, lattice: Lattice, k: int, words: tuple | None = None) -> None:
        word, first_word = lattice.words(words or cut_words(texts))
        self.lattice = lattice
        text_of = np.repeat(np.arange(len(texts)), np.diff(first_word))
        self.keys = keys = mixed(keys.astype(np.uint64))
        word_key = mixed(keys.take(text_of) + (np.arange(len(word)) - first_word.take(text_of)).astype(np.uint64) * _TOKEN)
        size_of = np.fromiter(map(len, lattice.extra), np.int64, len(lattice.extra))
        flat = np.array([i for x in lattice.extra for i in x], np.int32)
        begin_of = np.cumsum(size_of) - size_of
        self.ids: list[list[np.ndarray]] = [[] for _ in texts]
        self.log_prob: list[list[float]] = [[] for _ in texts]
        self.gumbel: list[list[float]] = [[] for _ in texts]
        best = -np.log(-np.log(_uniform(keys + np.uint64(7))))  # the root's perturbed score: its log-probability is 0

        def spelled(edges: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            piece = lattice.piece.all().take(edges)
            at = np.flatnonzero(piece >= lattice.pieces.size)
            if not len(at):
                return piece, cut
            which = piece[at] - lattice.pieces.size
            sizes = np.ones(len(piece), np.int64)
            sizes[at] = size_of[which]
            out, before = np.repeat(piece, sizes), np.concatenate([[0], np.cumsum(size_of[which] - 1)])
            out[gathered(at + before[:-1], size_of[which])] = flat[gathered(begin_of[which], size_of[which])]
            return out, cut + before[np.searchsorted(at, cut)]

        edges, counts = lattice.walk(word, word_key + np.uint64(1))
        word_cut = np.concatenate([[0], np.cumsum(counts)])
        cut = word_cut[first_word]
        ids, id_cut = spelled(edges, cut)
        logp = lattice.logp.all().take(edges)
        paths: list[list[_Path]] = []
        for d, (a, b, low, high) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), id_cut[:-1].tolist(), id_cut[1:].tolist(), strict=True)):
            prefix = _sums(0.0, logp[a:b])
            self._emit(d, ids[low:high], float(prefix[-1]), float(best[d]))
            w, x = int(first_word[d]), int(first_word[d + 1])
            paths.append([_Path(self, d, 1, edges[a:b], prefix, word_cut[w : x + 1] - a, 0, 0.0, float(best[d]))] if b > a else [])
        for s in range(2, k + 1):
            begun, start, start_key, owner = [], [], [], []
            for d, mine in enumerate(paths):
                if not mine or len(self.ids[d]) < s - 1:
                    continue
                p = max(mine, key=lambda p: p.bound)
                taken = p.leave(s) if p.bound > -np.inf else None
                if taken is None:
                    continue
                j, top, edge, phi = taken
                # the word that decision j lies in, from after the new edge on, and the words after it are walked anew
                w = int(first_word[d]) + int(np.searchsorted(p.word_cut, j, side="right")) - 1
                rest = slice(w, int(first_word[d + 1]))
                at = word[rest].copy()
                at[0] = lattice.ahead.all()[edge]
                start.append(at)
                start_key.append(word_key[rest] + np.uint64([s]) * _TOKEN)
                owner.append(len(at))
                begun.append((d, p, j, top, edge, phi, w - int(first_word[d])))
            if not begun:
                break
            more, counts = lattice.walk(np.concatenate(start), np.concatenate(start_key))
            walked = np.concatenate([[0], np.cumsum(counts)])
            of = np.concatenate([[0], np.cumsum(owner)])
            cut = walked[of]
            whole = [np.concatenate([p.edges[:j], [edge], more[a:b]]) for (_, p, j, _, edge, _, _), a, b in zip(begun, cut[:-1], cut[1:], strict=True)]
            ids, id_cut = spelled(np.concatenate(whole), np.concatenate([[0], np.cumsum([len(x) for x in whole])]))
            logp = lattice.logp.all().take(more)
            for n, (d, p, j, top, _, phi, w) in enumerate(begun):
                a, b = int(cut[n]), int(cut[n + 1])
                prefix = np.concatenate([p.prefix[: j + 1], _sums(phi, logp[a:b])])
                self._emit(d, ids[id_cut[n] : id_cut[n + 1]], float(prefix[-1]), top)
                ends = walked[of[n] + 1 : of[n + 1] + 1] - a + j + 1
                paths[d].append(_Path(self, d, s, whole[n], prefix, np.concatenate([p.word_cut[: w + 1], ends]), j + 1, phi, top))
        kappa = [max((p.bound for p in mine), default=-np.inf) for mine in paths]
        self.inclusion = [[1.0 if x == -np.inf else float(-np.expm1(-np.exp(min(v - x, 700.0)))) for v in mine] for mine, x in zip(self.log_prob, kappa, strict=True)]

    def _emit(self, d: int, ids: np.ndarray, log_prob: float, gumbel: float) -> None:
        self.ids[d].append(ids)
        self.log_prob[d].append(log_prob)
        self.gumbel[d].append(gumbel)


class _Path:
    """An emitted path and the bound of all segmentations that leave it at one of its decisions from ``since`` on.

    ``prefix[j]`` is the log-probability of what comes before decision j, so the segmentations that leave the path before
    decision j have the probability exp(prefix[since]) - exp(prefix[j]): where to leave is drawn by bisection.
    """

    def __init__(self, samples: Samples, d: int, s: int, edges: np.ndarray, prefix: np.ndarray, word_cut: np.ndarray, since: int, phi: float, top: float) -> None:
        self.samples, self.d, self.s, self.edges, self.prefix, self.word_cut, self.since, self.phi = samples, d, s, edges, prefix, word_cut, since, phi
        self.taken: set[tuple[int, int]] = set()
        self.mass = _log_less(phi, float(prefix[-1]))
        self.bound = _truncated(self.mass, top, self._uniform(s, 29))

    def _uniform(self, s: int, what: int) -> float:
        key = int(self.samples.keys[self.d]) + s * int(_STEP) + self.s * int(_TOKEN) + what * 0x9E3779B97F4A7C15
        return _uniform_of(key)

    def leave(self, s: int, tries: int = 32) -> tuple[int, float, int, float] | None:
        """Where the next segmentation leaves the path, its perturbed score, the edge it takes there and the log-probability
        up to and with it; None if nothing is left.  A way that was taken before is drawn again, and after some tries all
        ways that are left are laid out and one of them is drawn."""
        lattice, top = self.samples.lattice, self.bound
        drawn = next((x for x in (self._drawn(s, n) for n in range(tries)) if x and x not in self.taken), None) or self._listed(s)
        if drawn is None:
            self.bound = -np.inf
            return None
        j, edge = drawn
        self.taken.add(drawn)
        phi = float(self.prefix[j] + lattice.logp.all()[edge])
        self.mass = _log_less(self.mass, phi)
        self.bound = _truncated(self.mass, top, self._uniform(s, 31))
        return j, top, edge, phi

    def _drawn(self, s: int, n: int) -> tuple[int, int] | None:
        lattice = self.samples.lattice
        u, v = self._uniform(s, 100 + 2 * n), self._uniform(s, 101 + 2 * n)
        # what is left is between the probability of the whole path and that of the prefix
        left = self.phi + np.log1p(u * np.expm1(float(self.prefix[-1]) - self.phi))
        after = self.prefix[self.since + 1 :]
        j = len(after) - int(np.searchsorted(after[::-1], left, side="right")) + self.since
        j = min(j, len(self.edges) - 1)
        own = int(self.edges[j])
        ways = [e for e in lattice.ways(own) if e != own]
        if not ways:  # by rounding only
            return None
        score = lattice.logp.all()[ways]
        weight = np.cumsum(np.exp(score - score.max()))
        return j, ways[min(len(ways) - 1, int(np.searchsorted(weight, v * weight[-1], side="right")))]

    def _listed(self, s: int) -> tuple[int, int] | None:
        lattice = self.samples.lattice
        ways = [(j, e) for j in range(self.since, len(self.edges)) for e in lattice.ways(int(self.edges[j])) if e != self.edges[j] and (j, e) not in self.taken]
        if not ways:
            return None
        score = self.prefix[[j for j, _ in ways]] + lattice.logp.all()[[e for _, e in ways]]
        weight = np.cumsum(np.exp(score - score.max()))
        return ways[min(len(ways) - 1, int(np.searchsorted(weight, self._uniform(s, 99) * weight[-1], side="right")))]


def _sums(first: float, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(values) + 1)
    out[0], out[1:] = first, values
    return np.cumsum(out, out=out)


def _log_less(a: float, b: float) -> float:
    """log(exp(a) - exp(b)); nothing if they are equal but for rounding."""
    return a + float(np.log(-np.expm1(b - a))) if b - a < -1e-12 else -np.inf


def _truncated(phi: float, top: float, u: float) -> float:
    """A Gumbel variable of location phi, given that it is at most ``top``, from a uniform one."""
    return -float(np.logaddexp(-top, np.log(-np.log(u)) - phi)) if phi > -np.inf else -np.inf


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The model file for the executors; its size is that of the file, whatever the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def sample(docs: DataFrame, model_path: str, *, k: int = 2, seed: int = 1, alpha: float = 1.0, keep: list[str] | None = None, key_col: str = "doc_id", text_col: str = "text", own: bool = False) -> DataFrame:
    """k rows per text: ``keep``, ``sample`` (from 1), ``ids``, ``log_prob``, ``gumbel``, ``inclusion``, ``round_trip``.

    ``round_trip`` tells whether decoding the ids gives the text back (as the model normalises it).  With ``own`` the
    library's own encoding comes as sample 0 before them, without scores.

    Whole texts; a null one counts as empty, and an empty one has one segmentation without ids.  Random numbers come from
    the seed and the row's key alone: the same row gives the same samples on any cluster, and rows that share key and text
    share them.  Texts with fewer than k segmentations give all of them.  Read in place, no shuffle.
    """
    results = ["sample", "ids", "log_prob", "gumbel", "inclusion", "round_trip"]
    keep, columns, fields = kept_columns(docs, ["doc_id"] if keep is None else keep, set(results))
    proto = shipped(docs.sparkSession, model_path)
    source = docs.select(*columns, F.xxhash64(F.lit(seed), F.col(quoted(key_col))).alias("__key"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("__text"))
    schema = T.StructType(fields + [T.StructField("sample", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField(c, T.DoubleType()) for c in ("log_prob", "gumbel", "inclusion")] + [T.StructField("round_trip", T.BooleanType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # made anew in each task: kept in idle workers, they would take memory from whatever runs next
        lattice = Lattice(Pieces(proto.value, alpha))
        encoder, decoder = Encoder(lattice.pieces.processor) if own else None, Decoder(lattice.pieces.processor)
        give_back()  # what the vocabulary was built from
        for batch in batches:
            for part, texts in chunks(batch, "__text"):
                keys = part.column(len(keep)).to_numpy(zero_copy_only=False).view(np.uint64)
                texts = [t.decode("utf-8", "replace") for t in texts]
                normal = [lattice.pieces.normalized(t) for t in texts]
                words = cut_words(normal)
                found = Samples(normal, keys, lattice, k, words)
                scores = [found.log_prob, found.gumbel, found.inclusion]
                lists = found.ids
                if own:
                    flat, size = encoder.encode(texts, words)
                    lists = [[x, *mine] for x, mine in zip(np.split(flat, np.cumsum(size)[:-1]), lists, strict=True)]
                    scores = [[[None, *mine] for mine in x] for x in scores]
                counts = [len(x) for x in lists]
                rows = pa.array(np.repeat(np.arange(len(texts)), counts))
                ids = [x for mine in lists for x in mine]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
                arrays = pa.ListArray.from_arrays(pa.array(offsets), flat)
                back = decoder.same(flat, offsets, [t.encode() for t in normal], counts)
                numbers = pa.array([i + (not own) for n in counts for i in range(n)], pa.int32())
                floats = [pa.array([v for mine in x for v in mine], pa.float64()) for x in scores]
                yield pa.RecordBatch.from_arrays([part.column(i).take(rows) for i in range(len(keep))] + [numbers, arrays, *floats, pa.array(back, pa.bool_())], names=names)
            batch = part = None  # not beside the next one

    return source.mapInArrow(tidied(run), schema).toDF(*keep, *results)


def encode(docs: DataFrame, model_path: str, *, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns plus ``ids``: the library's own encoding of each whole text.

    A null text counts as empty and has no ids; repeated rows get a row each; an empty table gives an empty one; an input
    column ``ids`` is replaced.  Read in place, no shuffle.
    """
    proto = shipped(docs.sparkSession, model_path)

    def make():
        encoder = Encoder(proto.value)

        def work(texts: list[bytes]) -> list:
            ids, size = encoder.encode([t.decode("utf-8", "replace") for t in texts])
            return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids, pa.int32()))]

        return work

    return map_texts(docs, text_col, ["doc_id"] if keep is None else keep, [T.StructField("ids", T.ArrayType(T.IntegerType()))], make)


class Decoder:
    """Ids to texts: the pieces' characters or bytes in a row, word marks as spaces, without the leading one."""

    def __init__(self, model) -> None:
        sp = _processor(model)
        spelt = []
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                spelt.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]))
            elif sp.is_control(i):
                spelt.append(b"")
            else:
                spelt.append(sp.id_to_piece(i).replace(MARK, " ").encode() if not sp.is_unknown(i) else " ⁇ ".encode())
        self.size = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt = pa.array([x.replace(b" ", MARK.encode()) for x in spelt], pa.large_binary())
        self.dummy = sp.normalize("a").startswith(MARK)

    def same(self, ids: pa.Array, cuts: np.ndarray, texts: list[bytes], counts: list[int]) -> list[bool]:
        """Whether the ids between each two cuts spell their text: the first ``counts[0]`` runs the first one, and so on."""
        found = self.spelt.take(ids)
        _, offsets, data = found.buffers()
        at = np.frombuffer(offsets, np.int64)[cuts] if len(ids) else np.zeros(len(cuts), np.int64)
        data = (data or pa.py_buffer(b"")).slice(0, int(at[-1]))
        wanted = [t for t, n in zip(texts, counts, strict=True) for _ in range(n)]
        if (np.diff(at) == np.fromiter(map(len, wanted), np.int64, len(wanted))).all() and data.equals(pa.py_buffer(b"".join(wanted))):
            return [True] * len(wanted)
        data, at = memoryview(data), at.tolist()
        return [bytes(data[a:b]) == t for a, b, t in zip(at, at[1:], wanted, strict=False)]

    def text(self, ids: np.ndarray) -> str:
        raw = self.flat[gathered(self.begin[ids], self.size[ids])].tobytes().decode("utf-8", "replace")
        return raw[1:] if self.dummy and raw.startswith(" ") else raw


def decode(encoded: DataFrame, model_path: str, *, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """``keep`` columns plus ``decoded``; null ids decode to null, null entries are left out, ids out of range raise."""
    proto = shipped(encoded.sparkSession, model_path)
    keep, columns, own = kept_columns(encoded, keep, {"decoded"})
    source = encoded.select(*columns, F.col(quoted(ids_col)).cast("array<int>").alias("__ids"))
    schema = T.StructType(own + [T.StructField("decoded", T.StringType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(proto.value)
        for batch in batches:
            column = batch.column(len(keep))
            out = [None if x is None or not x.is_valid else decoder.text(np.asarray(x.values.drop_null(), np.int64)) for x in column]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(out, pa.string())], names=names)

    return source.mapInArrow(tidied(run), schema).toDF(*keep, "decoded")


def segmentations(text: str, pieces: Pieces) -> dict[tuple[int, ...], float]:
    """Brute force for tests: every segmentation of a normalised text with its probability, from the pieces' texts alone."""
    sp, out = pieces.processor, {}
    ids = {sp.id_to_piece(i): i for i in range(pieces.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))}

    def go(at: int, done: tuple[int, ...], score: float) -> None:
        if at == len(text):
            out[done] = score
            return
        if text[at] not in ids:
            raw = [pieces.bytes.get(b, pieces.unknown) for b in text[at].encode()]
            go(at + 1, (*done, *raw), score + pieces.floor * len(raw))
        for size in range(1, min(pieces.longest, len(text) - at) + 1):
            if (i := ids.get(text[at : at + size])) is not None:
                go(at + size, (*done, i), score + float(pieces.logp[i]))

    go(0, (), 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: float(np.exp(v - total)) for k, v in out.items()}
