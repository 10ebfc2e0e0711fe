"""Benchmark decontamination by winnowing.

Each text is fingerprinted by the smallest k-gram hash of every window of w consecutive k-grams (k words each), so that
two texts sharing t = w + k - 1 words in a row always share a fingerprint, at the same place of these words.  An item of
fewer than t words counts as a whole: for each such length L the k-grams of k = L, w = 1 are kept, for which the same holds
with t = L.

Fingerprints of documents and benchmark are rows that are joined by hash.  A row carries the words around its k-gram that a
shared span of t words may reach; so each hit is extended word by word, exactly, on the row itself, and no text is sent
about.  A bitmap of fixed size of the benchmark's hashes first turns away the documents' fingerprints that surely meet none;
a larger benchmark only lets more of them through to the join.  Fingerprints that many documents share are dealt to several
tasks, and equal texts are one text until the end.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.text import Bits, Scratch, Words, chunks, dealt_join, hash_bits, kept_columns, mixed, quoted, saved, tidied, with_text

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Indices i such that values[i] is the smallest of some w consecutive values (all, if there are fewer than w)."""
    n = len(values)
    if n == 0:
        return np.empty(0, np.int64)
    w = min(w, n)
    least, span = values, 1
    while span < w:
        step = min(span, w - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    # values[i] is chosen if a window that holds it has it as its minimum: the largest of those minima equals it
    padded = np.concatenate([np.zeros(w - 1, values.dtype), least, np.zeros(w - 1, values.dtype)])
    most, span = padded, 1
    while span < w:
        step = min(span, w - span)
        most = np.maximum(most[: len(most) - step], most[step:])
        span += step
    return np.flatnonzero(most[:n] == values)


class Winnower:
    """Fingerprints of texts for spans of ``window`` words, and of fewer for whole short items (``size`` says how many)."""

    def __init__(self, window: int, k: int) -> None:
        self.window, self.k = window, min(k, window)

    def gram(self, size: int) -> int:
        return self.k if size == self.window else size

    def fingerprints(self, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes, different for every size, and the first word of each k-gram, of all texts."""
        k = self.gram(size)
        w = size - k + 1
        grams, places = words.grams(k)
        if w > 1 and len(grams):
            # windows may cross from one text into the next: that only adds fingerprints, but short runs need their own
            chosen = window_minima(grams, w)
            docs = words.doc[places]
            edges = np.flatnonzero(docs[1:] != docs[:-1]) + 1
            near = [i for e in [0, *edges.tolist(), len(grams)] for i in range(max(0, e - w + 1), min(len(grams), e + w - 1))]
            chosen = np.unique(np.concatenate([chosen, np.array(near, np.int64)]))
            grams, places = grams[chosen], places[chosen]
        return mixed(grams + np.uint64(size * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), places

    def context(self, words: Words, place: int, size: int) -> bytes:
        """The k-gram at a word with all words that a span of ``size`` words around it may have, and how many come before it."""
        doc, k = int(words.doc[place]), self.gram(size)
        begin = max(int(words.first[doc]), place + k - size)
        end = min(int(words.first[doc + 1]), place + size)
        return struct.pack("<H", place - begin) + b"\0".join([words.word(i) for i in range(begin, end)])

    def extended(self, mine: bytes, theirs: bytes, size: int) -> tuple[int, int] | None:
        """How far two contexts agree before and from the k-gram's first word on; None if that is less than ``size`` words."""
        i, j, k = struct.unpack_from("<H", mine)[0], struct.unpack_from("<H", theirs)[0], self.gram(size)
        a, b = mine[2:].split(b"\0"), theirs[2:].split(b"\0")
        if a[i : i + k] != b[j : j + k]:
            return None
        back = ahead = 0
        while back < min(i, j) and a[i - 1 - back] == b[j - 1 - back]:
            back += 1
        while ahead < min(len(a) - i, len(b) - j) and a[i + ahead] == b[j + ahead]:
            ahead += 1
        return (back, ahead) if back + ahead >= size else None

    def of_items(self, texts: list[bytes]) -> list[tuple[int, int, int, bytes]]:
        """(text, size, hash, context) of each text, repeated ones left out."""
        words, out = Words(texts), set()
        count = np.diff(words.first)
        for size in sorted({min(int(n), self.window) for n in count} - {0}):
            hashes, places = self.fingerprints(words, size)
            doc = words.doc[places]
            fits = np.flatnonzero(np.minimum(count[doc], self.window) == size)
            for d, h, p in zip(doc[fits].tolist(), hashes[fits].view(np.int64).tolist(), places[fits].tolist(), strict=True):
                out.add((d, size, h, self.context(words, p, size)))
        return sorted(out)

    def of_documents(self, texts: list[bytes], sizes: list[int], seen: Bits) -> tuple[np.ndarray, list[dict[tuple[int, bytes], list[int]]]]:
        """The number of words of each text, and (hash, context) -> word places of the fingerprints that may be the benchmark's."""
        words = Words(texts)
        found: list[dict[tuple[int, bytes], list[int]]] = [{} for _ in texts]
        for size in sizes:
            hashes, places = self.fingerprints(words, size)
            maybe = np.flatnonzero(seen.found(hashes))
            places = places[maybe]
            docs = words.doc[places]
            for d, h, p, at in zip(docs.tolist(), hashes[maybe].view(np.int64).tolist(), places.tolist(), (places - words.first[docs]).tolist(), strict=True):
                found[d].setdefault((h, self.context(words, p, size)), []).append(at)
        return np.diff(words.first), found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HIT = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("context", T.BinaryType()), T.StructField("places", T.ArrayType(T.IntegerType()))]))


def benchmark_rows(benchmark: DataFrame, winnower: Winnower, item_col: str, text_col: str) -> DataFrame:
    """(item, size, hash, context) of every item's fingerprints; a null id is shown as an empty one."""
    rows = benchmark.select(F.coalesce(F.col(quoted(item_col)).cast("string"), F.lit("")).alias("item"), F.col(quoted(text_col)).cast("string").alias("text"))
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("context", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                ids, found = part.column(0).to_pylist(), winnower.of_items(texts)
                cols = [[ids[d] for d, _, _, _ in found], *[[x[i] for x in found] for i in (1, 2, 3)]]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=schema.names)

    return rows.mapInArrow(tidied(run), schema).distinct()


def _marked(docs: DataFrame, names: list[str], columns: list, fields: list[T.StructField], text_col: str, winnower: Winnower, sizes: list[int], seen) -> DataFrame:
    """``columns``, the number of words, the fingerprints to be looked up, and for texts with any a name of the text."""
    source, text = with_text(docs, text_col, names, columns, fields)
    schema = T.StructType(fields + [T.StructField("__words", T.LongType()), T.StructField("__node", T.BinaryType()), T.StructField("__hits", _HIT)])
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("context", pa.binary()), ("places", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, text):
                count, found = winnower.of_documents(texts, sizes, seen.value)
                hits = [[{"hash": h, "context": c, "places": at} for (h, c), at in x.items()] or None for x in found]
                nodes = [hashlib.md5(t).digest() if x else None for t, x in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(fields)], pa.array(count, pa.int64()), pa.array(nodes, pa.binary()), pa.array(hits, kind)], names=schema.names)

    return source.mapInArrow(tidied(run), schema)


def _extended(met: DataFrame, winnower: Winnower) -> DataFrame:
    """(node, item, start, end) of the spans that a document's and an item's fingerprint share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for node, places, mine, item, size, theirs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if far := winnower.extended(mine, theirs, size):
                    out[0].extend([node] * len(places))
                    out[1].extend([item] * len(places))
                    out[2].extend(p - far[0] for p in places)
                    out[3].extend(p + far[1] for p in places)
            kinds = (pa.binary(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["node", "item", "start", "end"])

    return met.select("__node", "places", "context", "item", "size", "theirs").mapInArrow(run, "node binary, item string, start int, end int")


def _per_text(spans: DataFrame) -> DataFrame:
    """``__node``, ``__spans`` (merged) and ``__items`` (sorted) of every text with a hit."""
    rows = spans.groupBy("node").agg(F.collect_set("item").alias("items"), F.collect_set(F.struct("start", "end")).alias("spans"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in _merged([(x["start"], x["end"]) for x in mine])] for mine in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array([sorted(x) for x in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["__node", "__spans", "__items"])

    return rows.mapInArrow(run, T.StructType([T.StructField("__node", T.BinaryType()), T.StructField("__spans", SPANS), T.StructField("__items", T.ArrayType(T.StringType()))]))


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 13, k: int = 5, one_in: int = 20,
) -> DataFrame:
    """``keep`` columns plus ``n_words``, ``hit_spans`` (word places, end exclusive), ``n_hit``, ``items``, ``contaminated``.

    ``items`` lists as strings the ids of the items with an occurring window, sorted; a document is contaminated if
    ``n_hit > 0`` and ``one_in * n_hit >= n_words``.  A null text has no words and no hits; an item without words is
    ignored; items that share an id (or have a null one, shown as an empty id) count once for that id.  Repeated documents
    get a row each.  Documents are read in place; only those with a fingerprint to look up meet the join's results.
    """
    names, columns, fields = kept_columns(docs, ["doc_id"] if keep is None else keep, {"n_words", "n_hit", "items", "hit_spans", "contaminated"})
    spark, winnower = docs.sparkSession, Winnower(window, k)
    with Scratch(spark) as scratch:
        theirs = scratch.saved(benchmark_rows(benchmark, winnower, item_col, item_text_col), "benchmark")
        sizes = sorted(r[0] for r in theirs.select("size").distinct().collect())  # from 1 to the window's
        seen = spark.sparkContext.broadcast(hash_bits(theirs, "hash"))  # 4 MB whatever the benchmark
        marked = saved(_marked(docs, names, columns, fields, text_col, winnower, sizes, seen), "marked")
        maybe = marked.where(F.col("__hits").isNotNull())
        texts = maybe.groupBy("__node").agg(F.first("__hits").alias("__hits"))
        rows = scratch.saved(texts.select("__node", F.explode("__hits").alias("__hit")).select("__node", "__hit.*"), "fingerprints")
        met = dealt_join(rows, theirs.withColumnRenamed("context", "theirs"), "hash")
        found = saved(_per_text(_extended(met, winnower)), "hits")
    none = marked.where(F.col("__hits").isNull()).select(*[f.name for f in fields], "__words", F.array().cast(SPANS).alias("__spans"), F.array().cast("array<string>").alias("__items"))
    some = dealt_join(maybe, found, "__node", "left").select(
        *[f.name for f in fields], "__words", F.coalesce("__spans", F.array().cast(SPANS)).alias("__spans"), F.coalesce("__items", F.array().cast("array<string>")).alias("__items")
    )
    out = none.union(some).withColumn("__hit", F.aggregate("__spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]).cast("long")))
    contaminated = (F.col("__hit") > 0) & (F.lit(one_in) * F.col("__hit") >= F.col("__words"))
    return out.select(*[f.name for f in fields], "__words", "__spans", "__items", "__hit", contaminated).toDF(*names, "n_words", "hit_spans", "items", "n_hit", "contaminated")


def hit_words(text: str, item_texts: list[str], window: int = 13) -> set[int]:
    """Brute force for tests: places of the words of ``text`` inside any occurrence of a window of an item."""
    import re

    lower = {c: c + 32 for c in range(65, 91)}
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.translate(lower))
    mine, hit = words(text), set()
    for theirs in map(words, item_texts):
        n = min(window, len(theirs))
        wanted = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(mine) - n + 1):
            if n and tuple(mine[i : i + n]) in wanted:
                hit.update(range(i, i + n))
    return hit


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
