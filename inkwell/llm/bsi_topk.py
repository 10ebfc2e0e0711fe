"""Exact top-k inner products on a bit-sliced index.

Vectors are quantised to integers floor(scale * x).  The index holds blocks of rows; in a block, each attribute is a set
of bitmaps, one per bit of its value (shifted to be non-negative), with one bit per row.  A query's scores are formed by
bitmap arithmetic alone: for each set bit of a query value the attribute's slices are added, by carry-save adders, into
one bit-sliced sum.  The best rows are then selected from the most significant slice of the sum downward, and the rows
left at the boundary, which are tied exactly, by id.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.text import quoted, saved

#: Rows of an index block, and queries of a query block at most and, if there are so many, at least.
BLOCK_ROWS, BLOCK_QUERIES, LEAST_QUERIES = 1 << 16, 512, 32
#: Quantised components must lie within this bound, so that no score overflows 64 bits.
MOST = 1 << 26


def quantised(vectors: np.ndarray, scale: float) -> np.ndarray:
    q = np.floor(vectors.astype(np.float64) * scale)
    if q.size and np.abs(q).max() > MOST:
        raise ValueError(f"quantised components beyond {MOST} are not supported")
    return q.astype(np.int64)


class Index:
    """Bit slices of one block: ``slices[d]`` is (bits, words) of attribute d's values less ``low[d]``; ids ascend."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        n, dims = self.values.shape
        self.words = (n + 63) // 64
        self.low = self.values.min(0) if n else np.zeros(dims, np.int64)
        self.high = self.values.max(0) if n else np.zeros(dims, np.int64)
        self.slices: list[np.ndarray] = []
        for d in range(dims):
            u = self.values[:, d] - self.low[d]
            bits = int(u.max()).bit_length() if n else 0
            out = np.zeros((bits, self.words), np.uint64)
            for j in range(bits):
                packed = np.packbits((u >> j) & 1 == 1, bitorder="little")
                out[j].view(np.uint8)[: len(packed)] = packed
            self.slices.append(out)
        self.flipped = [~s for s in self.slices]
        self.there = np.zeros(self.words, np.uint64)
        ones = np.packbits(np.ones(n, bool), bitorder="little")
        self.there.view(np.uint8)[: len(ones)] = ones
        self.place = {}
        for i, v in enumerate(self.ids.tolist()):
            self.place.setdefault(v, []).append(i)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least first, of a sum that orders the rows as their inner products with the query do.

        Query values are taken in non-adjacent form, digits -1, 0 and 1 of few non-zero ones; a digit -1 takes the
        complements of its attribute's slices, which only shifts all sums alike.
        """
        piles: dict[int, list[np.ndarray]] = {}
        for d, q in enumerate(query.tolist()):
            shift = 0
            while q:
                if q & 1:
                    digit = 2 - (q & 3)
                    q -= digit
                    for j, s in enumerate(self.slices[d] if digit > 0 else self.flipped[d]):
                        piles.setdefault(j + shift, []).append(s)
                q >>= 1
                shift += 1
        out, weight = [], 0
        x, y = np.empty(self.words, np.uint64), np.empty(self.words, np.uint64)
        while weight <= max(piles, default=-1):
            pile = piles.get(weight, [])
            carry = piles.setdefault(weight + 1, []) if len(pile) > 1 else []
            while len(pile) > 2:  # full adder: three slices of a weight make one, and one of the next weight
                a, b, c = pile.pop(), pile.pop(), pile.pop()
                np.bitwise_xor(a, b, out=x)
                np.bitwise_and(a, b, out=y)
                up = x & c
                up |= y
                carry.append(up)
                pile.append(x ^ c)
            if len(pile) == 2:
                a, b = pile
                carry.append(a & b)
                pile = [a ^ b]
            out.append(pile[0] if pile else np.zeros(self.words, np.uint64))
            weight += 1
        return out

    def top(self, query: np.ndarray, k: int, own_id: int | None = None) -> list[int]:
        """Places of the k rows with the largest products, ties to smaller ids; rows with the query's own id left out."""
        rest, sure, n_sure = self.there.copy(), np.zeros(self.words, np.uint64), 0
        for i in self.place.get(own_id, ()):
            rest[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        for s in reversed(self.sums(query)):
            high = rest & s
            n = n_sure + int(np.bitwise_count(high).sum())
            if n > k:
                rest = high
            else:
                sure |= high
                n_sure = n
                rest &= ~s
                if n == k:
                    rest[:] = 0
                    break
        places = _set_bits(sure)
        if n_sure < k:  # the boundary: equal sums, so the smaller ids, which come first
            places = np.concatenate([places, _set_bits(rest, k - n_sure)])
        return places.tolist()


def _set_bits(words: np.ndarray, most: int | None = None) -> np.ndarray:
    at = np.flatnonzero(words)
    if most is not None:
        at = at[:most]
    bits = np.unpackbits(words[at].view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    out = at[row] * 64 + bit
    return out if most is None else out[:most]


def _packed(ids: np.ndarray, values: np.ndarray) -> bytes:
    return struct.pack("<2I", *values.shape) + ids.astype("<i8").tobytes() + values.astype("<i4").tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, dims = struct.unpack_from("<2I", blob)
    return np.frombuffer(blob, "<i8", n, 8), np.frombuffer(blob, "<i4", n * dims, 8 + 8 * n).reshape(n, dims).astype(np.int64)


def _blocks(vectors: DataFrame, rows: int, scale: float) -> DataFrame:
    """(id, vec) rows as blocks of at most ``rows``, packed where they lie: ``name`` is the same whenever a task is redone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids: dict[int, list[np.ndarray]] = {}
        values: dict[int, list[np.ndarray]] = {}
        made = [0]

        def block(dims: int) -> pa.RecordBatch:
            i, v = np.concatenate(ids[dims]), np.concatenate(values[dims])
            ids[dims], values[dims] = [i[rows:]], [v[rows:]]
            made[0] += 1
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() * 1_000_003 + made[0]], pa.int64()), pa.array([dims], pa.int32()), pa.array([_packed(i[:rows], v[:rows])], pa.binary())], names=["name", "dims", "payload"])

        for batch in batches:
            all_ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            size = np.asarray(pc.list_value_length(column))
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            cut = np.concatenate([[0], np.cumsum(size)])
            for dims in np.unique(size).tolist():  # vectors of different lengths never meet
                at = np.flatnonzero(size == dims)
                x = flat[(cut[at][:, None] + np.arange(dims)[None]).ravel()].reshape(len(at), dims)
                ids.setdefault(dims, []).append(all_ids[at].astype(np.int64))
                values.setdefault(dims, []).append(quantised(x, scale))
                while sum(map(len, ids[dims])) >= rows:
                    yield block(dims)
        for dims in ids:
            while sum(map(len, ids[dims])):
                yield block(dims)


    return vectors.mapInArrow(run, "name bigint, dims int, payload binary")


def top_k(
    vectors: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_filter=None, scale: float = 256.0,
    block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's k best integer inner products over all other rows.

    Queries are the rows that ``query_filter`` (a function of the id column; default all) holds for, candidates all rows
    but those with the query's id; ties go to the smaller id.  Rows with a null id or vector, or a null or non-finite
    component, take no part; an empty vector takes part with score 0; vectors of different lengths never meet.  Repeated
    rows are candidates of their own.  A query is an id with a quantised vector: rows that share both are answered once, rows
    that share the id only are answered each by itself (their answers differ by nothing but score).  Every block of rows meets every
    block of queries once; a task holds one index block and one query block at a time.
    """
    spark = vectors.sparkSession
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("i"), F.col(quoted(vector_col)).cast("array<double>").alias("v"))
    rows = rows.where(F.col("i").isNotNull() & F.col("v").isNotNull()).where(finite)
    # as few partitions as fill their blocks: a block's bitmaps are added at a cost per slice, however short
    index = saved(_blocks(rows.coalesce(max(1, vectors.count() // block_rows)), block_rows, scale), "index")
    asked = rows.where(query_filter(F.col("i"))) if query_filter else rows
    asked = asked.select("i", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    asked = saved(asked.distinct(), "queries")
    n_asked = asked.count()
    each = min(block_queries, max(LEAST_QUERIES, -(-n_asked // groups)))
    asked = _blocks(asked.coalesce(max(1, n_asked // each)), each, 1.0)
    # index blocks are dealt to groups of tasks; if there are few, each goes to several tasks, which share the queries
    index = index.select(F.pmod(F.hash("name"), F.lit(groups)).alias("g"), F.col("name").alias("index_name"), "dims", F.col("payload").alias("index_payload"))
    holding = [r[0] for r in index.select("g").distinct().collect()]  # as many as groups at most
    shares = max(1, min(groups // max(1, len(holding)), -(-n_asked // each)))
    index = index.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    asked = asked.select(F.explode(F.lit(holding or [0]).cast("array<int>")).alias("g"), "dims", F.pmod(F.hash("name"), F.lit(shares)).alias("q"), F.col("payload").alias("query_payload"))
    # a merge join gives all query blocks of an index block in a row, and spills if they are many
    pairs = index.join(asked.hint("merge"), ["g", "q", "dims"])
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("query", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]
        for batch in batches:
            for name, blob, queries in zip(*(batch.column(i) for i in range(3)), strict=True):
                if last[0] != (name := name.as_py()):
                    last[:] = [name, Index(*_unpacked(blob.as_py()))]
                part: Index = last[1]
                out: tuple[list, list, list, list] = ([], [], [], [])
                for query_id, query in zip(*_unpacked(queries.as_py()), strict=True):
                    at = part.top(query, k, int(query_id))
                    out[0].extend([query_id] * len(at))
                    out[1].extend([int.from_bytes(hashlib.md5(query.tobytes()).digest()[:8], "little", signed=True)] * len(at))
                    out[2].extend(part.ids[at])
                    out[3].extend(part.values[at] @ query)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in out], names=schema.names)

    found = pairs.select("index_name", "index_payload", "query_payload").mapInArrow(run, schema)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def by_brute_force(rows: list[tuple[int, list[float]]], queries: list[int], k: int, scale: float = 256.0) -> list[tuple[int, int, int, int]]:
    import math

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in kept:
        if q in queries:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in kept if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)
