"""Token ids in files compressed by a Re-Pair grammar.

Documents are dealt to shards by ranges of their id and sorted; each shard is a run of blocks.  Within a block, the most
frequent pairs of neighbouring symbols are replaced by new nonterminals, round after round, never across the end of a
document.  A block is one self-contained record:

    magic "RPG1" | u32 documents, ids, symbols, rules, terminals, width | i32 rules left, right | i32 expansion lengths
    | u32 symbols before each document (documents + 1 entries) | symbols, ``width`` bytes each (2 or 4)

all little-endian.  Any document, or any run of ids, is decoded from its symbols alone.  Blocks are written by Spark's
own writer (one binary column of a Parquet folder), so the files may lie in any store that Spark reaches.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.bpe import gathered, of_worker, shipped
from inkwell.llm.text import chunks, quoted, shared_dir

MAGIC = b"RPG1"
#: Ids of a block (about), pairs replaced in a round at most, and least uses of a pair.
BLOCK_IDS, ROUND_PAIRS, LEAST_USES = 1 << 20, 2048, 8


class Grammar:
    """Rules terminal-first: nonterminal ``terminals + i`` stands for (left[i], right[i])."""

    def __init__(self, terminals: int, left: np.ndarray, right: np.ndarray, length: np.ndarray | None = None) -> None:
        self.terminals, self.left, self.right = terminals, left, right
        if length is None:
            length = np.ones(len(left), np.int32)
            for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
                length[i] = sum(1 if x < terminals else length[x - terminals] for x in (a, b))
        self.length = length
        self._table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The expansions of all symbols in a row, with begin and size of each symbol's."""
        if self._table is None:
            v = self.terminals
            size = np.concatenate([np.ones(v, np.int64), self.length.astype(np.int64)])
            begin = np.cumsum(size) - size
            flat = np.empty(int(size.sum()), np.int32)
            flat[:v] = np.arange(v)
            for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)):
                at, n = begin[v + i], size[a]
                flat[at : at + n] = flat[begin[a] : begin[a] + n]
                flat[at + n : at + n + size[b]] = flat[begin[b] : begin[b] + size[b]]
            self._table = flat, begin, size
        return self._table

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begin, size = self.table()
        return flat[gathered(begin[symbols], size[symbols])]


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """Grammar, symbols, and the symbols before each document (with the total); ``ends`` are the documents' ends in ``ids``.

    Rounds go on until no pair has LEAST_USES or the symbols are used up.  While two bytes can hold them, there are at most
    65,536 symbols in all.
    """
    seq = ids.astype(np.uint32)
    final = np.zeros(len(seq) + 1, bool)  # the last symbol of a document; one more entry for "none"
    final[ends[ends > 0] - 1] = True
    final = final[:-1]
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    symbols, room = terminals, (1 << 16) - terminals if terminals < 1 << 16 else 1 << 20
    while len(seq) > 1 and room > 0:
        wide = symbols > 1 << 16
        key = (seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]) if wide else (seq[:-1] << np.uint32(16) | seq[1:])
        free = ~final[:-1]
        ordered = np.sort(key[free])
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
        uses = np.diff(np.append(edge, len(ordered)))
        often = np.flatnonzero(uses >= LEAST_USES)
        if not len(often):
            break
        most = min(ROUND_PAIRS, room)
        if len(often) > most:
            often = often[np.argsort(-uses[often], kind="stable")[:most]]
        pairs = ordered[edge[often]]
        # a table by hash turns pairs into nonterminals; of pairs in the same place the more frequent one stays
        bits = 18
        slot = _slots(pairs, bits)
        _, keep = np.unique(slot, return_index=True)
        keep.sort()
        pairs, slot = pairs[keep], slot[keep]
        holds, stands = np.zeros(1 << bits, key.dtype), np.zeros(1 << bits, np.uint32)
        taken = np.zeros(1 << bits, bool)
        holds[slot], stands[slot], taken[slot] = pairs, symbols + np.arange(len(pairs)), True
        at = _slots(key, bits)
        hit = np.flatnonzero((holds[at] == key) & taken[at] & free)
        # in a run of overlapping pairs every second one is replaced
        run = np.concatenate([[True], hit[1:] != hit[:-1] + 1]) if len(hit) else np.empty(0, bool)
        began = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - began) % 2 == 0]
        new = stands[at[hit]]
        # rules that no place uses after all are left out
        used, new = np.unique(new, return_inverse=True)
        chosen = pairs[used - symbols]
        shift, mask = (np.uint64(32), np.uint64((1 << 32) - 1)) if wide else (np.uint32(16), np.uint32(0xFFFF))
        left.append((chosen >> shift).astype(np.int32))
        right.append((chosen & mask).astype(np.int32))
        seq[hit] = symbols + new
        final[hit] = final[hit + 1]
        stay = np.ones(len(seq), bool)
        stay[hit + 1] = False
        seq, final = seq[stay], final[stay]
        symbols += len(used)
        room -= len(used)
    none = np.empty(0, np.int32)
    grammar = Grammar(terminals, np.concatenate([none, *left]), np.concatenate([none, *right]))
    # an empty document ends where the one before it does
    full = np.diff(np.concatenate([[0], ends])) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    last = np.concatenate([[0], np.flatnonzero(final) + 1])
    return grammar, seq, last[before]


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    if key.dtype == np.uint32:
        return (key * np.uint32(2654435761)) >> np.uint32(32 - bits)
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def packed(ids: np.ndarray, ends: np.ndarray, terminals: int) -> bytes:
    grammar, seq, before = compress(ids, ends, terminals)
    width = 2 if terminals + len(grammar.left) <= 1 << 16 else 4
    head = MAGIC + struct.pack("<6I", len(ends), len(ids), len(seq), len(grammar.left), terminals, width)
    body = [grammar.left.astype("<i4"), grammar.right.astype("<i4"), grammar.length.astype("<i4"), before.astype("<u4"), seq.astype(f"<u{width}")]
    return head + b"".join(x.tobytes() for x in body)


class Block:
    """A block read back: all ids, the ids of one document, or a run of ids, each without decoding anything else."""

    def __init__(self, blob: bytes) -> None:
        if blob[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        self.documents, self.ids, n, rules, terminals, width = struct.unpack_from("<6I", blob, 4)
        at, parts = 28, []
        for kind, size in (("<i4", rules), ("<i4", rules), ("<i4", rules), ("<u4", self.documents + 1), (f"<u{width}", n)):
            parts.append(np.frombuffer(blob, kind, size, at))
            at += parts[-1].nbytes
        self.grammar = Grammar(terminals, *parts[:3])
        self.before, self.symbols = parts[3].astype(np.int64), parts[4]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents in a row, and the ids before each document (with the total)."""
        size = self.grammar.table()[2][self.symbols]
        return self.grammar.expand(self.symbols), np.concatenate([[0], np.cumsum(size)])[self.before]

    def document(self, i: int) -> np.ndarray:
        return self.grammar.expand(self.symbols[self.before[i] : self.before[i + 1]])

    def run(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the block: the symbols that cover them by their expansion lengths, then the ends cut off."""
        ends = np.cumsum(self.grammar.table()[2][self.symbols])
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        first = int(ends[a - 1]) if a else 0
        return self.grammar.expand(self.symbols[a:b])[start - first : stop - first]


BLOCK_SCHEMA = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_ids", T.LongType()),
    T.StructField("ids_before", T.LongType()),  # in the shard
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()),
])


def write(
    docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, shards: int | None = None, block_ids: int = BLOCK_IDS,
    special_as_text: bool = False,
) -> None:
    """Encode every whole text (null: empty), append ``end_id`` to each document, and write blocks in ascending id order.

    One shuffle, of the texts, to ranges of the id; the ranges come from approximate quantiles of the id column alone.
    Null ids come first; rows that share an id are ordered by a hash of their text; an empty table writes no blocks.
    """
    spark = docs.sparkSession
    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col(quoted(id_col)).cast("long").alias("i"))
    bounds = (ids.agg(F.percentile_approx("i", [k / n for k in range(1, n)], 10_000)).first()[0] or []) if n > 1 else []
    bounds = sorted(set(bounds))
    config = shipped(spark, tokenizer_path)
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("i"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("t"))
    shard = F.when(F.col("i").isNull(), 0).otherwise(_number_below(F.col("i"), bounds))
    dealt = rows.withColumn("s", shard.cast("int")).repartitionById(n, F.col("s")).sortWithinPartitions("s", F.col("i").asc_nulls_first(), F.xxhash64("t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = of_worker(config.value, special_as_text)
        terminals = bpe.tokenizer.get_vocab_size()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        at: list[int] = [-1, 0, 0]  # shard, block, ids before it

        def block() -> pa.RecordBatch:
            doc_ids = [i for x in held for i in x[0]]
            values, counts = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            held.clear()
            row = [[at[0]], [at[1]], [len(values)], [at[2]], [doc_ids], [packed(values, np.cumsum(counts), terminals)]]
            at[1:] = at[1] + 1, at[2] + len(values)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=BLOCK_SCHEMA.names)

        for batch in batches:
            for part, texts in chunks(batch, "t"):
                shard_of = part.column(2).to_numpy(zero_copy_only=False)
                doc_ids = part.column(0).to_pylist()
                values, counts = bpe.encode(texts)
                if end_id is not None:
                    values, counts = np.insert(values, np.cumsum(counts), end_id), counts + 1
                cut = np.concatenate([[0], np.cumsum(counts)])
                # a shard, and so a block, never holds rows of two ranges
                edges = [0, *(np.flatnonzero(shard_of[1:] != shard_of[:-1]) + 1).tolist(), len(doc_ids)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if shard_of[a] != at[0]:
                        if held:
                            yield block()
                        at[:] = [int(shard_of[a]), 0, 0]
                    held.append((doc_ids[a:b], values[cut[a] : cut[b]], counts[a:b]))
                    if sum(len(x[1]) for x in held) >= block_ids:
                        yield block()
        if held:
            yield block()

    dealt.mapInArrow(encode, BLOCK_SCHEMA).write.parquet(path)


def _number_below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below the value: first among every k-th, then within one run of k."""
    if not bounds:
        return F.lit(0)
    k = math.isqrt(len(bounds)) + 1
    below = lambda array: F.size(F.filter(array, lambda b: b < value))
    runs = below(F.lit(bounds[k - 1 :: k]).cast("array<bigint>"))
    return runs * k + below(F.slice(F.lit(bounds).cast("array<bigint>"), runs * k + 1, F.lit(k)))


def read(spark: SparkSession, path: str, end_id: int | None = 0) -> DataFrame:
    """Per document, decoded from the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    A row for every row written, repeated ones included; ``doc_id`` is null where it was.  A block knows the ids before it in its shard, so only the shards' totals are summed up; the payloads stay where they are.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    offsets, total = {}, 0
    for shard, n in sorted(blocks.groupBy("shard").agg(F.sum("n_ids")).collect()):  # one row per shard
        offsets[shard], total = total, total + n
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, s, doc_ids, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, before = Block(payload).all()
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(before[:-1] + s + offsets[shard], pa.int64()), pa.array(np.diff(before), pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("shard", "ids_before", "doc_ids", "payload").mapInArrow(decode, schema)


def store_path(spark: SparkSession) -> str:
    return shared_dir(spark, "token-ids")
