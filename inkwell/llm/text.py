"""Shared pieces of the training-data operators: bounded Arrow chunks, vectorised word hashing, folds and the shared folder.

Conventions that hold for every operator here:

* An operator reads the columns it is told to read and returns ``keep`` columns plus its own; an input column that has
  the name of a result column is replaced by the result.  Any other column, whatever its name, is left out or passed on
  untouched.
* A null text counts as empty unless the operator says otherwise; nulls in ``keep`` columns are passed on.
* Repeated rows are rows of their own: nothing is keyed by an id that might repeat unless the operator says so.
* Columns that an operator makes on its way are told apart from the input's by place, so no input column's name clashes.
* An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at once; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 18

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_WORD = np.array([c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)], dtype=np.uint8)
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Powers that outlive a task; a very long text needs more.
_KEPT_POWERS = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def kept_columns(df: DataFrame, keep: list[str], own: set[str]) -> tuple[list[str], list[Column], list[T.StructField]]:
    """The names of ``keep`` without those of results, and columns and fields for them under names that no function trips over."""
    names = [c for c in keep if c.lower() not in own]
    columns = [F.col(quoted(c)).alias(f"__k{i}") for i, c in enumerate(names)]
    fields = [T.StructField(f"__k{i}", f.dataType) for i, f in enumerate(df.select(*columns).schema)] if names else []
    return names, columns, fields


def learned_fold(id_col: Column) -> Column:
    """True for rows a model may learn from; the others (crc32 of the id as text divisible by 5) are held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 != 0


def share_bound(n: float, total: float) -> int | None:
    """The 64-bit hash that n of ``total`` values lie below on average; None if all of them do."""
    return None if n >= total else -(1 << 63) + int(int(n) * (1 << 64) // max(1, int(total)))


def sampled(df: DataFrame, n: int, *cols: Column) -> DataFrame:
    """The rows whose ``cols`` hash low, so low that about ``n`` different values of them do, whatever the table's size.

    A value is in the sample with all its rows or not at all.  The number of different values is Spark's estimate (within a
    few hundredths) from a sketch of fixed size, so a value that fills the table counts once.
    """
    total = df.select(F.approx_count_distinct(F.xxhash64(*cols), 0.02)).first()[0]
    return df.where(below(share_bound(n, total), *cols))


def below(bound: int | None, *cols: Column) -> Column:
    return F.lit(True) if bound is None else F.xxhash64(*cols) < F.lit(bound)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a folder of this machine; any other one is refused, as the executors would
    write to disks that no one else reads.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return _placed(top, spark.sparkContext.master, what)


def _placed(top: str | None, master: str, what: str) -> str:
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + os.path.join(tempfile.gettempdir(), "inkwell-checkpoints")
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str, at: str | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: lineage ends there and survives lost executors."""
    path = at or shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A join's key is dealt to several tasks if it has more rows than that and is among the HOT_KEYS keys of the most rows (so
#: any other has less than a HOT_KEYS-th of all rows), to as many tasks as HOT_KEYS at most.
HOT_ROWS, HOT_KEYS = 512, 1000


def hot_keys(left: DataFrame, key: str, counts: DataFrame | None = None, least: int = HOT_ROWS) -> list[tuple]:
    """The keys of ``left`` that are dealt out, at most HOT_KEYS, and the number of parts of each.

    ``counts`` has the rows of each key (``key``, ``__n``), which are counted else.
    """
    counts = counts if counts is not None else left.groupBy(key).agg(F.count("*").alias("__n"))
    rows = counts.where(F.col("__n") > least).select(key, "__n").orderBy(F.desc("__n"), key).limit(HOT_KEYS).collect()
    most = max([least, *(-(-r[1] // HOT_KEYS) for r in rows)])
    return [(r[0], -(-r[1] // most)) for r in rows if r[1] > most]


def dealt_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", *, counts: DataFrame | None = None, hot: list[tuple] | None = None,
    number: Column | None = None, least: int = HOT_ROWS,
) -> DataFrame:
    """``left.join(right, key, how)`` in which no key of ``left`` fills a task, however many rows it has.

    ``how`` is inner, left or left_semi.  The hot keys are those of ``hot_keys``, found by ``counts`` if there are such.
    ``number`` tells a key's rows apart, whenever a task is run again.  Without it ``left`` has to be read from files, where
    a row's place does.  Hot keys' rows are dealt out by number, and ``right``'s rows for them are there once for each part.
    """
    hot = hot if hot is not None else hot_keys(left, key, counts, least)
    if not hot:
        return left.join(right, key, how)
    few = F.broadcast(left.sparkSession.createDataFrame(hot, T.StructType([left.schema[key], T.StructField("__parts", T.IntegerType())])))
    parts = F.when(F.col(key).isNull(), 1000).otherwise(F.coalesce("__parts", F.lit(1)))  # null keys meet nothing
    numbered = left.withColumn("__row", F.monotonically_increasing_id() if number is None else number).join(few, key, "left")
    numbered = numbered.withColumn("__part", F.pmod(F.col("__row"), parts.cast("long")).cast("int")).drop("__row", "__parts")
    there = right.join(few, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return numbered.join(there, [key, "__part"], how).drop("__part")


class Bits:
    """A set of hashes as a bitmap of fixed size: ``found`` tells which hashes may be in it."""

    def __init__(self, bits: int, rows: list[tuple[int, bytes]]) -> None:
        self.bits = bits
        self.map = np.zeros(1 << (bits - 3), np.uint8)
        for bucket, part in rows:
            at = (bucket - 1) << 12
            self.map[at : at + len(part)] = np.frombuffer(part, np.uint8)

    def found(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        return (self.map[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def hash_bits(hashes: DataFrame, column: str, bits: int = 25) -> Bits:
    """The bitmap (4 MB for 25 bits, whatever the data) of a column of 64-bit hashes; parts of 4 KB are put together by executors."""
    place = F.shiftrightunsigned(F.col(column), 64 - bits) + 1  # those functions count from 1
    parts = hashes.where(F.col(column).isNotNull()).groupBy(F.call_function("bitmap_bucket_number", place).alias("bucket"))
    return Bits(bits, [(r[0], bytes(r[1])) for r in parts.agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", place)).alias("part")).collect()])


class Scratch:
    """Saved tables that go when the work that needs them is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def saved(self, df: DataFrame, what: str) -> DataFrame:
        self.paths.append(shared_dir(self.spark, what))
        return saved(df, what, self.paths[-1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Rows that a chunk has at most, so that arrays with a fixed size per text are bounded and a text's place fits 16 bits.
CHUNK_ROWS = 1 << 14


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batch of about ``most`` bytes of text and at most ``rows`` rows, each with its texts as bytes (null: empty)."""
    array = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pc.fill_null(pc.binary_length(array), 0), dtype=np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        before = int(ends[at - 1]) if at else 0
        upto = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
        part = batch.slice(at, upto - at)
        texts = part.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
        yield part, [t or b"" for t in texts]
        at = upto


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, before and after which freed memory goes back to the system: Python workers stay, idle, after a task, and drop
    an earlier task's broadcasts when the next one begins."""

    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            if len(_powers[0]) > _KEPT_POWERS:
                _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
            give_back()

    return to_the_end


def give_back() -> None:
    """Memory that is free goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other systems have none
    if trim:
        trim(0)


def give_back_heaps(spark: SparkSession) -> None:
    """Free memory of the executors' heaps goes back to the system.

    A heap keeps the size that earlier work's garbage gave it, and what runs next has its Python workers beside it.  One short
    task per core collects the garbage, after which Java shrinks the heap; an executor that is busy or comes later keeps its own.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc"))).collect()


def with_text(df: DataFrame, text_col: str, kept: list[str], columns: list[Column], own: list[T.StructField]) -> tuple[DataFrame, str]:
    """The kept columns with the text, and its name: if it is kept itself, it goes to Python once."""
    if text_col in kept and isinstance(own[kept.index(text_col)].dataType, T.StringType):
        return df.select(*columns), own[kept.index(text_col)].name
    return df.select(*columns, F.col(quoted(text_col)).cast("string").alias("__text")), "__text"


def map_texts(
    df: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField], make: Callable[[], Callable[[list[bytes]], list]], most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``fields`` to ``keep`` by a function of chunks of whole texts; ``make`` runs once in each Python worker task.

    The function returns one list or Arrow array per field.  Rows stay in place: no shuffle.
    """
    kept, columns, own = kept_columns(df, keep, {f.name.lower() for f in fields})
    source, text = with_text(df, text_col, kept, columns, own)
    schema = T.StructType(own + fields)
    types = [_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part, texts in chunks(batch, text, most, rows):
                made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(work(texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(own))] + made, names=names)

    return source.mapInArrow(tidied(run), schema).toDF(*kept, *[f.name for f in fields])


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind])
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    }[kind.simpleString()]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of each 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end): a polynomial over random byte values by prefix sums, then mixed."""
    power, inverse = _power_tables(len(raw))
    value = _BYTE_VALUE.take(raw)
    value *= power[: len(raw)]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mixed((total.take(end) - total.take(start)) * inverse.take(start))


class Words:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of some texts with A-Z lower-cased, hashed without a Python loop.

    ``buffer`` holds the lower-cased texts, ``start``/``end`` the words' byte places in it, ``doc`` the text that each
    word is in, ``hash`` its 64-bit hash (polynomial over random byte values, then mixed), ``first`` the number of words
    before each text (one more entry than texts).
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.buffer = (b"\x00" + b"\x00".join(texts) + b"\x00").translate(_LOWER)
        raw = np.frombuffer(self.buffer, np.uint8)
        inside = _IS_WORD[raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = span_hashes(raw, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i]]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words of one text, and the index of each one's first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += self.hash[j : j + n]
        return mixed(out[at]), at
