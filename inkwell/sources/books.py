"""Books in and out: files of a folder as rows, and rows as container files (for fixtures and for writing)."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOOK_FILES = "*.{azw3,mobi,azw,kf8}"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a local master may do without one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + os.path.join(tempfile.gettempdir(), "inkwell-checkpoints")
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def read_books(spark: SparkSession, path: str, *, any_file: bool = False, most_bytes: int | None = None) -> DataFrame:
    """One row per file: ``path``, ``modificationTime``, ``length``, ``content``.

    Filters on length and time, and a projection without ``content``, reach the scan.  The name is not proof of a book:
    the magic of the content is.  ``most_bytes`` leaves larger files out before they are read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if not any_file:
        reader = reader.option("pathGlobFilter", BOOK_FILES)
    books = reader.load(path)
    return books.where(F.col("length") <= most_bytes) if most_bytes is not None else books


def number_bytes(value: Column | int, size: int) -> Column:
    """Big-endian bytes of a non-negative integer."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def zeros(n: int) -> Column:
    return F.lit(bytes(n))


def fixed_text(text: Column, size: int) -> Column:
    data = F.substr(F.encode(text, "utf-8"), F.lit(1), F.lit(size))
    return F.substr(F.concat(data, zeros(size)), F.lit(1), F.lit(size))


def exth_block(entries: list[tuple[int, Column]]) -> Column:
    """An EXTH block of (tag, payload) entries, as they come; a null payload is left out."""
    made = [F.when(p.isNotNull(), F.concat(number_bytes(tag, 4), number_bytes(F.octet_length(p) + 8, 4), p)) for tag, p in entries]
    there = F.filter(F.array(*made), lambda x: x.isNotNull())
    body = F.unhex(F.array_join(F.transform(there, lambda x: F.hex(x)), ""))
    return F.concat(F.lit(b"EXTH"), number_bytes(F.octet_length(body) + 12, 4), number_bytes(F.size(there), 4), body)


def record0(
    *, compression: Column | int = 1, text_length: Column | int = 0, records: Column | int = 0, encryption: Column | int = 0, encoding: Column | int = 65001,
    first_image: Column | int = 0, kf8: Column | int = 0, exth: Column | None = None,
) -> Column:
    """Record 0: the two headers in 248 bytes, and an EXTH block after them."""
    head = [
        number_bytes(compression, 2), zeros(2), number_bytes(text_length, 4), number_bytes(records, 2), number_bytes(4096, 2), number_bytes(encryption, 2), zeros(2),
        F.lit(b"MOBI"), number_bytes(232, 4), number_bytes(2, 4), number_bytes(encoding, 4), zeros(52), number_bytes(first_image, 4), zeros(8),
        number_bytes(232 if exth is not None else 0, 4), zeros(144), number_bytes(kf8, 4),
    ]
    return F.concat(*head, *([exth] if exth is not None else []))


def packed(name: Column, records: Column) -> Column:
    """The container file of an array of binary records."""
    n = F.size(records)
    sizes = F.transform(records, lambda r: F.octet_length(r).cast("long"))
    start = (F.lit(78) + 8 * n).cast("long")
    offsets = F.aggregate(sizes, F.array(start), lambda out, s: F.concat(out, F.array(F.element_at(out, -1) + s)))
    entries = F.transform(F.slice(offsets, 1, n), lambda o: F.concat(F.hex(number_bytes(o, 4)), F.lit("00000000")))
    table = F.unhex(F.array_join(entries, ""))
    data = F.unhex(F.array_join(F.transform(records, lambda r: F.hex(r)), ""))
    return F.concat(fixed_text(name, 32), zeros(28), F.lit(b"BOOKMOBI"), zeros(8), number_bytes(n, 2), table, data)


def chunked(data: Column, size: int = 4096) -> Column:
    """A binary cut into pieces of ``size`` bytes."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(data, i * size + 1, F.lit(size)))
