"""Column expressions over binary containers: big-endian integers, fixed fields, record tables.  No Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the container layout.
HEADER_BYTES, ENTRY_BYTES = 78, 8
NAME_BYTES, TYPE_AT, CREATOR_AT, COUNT_AT = 32, 60, 64, 76
MAGIC = b"BOOKMOBI"
LEAST_RECORD0 = 20


def big_endian(data: Column, offset: Column | int, size: int) -> Column:
    """The unsigned integer of ``size`` bytes at ``offset`` (from 0) as a long; null where the bytes are not all there."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    part = F.substr(data, offset + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def bytes_at(data: Column, offset: Column | int, size: Column | int) -> Column:
    offset, size = (F.lit(x) if isinstance(x, int) else x for x in (offset, size))
    return F.substr(data, offset + 1, size)


def ascii_text(data: Column) -> Column:
    """Fixed-width text without trailing NULs; bytes beyond ASCII become question marks."""
    text = F.decode(data, "iso-8859-1")
    return F.regexp_replace(F.regexp_replace(text, "[^\\x00-\\x7F]", "?"), "\\x00+$", "")


def utf8_text(data: Column) -> Column:
    """UTF-8 with replacement characters, without trailing NULs."""
    return F.regexp_replace(F.call_function("make_valid_utf8", data.cast("string")), "\\x00+$", "")


def database_type(content: Column) -> Column:
    return F.concat(bytes_at(content, TYPE_AT, 4), bytes_at(content, CREATOR_AT, 4))


def record_entries(content: Column) -> Column:
    """array<struct<idx, offset, end_offset, attributes>>: the table of records, as far as the file goes.

    A record ends where the next one begins, the last one at the end of the file.
    """
    size = F.octet_length(content)
    there = F.floor((size - HEADER_BYTES) / ENTRY_BYTES).cast("int")
    count = F.greatest(F.lit(0), F.least(F.coalesce(big_endian(content, COUNT_AT, 2), F.lit(0)).cast("int"), there))
    at = lambda i: F.lit(HEADER_BYTES) + i * ENTRY_BYTES
    numbers = F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count)
    return F.transform(
        numbers,
        lambda i: F.struct(
            i.alias("idx"),
            big_endian(content, at(i), 4).alias("offset"),
            F.when(i + 1 < count, big_endian(content, at(i + 1), 4)).otherwise(size.cast("long")).alias("end_offset"),
            big_endian(content, at(i) + 4, 4).alias("attributes"),
        ),
    )


def record_data(content: Column, entry: Column) -> Column:
    """The bytes of a record; empty if its end lies before its start or beyond the file.

    Lengths are 32-bit with wrap-around, so ends before starts give a negative number.
    """
    gap = F.pmod(entry["end_offset"] - entry["offset"], F.lit(1 << 32))
    length = F.when(gap >= 1 << 31, gap - (1 << 32)).otherwise(gap)
    fits = (length > 0) & (entry["offset"] + length <= F.octet_length(content))
    return F.when(fits, F.substr(content, (entry["offset"] + 1).cast("int"), length.cast("int"))).otherwise(F.lit(b""))


def mobi_header(record0: Column) -> Column:
    """struct of the fields of record 0; fields beyond its end are 0, as is the start of the EXTH block if there is none.

    The encryption flag falls back on the high half of the text encoding, which is where the second flag is read.
    """
    size = F.octet_length(record0)
    field = lambda at, width, more=0: F.when(size > at + width * (more > 0) - (more == 0), F.coalesce(big_endian(record0, at, width), F.lit(0))).otherwise(0)
    encryption = field(12, 2)
    exth = field(96, 4, 1)
    return F.struct(
        field(0, 2).cast("int").alias("compression"),
        field(4, 4).alias("text_length"),
        field(8, 2).cast("int").alias("text_records"),
        field(10, 2).cast("int").alias("text_record_size"),
        F.when(encryption == 0, field(28, 2)).otherwise(encryption).cast("int").alias("encryption"),
        field(20, 4).alias("header_length"),
        field(24, 4).alias("mobi_type"),
        field(28, 4).alias("text_encoding"),
        field(84, 4, 1).alias("first_image"),
        F.when(exth > 0, exth + 16).otherwise(F.lit(0)).alias("exth_at"),
        field(244, 4, 1).alias("kf8_offset"),
    )


def image_start(first_image: Column, records: Column) -> Column:
    """First record that is no text: the header's, or none if that is 0, beyond the records or negative as 32 bits."""
    return F.when((first_image <= 0) | (first_image > records) | (first_image >= 1 << 31), records).otherwise(first_image).cast("int")


def starts_with(data: Column, prefix: bytes) -> Column:
    return F.coalesce(F.substr(data, F.lit(1), F.lit(len(prefix))) == F.lit(prefix), F.lit(False))


def is_image(data: Column) -> Column:
    """JPEG, PNG, GIF or BMP by the first bytes; at least four of them."""
    kinds = starts_with(data, b"\xff\xd8") | starts_with(data, b"\x89PNG") | starts_with(data, b"GIF") | starts_with(data, b"BM")
    return (F.octet_length(data) >= 4) & kinds


def is_probably_image(data: Column) -> Column:
    """The looser test by two bytes that the text decoders use to leave images out (no BMP)."""
    return (F.octet_length(data) >= 4) & (starts_with(data, b"\xff\xd8") | starts_with(data, b"\x89\x50") | starts_with(data, b"\x47\x49"))


def image_mime(data: Column) -> Column:
    size = F.octet_length(data)
    return (
        F.when(starts_with(data, b"\xff\xd8"), "image/jpeg")
        .when(starts_with(data, b"\x89PNG"), "image/png")
        .when((size >= 6) & starts_with(data, b"GIF"), "image/gif")
        .when(starts_with(data, b"RIFF"), "image/webp")
        .when((size >= 4) & starts_with(data, b"BM"), "image/bmp")
        .otherwise("image/jpeg")
    )


def data_uri(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), "[\\r\\n]", ""))


def joined_bytes(parts: Column) -> Column:
    """The binaries of an array in a row."""
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x)), ""))
