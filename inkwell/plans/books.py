"""The book pipeline: containers to headers, metadata, text, images, chapters and pages.

Everything stays on a book's row until a published table is exploded from it, so no step shuffles and none joins: a book's
cover and pictures are looked up in its row.  Headers, records, images and metadata fields are built-in expressions; text
decoding and HTML run in Arrow UDFs, which get the columns they read and no others.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import binary as B
from inkwell.functions import codecs, html
from inkwell.functions import strings as S

RAW, PALMDOC, HUFFMAN = 1, 2, 17480
#: EXTH tags of the fields that a book has.
TAGS = {"title": 503, "author": 100, "publisher": 101, "description": 103, "isbn": 104, "asin": 113, "language": 524}
COVER_TAG, UPDATED_TAG = 201, 551
#: Books handed to a Python function at once; contents are large, so few.
BOOKS_AT_ONCE = 8

EXTH = "array<struct<ord:int,tag:bigint,length:bigint,raw:binary>>"
CHAPTERS = "array<struct<idx:int,title:string,anchor:string,html_content:string>>"


def held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once, however often it is used.

    A generator of one row keeps the optimizer from putting the expression in the place of every use, which would let the
    plan grow with the product of the uses of each step.
    """
    return rows.select(*[F.col(c) for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def parsed(raw: DataFrame, *, path_col: str = "path", content_col: str = "content", strict: bool = False) -> DataFrame:
    """``path``, ``name``, ``db_type``, ``records`` (with data), ``header``, ``image_start``, ``status``, ``error`` of every container.

    Broken and refused files keep their row with a status other than OK and without records; ``strict`` raises instead.
    """
    books = held(raw.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")), "content", F.coalesce("content", F.lit(b"")))
    none = F.array().cast("array<struct<idx:int,offset:bigint,end_offset:bigint,attributes:bigint>>")
    books = held(books, "entries", F.when(F.octet_length("content") >= B.HEADER_BYTES, B.record_entries(F.col("content"))).otherwise(none))
    books = held(books, "record0", F.when(F.size("entries") > 0, B.record_data(F.col("content"), F.get("entries", F.lit(0)))))
    books = held(books, "header", B.mobi_header(F.col("record0")))
    books = held(books, "image_start", B.image_start(F.col("header")["first_image"], F.size("entries")))
    books = held(books, "db_type", B.ascii_text(B.database_type(F.col("content"))))
    status = (
        F.when(F.octet_length("content") < B.HEADER_BYTES, "TOO_SMALL")
        .when(B.database_type(F.col("content")) != F.lit(B.MAGIC), "NOT_BOOKMOBI")
        .when(F.size("entries") == 0, "NO_RECORDS")
        .when(F.octet_length("record0") < 32, "CORRUPT")
        .when(F.col("header.encryption") != 0, "ENCRYPTED")
        .when(~F.col("header.compression").isin(RAW, PALMDOC, HUFFMAN), "UNSUPPORTED_COMPRESSION")
        .otherwise("OK")
    )
    messages = {
        "TOO_SMALL": "shorter than a container header", "NOT_BOOKMOBI": "not a BOOKMOBI container", "NO_RECORDS": "no records", "CORRUPT": "record 0 is too short",
        "ENCRYPTED": "encrypted books are not read", "UNSUPPORTED_COMPRESSION": "unknown compression",
    }
    books = held(books, "status", status).withColumn("error", F.create_map(*[F.lit(x) for kv in messages.items() for x in kv])[F.col("status")])
    if strict:
        books = books.withColumn("status", F.when(F.col("status") == "OK", F.col("status")).otherwise(F.raise_error(F.concat_ws(": ", "path", "error"))))
    records = F.transform("entries", lambda e: F.struct(e["idx"].alias("idx"), e["offset"].alias("offset"), e["end_offset"].alias("end_offset"), e["attributes"].alias("attributes"), B.record_data(F.col("content"), e).alias("data")))
    good = F.col("status") == "OK"
    no_records = F.array().cast("array<struct<idx:int,offset:bigint,end_offset:bigint,attributes:bigint,data:binary>>")
    books = held(books, "records", F.when(good, records).otherwise(no_records))
    return books.select(
        "path", B.ascii_text(B.bytes_at(F.col("content"), 0, B.NAME_BYTES)).alias("name"), "db_type",
        "records", "header", "image_start", "status", "error",
    )


def record_table(books: DataFrame) -> DataFrame:
    return books.select("path", F.explode("records").alias("r")).select("path", "r.*")


def _per_book(one: Callable[..., object], schema: str, *columns: Column) -> Column:
    """A function of one book's values as a column.  Spark bounds the bytes of a batch; results go back a few books at a time."""
    kind = T._parse_datatype_string(schema)
    arrow = _arrow(kind)

    def run(*values: pa.Array) -> pa.Array:
        parts = [pa.array([one(*v) for v in zip(*(x.slice(at, BOOKS_AT_ONCE).to_pylist() for x in values), strict=True)], arrow) for at in range(0, len(values[0]), BOOKS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return F.arrow_udf(run, kind)(*columns)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    return {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64()}[kind.simpleString()]


def with_exth(books: DataFrame) -> DataFrame:
    """The books with ``exth``: the metadata entries, in order.  Only record 0 goes to Python."""

    def one(record0: bytes | None, at: int | None) -> list[dict]:
        return [{"ord": i, "tag": t, "length": n, "raw": raw} for i, (t, n, raw) in enumerate(codecs.exth_records(record0 or b"", at or 0))]

    return held(books, "exth", _per_book(one, EXTH, F.get("records", F.lit(0))["data"], F.col("header.exth_at")))


def last_of(exth: Column, tag: int) -> Column:
    """The payload of the last entry with a tag; null without one."""
    return F.try_element_at(F.filter(exth, lambda x: x["tag"] == tag), F.lit(-1))["raw"]


def _info_fields() -> list[Column]:
    entries = F.col("exth")
    fields = [F.coalesce(B.utf8_text(last_of(entries, tag)), F.lit("")).alias(name) for name, tag in TAGS.items()]
    dates = F.transform(F.filter(entries, lambda x: x["tag"] == UPDATED_TAG), lambda x: F.try_to_timestamp(B.utf8_text(x["raw"])))
    updated = F.try_element_at(F.filter(dates, lambda d: d.isNotNull()), F.lit(-1))
    return [*fields, cover_index(entries).alias("cover_index"), updated.alias("updated_at")]


def cover_index(exth: Column) -> Column:
    """The record number in the last entry of the cover, -1 without one or if it has under four bytes."""
    cover = B.big_endian(last_of(exth, COVER_TAG), 0, 4)
    return F.coalesce(F.when(cover >= 1 << 31, cover - (1 << 32)).otherwise(cover), F.lit(-1)).cast("int")


def book_info(exth: DataFrame, *, strict: bool = False) -> DataFrame:
    """One row per book: text fields (empty if missing), ``cover_index`` (-1), ``updated_at`` (last date that reads, or null),
    ``error``.

    A cover entry of under four bytes is no number: ``error`` says so, and ``strict`` raises.
    """
    raw = last_of(F.col("exth"), COVER_TAG)
    error = F.when(raw.isNotNull() & (F.octet_length(raw) < 4), F.lit("the cover entry is too short for a number"))
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(F.concat_ws(": ", "path", error)).cast("string"))
    return exth.select("path", *_info_fields(), error.alias("error"))


def image_list() -> Column:
    """The images of a book's row: (idx, mime, data), by record number.

    Huffman books: every record that begins like an image; others: every record from the first image on, of four bytes or
    more.
    """
    mine = F.when(
        F.col("header.compression") == HUFFMAN, F.filter("records", lambda r: B.is_image(r["data"]))
    ).otherwise(F.filter("records", lambda r: (r["idx"] >= F.col("image_start")) & (F.octet_length(r["data"]) >= 4)))
    return F.transform(mine, lambda r: F.struct(r["idx"].alias("idx"), B.image_mime(r["data"]).alias("mime"), r["data"].alias("data")))


def images(books: DataFrame) -> DataFrame:
    """``path``, ``record_idx``, ``mime``, ``data``."""
    return books.select("path", F.explode(image_list()).alias("i")).select("path", F.col("i.idx").alias("record_idx"), "i.mime", "i.data")


def covers(exth: DataFrame) -> DataFrame:
    """Books with their metadata and ``cover_url``: the data URI of the image whose record number is the cover's; empty without one."""
    rows = exth.select("path", *_info_fields(), image_list().alias("pictures"))
    mine = F.get(F.filter("pictures", lambda x: x["idx"] == F.col("cover_index")), F.lit(0))
    return rows.withColumn("cover_url", F.coalesce(B.data_uri(mine["mime"], mine["data"]), F.lit(""))).drop("pictures")


TEXT = "struct<html:string,decoder:string,charset:string,n_bytes:bigint>"


def texts(books: DataFrame, *, repair: bool = True, pictures: bool = False) -> DataFrame:
    """``path``, ``html``, ``decoder``, ``charset``, ``n_bytes`` (of the decoded records) of every readable book.

    With ``pictures`` the images go with it, for ``inlined``.
    """

    def one(records: list[bytes], compression: int, encoding: int, start: int) -> dict:
        if compression == RAW:
            data, decoder = b"".join(records[:start]), "raw"
        elif compression == PALMDOC:
            data, decoder = codecs.lz77([records[0][codecs.text_start(records[0]) :], *records[1:start]]), "palmdoc"
        else:
            data, decoder = codecs.mixed_text(records)
        text, charset = codecs.decoded_text(data, encoding, repair)
        return {"html": codecs.cleaned(text), "decoder": decoder, "charset": charset, "n_bytes": len(data)}

    read = _per_book(one, TEXT, F.transform("records", lambda r: r["data"]), F.col("header.compression"), F.col("header.text_encoding"), F.col("image_start"))
    more = [image_list().alias("pictures")] if pictures else []
    return books.where("status = 'OK'").select("path", read.alias("t"), *more).select("path", "t.*", *(["pictures"] if pictures else []))


def chaptered(found: DataFrame, *, least_pages: int = 2) -> DataFrame:
    """``found`` with ``html`` (with ids for made-up anchors), ``chapters``, ``strategy``; blank books have no chapters.

    Page breaks give the chapters if there are ``least_pages`` pages or more between them.
    """

    def one(source: str | None) -> dict:
        source = source or ""
        if not source.strip(html.WHITE):
            return {"html": source, "chapters": [], "strategy": "blank"}
        parts, strategy = html.chapters(source, least_pages)
        rows = [{"idx": c.idx, "title": c.title, "anchor": c.anchor, "html_content": c.html_content} for c in parts]
        return {"html": html.with_anchor_ids(source, parts), "chapters": rows, "strategy": strategy}

    others = [F.col(c) for c in found.columns if c not in ("html", "chapters", "strategy")]
    return found.select(*others, _per_book(one, f"struct<html:string,chapters:{CHAPTERS},strategy:string>", F.col("html")).alias("c")).select(*others, "c.*")


def chapter_table(found: DataFrame) -> DataFrame:
    return found.select("path", "strategy", F.explode("chapters").alias("c")).select("path", "strategy", "c.*")


def chapter_at(found: DataFrame, idx: Column) -> DataFrame:
    """``path`` and the chapter with a number (from 0); none where the book has no such chapter."""
    one = found.select("path", F.get("chapters", idx).alias("c"))
    return one.where(F.col("c").isNotNull()).select("path", "c.*")


def inlined(found: DataFrame) -> DataFrame:
    """``found`` without ``pictures``, image references in ``html`` replaced by them; references to others stay."""

    def one(source: str | None, pictures: list[dict] | None) -> str:
        mine = {x["idx"]: (x["mime"], base64.b64encode(x["data"]).decode()) for x in pictures or []}
        return html.with_images(source or "", mine).replace("\0", "")

    return found.select(*[_per_book(one, "string", F.col("html"), F.col("pictures")).alias("html") if c == "html" else F.col(c) for c in found.columns if c != "pictures"])


#: Label, background, text and link colour of each theme.
THEMES = [
    ("默认", "#ffffff", "#000000", "#0066cc"),
    ("灰色", "#e0e0e0", "#222222", "#4488cc"),
    ("羊皮纸", "#f1e8d0", "#5b4636", "#008b8b"),
    ("草绿", "#d7dbbd", "#232c16", "#177b4d"),
    ("樱桃", "#f0d1d5", "#4e1609", "#de3838"),
    ("天空", "#cedef5", "#262d48", "#2d53e5"),
    ("Solarized", "#fdf6e3", "#586e75", "#268bd2"),
    ("Gruvbox", "#fbf1c7", "#3c3836", "#076678"),
    ("Nord", "#eceff4", "#2e3440", "#5e81ac"),
    ("夜间", "#222222", "#e0e0e0", "#77bbee"),
]


#: The style of a page, by element; the theme's colours, font size and line height come on top.
STYLES = [
    ("body", "padding: 15px 20px 30px 20px; max-width: 780px; margin: 0 auto; font-family: 'Georgia', 'Songti SC', 'Noto Serif SC', 'Source Han Serif SC', serif; word-wrap: break-word; overflow-wrap: break-word; -webkit-font-smoothing: antialiased"),
    ("p", "margin: 0.3em 0; text-indent: 2em; text-align: justify"),
    ("h1, h2, h3, h4", "margin: 0.8em 0 0.3em 0; font-weight: bold; text-indent: 0"),
    ("img", "max-width: 100% !important; height: auto !important; display: block; margin: 1em auto; background-color: transparent"),
    ("a", "text-decoration: none"),
    ("blockquote", "margin: 0.5em 0; padding: 0.5em 1em; border-left: 3px solid rgba(0,0,0,.1); background-color: rgba(0,0,0,.02)"),
    ("code, pre", "font-family: 'Consolas', 'Courier New', monospace; font-size: 0.9em"),
]


def css(theme: int = 0, font_size: int = 18, line_height: float = 1.6) -> str:
    _, background, color, link = THEMES[theme]
    chosen = {"body": f"background-color: {background}; color: {color}; font-size: {font_size}px; line-height: {line_height}; ", "a": f"color: {link}; "}
    return "\n".join(f"{element} {{{chosen.get(element, '')}{style}}}" for element, style in STYLES)


def anchors_json(chapters: Column) -> Column:
    """The chapters' anchors without leading ``#``, as a JSON array."""
    return F.to_json(F.transform(chapters, lambda c: F.regexp_replace(c["anchor"], "^#+", "")))


#: Seconds after which a page scrolls, in thousandths.
SCROLL_AFTER = 100


def pages(found: DataFrame, current: Column | None = None, style: str | None = None) -> DataFrame:
    """``path``, ``page``: the whole book as one HTML page that scrolls to the current chapter (from 0, clamped)."""
    at = S.clamped(current if current is not None else F.lit(0), F.size("chapters"))
    parts = [
        F.lit("<!DOCTYPE html>\n<html><head><meta charset='utf-8'/><meta name='viewport' content='width=device-width, initial-scale=1.0'/>"),
        F.lit(f"<style>{style or css()}</style></head><body>\n"), F.col("html"), F.lit("\n<script>setTimeout(() => {const a = "), anchors_json(F.col("chapters")),
        F.lit(", t = a["), at.cast("string"), F.lit("], e = t && (document.getElementById(t) || document.getElementsByName(t)[0]); "),
        F.lit(f"if (e) e.scrollIntoView({{behavior: 'instant', block: 'start'}});}}, {SCROLL_AFTER});</script>\n</body></html>"),
    ]
    return found.select("path", F.concat(*parts).alias("page"))
