import pytest
from pyspark.sql import functions as F

from inkwell import queries
from inkwell.functions import binary as B
from inkwell.functions import strings as S
from inkwell.plans import books
from inkwell.sources import books as source


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_big_endian(spark):
    data = F.lit(b"\xff\xff\xff\xff\x01\x02")
    assert one(spark, B.big_endian(data, 0, 4)) == 4294967295
    assert one(spark, B.big_endian(data, 4, 2)) == 258
    assert one(spark, B.big_endian(data, 4, 4)) is None


def test_text_fields(spark):
    assert one(spark, B.ascii_text(F.lit(b"caf\xe9\0\0"))) == "caf?"
    assert one(spark, B.utf8_text(F.lit("é".encode() + b"\xff\0"))) == "é�"
    assert one(spark, B.data_uri(F.lit("image/png"), F.lit(bytes(90)))) == "data:image/png;base64," + "A" * 120


def test_strings(spark):
    assert one(spark, S.cleaned_html(F.lit("x\0<p>a\0</p>　 "))) == "<p>a</p>"
    assert one(spark, S.without_outer_tags(F.lit("<HTML><header>a</body> "))) == "a"
    assert one(spark, S.anchor_of(F.lit("a#b#c"))) == "#b#c"
    assert one(spark, S.anchor_of(F.lit("a"))) == ""
    assert one(spark, S.numbered_title(F.lit(0))) == "第 1 节"
    assert one(spark, S.clamped(F.lit(9), F.lit(3))) == 2
    assert one(spark, S.progress_label(F.lit(0), F.lit(3))) == "1 / 3"
    assert one(spark, S.scroll_fraction(F.lit(5.0), F.lit(10.0), F.lit(10.0))) == 0.0
    assert one(spark, S.page_chunks(F.lit("a<pagebreak/> <HR class=pagebreak>b"))) == ["a", "b"]
    assert one(spark, S.page_chunks(F.lit("a"))) == []


def container(records, name=b"n", kind=b"BOOKMOBI", offsets=None):
    at, table = 78 + 8 * len(records), b""
    for i, r in enumerate(records):
        table += (offsets[i] if offsets else at).to_bytes(4, "big") + bytes(4)
        at += len(r)
    return name.ljust(32, b"\0") + bytes(28) + kind + bytes(8) + len(records).to_bytes(2, "big") + table + b"".join(records)


def head(compression=1, encryption=0, encoding=65001, image=0, exth_at=0, kf8=0):
    out = bytearray(248)
    out[0:2], out[12:14] = compression.to_bytes(2, "big"), encryption.to_bytes(2, "big")
    out[16:20] = b"MOBI"
    for at, x in ((28, encoding), (84, image), (96, exth_at), (244, kf8)):
        out[at : at + 4] = x.to_bytes(4, "big")
    return bytes(out)


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content binary")


def test_statuses(spark):
    good = container([head(), b"<p>x</p>"])
    files = {
        "good": good, "null": None, "empty": b"", "short": good[:60], "type": container([head()], kind=b"TEXtREAd"), "none": container([]), "tiny": container([b"x" * 25]),
        "drm": container([head(encryption=2)]), "drm2": container([head(encoding=0x10000)]), "code": container([head(compression=3)]),
        "reversed": container([head(), b"abc", b"def"], offsets=[102, 352, 350]),
    }
    rows = {r.path: r for r in books.parsed(frame(spark, files)).collect()}
    assert {k: r.status for k, r in rows.items()} == {
        "good": "OK", "null": "TOO_SMALL", "empty": "TOO_SMALL", "short": "TOO_SMALL", "type": "NOT_BOOKMOBI", "none": "NO_RECORDS", "tiny": "CORRUPT",
        "drm": "ENCRYPTED", "drm2": "ENCRYPTED", "code": "UNSUPPORTED_COMPRESSION", "reversed": "OK",
    }
    assert [r.data for r in rows["good"].records] == [head(), b"<p>x</p>"]
    assert [r.data for r in rows["reversed"].records][1] == b""
    assert rows["drm"].error and rows["good"].error is None
    with pytest.raises(Exception, match="encrypted"):
        books.parsed(frame(spark, {"drm": files["drm"]}), strict=True).collect()


def test_raw_book_with_images_and_cover(spark):
    exth = b"EXTH" + bytes(4) + (2).to_bytes(4, "big") + (201).to_bytes(4, "big") + (12).to_bytes(4, "big") + (3).to_bytes(4, "big") + (503).to_bytes(4, "big") + (10).to_bytes(4, "big") + b"T\0"
    record0 = head(image=2, exth_at=232, kf8=1) + exth
    text = b"<h1>A</h1><img filepos='3'><img filepos='2'/>"
    found = books.parsed(frame(spark, {"b": container([record0, text, b"xyz", b"\x89PNGdata"])})).persist()
    info = books.covers(books.with_exth(found)).first()
    assert (info.title, info.cover_index, info.author, info.updated_at) == ("T", 3, "", None)
    assert info.cover_url.startswith("data:image/png;base64,")
    assert [(r.record_idx, r.mime) for r in books.images(found).collect()] == [(3, "image/png")]  # three bytes are no image
    read = books.chaptered(books.texts(found, pictures=True))
    row = books.inlined(read).first()
    assert "<img src='data:image/png" in row.html and "filepos='2'" in row.html
    assert [(c.title, c.anchor) for c in row.chapters] == [("A", "#__ch0")]
    page = books.pages(read, F.lit(7)).first().page
    assert 'a = ["__ch0"], t = a[0]' in page and '<h1 id="__ch0">A</h1>' in page
    assert [(r.idx, r.title) for r in books.chapter_at(read, F.lit(0)).collect()] == [(0, "A")] and books.chapter_at(read, F.lit(1)).count() == 0
    for rows in (books.covers(books.with_exth(found)), books.inlined(read)):
        plan = rows._jdf.queryExecution().toString()
        assert "Join" not in plan and "Exchange" not in plan


def test_files_of_a_folder(spark, tmp_path):
    for name in ("a.azw3", "b.mobi", "c.txt"):
        (tmp_path / name).write_bytes(container([head(), b"<p>x</p>"]))
    found = source.read_books(spark, str(tmp_path))
    assert found.count() == 2
    assert source.read_books(spark, str(tmp_path), any_file=True).count() == 3
    assert source.read_books(spark, str(tmp_path), most_bytes=10).count() == 0
    plan = found.where("length > 5").select("path", "length")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThan(length" in plan


def test_empty_tables(spark):
    none = books.parsed(spark.createDataFrame([], "path string, content binary"))
    assert none.count() == 0
    assert books.chapter_table(books.chaptered(books.texts(none))).count() == 0
    assert books.book_info(books.with_exth(none)).count() == 0


def test_short_cover_entry(spark):
    exth = b"EXTH" + bytes(4) + (1).to_bytes(4, "big") + (201).to_bytes(4, "big") + (10).to_bytes(4, "big") + b"ab"
    found = books.with_exth(books.parsed(frame(spark, {"b": container([head(exth_at=232) + exth, b"x"])})))
    row = books.book_info(found).first()
    assert row.cover_index == -1 and "too short" in row.error
    with pytest.raises(Exception, match="too short"):
        books.book_info(found, strict=True).collect()


def test_styles():
    assert books.css(2, 20, 1.8) == queries.PAGE_STYLE
    assert "background-color: #222222; color: #e0e0e0; font-size: 18px; line-height: 1.6; " in books.css(9)


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "yarn"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        source.shared_path(Session, "x")
    Session.sparkContext.master = "local[2]"
    assert source.shared_path(Session, "x").startswith("file:///")
