"""Column expressions over text: trimming, clean-up, anchors, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of outer tags, page breaks and image references decide what is split, removed and replaced, and
#: the whole book's title is shown.
OUTER_TAGS = r"(?i)</?(?:html|body|head|meta|title|link)[^>]*>"
PAGE_BREAK = r"""(?i)<\s*(?:mbp:)?pagebreak[^>]*>|<hr[^>]*class\s*=\s*['"]?pagebreak['"]?[^>]*>"""
IMAGE_REFERENCE = r"""<img[^>]*filepos\s*=\s*['"]#?(\d+)['"][^>]*>"""
WHOLE_BOOK_TITLE = "全文"


def trimmed(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(trimmed(text) == "", F.lit(True))


def cleaned_html(text: Column) -> Column:
    """From the first ``<`` on, if there is one, without NULs, trimmed."""
    at = F.locate("<", text)
    return trimmed(F.regexp_replace(F.when(at > 1, F.substr(text, at, F.length(text))).otherwise(text), "\\x00", ""))


def without_outer_tags(html: Column) -> Column:
    return trimmed(F.regexp_replace(html, OUTER_TAGS, ""))


def anchor_of(href: Column) -> Column:
    """The href from its first ``#`` on; empty without one."""
    return F.when(F.locate("#", href) > 0, F.substr(href, F.locate("#", href), F.length(href))).otherwise("")


def numbered_title(idx: Column) -> Column:
    return F.concat(F.lit("第 "), (idx + 1).cast("string"), F.lit(" 节"))


def progress_label(idx: Column, n: Column) -> Column:
    return F.concat_ws(" / ", (idx + 1).cast("string"), n.cast("string"))


def scroll_fraction(scroll: Column, height: Column, window: Column) -> Column:
    room = height - window
    return F.when(room > 0, scroll / room).otherwise(0.0)


def clamped(idx: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(idx, n - 1))


def page_chunks(html: Column) -> Column:
    """The trimmed non-blank pieces between page breaks; none at all without a page break."""
    pieces = F.transform(F.split(html, PAGE_BREAK, -1), trimmed)
    return F.when(html.rlike(PAGE_BREAK), F.filter(pieces, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def file_format(kf8_offset: Column) -> Column:
    return F.when(kf8_offset > 0, "AZW3/KF8").otherwise("MOBI")


def replacement_count(text: Column, chars: int = 10_000, most: int = 5) -> Column:
    """Replacement characters among the first ``chars``; counting stops one beyond ``most``."""
    head = F.substr(text, F.lit(1), F.lit(chars))
    return F.least(F.lit(most + 1), F.length(head) - F.length(F.replace(head, F.lit("�"), F.lit(""))))


def cjk_count(text: Column, chars: int = 200) -> Column:
    return F.regexp_count(F.substr(text, F.lit(1), F.lit(chars)), F.lit("[一-鿿]"))


def is_plausible(text: Column, chars: int = 200) -> Column:
    """The start has two angle brackets or more, or is printable ASCII for more than three tenths; at least 20 bytes in all."""
    head = F.substr(text, F.lit(1), F.lit(chars))
    readable = F.regexp_count(head, F.lit("[ -~]")) > 0.3 * F.length(head)
    return (F.octet_length(text) >= 20) & ((F.regexp_count(head, F.lit("[<>]")) >= 2) | readable)
