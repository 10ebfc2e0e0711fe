"""URL filters as a sort-merge range join.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's path.  Hosts are turned
round into arrays of labels (``www.example.com`` -> ``[com, example, www]``), so that "host or subdomain" is one interval
of the sorted keys and intervals are nested or disjoint.  Urls and rules are dealt to ranges of that order, each rule to
every range that its interval meets; within a range one sorted sweep keeps the stack of the rules' hosts that are active,
each with its paths sorted, and looks only there.  Equal keys may fill several ranges, so a hot host is split.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.text import kept_columns, quoted, sampled

RULES = "host string, path string, verdict string"
#: Urls that are sampled (about) to place the bounds of the ranges, and of each range at least.
SAMPLE_KEYS, SAMPLES_PER_RANGE = 20_000, 20


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*(/[^?#]*)", 1), F.lit(""))


class PathRules:
    """The rules of one host: the longest path that a given path starts with, by bisection and links to enclosing paths."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        best: dict[str, str] = {}
        for path, verdict in rules:  # equal rules: block wins, else the smaller verdict
            best[path] = verdict if path not in best else "block" if "block" in (verdict, best[path]) else min(verdict, best[path])
        self.paths = sorted(best)
        self.verdicts = [best[p] for p in self.paths]
        self.outer: list[int] = []
        stack: list[int] = []
        for i, p in enumerate(self.paths):
            while stack and not p.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.outer.append(stack[-1] if stack else -1)
            stack.append(i)

    def find(self, path: str) -> int:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return i


def sweep(rows: Iterator[tuple[tuple[str, ...], bool, str, str]], default: str) -> Iterator[tuple[str | None, str] | None]:
    """Rows (reversed host, is a url, path, verdict) sorted with rules before urls of the same host; None for each rule."""
    stack: list[tuple[tuple[str, ...], PathRules]] = []
    waiting: list[tuple[str, str]] = []
    at: tuple[str, ...] | None = None
    last: tuple[tuple[str, ...], str] | None = None
    answer: tuple[str | None, str] = (None, default)

    for key, is_url, path, verdict in rows:
        if key != at:
            if waiting:
                stack.append((at, PathRules(waiting)))
                waiting = []
            while stack and key[: len(stack[-1][0])] != stack[-1][0]:
                stack.pop()
            at = key
        if not is_url:
            waiting.append((path, verdict))
            yield None
            continue
        if waiting:
            stack.append((key, PathRules(waiting)))
            waiting, last = [], None
        if last != (key, path):
            found: list[tuple[int, int, str, str]] = []
            for host, rules in stack:
                if (i := rules.find(path)) >= 0:
                    name = ".".join(reversed(host))
                    found.append((len(name) + len(rules.paths[i]), len(name), name + rules.paths[i], rules.verdicts[i]))
            last = (key, path)
            answer = max(found)[2:] if found else (None, default)
        yield answer


def url_filter(
    pages: DataFrame, rules: DataFrame, *, keep: list[str] | None = None, url_col: str = "url", default: str = "allow", ranges: int | None = None
) -> DataFrame:
    """``keep`` columns plus ``host``, ``path``, ``rule`` (host and path joined, null if none fits) and ``verdict``.

    The longest rule that fits wins (of equally long ones that with the longer host); without any, ``default``.  A null
    url or one without ``://`` has an empty host and path.  A rule with a null host never fits; a null path is empty; a
    null verdict is ``block``.  Rules may be many: they are dealt out with the urls, never broadcast whole.
    """
    spark = pages.sparkSession
    keep, columns, fields = kept_columns(pages, ["page_id"] if keep is None else keep, {"host", "path", "rule", "verdict"})
    own = [f.name for f in fields]
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    url = F.col(quoted(url_col)).cast("string")
    # the salt tells repeated rows apart; a row's number is the same whenever its task is run again
    salt = F.xxhash64(url, *[F.col(quoted(c)).cast("string") for c in keep], F.monotonically_increasing_id())
    urls = pages.select(*columns, url_host(url).alias("__host"), url_path(url).alias("__path"), salt.alias("__salt"))
    urls = urls.withColumn("__key", F.reverse(F.split("__host", r"\.", -1)))

    # bounds: quantiles of (key, salt) of a hashed sample; a hot key takes several bounds that differ by salt
    drawn = sampled(urls, max(SAMPLE_KEYS, SAMPLES_PER_RANGE * n), F.col("__salt")).select("__key", "__salt").collect()
    sample = sorted((tuple(r[0]), r[1]) for r in drawn)
    bounds = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    @F.pandas_udf(T.IntegerType())
    def range_of(key, salt):
        import pandas as pd

        return pd.Series([bisect_right(bounds, (tuple(k), s)) for k, s in zip(key, salt, strict=True)], dtype="int32")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ranges_of(key):
        import pandas as pd

        least = -(1 << 63)
        out = []
        for k in key:
            k = tuple(k)
            # the interval ends before the first key that does not begin with k
            past = bisect_left(bounds, True, lo=bisect_left(bounds, (k, least)), key=lambda b: b[0][: len(k)] != k)
            out.append(list(range(bisect_left(bounds, (k, least)), past + 1)))
        return pd.Series(out)

    rule = rules.select(F.col("host").alias("__host"), F.coalesce("path", F.lit("")).alias("__path"), F.coalesce("verdict", F.lit("block")).alias("__verdict")).where(F.col("__host").isNotNull())
    rule = rule.withColumn("__host", F.translate("__host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rule = rule.distinct().withColumn("__key", F.reverse(F.split("__host", r"\.", -1)))
    rule = rule.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], "__host", "__path", "__key",
        F.explode(ranges_of("__key")).alias("__range"), F.lit(False).alias("__is_url"), "__verdict",
    )
    mine = urls.select(
        *own, "__host", "__path", "__key", range_of("__key", "__salt").alias("__range"), F.lit(True).alias("__is_url"), F.lit("").alias("__verdict")
    )
    dealt = mine.union(rule).repartitionById(n, F.col("__range")).sortWithinPartitions("__range", "__key", "__is_url", "__path")
    schema = T.StructType(fields + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows() -> Iterator[tuple[tuple[str, ...], bool, str, str]]:
            for batch in batches:
                held.append(batch)
                cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__key", "__is_url", "__path", "__verdict")]
                for k, u, p, v in zip(*cols, strict=True):
                    yield tuple(k), u, p, v

        found: list[tuple[str | None, str] | None] = []

        def flush() -> Iterator[pa.RecordBatch]:
            batch = held.pop(0)
            mask = pa.array([x is not None for x in found])
            part = batch.filter(mask)
            answers = [x for x in found if x is not None]
            found.clear()
            place = {f.name: i for i, f in enumerate(part.schema)}
            cols = [part.column(place[c]) for c in (*own, "__host", "__path")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r for r, _ in answers], pa.string()), pa.array([v for _, v in answers], pa.string())], names=names)

        for answer in sweep(rows(), default):
            if len(held) > 1 and len(found) == held[0].num_rows:
                yield from flush()
            found.append(answer)
        if held:
            yield from flush()

    return dealt.mapInArrow(run, schema).toDF(*keep, "host", "path", "rule", "verdict")


def judged(url: str | None, rules: list[tuple[str, str, str]], default: str = "allow") -> tuple[str, str, str | None, str]:
    """Brute force for tests: every rule is tried."""
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))
