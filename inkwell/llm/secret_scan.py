"""Secret scans with built-in DataFrame functions only.

Three rules find assignments, access keys and long hex strings.  Beside them, two first-order Markov models of characters,
one of random strings and one of ordinary identifiers, are trained from labelled samples.  They judge what the rules leave:
a run of key-like characters whose log-likelihood ratio favours the random model becomes a span of its own; of any other
run, so do its pieces between signs (a key at the end of a path).

Spans are places in code points, end exclusive.  A pattern's matches are put between two marks in one pass over the text,
which is then cut at the marks; positions are the running sums of the pieces' lengths, in two levels so that long lists stay
cheap.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.text import kept_columns, quoted, sampled

#: The rules' patterns.  The last two are written with their least length, which picks the same matches,
#: as no shorter one can end inside a longer.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Key-like runs that the Markov models judge.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Pieces of a run that are judged by themselves if the run is not random as a whole.
PIECE = r"[A-Za-z0-9+]{20,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Random strings generated, and documents that ordinary identifiers are drawn from (about), for training.
RANDOM_SAMPLES, ORDINARY_DOCS = 6000, 400
#: Least mean log-likelihood ratio of a character pair, and least sum over a run.
LEAST_MEAN, LEAST_SUM = 0.35, 10.0

#: Stands before and after each match while a text is cut; where a text has it, it counts as another character of no pattern.
_MARK, _OTHER = "\uE000", "\uE001"
_LEVEL = 64
_SPANS = "array<struct<start:int,kind:int,end:int,match:string>>"


def running(values: Column, first: int, step: Callable[[Column, Column], Column]) -> Column:
    """[first, step(first, x0), ...] (one entry more than ``values``) for an associative step, by slices of 64."""

    def prefix(of: Column, begin: Column) -> Column:
        return F.aggregate(of, F.array(begin), lambda out, x: F.concat(out, F.array(step(F.element_at(out, -1), x))))

    def over(values: Column) -> Column:
        slices = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / _LEVEL).cast("int")), lambda k: F.slice(values, k * _LEVEL + 1, F.lit(_LEVEL)))
        return once(slices, lambda s: once(prefix(F.transform(s, lambda x: F.aggregate(x, F.lit(first), step)), F.lit(first)), lambda firsts: F.concat(
            F.flatten(F.transform(s, lambda x, k: F.slice(prefix(x, F.get(firsts, k)), 1, F.size(x)))), F.slice(firsts, -1, 1)
        )))

    return once(values, over)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unmarked(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _OTHER)).otherwise(text)


def pieces(text: Column, pattern: str) -> Column:
    """What lies before, in and between the leftmost non-overlapping matches: every second piece is a match."""
    return F.split(F.regexp_replace(text, pattern, _MARK + "$0" + _MARK), _MARK, -1)


def spans_of(cut: Column, kind: int) -> Column:
    """The matches among pieces as struct(start, kind, end, match)."""
    def spans(cut: Column) -> Column:
        starts = running(F.transform(cut, lambda p: F.length(p)), 0, lambda a, b: a + b)
        return once(starts, lambda s: F.transform(
            F.sequence(F.lit(1), F.size(cut) - 2, F.lit(2)),
            lambda i: F.struct(F.get(s, i).alias("start"), F.lit(kind).alias("kind"), F.get(s, i + 1).alias("end"), F.get(cut, i).alias("match")),
        ))

    return F.when(F.size(cut) > 1, once(cut, spans)).otherwise(F.array().cast(_SPANS))


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 8


def blanked(text: Column, pattern: str, fits: Callable[[Column], Column] | None = None) -> Column:
    """The text with blanks in the place of the matches, as many as they have characters."""
    def blank(p: Column, i: Column) -> Column:
        match = i % 2 == 1
        return F.when(match & fits(p) if fits else match, F.repeat(F.lit(" "), F.length(p))).otherwise(p)

    return F.array_join(F.transform(pieces(text, pattern), blank), "")


def labelled_samples(spark: SparkSession, docs: DataFrame, text_col: str = "text", ordinary_docs: int = ORDINARY_DOCS, random_samples: int = RANDOM_SAMPLES) -> DataFrame:
    """(random, s): generated keys of base64, base62-like and hex characters, and words and joined words of some documents.

    The documents are about ``ordinary_docs`` different texts, picked by hash; null texts take no part.
    """
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), r"\s", "")
    key = F.when(F.col("id") % 3 == 0, base64).when(F.col("id") % 3 == 1, F.regexp_replace(base64, "[+/=]", "")).otherwise(digest)
    random = spark.range(random_samples).select(F.lit(True).alias("random"), key.alias("s"))
    texts = docs.select(F.col(quoted(text_col)).cast("string").alias("t")).where("t IS NOT NULL")
    drawn = sampled(texts, ordinary_docs, F.col("t")).distinct()
    words = F.filter(F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,40}(?![0-9+/=])"), F.lit(0)), lambda w: ~w.rlike(HEX))
    # identifiers as programmers join words: snake, kebab and camel case, with a number at times
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.when(F.length(a) % 4 == 0, F.concat_ws("_", a, b)).when(F.length(a) % 4 == 1, F.concat_ws("-", a, b)).when(F.length(a) % 4 == 2, F.concat(a, F.initcap(b))).otherwise(F.concat_ws("/", a, F.concat(b, (F.length(b) % 10).cast("string")))))
    ordinary = drawn.select(words.alias("w")).select(F.explode(F.concat("w", pairs)).alias("s"))
    return random.unionByName(ordinary.where("s IS NOT NULL").select(F.lit(False).alias("random"), "s"))


def trained(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratio of every pair of characters (row: first, column: second), with add-one smoothing.

    At most one row per label and pair of the alphabet comes to the driver.  None if a label has no pair at all (a table
    without words): then only the rules apply.
    """
    n = len(ALPHABET)
    size = F.length("s")
    pairs = samples.where(size >= 2).select("random", F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substr("s", i, F.lit(2)))).alias("p"))
    counts: dict[bool, dict[str, int]] = {True: {}, False: {}}
    for r in pairs.where(F.col("p").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "p").count().collect():
        counts[r[0]][r[1]] = r[2]
    if not counts[True] or not counts[False]:
        return None
    rows: dict[bool, dict[str, int]] = {label: {a: sum(counts[label].get(a + b, 0) for b in ALPHABET) for a in ALPHABET} for label in counts}
    return [
        math.log((counts[True].get(a + b, 0) + 1) / (rows[True][a] + n)) - math.log((counts[False].get(a + b, 0) + 1) / (rows[False][a] + n))
        for a in ALPHABET for b in ALPHABET
    ]


def log_ratio(run: Column, model: list[float]) -> Column:
    """Sum of the model's log-likelihood ratios over the run's pairs of neighbouring characters, in one pass over them."""
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in model])), "array<double>")  # folded into one literal
    n = len(ALPHABET)
    return F.aggregate(
        F.split(run, ""), F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last")),
        lambda acc, c: once(_place(c), lambda x: F.struct((acc["sum"] + F.when(acc["last"] >= 0, F.get(table, acc["last"] * n + x)).otherwise(0.0)).alias("sum"), x.alias("last"))),
        lambda acc: acc["sum"],
    )


def _place(c: Column) -> Column:
    return F.call_function("locate", c, F.lit(ALPHABET)) - 1


def scan(
    docs: DataFrame, model: list[float] | None, *, keep: list[str] | None = None, text_col: str = "text", least_mean: float = LEAST_MEAN, least_sum: float = LEAST_SUM
) -> DataFrame:
    """``keep`` columns plus ``spans``: array of struct(start, kind, end, match), by start, then kind as in ``KINDS``.

    A null or empty text has no spans; repeated rows get a row each; an input column ``spans`` is replaced.  Whole texts of
    any length; rows stay in place.  The models' spans never overlap a rule's.  Without a model only the rules apply.
    """
    names, columns, _ = kept_columns(docs, ["doc_id"] if keep is None else keep, {"spans"})
    kept = [f"__k{i}" for i in range(len(names))]
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    rows = docs.select(*columns, unmarked(text).alias("__text"))
    cut = _held(rows, kept + ["__text"], **{f"__c{i}": pieces(F.col("__text"), p) for i, p in enumerate((ASSIGN, ACCESS, HEX))})
    base = F.concat(F.filter(spans_of(F.col("__c0"), 0), lambda x: _long_value(x["match"])), spans_of(F.col("__c1"), 1), spans_of(F.col("__c2"), 2))
    rows = _held(cut, kept + ["__text"], __base=F.array_sort(base))
    if model is None:
        spans = F.col("__base")
    else:
        left = blanked(blanked(blanked(F.col("__text"), ASSIGN, _long_value), ACCESS), HEX)
        rows = _held(rows, kept + ["__base"], __cut=pieces(F.when(F.size("__base") > 0, left).otherwise(F.col("__text")), RUN))
        judged = F.flatten(F.transform(spans_of(F.col("__cut"), 3), lambda x: _judged(x, model, least_mean, least_sum)))
        rows = _held(rows, kept + ["__base"], __judged=judged)
        spans = F.when(F.size("__judged") == 0, F.col("__base")).when(F.size("__base") == 0, F.col("__judged")).otherwise(F.array_sort(F.concat("__base", _apart(F.col("__judged"), F.col("__base")))))
    return rows.select(*kept, spans.alias("spans")).toDF(*names, "spans")


def _held(rows: DataFrame, keep: list[str], **values: Column) -> DataFrame:
    """``rows`` with columns that are computed once: a generator of one row keeps the optimizer from repeating them."""
    return rows.select(*keep, F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("__held")).select(*keep, "__held.*")


def _random(run: Column, model: list[float], least_mean: float, least_sum: float) -> Column:
    ratio = log_ratio(run, model)
    return ratio >= F.greatest(F.lit(least_sum), F.lit(least_mean) * (F.length(run) - 1))


def _judged(run: Column, model: list[float], least_mean: float, least_sum: float) -> Column:
    """The run itself, if it is random, else its random pieces between signs."""
    inner = F.transform(
        F.filter(spans_of(pieces(run["match"], PIECE), 3), lambda x: _random(x["match"], model, least_mean, least_sum)),
        lambda x: F.struct((run["start"] + x["start"]).alias("start"), x["kind"].alias("kind"), (run["start"] + x["end"]).alias("end"), x["match"].alias("match")),
    )
    whole = F.regexp_like(run["match"], F.lit(f"^{PIECE}$"))
    return F.when(_random(run["match"], model, least_mean, least_sum), F.array(run)).when(whole, F.array().cast(_SPANS)).otherwise(inner)


def _apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base`` (sorted by start).  Blanks leave but a few to look up, each by bisection."""
    ends = running(F.transform(base, lambda b: b["end"]), 0, lambda a, b: F.greatest(a, b))

    def free(x: Column, ends: Column) -> Column:
        steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
        begun = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= F.size(base)) & (F.get(base, n + s - 1)["start"] < x["end"]), n + s).otherwise(n))
        return F.get(ends, begun) <= x["start"]

    return once(ends, lambda e: F.filter(spans, lambda x: free(x, e)))


def shown(spans: Column, *kinds: str) -> Column:
    """``kind:start:end`` of the spans of these kinds (default all), comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    mine = F.filter(spans, lambda x: F.element_at(names, x["kind"] + 1).isin(*kinds)) if kinds else spans
    return F.concat_ws(",", F.transform(mine, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span (sorted by start) replaced by ``mark``; overlapping spans are replaced together.

    What is left is cut out in two levels, a run of spans at a time, as each cut walks along what it is cut from.
    """
    def between(ends: Column) -> Column:
        n = F.size(spans)
        runs = F.sequence(F.lit(0), F.floor(n / _LEVEL).cast("int"))  # span n stands for the text's end

        def run(k: Column) -> Column:
            first, last = k * _LEVEL, F.least((k + 1) * _LEVEL, n)
            begin = F.get(ends, first)
            stop = F.when(last < n, F.get(ends, last)).otherwise(F.length(text))
            return once(F.substr(text, begin + 1, stop - begin), lambda part: F.array_join(F.transform(F.sequence(first, F.when(last < n, last - 1).otherwise(n)), lambda i: gap(i, part, begin)), ""))

        def gap(i: Column, part: Column, begin: Column) -> Column:
            at = F.get(ends, i)
            start = F.get(spans, i)["start"]
            return F.when(i == n, F.substr(part, at - begin + 1, F.length(part))).when(start >= at, F.concat(F.substr(part, at - begin + 1, start - at), F.lit(mark))).otherwise("")

        return F.array_join(F.transform(runs, run), "")

    replaced = once(running(F.transform(spans, lambda x: x["end"]), 0, lambda a, b: F.greatest(a, b)), between)
    return F.when(F.size(spans) > 0, replaced).otherwise(text)


def base_spans(text: str | None) -> list[tuple[int, str, int]]:
    """Brute force for tests: (start, kind, end) of the rules' matches."""
    import re

    found = []
    for kind, pattern, fits in (
        ("assign", ASSIGN, lambda m: len(m[2]) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ):
        found += [(m.start(), KINDS.index(kind), m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if fits(m)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]
