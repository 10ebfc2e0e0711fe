"""Reading progress: messages, the debounced scroll position, the chapter cursor, and the latest state of each book.

All of it is keyed, and every aggregate combines on the map side.  The cursor folds a key's events by spans of time first, so
that no key's events are gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "type string, value double"
STORE = "book_path string, chapter_index int, scroll_percent double, last_read timestamp"
#: Quiet time after which the last scroll position counts.
DEBOUNCE = "300 milliseconds"


def messages(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """JSON messages ``{type: prev | next | progress, value?}`` as columns; what does not read, or has another type, goes."""
    parsed = raw.withColumn("__m", F.from_json(F.col(value_col).cast("string"), MESSAGE))
    kept = parsed.where(F.col("__m.type").isin("prev", "next") | ((F.col("__m.type") == "progress") & F.col("__m.value").isNotNull()))
    others = [c for c in raw.columns if c not in {value_col, "type", "value"}]
    return kept.select(*others, F.col("__m.type").alias("type"), F.col("__m.value").alias("value"))


def action_of_click(x: Column, width: Column) -> Column:
    """The left third goes back, the right third goes on, the middle does nothing."""
    return F.when(x / width < 0.33, "prev").when(x / width > 0.66, "next")


def action_of_key(key: Column) -> Column:
    return F.when(key.isin("ArrowLeft", "PageUp"), "prev").when(key.isin("ArrowRight", "PageDown", " "), "next")


def debounced(events: DataFrame, *, keys: list[str], ts_col: str = "ts", value_col: str = "value", quiet: str = DEBOUNCE) -> DataFrame:
    """``keys``, ``ts``, ``value``: of each run of events without a pause of ``quiet``, the last value and its time.

    Works on streams with a watermark as well: a run is emitted once the watermark has passed its end.
    """
    last = F.max_by(F.struct(F.col(ts_col).alias("ts"), F.col(value_col).alias("value")), F.col(ts_col)).alias("__last")
    runs = events.groupBy(*keys, F.session_window(F.col(ts_col), quiet).alias("__run")).agg(last)
    return runs.select(*keys, F.col("__last.ts").alias("ts"), F.col("__last.value").alias("value"))


def latest(events: DataFrame, *, keys: list[str], ts_col: str, value_cols: list[str], order_cols: list[str] | None = None) -> DataFrame:
    """The last event of each key; of events of the same time that with the largest ``order_cols``, then values."""
    wanted = list(dict.fromkeys([*value_cols, ts_col]))
    order = F.struct(*[F.col(c) for c in dict.fromkeys([ts_col, *(order_cols or []), *value_cols])])
    last = F.max_by(F.struct(*[F.col(c) for c in wanted]), order).alias("__last")
    return events.groupBy(*keys).agg(last).select(*keys, "__last.*")


def upserted(store: DataFrame, updates: DataFrame) -> DataFrame:
    """The store with the updates in it: the latest row of each book; of the same time, an update's."""
    both = store.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    return latest(both, keys=["book_path"], ts_col="last_read", value_cols=["chapter_index", "scroll_percent"], order_cols=["__new"]).select(store.columns)


#: The store's times keep their microseconds.
_TIMES = ("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """A JSON store; one that is missing or does not read is empty."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], STORE)
    return spark.read.schema(STORE).option("mode", "PERMISSIVE").option(*_TIMES).json(path).where(F.col("book_path").isNotNull())


def saved_to(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").option(*_TIMES).json(path)


def restored(books: DataFrame, store: DataFrame, *, path_col: str = "path", chapters_col: str = "n_chapters") -> DataFrame:
    """``books`` with ``current_chapter``: the saved one if the book has it, else 0.  The scroll position is not read back."""
    saved = store.select(F.col("book_path").alias("__p"), F.col("chapter_index").alias("__c"))
    joined = books.join(saved, F.col(path_col) == F.col("__p"), "left")
    fits = F.col("__c") < F.col(chapters_col)
    return joined.select(books["*"], F.when(fits, F.col("__c")).otherwise(0).alias("current_chapter"))


def cursor(
    events: DataFrame, *, keys: list[str], last_chapter: Column, ts_col: str = "ts", type_col: str = "type", order_cols: list[str] | None = None, span: str = "1 hour"
) -> DataFrame:
    """``keys`` and ``chapter``: where each key's prev and next events lead from chapter 0, staying within the book.

    ``last_chapter`` is the same for all events of a key.  Steps that stay within bounds compose to one such step (by, lowest
    result, highest result), so the events of each ``span`` of time are folded to one, and a key's spans then in turn.
    """
    order = [F.col(c) for c in [ts_col, *(order_cols or [])]]
    moves = events.where(F.col(type_col).isin("prev", "next"))
    rows = moves.select(*keys, F.window(F.col(ts_col).cast("timestamp"), span)["start"].alias("__span"), F.struct(*order, F.when(F.col(type_col) == "next", 1).otherwise(-1).alias("__step")).alias("__event"), last_chapter.cast("int").alias("__last"))
    spans = rows.groupBy(*keys, "__span").agg(F.array_sort(F.collect_list("__event")).alias("__events"), F.max("__last").alias("__last"))
    far = 1 << 30
    within = lambda x: F.greatest(F.lit(0), F.least(F.col("__last"), x))
    folded = F.aggregate(
        "__events", F.struct(F.lit(0).alias("by"), F.lit(-far).alias("low"), F.lit(far).alias("high")),
        lambda f, e: F.struct((f["by"] + e["__step"]).alias("by"), within(f["low"] + e["__step"]).alias("low"), within(f["high"] + e["__step"]).alias("high")),
    )
    steps = spans.select(*keys, F.struct("__span", folded.alias("f")).alias("__f")).groupBy(*keys).agg(F.array_sort(F.collect_list("__f")).alias("__fs"))
    at = F.aggregate("__fs", F.lit(0), lambda a, s: F.greatest(s["f"]["low"], F.least(s["f"]["high"], a + s["f"]["by"])))
    return steps.select(*keys, at.alias("chapter"))
