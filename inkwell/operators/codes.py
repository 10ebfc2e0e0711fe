"""Canonical codes and record ends as table operators: sums over ordered rows that no single task does alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Symbols of a length that are numbered in one task at most.
RANGE = 1 << 16


def canonical_codes(lengths: DataFrame) -> DataFrame:
    """``symbol``, ``len`` with ``code`` (32 bits, counted up in order of length and symbol) and ``mirrored`` (its bits in reverse).

    The symbols of a length are numbered in ranges of RANGE symbol values; only the ranges' counts are summed up in order.
    """
    rows = lengths.select("symbol", "len", F.floor(F.col("symbol") / RANGE).alias("__range"))
    counts = rows.groupBy("len", "__range").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.groupBy("len").agg(F.sum("n").alias("n")).select("len", F.coalesce(F.sum(F.col("n") * F.expr("shiftleft(1L, 32 - len)")).over(earlier), F.lit(0)).alias("before"))
    below = Window.partitionBy("len").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.select("len", "__range", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("skipped")).join(begun, "len")  # 32 lengths
    place = F.row_number().over(Window.partitionBy("len", "__range").orderBy("symbol")) - 1
    placed = rows.withColumn("place", place).join(begun, ["len", "__range"])
    code = (F.expr("shiftright(before, 32 - len)") + F.col("skipped") + F.col("place")).bitwiseAND(0xFFFFFFFF)
    return placed.select("symbol", "len", code.alias("code")).withColumn("mirrored", F.reverse(F.lpad(F.bin("code"), F.col("len"), F.lit("0"))))


def end_offsets(records: DataFrame, *, file: Column, offset_col: str, size_col: str = "size") -> DataFrame:
    """``records`` (with a size each) of files: where each begins, and where it ends: at the next one, the last at the file's end.

    ``file`` names the file, ``offset_col`` orders its records.
    """
    w = Window.partitionBy(file).orderBy(offset_col)
    begin = F.coalesce(F.sum(size_col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = F.sum(size_col).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = records.select("*", begin.alias("off"), end.alias("__total"))
    return rows.select("*", F.coalesce(F.lead("off").over(w), F.col("__total")).alias("end_off")).drop("__total")
