"""Scores of predicted labels against accepted answers, joined by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

BIN, TOP = 50, 15


def accepted(label: Column, options: Column, mode: str = "whole") -> Column:
    """Whether a label counts as right.

    whole: the whole label is one of the stripped options. parts: one of the label's parts is an option, nothing stripped.
    stripped: the parts are stripped, the options only as a whole.
    """
    if mode == "whole":
        return F.array_contains(F.transform(options, strip), label)
    parts = F.split(label, r"\|")
    if mode == "parts":
        return F.arrays_overlap(parts, options)
    if mode == "stripped":
        return F.arrays_overlap(F.transform(parts, strip), F.split(strip(F.array_join(options, "|")), r"\|"))
    raise ValueError(f"no such mode: {mode}")


def positional(labels: DataFrame, answers: DataFrame, keys: tuple[str, ...] = ("idx",), mode: str = "whole") -> DataFrame:
    """Label i with answer i, up to the shorter of the two; `correct` says whether it counts."""
    return labels.join(answers, list(keys)).withColumn("correct", accepted(F.col("label"), F.col("accepted"), mode))


def accuracy(scored: DataFrame, *by: str) -> DataFrame:
    """n, right, accuracy in per cent; 0 where there is nothing."""
    n, right = F.count(F.lit(1)), F.count_if("correct")
    return scored.groupBy(*by).agg(n.alias("n"), right.alias("right"), F.coalesce(F.try_divide(right * 100.0, n), F.lit(0.0)).alias("accuracy"))


def by_bin(scored: DataFrame, position: str = "idx", size: int = BIN) -> DataFrame:
    """Accuracy of each bin of `size` positions, with its centre."""
    binned = scored.withColumn("bin", F.expr(f"{position} div {size}"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("right"), F.avg(F.col("correct").cast("double") * 100).alias("accuracy"), F.expr(f"(min({position}) + max({position}) + 1) div 2").alias("centre"))


def validation_range(scored: DataFrame, start: int = 1, count: int = 0, position: str = "idx") -> DataFrame:
    """From position `start` (1-based, at least 1) `count` rows; count <= 0: to the end."""
    first = max(1, start) - 1
    rows = scored.where(F.col(position) >= first)
    return rows if count <= 0 else rows.where(F.col(position) < first + count)


def error_patterns(scored: DataFrame, position: str = "idx", top: int = TOP, ordered: bool = True) -> DataFrame:
    """pattern "expected -> got", count; most frequent first, ties by first occurrence. ordered: options sorted in the pattern."""
    options = F.array_join(F.array_sort("accepted") if ordered else F.col("accepted"), "|")
    wrong = scored.where("not correct").select(F.concat(options, F.lit(" -> "), F.col("label")).alias("pattern"), F.col(position).alias("_at"))
    return _top(wrong, "pattern", top)


def confusions(scored: DataFrame, of: Column, position: str = "idx", top: int | None = None) -> DataFrame:
    """Counts over wrong rows of the predicted or the true value."""
    return _top(scored.where("not correct").select(of.alias("value"), F.col(position).alias("_at")), "value", top)


def frequency(rows: DataFrame, speaker: str, position: str, top: int | None = None, ignore: tuple[str, ...] = ("", "?")) -> DataFrame:
    """value, count of speakers, without empty and unknown ones."""
    named = rows.where(F.col(speaker).isNotNull() & ~F.col(speaker).isin(*ignore)).select(F.col(speaker).alias("value"), F.col(position).alias("_at"))
    return _top(named, "value", top)


def _top(rows: DataFrame, name: str, top: int | None) -> DataFrame:
    counted = rows.groupBy(name).agg(F.count(F.lit(1)).alias("count"), F.min("_at").alias("first_at"))
    return counted if top is None else counted.orderBy(F.desc("count"), "first_at").limit(top)
