"""Which attributions need a second look, and what is taken from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NON_PERSON, garbage_speaker, short_or_fragment, strip, temporary_name

# The five reasons, in their order.
REASONS = (
    "speaker is a temporary descriptor and may need identity verification",
    "speaker is non-person; quote type should be verified",
    "speaker conflicts with recent two-person exchange expectation",
    "short or fragmentary line inside a rapid exchange",
    "low evidence depth for a short or fragmentary line",
)
QUOTE_TYPES = ("direct_speech", "quote_or_letter", "password_or_signal", "sound_effect", "thought_not_spoken", "unclear")


def risk_reasons(speaker: Column, text: Column, tool_rounds: Column, expected: Column, rapid: Column) -> Column:
    """array of the reasons that hold, in order."""
    name = strip(F.coalesce(speaker, F.lit("")))
    short = short_or_fragment(text)
    holds = (temporary_name(name), name.isin(*NON_PERSON), (F.coalesce(expected, F.lit("")) != "") & (name != "") & (name != expected), rapid & short, (tool_rounds <= 1) & short)
    return F.filter(F.array(*(F.when(h, F.lit(r)) for h, r in zip(holds, REASONS))), lambda x: x.isNotNull())


def gated(rows: DataFrame, risky: Column, review: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """review() applied to risky rows only. The rest goes around it: a costly function inside when() would run on every row. review keeps the columns."""
    flag = F.coalesce(risky, F.lit(False))
    return review(rows.where(flag)).unionByName(rows.where(~flag))


def take_identity(speaker: Column, status: Column, character: Column) -> Column:
    """A found character replaces the speaker only if it is verified."""
    return F.when(status == "verified", character).otherwise(speaker)


def take_verdict(speaker: Column, verdict: Column, suggestion: Column) -> Column:
    """struct(speaker, corrected)"""
    changes = F.coalesce((verdict == "disagree") & (suggestion != speaker), F.lit(False))
    return F.struct(F.when(changes, suggestion).otherwise(speaker).alias("speaker"), changes.alias("corrected"))


def usable(speaker: Column) -> Column:
    return ~garbage_speaker(speaker)
