"""Recent-speaker memory: bounded history, alternation and rhythm, the speaker expected next.

All are windows per key over what came before a row; the current row is never part of its own history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pair_name

MEMORY_ROUNDS, RHYTHM_ROUNDS, RHYTHM_LEAST, RHYTHM_SHARE, EXCHANGE_ROUNDS = 20, 8, 4, 0.6, 4
# The texts that a model reads.
NOTHING, HEADING = "(No prior annotations)", "[Recent Dialogues]"
RHYTHM_TEXT = """[Exchange rhythm - last %d rounds]
  Alternating: %s ↔ %s
  Current expects: %s (opposite of previous speaker)
  NEXT EXPECTED: %s"""
ANCHOR_TEXT = """[ANCHOR CONSTRAINT] Last round violated the alternating pattern!
The last %d rounds form %s.
NEXT SPEAKER MUST BE: %s (strict alternation - do NOT repeat the previous speaker)
RULE: Only override this if the narrative clearly assigns speech to a different character."""
RAPID_TEXT = """RAPID EXCHANGE: Last 4 dialogues alternate between two speakers.
RULE: Narrative attribution (#1) before alternation (#3). Read 3-5 lines before target."""


def history(key: str, order: str, value: Column, rounds: int = MEMORY_ROUNDS) -> Column:
    """The last values before the row, oldest first."""
    return F.collect_list(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(-rounds, -1))


def rapid_exchange(seen: Column, rounds: int = EXCHANGE_ROUNDS) -> Column:
    """Whether the last `rounds` values are two that take turns."""
    last = F.slice(seen, F.greatest(F.size(seen) - rounds + 1, F.lit(1)), rounds)
    turns = F.forall(F.sequence(F.lit(1), F.lit(rounds - 1)), lambda i: F.get(last, i) != F.get(last, i - 1))
    return (F.size(seen) >= rounds) & (F.size(F.array_distinct(last)) == 2) & F.coalesce(turns, F.lit(False))


def strict_alternation(seen: Column) -> Column:
    """The last four are a b a b."""
    at = lambda i: F.get(seen, F.size(seen) - i)
    return (F.size(seen) >= 4) & F.coalesce((at(4) == at(2)) & (at(3) == at(1)) & (at(4) != at(3)), F.lit(False))


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once: a lambda's variable, not the expression, stands wherever it is needed."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rhythm(seen: Column) -> Column:
    """struct(a, b, score, next): the first two voices of the last RHYTHM_ROUNDS, how many steps follow their alternation, and whose turn
    it is; null unless there are enough rows, both voices occur twice and the share of steps is enough."""

    def framed(frame: Column) -> Column:
        return _bound(F.array_distinct(frame), lambda voices: scored(frame, voices, F.get(voices, F.lit(0)), F.get(voices, F.lit(1))))

    def scored(frame: Column, voices: Column, a: Column, b: Column) -> Column:
        steps = F.aggregate(frame, F.lit(0), lambda n, x: F.when(x == F.when(n % 2 == 0, a).otherwise(b), n + 1).otherwise(n))
        count = lambda v: F.size(F.filter(frame, lambda x: x == v))
        turn = F.when(F.get(frame, F.size(frame) - 1) == a, b).otherwise(a)
        enough = (F.size(frame) >= RHYTHM_LEAST) & (F.size(voices) >= 2) & (count(a) >= 2) & (count(b) >= 2)
        return _bound(steps, lambda score: F.when(enough & (score >= RHYTHM_SHARE * F.size(frame)), F.struct(a.alias("a"), b.alias("b"), score.cast("bigint").alias("score"), turn.alias("next"))))

    return _bound(F.slice(seen, F.greatest(F.size(seen) - RHYTHM_ROUNDS + 1, F.lit(1)), RHYTHM_ROUNDS), framed)


def next_expected(seen: Column) -> Column:
    """By the rhythm; without one the other of the last two if they differ; else null."""
    last, before = F.get(seen, F.size(seen) - 1), F.get(seen, F.size(seen) - 2)
    return F.coalesce(rhythm(seen)["next"], F.when((F.size(seen) >= 2) & (last != before), before))


def with_expectations(turns: DataFrame, key: str, order: str, speaker: str, rounds: int = MEMORY_ROUNDS) -> DataFrame:
    """turns with seen, rapid, alternates, expected, violation and anchored (the turn before was a violation)."""
    w = Window.partitionBy(key).orderBy(order)
    seen = turns.withColumn("seen", history(key, order, F.col(speaker), rounds))
    out = seen.withColumns({"rapid": rapid_exchange(F.col("seen")), "alternates": strict_alternation(F.col("seen")), "expected": next_expected(F.col("seen"))})
    out = out.withColumn("violation", F.coalesce(F.col("expected") != F.col(speaker), F.lit(False)))
    return out.withColumn("anchored", F.lag("violation", 1, False).over(w))


def summary(turns: DataFrame, key: str, order: str, speaker: str, text: str, rounds: int = MEMORY_ROUNDS, length: int = 60) -> DataFrame:
    """turns with `memory`: the rounds before as "Ln speaker: text" lines."""
    line = F.concat(F.lit("L"), F.col(order).cast("string"), F.lit(" "), F.col(speaker), F.lit(": "), F.left(F.col(text), F.lit(length)))
    return turns.withColumn("memory", F.array_join(history(key, order, line, rounds), "\n"))


def full_text(turns: DataFrame, key: str, order: str, speaker: str, text: str, before: str, rounds: int = MEMORY_ROUNDS) -> DataFrame:
    """turns with with_expectations() and `memory`: heading, the rounds before with the narrative that stood before each, then the rhythm, the constraint after a violation
    and the rapid exchange, each where it holds. A first row has NOTHING."""
    note = F.when(F.coalesce(before, F.lit("")) != "", F.concat(F.lit(" [before: "), F.left(before, F.lit(60)), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("  L"), F.col(order).cast("string"), F.lit("「"), F.left(F.coalesce(text, F.lit("")), F.lit(50)), F.lit("」-> "), F.col(speaker), note)
    rows = with_expectations(turns, key, order, speaker, rounds).withColumn("memory", history(key, order, line, rounds))
    seen, frame = F.col("seen"), F.least(F.size("seen"), F.lit(RHYTHM_ROUNDS))
    turn = _bound(rhythm(seen), lambda r: F.when(r.isNotNull(), F.format_string(RHYTHM_TEXT, frame, r["a"], r["b"], r["next"], r["next"])))
    anchor = F.when(F.col("anchored") & F.col("expected").isNotNull(), F.format_string(ANCHOR_TEXT, frame, pair_name(seen), F.col("expected")))
    parts = [F.concat(F.lit("\n"), part) for part in (turn, anchor, F.when(F.col("rapid"), F.lit(RAPID_TEXT)))]
    return rows.withColumn("memory", F.when(F.size(seen) == 0, F.lit(NOTHING)).otherwise(F.concat_ws("\n", F.lit(HEADING), F.array_join("memory", "\n"), *parts)))
