"""Profiles of run logs: rows (round, agents, tool_calls, ...) of either log version, or flat (round, agent, tokens) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import first_nonzero

CONTEXT, BIN, WINDOWS = 40_960, 50, (20, 30)


def tool_call_count(tool_calls: Column) -> Column:
    """Calls in an entry list: nested calls where the entry has them, else one if it names a function."""
    one = lambda c: F.when(c["tool_calls"].isNotNull(), F.size(c["tool_calls"])).when(c["function"].isNotNull(), 1).otherwise(0)
    return F.aggregate(F.coalesce(tool_calls, F.array()), F.lit(0), lambda n, c: n + one(c)).cast("bigint")


def agent_rows(log: DataFrame) -> DataFrame:
    """round, agent, tokens, tool_calls (the round's, repeated for each agent present)."""
    calls = tool_call_count(F.col("tool_calls")).alias("tool_calls")
    rows = log.select("round", calls, F.explode("agents").alias("agent", "facts"))
    return rows.select("round", "agent", first_nonzero(F.col("facts.total_tokens"), F.col("facts.prompt_eval_count") + F.col("facts.eval_count")).alias("tokens"), "tool_calls")


def agent_pivot(rows: DataFrame, agents: list[str], key: str = "round") -> DataFrame:
    """One row per round: <agent>_tokens and <agent>_tool_calls, 0 where an agent took no part. The agents are given, so no pass is needed to find them."""
    wide = rows.groupBy(key).pivot("agent", sorted(agents)).agg(F.sum("tokens").alias("tokens"), F.sum("tool_calls").alias("tool_calls"))
    return wide.fillna(0)


def agents_of(rows: DataFrame) -> DataFrame:
    return rows.select("agent").distinct()


def agent_statistics(rows: DataFrame) -> DataFrame:
    """Per agent: total tokens, mean over rounds with any, those rounds, tool calls, rounds with calls."""
    used = F.col("tokens") > 0
    return rows.groupBy("agent").agg(
        F.sum("tokens").alias("total_tokens"),
        (F.sum("tokens") / F.greatest(F.count_if(used), F.lit(1))).alias("mean_tokens"),
        F.count_if(used).alias("active_rounds"),
        F.sum("tool_calls").alias("tool_calls"),
        F.count_if(F.col("tool_calls") > 0).alias("rounds_with_calls"),
    )


def utilisation(tokens: Column, context: int = CONTEXT) -> Column:
    """Share of the context in per cent, 100 at most."""
    return F.least(tokens / F.lit(context) * 100, F.lit(100.0))


def binned(rows: DataFrame, position: str = "round", size: int = BIN) -> DataFrame:
    """Per bin: n, mean tokens, mean calls x 100, share of rounds with calls, mean utilisation."""
    return rows.groupBy(F.expr(f"{position} div {size}").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("tokens").alias("mean_tokens"),
        (F.avg("tool_calls") * 100).alias("calls_rate"),
        (F.avg((F.col("tool_calls") > 0).cast("double")) * 100).alias("rounds_with_calls_rate"),
        F.avg(utilisation(F.col("tokens"))).alias("utilisation"),
    )


def moving_average(rows: DataFrame, value: str, order: str, key: str, width: int = WINDOWS[0]) -> DataFrame:
    """key, x, average of full frames only; x is the place of the frame's middle (0-based)."""
    w = Window.partitionBy(key).orderBy(order)
    frame = w.rowsBetween(-(width - 1), 0)
    held = rows.select(key, (F.row_number().over(w) - width + width // 2).cast("bigint").alias("x"), F.avg(value).over(frame).alias("average"), F.count(F.lit(1)).over(frame).alias("_n"))
    return held.where(F.col("_n") == width).drop("_n")


def durations(rows: DataFrame, at: str, key: str, order: str) -> DataFrame:
    """rows with `seconds` since the round before (the first: the mean of the others) and whether that is above the mean."""
    w = Window.partitionBy(key).orderBy(order)
    everything = Window.partitionBy(key)
    gap = F.timestamp_diff("MICROSECOND", F.lag(at).over(w), F.col(at)) / 1e6
    held = rows.withColumn("_gap", gap).withColumn("_mean", F.avg("_gap").over(everything))
    return held.withColumn("seconds", F.coalesce("_gap", "_mean")).withColumn("above", F.col("seconds") > F.col("_mean")).drop("_gap", "_mean")


def first_read_range(log: DataFrame) -> DataFrame:
    """round, first_line, last_line of the first tool call that reads lines; 0, 0 without one."""
    call = F.get("tool_calls", F.lit(0))
    start, count = call["args"]["start"].cast("bigint"), call["args"]["count"].cast("bigint")
    has = start.isNotNull() & count.isNotNull()
    return log.select("round", F.when(has, start).otherwise(0).alias("first_line"), F.when(has, start + count - 1).otherwise(0).alias("last_line"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("total"), F.avg("tokens").alias("mean"), F.max("tokens").alias("most"), F.count_distinct("agent").alias("agents"))


def presence(log: DataFrame, agents: list[str]) -> DataFrame:
    """entries, entries with tool calls, and entries with each agent."""
    return log.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.size(F.coalesce("tool_calls", F.array())) > 0).alias("with_calls"), *(F.count_if(F.map_contains_key("agents", a)).alias(f"with_{a}") for a in agents))


def counters() -> list[Column]:
    """Sums over a run: rounds, calls of tools, tokens (the first agent's only, as a run reports them), rounds that were reviewed, rounds that were corrected."""
    return [
        F.count(F.lit(1)).alias("rounds"),
        F.coalesce(F.sum(F.size(F.coalesce("tool_calls", F.array())).cast("bigint")), F.lit(0).cast("bigint")).alias("tool_calls"),
        F.coalesce(F.sum(F.col("agents")["Labeler"]["total_tokens"]), F.lit(0).cast("bigint")).alias("tokens"),
        F.count_if(F.col("risk_review").isNotNull()).alias("reviewed"),
        F.count_if(F.coalesce(F.col("result.corrected"), F.lit(False))).alias("corrected"),
    ]


def run_counters(log: DataFrame) -> DataFrame:
    return log.agg(*counters())


def observed(log: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """log, and the counters of the first action on it: they cost no pass of their own."""
    seen = Observation(name)
    return log.observe(seen, *counters()), seen
