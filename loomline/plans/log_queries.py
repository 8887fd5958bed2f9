"""Queries over run logs: events stand for rounds, their type for the agent, and log entries are read from JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import runlog
from ..session import new_path, table
from ..sources import readers, writers
from .base import Registered

REGISTERED = query = Registered()
AGENTS = ["click", "error", "purchase", "signup", "view"]
_ROWS = "r AS (SELECT event_id // 10 AS round, event_type AS agent, CAST(round(value * 100) AS BIGINT) AS tokens, event_id % 3 AS tool_calls FROM events)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.expr("event_id div 10").alias("round"), F.col("event_type").alias("agent"), F.round(F.col("value") * 100).cast("bigint").alias("tokens"), (F.col("event_id") % 3).alias("tool_calls"))


def _columns(alias: str) -> str:
    return ", ".join(f"CAST(coalesce(sum({alias}) FILTER (agent = '{a}'), 0) AS BIGINT) AS {a}_{alias}" for a in AGENTS)


@query(f"WITH {_ROWS} SELECT round, {_columns('tokens')}, {_columns('tool_calls')} FROM r GROUP BY round")
def agent_pivot(spark, sf_dir):
    return runlog.agent_pivot(_rows(spark, sf_dir), AGENTS)


@query(f"WITH {_ROWS} SELECT DISTINCT agent FROM r")
def agent_names(spark, sf_dir):
    return runlog.agents_of(_rows(spark, sf_dir))


@query(f"""WITH {_ROWS} SELECT agent, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(tokens) / greatest(count(*) FILTER (tokens > 0), 1), 6) AS mean_tokens,
  count(*) FILTER (tokens > 0) AS active_rounds, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, count(*) FILTER (tool_calls > 0) AS rounds_with_calls FROM r GROUP BY agent""")
def agent_statistics(spark, sf_dir):
    return runlog.agent_statistics(_rows(spark, sf_dir)).withColumn("mean_tokens", F.round("mean_tokens", 6))


@query(f"""WITH {_ROWS} SELECT round // 50 AS bin, count(*) AS n, round(avg(tokens), 6) AS mean_tokens, round(avg(tool_calls) * 100, 6) AS calls_rate,
  round(avg(CASE WHEN tool_calls > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS rounds_with_calls_rate, round(avg(least(tokens / 40960.0 * 100, 100.0)), 6) AS utilisation FROM r GROUP BY bin""")
def binned_stats(spark, sf_dir):
    rounded = ("mean_tokens", "calls_rate", "rounds_with_calls_rate", "utilisation")
    return runlog.binned(_rows(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in rounded})


@query("""WITH w AS (SELECT user_id, row_number() OVER o AS n, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS a FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, CAST(n - 20 + 10 AS BIGINT) AS x, round(a, 6) AS average FROM w WHERE n >= 20""")
def moving_average(spark, sf_dir):
    return runlog.moving_average(table(spark, sf_dir, "events"), "value", "event_id", "user_id").withColumn("average", F.round("average", 6))


@query("""WITH g AS (SELECT user_id, event_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), ts) / 1e6 AS gap FROM events),
m AS (SELECT *, avg(gap) OVER (PARTITION BY user_id) AS mean FROM g)
SELECT user_id, event_id, round(coalesce(gap, mean), 3) AS seconds FROM m""")
def round_duration(spark, sf_dir):
    rows = runlog.durations(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "ts", "user_id", "event_id")
    return rows.select("user_id", "event_id", F.round("seconds", 3).alias("seconds"))


@query("""WITH g AS (SELECT user_id, event_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), ts) / 1e6 AS gap FROM events),
m AS (SELECT *, avg(gap) OVER (PARTITION BY user_id) AS mean FROM g)
SELECT user_id, count(*) AS n, count(*) FILTER (gap > mean) AS above FROM m GROUP BY user_id""")
def above_average_rounds(spark, sf_dir):
    rows = runlog.durations(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "ts", "user_id", "event_id")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("above").alias("above"))


@query(f"WITH {_ROWS} SELECT count(*) AS n, CAST(sum(tokens) AS BIGINT) AS total, round(avg(tokens), 6) AS mean, max(tokens) AS most, count(DISTINCT agent) AS agents FROM r")
def log_totals(spark, sf_dir):
    return runlog.totals(_rows(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries as JSON text, parsed with the log's schema: every third round has calls of the older form, every other third of the newer one."""
    third, e = F.col("event_id") % 3, F.col("event_id").cast("string")
    calls = (
        F.when(third == 0, F.concat(F.lit('[{"round": 1, "tool_calls": [{"function": "a", "arguments": "{}"}, {"function": "b", "arguments": "{}"}]}]')))
        .when(third == 1, F.concat(F.lit('[{"round": 1, "function": "read_novel_lines", "args": {"start": '), F.col("user_id").cast("string"), F.lit(', "count": "5"}}]')))
        .otherwise(F.lit("[]"))
    )
    agent = F.concat(F.lit('{"Labeler": {"agent": "Labeler", "prompt_eval_count": '), F.col("user_id").cast("string"), F.lit(', "eval_count": 7, "total_tokens": 0}'), F.when(F.col("event_id") % 5 == 0, F.lit(', "Verifier": {"agent": "Verifier", "total_tokens": 11}')).otherwise(F.lit("")), F.lit("}"))
    text = F.concat(F.lit('{"round": '), e, F.lit(', "agents": '), agent, F.lit(', "tool_calls": '), calls, F.lit("}"))
    return table(spark, sf_dir, "events").select(F.from_json(text, readers.LOG_SCHEMA).alias("x")).select("x.*")


_CALLS = "CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END"


@query(f"""SELECT event_id::INT AS round, 'Labeler' AS agent, user_id + 7 AS tokens, ({_CALLS})::BIGINT AS tool_calls FROM events
UNION ALL SELECT event_id::INT, 'Verifier', 11, ({_CALLS})::BIGINT FROM events WHERE event_id % 5 = 0""")
def tool_counts(spark, sf_dir):
    return runlog.agent_rows(_log(spark, sf_dir))


@query("SELECT event_id::INT AS round, CASE WHEN event_id % 3 = 1 THEN user_id ELSE 0 END AS first_line, CASE WHEN event_id % 3 = 1 THEN user_id + 4 ELSE 0 END AS last_line FROM events")
def read_range(spark, sf_dir):
    return runlog.first_read_range(_log(spark, sf_dir))


@query('SELECT count(*) AS entries, count(*) FILTER (event_id % 3 < 2) AS with_calls, count(*) AS "with_Labeler", count(*) FILTER (event_id % 5 = 0) AS "with_Verifier" FROM events')
def log_presence(spark, sf_dir):
    return runlog.presence(_log(spark, sf_dir), ["Labeler", "Verifier"])


@query("SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k, CAST(coalesce(props ->> 'missing', '-1') AS BIGINT) AS missing FROM events")
def json_props(spark, sf_dir):
    value = F.from_json("props", "k bigint, missing bigint")
    return table(spark, sf_dir, "events").select("event_id", value["k"].alias("k"), F.coalesce(value["missing"], F.lit(-1).cast("bigint")).alias("missing"))


@query("""WITH e AS (SELECT event_id, user_id * 37 + event_id AS s, user_id % 9 - 1 AS c FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh%02dm', s // 3600, s // 60 % 60) ELSE printf('%dm%02ds', s // 60, s % 60) END AS took,
  CAST(least(greatest(CASE WHEN c = 0 THEN 1 ELSE c END, 0), 5) AS BIGINT) AS reach, s + 2048 > 40000 AS over FROM e""")
def scalar_functions(spark, sf_dir):
    s, c = F.col("user_id") * 37 + F.col("event_id"), F.col("user_id") % 9 - 1
    return table(spark, sf_dir, "events").select("event_id", fn.duration(s).alias("took"), fn.clamp(c, 0, 5).cast("bigint").alias("reach"), fn.over_budget(s).alias("over"))


@query("SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY conv_id")
def message_length(spark, sf_dir):
    message = F.struct("role", F.col("text").alias("content"), F.lit(None).cast("array<string>").alias("tool_calls"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(message).alias("messages"))
    return grouped.select("conv_id", fn.message_length(F.col("messages")).cast("bigint").alias("characters"))


@query("SELECT event_id AS idx, user_id AS doc_id, event_type AS label FROM events")
def label_sink(spark, sf_dir):
    """Labels appended in two parts, the second one twice: rows already there are not added again."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("label"))
    path = new_path(spark, "labels")
    writers.append_labels(rows.where("idx % 2 = 0"), path)
    for _ in range(2):
        writers.append_labels(writers.new_labels(rows, spark.read.parquet(path)), path)
    return spark.read.parquet(path)


@query("SELECT event_id::INT AS round, event_type AS dialogue_text, user_id::INT AS dialogue_line FROM events")
def log_sink(spark, sf_dir):
    """Rounds written as JSON lines and read back with the log's schema."""
    rounds = table(spark, sf_dir, "events").select(F.col("event_id").cast("int").alias("round"), F.col("user_id").cast("int").alias("dialogue_line"), F.col("event_type").alias("dialogue_text"))
    path = new_path(spark, "log")
    writers.append_rounds(rounds, path)
    return readers.run_log(spark, path).select("round", "dialogue_line", "dialogue_text")


@query(f"WITH {_ROWS} SELECT round, {_columns('tokens')}, {_columns('tool_calls')} FROM r GROUP BY round")
def statistics_sink(spark, sf_dir):
    pivot = agent_pivot(spark, sf_dir)
    path = new_path(spark, "statistics")
    writers.statistics_csv(pivot, path)
    return spark.read.schema(pivot.schema).csv(path, header=True)


@query("SELECT user_id, event_id // 500 AS chunk, count(*) AS n FROM events GROUP BY ALL")
def curation_batches(spark, sf_dir):
    """Count-based tumbling batches: every 500 rounds."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.expr("event_id div 500").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS rounds, CAST(sum(event_id % 3) AS BIGINT) AS tool_calls, CAST(sum(user_id) AS BIGINT) AS tokens,
  count(*) FILTER (event_id % 4 = 0) AS reviewed, count(*) FILTER (event_id % 8 = 0) AS corrected FROM events""")
def run_counters(spark, sf_dir):
    case, user = F.col("event_id"), F.col("user_id").cast("string")
    calls = F.concat(F.lit('"tool_calls": ['), F.array_join(F.array_repeat(F.lit('{"function": "a"}'), (case % 3).cast("int")), ", "), F.lit("]"))
    agents = F.concat(F.lit('"agents": {"Labeler": {"total_tokens": '), user, F.lit('}, "Verifier": {"total_tokens": 11}}'))
    review = F.when(case % 4 == 0, F.lit(', "risk_review": {"verdict": "agree"}')).otherwise("")
    result = F.concat(F.lit(', "result": {"speaker": "x", "corrected": '), (case % 8 == 0).cast("string"), F.lit("}}"))
    text = F.concat(F.lit('{"round": 1, '), agents, F.lit(", "), calls, review, result)
    return runlog.run_counters(table(spark, sf_dir, "events").select(F.from_json(text, readers.LOG_SCHEMA).alias("x")).select("x.*"))
