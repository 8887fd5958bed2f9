"""Stateful streams: the evidence vault and speaker expectations per document, and windows over run events.

State lives in the state store and is saved with every micro-batch, so a restarted query goes on where it was. Rows of a micro-batch come in any order: they are
sorted by their position first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import new_path

VAULT_OUT = "name string, aliases string, status string, evidence bigint, introduction_line bigint, last_seen_line bigint"
VAULT_STATE = "aliases array<string>, verified boolean, lines array<bigint>, introduction_line bigint, last_seen_line bigint"


def _fold_vault(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    name = key[0]
    aliases, verified, lines, first, last = state.get if state.exists else ([], False, [], None, 0)
    aliases, lines = list(aliases), set(lines)
    for row in pd.concat(list(batches)).sort_values("ord").itertuples():
        if row.alias and row.alias != name and row.alias not in aliases:
            aliases.append(row.alias)
        lines.add(int(row.line_no))
        verified = verified or bool(row.verified)
        if row.introduces:
            first = int(row.line_no) if first is None else min(first, int(row.line_no))
        last = max(last, int(row.line_no))
    state.update((aliases, verified, sorted(lines), first, last))
    yield pd.DataFrame({"name": [name], "aliases": ["|".join(aliases)], "status": ["verified" if verified else "candidate"], "evidence": [len(lines)], "introduction_line": pd.array([first], "Int64"), "last_seen_line": [last]})


def vault_updates(evidence: DataFrame) -> DataFrame:
    """Evidence rows (name, alias, verified, line_no, introduces, ord) as they arrive -> the character's state after each micro-batch (update mode)."""
    return evidence.groupBy("name").applyInPandasWithState(_fold_vault, VAULT_OUT, VAULT_STATE, "update", GroupStateTimeout.NoTimeout)


TURN_OUT = "key bigint, turn bigint, speaker string, expected string, violation boolean"


def _fold_turns(rounds: int):
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        from .rhythm import expected_next

        seen, due, early = state.get if state.exists else ([], 0, [])
        seen, out = list(seen), []
        held = {int(e["turn"]): e["speaker"] for e in (x if isinstance(x, dict) else x.asDict() for x in early)}
        for row in pd.concat(list(batches)).itertuples():
            held[int(row.turn)] = row.speaker
        while due in held:
            speaker, expected = held.pop(due), expected_next(seen)
            out.append((key[0], due, speaker, expected, expected is not None and expected != speaker))
            seen, due = [*seen, speaker][-rounds:], due + 1
        state.update((seen, due, [{"turn": t, "speaker": s} for t, s in sorted(held.items())]))
        yield pd.DataFrame(out, columns=["key", "turn", "speaker", "expected", "violation"])

    return fold


def turn_expectations(turns: DataFrame, rounds: int = 20) -> DataFrame:
    """Turns (key, turn, speaker), numbered from 0, as they arrive -> whose turn was expected (append mode). A turn waits until all before it have come."""
    state = "seen array<string>, due bigint, early array<struct<turn:bigint,speaker:string>>"
    return turns.groupBy("key").applyInPandasWithState(_fold_turns(rounds), TURN_OUT, state, "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; rows later than `late` are left out by the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, at: str = "ts", width: str = "2 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width, step)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, at: str = "ts", gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Runs of a user's events with no gap of that length."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def drained(stream: DataFrame, mode: str, keys: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """All that the source has now, as a table in the shared folder: for tests and for sources that end. A micro-batch has a folder of its own, so one that runs again after a restart
    replaces itself. In update mode the last row of each key counts; in complete mode the last micro-batch."""
    spark = stream.sparkSession
    path = path or new_path(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/table")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{path}/table")
    if mode == "update":
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("last")).select("last.*")
    return rows.select(*stream.columns)
