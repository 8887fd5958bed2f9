"""Context of ordered lines: search, ranges, neighbourhoods, as-of lookups, islands, batches.

Rows are (key, line_no, line); windows are per key, so documents are independent and a long table splits by key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import INTRODUCTIONS, OPEN_QUOTE, any_of, reveal_after, reveals_after, strip
from .roster import WIDTHS, Roster, head_width, window_codes

NAVIGATION_RANGE, NAVIGATION_LENGTH = 25, 120
NARRATIVE_LINES = 5
MATCHES, MATCH_CHARACTERS = 8, 12_000
REFERENCES = 10
IDENTITY_FORWARD, IDENTITY_BACKWARD, IDENTITY_NEAR, IDENTITY_NAMES = 200, 100, 50, 15
BATCH_GAP = 10
# What a search says beside its lines.
SEARCH_MARKS = (">>>", "   ")
SEARCH_CUT = "\n...(search result truncated; use a narrower keyword or read_novel_lines around a specific line)"
SEARCH_MORE = "\n...(showing first %d of %d matches; use a narrower keyword or read_novel_lines around a specific line)"
SEARCH_NONE = "(No matches for '%s')"
#: Bytes of terms that are broadcast at most.
ROSTER_BYTES = 64 << 20


def _order(key: str):
    return Window.partitionBy(key).orderBy("line_no")


def line_kind(line: Column, mark: str = OPEN_QUOTE) -> Column:
    """D: dialogue, N: narrative."""
    return F.when(line.contains(mark), "D").otherwise("N")


def joined_lines(df: DataFrame, keys: list[str], line: Column, separator: str = "\n", name: str = "text") -> DataFrame:
    """One text per group, lines in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", line.alias("_line")))), lambda x: x["_line"])
    return df.groupBy(*keys).agg(F.array_join(ordered, separator).alias(name))


def read_range(rows: DataFrame, start: int, count: int, key: str = "doc_id") -> DataFrame:
    """key, text: lines start .. start + count - 1 as "n: line". A start below 1 begins at 1: it does not wrap to the text's end."""
    first = max(1, start)
    some = rows.where(F.col("line_no").between(first, start + count - 1))
    numbered = F.concat(F.col("line_no").cast("string"), F.lit(": "), F.col("line"))
    return joined_lines(some, [key], numbered).withColumn("text", F.regexp_replace("text", r"(?U)\s+$", ""))


def keyword_hits(rows: DataFrame, keyword: str, key: str = "doc_id", limit: int | None = MATCHES) -> DataFrame:
    """Lines with the keyword: key, line_no, hit_no, total. An empty keyword is in every line."""
    hits = rows.where(F.col("line").contains(keyword))
    number, total = F.row_number().over(_order(key)), F.count(F.lit(1)).over(Window.partitionBy(key))
    found = hits.select(key, "line_no", number.cast("bigint").alias("hit_no"), total.alias("total"))
    return found if limit is None else found.where(F.col("hit_no") <= limit)


def keyword_in_context(rows: DataFrame, keyword: str, context: int = 1, key: str = "doc_id", limit: int = MATCHES) -> DataFrame:
    """The first hits with `context` (0 to 5; 0 counts as 1) lines around each; blocks may overlap. One equi-join: each hit is spread over its lines."""
    reach = max(0, min(context or 1, 5))
    hits = keyword_hits(rows, keyword, key, limit)
    spread = hits.select(key, "hit_no", "total", F.col("line_no").alias("hit_line"), F.explode(F.sequence(F.col("line_no") - reach, F.col("line_no") + reach)).alias("line_no"))
    return spread.join(rows, [key, "line_no"]).select(key, "hit_no", "hit_line", "line_no", "line", "total")


def context_block(found: DataFrame, key: str = "doc_id", characters: int = MATCH_CHARACTERS, separator: str = "\n---\n", marks: tuple[str, str] = (">>", "  "), cut: str = "") -> DataFrame:
    """Blocks of keyword_in_context() as one text per key, cut at a number of characters; `cut` follows a text that was."""
    marked = F.concat(F.when(F.col("line_no") == F.col("hit_line"), marks[0]).otherwise(marks[1]), F.col("line_no").cast("string"), F.lit(": "), F.col("line"))
    blocks = joined_lines(found, [key, "hit_no", "total"], marked, name="block")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hit_no", "block"))), lambda x: x["block"]), separator)
    whole = blocks.groupBy(key).agg(text.alias("text"), F.max("total").alias("total"), F.count(F.lit(1)).alias("shown"))
    return whole.withColumn("text", F.when(F.length("text") > characters, F.concat(F.left("text", F.lit(characters)), F.lit(cut))).otherwise(F.col("text")))


def search_text(rows: DataFrame, keyword: str, context: int = 1, key: str = "doc_id", limit: int = MATCHES, characters: int = MATCH_CHARACTERS) -> DataFrame:
    """key, text for every key of rows: the blocks of the first hits, and a notice where there is none, where the text was cut, where there are more hits."""
    found = keyword_in_context(rows, keyword, context, key, limit).withColumn("line", F.regexp_replace("line", r"(?U)\s+$", ""))
    blocks = context_block(found, key, characters, marks=SEARCH_MARKS, cut=SEARCH_CUT)
    more = F.when(F.col("total") > F.col("shown"), F.format_string(SEARCH_MORE, "shown", "total")).otherwise("")
    return rows.select(key).distinct().join(blocks, key, "left").select(key, F.coalesce(F.concat("text", more), F.lit(SEARCH_NONE % keyword)).alias("text"))


def pattern_hits(rows: DataFrame, patterns: Iterable[str] = INTRODUCTIONS, key: str = "doc_id") -> DataFrame:
    """One row per line and pattern in it."""
    listed = F.explode(F.array(*map(F.lit, patterns))).alias("pattern")
    return rows.where(any_of(F.col("line"), patterns)).select(key, "line_no", "line", listed).where("contains(line, pattern)")


def navigation(rows: DataFrame, targets: DataFrame, reach: int = NAVIGATION_RANGE, length: int = NAVIGATION_LENGTH, mark: str = OPEN_QUOTE, quotes: tuple[str, str] = ("「", "」"), key: str = "doc_id") -> DataFrame:
    """key, target, line_no, text: the lines around each target, cut, the target marked, dialogue in quotes and narrative tagged."""
    wide = targets.select(key, F.col("line_no").alias("target"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("line_no") - reach), F.col("line_no") + reach)).alias("line_no"))
    body = F.left(strip(F.col("line")), F.lit(length))
    shown = F.when(line_kind(F.col("line"), mark) == "D", F.concat(F.lit(quotes[0]), body, F.lit(quotes[1]))).otherwise(F.concat(F.lit("[narr] "), body))
    text = F.concat(F.when(F.col("line_no") == F.col("target"), ">> ").otherwise("   "), F.lit("L"), F.col("line_no").cast("string"), F.lit(": "), shown)
    return wide.join(rows, [key, "line_no"]).select(key, "target", "line_no", text.alias("text"))


def narrative_before(rows: DataFrame, count: int = NARRATIVE_LINES, mark: str = OPEN_QUOTE, key: str = "doc_id", separator: str = " | ") -> DataFrame:
    """rows with `before`: the narrative of up to `count` preceding lines, back to the last dialogue line; blank lines are skipped."""
    seen = F.collect_list(F.struct("line_no", "line")).over(_order(key).rowsBetween(-count, -1))
    stop = lambda a: F.coalesce(F.array_max(F.transform(F.filter(a, lambda x: x["line"].contains(mark)), lambda x: x["line_no"])), F.lit(0))
    held = rows.withColumn("_seen", seen).withColumn("_stop", stop(F.col("_seen")))
    kept = F.filter("_seen", lambda x: (x["line_no"] > F.col("_stop")) & (strip(x["line"]) != ""))
    return held.withColumn("before", F.array_join(F.transform(kept, lambda x: strip(x["line"])), separator)).drop("_seen", "_stop")


def blocks(rows: DataFrame, mark: str = OPEN_QUOTE, key: str = "doc_id") -> DataFrame:
    """key, kind, first_line, last_line, lines: runs of narrative lines as one row, dialogue lines one by one."""
    kind = line_kind(F.col("line"), mark)
    tagged = rows.select(key, "line_no", kind.alias("kind"))
    begins = ((F.col("kind") == "D") | (F.lag("kind", 1, "D").over(_order(key)) == "D")).cast("int")
    numbered = tagged.withColumn("_begins", begins).withColumn("_block", F.sum("_begins").over(_order(key)))
    return numbered.groupBy(key, "_block", "kind").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count(F.lit(1)).alias("lines")).drop("_block")


def reveal_as_of(rows: DataFrame, revealed: Column | None = None, key: str = "doc_id") -> DataFrame:
    """rows with `name` and `reveal_line`: the first name that a later line reveals. Lines are read from the last one back, so each is visited once."""
    found = rows.withColumn("_name", reveal_after(F.col("line")) if revealed is None else revealed)
    later = Window.partitionBy(key).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.last(F.when(F.col("_name").isNotNull(), F.struct("_name", "line_no")), True).over(later)
    return found.withColumn("_hit", hit).select(*rows.columns, F.col("_hit._name").alias("name"), F.col("_hit.line_no").alias("reveal_line"))


def reveal_for(rows: DataFrame, targets: DataFrame, revealed: Column | None = None, key: str = "doc_id") -> DataFrame:
    """For targets (key, line_no, descriptor): the first name in later lines that is not the descriptor itself, with its line. `revealed`: array of the names in a line.

    No pairs of targets and lines are made. The next revealing line answers, unless it has the descriptor as its only name; then the answer is in the first line after the run of
    such lines, which every line of the run knows.
    """
    names = F.array_distinct(reveals_after(F.col("line")) if revealed is None else F.array_compact(revealed))
    found = rows.select(key, "line_no", names.alias("names")).where("size(names) > 0").withColumn("lone", F.when(F.size("names") == 1, F.get("names", F.lit(0))))
    order = _order(key)
    begins = (~F.coalesce(F.lag("lone").over(order) == F.col("lone"), F.lit(False))).cast("int")
    found = found.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order))
    runs = found.groupBy(key, "_run").agg(F.min(F.struct("line_no", "names")).alias("head"))
    runs = runs.select(key, "_run", F.lead("head").over(Window.partitionBy(key).orderBy("_run")).alias("after"))
    hits = found.join(runs, [key, "_run"]).select(key, "line_no", F.struct("line_no", "names", "after").alias("hit"), F.lit(None).cast("string").alias("descriptor"), F.lit(0).alias("asks"))
    asked = targets.select(key, "line_no", F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"), F.col("descriptor").cast("string").alias("descriptor"), F.lit(1).alias("asks"))
    later = Window.partitionBy(key).orderBy(F.desc("line_no"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    met = asked.unionByName(hits).withColumn("next", F.last("hit", True).over(later)).where("asks = 1")
    other = lambda names: F.get(F.filter(names, lambda x: ~x.eqNullSafe(F.col("descriptor"))), F.lit(0))
    met = met.withColumns({"first": other(F.col("next.names")), "second": other(F.col("next.after.names"))})
    line = F.when(F.col("first").isNotNull(), F.col("next.line_no")).when(F.col("second").isNotNull(), F.col("next.after.line_no"))
    return met.select(key, "line_no", "descriptor", F.coalesce("first", "second").alias("name"), line.alias("reveal_line"))


def _around(rows: DataFrame, targets: DataFrame, at: str, before: int, after: int, key: str) -> DataFrame:
    """rows joined to the targets that have them between `before` lines before and `after` lines after targets[at]. Lines and targets meet by blocks of lines, in an equi-join: a target is
    sent to the two or three blocks that it reaches."""
    size = max(16, before + after + 1)
    block = lambda x: F.floor(x / size)
    wide = targets.withColumn("_block", F.explode(F.sequence(block(F.col(at) - before), block(F.col(at) + after))))
    return rows.withColumn("_block", block(F.col("line_no"))).join(wide, [key, "_block"]).where(F.col("line_no").between(F.col(at) - before, F.col(at) + after)).drop("_block")


def deep_search(rows: DataFrame, targets: DataFrame, patterns: Iterable[str] = INTRODUCTIONS, forward: int = IDENTITY_FORWARD, backward: int = IDENTITY_BACKWARD, near: int = IDENTITY_NEAR, names: int = IDENTITY_NAMES, key: str = "doc_id") -> DataFrame:
    """Around targets (key, around, name): introduction lines, with a near flag, and the first lines with the name, with the total. kind: intro or name."""
    t = targets.select(key, "around", "name")
    close = (F.abs(F.col("line_no") - F.col("around")) < near).alias("near")
    group = Window.partitionBy(key, "around", "name")
    said = rows.where(any_of(F.col("line"), patterns)).select(key, "line_no", "line", F.explode(F.array(*map(F.lit, patterns))).alias("pattern")).where("contains(line, pattern)").drop("line")
    intro = _around(said, t, "around", backward, forward - 1, key).select(key, "around", "name", F.lit("intro").alias("kind"), "line_no", close, F.count(F.lit(1)).over(group).alias("total"))
    named = _around(rows, t, "around", backward, forward - 1, key).where("contains(line, name)")
    named = named.select(key, "around", "name", F.lit("name").alias("kind"), "line_no", close, F.count(F.lit(1)).over(group).alias("total"), F.row_number().over(group.orderBy("line_no")).alias("_n"))
    return intro.unionByName(named.where(F.col("_n") <= names).drop("_n"))


def investigate(rows: DataFrame, targets: DataFrame, patterns: Iterable[str] = INTRODUCTIONS, revealed: Column | None = None, key: str = "doc_id") -> DataFrame:
    """Who a descriptor is: targets (key, line_no, descriptor) with found, name, status, introduction_line and evidence.

    A later line that reveals another name makes a verified identity, with that line as evidence; else lines that introduce someone near the target leave a candidate; else nothing is found.
    """
    t = targets.select(key, "line_no", "descriptor")
    shown = reveal_for(rows, t, revealed, key)
    close = deep_search(rows, t.select(key, F.col("line_no").alias("around"), F.col("descriptor").alias("name")), patterns, key=key).where("kind = 'intro' and near")
    close = close.groupBy(key, F.col("around").alias("line_no"), F.col("name").alias("descriptor")).agg(F.count_distinct("line_no").alias("introductions"))
    same = [shown[c].eqNullSafe(close[c]) for c in (key, "line_no", "descriptor")]
    joined = shown.join(close, same[0] & same[1] & same[2], "left").select(*(shown[c] for c in shown.columns), F.coalesce("introductions", F.lit(0)).alias("introductions"))
    status = F.when(F.col("name").isNotNull(), "verified").when(F.col("introductions") > 0, "candidate").otherwise("unknown")
    return joined.select(key, "line_no", "descriptor", F.col("name").isNotNull().alias("found"), "name", status.alias("status"), F.col("reveal_line").alias("introduction_line"), "introductions")


def first_rows(rows: DataFrame, count: int, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """The first `count` rows of each key, in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= count).drop("_n")


def gap_batches(spans: DataFrame, key: str, order: str, position: str, gap: int = BATCH_GAP, size: int | None = None) -> DataFrame:
    """spans with `batch` (from 0): a new one starts where the distance to the previous position is over the gap; size cuts batches further."""
    w = Window.partitionBy(key).orderBy(order)
    begins = F.coalesce((F.col(position) - F.lag(position).over(w) > gap).cast("bigint"), F.lit(0))
    out = spans.withColumn("_begins", begins).withColumn("batch", F.sum("_begins").over(w)).drop("_begins")
    if size is None:
        return out
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(key, "batch").orderBy(order))).where(F.col("_n") <= size).drop("_n")


def next_batch(spans: DataFrame, done: DataFrame, key: str, order: str, position: str, size: int = 1, gap: int = BATCH_GAP) -> DataFrame:
    """The spans to label next: from the first unlabeled one up to `size`, ending at the first gap."""
    open_spans = spans.join(done.select(key, "labeled"), key, "left").where(F.col(order) >= F.coalesce("labeled", F.lit(0))).drop("labeled")
    return gap_batches(open_spans, key, order, position, gap, size).where("batch = 0").drop("batch")


def leaks(rows: DataFrame, terms: DataFrame, key: str = "doc_id", bound: int = ROSTER_BYTES) -> DataFrame:
    """key, line_no, term of lines that contain a term, at any offset. A roster of up to `bound` bytes is broadcast as an index (Roster); of a larger one only
    the heads' hashes meet those of the lines' windows, by a shuffle. Whole terms are compared in both. An empty term is in every line, a null in none."""
    t = terms.select(F.col("term").cast("string").alias("term")).where("term is not null").distinct()
    held = t.agg(F.sum(F.octet_length("term")).alias("n")).first().n or 0
    lines = rows.select(key, "line_no", "line").where("line is not null")
    out = StructType([lines.schema[key], lines.schema["line_no"], StructField("term", StringType())])
    if held <= bound:
        sent = rows.sparkSession.sparkContext.broadcast(sorted(r.term.encode() for r in t.collect()))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            roster = Roster(sent.value)
            for part in batches:
                line, term = roster.found(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0).take(line), part.column(1).take(line), term], names=out.names)

        return lines.mapInArrow(search, out)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            values = [x.as_py().encode() for x in part.column(0)]
            widths = list(map(head_width, values))
            hashes = [int(window_codes(np.frombuffer(v, np.uint8, w), w)[0]) if w else 0 for v, w in zip(values, widths)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(widths, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64))], names=["term", "_width", "_code"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for i, value in enumerate(part.column(2)):
                data = np.frombuffer(value.as_py().encode(), np.uint8)
                codes = [np.zeros(1, np.uint64), *(np.unique(window_codes(data, w)) for w in WIDTHS)]
                at, n = pa.array([i] * sum(map(len, codes)), pa.int64()), np.repeat([0, *WIDTHS], [len(c) for c in codes])
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(n, pa.int32()), pa.array(np.concatenate(codes).view(np.int64))], names=[*out.names[:2], "_width", "_code"])

    coded = t.mapInArrow(heads, "term string, _width int, _code long")
    seen = lines.mapInArrow(windows, StructType([*out.fields[:2], StructField("_width", IntegerType()), StructField("_code", LongType())]))
    near = seen.join(coded, ["_width", "_code"]).select(F.col(key).alias("_key"), F.col("line_no").alias("_line_no"), "term").distinct()
    both = F.col(key).eqNullSafe(F.col("_key")) & F.col("line_no").eqNullSafe(F.col("_line_no"))
    return lines.join(near, both).where("contains(line, term)").select(key, "line_no", "term")


def block_map(rows: DataFrame, targets: DataFrame, reach: int = 40, mark: str = OPEN_QUOTE, span: str = "「([^」]+)」", quotes: tuple[str, str] = ("「", "」"), cut: int = 40, key: str = "doc_id") -> DataFrame:
    """key, target, text: the lines around each target as a map, runs of narrative as one line, dialogue by its first span."""
    wide = _around(rows, targets.select(key, F.col("line_no").alias("target")), "target", reach, reach, key)
    w = Window.partitionBy(key, "target").orderBy("line_no")
    tagged = wide.withColumn("kind", line_kind(F.col("line"), mark))
    begins = ((F.col("kind") == "D") | (F.lag("kind", 1, "D").over(w) == "D")).cast("int")
    numbered = tagged.withColumn("_begins", begins).withColumn("_block", F.sum("_begins").over(w))
    runs = numbered.groupBy(key, "target", "_block", "kind").agg(F.min("line_no").alias("line_no"), F.max("line_no").alias("last"), F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    said = F.regexp_extract("line", span, 1)
    shown = F.concat(F.left(said, F.lit(cut)), F.when(F.length(said) > cut, F.lit("...")).otherwise(F.lit("")))
    dialogue = F.concat(F.lit("  "), F.when(F.col("line_no") == F.col("target"), "->").otherwise("  "), F.format_string("L%d [D] ", F.col("line_no")), F.lit(quotes[0]), shown, F.lit(quotes[1]))
    narrative = F.format_string("     L%d-L%d [N] (%d lines)", F.col("line_no"), F.col("last"), F.col("n"))
    return joined_lines(runs, [key, "target"], F.when(F.col("kind") == "D", dialogue).otherwise(narrative))


def resume_range(spans: DataFrame, done: DataFrame, start: int = 0, count: int | None = None, key: str = "doc_id", order: str = "span_idx") -> DataFrame:
    """The spans a run works on: from `start` if it is over 0, else from the number of labels already there; `count` of them."""
    held = spans.join(done.select(key, "labeled"), key, "left").withColumn("_from", F.lit(start) if start > 0 else F.coalesce("labeled", F.lit(0)))
    rows = held.where(F.col(order) >= F.col("_from"))
    return (rows if count is None else rows.where(F.col(order) < F.col("_from") + count)).drop("labeled", "_from")
