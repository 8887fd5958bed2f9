"""Scans: ordered lines, delimited spans, answer and label files, JSON run logs, term lists, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ANSWER_MARK, SPAN, quoted, strip

#: Rounds of a run, one JSON object a line. Tool calls of both log versions fit.
LOG_SCHEMA = """
round int, dialogue_line int, dialogue_text string, `timestamp` string,
agents map<string, struct<agent:string, role:string, input_summary:string, response:string,
  prompt_eval_count:bigint, eval_count:bigint, total_tokens:bigint,
  tool_calls_detail:array<struct<round:int,function:string,args:string,prompt_eval_count:bigint,eval_count:bigint>>,
  model_calls:array<struct<label:string,provider:string,model:string,model_label:string,tools_enabled:boolean,
    tool_choice:string,tool_calls:int,coerced_text_tool_call:boolean,prompt_eval_count:bigint,eval_count:bigint>>>>,
tool_calls array<struct<round:int, function:string, args:map<string,string>, prompt_eval_count:bigint, eval_count:bigint,
  tool_calls:array<struct<function:string,arguments:string>>>>,
boss_task struct<dialogue_line:int,dialogue_text:string,short_mem:string,evidence:string,navigation:string>,
risk_review struct<reasons:array<string>,verdict:string,suggested:string,reason:string>,
result struct<speaker:string,summary:string,reason:string,corrected:boolean>
"""
VAULT_SCHEMA = "map<string, struct<aliases:array<string>, status:string, evidence:array<struct<text:string,line:int,type:string>>, introduction_line:int, last_seen_line:int>>"


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", last_empty: bool = True) -> DataFrame:
    """key, line_no (from 1), line of every text; any line end. last_empty=False leaves out the empty line after a final line end."""
    body = F.regexp_replace(F.col(text), "\r\n?", "\n") if not last_empty else F.col(text)
    parts = F.split(body, "\n", -1)
    if not last_empty:
        parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return docs.select(key, F.posexplode(parts).alias("pos", "line")).select(key, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def spans(rows: DataFrame, key: str = "doc_id", order: str = "line_no", text: str = "line", pattern: str = SPAN) -> DataFrame:
    """key, span_idx (from 0, in order of line and place), order, pos, text of every match's first group."""
    found = rows.select(key, order, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("pos", "text"))
    number = F.row_number().over(Window.partitionBy(key).orderBy(order, "pos")) - 1
    return found.select(key, number.cast("bigint").alias("span_idx"), order, F.col("pos").cast("bigint").alias("pos"), "text")


def answers(text: Column, pattern: str = ANSWER_MARK) -> Column:
    """Every mark in the whole text: array of sets of stripped options."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda m: F.array_distinct(F.transform(F.split(m, r"\|"), strip)))


def answer_lines(rows: DataFrame, line: str = "line", pattern: str = ANSWER_MARK) -> DataFrame:
    """The first mark of each line only, options as they stand; lines without one are left out."""
    return rows.withColumn("_mark", F.regexp_extract(line, pattern, 1)).where("_mark <> ''").withColumn("accepted", F.split("_mark", r"\|")).drop("_mark")


def labels(rows: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """key, idx (from 0), label of the lines that are not blank."""
    kept = rows.withColumn("label", strip(F.col(line))).where("label <> ''")
    return kept.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("bigint").alias("idx"), "label")


def label_count(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Physical lines, blank ones too: where a run resumes."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("labeled"))


def run_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path, mode="FAILFAST" if strict else "PERMISSIVE")


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).json(path)


def vault(spark: SparkSession, path: str) -> DataFrame:
    """name and facts of the saved characters; none if the text is no JSON object."""
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<characters:{VAULT_SCHEMA}>").alias("v"))
    return read.select(F.explode(F.coalesce(F.col("v.characters"), F.map_from_arrays(F.array(), F.array()).cast(VAULT_SCHEMA))).alias("name", "facts")).select("name", "facts.*")


def terms(rows: DataFrame, line: str = "line", comments: bool = False) -> DataFrame:
    """Stripped lines that are not blank; those that begin with # only with comments=True."""
    kept = rows.select(strip(F.col(line)).alias("term")).where("term <> ''")
    return kept if comments else kept.where("term not like '#%'")


def source_files(spark: SparkSession, root: str, pattern: str = "*.py", leave_out: tuple[str, ...] = ()) -> DataFrame:
    """path, line of every file below root whose name matches."""
    files = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("line"))
    return files.where(~F.col("name").isin(*leave_out)) if leave_out else files


def settings(rows: DataFrame, line: str = "line", known: tuple[str, ...] = ()) -> DataFrame:
    """name, value of KEY=VALUE lines."""
    parts = F.split(F.col(line), "=", 2)
    found = rows.where(F.col(line).contains("=")).select(strip(parts[0]).alias("name"), strip(parts[1]).alias("value"))
    return found.where(F.col("name").isin(*known)) if known else found


def commented_json(text: Column, schema: str) -> Column:
    """The value of a JSON text in which lines that begin with // are comments; null fields if it is no such text. A // inside a line stays."""
    kept = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: ~strip(x).startswith("//"))
    return F.from_json(F.array_join(kept, "\n"), schema)


def assigned(text: Column, name: str) -> Column:
    """What the first NAME = "value" of a source text gives a name; null without one. With text.first_filled() settings take the first source that has them."""
    return F.nullif(F.regexp_extract(text, quoted(name) + r"""\s*=\s*["']([^"']+)["']""", 1), F.lit(""))
