"""Text predicates and parsers as Column functions; all stay inside generated code.

Unicode rules: white space is the Unicode class, lengths count code points, Han letters are the block U+4E00 to U+9FFF.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks, word lists and limits that results depend on.
OPEN_QUOTE = "「"
SPAN = "「([^」]+)」"
ANSWER_MARK = "【([^】]+)】"
HAN = "[一-鿿]"
BAD_NAME_PARTS = ("--", "—", "–", "根据", "原文", "禁止", "错误示例")
QUESTION_WORDS = ("什么", "啥", "谁", "哪个", "哪里", "为什么", "怎么")
TEMPORARY_NAMES = ("女孩", "少年", "老人", "大汉", "年轻人", "男孩", "少女", "妇人", "老妇", "男子", "女子", "青年", "孩子")
NON_PERSON = ("非人物发声", "non-human")
REVEAL_PATTERNS = ("咱的名字是", "我的名字是", "吾乃", "名字是")
INTRODUCTIONS = ("我叫", "咱是", "我是", "名字是", "吾乃", "咱的名字是")
NAME_END = "「」『』\"'。，！？、，：:；;）)] \t\r\n"
NAME_LENGTH, SHORT_LENGTH, SHORT_HAN = 15, 12, 4
REASON_LENGTH, FALLBACK_LENGTH = 200, 50


def strip(text: Column) -> Column:
    """Without white space at either end, by the Unicode class."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def quoted(term: str) -> str:
    """A Java pattern that matches the term itself."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def alternation(terms: Iterable[str]) -> str:
    return "|".join(quoted(t) for t in terms)


def any_of(text: Column, parts: Iterable[str]) -> Column:
    """Whether the text contains one of the parts."""
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def han_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HAN))


def valid_name(name: Column, limit: int = NAME_LENGTH, bad: Iterable[str] = BAD_NAME_PARTS) -> Column:
    """The stripped name, or null if it cannot be one: empty, too long, with white space, a description mark or a bracketed part."""
    clean = strip(name)
    wrong = any_of(clean, bad) | (F.length(clean) > limit) | clean.rlike(r"(?U)\s") | clean.rlike(r"[（(【\[].*[）)】\]]")
    return F.when((clean == "") | wrong, F.lit(None)).otherwise(clean)


def garbage_speaker(speaker: Column) -> Column:
    """Empty, with an ASCII letter, a question word, or without any Han letter."""
    s = F.coalesce(speaker, F.lit(""))
    return (s == "") | s.rlike("[a-zA-Z]") | s.isin(*QUESTION_WORDS) | ~s.rlike(HAN)


def temporary_name(name: Column, names: Iterable[str] = TEMPORARY_NAMES) -> Column:
    return name.isin(*names)


def short_or_fragment(text: Column, length: int = SHORT_LENGTH, han: int = SHORT_HAN) -> Column:
    clean = strip(F.coalesce(text, F.lit("")))
    return (F.length(clean) <= length) | (han_count(clean) <= han)


def tag(text: Column, name: str) -> Column:
    """Stripped body of the first such element; null without one."""
    pattern = f"(?s)<{name}>(.*?)</{name}>"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def parse_answer(text: Column, valid=valid_name) -> Column:
    """Body of <answer> if it is a valid name, else what stands before its first dash or bracket if that is one, else the body; without the
    element the first line, cut short."""
    body = tag(text, "answer")
    head = F.split(body, r"(?U)\s*[—\-–(（]", 2)[0]
    first_line = F.left(F.split(strip(text), "\n", 2)[0], F.lit(FALLBACK_LENGTH))
    return F.when(body.isNotNull(), F.coalesce(valid(body), valid(head), body)).otherwise(first_line)


def parse_summary(text: Column) -> Column:
    return F.coalesce(tag(text, "summary"), F.lit(""))


def parse_reason(text: Column) -> Column:
    return F.left(F.coalesce(tag(text, "reason"), F.lit("")), F.lit(REASON_LENGTH))


def parse_verdict(text: Column, labeled: Column, valid=valid_name) -> Column:
    """struct(verdict, speaker, reason): disagreement only by its literal element, and a suggestion only if it is a valid name."""
    disagree = text.contains("<verdict>disagree</verdict>")
    suggestion = F.coalesce(valid(tag(text, "suggested_speaker")), labeled)
    return F.struct(F.when(disagree, "disagree").otherwise("confirm").alias("verdict"), F.when(disagree, suggestion).otherwise(labeled).alias("speaker"), parse_reason(text).alias("reason"))


RESULT_SCHEMA = "found boolean, character string, aliases array<string>, introduction_line bigint, status string, evidence array<struct<text:string,line:bigint,type:string>>"


def parse_result(text: Column) -> Column:
    """The widest JSON object in free text; missing keys have defaults (introduction_line: null), and text that is no object is a result not found."""
    value = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), RESULT_SCHEMA)
    return F.struct(
        F.coalesce(value["found"], F.lit(False)).alias("found"),
        F.coalesce(value["character"], F.lit("")).alias("character"),
        F.coalesce(value["aliases"], F.array().cast("array<string>")).alias("aliases"),
        value["introduction_line"].alias("introduction_line"),
        F.coalesce(value["status"], F.lit("candidate")).alias("status"),
        F.coalesce(value["evidence"], F.array().cast("array<struct<text:string,line:bigint,type:string>>")).alias("evidence"),
    )


def arguments(value: Column, schema: str) -> Column:
    """Arguments of a call given as a JSON object or as a JSON string that holds one."""
    inner = F.get_json_object(F.concat(F.lit('{"x":'), value, F.lit("}")), "$.x")
    return F.from_json(F.when(F.ltrim(value).startswith('"'), inner).otherwise(value), schema)


#: Calls written as text; the groups are their arguments.
TEXT_CALLS = {
    "read_novel_lines": r"read_novel_lines\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)",
    "search_novel": r"search_novel\s*\(\s*['\"]([^'\"]+)['\"]\s*(?:,\s*(\d+))?\s*\)",
}


def parse_tool_call(text: Column) -> Column:
    """A call written as text, read_novel_lines(a, b) before search_novel('k'[, n]): struct(function, start, count, keyword, context); null without one."""
    read, find = TEXT_CALLS.values()
    number = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit("")).cast("bigint")
    none = F.lit(None)
    as_read = F.struct(F.lit("read_novel_lines").alias("function"), number(read, 1).alias("start"), number(read, 2).alias("count"), none.cast("string").alias("keyword"), none.cast("bigint").alias("context"))
    as_find = F.struct(F.lit("search_novel").alias("function"), none.cast("bigint").alias("start"), none.cast("bigint").alias("count"), F.regexp_extract(text, find, 1).alias("keyword"), number(find, 2).alias("context"))
    return F.when(text.rlike(read), as_read).when(text.rlike(find), as_find)


def parse_commands(text: Column) -> Column:
    """array(struct(kind, name, field, value)) of the lines in <state_update>; lines of no known form are left out."""
    forms = (
        ("update", r"^\s*UPDATE\s+character:\s+(\S+)\.(\S+)\s*=\s*(.+?)\s*$", (1, 2, 3)),
        ("alias", r"^\s*UPDATE\s+alias:\s+(.+?)\s*->\s*(.+?)\s*$", (1, None, 2)),
        ("new", r"^\s*NEW\s+character:\s+(.+?)\s*$", (1, None, None)),
    )

    def one(line: Column) -> Column:
        found = F.lit(None)
        for kind, pattern, places in reversed(forms):
            part = [F.trim(F.regexp_extract(line, pattern, k)) if k else F.lit(None).cast("string") for k in places]
            found = F.when(line.rlike(pattern), F.struct(F.lit(kind).alias("kind"), *(p.alias(n) for p, n in zip(part, ("name", "field", "value"))))).otherwise(found)
        return found

    return F.filter(F.transform(F.split(F.coalesce(tag(text, "state_update"), F.lit("")), "\n"), one), lambda x: x.isNotNull())


def reveals_after(line: Column, patterns: Iterable[str] = REVEAL_PATTERNS, end: str = NAME_END, name: str = f"^({HAN}{{2,4}})", valid=valid_name, least: int = 3) -> Column:
    """array of the valid names that a line introduces, in the order of the patterns they stand after (each at its first place)."""
    body = strip(line)
    stop = "".join("\\" + c if c in "[]\\^-" else c for c in end)
    tries = []
    for p in patterns:
        rest = F.regexp_extract(body, f"{quoted(p)}([^{stop}]*)", 1)
        tries.append(F.when(body.contains(p), valid(F.nullif(F.regexp_extract(rest, name, 1), F.lit("")))))
    return F.when(F.length(body) >= least, F.array_compact(F.array(*tries))).otherwise(F.array().cast("array<string>"))


def reveal_after(line: Column, *args, **kwargs) -> Column:
    """The first of reveals_after(); null without one."""
    return F.get(reveals_after(line, *args, **kwargs), F.lit(0))


def clamp(value: Column, low: int, high: int, zero_means: int = 1) -> Column:
    """Between low and high; null and 0 count as zero_means."""
    return F.least(F.greatest(F.coalesce(F.nullif(value, F.lit(0)), F.lit(zero_means)), F.lit(low)), F.lit(high))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def first_nonzero(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in columns), F.lit(0))


def duration(seconds: Column) -> Column:
    """3725 -> 1h02m, 125 -> 2m05s."""
    s = F.floor(seconds).cast("bigint")
    hours, minutes = F.floor(s / 3600).cast("bigint"), F.floor(s / 60).cast("bigint") % 60
    return F.when(s >= 3600, F.format_string("%dh%02dm", hours, minutes)).otherwise(F.format_string("%dm%02ds", F.floor(s / 60).cast("bigint"), s % 60))


def message_length(messages: Column) -> Column:
    """Characters in the contents and in the JSON of the tool calls of array(struct(role, content, tool_calls))."""
    size = lambda m: F.length(F.coalesce(m["content"], F.lit(""))) + F.aggregate(F.coalesce(m["tool_calls"], F.array().cast("array<string>")), F.lit(0), lambda n, c: n + F.length(c))
    return F.aggregate(messages, F.lit(0), lambda n, m: n + size(m))


def over_budget(estimate: Column, output: int = 2048, context: int = 40_000) -> Column:
    return estimate + F.lit(output) > context


def markers(text: Column, required: Iterable[str] = (), forbidden: Iterable[str] = ()) -> Column:
    """array of what is wrong with a whole text: "missing x", "forbidden y"."""
    wrong = [F.when(~text.contains(x), F.lit(f"missing {x}")) for x in required] + [F.when(text.contains(x), F.lit(f"forbidden {x}")) for x in forbidden]
    return F.filter(F.array(*wrong), lambda x: x.isNotNull())


def pair_name(seen: Column, frame: int = 8) -> Column:
    """The two voices of the last rows as text; "?" with fewer than four rows."""
    voices = F.array_distinct(F.slice(seen, F.greatest(F.size(seen) - frame + 1, F.lit(1)), frame))
    named = F.when(F.size(voices) >= 2, F.concat(F.get(voices, F.lit(0)), F.lit(" ↔ "), F.get(voices, F.lit(1)), F.lit(" alternation"))).otherwise("alternation")
    return F.when(F.size(seen) < 4, "?").otherwise(named)


def progress(elapsed: Column, done: Column, total: Column) -> Column:
    """Seconds left at the pace so far."""
    return F.try_divide(elapsed, done) * (total - done)
