"""Queries over ordered lines. The tables hold no CJK quotes, so a comma stands for the dialogue mark and plain words for the patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context
from ..session import table
from ..sources import readers
from .base import LINES, Registered, stripped

REGISTERED = query = Registered()
MARK = ","


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.lines(table(spark, sf_dir, "documents"))


def _dialogue(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("line").contains(MARK))


@query(f"WITH {LINES} SELECT * FROM lines")
def line_scan(spark, sf_dir):
    return _lines(spark, sf_dir)


@query("""
SELECT page_id, CAST(i - 1 AS BIGINT) AS span_idx, a[i] AS text
FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS a FROM pages), unnest(generate_series(1, len(a))) AS t(i)
""")
def span_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit(1).alias("line_no"), "html")
    return readers.spans(pages, "page_id", "line_no", "html", 'href="([^"]+)"').select("page_id", "span_idx", "text")


@query(f"WITH {LINES} SELECT doc_id, count(*) AS labeled FROM lines GROUP BY doc_id")
def label_count(spark, sf_dir):
    return readers.label_count(_lines(spark, sf_dir))


@query(f"""WITH {LINES}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS idx, {stripped("line")} AS label
FROM lines WHERE {stripped("line")} <> ''""")
def label_lines(spark, sf_dir):
    return readers.labels(_lines(spark, sf_dir))


_HITS = f"""WITH {LINES}, hits AS (
  SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS hit_no, count(*) OVER (PARTITION BY doc_id) AS total
  FROM lines WHERE contains(line, '%s')),
kwic AS (
  SELECT h.doc_id, hit_no, h.line_no AS hit_line, l.line_no, l.line, total
  FROM hits h JOIN lines l ON l.doc_id = h.doc_id AND l.line_no BETWEEN h.line_no - %d AND h.line_no + %d WHERE hit_no <= %d)"""


@query(_HITS % ("with", 1, 1, 8) + " SELECT * FROM kwic")
def kwic(spark, sf_dir):
    return context.keyword_in_context(_lines(spark, sf_dir), "with")


@query(_HITS % ("the", 2, 2, 8) + """, blocks AS (
  SELECT doc_id, hit_no, total, string_agg(CASE WHEN line_no = hit_line THEN '>>' ELSE '  ' END || line_no || ': ' || line, chr(10) ORDER BY line_no) AS block
  FROM kwic GROUP BY ALL)
SELECT doc_id, left(string_agg(block, chr(10) || '---' || chr(10) ORDER BY hit_no), 12000) AS text, max(total) AS total, count(*) AS shown FROM blocks GROUP BY doc_id""")
def kwic_block(spark, sf_dir):
    return context.context_block(context.keyword_in_context(_lines(spark, sf_dir), "the", 2))


@query(_HITS % ("the", 2, 2, 8) + """, blocks AS (
  SELECT doc_id, hit_no, total, string_agg(CASE WHEN line_no = hit_line THEN '>>>' ELSE '   ' END || line_no || ': ' || regexp_replace(line, '\s+$', ''), chr(10) ORDER BY line_no) AS block
  FROM kwic GROUP BY ALL),
whole AS (SELECT doc_id, string_agg(block, chr(10) || '---' || chr(10) ORDER BY hit_no) AS text, max(total) AS total, count(*) AS shown FROM blocks GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN '(No matches for ''the'')' ELSE left(text, 300)
    || CASE WHEN length(text) > 300 THEN chr(10) || '...(search result truncated; use a narrower keyword or read_novel_lines around a specific line)' ELSE '' END
    || CASE WHEN total > shown THEN chr(10) || '...(showing first ' || shown || ' of ' || total || ' matches; use a narrower keyword or read_novel_lines around a specific line)' ELSE '' END END AS text
FROM (SELECT DISTINCT doc_id FROM lines) LEFT JOIN whole USING (doc_id)""")
def search_text(spark, sf_dir):
    """At most 300 characters of blocks, so that some are cut."""
    return context.search_text(_lines(spark, sf_dir), "the", 2, characters=300)


@query(_HITS % ("for", 1, 1, 10) + " SELECT doc_id, hit_no, hit_line, line_no, line FROM kwic")
def find_references(spark, sf_dir):
    return context.keyword_in_context(_lines(spark, sf_dir), "for", 1, limit=context.REFERENCES).drop("total")


@query(rf"""WITH {LINES}
SELECT doc_id, regexp_replace(string_agg(line_no || ': ' || line, chr(10) ORDER BY line_no), '\s+$', '') AS text
FROM lines WHERE line_no BETWEEN 2 AND 5 GROUP BY doc_id""")
def range_read(spark, sf_dir):
    return context.read_range(_lines(spark, sf_dir), 2, 4)


@query(f"""WITH {LINES}
SELECT l.doc_id, t.line_no AS target, l.line_no,
       CASE WHEN l.line_no = t.line_no THEN '>> ' ELSE '   ' END || 'L' || l.line_no || ': ' ||
       CASE WHEN contains(l.line, ',') THEN '<' || left({stripped("l.line")}, 120) || '>' ELSE '[narr] ' || left({stripped("l.line")}, 120) END AS text
FROM lines t JOIN lines l ON l.doc_id = t.doc_id AND l.line_no BETWEEN greatest(1, t.line_no - 25) AND t.line_no + 25
WHERE contains(t.line, ',')""")
def navigation(spark, sf_dir):
    """Around every dialogue line."""
    rows = _lines(spark, sf_dir)
    return context.navigation(rows, _dialogue(rows), mark=MARK, quotes=("<", ">"))


@query(f"WITH {LINES} SELECT doc_id, CASE WHEN contains(line, ',') THEN 'D' ELSE 'N' END AS kind, count(*) AS n FROM lines GROUP BY ALL")
def line_kinds(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("doc_id", context.line_kind(F.col("line"), MARK).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINES} SELECT doc_id, line_no, line, pattern FROM lines, (VALUES ('the'), ('with'), ('them'), ('is')) p(pattern) WHERE contains(line, pattern)")
def pattern_hits(spark, sf_dir):
    return context.pattern_hits(_lines(spark, sf_dir), ("the", "with", "them", "is"))


@query(f"""WITH {LINES}, w AS (
  SELECT *, coalesce(list({{'n': line_no, 'l': line}}) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS seen FROM lines),
s AS (SELECT *, coalesce(list_max(list_transform(list_filter(seen, lambda x: contains(x.l, ',')), lambda x: x.n)), 0) AS stop FROM w)
SELECT doc_id, line_no, line,
  coalesce(array_to_string(list_transform(list_filter(seen, lambda x: x.n > stop AND {stripped("x.l")} <> ''), lambda x: {stripped("x.l")}), ' | '), '') AS "before"
FROM s""")
def narrative_before(spark, sf_dir):
    return context.narrative_before(_lines(spark, sf_dir), mark=MARK)


@query(f"""WITH {LINES}, k AS (
  SELECT *, CASE WHEN contains(line, ',') THEN 'D' ELSE 'N' END AS kind FROM lines),
b AS (SELECT *, CASE WHEN kind = 'D' OR coalesce(lag(kind) OVER w, 'D') = 'D' THEN 1 ELSE 0 END AS begins FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
n AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM b)
SELECT doc_id, kind, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS lines FROM n GROUP BY doc_id, block, kind""")
def narrative_blocks(spark, sf_dir):
    return context.blocks(_lines(spark, sf_dir), MARK)


_REVEALED = r"nullif(regexp_extract(line, 'with ([a-z]+)', 1), '')"


def _revealed():
    return F.nullif(F.regexp_extract("line", "with ([a-z]+)", 1), F.lit(""))


@query(f"""WITH {LINES}, r AS (SELECT *, {_REVEALED} AS v FROM lines)
SELECT doc_id, line_no, line, first_value(v IGNORE NULLS) OVER w AS name, first_value(CASE WHEN v IS NOT NULL THEN line_no END IGNORE NULLS) OVER w AS reveal_line
FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")
def asof_forward_reveal(spark, sf_dir):
    return context.reveal_as_of(_lines(spark, sf_dir), _revealed())


@query(f"""WITH {LINES}, r AS (SELECT *, {_REVEALED} AS v FROM lines),
p AS (SELECT t.doc_id, t.line_no, arg_min(r.v, r.line_no) AS name, min(r.line_no) AS reveal_line
      FROM r t JOIN r ON r.doc_id = t.doc_id AND r.line_no > t.line_no AND r.v <> 'the' WHERE contains(t.line, ',') GROUP BY ALL)
SELECT t.doc_id, t.line_no, 'the' AS descriptor, p.name, p.reveal_line FROM lines t LEFT JOIN p USING (doc_id, line_no) WHERE contains(t.line, ',')""")
def reveal_for_descriptor(spark, sf_dir):
    """For every dialogue line."""
    rows = _lines(spark, sf_dir)
    return context.reveal_for(rows, _dialogue(rows).withColumn("descriptor", F.lit("the")), F.array(_revealed()))


@query(f"""WITH {LINES}, t AS (SELECT doc_id, line_no AS around, 'the' AS name FROM lines WHERE contains(line, ',')),
w AS (SELECT l.*, around, name FROM lines l JOIN t USING (doc_id) WHERE l.line_no BETWEEN around - {context.IDENTITY_BACKWARD} AND around + {context.IDENTITY_FORWARD - 1}),
i AS (SELECT doc_id, around, name, 'intro' AS kind, line_no, abs(line_no - around) < {context.IDENTITY_NEAR} AS near, count(*) OVER (PARTITION BY doc_id, around, name) AS total
      FROM w, (VALUES ('on the'), ('the')) p(pattern) WHERE contains(line, pattern)),
n AS (SELECT doc_id, around, name, 'name' AS kind, line_no, abs(line_no - around) < {context.IDENTITY_NEAR} AS near, count(*) OVER g AS total,
             row_number() OVER (PARTITION BY doc_id, around, name ORDER BY line_no) AS k
      FROM w WHERE contains(line, name) WINDOW g AS (PARTITION BY doc_id, around, name))
SELECT * FROM i UNION ALL SELECT * EXCLUDE k FROM n WHERE k <= {context.IDENTITY_NAMES}""")
def deep_search(spark, sf_dir):
    """Around every dialogue line, with the operator's own windows."""
    rows = _lines(spark, sf_dir)
    targets = _dialogue(rows).select("doc_id", F.col("line_no").alias("around"), F.lit("the").alias("name"))
    return context.deep_search(rows, targets, ("on the", "the"))


@query(f"""WITH {LINES}, r AS (SELECT *, {_REVEALED} AS v FROM lines),
t AS (SELECT * FROM r WHERE contains(line, ',')),
p AS (SELECT t.doc_id, t.line_no, arg_min(r.v, r.line_no) AS name, min(r.line_no) AS reveal_line FROM t JOIN r ON r.doc_id = t.doc_id AND r.line_no > t.line_no AND r.v <> 'her' GROUP BY ALL),
i AS (SELECT t.doc_id, t.line_no, count(*) AS n FROM t JOIN r ON r.doc_id = t.doc_id AND r.line_no BETWEEN t.line_no - {context.IDENTITY_NEAR - 1} AND t.line_no + {context.IDENTITY_NEAR - 1}
      WHERE contains(r.line, 'this is') OR contains(r.line, 'on the') GROUP BY ALL)
SELECT t.doc_id, t.line_no, 'her' AS descriptor, p.name IS NOT NULL AS found, p.name, CASE WHEN p.name IS NOT NULL THEN 'verified' WHEN i.n > 0 THEN 'candidate' ELSE 'unknown' END AS status,
  p.reveal_line AS introduction_line, coalesce(i.n, 0) AS introductions FROM t LEFT JOIN p USING (doc_id, line_no) LEFT JOIN i USING (doc_id, line_no)""")
def investigate(spark, sf_dir):
    """Who every dialogue line's descriptor is."""
    rows = _lines(spark, sf_dir)
    return context.investigate(rows, _dialogue(rows).withColumn("descriptor", F.lit("her")), ("this is", "on the"), F.array(_revealed()))


@query(f"WITH {LINES} SELECT * FROM lines WHERE line_no <= 3")
def first_rows(spark, sf_dir):
    return context.first_rows(_lines(spark, sf_dir), 3)


@query("""WITH g AS (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER w > 150 THEN 1 ELSE 0 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, CAST(sum(begins) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS batch FROM g""")
def gap_batches(spark, sf_dir):
    return context.gap_batches(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", "event_id", 150)


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, event_id FROM events),
o AS (SELECT * FROM s WHERE idx >= 3),
g AS (SELECT *, CASE WHEN event_id - lag(event_id) OVER w > 200 THEN 1 ELSE 0 END AS begins FROM o WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
b AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY idx) AS batch FROM g)
SELECT user_id, CAST(idx AS BIGINT) AS idx, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx) AS n FROM b WHERE batch = 0) WHERE n <= 4""")
def next_batch(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    w = context.Window.partitionBy("user_id").orderBy("event_id")
    spans = events.withColumn("idx", (F.row_number().over(w) - 1).cast("bigint"))
    done = events.select("user_id").distinct().withColumn("labeled", F.lit(3))
    return context.next_batch(spans, done, "user_id", "idx", "event_id", size=4, gap=200).select("user_id", "idx", "event_id")


#: Every six-word window of every passage.
_WINDOWS = """w AS (SELECT string_split(text, ' ') AS w FROM benchmark),
t AS (SELECT DISTINCT array_to_string(w[i:i + 5], ' ') AS term FROM w, unnest(generate_series(1, greatest(1, len(w) - 5))) AS s(i))"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.split("text", " ").alias("w"))
    begins = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 5))).alias("i")
    return words.select("w", begins).select(F.array_join(F.slice("w", F.col("i"), F.lit(6)), " ").alias("term"))


@query(f"WITH {LINES}, {_WINDOWS} SELECT doc_id, line_no, term FROM lines JOIN t ON contains(line, term)")
def leak_scan(spark, sf_dir):
    """Every window of every passage in every line."""
    return context.leaks(_lines(spark, sf_dir), _windows(spark, sf_dir))


@query(f"""WITH {LINES}, {_WINDOWS}
SELECT doc_id, count(*) AS violations, string_agg(DISTINCT term, '; ' ORDER BY term) AS terms FROM lines JOIN t ON contains(line, term) GROUP BY doc_id""")
def leaks_by_document(spark, sf_dir):
    found = leak_scan(spark, sf_dir)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("violations"), F.array_join(F.array_sort(F.collect_set("term")), "; ").alias("terms"))


@query(f"WITH {_WINDOWS} SELECT doc_id, term FROM documents JOIN t ON contains(replace(text, chr(10), ' '), term)")
def leak_windows(spark, sf_dir):
    """Every window of every passage over whole texts, across line ends."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("line_no"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("line"))
    return context.leaks(texts, _windows(spark, sf_dir)).drop("line_no")


@query(f"""WITH {LINES}, t AS (SELECT doc_id, line_no AS target FROM lines WHERE contains(line, ',')),
w AS (SELECT l.doc_id, target, l.line_no, line, CASE WHEN contains(line, ',') THEN 'D' ELSE 'N' END AS kind FROM lines l JOIN t ON l.doc_id = t.doc_id AND l.line_no BETWEEN target - 40 AND target + 40),
b AS (SELECT *, CASE WHEN kind = 'D' OR coalesce(lag(kind) OVER o, 'D') = 'D' THEN 1 ELSE 0 END AS begins FROM w WINDOW o AS (PARTITION BY doc_id, target ORDER BY line_no)),
n AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, target ORDER BY line_no) AS block FROM b),
g AS (SELECT doc_id, target, block, kind, min(line_no) AS line_no, max(line_no) AS last, count(*) AS n, min(line) AS line FROM n GROUP BY ALL),
m AS (SELECT *, regexp_extract(line, ',([^,]+)', 1) AS said FROM g)
SELECT doc_id, target, string_agg(CASE WHEN kind = 'D' THEN '  ' || CASE WHEN line_no = target THEN '->' ELSE '  ' END || 'L' || line_no || ' [D] <' || left(said, 40) || CASE WHEN length(said) > 40 THEN '...' ELSE '' END || '>'
  ELSE '     L' || line_no || '-L' || last || ' [N] (' || n || ' lines)' END, chr(10) ORDER BY line_no) AS text FROM m GROUP BY doc_id, target""")
def block_map(spark, sf_dir):
    """Around every dialogue line."""
    rows = _lines(spark, sf_dir)
    return context.block_map(rows, _dialogue(rows), mark=MARK, span=",([^,]+)", quotes=("<", ">"))


@query("""WITH s AS (SELECT page_id, CAST(i - 1 AS BIGINT) AS span_idx, a[i] AS text
  FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS a FROM pages), unnest(generate_series(1, len(a))) AS t(i))
SELECT * FROM s WHERE span_idx >= page_id % 3 AND span_idx < page_id % 3 + 2""")
def resume_range(spark, sf_dir):
    done = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 3).alias("labeled"))
    return context.resume_range(span_extract(spark, sf_dir), done, count=2, key="page_id")
