"""Queries over speakers, names, evidence, risk and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import annotate, context, evidence, memory, risk, scoring
from ..session import table
from ..sources import readers
from .base import LINES, Registered, stripped

REGISTERED = query = Registered()

#: History, rhythm and expectation of a sequence t(k, o, s): key, order, speaker.
_EXPECT = """
h AS (SELECT *, coalesce(list(s) OVER (PARTITION BY k ORDER BY o ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), []) AS seen FROM t),
f AS (SELECT *, seen[greatest(1, len(seen) - 7):] AS frame FROM h),
v AS (SELECT *, frame[1] AS a, list_filter(frame, lambda x: x <> frame[1])[1] AS b FROM f),
c AS (SELECT *, list_reduce(list_prepend(0, list_transform(frame, lambda x: CASE WHEN x = a THEN 1 WHEN x = b THEN 2 ELSE 3 END)),
          lambda n, x: CASE WHEN x = CASE WHEN n % 2 = 0 THEN 1 ELSE 2 END THEN n + 1 ELSE n END) AS score FROM v),
r AS (SELECT *, CASE WHEN len(seen) >= 4 AND b IS NOT NULL AND len(list_filter(frame, lambda x: x = a)) >= 2 AND len(list_filter(frame, lambda x: x = b)) >= 2
                      AND score >= 0.6 * len(frame) THEN CASE WHEN frame[len(frame)] = a THEN b ELSE a END END AS turn FROM c),
e AS (SELECT *, coalesce(turn, CASE WHEN len(seen) >= 2 AND seen[len(seen)] <> seen[len(seen) - 1] THEN seen[len(seen) - 1] END) AS expected,
  len(seen) >= 4 AND seen[len(seen) - 3] = seen[len(seen) - 1] AND seen[len(seen) - 2] = seen[len(seen)] AND seen[len(seen) - 3] <> seen[len(seen) - 2] AS alternates FROM r)"""
_TURNS = "t AS (SELECT conv_id AS k, turn AS o, role AS s FROM conversations)"
_EVENTS = "t AS (SELECT user_id AS k, event_id AS o, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS s FROM events)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")


def _voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    voice = F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise("other")
    return table(spark, sf_dir, "events").select("user_id", "event_id", voice.alias("voice"))


@query("SELECT conv_id, turn, role, coalesce(array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), ','), '') AS seen FROM conversations")
def history(spark, sf_dir):
    return _turns(spark, sf_dir).withColumn("seen", F.array_join(memory.history("conv_id", "turn", F.col("role")), ","))


@query(f"WITH {_EVENTS}, {_EXPECT} SELECT k AS user_id, o AS event_id, alternates AS rapid, alternates FROM e")
def rapid_exchange(spark, sf_dir):
    rows = memory.with_expectations(_voices(spark, sf_dir), "user_id", "event_id", "voice")
    return rows.select("user_id", "event_id", "rapid", "alternates")


@query(f"WITH {_EVENTS}, {_EXPECT} SELECT k AS user_id, o AS event_id, a, b, CAST(score AS BIGINT) AS score, turn AS next FROM e WHERE turn IS NOT NULL")
def rhythm_score(spark, sf_dir):
    seen = _voices(spark, sf_dir).withColumn("seen", memory.history("user_id", "event_id", F.col("voice")))
    # A generator is run once a row; a filter and four fields of a struct would each compute it again.
    return seen.select("user_id", "event_id", F.inline(F.array_compact(F.array(memory.rhythm(F.col("seen"))))))


@query(f"WITH {_TURNS}, {_EXPECT} SELECT k AS conv_id, o AS turn, s AS role, expected FROM e")
def next_expected(spark, sf_dir):
    return memory.with_expectations(_turns(spark, sf_dir), "conv_id", "turn", "role").select("conv_id", "turn", "role", "expected")


@query(f"""WITH {_EVENTS}, {_EXPECT}, p AS (SELECT *, coalesce(expected <> s, false) AS violation FROM e)
SELECT k AS user_id, o AS event_id, s AS voice, violation, coalesce(lag(violation) OVER (PARTITION BY k ORDER BY o), false) AS anchored FROM p""")
def phase_violation(spark, sf_dir):
    return memory.with_expectations(_voices(spark, sf_dir), "user_id", "event_id", "voice").select("user_id", "event_id", "voice", "violation", "anchored")


@query("""SELECT conv_id, turn, coalesce(array_to_string(list('L' || turn || ' ' || role || ': ' || left(text, 60)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), chr(10)), '') AS memory
FROM conversations""")
def memory_summary(spark, sf_dir):
    return memory.summary(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", "memory")


_CHARACTERS = "ch AS (SELECT n_name AS name, [lower(n_name), 'n' || (n_nationkey % 7)] AS aliases, n_nationkey AS ord FROM nation)"


def _characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.col("n_name").alias("name"), F.array(F.lower("n_name"), F.concat(F.lit("n"), (F.col("n_nationkey") % 7).cast("string"))).alias("aliases"), F.col("n_nationkey").alias("ord"))


@query(f"""WITH {_TURNS}, {_EXPECT}, p AS (SELECT *, coalesce(lag(coalesce(expected <> s, false)) OVER (PARTITION BY k ORDER BY o), false) AS anchored FROM e),
n AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS narr FROM conversations),
x AS (SELECT conv_id, turn AS o, list('  L' || turn || '「' || left(coalesce(text, ''), 50) || '」-> ' || role || CASE WHEN coalesce(narr, '') <> '' THEN ' [before: ' || left(narr, 60) || ']' ELSE '' END)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS said FROM n)
SELECT conv_id, x.o AS turn, CASE WHEN len(seen) = 0 THEN '(No prior annotations)' ELSE concat_ws(chr(10), '[Recent Dialogues]', array_to_string(said, chr(10)),
  CASE WHEN p.turn IS NOT NULL THEN chr(10) || '[Exchange rhythm - last ' || len(frame) || ' rounds]' || chr(10) || '  Alternating: ' || a || ' ↔ ' || b || chr(10)
    || '  Current expects: ' || p.turn || ' (opposite of previous speaker)' || chr(10) || '  NEXT EXPECTED: ' || p.turn END,
  CASE WHEN anchored AND expected IS NOT NULL THEN chr(10) || '[ANCHOR CONSTRAINT] Last round violated the alternating pattern!' || chr(10) || 'The last ' || len(frame) || ' rounds form '
    || CASE WHEN len(seen) < 4 THEN '?' WHEN b IS NOT NULL THEN a || ' ↔ ' || b || ' alternation' ELSE 'alternation' END || '.' || chr(10)
    || 'NEXT SPEAKER MUST BE: ' || expected || ' (strict alternation - do NOT repeat the previous speaker)' || chr(10)
    || 'RULE: Only override this if the narrative clearly assigns speech to a different character.' END,
  CASE WHEN alternates THEN chr(10) || 'RAPID EXCHANGE: Last 4 dialogues alternate between two speakers.' || chr(10)
    || 'RULE: Narrative attribution (#1) before alternation (#3). Read 3-5 lines before target.' END) END AS memory
FROM x JOIN p ON p.k = x.conv_id AND p.o = x.o""")
def memory_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("narrative", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return memory.full_text(rows, "conv_id", "turn", "role", "text", "narrative").select("conv_id", "turn", "memory")


@query(f"""WITH {_CHARACTERS}, o AS (SELECT alias, arg_min(name, ord) AS owner FROM (SELECT name, ord, unnest(aliases) AS alias FROM ch) GROUP BY alias),
n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'NATION_' || c_nationkey WHEN 1 THEN 'nation_' || c_nationkey WHEN 2 THEN 'n' || (c_nationkey % 9) ELSE c_name END AS name FROM customer)
SELECT c_custkey, n.name, coalesce(ch.name, o.owner, n.name) AS resolved FROM n LEFT JOIN ch ON ch.name = n.name LEFT JOIN o ON o.alias = n.name""")
def alias_resolve(spark, sf_dir):
    key, place = F.col("c_custkey") % 4, F.col("c_nationkey").cast("string")
    name = F.when(key == 0, F.concat(F.lit("NATION_"), place)).when(key == 1, F.concat(F.lit("nation_"), place)).when(key == 2, F.concat(F.lit("n"), (F.col("c_nationkey") % 9).cast("string"))).otherwise(F.col("c_name"))
    names = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    return evidence.resolve(names, _characters(spark, sf_dir))


_EVIDENCE = """ev AS (SELECT 'u' || (user_id % 40) AS name, CASE WHEN event_id % 3 = 0 THEN 'u' || (user_id % 40) WHEN event_id % 3 = 1 THEN event_type || (event_id % 5) END AS alias,
  value > 60 AS verified, event_id % 2000 AS line_no, event_type = 'signup' AS introduces, event_id AS ord FROM events)"""


def _evidence(rows: DataFrame) -> DataFrame:
    name = F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string"))
    third = F.col("event_id") % 3
    alias = F.when(third == 0, name).when(third == 1, F.concat("event_type", (F.col("event_id") % 5).cast("string")))
    return rows.select(name.alias("name"), alias.alias("alias"), (F.col("value") > 60).alias("verified"), (F.col("event_id") % 2000).alias("line_no"), (F.col("event_type") == "signup").alias("introduces"), F.col("event_id").alias("ord"))


VAULT_SQL = f"""WITH {_EVIDENCE}, a AS (SELECT name, alias, min(ord) AS o FROM ev WHERE alias IS NOT NULL AND alias <> name GROUP BY ALL),
l AS (SELECT name, string_agg(alias, '|' ORDER BY o) AS aliases FROM a GROUP BY name)
SELECT name, coalesce(any_value(aliases), '') AS aliases, CASE WHEN bool_or(verified) THEN 'verified' ELSE 'candidate' END AS status, count(DISTINCT line_no) AS evidence,
  min(CASE WHEN introduces THEN line_no END) AS introduction_line, max(line_no) AS last_seen_line FROM ev LEFT JOIN l USING (name) GROUP BY name"""


@query(VAULT_SQL)
def vault_upsert(spark, sf_dir):
    return evidence.upsert(_evidence(table(spark, sf_dir, "events"))).withColumn("aliases", F.array_join("aliases", "|"))


@query(f"""WITH {_EVIDENCE}, a AS (SELECT name, alias, min(CASE WHEN line_no % 2 = 0 THEN ord END) AS h, min(ord) AS o FROM ev WHERE alias IS NOT NULL AND alias <> name GROUP BY ALL),
l AS (SELECT name, string_agg(alias, '|' ORDER BY h IS NULL, coalesce(h, o)) AS aliases FROM a GROUP BY name)
SELECT name, coalesce(any_value(aliases), '') AS aliases, CASE WHEN bool_or(verified) THEN 'verified' ELSE 'candidate' END AS status, CAST(count(DISTINCT line_no) AS BIGINT) AS evidence,
  min(CASE WHEN introduces THEN line_no END) AS introduction_line, max(line_no) AS last_seen_line FROM ev LEFT JOIN l USING (name) GROUP BY name""")
def vault_merge(spark, sf_dir):
    """Held state plus unseen evidence, where evidence lines are unique to a half; held aliases come first."""
    rows = _evidence(table(spark, sf_dir, "events"))
    held, new = rows.where("line_no % 2 = 0"), evidence.unseen_evidence(rows, rows.where("line_no % 2 = 0"))
    return evidence.merge_vaults(evidence.upsert(held), evidence.upsert(new)).withColumn("aliases", F.array_join("aliases", "|"))


@query(f"""WITH {_EVIDENCE}, v AS ({VAULT_SQL.replace(f"WITH {_EVIDENCE}, ", "WITH ")}),
w AS (SELECT name, unnest(string_split(aliases, '|')) AS alias FROM v WHERE aliases <> ''), ow AS (SELECT alias, min(name) AS owner FROM w GROUP BY alias),
m AS (SELECT CASE event_id % 3 WHEN 0 THEN 'u' || (user_id % 60) ELSE event_type || (event_id % 7) END AS raw, event_id AS line_no FROM events),
r AS (SELECT coalesce(v.name, ow.owner, raw) AS name, max(line_no) AS seen FROM m LEFT JOIN v ON v.name = raw LEFT JOIN ow ON ow.alias = raw GROUP BY 1)
SELECT name, coalesce(v.aliases, '') AS aliases, coalesce(status, 'candidate') AS status, CAST(coalesce(evidence, 0) AS BIGINT) AS evidence, introduction_line,
  greatest(coalesce(last_seen_line, 0), coalesce(seen, 0)) AS last_seen_line FROM v FULL JOIN r USING (name)""")
def last_seen_update(spark, sf_dir):
    """Mentions by name, by alias and of nobody known."""
    events = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), (F.col("user_id") % 60).cast("string"))).otherwise(F.concat("event_type", (F.col("event_id") % 7).cast("string")))
    updated = evidence.update_last_seen(evidence.upsert(_evidence(events)), events.select(name.alias("name"), F.col("event_id").alias("line_no")))
    return updated.withColumn("aliases", F.array_join("aliases", "|"))


@query(f"WITH {_EVIDENCE} SELECT name, line_no, min(ord) AS ord FROM ev GROUP BY ALL")
def evidence_dedupe(spark, sf_dir):
    return evidence.fresh_evidence(_evidence(table(spark, sf_dir, "events"))).select("name", "line_no", "ord")


@query("""WITH s AS (SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_seen FROM events)
SELECT *, coalesce(last_seen, 0) <> 0 AND event_id - last_seen < 80 AS active FROM s""")
def activity_window(spark, sf_dir):
    rows = evidence.seen_before(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", "event_id")
    return rows.withColumn("active", evidence.active(F.col("event_id"), F.col("last_seen")))


@query("SELECT user_id, min(event_id) AS first_seen, max(event_id) AS last_seen, count(*) AS mentions FROM events GROUP BY user_id")
def first_last_seen(spark, sf_dir):
    return evidence.extent(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("""WITH s AS (SELECT user_id % 20 AS u, event_id FROM events),
m AS (SELECT CASE WHEN u >= 15 THEN u - 15 ELSE u END AS u, event_id FROM s)
SELECT 'u' || u AS name, min(event_id) AS first_seen, max(event_id) AS last_seen, array_to_string(list_sort(list(event_id))[-5:], ',') AS recent FROM m GROUP BY u""")
def merge_characters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("name", F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")))
    states = rows.groupBy("name").agg(F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen")).join(evidence.newest(rows, "name", "event_id", "event_type"), "name")
    reveals = rows.sparkSession.createDataFrame([(f"u{i}", f"u{i - 15}") for i in range(15, 20)], "name string, real string")
    merged = evidence.merge_characters(states, reveals)
    return merged.withColumn("recent", F.array_join(F.transform("recent", lambda x: x["line"].cast("string")), ","))


_NAME = stripped("raw")


@query(rf"""WITH {LINES}, n AS (SELECT doc_id, line_no, CAST(i AS BIGINT) AS part, p[i] AS raw FROM (SELECT doc_id, line_no, string_split(line, '.') AS p FROM lines), unnest(generate_series(1, len(p))) AS t(i)),
c AS (SELECT *, {_NAME} AS clean FROM n)
SELECT doc_id, line_no, part, raw, CASE WHEN clean = '' OR contains(clean, '--') OR contains(clean, '—') OR contains(clean, '–') OR length(clean) > 15
  OR regexp_matches(clean, '\s') OR regexp_matches(clean, '[（(【\[].*[）)】\]]') THEN NULL ELSE clean END AS name FROM c""")
def name_validate(spark, sf_dir):
    """Every sentence of every line."""
    rows = readers.lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.posexplode(F.split("line", r"\.", -1)).alias("part", "raw"))
    return rows.select("doc_id", "line_no", (F.col("part") + 1).cast("bigint").alias("part"), "raw", fn.valid_name(F.col("raw")).alias("name"))


@query(rf"""WITH {LINES}, n AS (SELECT doc_id, line_no, {stripped("line")} AS c FROM lines)
SELECT doc_id, line_no, length(c) <= 12 OR len(regexp_extract_all(c, '[一-鿿]')) <= 4 AS short, c = '' OR regexp_matches(c, '[a-zA-Z]') OR NOT regexp_matches(c, '[一-鿿]') AS garbage, left(c, 40) AS cut FROM n""")
def text_predicates(spark, sf_dir):
    rows = readers.lines(table(spark, sf_dir, "documents"))
    clean = fn.strip(F.col("line"))
    return rows.select("doc_id", "line_no", fn.short_or_fragment(F.col("line")).alias("short"), fn.garbage_speaker(clean).alias("garbage"), F.left(clean, F.lit(40)).alias("cut"))


_SHORT = "(length(line) <= 12 OR len(regexp_extract_all(line, '[一-鿿]')) <= 4)"


_RISK_LINES = f"""r AS (SELECT doc_id, line_no, CASE doc_id % 4 WHEN 0 THEN '女孩' WHEN 1 THEN 'non-human' ELSE lang END AS speaker, {stripped("lines.line")} AS line, doc_id % 3 AS rounds,
  CASE WHEN doc_id % 5 < 3 THEN 'en' END AS expected, doc_id % 2 = 0 AS rapid FROM lines JOIN documents USING (doc_id))"""


@query(f"""WITH {LINES}, {_RISK_LINES} SELECT doc_id, line_no, speaker, concat_ws('; ',
  CASE WHEN speaker = '女孩' THEN '{risk.REASONS[0]}' END, CASE WHEN speaker = 'non-human' THEN '{risk.REASONS[1]}' END,
  CASE WHEN expected <> speaker THEN '{risk.REASONS[2]}' END, CASE WHEN rapid AND {_SHORT} THEN '{risk.REASONS[3]}' END,
  CASE WHEN rounds <= 1 AND {_SHORT} THEN '{risk.REASONS[4]}' END) AS reasons FROM r""")
def risk_flags(spark, sf_dir):
    """Every line of every document."""
    docs = table(spark, sf_dir, "documents").select(F.struct("doc_id", "lang").alias("doc"), "text")
    doc_id = F.col("doc.doc_id")
    speaker = F.when(doc_id % 4 == 0, "女孩").when(doc_id % 4 == 1, "non-human").otherwise(F.col("doc.lang"))
    reasons = risk.risk_reasons(speaker, F.col("line"), doc_id % 3, F.when(doc_id % 5 < 3, "en"), doc_id % 2 == 0)
    return readers.lines(docs, "doc").select(doc_id.alias("doc_id"), "line_no", speaker.alias("speaker"), F.array_join(reasons, "; ").alias("reasons"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS speaker, doc_id % 3 = 0 AS corrected FROM documents""")
def reviewed(spark, sf_dir):
    """Only flagged rows go through the review; the others pass beside it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("speaker"), F.lit(False).alias("corrected"))

    def review(some: DataFrame) -> DataFrame:
        taken = risk.take_verdict(F.col("speaker"), F.lit("disagree"), F.col("lang"))
        return some.withColumn("_t", taken).select("doc_id", "lang", F.col("_t.speaker").alias("speaker"), F.col("_t.corrected").alias("corrected"))

    return risk.gated(rows, F.col("doc_id") % 3 == 0, review).drop("lang")


@query(r"""WITH r AS (SELECT doc_id, lang, doc_id % 3 AS k, regexp_replace(text, '[\s\x{3000}\x{00A0}]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, CASE WHEN k = 2 THEN left('no tag ' || body, 50) ELSE lang END AS answer, CASE WHEN k = 2 THEN '' ELSE left(trim(body), 200) END AS reason,
  CASE WHEN k = 1 THEN 'disagree' ELSE 'confirm' END AS verdict, CASE WHEN k = 1 THEN lang ELSE 'before' END AS final FROM r""")
def tag_parse(spark, sf_dir):
    body = F.regexp_replace("text", r"(?U)\s+", " ")
    third = F.col("doc_id") % 3
    said = F.when(third == 2, F.concat(F.lit("no tag "), body)).otherwise(
        F.concat(F.lit("<answer> "), "lang", F.when(third == 0, F.lit(" (a b)")).otherwise(F.lit("")), F.lit("\n</answer><reason>"), body, F.lit("</reason>"), F.when(third == 1, F.concat(F.lit("<verdict>disagree</verdict><suggested_speaker>"), "lang", F.lit("</suggested_speaker>"))).otherwise(F.lit("")))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", said.alias("said"))
    verdict = fn.parse_verdict(F.col("said"), F.lit("before"))
    return rows.select("doc_id", fn.parse_answer(F.col("said")).alias("answer"), fn.parse_reason(F.col("said")).alias("reason"), verdict["verdict"].alias("verdict"), verdict["speaker"].alias("final"))


@query("""SELECT event_id, event_id % 2 = 0 AS found, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS character, CASE WHEN event_id % 4 = 0 THEN 'verified' ELSE 'candidate' END AS status,
  CASE WHEN event_id % 2 = 0 THEN 'a|b' ELSE '' END AS aliases, CASE WHEN event_id % 2 = 0 THEN user_id ELSE -1 END AS line FROM events""")
def result_parse(spark, sf_dir):
    even, four = F.col("event_id") % 2 == 0, F.col("event_id") % 4 == 0
    status = F.when(four, F.lit(', "status": "verified"')).otherwise(F.lit(""))
    said = F.when(even, F.concat(F.lit('I think: {"found": true, "aliases": ["a", "b"], "character": "'), "event_type", F.lit('"'), status, F.lit(', "introduction_line": '), F.col("user_id").cast("string"), F.lit("} done"))).otherwise(F.lit("nothing here"))
    rows = table(spark, sf_dir, "events").select("event_id", fn.parse_result(said).alias("r"))
    return rows.select("event_id", "r.found", "r.character", "r.status", F.array_join("r.aliases", "|").alias("aliases"), F.coalesce("r.introduction_line", F.lit(-1)).alias("line"))


@query("""SELECT event_id, user_id AS start, event_id % 50 AS count FROM events""")
def argument_parse(spark, sf_dir):
    """The same arguments as a JSON object and as a JSON string."""
    plain = F.to_json(F.struct(F.col("user_id").alias("start"), (F.col("event_id") % 50).alias("count")))
    given = F.when(F.col("event_id") % 2 == 0, plain).otherwise(F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit('"')))
    return table(spark, sf_dir, "events").select("event_id", fn.arguments(given, "start bigint, count bigint").alias("a")).select("event_id", "a.start", "a.count")


@query("""SELECT doc_id, concat_ws('; ', CASE WHEN NOT contains(text, 'the') THEN 'missing the' END, CASE WHEN contains(text, 'with') THEN 'forbidden with' END) AS wrong FROM documents""")
def marker_check(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(fn.markers(F.col("text"), ("the",), ("with",)), "; ").alias("wrong"))


@query(f"""WITH {_EVENTS}, {_EXPECT} SELECT k AS user_id, o AS event_id, CASE WHEN len(seen) < 4 THEN '?' WHEN b IS NOT NULL THEN a || ' ↔ ' || b || ' alternation' ELSE 'alternation' END AS pair FROM e""")
def pair_name(spark, sf_dir):
    seen = memory.history("user_id", "event_id", F.col("voice"))
    return _voices(spark, sf_dir).withColumn("seen", seen).select("user_id", "event_id", fn.pair_name(F.col("seen")).alias("pair"))


@query("""WITH c AS (SELECT user_id, max(event_id) AS last, list({'t': event_type, 'l': event_id} ORDER BY event_id) AS e FROM events GROUP BY user_id)
SELECT 'u' || user_id AS name, '  [CANDIDATE] u' || user_id || CASE WHEN user_id % 2 = 0 THEN ' (aka: x, y)' ELSE '' END || chr(10) || '     L' || e[1].l || ': ' || e[1].t || chr(10) ||
  CASE WHEN len(e) > 1 THEN '     L' || e[2].l || ': ' || e[2].t || chr(10) ELSE '' END || '     last seen: ~L' || last AS text FROM c WHERE last <> 0 AND 9950 - last < 80""")
def vault_text(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    facts = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.struct(x["event_type"].alias("text"), x["event_id"].alias("line")))
    vault = events.groupBy("user_id").agg(F.max("event_id").alias("last_seen_line"), facts.alias("evidence"))
    aliases = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
    return evidence.render(vault.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), aliases.alias("aliases"), F.lit("candidate").alias("status"), "evidence", "last_seen_line"), 9950)


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'read_novel_lines' WHEN 1 THEN 'search_novel' END AS function, CASE WHEN event_id % 3 = 0 THEN user_id END AS start,
  CASE WHEN event_id % 3 = 0 THEN event_id % 50 END AS count, CASE WHEN event_id % 3 = 1 THEN event_type END AS keyword, CASE WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN 2 END::BIGINT AS context FROM events""")
def tool_call_parse(spark, sf_dir):
    third = F.col("event_id") % 3
    find = F.concat(F.lit("search_novel('"), "event_type", F.lit("'"), F.when(F.col("event_id") % 2 == 0, F.lit(", 2")).otherwise(F.lit("")), F.lit(")"))
    said = F.when(third == 0, F.concat(F.lit("call read_novel_lines("), F.col("user_id").cast("string"), F.lit(", "), (F.col("event_id") % 50).cast("string"), F.lit(") or "), find)).when(third == 1, find).otherwise(F.lit("none"))
    return table(spark, sf_dir, "events").select("event_id", fn.parse_tool_call(said).alias("r")).select("event_id", "r.function", "r.start", "r.count", "r.keyword", "r.context")


@query("""SELECT event_id, k AS n, CASE k WHEN 0 THEN 'update' WHEN 1 THEN 'alias' ELSE 'new' END AS kind, CASE k WHEN 0 THEN 'u' || user_id WHEN 1 THEN event_type ELSE 'n' || user_id END AS name,
  CASE k WHEN 0 THEN 'status' END AS field, CASE k WHEN 0 THEN 'seen ' || event_id WHEN 1 THEN 'u' || user_id END AS value FROM events, (VALUES (0::BIGINT), (1), (2)) t(k)""")
def command_parse(spark, sf_dir):
    u = F.col("user_id").cast("string")
    said = F.concat(F.lit("ok <state_update>\nUPDATE character: u"), u, F.lit(".status = seen "), F.col("event_id").cast("string"), F.lit("\nnonsense\nUPDATE alias: "), "event_type", F.lit(" -> u"), u, F.lit("\nNEW character: n"), u, F.lit("\n</state_update>"))
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(fn.parse_commands(said)).alias("n", "c"))
    return rows.select("event_id", F.col("n").cast("bigint").alias("n"), "c.kind", "c.name", "c.field", "c.value")


@query("""WITH p AS (SELECT doc_id AS idx, CASE WHEN contains(text, '!!') OR contains(text, '***') THEN '0' ELSE '1' END AS label FROM documents),
s AS (SELECT idx, label = CAST(quality AS VARCHAR) AS correct FROM p JOIN labels ON idx = doc_id)
SELECT idx // 50 AS bin, count(*) AS n, count(*) FILTER (correct) AS "right", round(avg(CASE WHEN correct THEN 100.0 ELSE 0.0 END), 6) AS accuracy, (min(idx) + max(idx) + 1) // 2 AS centre FROM s GROUP BY bin""")
def accuracy_by_bin(spark, sf_dir):
    return scoring.by_bin(_scored_labels(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


def _scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    junk = F.col("text").contains("!!") | F.col("text").contains("***")
    predicted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.when(junk, "0").otherwise("1").alias("label"))
    truth = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), F.array(F.col("quality").cast("string")).alias("accepted"))
    return scoring.positional(predicted, truth)


#: Labels and accepted options of the events; some labels have two parts, some options blanks.
_SCORES = """s AS (SELECT event_id AS idx, CASE WHEN event_id % 5 = 0 THEN event_type || ' |view' ELSE event_type END AS label,
  CASE event_id % 3 WHEN 0 THEN ['view', ' click'] WHEN 1 THEN ['purchase', 'error|signup'] ELSE ['error', 'signup ', 'view'] END AS accepted FROM events)"""
_WHOLE = "list_contains(list_transform(accepted, lambda x: trim(x)), label)"


def _event_scores(spark: SparkSession, sf_dir: str, mode: str = "whole") -> DataFrame:
    events, third = table(spark, sf_dir, "events"), F.col("event_id") % 3
    label = F.when(F.col("event_id") % 5 == 0, F.concat("event_type", F.lit(" |view"))).otherwise(F.col("event_type"))
    options = lambda *x: F.array(*map(F.lit, x))
    accepted = F.when(third == 0, options("view", " click")).when(third == 1, options("purchase", "error|signup")).otherwise(options("error", "signup ", "view"))
    return scoring.positional(events.select(F.col("event_id").alias("idx"), label.alias("label")), events.select(F.col("event_id").alias("idx"), accepted.alias("accepted")), mode=mode)


@query(f"""WITH {_SCORES}, m AS (
SELECT 'whole' AS mode, {_WHOLE} AS c FROM s UNION ALL
SELECT 'parts', list_has_any(string_split(label, '|'), accepted) FROM s UNION ALL
SELECT 'stripped', list_has_any(list_transform(string_split(label, '|'), lambda x: trim(x)), string_split(trim(array_to_string(accepted, '|')), '|')) FROM s)
SELECT mode, count(*) AS n, count(*) FILTER (c) AS "right", round(count(*) FILTER (c) * 100.0 / count(*), 6) AS accuracy FROM m GROUP BY mode""")
def accuracy_modes(spark, sf_dir):
    out = None
    for mode in ("whole", "parts", "stripped"):
        one = scoring.accuracy(_event_scores(spark, sf_dir, mode)).select(F.lit(mode).alias("mode"), "n", "right", F.round("accuracy", 6).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_SCORES}, w AS (SELECT *, array_to_string(list_sort(accepted), '|') || ' -> ' || label AS pattern FROM s WHERE NOT {_WHOLE})
SELECT pattern, count(*) AS "count", min(idx) AS first_at FROM w GROUP BY pattern ORDER BY 2 DESC, 3 LIMIT 15""")
def error_patterns(spark, sf_dir):
    return scoring.error_patterns(_event_scores(spark, sf_dir))


@query(f"""WITH {_SCORES}, w AS (SELECT * FROM s WHERE NOT {_WHOLE})
SELECT 'predicted' AS side, label AS value, count(*) AS "count", min(idx) AS first_at FROM w GROUP BY label UNION ALL
SELECT 'truth', array_to_string(accepted, '|'), count(*), min(idx) FROM w GROUP BY 2""")
def confusion_counts(spark, sf_dir):
    scored = _event_scores(spark, sf_dir)
    sides = {"predicted": F.col("label"), "truth": F.array_join("accepted", "|")}
    parts = [scoring.confusions(scored, c).select(F.lit(k).alias("side"), "value", "count", "first_at") for k, c in sides.items()]
    return parts[0].unionByName(parts[1])


@query("SELECT role AS value, count(*) AS \"count\", min(conv_id * 1000 + turn) AS first_at FROM conversations GROUP BY role ORDER BY 2 DESC, 3 LIMIT 10")
def topk_speakers(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("at", F.col("conv_id") * 1000 + F.col("turn"))
    return scoring.frequency(rows, "role", "at", top=10)


@query(f"WITH {_SCORES} SELECT count(*) AS n, count(*) FILTER ({_WHOLE}) AS \"right\", round(count(*) FILTER ({_WHOLE}) * 100.0 / count(*), 6) AS accuracy FROM s WHERE idx >= 100 AND idx < 350")
def validation_range(spark, sf_dir):
    part = scoring.validation_range(_event_scores(spark, sf_dir), 101, 250)
    return scoring.accuracy(part).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH {LINES}, w AS (
  SELECT *, coalesce(list({{'n': line_no, 'l': line}}) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS seen, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS after FROM lines),
s AS (SELECT *, coalesce(list_max(list_transform(list_filter(seen, lambda x: contains(x.l, ',')), lambda x: x.n)), 0) AS stop FROM w),
b AS (SELECT *, array_to_string(list_transform(list_filter(seen, lambda x: x.n > stop AND {stripped("x.l")} <> ''), lambda x: {stripped("x.l")}), ' | ') AS bef FROM s),
n AS (SELECT doc_id, line_no, nullif(regexp_extract(coalesce(bef, ''), '([a-z]{{2,4}}) (?:with|is|that)', 1), '') AS x, nullif(regexp_extract(coalesce(after, ''), '([a-z]{{2,4}}) (?:with|is|that)', 1), '') AS y FROM b)
SELECT doc_id, line_no, coalesce(x, y, CASE WHEN line_no % 2 = 0 THEN 'turn' END, CASE WHEN doc_id % 2 = 0 THEN 'alone' END, '?') AS speaker,
  CASE WHEN x IS NOT NULL THEN 'speech verb before' WHEN y IS NOT NULL THEN 'speech verb after' WHEN line_no % 2 = 0 THEN 'alternation' WHEN doc_id % 2 = 0 THEN 'only one present' ELSE 'no evidence' END AS reason FROM n""")
def annotate_rules(spark, sf_dir):
    rows = context.narrative_before(readers.lines(table(spark, sf_dir, "documents")), mark=",")
    after = F.lead("line").over(context.Window.partitionBy("doc_id").orderBy("line_no"))
    present = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("alone"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    rows = rows.withColumns({"after": after, "expected": F.when(F.col("line_no") % 2 == 0, "turn"), "present": present})
    return annotate.RuleAnnotator(verbs=("with", "is", "that"), name="([a-z]{2,4}) ").annotate(rows).select("doc_id", "line_no", "speaker", "reason")


_OPTIONS = r"th([a-z|]+)"


@query(rf"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS n, CAST(length(m[i]) AS BIGINT) AS size, m[i] AS options FROM (SELECT doc_id, regexp_extract_all(text, '{_OPTIONS}', 1) AS m FROM documents), unnest(generate_series(1, len(m))) AS t(i)""")
def answer_marks(spark, sf_dir):
    """Every mark in a whole text, its options joined again."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(readers.answers(F.col("text"), _OPTIONS)).alias("n", "o"))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n"), F.length(F.array_join("o", "|")).cast("bigint").alias("size"), F.array_join("o", "|").alias("options"))


@query(rf"""WITH {LINES} SELECT doc_id, line_no, regexp_extract(line, '{_OPTIONS}', 1) AS options FROM lines WHERE regexp_extract(line, '{_OPTIONS}', 1) <> ''""")
def answer_lines(spark, sf_dir):
    """The first mark of each line."""
    rows = readers.answer_lines(readers.lines(table(spark, sf_dir, "documents")), pattern=_OPTIONS)
    return rows.select("doc_id", "line_no", F.array_join("accepted", "|").alias("options"))


@query(f"WITH {LINES} SELECT {stripped('line')} AS term, count(*) AS n FROM lines WHERE {stripped('line')} <> '' AND NOT starts_with({stripped('line')}, '#') GROUP BY 1")
def term_list(spark, sf_dir):
    return readers.terms(readers.lines(table(spark, sf_dir, "documents"))).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH l AS (SELECT unnest(string_split(html, '"')) AS line FROM pages), p AS (SELECT line, instr(line, '=') AS i FROM l WHERE contains(line, '='))
SELECT trim(line[:i - 1], ' ' || chr(10) || chr(9) || chr(13)) AS name, count(*) AS n FROM p GROUP BY 1""")
def settings_list(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.explode(F.split("html", '"', -1)).alias("line"))
    return readers.settings(rows).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '赫萝' WHEN 2 THEN '丙丁' WHEN 3 THEN '甲乙' END AS first, CASE event_id % 4 WHEN 0 THEN '赫萝' WHEN 2 THEN '丙丁,甲乙' WHEN 3 THEN '甲乙' ELSE '' END AS names FROM events""")
def reveal_names(spark, sf_dir):
    """One name, none, two patterns in a line, a name after a pattern that stands before nothing valid."""
    kind = F.col("event_id") % 4
    line = F.when(kind == 0, "咱的名字是赫萝。").when(kind == 1, "他说什么 ok").when(kind == 2, "名字是甲乙。我的名字是丙丁，吾乃").otherwise("我的名字是x。吾乃甲乙！")
    return table(spark, sf_dir, "events").select("event_id", fn.reveal_after(line).alias("first"), F.array_join(F.array_distinct(fn.reveals_after(line)), ",").alias("names"))


@query("SELECT event_id, CASE WHEN user_id > 0 THEN round(value / user_id * (1000 - user_id), 6) END AS left_s, CASE WHEN event_id % 2 = 0 THEN 'found' ELSE event_type END AS speaker, event_id % 3 = 2 AS usable FROM events")
def round_control(spark, sf_dir):
    """Time left, which speaker an identity search leaves, and whether an answer can be used."""
    rows = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 2 == 0, "verified").otherwise("candidate")
    said = F.when(F.col("event_id") % 3 == 0, "who").when(F.col("event_id") % 3 == 1, "").otherwise("赫萝")
    return rows.select("event_id", F.round(fn.progress(F.col("value"), F.nullif(F.col("user_id"), F.lit(0)), F.lit(1000)), 6).alias("left_s"), risk.take_identity(F.col("event_type"), status, F.lit("found")).alias("speaker"), risk.usable(said).alias("usable"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'env' || user_id WHEN 1 THEN 'py' || user_id WHEN 2 THEN 'json' || user_id ELSE '' END AS setting FROM events""")
def settings_precedence(spark, sf_dir):
    """A setting from the environment, else from a source text, else from JSON with comments; the last fourth has broken JSON only."""
    case, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    commented = F.concat(F.lit('  // {"one": {"key": "old"}}\n{"one":\n//\n {"key": "json'), user, F.lit('"}}\n// end'))
    found = readers.commented_json(F.when(case < 3, commented).otherwise(F.left(commented, F.lit(40))), "one struct<key string>")
    source = F.when(case == 1, F.concat(F.lit("import os\nAPI_KEY = 'py"), user, F.lit("'\n"))).otherwise(F.lit("API_KEY = None"))
    first = fn.first_filled(F.when(case == 0, F.concat(F.lit("env"), user)), readers.assigned(source, "API_KEY"), found["one"]["key"])
    return table(spark, sf_dir, "events").select("event_id", first.alias("setting"))
