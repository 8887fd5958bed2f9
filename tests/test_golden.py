"""Hand-written cases with the CJK defaults, edge cases of ranges and ties, and the model policy without a network."""

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as fn
from loomline.operators import annotate, context, evidence, memory, risk, runlog, scoring
from loomline.sources import readers, writers
from loomline.streaming.rhythm import expected_next


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def novel(spark, *texts, key=1):
    return spark.createDataFrame([(key, i + 1, t) for i, t in enumerate(texts)], "doc_id long, line_no long, line string")


def test_spans_inner_open_empty_and_unterminated(spark):
    rows = novel(spark, "x「a」y「b「c」「」d「e", "", "　「f」")
    assert [(r.span_idx, r.line_no, r.text) for r in readers.spans(rows).orderBy("span_idx").collect()] == [(0, 1, "a"), (1, 1, "b「c"), (2, 3, "f")]


def test_lines_of_any_line_end(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\n")], "doc_id long, text string")
    assert [r.line for r in readers.lines(df, last_empty=False).orderBy("line_no").collect()] == ["a", "b", "c"]
    assert readers.lines(df.withColumn("text", F.lit("a\nb\n"))).count() == 3


def test_answers_of_both_scanners(spark):
    df = spark.createDataFrame([(1, 1, "【 A | B 】 and 【C】"), (1, 2, "none")], "doc_id long, line_no long, line string")
    assert df.select(readers.answers(F.col("line")).alias("x")).first().x == [["A", "B"], ["C"]]
    assert [r.accepted for r in readers.answer_lines(df).collect()] == [[" A ", " B "]]


@pytest.mark.parametrize("name,valid", [("罗伦斯", "罗伦斯"), ("　罗伦斯 ", "罗伦斯"), ("", None), ("a b", None), ("a　b", None), ("甲——乙", None), ("甲（乙）", None), ("x" * 15, "x" * 15), ("x" * 16, None), ("根据原文", None)])
def test_valid_name(spark, name, valid):
    assert one(spark, fn.valid_name(F.col("n")), n=name) == valid


def test_answer_tag_falls_back(spark):
    parse = lambda t: one(spark, fn.parse_answer(F.col("t")), t=t)
    assert parse("x<answer> 赫萝 </answer>") == "赫萝"
    assert parse("<answer>赫萝（狼）</answer>") == "赫萝"
    assert parse("<answer>a b c d</answer>") == "a b c d"
    assert parse("  first line\nsecond") == "first line"


def test_short_garbage_and_risks(spark):
    assert one(spark, fn.short_or_fragment(F.col("t")), t="嗯，我知道了")
    assert not one(spark, fn.short_or_fragment(F.col("t")), t="这是一句相当长的话所以它绝对不会被当成片段")
    assert one(spark, fn.garbage_speaker(F.col("t")), t="什么") and one(spark, fn.garbage_speaker(F.col("t")), t="Bob") and not one(spark, fn.garbage_speaker(F.col("t")), t="赫萝")
    reasons = risk.risk_reasons(F.lit("女孩"), F.lit("嗯"), F.lit(1), F.lit("赫萝"), F.lit(True))
    assert one(spark, reasons) == [risk.REASONS[0], risk.REASONS[2], risk.REASONS[3], risk.REASONS[4]]


def test_range_read_clamps(spark):
    rows = novel(spark, "a", "b", "c  ")
    text = lambda s, n: [r.text for r in context.read_range(rows, s, n).collect()]
    assert text(0, 2) == ["1: a"] and text(2, 9) == ["2: b\n3: c"] and text(9, 2) == []


def test_narrative_before_stops_at_dialogue(spark):
    rows = novel(spark, "n1", "「d」", "n2", " ", "　n3　", "「e」")
    got = {r.line_no: r.before for r in context.narrative_before(rows).collect()}
    assert got[6] == "n2 | n3" and got[2] == "n1" and got[3] == "" and got[1] == ""


def test_reveal_is_strictly_later_and_differs(spark):
    rows = novel(spark, "我的名字是阿玛堤", "x", "名字是罗伦斯。", "吾乃赫萝")
    got = {r.line_no: (r.name, r.reveal_line) for r in context.reveal_as_of(rows).collect()}
    assert got[1] == ("罗伦斯", 3) and got[3] == ("赫萝", 4) and got[4] == (None, None)
    targets = rows.where("line_no = 1").withColumn("descriptor", F.lit("罗伦斯"))
    assert [(r.name, r.reveal_line) for r in context.reveal_for(rows, targets).collect()] == [("赫萝", 4)]
    assert one(spark, fn.reveal_after(F.col("t")), t="名字是甲乙丙丁戊") == "甲乙丙丁" and one(spark, fn.reveal_after(F.col("t")), t="名字是甲") is None


def test_batches_at_the_gap(spark):
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate([1, 11, 22, 23])], "k long, i long, p long")
    assert [r.batch for r in context.gap_batches(rows, "k", "i", "p").orderBy("i").collect()] == [0, 0, 1, 1]
    done = spark.createDataFrame([(1, 2)], "k long, labeled long")
    assert [r.i for r in context.next_batch(rows, done, "k", "i", "p", size=5).orderBy("i").collect()] == [2, 3]


def test_memory_against_plain_python(spark):
    import random

    random.seed(5)
    rows = [(k, i, random.choice("aab" if k % 2 else "abc")) for k in range(60) for i in range(random.randint(1, 14))]
    df = spark.createDataFrame(rows, "k long, o long, s string")
    got = {(r.k, r.o): r for r in memory.with_expectations(df, "k", "o", "s").collect()}
    for k, i, s in rows:
        seen = [x for j, n, x in rows if j == k and n < i][-20:]
        r = got[k, i]
        last = seen[-4:]
        assert r.expected == expected_next(seen)
        assert r.rapid == (len(last) == 4 and len(set(last)) == 2 and all(a != b for a, b in zip(last, last[1:])))
        assert r.violation == (r.expected is not None and r.expected != s)


def test_modes_of_accuracy(spark):
    check = lambda label, options, mode: one(spark, scoring.accepted(F.lit(label), F.array(*map(F.lit, options)), mode))
    assert check("A|B", ["A"], "parts") and not check("A|B", ["A"], "whole") and check("A", [" A "], "whole") and not check("A", [" A "], "parts")
    assert check(" A |B", ["A"], "stripped")
    assert one(spark, F.lit(1)) == 1 and scoring.accuracy(spark.createDataFrame([], "correct boolean")).first().accuracy == 0.0


def test_vault_edges(spark):
    rows = spark.createDataFrame([("a", "a", False, 5, False, 1), ("a", "x", False, 9, True, 2), ("a", "x", True, 5, False, 3), ("a", None, False, 1, True, 4)], "name string, alias string, verified boolean, line_no long, introduces boolean, ord long")
    r = evidence.upsert(rows).first()
    assert (r.aliases, r.status, r.evidence, r.introduction_line, r.last_seen_line) == (["x"], "verified", 3, 1, 9)
    act = lambda now, seen: one(spark, evidence.active(F.lit(now), F.lit(seen).cast("long")))
    assert act(100, 21) and not act(100, 20) and not act(5, 0) and not act(5, None) and act(5, 50)
    chars = spark.createDataFrame([("A", ["x", "B"], 1), ("B", ["x"], 2)], "name string, aliases array<string>, ord long")
    got = {r.name: r.resolved for r in evidence.resolve(spark.createDataFrame([("x",), ("B",), ("?",)], "name string"), chars).collect()}
    assert got == {"x": "A", "B": "B", "?": "?"}


def test_tool_calls_and_log_round_trip(spark, tmp_path):
    lines = ['{"round": 1, "agents": {"L": {"agent": "L", "total_tokens": 5}}, "tool_calls": [{"round": 0, "function": "f", "args": {"start": "3", "count": "2"}}]}', '{"round": 2, "agents": {}, "tool_calls": [{"tool_calls": [{"function": "a"}, {"function": "b"}]}]}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = readers.run_log(spark, str(tmp_path / "log.jsonl"))
    assert [r.n for r in log.orderBy("round").select(runlog.tool_call_count(F.col("tool_calls")).alias("n")).collect()] == [1, 2]
    assert [(r.first_line, r.last_line) for r in runlog.first_read_range(log).orderBy("round").collect()] == [(3, 4), (0, 0)]
    (tmp_path / "bad.jsonl").write_text("not json")
    with pytest.raises(Exception):
        readers.run_log(spark, str(tmp_path / "bad.jsonl")).collect()


def test_moving_average_has_full_frames_only(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(5)], "k long, o long, v double")
    assert [(r.x, r.average) for r in runlog.moving_average(rows, "v", "o", "k", 3).orderBy("x").collect()] == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_files_state_and_backup(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("x = 1\n# roster\n")
    (tmp_path / "d" / "keep.py").write_text("y")
    assert {r.line for r in readers.source_files(spark, str(tmp_path / "d"), leave_out=("keep.py",)).collect()} == {"x = 1", "# roster"}
    assert [r.term for r in readers.terms(spark.createDataFrame([(" a ",), ("# c",), ("",)], "line string")).collect()] == ["a"]
    assert {r.name: r.value for r in readers.settings(spark.createDataFrame([("A=b=c",), ("no",)], "line string")).collect()} == {"A": "b=c"}
    assert writers.back_up(spark, str(tmp_path / "d"), str(tmp_path / "b"), keep=("keep.py",)) == ["a.py"]
    state = tmp_path / "vault.json"
    state.write_text('{"characters": {"A": {"aliases": ["x"], "status": "verified", "evidence": [], "last_seen_line": 4}}}')
    assert [(r.name, r.aliases, r.last_seen_line) for r in readers.vault(spark, str(state)).collect()] == [("A", ["x"], 4)]
    state.write_text("broken")
    assert readers.vault(spark, str(state)).count() == 0
    writers.save_state(spark.createDataFrame([("A", 1)], "name string, n long"), str(tmp_path / "s"), round_no=50)
    assert spark.read.json(str(tmp_path / "s")).first().asDict() == {"name": "A", "n": 1, "round": 50}
    writers.reset(spark, str(tmp_path / "s"))
    assert not (tmp_path / "s").exists()


def test_gated_review_sees_flagged_rows_only(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, risky boolean")
    out = risk.gated(rows, F.col("risky"), lambda df: df.withColumn("id", F.col("id") + 10))
    assert sorted(r.id for r in out.collect()) == [2, 3, 11]


def test_function_annotator_and_identity(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "text string")
    out = annotate.FunctionAnnotator(lambda xs: [(x["text"].upper(), "said") for x in xs]).annotate(rows)
    assert sorted(r.speaker for r in out.collect()) == ["A", "B"]
    assert one(spark, risk.take_identity(F.lit("女孩"), F.lit("candidate"), F.lit("赫萝"))) == "女孩"
    assert one(spark, risk.take_verdict(F.lit("a"), F.lit("disagree"), F.lit("b"))).corrected


def test_provider_chain_rests_and_goes_on():
    now, asked = [0.0], []

    def answer(name, error=None):
        def chat(messages, tools):
            asked.append(name)
            if error:
                raise annotate.ModelError("no", error)
            return {"content": name}

        return chat

    chain = annotate.ProviderChain([annotate.Provider("a", "m1", answer("a", 429)), annotate.Provider("b", "m2", answer("b", 401)), annotate.Provider("c", "m3", answer("c"))], clock=lambda: now[0], wait=lambda s: None)
    assert chain.call([{"role": "user", "content": "x"}])[0] == "c" and asked == ["a", "b", "c"]
    chain.call([{"role": "user", "content": "x"}])
    assert asked == ["a", "b", "c", "c"]
    now[0] = 121
    chain.call([{"role": "user", "content": "x"}])
    assert asked[4:] == ["a", "c"] and chain.providers[1].disabled
    assert [p.label for p in chain.select("m")] == ["a", "b", "c"] and [p.label for p in chain.select("m2")] == ["b"]
    with pytest.raises(annotate.ModelError):
        chain.call([{"role": "user", "content": "x" * 40_000}])


def test_tool_loop_and_messages():
    replies = iter([{"tool_calls": [{"function": "read", "arguments": {"n": 1}}], "tokens": 5}, {"content": "", "tokens": 1}, {"content": "赫萝", "tokens": 1}])
    chain = annotate.ProviderChain([annotate.Provider("a", "m", lambda m, t: next(replies))])
    assert annotate.ToolLoop(chain, {"read": lambda n: f"line {n}"}, bool).run([{"role": "user", "content": "who?"}]) == ("赫萝", 7, 1)
    sent = annotate.with_call_ids([{"role": "assistant", "tool_calls": [{"function": "f"}]}, {"role": "tool", "content": "r"}])
    assert sent[1]["tool_call_id"] == sent[0]["tool_calls"][0]["id"]
    assert annotate.expects_tool_call([{"role": "user", "content": "must look"}], ("must",)) and not annotate.expects_tool_call([{"role": "user", "content": "must"}, {"role": "tool", "content": ""}], ("must",))


def test_library_does_not_need_the_training_data_operators():
    import pathlib

    root = pathlib.Path(context.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path


def test_leaks_stand_anywhere(spark):
    lines = ["他说「王小明来了」，李雷不在。", '"alpha beta" (gamma)', "pre-alpha\tbeta", "xalpha betax", "", "plain", "e" * 40 + "王小明" + "李雷" * 9, None]
    terms = ["王小明", "李雷", "alpha beta", "gamma", "alpha", "李雷" * 9, "e" * 33, "明李", "absent", "a"]
    rows = novel(spark, *lines)
    roster = spark.createDataFrame([(t,) for t in [*terms, None, "alpha"]], "term string")
    want = sorted((n + 1, t) for n, x in enumerate(lines) for t in terms if x is not None and t in x)
    for bound in (context.ROSTER_BYTES, 0):
        assert sorted((r.line_no, r.term) for r in context.leaks(rows, roster, bound=bound).collect()) == want
    every = context.leaks(rows, spark.createDataFrame([("",)], "term string"))
    assert sorted(r.line_no for r in every.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert context.leaks(rows, roster.limit(0)).count() == 0


def test_leaks_across_segments(spark, monkeypatch):
    import random

    import pyarrow as pa

    from loomline.operators import roster

    monkeypatch.setattr(roster, "SEGMENT", 7)
    r = random.Random(1)
    lines = ["".join(r.choice("ab王") for _ in range(r.randint(0, 60))) for _ in range(60)]
    terms = sorted({x[i : i + r.randint(1, 40)] for x in lines for i in range(0, len(x), 9)})
    line, term = roster.Roster([t.encode() for t in terms]).found(pa.array(lines).slice(3))
    assert list(zip(line.to_pylist(), term.to_pylist())) == sorted(((i, t) for i, x in enumerate(lines[3:]) for t in terms if t in x), key=lambda p: (p[0], p[1].encode()))


def test_a_line_may_reveal_several_names(spark):
    rows = spark.createDataFrame([(1, 1, "某人来了"), (1, 2, "吾乃甲乙"), (1, 3, "我的名字是甲乙。吾乃丙丁"), (1, 4, "吾乃甲乙"), (2, 1, "某人"), (2, 2, "吾乃甲乙"), (2, 3, "吾乃甲乙"), (2, 5, "吾乃戊己")], "doc_id long, line_no long, line string")
    targets = spark.createDataFrame([(1, 1, "甲乙"), (1, 1, "丙丁"), (1, 3, "甲乙"), (2, 1, "甲乙"), (2, 2, "甲乙"), (2, 5, "x")], "doc_id long, line_no long, descriptor string")
    got = {(r.doc_id, r.line_no, r.descriptor): (r.name, r.reveal_line) for r in context.reveal_for(rows, targets).collect()}
    assert got == {(1, 1, "甲乙"): ("丙丁", 3), (1, 1, "丙丁"): ("甲乙", 2), (1, 3, "甲乙"): (None, None), (2, 1, "甲乙"): ("戊己", 5), (2, 2, "甲乙"): ("戊己", 5), (2, 5, "x"): (None, None)}


def test_a_stream_of_several_batches_and_a_restart(spark, tmp_path):
    from loomline.streaming import vault_stream

    schema = "name string, alias string, verified boolean, line_no long, introduces boolean, ord long"
    put = lambda rows, k: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([("a", "x", False, 3, False, 1)], 0)
    put([("a", "y", True, 5, True, 2), ("b", None, False, 1, False, 3)], 1)
    stream = lambda: vault_stream.vault_updates(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    read = lambda: {r.name: (set(r.aliases.split("|")), r.status, r.evidence, r.last_seen_line) for r in vault_stream.drained(stream(), "update", ("name",), f"{tmp_path}/out").collect()}
    assert read() == {"a": ({"x", "y"}, "verified", 2, 5), "b": ({""}, "candidate", 1, 1)}
    put([("a", "z", False, 9, False, 4)], 2)
    assert read() == {"a": ({"x", "y", "z"}, "verified", 3, 9), "b": ({""}, "candidate", 1, 1)}
    assert read()["a"] == ({"x", "y", "z"}, "verified", 3, 9)


def test_any_failure_of_a_provider_leads_to_the_next():
    from loomline.operators import annotate

    def broken(messages, tools):
        raise OSError("timed out")

    good = annotate.Provider("Good", "M2", lambda m, t: {"content": "ok"})
    chain = annotate.ProviderChain([annotate.Provider("Bad", "m1", broken), good], clock=lambda: 100.0, wait=lambda s: None)
    assert chain.call([{"role": "user", "content": "x"}])[0] == "Good" and chain.check([]) == ["Good"]
    assert [p.label for p in chain.select("good")] == ["Good"] and [p.label for p in chain.select("m")] == ["Bad", "Good"]


def test_calls_that_are_wanted_written_as_text_or_missing():
    asked, now = [], [100.0]
    wants = [{"role": "user", "content": "Call read_novel_lines first."}]
    tools = [annotate.tool_schema("read_novel_lines")]
    silent = annotate.Provider("silent", "m1", lambda m, t, *forced: asked.append(forced) or {"content": "I would rather not"}, forces=True)
    writes = annotate.Provider("writes", "m2", lambda m, t: {"content": "read_novel_lines(12, 5)"})
    chain = annotate.ProviderChain([silent, writes], clock=lambda: now[0], wait=lambda s: None)
    label, reply = chain.call(wants, tools)
    assert label == "writes" and reply["tool_calls"] == [{"function": "read_novel_lines", "arguments": {"start": 12, "count": 5}}] and reply["coerced"]
    assert asked == [("read_novel_lines",)] and silent.resting_until == 0
    assert chain.call([{"role": "user", "content": "who?"}], tools)[0] == "silent"
    with pytest.raises(annotate.ModelError, match="silent: no tool call"):
        annotate.ProviderChain([silent], clock=lambda: now[0], wait=lambda s: None).call(wants, tools)
    search = [annotate.tool_schema("search_novel")]
    assert annotate.call_in_text("search_novel('12', 3) read_novel_lines(1, 2)", search) == [{"function": "search_novel", "arguments": {"keyword": "12", "context_lines": 3}}]
    assert annotate.call_in_text("search_novel(\"x\")", search)[0]["arguments"] == {"keyword": "x"} and annotate.call_in_text("", search) == []


def test_tool_schemas_and_tool_check():
    schema = annotate.tool_schema("find_all_references")["function"]["parameters"]
    assert schema["required"] == ["name"] and schema["properties"] == {"name": {"type": "string"}, "max_results": {"type": "integer"}}
    assert annotate.tool_schema("other") == {"type": "function", "function": {"name": "other"}}
    call = {"tool_calls": [{"function": "read_novel_lines", "arguments": {}}]}
    able = annotate.Provider("able", "m1", lambda m, t: call if t else {"content": "OK"})
    unable = annotate.Provider("unable", "m2", lambda m, t: {"content": "read_novel_lines(1, 1)"})
    chain = annotate.ProviderChain([able, unable], clock=lambda: 100.0, wait=lambda s: None)
    assert chain.check([]) == ["able", "unable"] and chain.check([], [{"role": "user", "content": "x"}]) == ["able"] and unable.resting_until == 400


def test_commented_json_and_observed_counters(spark):
    rows = spark.createDataFrame([("// a\n{\"u\": \"http://x\"}",), ("{",), (None,)], "t string")
    assert [r.u for r in rows.select(readers.commented_json(F.col("t"), "u string").alias("v")).select("v.u").collect()] == ["http://x", None, None]
    log = spark.createDataFrame([], readers.LOG_SCHEMA)
    assert runlog.run_counters(log).collect()[0].asDict() == {"rounds": 0, "tool_calls": 0, "tokens": 0, "reviewed": 0, "corrected": 0}
    one = spark.sql("SELECT 1 AS x").select(F.from_json(F.lit('{"round": 1, "agents": {"Labeler": {"total_tokens": 3}}}'), readers.LOG_SCHEMA).alias("l")).select("l.*")
    rows, seen = runlog.observed(one)
    rows.collect()
    assert seen.get == {"rounds": 1, "tool_calls": 0, "tokens": 3, "reviewed": 0, "corrected": 0}
