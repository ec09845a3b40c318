"""Answer parsing, retries and tracing."""

import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from repovigil.functions.answers import first_json
from repovigil.operators import model, parse, rounds, trace, tree, turns
from repovigil.plans import model_calls
from repovigil.session import materialize


def scan_json(text):
    """First balanced object, one character at a time."""
    start = text.find("{")
    depth, quoted, hidden = 0, False, False
    for i in range(max(start, 0), len(text) if start >= 0 else 0):
        c = text[i]
        if hidden:
            hidden = False
        elif c == "\\":
            hidden = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start : i + 1]
    return None


TEXTS = [
    "", "none", "}{}", 'a {"x":"}"} b', '{"a":{"b":1}} {"c":2}', "{ unbalanced {}", r'{"a":"\"}"}', r"\{}", r"{\}}", r"{\\}", '{"é😀":"{"}x',
    '{"a":"line\nbreak"}', '{"open', "{}" * 3, "{" * 50 + "}" * 50, "x" * 5000 + '{"k":"' + "\\n" * 5000 + '"}', "{a\\",
]


def test_first_json_matches_a_character_scan(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r.j for r in rows.select("i", first_json(F.col("t")).alias("j")).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == scan_json(text), text


@pytest.fixture()
def answers(spark):
    return lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")


def errors(df):
    return [r.error for r in df.orderBy("i").collect()]


def test_blank_fields(answers):
    statuses = ['""', "0", "false", "null", "0.0", '"0"', "[]", "1", "true"]
    got = errors(parse.parse_trace(answers(*[f'{{"status":{s}}}' for s in statuses])))
    assert got[:5] == [parse.NO_STATUS] * 5
    assert [e.startswith("Unknown status: ") for e in got[5:]] == [True] * 4


def test_order_of_checklist_errors(answers):
    body = {"flow_name": "f", "required_controls": [], "recommended_controls": [], "references": []}
    wrong = []
    for name in body:
        wrong.append(json.dumps({"status": "completed", "result": {k: v for k, v in body.items() if k != name}}))
    got = errors(parse.parse_checklist(answers(*wrong, json.dumps({"status": "completed", "result": body}))))
    assert got == ["result missing 'flow_name'"] + [f"result missing '{n}' array" for n in list(body)[1:]] + [None]


def test_report_defaults(answers):
    body = {"flow_name": "f", "implemented": [], "missing": [], "auto_handled": [], "summary": {"vulnerabilities_count": "two"}}
    with_two = {**body, "vulnerabilities": [{"id": "a"}, {"id": "b"}]}
    odd = {**body, "vulnerabilities": {"id": "a"}}
    rows = parse.parse_report(answers(*[json.dumps({"status": "completed", "result": b}) for b in (body, with_two, odd)])).orderBy("i").collect()
    assert [r.summary.vulnerabilities_count for r in rows] == [0, 2, 0]
    assert [len(r.vulnerabilities) for r in rows] == [0, 2, 0]


GOOD = json.dumps({"status": "completed", "result": {"flow_name": "other", "required_controls": [], "recommended_controls": [], "references": []}})


def flows(spark, n):
    rows = spark.createDataFrame([(i, f"flow-{i}") for i in range(n)], "id int, flow_name string")
    return rows.select("id", "flow_name", F.lit("gpt").alias("model"), F.lit("s").alias("system"), model.user_prompt(F.col("flow_name")).alias("messages"))


def test_live_calls_see_the_feedback_and_errors_use_up_attempts(spark):
    def call(name, system, messages):
        flow = messages[0]["content"]
        if flow == "flow-0":
            return GOOD
        if flow == "flow-1":  # fails until it was told why
            return GOOD if "could not be parsed. Error: No JSON found" in messages[-1]["content"] else "no"
        if flow == "flow-2":
            raise RuntimeError("overloaded")
        return json.dumps({"status": "error", "message": "m"})

    out = rounds.retry_rounds(flows(spark, 4), model.live(call, 2), rounds.CHECKLIST).orderBy("id").collect()
    assert [(r.success, r.retries, len(r.messages)) for r in out] == [(True, 0, 2), (True, 1, 3), (False, 3, 4), (False, 3, 7)]
    assert out[2].error == "overloaded" and out[2].messages[-1].content.startswith("Your response could not be parsed. Error: overloaded")
    assert [r.flow_name for r in out] == [f"flow-{i}" for i in range(4)]
    assert out[3].messages[-1].content.startswith("Please try again and provide a valid security checklist")


def test_inspection_says_nothing_after_a_bad_answer(spark):
    replay = model.replay(spark.createDataFrame([(0, a, "bad") for a in range(3)], "id int, attempt int, text string"), ["id", "attempt"])
    row = rounds.retry_rounds(flows(spark, 1), replay, rounds.INSPECTION).first()
    assert (row.success, row.retries, len(row.messages)) == (False, 3, 1)


def traced(files, answer, max_depth=10):
    rows = files([("r", "a.ts", "A"), ("r", "b.ts", "B"), ("r", "empty.ts", "")])
    trees = materialize(tree.tree_text(tree.render_tree(rows)))

    def call(name, system, messages):
        out = answer([dict(m) for m in messages])
        return out if isinstance(out, str) else json.dumps(out)

    out = trace.trace_rounds(rows, trees, model.live(call, 1), "gpt", "s", max_depth)
    return out.profiles.collect(), out.states.first(), out


def test_depth_limit_warns_and_ends(files):
    def answer(messages):
        if len(messages) == 1:
            return {"status": "pick_endpoint", "file_to_read_next": "a.ts"}
        return {"status": "tracing_endpoint", "endpoint_being_traced": "E", "file_to_read_next": "b.ts"}

    profiles, final, log = traced(files, answer, max_depth=3)
    assert profiles == [] and final.status == "depth_reached" and final.call_no == 4
    warned = [m.content for m in final.messages if m.content.startswith("⚠️ You have reached the maximum analysis depth of 3")]
    assert len(warned) == 2  # after the second and the third call
    assert any(m.content.startswith("You've already read this file") for m in final.messages)
    assert trace.trace_transcripts(log).first().endpoint == "E"


def test_missing_pick_ends_and_empty_file_counts_as_missing(files):
    profiles, final, _ = traced(files, lambda m: {"status": "pick_endpoint", "file_to_read_next": "empty.ts"})
    assert profiles == [] and final.status == "finished" and final.call_no == 2


def test_unreadable_answers_cost_no_depth_and_end_without_messages(files):
    profiles, final, _ = traced(files, lambda m: "what?")
    assert (final.status, final.depth, final.call_no, len(final.messages)) == ("no_messages", 0, 2, 0)


def test_tracing_goes_on_until_nothing_is_left(files):
    def answer(messages):
        done = messages[0]["content"].count("- GET /")
        if done == 8:
            return {"status": "not_found"}
        return {"status": "completed", "result": {"flow_name": f"F{done}", "entry_point": f"GET /{done}"}}

    profiles, final, _ = traced(files, answer)
    assert final.status == "finished" and sorted(p.flow_name for p in profiles) == [f"F{k}" for k in range(8)]


def test_repeated_keys_and_repeated_answers(spark):
    rows = spark.createDataFrame([(0, '{"status":"error","status":"completed","result":{"flow_name":"A","required_controls":[],"recommended_controls":[],"references":[]}}')], "id int, text string")
    got = parse.parse_checklist(rows).first()
    assert got.error is None and got.status == "completed"
    twice = spark.createDataFrame([(0, 0, "b"), (0, 0, "a")], "id int, attempt int, text string")
    asked = spark.createDataFrame([(0, 0)], "id int, attempt int")
    assert [r.text for r in model.replay(twice, ["id", "attempt"])(asked).collect()] == ["a"]


def test_known_answers_are_worked_out_once(spark, tmp_path):
    """Every round of a loop asks the responder; the answers' source is not read again."""
    spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "id int, attempt int, text string").write.parquet(f"{tmp_path}/answers")
    respond = model.replay(spark.read.parquet(f"{tmp_path}/answers"), ["id", "attempt"])
    asked = spark.createDataFrame([(0, 1), (0, 2)], "id int, attempt int")
    assert not any(str(tmp_path) in f for f in respond(asked).inputFiles())
    assert [(r.attempt, r.text) for r in respond(asked).orderBy("attempt").collect()] == [(1, "b"), (2, None)]


def test_missing_file_serves_the_queue(files):
    def answer(messages):
        if len(messages) == 1 and "- GET /a" in messages[0]["content"]:
            return {"status": "not_found"}
        if len(messages) == 1:
            return {"status": "tracing_endpoint", "endpoint_being_traced": "E", "file_to_read_next": "zz", "files_to_read_later": ["b.ts", "a.ts"]}
        assert messages[-2]["content"].startswith("File not found: zz") and messages[-1]["content"].startswith("**File: b.ts**")
        return {"status": "completed", "result": {"flow_name": "F", "entry_point": "GET /a", "input_types": ["i"], "mark_down": "#"}}

    profiles, final, _ = traced(files, answer)
    assert [(p.flow_name, p.entry_point, p.input_types) for p in profiles] == [("F", "GET /a", ["i"])]
    assert final.status == "finished" and final.processed == ["GET /a"]


def test_failed_call_discards_profiles(files):
    def answer(messages):
        if "- GET /a" in messages[0]["content"]:
            raise RuntimeError("down")
        return {"status": "completed", "result": {"flow_name": "F", "entry_point": "GET /a"}}

    profiles, final, _ = traced(files, answer)
    assert profiles == [] and final.status == "failed"


def test_conversations_are_told_in_full_and_written_once(spark, files):
    """Seven calls about a large file: turns hold its text as often as it was said, whatever the rounds."""
    rows = files([("r", "a.ts", "A" * 50_000), ("r", "b.ts", "B")])
    seen = []

    def answer(name, system, messages):
        n = len(messages)
        if n == 1:
            return json.dumps({"status": "pick_endpoint", "file_to_read_next": "a.ts"})
        if n < 13:
            return json.dumps({"status": "tracing_endpoint", "endpoint_being_traced": "E", "file_to_read_next": "b.ts"})
        if "- GET /x" in messages[0]["content"]:
            return json.dumps({"status": "not_found"})
        assert sum(m["content"].count("A" * 50_000) for m in messages) == 1
        return json.dumps({"status": "not_found"})

    parts = materialize(tree.tree_parts(tree.render_tree(rows)))
    out = trace.trace_rounds(rows, parts, model.live(answer, 1, parts), "gpt", "s")
    state = out.states.first()
    assert state.status == "finished" and state.call_no == 8
    assert [m.role for m in state.messages] == ["user"] + ["assistant", "user"] * 6 + ["assistant"]
    stored = spark.read.parquet(out.turns.folder)
    assert stored.count() == 14 and stored.selectExpr("sum(length(content))").first()[0] < 60_000
    told = trace.trace_transcripts(out).first().conversation
    assert [m.role for m in told] == ["user"] + ["assistant", "user"] * 6 + ["assistant"] and "A" * 50_000 in told[2].content


def test_messages_name_the_tree_and_calls_see_it(spark, files, monkeypatch):
    monkeypatch.setattr(tree, "CHUNK_LINES", 1000)
    rows = files([("r", f"src/f{i}.ts", "") for i in range(4500)] + [("q", "x.ts", "")])
    parts = materialize(tree.tree_parts(tree.render_tree(rows)))
    assert parts.filter("repo_id = 'r'").count() > 1
    whole = {r.repo_id: r.tree for r in tree.tree_text(tree.render_tree(rows)).collect()}

    def answer(name, system, messages):
        assert messages[0]["content"].count("```\n" + whole["r" if "f4499" in messages[0]["content"] else "q"] + "\n```") == 1
        return json.dumps({"status": "not_found"})

    out = trace.trace_rounds(rows, parts, model.live(answer, 2, parts), "gpt", "s")
    for state in out.states.collect():
        assert state.status == "finished" and turns.TREE in state.messages[0].content
    prompts_ = spark.createDataFrame([("r", i) for i in range(50)] + [("q", 0), ("none", 0)], "repo_id string, n int")
    lengths = turns.with_trees(prompts_, parts, lambda rows, text: rows.assign(length=len(text)), "repo_id string, n int, length int", per_slice=7)
    got = sorted(map(tuple, lengths.collect()))
    assert got == sorted([("r", i, len(whole["r"])) for i in range(50)] + [("q", 0, len(whole["q"])), ("none", 0, 0)])


def test_cancelled_jobs_leave_between_rounds(spark, files):
    rows = files([("a", "a.ts", "A"), ("b", "a.ts", "A"), ("c", "a.ts", "A")])
    trees = materialize(tree.tree_text(tree.render_tree(rows)))
    rounds_ = []

    def answer(name, system, messages):
        done = messages[0]["content"].count("- GET /")
        if done == 3:
            return json.dumps({"status": "not_found"})
        return json.dumps({"status": "completed", "result": {"flow_name": f"F{done}", "entry_point": f"GET /{done}"}})

    def cancelled():
        rounds_.append(None)
        gone = {1: ["c"], 3: ["c", "b", "zz"]}.get(len(rounds_), ["c", "b"] if len(rounds_) > 3 else ["c"])
        return spark.createDataFrame([(g,) for g in gone], "repo_id string")

    out = trace.trace_rounds(rows, trees, model.live(answer, 1), "gpt", "s", cancelled=cancelled)
    assert {r.repo_id: (r.status, r.call_no) for r in out.states.collect()} == {"a": ("finished", 5), "b": ("cancelled", 3), "c": ("cancelled", 1)}
    assert sorted((p.repo_id, p.pos) for p in out.profiles.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    everyone = lambda: spark.createDataFrame([("a",), ("b",), ("c",)], "repo_id string")
    none = trace.trace_rounds(rows, trees, model.live(answer, 1), "gpt", "s", cancelled=everyone)
    assert {r.status for r in none.states.collect()} == {"cancelled"} and none.profiles.count() == 0


def test_prompt_digests_encode_the_tree_once():
    read = []

    class Tree(str):
        def encode(self, *_):
            read.append(1)
            return super().encode()

    said = [f"a{turns.TREE}b{k}" for k in range(50)] + [turns.TREE * 2, "none", f"x{turns.TREE}", f"a{turns.TREE}é{turns.TREE}z"]
    tree = Tree("├── f\n" * 100)
    rows = pd.DataFrame({"repo_id": "r", "flow_name": [str(k) for k in range(len(said))], "prompt": said})
    plain = [hashlib.md5(p.replace(turns.TREE, str(tree)).encode()).hexdigest() for p in said]
    read.clear()
    assert model_calls._digest(rows, tree)["prompt_md5"].tolist() == plain
    assert len(read) == 1
