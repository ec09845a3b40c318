"""Registered queries: prompts, replayed model calls, answer parsing, retries, tracing."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from repovigil.functions.answers import first_json
from repovigil.operators import detect, model, parse, prompts, rounds, trace, tree, turns
from repovigil.plans import cleaning, navigation
from repovigil.plans.corpus import FILES_CORPUS, from_sql, view, with_views
from repovigil.session import materialize

FLOWS = """
SELECT source AS repo_id, doc_id AS pos, 'flow-' || CAST(doc_id AS STRING) AS flow_name, 'Handles ' || lang AS purpose,
  'GET /' || CAST(doc_id AS STRING) AS entry_point,
  CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'id: string' ELSE 'id: string;page: number' END AS inputs,
  CASE doc_id % 2 WHEN 0 THEN '' ELSE 'item: Item' END AS outputs,
  CASE doc_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS sensitivity_level,
  text AS mark_down, doc_id % 3 AS n_required, doc_id % 2 AS n_recommended
FROM documents
"""
# Every way an answer can be right or wrong, one arm each.
ARMS = [
    '{"status":"pick_endpoint","file_to_read_next":"src/a.ts"}',
    '{"status":"pick_endpoint","file_to_read_next":""}',
    'Next: {"status":"tracing_endpoint","endpoint_being_traced":"GET /x","file_to_read_next":"b.ts"} ok',
    '{"status":"tracing_endpoint","file_to_read_next":"b.ts"}',
    '{"status":"completed","result":{"flow_name":"A","required_controls":[{"control_id":"C1","name":"n","owasp_mapping":["A01"]}],"recommended_controls":[],"references":[]}}',
    '{"status":"completed","result":{"flow_name":"A","required_controls":{},"recommended_controls":[],"references":[]}}',
    '{"status":"completed","result":{"flow_name":"B","implemented":[{"control_id":"C1"}],"missing":[{"control_id":"C2","severity":"high"}],"auto_handled":[],"summary":{"total_controls":2,"overall_severity":"high"}}}',
    '{"status":"completed","result":{"flow_name":"B","implemented":[],"missing":[],"auto_handled":[],"vulnerabilities":[{"id":"V1"},{"id":"V2"}],"summary":{"vulnerabilities_count":7,"overall_severity":"none"}}}',
    '{"status":"completed","result":{"flow_name":"B","implemented":[],"missing":[],"auto_handled":[],"summary":null}}',
    '{"status":"completed","result":""}',
    '{"status":"error","message":"too hard"}',
    '{"status":"not_found"}',
    '{"status":0}',
    "{'status':'completed'}",
    '{"status":"completed"',
    '{"status":"later"}',
]
ANSWERS = (
    "SELECT conv_id, turn, text || chr(10) || CASE (conv_id * 7 + turn) % 16 "
    + " ".join(f"WHEN {i} THEN '{arm.replace(chr(39), chr(39) * 2)}'" for i, arm in enumerate(ARMS))
    + " END AS text, (conv_id * 7 + turn) % 16 AS arm FROM conversations"
)
# Every three turns of a conversation answer the three attempts of one flow.
ATTEMPTS = """
SELECT conv_id * 1000000 + CAST(floor(n / 3) AS BIGINT) AS conv_id, CAST(n % 3 AS INT) AS attempt, text, arm
FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, text, arm FROM ({answers}) a) b
"""
TRACE_SCRIPT = f"""
SELECT repo_id, call_no, CASE call_no
    WHEN 1 THEN '{{"status":"pick_endpoint","file_to_read_next":"' || a || '"}}'
    WHEN 2 THEN 'cannot say'
    WHEN 3 THEN '{{"status":"tracing_endpoint","endpoint_being_traced":"GET /a","file_to_read_next":"no/such.file","files_to_read_later":["' || b || '","README.md"]}}'
    WHEN 4 THEN '{{"status":"tracing_endpoint","endpoint_being_traced":"GET /a","file_to_read_next":"./' || a || '"}}'
    WHEN 5 THEN '{{"status":"completed","result":{{"flow_name":"A of ' || repo_id || '","purpose":"p","entry_point":"GET /a","input_types":["id"],"output_types":[],"sensitivity_level":"high","mark_down":"# A"}}}}'
    ELSE CASE rn % 3 WHEN 0 THEN '{{"status":"not_found"}}' WHEN 1 THEN '{{"status":"pick_endpoint","file_to_read_next":"missing.ts"}}' END
  END AS text
FROM (SELECT repo_id, CAST(substr(repo_id, 4) AS INT) AS rn, min(CASE WHEN path LIKE 'src/routes/%' THEN path END) AS a,
        max(CASE WHEN path LIKE 'src/routes/%' THEN path END) AS b FROM ({FILES_CORPUS}) c GROUP BY repo_id) r
LATERAL VIEW explode(sequence(1, 6)) v AS call_no
"""


def _types(column):
    return F.when(F.col(column) == "", F.array().cast("array<string>")).otherwise(F.split(column, ";"))


def _flows(spark, sf):
    def controls(n, prefix):
        made = F.transform(
            F.sequence(F.lit(1), F.col(n).cast("int")),
            lambda i: F.struct(
                F.concat(F.lit(prefix), i).alias("control_id"), F.lit("Name").alias("name"),
                F.lit("Do it").alias("description"), F.lit("high").alias("importance"),
            ),
        )
        return F.when(F.col(n) > 0, made).otherwise(F.slice(made, 1, 0))

    return from_sql(spark, sf, FLOWS).select(
        "repo_id", "pos", "flow_name", "purpose", "entry_point", "sensitivity_level", "mark_down",
        _types("inputs").alias("input_types"), _types("outputs").alias("output_types"),
        controls("n_required", "R-").alias("required_controls"),
        controls("n_recommended", "O-").alias("recommended_controls"),
    )


def _trees(spark, sf):
    return tree.tree_parts(tree.render_tree(view(spark, sf, "files_corpus").select("repo_id", "ord", "path")))


#: Prompts that are digested beside one copy of their tree; a prompt without its tree is about a kilobyte.
PROMPTS = 20_000


def _digest(rows, text):
    """The prompts of some rows with their tree, as digests.

    What stands before the tree is the same in all prompts of a repository, so the tree is encoded and read once for
    each such beginning and not once a prompt.
    """
    begun, tree_bytes = {}, text.encode()

    def digest(prompt):
        head, *rest = prompt.split(turns.TREE)
        if not rest:
            return hashlib.md5(prompt.encode()).hexdigest()
        if head not in begun:
            begun[head] = hashlib.md5(head.encode())
            begun[head].update(tree_bytes)
        whole = begun[head].copy()
        whole.update(rest[0].encode())
        for part in rest[1:]:
            whole.update(tree_bytes)
            whole.update(part.encode())
        return whole.hexdigest()

    # a null prompt fails here as it did before
    return rows.drop(columns="prompt").assign(prompt_md5=rows["prompt"].map(digest))


def render_checklist_prompts(spark, sf):
    flows = _flows(spark, sf).drop("mark_down", "required_controls", "recommended_controls")
    frameworks = detect.detect_frameworks(view(spark, sf, "files_corpus"))
    out = prompts.render_checklist_prompts(flows, frameworks).select("repo_id", "flow_name", "prompt")
    return turns.with_trees(out, _trees(spark, sf), _digest, "repo_id string, flow_name string, prompt_md5 string", PROMPTS)


def render_inspection_prompts(spark, sf):
    return prompts.render_inspection_prompts(_flows(spark, sf)).select("repo_id", "flow_name", F.md5("prompt").alias("prompt_md5"))


def render_trace_prompts(spark, sf):
    number = F.substring("repo_id", 4, 9).cast("int") % 3
    done = view(spark, sf, "files_corpus").select("repo_id").distinct().select(
        "repo_id", F.slice(F.array(F.lit("GET /a"), F.lit("POST /b")), F.lit(1), number).alias("endpoints")
    )
    trees = materialize(_trees(spark, sf))
    out = prompts.render_trace_prompts(trees, done)
    return turns.with_trees(out, trees, _digest, "repo_id string, prompt_md5 string")


def _calls(spark, sf):
    turns = from_sql(spark, sf, "SELECT conv_id, turn, role, text FROM conversations")
    return turns.filter("role = 'user'").select(
        "conv_id", "turn",
        F.expr("CASE conv_id % 4 WHEN 0 THEN 'claude-x' WHEN 1 THEN 'gemini-y' WHEN 2 THEN 'models/gemini-z' ELSE 'gpt-w' END").alias("model"),
        F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("system"),
        model.user_prompt(F.col("text")).alias("messages"),
    )


def call_model(spark, sf):
    calls = _calls(spark, sf)
    answers = from_sql(spark, sf, "SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant'")
    known = calls.withColumn("prompt_hash", model.prompt_hash()).join(answers, ["conv_id", "turn"]).select("prompt_hash", "text")
    out = model.call_model(calls, model.replay(known))
    return out.select("conv_id", "turn", "model", "provider", F.md5("text").alias("text_md5"), "call_error")


def extract_first_json(spark, sf):
    return view(spark, sf, "model_responses").select("conv_id", "turn", first_json(F.col("response")).alias("json"))


def parse_trace(spark, sf):
    return parse.parse_trace(from_sql(spark, sf, ANSWERS)).select(
        "conv_id", "turn", "error", "status", "file_to_read_next", "endpoint_being_traced",
        F.size("files_to_read_later").cast("bigint").alias("n_later"), F.col("profile.flow_name").alias("flow_name"),
    )


def parse_checklist(spark, sf):
    return parse.parse_checklist(from_sql(spark, sf, ANSWERS)).select(
        "conv_id", "turn", "error", "status", "message", "answer_flow_name",
        F.size("required_controls").cast("bigint").alias("n_required"),
        F.get("required_controls", F.lit(0))["control_id"].alias("first_control"),
    )


def parse_report(spark, sf):
    return parse.parse_report(from_sql(spark, sf, ANSWERS)).select(
        "conv_id", "turn", "error", "status", "answer_flow_name",
        F.size("missing").cast("bigint").alias("n_missing"), F.size("vulnerabilities").cast("bigint").alias("n_vulnerabilities"),
        F.col("summary.total_controls").alias("total_controls"),
        F.col("summary.vulnerabilities_count").alias("vulnerabilities_count"),
        F.col("summary.overall_severity").alias("overall_severity"),
    )


def _retried(task):
    def run(spark, sf):
        answers = from_sql(spark, sf, ATTEMPTS.format(answers=ANSWERS)).drop("arm")
        flows = answers.select("conv_id").distinct().select(
            "conv_id",
            F.concat(F.lit("flow-"), "conv_id").alias("flow_name"),
            F.lit("gpt-w").alias("model"),
            F.lit("system").alias("system"),
            model.user_prompt(F.concat(F.lit("prompt "), "conv_id")).alias("messages"),
        )
        return rounds.retry_rounds(flows, model.replay(answers, ["conv_id", "attempt"]), task)

    return run


def _retry_query(task):
    def run(spark, sf):
        return _retried(task)(spark, sf).select(
            "conv_id", "flow_name", "success", F.col("retries").cast("bigint").alias("retries"), "error",
            F.size("messages").cast("bigint").alias("n_messages"), F.element_at("messages", -1)["role"].alias("last_role"),
        )

    return run


def transcripts(spark, sf):
    out = rounds.transcripts(_retried(rounds.CHECKLIST)(spark, sf), "checklists", ["conv_id"])
    return out.select(
        "conv_id", "agent", "flow_name", "success", F.col("retries").cast("bigint").alias("retries"),
        F.array_join(F.transform("conversation", lambda m: m["role"]), ",").alias("roles"),
    )


def _traced(spark, sf):
    script = from_sql(spark, sf, TRACE_SCRIPT).filter("text IS NOT NULL")
    files = view(spark, sf, "files_corpus")
    return trace.trace_rounds(files, _trees(spark, sf), model.replay(script, ["repo_id", "call_no"]), "gpt-w", "system")


def trace_rounds(spark, sf):
    _, final, _ = _traced(spark, sf)
    return final.select(
        "repo_id", "status", *[F.col(c).cast("bigint").alias(c) for c in ("endpoint_no", "depth", "call_no")],
        F.size("messages").cast("bigint").alias("n_messages"), F.array_join("processed", ",").alias("processed"),
    )


def flow_profiles(spark, sf):
    profiles, _, _ = _traced(spark, sf)
    out = trace.flow_profiles(profiles)
    return out.select(
        "repo_id", F.col("pos").cast("bigint").alias("pos"), "flow_name", "purpose", "entry_point", "sensitivity_level",
        F.array_join("input_types", ",").alias("input_types"), F.array_join("output_types", ",").alias("output_types"),
    )


def trace_transcripts(spark, sf):
    return trace.trace_transcripts(_traced(spark, sf)).select(
        "repo_id", F.col("endpoint_no").cast("bigint").alias("endpoint_no"), "endpoint",
        F.size("conversation").cast("bigint").alias("n_messages"), F.array_join("files_read", ",").alias("files_read"),
    )


# ------------------------------------------------------------------------------------------ SQL


def _prompt_sql(template, values):
    pieces = []
    for i, part in enumerate(template.split("{")):
        if i:
            name, part = part.split("}", 1)
            pieces.append(values[name])
        pieces.append("'" + part.replace("'", "''") + "'")
    return " || ".join(pieces)


_LIST = "coalesce(NULLIF(replace({c}, ';', ', '), ''), '{empty}')"
_BASE = {c: c for c in ("flow_name", "purpose", "entry_point", "sensitivity_level")}
_TREES = f"""{navigation._tree('SELECT repo_id, ord, path FROM files_corpus')},
trees AS (SELECT repo_id, string_agg(line || chr(10), '' ORDER BY line_no) AS tree FROM lines GROUP BY repo_id)"""


def _lines(n, prefix, kind):
    one = f"'- [{prefix}' || i || '] Name (high): Do it'"
    return f"CASE WHEN {n} = 0 THEN 'No {kind} controls.' ELSE list_aggregate(list_transform(range(1, {n} + 1), lambda i: {one}), 'string_agg', chr(10)) END"


_NO, _BAD, _MISS = parse.NO_JSON, parse.BAD_JSON, parse.NO_STATUS


def _by_arm(values, default="NULL"):
    return "CASE arm " + " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in values.items()) + f" ELSE {default} END"


_COMMON = {12: _MISS, 13: _BAD, 14: _NO, 15: "Unknown status: later"}
_UNFIT = {0: "Unknown status: pick_endpoint", 1: "Unknown status: pick_endpoint", 2: "Unknown status: tracing_endpoint",
          3: "Unknown status: tracing_endpoint", 11: "Unknown status: not_found", 9: "completed response missing 'result'"}
_TRACE_ERR = {**_COMMON, 1: "pick_endpoint response missing 'file_to_read_next'",
              3: "tracing_endpoint response missing 'endpoint_being_traced'", 9: "completed response missing 'result'",
              10: "Unknown status: error"}
_LIST_ERR = {**_COMMON, **_UNFIT, 5: "result missing 'required_controls' array", 6: "result missing 'required_controls' array",
             7: "result missing 'required_controls' array", 8: "result missing 'required_controls' array"}
_REPORT_ERR = {**_COMMON, **_UNFIT, 4: "result missing 'implemented' array", 5: "result missing 'implemented' array",
               8: "result missing 'summary'"}


def _retry_sql(errors, bad_messages, columns):
    # expected errors by arm; a missing answer is a failed call
    return f"""WITH answers AS ({ATTEMPTS.format(answers=ANSWERS)}),
convs AS (SELECT DISTINCT conv_id FROM answers),
tries AS (SELECT c.conv_id, t.attempt, arm, CASE WHEN a.conv_id IS NULL THEN 'Unknown error' ELSE {_by_arm(errors)} END AS err
  FROM convs c CROSS JOIN (VALUES (0), (1), (2)) t(attempt) LEFT JOIN answers a ON a.conv_id = c.conv_id AND a.attempt = t.attempt),
kinds AS (SELECT *, CASE WHEN err IS NOT NULL THEN 'bad' WHEN arm = 10 THEN 'refused' ELSE 'good' END AS kind FROM tries),
won AS (SELECT conv_id, min(attempt) FILTER (kind = 'good') AS w FROM kinds GROUP BY conv_id),
used AS (SELECT k.*, w FROM kinds k JOIN won USING (conv_id) WHERE w IS NULL OR attempt <= w),
outcome AS (SELECT conv_id, w IS NOT NULL AS success, coalesce(w, 3)::BIGINT AS retries, last(err ORDER BY attempt) AS error,
  CAST(1 + sum(CASE kind WHEN 'good' THEN 1 WHEN 'refused' THEN 2 ELSE {bad_messages} END) AS BIGINT) AS n_messages,
  CASE WHEN w IS NOT NULL THEN 'assistant' ELSE 'user' END AS last_role,
  'user' || string_agg(CASE kind WHEN 'good' THEN ',assistant' WHEN 'refused' THEN ',assistant,user' ELSE {"',user'" if bad_messages else "''"} END, '' ORDER BY attempt) AS roles
  FROM used GROUP BY conv_id, w)
SELECT conv_id, 'flow-' || conv_id AS flow_name, {columns} FROM outcome"""


_REPOS = f"{with_views('files_corpus')}, r AS (SELECT repo_id, CAST(substr(repo_id, 4) AS INT) % 3 AS k, bool_or(path = 'README.md') AS readme, min(path) FILTER (path LIKE 'src/routes/%') AS a, max(path) FILTER (path LIKE 'src/routes/%') AS b FROM files_corpus GROUP BY repo_id)"

SQL = {
    "render_checklist_prompts": f"""{cleaning._FILES}, {cleaning._DETECT}, {_TREES}, flows AS ({FLOWS})
        SELECT repo_id, flow_name, md5({_prompt_sql(prompts.CHECKLIST_PROMPT, {**_BASE, 'framework': 'framework', 'confidence': 'confidence',
            'indicators': "replace(indicators, '|', ', ')", 'tree': 'tree', 'input_types': _LIST.format(c='inputs', empty='None specified'),
            'output_types': _LIST.format(c='outputs', empty='None specified')})}) AS prompt_md5
        FROM flows JOIN fw USING (repo_id) JOIN trees USING (repo_id)""",
    "render_inspection_prompts": f"""WITH flows AS ({FLOWS}) SELECT repo_id, flow_name, md5({_prompt_sql(prompts.INSPECTION_PROMPT, {**_BASE,
            'mark_down': 'mark_down', 'input_types': _LIST.format(c='inputs', empty='None'), 'output_types': _LIST.format(c='outputs', empty='None'),
            'required': _lines('n_required', 'R-', 'required'), 'recommended': _lines('n_recommended', 'O-', 'recommended')})}) AS prompt_md5 FROM flows""",
    "render_trace_prompts": f"""{cleaning._FILES}, {_TREES} SELECT repo_id, md5({_prompt_sql(prompts.TRACE_PROMPT, {'tree': 'tree',
            'processed': "CASE CAST(substr(repo_id, 4) AS INT) % 3 WHEN 0 THEN '(none yet)' WHEN 1 THEN '- GET /a' ELSE '- GET /a' || chr(10) || '- POST /b' END"})}) AS prompt_md5 FROM trees""",
    "call_model": """SELECT u.conv_id, u.turn, CASE u.conv_id % 4 WHEN 0 THEN 'claude-x' WHEN 1 THEN 'gemini-y' WHEN 2 THEN 'models/gemini-z' ELSE 'gpt-w' END AS model,
        CASE u.conv_id % 4 WHEN 0 THEN 'anthropic' WHEN 3 THEN 'openai' ELSE 'google' END AS provider, md5(a.text) AS text_md5,
        CASE WHEN a.text IS NULL THEN 'Unknown error' END AS call_error
        FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""",
    "extract_first_json": """SELECT conv_id, turn, CASE (conv_id + turn) % 6
        WHEN 0 THEN '{"status":"completed","result":{"flow_name":"F' || conv_id || '","required_controls":[],"recommended_controls":[],"references":[]}}'
        WHEN 1 THEN '{"status":"error","message":"no"}' WHEN 3 THEN '{"result":{}}' WHEN 4 THEN '{"status":"completed"}'
        WHEN 5 THEN '{"status":"odd","m":"a } b ' || chr(92) || chr(34) || ' {"}' END AS json FROM conversations WHERE role = 'assistant'""",
    "parse_trace": f"""WITH a AS ({ANSWERS}), e AS (SELECT *, {_by_arm(_TRACE_ERR)} AS error FROM a)
        SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN CASE arm WHEN 0 THEN 'pick_endpoint' WHEN 2 THEN 'tracing_endpoint' WHEN 11 THEN 'not_found' ELSE 'completed' END END AS status,
          CASE arm WHEN 0 THEN 'src/a.ts' WHEN 2 THEN 'b.ts' END AS file_to_read_next, CASE arm WHEN 2 THEN 'GET /x' END AS endpoint_being_traced,
          CASE arm WHEN 2 THEN CAST(0 AS BIGINT) END AS n_later, CASE WHEN arm IN (4, 5) THEN 'A' WHEN arm IN (6, 7, 8) THEN 'B' END AS flow_name FROM e""",
    "parse_checklist": f"""WITH a AS ({ANSWERS}), e AS (SELECT *, {_by_arm(_LIST_ERR)} AS error FROM a)
        SELECT conv_id, turn, error, CASE arm WHEN 4 THEN 'completed' WHEN 10 THEN 'error' END AS status, CASE arm WHEN 10 THEN 'too hard' END AS message,
          CASE arm WHEN 4 THEN 'A' END AS answer_flow_name, CASE arm WHEN 4 THEN CAST(1 AS BIGINT) END AS n_required, CASE arm WHEN 4 THEN 'C1' END AS first_control FROM e""",
    "parse_report": f"""WITH a AS ({ANSWERS}), e AS (SELECT *, {_by_arm(_REPORT_ERR)} AS error FROM a)
        SELECT conv_id, turn, error, CASE WHEN arm IN (6, 7) THEN 'completed' WHEN arm = 10 THEN 'error' END AS status,
          CASE WHEN arm IN (6, 7) THEN 'B' END AS answer_flow_name, CAST(CASE arm WHEN 6 THEN 1 WHEN 7 THEN 0 END AS BIGINT) AS n_missing,
          CAST(CASE arm WHEN 6 THEN 0 WHEN 7 THEN 2 END AS BIGINT) AS n_vulnerabilities, CAST(CASE arm WHEN 6 THEN 2 END AS BIGINT) AS total_controls,
          CAST(CASE arm WHEN 6 THEN 0 WHEN 7 THEN 7 END AS BIGINT) AS vulnerabilities_count, CASE arm WHEN 6 THEN 'high' WHEN 7 THEN 'none' END AS overall_severity FROM e""",
    "retry_rounds_checklists": _retry_sql(_LIST_ERR, 1, "success, retries, error, n_messages, last_role"),
    "retry_rounds_inspection": _retry_sql(_REPORT_ERR, 0, "success, retries, error, n_messages, last_role"),
    "transcripts": _retry_sql(_LIST_ERR, 1, "'checklists' AS agent, success, retries, roles"),
    "trace_rounds": f"""{_REPOS} SELECT repo_id, CASE k WHEN 2 THEN 'failed' ELSE 'finished' END AS status, CAST(2 AS BIGINT) AS endpoint_no,
        CAST(CASE k WHEN 2 THEN 0 ELSE 1 END AS BIGINT) AS depth, CAST(7 AS BIGINT) AS call_no,
        CAST(CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS BIGINT) AS n_messages, 'GET /a' AS processed FROM r""",
    "flow_profiles": f"""{_REPOS} SELECT repo_id, CAST(1 AS BIGINT) AS pos, 'A of ' || repo_id AS flow_name, 'p' AS purpose, 'GET /a' AS entry_point,
        'high' AS sensitivity_level, 'id' AS input_types, '' AS output_types FROM r WHERE k <> 2""",
    "trace_transcripts": f"""{_REPOS} SELECT repo_id, CAST(1 AS BIGINT) AS endpoint_no, 'GET /a' AS endpoint, CAST(8 AS BIGINT) AS n_messages,
          CASE WHEN a <> b THEN a || ',' || b WHEN readme THEN a || ',README.md' ELSE a END || ',./' || a AS files_read FROM r
        UNION ALL SELECT repo_id, 2, CASE k WHEN 1 THEN 'missing.ts' ELSE 'unknown' END, CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END, '' FROM r""",
}
QUERIES = {
    "render_checklist_prompts": render_checklist_prompts,
    "render_inspection_prompts": render_inspection_prompts,
    "render_trace_prompts": render_trace_prompts,
    "call_model": call_model,
    "extract_first_json": extract_first_json,
    "parse_trace": parse_trace,
    "parse_checklist": parse_checklist,
    "parse_report": parse_report,
    "retry_rounds_checklists": _retry_query(rounds.CHECKLIST),
    "retry_rounds_inspection": _retry_query(rounds.INSPECTION),
    "transcripts": transcripts,
    "trace_rounds": trace_rounds,
    "flow_profiles": flow_profiles,
    "trace_transcripts": trace_transcripts,
}
