"""Registered queries: rule-driven analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from repovigil.operators import analysis, detect, rules
from repovigil.plans.corpus import from_sql, view, with_views


def _app(spark, sf):
    return view(spark, sf, "app_corpus")


def _flows(spark, sf):
    return analysis.group_crud_flows(analysis.discover_endpoints(_app(spark, sf)))


def discover_endpoints(spark, sf):
    return analysis.discover_endpoints(_app(spark, sf))


def mounted_endpoints(spark, sf):
    return analysis.discover_endpoints(view(spark, sf, "mount_corpus"))


def import_edges(spark, sf):
    return analysis.import_edges(view(spark, sf, "mount_corpus"))


def group_crud_flows(spark, sf):
    return _flows(spark, sf).select(
        "repo_id", "ord", "path", "entity", "flow_name", "entry_point",
        F.array_join("methods", ",").alias("methods"), F.array_join("routes", ",").alias("routes"),
    )


def classify_sensitivity(spark, sf):
    return _flows(spark, sf).select("repo_id", "flow_name", "sensitivity_level")


def trace_imports(spark, sf):
    out = analysis.trace_imports(analysis.import_edges(_app(spark, sf)), _flows(spark, sf))
    return out.withColumn("depth", F.col("depth").cast("bigint"))


def build_checklists(spark, sf):
    return analysis.checklist_controls(analysis.build_checklists(_flows(spark, sf))).select(
        "repo_id", "flow_name", "control_id", "required", "category", "importance",
        F.array_join("owasp_mapping", ",").alias("owasp"),
    )


def _matched(spark, sf):
    app, flows = _app(spark, sf), _flows(spark, sf)
    controls = analysis.checklist_controls(analysis.build_checklists(flows))
    frameworks = detect.detect_frameworks(app)
    traces = analysis.trace_blocks(analysis.import_edges(app), flows)
    return analysis.match_controls(controls, traces, analysis.control_evidence(app), frameworks)


def match_controls(spark, sf):
    return _matched(spark, sf).select(
        "repo_id", "flow_name", "control_id", "outcome", "severity", "file", F.md5("snippet").alias("snippet_md5"), "handled_by"
    )


def _scan(name):
    def run(spark, sf):
        if name == "pages":
            files = from_sql(spark, sf, PAGE_FILES)
        elif name == "documents":
            files = from_sql(spark, sf, DOCUMENT_FILES)
        else:
            files = view(spark, sf, name)
        return analysis.scan_vulnerabilities(files).select(
            "repo_id", "ord", "path", "line_no", "type", "severity", F.md5("snippet").alias("snippet_md5")
        )

    return run


PAGE_FILES = "SELECT 'web' AS repo_id, page_id AS ord, url AS path, html AS content FROM pages"
DOCUMENT_FILES = "SELECT source AS repo_id, doc_id AS ord, lang AS path, text AS content FROM documents"

# ------------------------------------------------------------------------------------------ SQL


def _q(text):
    return "'" + text.replace("'", "''") + "'"


def _shows(column, control):
    return "(" + " OR ".join(f"contains({column}, {_q(sign)})" for sign in control[8]) + ")"


# Which routes each arm of the corpus defines, by hand: (arm of ord % 6, ord % 4 or all, rule, pos, method, route).
_ROUTES = """(0, NULL, 'script_router', 0, 'GET', '/users/:id'), (0, NULL, 'script_router', 1, 'POST', '/users'),
 (0, 0, 'script_router', 2, 'POST', '/auth/login'), (0, 0, 'script_route', 0, 'GET', '/bulk'), (0, 0, 'script_route', 1, 'POST', '/bulk'),
 (0, 2, 'script_router', 2, 'DELETE', '/orders/:oid'), (0, 2, 'script_route', 0, 'GET', '/tags'), (0, 2, 'script_route', 1, 'PUT', '/tags'),
 (1, NULL, 'decorator', 0, 'GET', 'health'),
 (3, NULL, 'mapping', 0, 'GET', '/payments/{id}'), (3, NULL, 'mapping', 1, 'POST', '/payments'),
 (3, NULL, 'mapping', 2, 'PUT', '/payments/{id}'), (3, NULL, 'mapping', 2, 'PUT', '/payments/bulk'),
 (5, NULL, 'python_route', 0, 'GET', '/uploads/<int:uid>'), (5, NULL, 'python_route', 0, 'PUT', '/uploads/<int:uid>'),
 (5, NULL, 'python_verb', 0, 'POST', '/uploads')"""


def _endpoint_sql():
    return f"""endpoints AS (SELECT repo_id, ord, path, rule, CAST(pos AS BIGINT) AS pos, method, route
   FROM app_corpus JOIN (VALUES {_ROUTES}) v(arm, quarter, rule, pos, method, route) ON ord % 6 = arm AND (quarter IS NULL OR ord % 4 = quarter)
   WHERE path NOT LIKE 'notes/%'),
keyed AS (SELECT *, '/' || array_to_string(list_filter(string_split(route, '/'), lambda s: s <> '' AND NOT regexp_matches(s, '^[:{{<[]')), '/') AS entity,
   method IN ('GET', 'POST', 'PUT', 'PATCH', 'DELETE') AS crud FROM endpoints),
named AS (SELECT *, path || '#' || entity || CASE WHEN crud THEN '' ELSE '#' || method || ' ' || route END AS flow_name FROM keyed),
flows AS (SELECT repo_id, ord, path, entity, flow_name, first(method || ' ' || route ORDER BY rule, pos, method, route) AS entry_point,
   string_agg(DISTINCT method, ',' ORDER BY method) AS methods, string_agg(DISTINCT route, ',' ORDER BY route) AS routes,
   CASE {" ".join(f"WHEN regexp_matches(lower(entity || ' ' || path), {_q(p)}) THEN '{n}'" for n, p in rules.SENSITIVITY_RULES)} ELSE 'medium' END AS sensitivity_level
   FROM named GROUP BY repo_id, ord, path, entity, flow_name)"""


_FLOWS = f"{with_views('app_corpus')}, {_endpoint_sql()}"

_TRACE = f"""
edges AS (SELECT a.repo_id, a.ord, b.ord AS target FROM app_corpus a JOIN app_corpus b
  ON b.repo_id = a.repo_id AND b.ord = a.ord + CASE WHEN a.ord % 6 = 4 THEN 60 WHEN a.ord % 6 <> 3 THEN 20 END
  WHERE a.path NOT LIKE 'notes/%'),
walk AS (SELECT DISTINCT repo_id, ord AS entry, ord, 0 AS depth FROM flows
  UNION SELECT w.repo_id, w.entry, e.target, w.depth + 1 FROM walk w JOIN edges e ON e.repo_id = w.repo_id AND e.ord = w.ord WHERE w.depth < 9),
traces AS (SELECT repo_id, entry, ord, min(depth) AS depth FROM walk GROUP BY ALL)"""

_CATALOG = "catalog(n, control_id, category, required, importance, owasp, applies) AS (VALUES " + ", ".join(
    f"({i}, '{c[0]}', '{c[3]}', {str(c[4]).lower()}, '{c[5]}', '{','.join(c[6])}', {_q(c[7])})"
    for i, c in enumerate(rules.CONTROLS)
) + ")"
_CHECK = f"""{_CATALOG},
picked AS (SELECT f.repo_id, f.ord, f.flow_name, f.sensitivity_level, c.*, row_number() OVER (PARTITION BY f.repo_id, f.flow_name ORDER BY c.n) AS r
  FROM flows f, catalog c WHERE (c.applies = '' OR regexp_matches(f.methods || ' ' || lower(replace(f.routes, ',', ' ')), c.applies))
  AND (c.required OR sensitivity_level IN ('critical', 'high') OR (sensitivity_level = 'medium' AND c.importance IN ('critical', 'high')))),
listed AS (SELECT * FROM picked WHERE r <= CASE sensitivity_level WHEN 'medium' THEN 7 WHEN 'low' THEN 4 ELSE 10 END)"""


def _scan_sql(source):
    arms = " UNION ALL ".join(
        f"SELECT repo_id, ord, path, i + 1 AS line_no, '{k}' AS type, '{s}' AS severity, md5(array_to_string(lines[greatest(i, 1):i + 2], chr(10))) AS snippet_md5 "
        f"FROM numbered WHERE regexp_matches(line, {_q(p)})"
        for k, s, _, p, _, _ in rules.VULNERABILITY_RULES
    )
    return f"""{source}, numbered AS (SELECT repo_id, ord, path, lines, unnest(lines) AS line, unnest(range(len(lines))) AS i
        FROM (SELECT repo_id, ord, path, string_split(content, chr(10)) AS lines FROM src)) {arms}"""


_HANDLED = "handled(framework, control_id, handled_by) AS (VALUES " + ", ".join(
    f"('{f}', '{c}', '{b}')" for f, c, b, _ in rules.HANDLED
) + ")"
# Full routes of the files of a service, by hand; {v} is its version.
_MOUNTED = """(0, 'script_router', 0, 'GET', '/version'), (1, 'script_router', 0, 'GET', '/api'),
 (2, 'script_router', 0, 'GET', '/api/v{v}/items/:id'), (2, 'script_router', 1, 'POST', '/api/v{v}/items'),
 (3, 'script_router', 0, 'ANY', '/health'), (4, 'script_router', 0, 'OPTIONS', '/o'), (5, 'script_route', 0, 'HEAD', '/p/q'),
 (6, 'python_path', 0, 'ANY', 'x/'), (7, 'python_verb', 0, 'GET', '/u/p/{id}'), (8, 'python_route', 0, 'POST', '/o/x'),
 (9, 'python_path', 0, 'ANY', '/d/y')"""
SQL = {
    "mounted_endpoints": f"""{with_views("mount_corpus")}
        SELECT repo_id, ord, path, rule, CAST(pos AS BIGINT) AS pos, method, replace(route, '{{v}}', CAST((ord // 10) % 3 AS VARCHAR)) AS route
        FROM mount_corpus JOIN (VALUES {_MOUNTED}) v(k, rule, pos, method, route) ON ord % 10 = k""",
    "import_edges": f"""{with_views("mount_corpus")}
        SELECT repo_id, ord, ord - ord % 10 + t AS target
        FROM mount_corpus JOIN (VALUES (0, 1), (0, 3), (0, 4), (1, 0), (1, 2), (4, 5), (6, 7), (6, 8)) v(k, t) ON ord % 10 = k""",
    "discover_endpoints": f"{_FLOWS} SELECT repo_id, ord, path, rule, pos, method, route FROM endpoints",
    "group_crud_flows": f"{_FLOWS} SELECT repo_id, ord, path, entity, flow_name, entry_point, methods, routes FROM flows",
    "classify_sensitivity": f"{_FLOWS} SELECT repo_id, flow_name, sensitivity_level FROM flows",
    "trace_imports": f"{_FLOWS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_TRACE} SELECT repo_id, entry, ord, CAST(depth AS BIGINT) AS depth FROM traces",
    "build_checklists": f"{_FLOWS}, {_CHECK} SELECT repo_id, flow_name, control_id, required, category, importance, owasp FROM listed",
    "match_controls": f"""{_FLOWS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_TRACE}, {_CHECK}, {_HANDLED},
        numbered AS (SELECT repo_id, ord, path, lines, unnest(lines) AS line, unnest(range(len(lines))) AS i
            FROM (SELECT *, string_split(content, chr(10)) AS lines FROM app_corpus)),
        proof AS ({" UNION ALL ".join(f"SELECT repo_id, ord, path, i, lines, '{c[0]}' AS control_id FROM numbered WHERE {_shows('line', c)}" for c in rules.CONTROLS)}),
        firsts AS (SELECT t.repo_id, t.entry, p.control_id, first(p.path ORDER BY t.depth, p.ord, p.i) AS file,
            first(md5(array_to_string(lines[greatest(i, 1):i + 2], chr(10))) ORDER BY t.depth, p.ord, p.i) AS snippet_md5
          FROM traces t JOIN proof p USING (repo_id, ord) GROUP BY ALL),
        fw AS (SELECT repo_id, CASE WHEN bool_or(ends_with(path, '.java') AND regexp_matches(content, '@SpringBootApplication|@RestController|@Controller|import org[.]springframework'))
            THEN 'springboot' ELSE 'unknown' END AS framework FROM app_corpus GROUP BY repo_id)
        SELECT l.repo_id, l.flow_name, l.control_id, CASE WHEN file IS NOT NULL THEN 'implemented' WHEN handled_by IS NOT NULL THEN 'auto_handled' ELSE 'missing' END AS outcome,
          CASE WHEN file IS NULL AND handled_by IS NULL THEN importance END AS severity, file, snippet_md5, CASE WHEN file IS NULL THEN handled_by END AS handled_by
        FROM listed l LEFT JOIN firsts p ON p.repo_id = l.repo_id AND p.entry = l.ord AND p.control_id = l.control_id
        LEFT JOIN fw ON fw.repo_id = l.repo_id LEFT JOIN handled h ON h.framework = fw.framework AND h.control_id = l.control_id""",
    "scan_vulnerabilities": _scan_sql(with_views("app_corpus") + ", src AS (SELECT * FROM app_corpus)"),
    "scan_vulnerabilities_corpus": _scan_sql(with_views("files_corpus") + ", src AS (SELECT * FROM files_corpus)"),
    "scan_vulnerabilities_documents": _scan_sql(f"WITH src AS ({DOCUMENT_FILES})"),
    "scan_vulnerabilities_pages": _scan_sql(f"WITH src AS ({PAGE_FILES})"),
}
QUERIES = {
    "mounted_endpoints": mounted_endpoints,
    "import_edges": import_edges,
    "discover_endpoints": discover_endpoints,
    "group_crud_flows": group_crud_flows,
    "classify_sensitivity": classify_sensitivity,
    "trace_imports": trace_imports,
    "build_checklists": build_checklists,
    "match_controls": match_controls,
    "scan_vulnerabilities": _scan("app_corpus"),
    "scan_vulnerabilities_corpus": _scan("files_corpus"),
    "scan_vulnerabilities_documents": _scan("documents"),
    "scan_vulnerabilities_pages": _scan("pages"),
}
