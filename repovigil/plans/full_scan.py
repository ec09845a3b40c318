"""Registered queries: the end-to-end scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from repovigil.plans.analysis_rules import _CHECK, _HANDLED, _TRACE, _endpoint_sql, _q, _shows
from repovigil.operators import rules
from repovigil.plans.corpus import APP_CORPUS, from_sql, view
from repovigil.plans.scan import scan


_QUIET = """SELECT 'quiet-' || source AS repo_id, doc_id AS ord, 'notes/n' || CAST(doc_id AS STRING) || '.ts' AS path,
  CAST(doc_id AS STRING) AS content FROM documents"""


def scan_scores(spark, sf):
    """Score, grade and counts of each repository of the application corpus."""
    out = scan(_quiet_corpus(spark, sf))
    repo = F.col("run_id").alias("repo_id")
    flows = out["flows"].groupBy("repo_id").agg(F.count("*").alias("flows"))
    findings = out["findings"].groupBy(repo).agg(F.count("*").alias("findings"))
    return (
        out["scores"].withColumnRenamed("run_id", "repo_id")
        .join(out["stats"], "repo_id")
        .join(flows, "repo_id", "left")
        .join(findings, "repo_id", "left")
        .fillna(0, ["flows", "findings"])
        .join(out["frameworks"].select("repo_id", "framework"), "repo_id")
    )


def _quiet_corpus(spark, sf):
    """The application corpus, and for every source a second repository of plain texts without any code."""
    return view(spark, sf, "app_corpus").unionByName(from_sql(spark, sf, _QUIET))


def scan_findings(spark, sf):
    """Findings by flow, type and level."""
    return scan(view(spark, sf, "app_corpus"))["findings"].groupBy("run_id", "flow_name", "type", "severity").agg(F.count("*").alias("n"))


_PROOF = " UNION ALL ".join(
    f"SELECT repo_id, ord, '{c[0]}' AS control_id FROM app_corpus WHERE {_shows('content', c)}" for c in rules.CONTROLS
)
_RISKS = " UNION ALL ".join(
    f"SELECT repo_id, ord, '{k}' AS type, '{s}' AS severity FROM numbered WHERE regexp_matches(line, {_q(p)})"
    for k, s, _, p, _, _ in rules.VULNERABILITY_RULES
)
_SCAN = f"""WITH RECURSIVE all_files AS ({APP_CORPUS}),
fw AS (SELECT repo_id, CASE WHEN bool_or(ends_with(path, '.java') AND regexp_matches(content, '@SpringBootApplication|@RestController|@Controller|import org[.]springframework'))
         THEN 'springboot' ELSE 'unknown' END AS framework FROM all_files GROUP BY repo_id),
app_corpus AS (SELECT a.* FROM all_files a JOIN fw USING (repo_id) WHERE NOT (framework = 'springboot' AND ends_with(path, '.py'))),
{_endpoint_sql()}, {_TRACE}, {_CHECK}, {_HANDLED}, proof AS ({_PROOF}),
shown AS (SELECT DISTINCT repo_id, entry, control_id FROM traces JOIN proof USING (repo_id, ord)),
results AS (SELECT l.repo_id, l.flow_name, CASE WHEN s.entry IS NOT NULL THEN 'implemented' WHEN handled_by IS NOT NULL THEN 'auto_handled' ELSE 'missing' END AS kind,
    importance AS severity FROM listed l LEFT JOIN shown s ON s.repo_id = l.repo_id AND s.entry = l.ord AND s.control_id = l.control_id
    LEFT JOIN fw ON fw.repo_id = l.repo_id LEFT JOIN handled h ON h.framework = fw.framework AND h.control_id = l.control_id),
numbered AS (SELECT repo_id, ord, unnest(string_split(content, chr(10))) AS line FROM app_corpus),
risks AS ({_RISKS}),
vulns AS (SELECT f.repo_id, f.flow_name, r.type, r.severity FROM risks r JOIN traces t USING (repo_id, ord) JOIN flows f ON f.repo_id = t.repo_id AND f.ord = t.entry),
found AS (SELECT repo_id, flow_name, 'Missing Control' AS type, severity FROM results WHERE kind = 'missing' UNION ALL SELECT * FROM vulns),
leveled AS (SELECT repo_id, flow_name, type, CASE WHEN severity IN ('critical', 'high') THEN 'critical' WHEN severity = 'medium' THEN 'warning' ELSE 'info' END AS severity FROM found)"""

SQL = {
    "scan_findings": f"{_SCAN} SELECT repo_id AS run_id, flow_name, type, severity, count(*) AS n FROM leveled GROUP BY ALL",
    "scan_scores": f"""{_SCAN.replace(f"all_files AS ({APP_CORPUS})", f"all_files AS ({APP_CORPUS} UNION ALL {_QUIET})")},
repos AS (SELECT DISTINCT repo_id FROM all_files),
cost AS (SELECT repo_id, sum(CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 2 END) AS d FROM vulns GROUP BY repo_id
  UNION ALL SELECT repo_id, sum(CASE severity WHEN 'critical' THEN 8 WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 1 END) FROM results WHERE kind = 'missing' GROUP BY repo_id),
share AS (SELECT repo_id, count(*) FILTER (kind = 'implemented') AS i, count(kind) AS c FROM repos LEFT JOIN results USING (repo_id) GROUP BY repo_id),
scored AS (SELECT repo_id, CAST(coalesce((SELECT sum(d) FROM cost WHERE cost.repo_id = share.repo_id), 0) AS BIGINT) AS deduction,
  CAST(CASE WHEN i * 100 > 80 * c THEN 10 WHEN i * 100 > 60 * c THEN 5 WHEN i * 100 > 40 * c THEN 2 ELSE 0 END AS BIGINT) AS bonus FROM share),
final AS (SELECT *, greatest(0, least(100, 100 - deduction + bonus)) AS score FROM scored)
SELECT repo_id, deduction, bonus, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade,
  (SELECT count(*) FROM all_files a WHERE a.repo_id = f.repo_id) AS total, (SELECT count(*) FROM app_corpus a WHERE a.repo_id = f.repo_id) AS included,
  (SELECT count(*) FROM all_files a WHERE a.repo_id = f.repo_id) - (SELECT count(*) FROM app_corpus a WHERE a.repo_id = f.repo_id) AS ignored,
  (SELECT count(*) FROM flows w WHERE w.repo_id = f.repo_id) AS flows, (SELECT count(*) FROM leveled l WHERE l.repo_id = f.repo_id) AS findings,
  (SELECT framework FROM fw WHERE fw.repo_id = f.repo_id) AS framework FROM final f""",
}
QUERIES = {"scan_scores": scan_scores, "scan_findings": scan_findings}
