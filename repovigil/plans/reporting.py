"""Registered queries: report assembly and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from repovigil.functions.severity import finding_level
from repovigil.operators import report
from repovigil.plans.corpus import from_sql, table, view, with_views

PROFILES = """
SELECT o_orderkey % 50 AS run_id, o_orderkey AS pos, 'flow-' || CAST(o_custkey % 2000 AS STRING) AS flow_name,
  'GET /' || CAST(o_orderkey AS STRING) AS entry_point FROM orders
"""
CHECKLISTS = """
SELECT p_partkey % 50 AS run_id, p_partkey AS pos, 'flow-' || CAST(p_partkey % 1500 AS STRING) AS flow_name,
  transform(sequence(1, p_size % 5 + 1), i -> 'R-' || CAST(i AS STRING)) AS required_controls,
  CASE WHEN p_size % 3 = 0 THEN CAST(array() AS array<string>)
       ELSE transform(sequence(1, p_size % 3), i -> 'O-' || CAST(i AS STRING)) END AS recommended_controls
FROM part
"""
# One report per order: the arrays hold that order's lines, so their size is bounded.
REPORTS = """
SELECT l_orderkey % 50 AS run_id, l_orderkey AS pos, 'flow-' || CAST(l_orderkey AS STRING) AS flow_name,
  CASE l_orderkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'High' ELSE 'low' END AS overall_severity,
  collect_list(l_partkey) FILTER (WHERE l_returnflag = 'A') AS implemented,
  array_sort(collect_list(named_struct('line', l_linenumber, 'control_id', 'C-' || CAST(l_partkey AS STRING),
      'supp', l_suppkey, 'price', l_extendedprice, 'control_name', 'N' || CAST(l_suppkey AS STRING),
      'severity', CASE CAST(l_quantity AS BIGINT) % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'High' WHEN 2 THEN 'medium' ELSE 'low' END))
    FILTER (WHERE l_returnflag = 'N')) AS missing,
  array_sort(collect_list(named_struct('line', l_linenumber, 'part', l_partkey, 'supp', l_suppkey, 'price', l_extendedprice,
      'type', CASE l_suppkey % 3 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'xss' ELSE 'hardcoded_secret' END,
      'severity', CASE CAST(l_quantity AS BIGINT) % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'high' ELSE 'critical' END,
      'title', 'T' || CAST(l_suppkey AS STRING), 'description', 'D' || CAST(l_partkey AS STRING),
      'location', named_struct('file', 'src/s' || CAST(l_suppkey AS STRING) || '.ts')))
    FILTER (WHERE l_linestatus = 'O')) AS vulnerabilities
FROM lineitem GROUP BY l_orderkey
"""
FILES = "SELECT doc_id % 50 AS run_id FROM documents"


def _outcomes(spark, sf):
    return report.outcomes(view(spark, sf, "control_results"), view(spark, sf, "vulnerabilities"))


def pair_checklists(spark, sf):
    paired = report.pair_checklists(from_sql(spark, sf, PROFILES), from_sql(spark, sf, CHECKLISTS))
    return paired.select(
        "run_id", "pos", "flow_name", "entry_point", F.col("checklist.pos").alias("checklist_pos"),
        F.array_join("checklist.required_controls", ",").alias("required"),
    )


def map_severity(spark, sf):
    rows = view(spark, sf, "control_results").select("run_id", "severity", finding_level(F.col("severity")).alias("level"))
    return rows.groupBy("run_id", "severity", "level").agg(F.count("*").alias("n"))


def findings(spark, sf):
    out = report.findings(from_sql(spark, sf, REPORTS))
    return out.withColumn("kind", F.col("kind").cast("bigint"))


def run_metrics(spark, sf):
    return report.run_metrics(*[from_sql(spark, sf, t) for t in (FILES, PROFILES, CHECKLISTS, REPORTS)])


def control_totals(spark, sf):
    return report.control_totals(from_sql(spark, sf, CHECKLISTS))


def severity_totals(spark, sf):
    return report.severity_totals(from_sql(spark, sf, REPORTS))


def stage_status(spark, sf):
    """Runs are customers; some have no orders or parts, some failed."""
    runs = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"))
    profiles = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"))
    lists = table(spark, sf, "part").select(F.col("p_partkey").alias("run_id"))
    errors = table(spark, sf, "customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias("run_id"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'discovery' WHEN 1 THEN 'checklists' ELSE 'inspection' END").alias("stage"),
        F.col("c_name").alias("message"),
    )
    known = runs.select("run_id")
    return report.stage_status(
        runs, profiles.join(known, "run_id", "left_semi"), lists.join(known, "run_id", "left_semi"), errors
    )


def overall_severity(spark, sf):
    return report.overall_severity(_outcomes(spark, sf), ["run_id", "flow_name"])


def report_summary(spark, sf):
    return report.report_summary(_outcomes(spark, sf), ["run_id", "flow_name"])


def security_score(spark, sf):
    return report.security_score(_outcomes(spark, sf), ["flow_name"])


def security_score_by_run(spark, sf):
    return report.security_score(_outcomes(spark, sf), ["run_id"])


def grade(spark, sf):
    return report.with_grade(report.security_score(_outcomes(spark, sf), ["flow_name"])).groupBy("grade").agg(
        F.count("*").alias("flows"), F.min("score").alias("lowest"), F.max("score").alias("highest")
    )


def findings_distribution(spark, sf):
    return report.findings_distribution(_outcomes(spark, sf), ["run_id"])


def run_summary_text(spark, sf):
    counts = (
        run_metrics(spark, sf)
        .select("run_id", "files_analyzed", "endpoints_found")
        .join(control_totals(spark, sf), "run_id")
        .join(severity_totals(spark, sf).drop("reports"), "run_id")
        .withColumn("framework", F.when(F.col("run_id") % 2 == 0, "express").otherwise("flask"))
    )
    return report.summary_texts(counts)


# ------------------------------------------------------------------------------------------ SQL

_OUT = with_views("control_results", "vulnerabilities") + """,
outcomes AS (SELECT run_id, flow_name, outcome AS kind, severity FROM control_results
             UNION ALL SELECT run_id, flow_name, 'vulnerability', severity FROM vulnerabilities),
ranked AS (SELECT *, CASE WHEN kind IN ('missing', 'vulnerability')
             THEN list_position(['low', 'medium', 'high', 'critical'], lower(severity)) END AS rk FROM outcomes)"""
_SEV = "coalesce(['low', 'medium', 'high', 'critical'][max(rk)], 'low') AS overall_severity"


def _score(by):
    return f"""{_OUT}, costs AS (SELECT {by}, kind, CASE
    WHEN kind = 'vulnerability' THEN CASE lower(severity) WHEN 'critical' THEN 15 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 2 END
    WHEN kind = 'missing' THEN CASE lower(severity) WHEN 'critical' THEN 8 WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 1 END
    ELSE 0 END AS cost FROM outcomes),
sums AS (SELECT {by}, sum(cost) AS deduction, count(*) FILTER (kind = 'implemented') AS impl,
           count(*) FILTER (kind <> 'vulnerability') AS ctl FROM costs GROUP BY {by}),
bonused AS (SELECT *, CASE WHEN ctl = 0 THEN 0 WHEN impl * 100 > 80 * ctl THEN 10 WHEN impl * 100 > 60 * ctl THEN 5
              WHEN impl * 100 > 40 * ctl THEN 2 ELSE 0 END AS bonus FROM sums),
scores AS (SELECT {by}, CAST(deduction AS BIGINT) AS deduction, CAST(bonus AS BIGINT) AS bonus,
             CAST(greatest(0, least(100, 100 - deduction + bonus)) AS BIGINT) AS score FROM bonused)"""


_CHECKLISTS = """checklists AS (SELECT p_partkey % 50 AS run_id, p_partkey AS pos, 'flow-' || CAST(p_partkey % 1500 AS STRING) AS flow_name,
  p_size % 5 + 1 AS n_req, p_size % 3 AS n_rec FROM part)"""
_LINES = """rep AS (SELECT l_orderkey % 50 AS run_id, count(DISTINCT l_orderkey) AS reports,
  count(*) FILTER (l_returnflag = 'A') AS implemented, count(*) FILTER (l_returnflag = 'N') AS missing,
  count(*) FILTER (l_linestatus = 'O') AS vulnerabilities,
  count(DISTINCT l_orderkey) FILTER (l_orderkey % 4 = 0) AS critical_reports,
  count(DISTINCT l_orderkey) FILTER (l_orderkey % 4 = 1) AS high_reports FROM lineitem GROUP BY 1)"""
_METRICS = f"""{_CHECKLISTS}, {_LINES}, ids AS (SELECT range AS run_id FROM range(50)),
metrics AS (SELECT run_id,
    (SELECT count(*) FROM documents WHERE doc_id % 50 = run_id) AS files_analyzed,
    (SELECT count(*) FROM orders WHERE o_orderkey % 50 = run_id) AS endpoints_found,
    (SELECT count(*) FROM part WHERE p_partkey % 50 = run_id) AS checklists, coalesce(reports, 0) AS reports,
    coalesce(missing, 0) AS issues_found, coalesce(vulnerabilities, 0) AS vulnerabilities_found FROM ids LEFT JOIN rep USING (run_id))"""
_TOTALS = """totals AS (SELECT run_id, count(*) AS checklists, CAST(sum(n_req) AS BIGINT) AS required,
  CAST(sum(n_rec) AS BIGINT) AS recommended FROM checklists GROUP BY run_id)"""

SQL = {
    "pair_checklists": f"""WITH {_CHECKLISTS}, first AS (SELECT run_id, flow_name, min(pos) AS checklist_pos, arg_min(n_req, pos) AS n_req FROM checklists GROUP BY ALL),
        profiles AS ({PROFILES}) SELECT run_id, pos, flow_name, entry_point, checklist_pos,
        list_aggregate(list_transform(range(1, n_req + 1), lambda i: 'R-' || i), 'string_agg', ',') AS required FROM profiles JOIN first USING (run_id, flow_name)""",
    "map_severity": f"""{with_views('control_results')} SELECT run_id, severity, CASE WHEN lower(severity) IN ('critical', 'high') THEN 'critical'
        WHEN lower(severity) = 'medium' THEN 'warning' ELSE 'info' END AS level, count(*) AS n FROM control_results GROUP BY ALL""",
    "findings": """SELECT l_orderkey % 50 AS run_id, l_orderkey AS report_pos, CAST(0 AS BIGINT) AS kind,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'C-' || l_partkey, l_suppkey, l_extendedprice, CAST(l_quantity AS BIGINT)) - 1 AS pos,
          'Missing Control' AS type, CASE WHEN CAST(l_quantity AS BIGINT) % 4 < 2 THEN 'critical' WHEN CAST(l_quantity AS BIGINT) % 4 = 2 THEN 'warning' ELSE 'info' END AS severity,
          'Missing C-' || l_partkey || ': N' || l_suppkey || ' in flow-' || l_orderkey AS message, CAST(NULL AS VARCHAR) AS file
        FROM lineitem WHERE l_returnflag = 'N'
        UNION ALL SELECT l_orderkey % 50, l_orderkey, 1,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1,
          ['sql_injection', 'xss', 'hardcoded_secret'][l_suppkey % 3 + 1], ['info', 'warning', 'critical', 'critical'][CAST(l_quantity AS BIGINT) % 4 + 1],
          'T' || l_suppkey || ': D' || l_partkey, 'src/s' || l_suppkey || '.ts'
        FROM lineitem WHERE l_linestatus = 'O'""",
    "run_metrics": f"WITH {_METRICS} SELECT * FROM metrics",
    "control_totals": f"WITH {_CHECKLISTS}, {_TOTALS} SELECT * FROM totals",
    "severity_totals": f"WITH {_LINES} SELECT * FROM rep",
    "stage_status": """WITH f AS (SELECT c_custkey AS run_id, c_name, CASE WHEN c_acctbal < 0 THEN c_custkey % 3 ELSE -1 END AS bad,
          (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS e,
          (SELECT count(*) FROM part WHERE p_partkey = c_custkey) AS c FROM customer),
        g AS (SELECT *, bad <> 0 AND e > 0 AS has_e FROM f)
        SELECT run_id, CASE bad WHEN 0 THEN 'failed' ELSE 'completed' END AS discovery,
          CASE WHEN NOT has_e THEN 'skipped' WHEN bad = 1 THEN 'failed' ELSE 'completed' END AS checklists,
          CASE WHEN NOT has_e OR bad = 1 OR c = 0 THEN 'skipped' WHEN bad = 2 THEN 'failed' ELSE 'completed' END AS inspection,
          CASE bad WHEN 0 THEN '⚠️ Discovery error: ' || c_name WHEN 1 THEN '⚠️ Checklists error: ' || c_name
            WHEN 2 THEN '⚠️ Inspection error: ' || c_name ELSE '' END AS warnings FROM g""",
    "overall_severity": f"{_OUT} SELECT run_id, flow_name, {_SEV} FROM ranked GROUP BY ALL",
    "report_summary": f"""{_OUT} SELECT run_id, flow_name, count(*) FILTER (kind <> 'vulnerability') AS total_controls,
        count(*) FILTER (kind = 'implemented') AS implemented_count, count(*) FILTER (kind = 'missing') AS missing_count,
        count(*) FILTER (kind = 'auto_handled') AS auto_handled_count, count(*) FILTER (kind = 'vulnerability') AS vulnerabilities_count,
        {_SEV} FROM ranked GROUP BY run_id, flow_name""",
    "security_score": f"{_score('flow_name')} SELECT * FROM scores",
    "security_score_by_run": f"{_score('run_id')} SELECT * FROM scores",
    "grade": f"""{_score('flow_name')} SELECT CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C'
        WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade, count(*) AS flows, min(score) AS lowest, max(score) AS highest FROM scores GROUP BY 1""",
    "findings_distribution": f"{_OUT} SELECT run_id, kind, count(*) AS n FROM outcomes GROUP BY ALL",
    "run_summary_text": f"""WITH {_METRICS}, {_TOTALS}, w AS (SELECT m.*, t.required, t.recommended, r.implemented, r.missing, r.vulnerabilities, r.critical_reports, r.high_reports,
          CASE WHEN m.run_id % 2 = 0 THEN 'express' ELSE 'flask' END AS framework FROM metrics m JOIN totals t USING (run_id) JOIN rep r USING (run_id))
        SELECT run_id, 'Analysis completed for ' || framework || ' project with ' || files_analyzed || ' files.' AS summary,
          '🚀 Starting analysis for ' || framework || ' project (' || files_analyzed || ' files)' AS started,
          '✓ Discovery: Discovered ' || endpoints_found || ' endpoints' AS discovered,
          '✓ Checklists: ' || checklists || ' checklists (' || required || ' required, ' || recommended || ' recommended controls)' AS listed,
          '✓ Inspection: ' || implemented || ' implemented, ' || missing || ' missing controls' AS inspected,
          CASE WHEN vulnerabilities > 0 THEN '🔴 Found ' || vulnerabilities || ' vulnerabilities' END AS found,
          CASE WHEN critical_reports > 0 THEN '🚨 ' || critical_reports || ' endpoint(s) with critical severity' END AS critical,
          CASE WHEN high_reports > 0 THEN '⚠️ ' || high_reports || ' endpoint(s) with high severity' END AS high FROM w""",
}
QUERIES = {
    name: globals()[name]
    for name in (
        "pair_checklists map_severity findings run_metrics control_totals severity_totals stage_status overall_severity "
        "report_summary security_score security_score_by_run grade findings_distribution run_summary_text"
    ).split()
}
