"""The whole analysis without a model: files in, result tables out.

File text is read once. That scan turns each file into a narrow row of hits (framework signals,
routes, imports, control evidence, risky lines); the framework filter, the joins and the roll-ups
all work on those rows, so text never enters a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repovigil.functions.severity import finding_level
from repovigil.functions.skew import salted_lookup
from repovigil.operators import analysis, clean, detect, report
from repovigil.operators.needles import needle_bits
from repovigil.session import materialize, written


def file_facts(files: DataFrame) -> DataFrame:
    """One narrow row per file; files that every framework drops only give framework signals."""
    path = F.col("path")
    wanted = clean.kept_by_some(path)
    code = F.when(wanted, analysis.code(path, F.col("content"))).alias("code")
    bits = needle_bits(F.when(wanted, F.col("content"))).alias("bits")
    return files.select("repo_id", "ord", "path", "content", code, bits).select(
        "repo_id",
        "ord",
        "path",
        F.when(detect.may_signal(), detect.signal_hits()).alias("signal_hits"),
        analysis.route_hits(F.col("code")).alias("route_hits"),
        analysis.mount_hits(F.col("code")).alias("mount_hits"),
        analysis.imported_modules(F.col("code")).alias("imported_modules"),
        analysis.evidence_hits(F.col("bits")).alias("evidence_hits"),
        analysis.vulnerability_hits(F.col("bits")).alias("vulnerability_hits"),
    )


def scan(files: DataFrame, forced: DataFrame | None = None) -> dict[str, DataFrame]:
    """Result tables of a scan; the run of a repository is its ``repo_id``."""
    facts = written(file_facts(files), "facts")
    signals = facts.select("repo_id", "ord", "path", F.inline("signal_hits"))
    found = detect.frameworks_of(signals, facts.select("repo_id").distinct())
    frameworks = materialize(clean.resolve_framework(found, forced, keep_unknown=True))
    by_repo = frameworks.select("repo_id", "framework")
    judged = salted_lookup(facts.drop("signal_hits"), by_repo, "repo_id", ["ord", "path"]).withColumn(
        "kept", clean.kept(F.col("path"), F.col("framework"))
    )
    kept = judged.filter("kept")

    flows = materialize(analysis.group_crud_flows(analysis.mount_endpoints(analysis.endpoints_of(kept), analysis.mounts_of(kept))))
    checklists = analysis.build_checklists(flows)
    traces = analysis.trace_blocks(analysis.edges_of(kept), flows)
    evidence = kept.select("repo_id", "ord", "path", F.inline("evidence_hits"))
    controls = materialize(
        analysis.match_controls(analysis.checklist_controls(checklists), traces, evidence, frameworks)
    )
    risky = kept.select("repo_id", "ord", "path", F.inline("vulnerability_hits"))
    reached = traces.rows().join(flows.select("repo_id", F.col("ord").alias("entry"), "flow_name"), ["repo_id", "entry"])
    vulnerabilities = materialize(risky.join(reached.select("repo_id", "ord", "flow_name"), ["repo_id", "ord"]))

    outcomes = report.outcomes(
        controls.withColumnRenamed("repo_id", "run_id"), vulnerabilities.withColumnRenamed("repo_id", "run_id")
    )
    missing = controls.filter("outcome = 'missing'").select(
        F.col("repo_id").alias("run_id"), "flow_name", F.lit("Missing Control").alias("type"),
        finding_level(F.col("severity")).alias("severity"),
        F.concat(F.lit("Missing "), "control_id", F.lit(": "), "control_name", F.lit(" in "), "flow_name").alias("message"),
        F.lit(None).cast("string").alias("file"),
    )
    risks = vulnerabilities.select(
        F.col("repo_id").alias("run_id"), "flow_name", "type", finding_level(F.col("severity")).alias("severity"),
        F.concat("title", F.lit(": "), "recommendation").alias("message"), F.col("path").alias("file"),
    )
    stats = judged.groupBy("repo_id").agg(F.count("*").alias("total"), F.count_if("kept").alias("included"))
    # files that every framework drops give a repository too
    stats = frameworks.select("repo_id").join(stats, "repo_id", "left").fillna(0, ["total", "included"])
    return {
        "frameworks": frameworks,
        "stats": stats.withColumn("ignored", F.col("total") - F.col("included")),
        "flows": flows,
        "checklists": checklists,
        "controls": controls,
        "vulnerabilities": vulnerabilities,
        "findings": missing.unionAll(risks),
        "summaries": report.report_summary(outcomes, ["run_id", "flow_name"]),
        "scores": report.with_grade(
            report.security_score(outcomes, ["run_id"], frameworks.select(F.col("repo_id").alias("run_id")))
        ),
    }
