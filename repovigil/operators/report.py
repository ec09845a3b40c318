"""Report assembly: pairing, findings, severities, scores, and per-run roll-ups.

Outcomes are rows: ``control_results(run_id, flow_name, pos, control_id, outcome, severity)`` and
``vulnerabilities(run_id, flow_name, pos, type, severity)``. Every roll-up is one union of narrow
rows and one hash aggregate that combines map-side, so a run with most of the rows is cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repovigil.functions.severity import finding_level, rank_severity, severity_rank

# Score weights, bonus steps, grade limits.
VULNERABILITY_COST = {"critical": 15, "high": 10, "medium": 5, "low": 2}
MISSING_COST = {"critical": 8, "high": 5, "medium": 3, "low": 1}
BONUS = [(80, 10), (60, 5), (40, 2)]
GRADES = [("A", 90), ("B", 80), ("C", 70), ("D", 60)]

# Names of the stages in status and log texts.
STAGE_LABELS = {"discovery": "Discovery", "checklists": "Checklists", "inspection": "Inspection"}


def pair_checklists(profiles: DataFrame, checklists: DataFrame) -> DataFrame:
    """Each endpoint with the first checklist of its flow name; endpoints without one are dropped."""
    first = checklists.groupBy("run_id", "flow_name").agg(
        F.min_by(F.struct(*[c for c in checklists.columns if c not in ("run_id", "flow_name")]), "pos").alias("checklist")
    )
    return profiles.join(first, ["run_id", "flow_name"])


def findings(reports: DataFrame) -> DataFrame:
    """One row per finding: a report's missing controls, then its vulnerabilities.

    ``(run_id, report_pos, kind, pos)`` is the order of the reference list. Both arrays are
    turned into rows in one pass over the reports.
    """
    missing = F.transform(
        "missing",
        lambda m, i: F.struct(
            F.lit(0).alias("kind"),
            i.cast("bigint").alias("pos"),
            F.lit("Missing Control").alias("type"),
            finding_level(m["severity"]).alias("severity"),
            F.concat(F.lit("Missing "), m["control_id"], F.lit(": "), m["control_name"], F.lit(" in "), F.col("flow_name")).alias("message"),
            F.lit(None).cast("string").alias("file"),
        ),
    )
    found = F.transform(
        "vulnerabilities",
        lambda v, i: F.struct(
            F.lit(1).alias("kind"),
            i.cast("bigint").alias("pos"),
            v["type"].alias("type"),
            finding_level(v["severity"]).alias("severity"),
            F.concat(v["title"], F.lit(": "), v["description"]).alias("message"),
            v["location"]["file"].alias("file"),
        ),
    )
    return reports.select("run_id", F.col("pos").alias("report_pos"), F.inline(F.concat(missing, found)))


def outcomes(control_results: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """Both outcome tables as ``(run_id, flow_name, kind, severity)``."""
    return control_results.select("run_id", "flow_name", F.col("outcome").alias("kind"), "severity").unionAll(
        vulnerabilities.select("run_id", "flow_name", F.lit("vulnerability").alias("kind"), "severity")
    )


def _count(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind)


def overall_severity(rows: DataFrame, by: list[str]) -> DataFrame:
    """Worst severity among vulnerabilities and missing controls; low if there are none."""
    rank = F.when(F.col("kind").isin("missing", "vulnerability"), severity_rank(F.col("severity")))
    return rows.groupBy(*by).agg(rank_severity(F.max(rank)).alias("overall_severity"))


def report_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Control and vulnerability counts with the overall severity."""
    rank = F.when(F.col("kind").isin("missing", "vulnerability"), severity_rank(F.col("severity")))
    return rows.groupBy(*by).agg(
        F.count_if(F.col("kind") != "vulnerability").alias("total_controls"),
        _count("implemented").alias("implemented_count"),
        _count("missing").alias("missing_count"),
        _count("auto_handled").alias("auto_handled_count"),
        _count("vulnerability").alias("vulnerabilities_count"),
        rank_severity(F.max(rank)).alias("overall_severity"),
    )


def _cost(kind: str, table: dict[str, int]) -> Column:
    level = F.lower("severity")
    points = F.lit(0)
    for name, cost in table.items():
        points = F.when((F.col("kind") == kind) & (level == name), cost).otherwise(points)
    return points


def security_score(rows: DataFrame, by: list[str], runs: DataFrame | None = None) -> DataFrame:
    """0-100: start at 100, subtract per finding, add a bonus for implemented controls, clamp.

    The share of implemented controls counts implemented, missing and auto-handled controls; it
    is 0 without controls. The bonus limits are strict. ``runs`` names all keys; one without rows has
    nothing to subtract or add.
    """
    summed = rows.groupBy(*by).agg(
        F.sum(_cost("vulnerability", VULNERABILITY_COST) + _cost("missing", MISSING_COST)).alias("deduction"),
        _count("implemented").alias("implemented"),
        F.count_if(F.col("kind") != "vulnerability").alias("controls"),
    )
    if runs is not None:
        summed = runs.select(*by).distinct().join(summed, by, "left").fillna(0, ["deduction", "implemented", "controls"])
    # share > p %  <=>  100 * implemented > p * controls, in whole numbers
    bonus = F.lit(0)
    for percent, points in reversed(BONUS):
        bonus = F.when(F.col("implemented") * 100 > F.col("controls") * percent, points).otherwise(bonus)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - F.col("deduction") + bonus))
    return summed.select(
        *by, F.col("deduction").cast("bigint").alias("deduction"), bonus.cast("bigint").alias("bonus"), score.cast("bigint").alias("score")
    )


def with_grade(scores: DataFrame) -> DataFrame:
    grade = F.lit("F")
    for name, limit in reversed(GRADES):
        grade = F.when(F.col("score") >= limit, name).otherwise(grade)
    return scores.withColumn("grade", grade)


def findings_distribution(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "kind").agg(F.count("*").alias("n"))


def run_metrics(files: DataFrame, profiles: DataFrame, checklists: DataFrame, reports: DataFrame) -> DataFrame:
    """Counts per run; sources are summed as one union, so a run may lack any of them."""
    names = ["files_analyzed", "endpoints_found", "checklists", "reports", "issues_found", "vulnerabilities_found"]

    def counted(df: DataFrame, **values: Column) -> DataFrame:
        return df.select("run_id", *[values.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])

    one = F.lit(1)
    rows = (
        counted(files, files_analyzed=one)
        .unionAll(counted(profiles, endpoints_found=one))
        .unionAll(counted(checklists, checklists=one))
        .unionAll(
            counted(reports, reports=one, issues_found=F.size("missing"), vulnerabilities_found=F.size("vulnerabilities"))
        )
    )
    return rows.groupBy("run_id").agg(*[F.sum(n).alias(n) for n in names])


def control_totals(checklists: DataFrame) -> DataFrame:
    return checklists.groupBy("run_id").agg(
        F.count("*").alias("checklists"),
        F.sum(F.size("required_controls")).alias("required"),
        F.sum(F.size("recommended_controls")).alias("recommended"),
    )


def severity_totals(reports: DataFrame) -> DataFrame:
    """Outcome totals, and how many reports are critical or high (in exactly this spelling)."""
    return reports.groupBy("run_id").agg(
        F.count("*").alias("reports"),
        F.sum(F.size("implemented")).alias("implemented"),
        F.sum(F.size("missing")).alias("missing"),
        F.sum(F.size("vulnerabilities")).alias("vulnerabilities"),
        F.count_if(F.col("overall_severity") == "critical").alias("critical_reports"),
        F.count_if(F.col("overall_severity") == "high").alias("high_reports"),
    )


def stage_status(runs: DataFrame, profiles: DataFrame, checklists: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """State of the three stages per run; ``errors(run_id, stage, message)`` names failed stages.

    A failed stage counts as having produced nothing, and the run goes on: later stages that need
    its rows are skipped.
    """
    rows = runs.select("run_id", F.lit(0).alias("e"), F.lit(0).alias("c"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("message"))
    none = F.lit(None).cast("string")
    rows = rows.unionAll(profiles.select("run_id", F.lit(1), F.lit(0), none, none))
    rows = rows.unionAll(checklists.select("run_id", F.lit(0), F.lit(1), none, none))
    if errors is not None:
        rows = rows.unionAll(errors.select("run_id", F.lit(0), F.lit(0), "stage", "message"))

    def failed(stage: str) -> Column:
        return F.min(F.when(F.col("stage") == stage, F.col("message"))).alias(stage + "_error")

    merged = rows.groupBy("run_id").agg(
        F.sum("e").alias("endpoints"), F.sum("c").alias("checklists"), *[failed(s) for s in STAGE_LABELS]
    )
    broke = {s: F.col(s + "_error").isNotNull() for s in STAGE_LABELS}
    endpoints = F.when(broke["discovery"], 0).otherwise(F.col("endpoints"))
    made = F.when((endpoints == 0) | broke["checklists"], 0).otherwise(F.col("checklists"))

    def state(stage: str, needed: Column) -> Column:
        return F.when(~needed, "skipped").when(broke[stage], "failed").otherwise("completed")

    return merged.select(
        "run_id",
        state("discovery", F.lit(True)).alias("discovery"),
        state("checklists", endpoints > 0).alias("checklists"),
        state("inspection", (endpoints > 0) & (made > 0)).alias("inspection"),
        F.array_join(
            F.array_compact(
                F.array(
                    *[
                        F.when(broke[s], F.concat(F.lit(f"⚠️ {label} error: "), F.col(s + "_error")))
                        for s, label in STAGE_LABELS.items()
                    ]
                )
            ),
            "\n",
        ).alias("warnings"),
    )


def summary_texts(runs: DataFrame) -> DataFrame:
    """Summary and stage log lines of each run from its counts."""
    label = STAGE_LABELS
    return runs.select(
        "run_id",
        F.format_string("Analysis completed for %s project with %d files.", "framework", "files_analyzed").alias("summary"),
        F.format_string("🚀 Starting analysis for %s project (%d files)", "framework", "files_analyzed").alias("started"),
        F.format_string(f"✓ {label['discovery']}: Discovered %d endpoints", "endpoints_found").alias("discovered"),
        F.format_string(
            f"✓ {label['checklists']}: %d checklists (%d required, %d recommended controls)", "checklists", "required", "recommended"
        ).alias("listed"),
        F.format_string(f"✓ {label['inspection']}: %d implemented, %d missing controls", "implemented", "missing").alias("inspected"),
        F.when(F.col("vulnerabilities") > 0, F.format_string("🔴 Found %d vulnerabilities", "vulnerabilities")).alias("found"),
        F.when(
            F.col("critical_reports") > 0, F.format_string("🚨 %d endpoint(s) with critical severity", "critical_reports")
        ).alias("critical"),
        F.when(F.col("high_reports") > 0, F.format_string("⚠️ %d endpoint(s) with high severity", "high_reports")).alias("high"),
    )
