"""Checked answers: the first JSON object of each answer, its fields, or the reason it is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repovigil.functions.answers import blank, field, first_json, is_array, is_number, last_key_wins

# Refusal texts and answer schemas.
NO_JSON = "No JSON found in agent response"
BAD_JSON = "Failed to parse JSON: malformed text"
NO_STATUS = "Response missing 'status' field"
CONTROL = "struct<control_id string, name string, description string, category string, importance string, owasp_mapping array<string>>"
REFERENCE = "struct<title string, url string>"
LOCATION = "struct<file string, code_snippet string>"
IMPLEMENTED = f"struct<control_id string, control_name string, evidence string, location {LOCATION}>"
MISSING = "struct<control_id string, control_name string, reason string, severity string, recommendation string>"
AUTO_HANDLED = "struct<control_id string, control_name string, handled_by string, explanation string>"
VULNERABILITY = (
    f"struct<id string, title string, type string, severity string, description string, location {LOCATION}, "
    "recommendation string>"
)
PROFILE_FIELDS = {
    "flow_name": "string", "purpose": "string", "entry_point": "string", "input_types": "array<string>",
    "output_types": "array<string>", "sensitivity_level": "string", "mark_down": "string",
}


def _opened(answers: DataFrame, column: str) -> DataFrame:
    """Two steps, so that the text is cut once and parsed once."""
    last_key_wins(answers)
    return answers.withColumn("json", first_json(F.col(column))).withColumn("doc", F.try_parse_json("json"))


def _first_error(checks: list[tuple[Column, Column | str]]) -> Column:
    out = F.when(F.col("json").isNull(), NO_JSON).when(F.col("doc").isNull(), BAD_JSON)
    for failed, text in [(blank(F.col("doc"), "$.status"), NO_STATUS), *checks]:
        out = out.when(failed, text)
    return out


def _finish(df: DataFrame, error: Column, values: dict[str, Column]) -> DataFrame:
    """Values are null wherever the answer is refused."""
    checked = df.withColumn("error", error)
    ok = F.col("error").isNull()
    return checked.withColumns({name: F.when(ok, value) for name, value in values.items()}).drop("doc")


def parse_trace(answers: DataFrame, column: str = "text") -> DataFrame:
    """Four statuses; each needs its own fields."""
    df = _opened(answers, column)
    doc = F.col("doc")
    status = field(doc, "$.status", "string")
    pick, tracing, done = status == "pick_endpoint", status == "tracing_endpoint", status == "completed"
    error = _first_error(
        [
            (pick & blank(doc, "$.file_to_read_next"), "pick_endpoint response missing 'file_to_read_next'"),
            (tracing & blank(doc, "$.file_to_read_next"), "tracing_endpoint response missing 'file_to_read_next'"),
            (tracing & blank(doc, "$.endpoint_being_traced"), "tracing_endpoint response missing 'endpoint_being_traced'"),
            (done & blank(doc, "$.result"), "completed response missing 'result'"),
            (~(pick | tracing | done | (status == "not_found")), F.concat(F.lit("Unknown status: "), status)),
        ]
    )
    later = F.coalesce(field(doc, "$.files_to_read_later", "array<string>"), F.array().cast("array<string>"))
    return _finish(
        df,
        error,
        {
            "status": status,
            "file_to_read_next": F.when(pick | tracing, field(doc, "$.file_to_read_next", "string")),
            "endpoint_being_traced": F.when(tracing, field(doc, "$.endpoint_being_traced", "string")),
            "files_to_read_later": F.when(tracing, later),
            "profile": F.when(
                done, F.struct(*[field(doc, f"$.result.{n}", kind).alias(n) for n, kind in PROFILE_FIELDS.items()])
            ),
        },
    )


def _result_checks(doc: Column, status: Column, arrays: list[str], extra: list) -> list:
    done = status == "completed"
    checks = [
        (done & blank(doc, "$.result"), "completed response missing 'result'"),
        (done & blank(doc, "$.result.flow_name"), "result missing 'flow_name'"),
    ]
    checks += [(done & ~is_array(doc, f"$.result.{a}"), f"result missing '{a}' array") for a in arrays]
    return checks + extra + [(~done & (status != "error"), F.concat(F.lit("Unknown status: "), status))]


def parse_checklist(answers: DataFrame, column: str = "text") -> DataFrame:
    """Checklist arrays of a completed answer, ``message`` of an error answer."""
    df = _opened(answers, column)
    doc = F.col("doc")
    status = field(doc, "$.status", "string")
    done = status == "completed"
    kinds = {"required_controls": CONTROL, "recommended_controls": CONTROL, "references": REFERENCE}
    return _finish(
        df,
        _first_error(_result_checks(doc, status, list(kinds), [])),
        {
            "status": status,
            "message": F.when(status == "error", field(doc, "$.message", "string")),
            "answer_flow_name": F.when(done, field(doc, "$.result.flow_name", "string")),
            **{name: F.when(done, field(doc, f"$.result.{name}", f"array<{kind}>")) for name, kind in kinds.items()},
        },
    )


def parse_report(answers: DataFrame, column: str = "text") -> DataFrame:
    """Report arrays and summary; missing vulnerabilities count as none."""
    df = _opened(answers, column)
    doc = F.col("doc")
    status = field(doc, "$.status", "string")
    done = status == "completed"
    kinds = {"implemented": IMPLEMENTED, "missing": MISSING, "auto_handled": AUTO_HANDLED}
    listed = is_array(doc, "$.result.vulnerabilities")
    none = F.array().cast(f"array<{VULNERABILITY}>")
    size = F.when(
        listed, F.size(field(doc, "$.result.vulnerabilities", "array<variant>"))
    ).otherwise(0)

    def number(name: str) -> Column:
        return field(doc, f"$.result.summary.{name}", "bigint")

    return _finish(
        df,
        _first_error(
            _result_checks(
                doc, status, list(kinds), [(done & blank(doc, "$.result.summary"), "result missing 'summary'")]
            )
        ),
        {
            "status": status,
            "message": F.when(status == "error", field(doc, "$.message", "string")),
            "answer_flow_name": F.when(done, field(doc, "$.result.flow_name", "string")),
            **{name: F.when(done, field(doc, f"$.result.{name}", f"array<{kind}>")) for name, kind in kinds.items()},
            "vulnerabilities": F.when(
                done, F.when(listed, field(doc, "$.result.vulnerabilities", f"array<{VULNERABILITY}>")).otherwise(none)
            ),
            "summary": F.when(
                done,
                F.struct(
                    *[number(n).alias(n) for n in ("total_controls", "implemented_count", "missing_count", "auto_handled_count")],
                    F.when(is_number(doc, "$.result.summary.vulnerabilities_count"), number("vulnerabilities_count"))
                    .otherwise(size.cast("bigint"))
                    .alias("vulnerabilities_count"),
                    field(doc, "$.result.summary.overall_severity", "string").alias("overall_severity"),
                ),
            ),
        },
    )


def restore_flow_name(parsed: DataFrame) -> DataFrame:
    """The request's flow name stands, whatever the answer says."""
    return parsed.drop("answer_flow_name")
