"""Prompt tables: one rendered request per row. All templates are plain concatenations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repovigil.functions.skew import salted_lookup
from repovigil.operators.turns import TREE

# ---------------------------------------------------------------------------------------------
# The request formats. ``{name}`` stands for a value.
# ---------------------------------------------------------------------------------------------
CHECKLIST_PROMPT = """## Security Analysis Request

### Framework Context:
- **Framework**: {framework}
- **Confidence**: {confidence}
- **Indicators**: {indicators}

### Project Structure:
```
{tree}
```

### Flow to Analyze:
- **Flow Name**: {flow_name}
- **Purpose**: {purpose}
- **Entry Point**: {entry_point}
- **Sensitivity Level**: {sensitivity_level}
- **Input Types**: {input_types}
- **Output Types**: {output_types}

---

Based on the flow profile above, generate a comprehensive security checklist. Consider:

1. The sensitivity level ({sensitivity_level}) - adjust required vs recommended controls accordingly
2. The framework ({framework}) - include framework-specific security recommendations
3. Input/output types - identify potential injection points and data protection needs
4. The endpoint purpose - tailor controls to the specific functionality

Respond with the security checklist in the required JSON format."""

INSPECTION_PROMPT = """## Security Inspection Request

### Endpoint Overview:
- **Flow Name**: {flow_name}
- **Purpose**: {purpose}
- **Entry Point**: {entry_point}
- **Sensitivity Level**: {sensitivity_level}
- **Input Types**: {input_types}
- **Output Types**: {output_types}

### Code Documentation:
{mark_down}

---

### Security Checklist to Verify:

#### Required Controls:
{required}

#### Recommended Controls:
{recommended}

---

Inspect the code documentation above and match it against the security checklist.
For each control, determine if it's implemented, missing, or auto-handled by the framework.

Be practical - moderate security is the goal. Mark partial implementations as implemented with notes.
For implemented controls, cite specific file paths and line numbers (max 3 lines) from the documentation.

Respond with the security report in the required JSON format."""

TRACE_PROMPT = """## Project Analysis Request

### Project Structure:
```
{tree}
```

### ⚠️ Already Processed Endpoints (DO NOT analyze these again):
{processed}

---

Please analyze this project structure and identify an API endpoint file to trace that hasn't been processed yet. Look for:
- Route handlers (e.g., route.ts, routes/, api/, controllers/)
- API definitions
- HTTP endpoint definitions

Respond with the file you want to read first to start tracing an endpoint."""
# ---------------------------------------------------------------------------------------------


def render(template: str, **values: Column) -> Column:
    """Fill a template with columns; null values make the whole prompt null."""
    pieces = []
    for i, part in enumerate(template.split("{")):
        if i:
            name, part = part.split("}", 1)
            pieces.append(values[name])
        pieces.append(F.lit(part))
    return F.concat(*pieces)


def _list(values: Column, empty: str) -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise(F.lit(empty))


def _controls(controls: Column, kind: str) -> Column:
    lines = F.transform(
        controls,
        lambda c: F.concat(
            F.lit("- ["), c["control_id"], F.lit("] "), c["name"], F.lit(" ("), c["importance"], F.lit("): "), c["description"]
        ),
    )
    return F.when(F.size(controls) > 0, F.array_join(lines, "\n")).otherwise(F.lit(f"No {kind} controls."))


def _flow_values() -> dict[str, Column]:
    return {c: F.col(c) for c in ("flow_name", "purpose", "entry_point", "sensitivity_level")}


def render_checklist_prompts(flows: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Flows (``repo_id``, profile fields) with ``prompt``.

    The prompt holds ``turns.TREE`` where its repository's tree belongs; ``turns.with_trees`` and ``model.live``
    put the tree there in the task that calls the model.
    """
    facts = frameworks.select("repo_id", "framework", "confidence", "indicators")
    prompt = render(
        CHECKLIST_PROMPT,
        **_flow_values(),
        framework=F.col("framework"),
        confidence=F.col("confidence"),
        indicators=F.array_join("indicators", ", "),
        tree=F.lit(TREE),
        input_types=_list(F.col("input_types"), "None specified"),
        output_types=_list(F.col("output_types"), "None specified"),
    )
    joined = salted_lookup(flows, facts, "repo_id", ["flow_name"])
    return joined.select(*flows.columns, prompt.alias("prompt"))


def render_inspection_prompts(inputs: DataFrame) -> DataFrame:
    """Profiles joined with their checklist arrays, with ``prompt``."""
    def types(column: str) -> Column:
        text = F.array_join(column, ", ")  # a list of blanks prints like an empty list
        return F.when(text == "", "None").otherwise(text)

    prompt = render(
        INSPECTION_PROMPT,
        **_flow_values(),
        mark_down=F.col("mark_down"),
        input_types=types("input_types"),
        output_types=types("output_types"),
        required=_controls(F.col("required_controls"), "required"),
        recommended=_controls(F.col("recommended_controls"), "recommended"),
    )
    return inputs.withColumn("prompt", prompt)


def trace_prompt(tree: Column, processed: Column) -> Column:
    lines = F.array_join(F.transform(processed, lambda e: F.concat(F.lit("- "), e)), "\n")
    return render(
        TRACE_PROMPT, tree=tree, processed=F.when(F.size(processed) > 0, lines).otherwise(F.lit("(none yet)"))
    )


def render_trace_prompts(trees: DataFrame, processed: DataFrame) -> DataFrame:
    """``prompt`` of each repository of ``trees``, with ``turns.TREE`` for its tree; ``processed(repo_id, endpoints array)``."""
    done = F.coalesce("endpoints", F.array().cast("array<string>"))
    repos = trees.select("repo_id").distinct()
    return repos.join(processed, "repo_id", "left").select("repo_id", trace_prompt(F.lit(TREE), done).alias("prompt"))
