"""Expressions over model answers: the first JSON object in a text, and checks on its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An escaped character, a structural character, a run of plain text, or a lone final backslash.
_TOKENS = r'(?s)(\\.|["{}]|[^\\"{}]+|\\)'


def first_json(text: Column) -> Column:
    """The first balanced ``{...}`` of ``text``, or null.

    Braces inside strings do not count. A backslash hides the next character, also outside
    strings. If the first brace never closes there is no answer: later ones are not tried.

    The text is cut into tokens first, so the fold runs once per structural character and not
    once per character.
    """
    start = F.instr(text, "{")
    tail = F.substr(text, F.greatest(start, F.lit(1)))
    tokens = F.regexp_extract_all(tail, F.lit(_TOKENS), F.lit(1))

    def step(state: Column, token: Column) -> Column:
        done = state["done"]
        quoted = state["quoted"] != (token == '"')
        depth = state["depth"] + (
            F.when(quoted, 0).when(token == "{", 1).when(token == "}", -1).otherwise(0)
        )
        closes = ~quoted & (token == "}") & (depth == 0)
        return F.struct(
            F.when(done, state["quoted"]).otherwise(quoted).alias("quoted"),
            F.when(done, state["depth"]).otherwise(depth).alias("depth"),
            F.when(done, state["width"]).otherwise(state["width"] + F.length(token)).alias("width"),
            (done | closes).alias("done"),
        )

    zero = F.struct(
        F.lit(False).alias("quoted"), F.lit(0).alias("depth"), F.lit(0).alias("width"), F.lit(False).alias("done")
    )
    width = F.aggregate(tokens, zero, step, lambda s: F.when(s["done"], s["width"]))
    return F.when(start > 0, F.substr(tail, F.lit(1), width))


def last_key_wins(df: DataFrame) -> None:
    """Let the session's JSON parser take the last of repeated keys, as model answers and manifests expect.

    The parser has a session option for it and refuses such objects by default.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def field(doc: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(doc, path, kind)


def kind_of(doc: Column, path: str) -> Column:
    """Type name of a field: VOID for JSON null, null if absent."""
    return F.schema_of_variant(field(doc, path))


def blank_value(value: Column) -> Column:
    """Absent, null, false, zero or the empty string."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        kind.isNull()
        | (kind == "VOID")
        | (kind.isin("STRING", "BOOLEAN") & text.isin("", "false") & ((kind == "BOOLEAN") == (text == "false")))
        | (~kind.isin("STRING", "BOOLEAN") & F.coalesce(F.try_variant_get(value, "$", "double") == 0, F.lit(False)))
    )


def blank(doc: Column, path: str) -> Column:
    return blank_value(field(doc, path))


def is_array(doc: Column, path: str) -> Column:
    return F.coalesce(kind_of(doc, path).startswith("ARRAY"), F.lit(False))


def is_number(doc: Column, path: str) -> Column:
    kind = kind_of(doc, path)
    return F.coalesce(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False))
