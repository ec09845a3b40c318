"""Reading source code as code: comments and quoted code dropped, brackets balanced by a fold over tokens.

``code_of`` is one pass of a pattern whose alternatives are the things that must not be cut apart (strings,
regular expressions, comments): plain strings stay, comments go, and strings that hold other quotes or line
breaks, so might quote code themselves, go as well. What is left can be searched by patterns that allow
line breaks between tokens. Where brackets matter, ``calls_of_route`` folds a file's tokens with a small state.

All patterns are possessive where they repeat, so no text is read twice and none is too deep for the stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repovigil.functions.text import ends_with_any

SCRIPT = [".js", ".ts", ".mjs", ".cjs", ".jsx", ".tsx"]
JVM = [".java", ".kt"]
PYTHON = [".py"]

_PLAIN = r'''"(?:[^"'`\\\n]|\\[^"'`\n])*+"|'(?:[^"'`\\\n]|\\[^"'`\n])*+\''''
_QUOTING = r'''"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+\''''
_TEMPLATE = r"`(?:[^`'\"\\\n]|\\.)*+`"
_LONG_TEMPLATE = r"`(?:[^`\\]|\\[\s\S])*+`"
_REGEX = r"[(,=:\[!&|?{};]\s*+/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/"
_SLASHES = r"//[^\n]*+|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
_THREE = r'"""[\s\S]*?"""' + r"|'''[\s\S]*?'''"
#: Per language; what stays is the first group. Looking at one character first passes over plain code quickly.
_LEXERS = [
    (SCRIPT, rf"(?=[\"'`/(,=:\[!&|?{{}};])(?:({_PLAIN}|{_TEMPLATE}|{_REGEX})|{_QUOTING}|{_LONG_TEMPLATE}|{_SLASHES})"),
    (JVM, rf"(?=[\"'/])(?:{_THREE}|({_PLAIN})|{_QUOTING}|{_SLASHES})"),
    (PYTHON, rf"(?=[\"'#])(?:{_THREE}|({_PLAIN})|{_QUOTING}|#[^\n]*+)"),
]


def code_of(path: Column, text: Column) -> Column:
    """The text without comments and without strings that may quote code; other files as they are."""
    out = text
    for extensions, pattern in reversed(_LEXERS):
        out = F.when(ends_with_any(path, extensions), F.regexp_replace(text, pattern, "$1")).otherwise(out)
    return out


_VERBS = "get|post|put|patch|delete|options|head|all"
#: A call of ``.route(``, a verb called on the call before it, strings, keys, brackets and ends of statements.
_TOKEN = (
    r"(?=[.)\"'`(){}\[\];]|(?<![\w$])[A-Za-z_$])(?:\.\s*+route\s*+\(" + rf"|\)\s*+\.\s*+(?:{_VERBS})\s*+\("
    + rf"|{_PLAIN}|{_TEMPLATE}" + r"|[A-Za-z_$][\w$]*+\s*+:|[(){}\[\];])"
)
_STATE = (
    "struct<depth:int,base:int,mode:int,key:string,path:string,methods:array<string>,"
    "found:array<struct<method:string,route:string>>>"
)
#: What the fold is in: nothing, the arguments of a ``.route(`` call, the calls chained to it.
_NOTHING, _ARGUMENTS, _CHAIN = range(3)


def calls_of_route(code: Column) -> Column:
    """``(method, route)`` of ``.route({...})`` objects, keys in any order, and ``.route(path).get(...)`` chains.

    Only keys of the object itself count, not those of objects inside it; a chain goes on over arguments of
    any depth until something else is said.
    """

    def step(s: Column, token: Column) -> Column:
        first = F.substring(token, 1, 1)
        route = first == "."
        chained = (first == ")") & (F.length(token) > 1)
        quoted = first.isin('"', "'", "`")
        key = token.endswith(":") & ~quoted
        opens, closes = token.isin("(", "{", "["), (first == ")") | token.isin("}", "]")
        depth, mode, base = s["depth"], s["mode"], s["base"]
        said = F.substring(token, 2, F.length(token) - 2)

        lower = F.when(closes, depth - 1).otherwise(depth)
        left = closes & (mode == _ARGUMENTS) & (lower == base)  # the call of .route( ends here
        chain = left & s["path"].isNotNull() & (F.size(s["methods"]) == 0)
        now = F.when(left, F.when(chain, _CHAIN).otherwise(_NOTHING)).otherwise(mode)
        begins = route & (mode != _ARGUMENTS)
        goes_on = chained & (now == _CHAIN) & (lower == base)
        # another statement, or a bracket that closes around the chain
        over = (now == _CHAIN) & (((token == ";") & (depth <= base)) | (lower < base))

        name = F.when(s["key"].isNotNull(), s["key"]).otherwise("")
        inside = quoted & (mode == _ARGUMENTS)
        is_path = inside & s["path"].isNull() & (
            (depth == base + 1) | ((depth == base + 2) & name.isin("url", "path"))
        )
        is_method = inside & (name == "method") & depth.isin(base + 2, base + 3)
        objects = F.transform(
            s["methods"], lambda m: F.struct(F.upper(m).alias("method"), s["path"].alias("route"))
        )
        verb = F.struct(F.upper(F.regexp_extract(token, rf"({_VERBS})\s*\($", 1)).alias("method"), s["path"].alias("route"))
        return F.struct(
            F.when(route | chained | opens, lower + 1).otherwise(lower).alias("depth"),
            F.when(begins, depth).otherwise(base).alias("base"),
            F.when(begins, _ARGUMENTS).when(over, _NOTHING).otherwise(now).alias("mode"),
            F.when(begins, F.lit(None)).when(key & (mode == _ARGUMENTS) & (depth == base + 2), F.rtrim(F.rtrim(token, F.lit(":"))))
            .otherwise(s["key"]).alias("key"),
            F.when(begins, F.lit(None)).when(is_path, said).otherwise(s["path"]).alias("path"),
            F.when(begins, F.array().cast("array<string>")).when(is_method, F.array_append(s["methods"], said))
            .otherwise(s["methods"]).alias("methods"),
            F.when(left & s["path"].isNotNull() & ~chain, F.concat(s["found"], objects))
            .when(goes_on, F.array_append(s["found"], verb))
            .otherwise(s["found"]).alias("found"),
        ).cast(_STATE)

    empty = F.struct(
        F.lit(0), F.lit(0), F.lit(_NOTHING), F.lit(None).cast("string"), F.lit(None).cast("string"),
        F.array().cast("array<string>"), F.array().cast("array<struct<method:string,route:string>>"),
    ).cast(_STATE)
    tokens = F.regexp_extract_all(code, F.lit(_TOKEN), F.lit(0))
    return F.aggregate(tokens, empty, step, lambda s: s["found"])
