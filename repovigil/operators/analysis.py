"""Rule-driven analysis: routes, flows, import traces, checklists, control evidence, risky lines.

File text is read where it is scanned and never shuffled: a cheap path or substring test comes
first, then a pattern on the whole text, and only texts that hit are cut into lines. What leaves
the scan are small hit rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repovigil.functions.skew import salted_lookup
from repovigil.functions.tables import constant_table
from repovigil.functions.text import contains_any, ends_with_any
from repovigil.operators import rules
from repovigil.operators.code import SCRIPT, calls_of_route, code_of
from repovigil.operators.needles import needle_bits, protective, risky
from repovigil.operators.order import ordered_positions
from repovigil.session import materialize, written


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _below(prefix: Column, route: Column) -> Column:
    """A method's route below its class's path; unchanged if the class has none."""
    base, rest = (F.regexp_replace(c, "^/+|/+$", "") for c in (prefix, route))
    joined = F.concat(F.lit("/"), base, F.when(rest != "", F.concat(F.lit("/"), rest)).otherwise(F.lit("")))
    return F.when(base != "", joined).otherwise(route)


def code(path: Column, text: Column) -> Column:
    """The code that routes and imports are read from; null for files that can hold neither."""
    useful = F.lower(path).rlike(rules.ROUTE_FILES) & text.rlike(rules.ROUTE_SIGNS)
    return F.when(contains_any(text, ["import", "require"]) | useful, code_of(path, text))


def _first_of(array: Column, otherwise: Column) -> Column:
    return F.when(F.size(array) > 0, array).otherwise(F.array(otherwise))


def _with_prefix(name: str, code: Column, route: Column) -> Column:
    if name not in rules.CLASS_PREFIX:
        return route
    return _below(F.regexp_extract(code, rules.CLASS_PREFIX[name], 1), route)


def route_hits(code: Column) -> Column:
    """Route definitions in one file's ``code``, as an array; nothing for files that cannot define any."""
    path = F.col("path")

    def found(name: str, match: Column, method: Column, route: Column) -> Column:
        method = F.when(F.upper(method) == "ALL", "ANY").otherwise(F.upper(method))
        return F.struct(F.lit(name).alias("rule"), match.alias("at"), method.alias("method"), route.alias("route"))

    per_rule = []
    for name, extensions, pattern, method_group, route_group in rules.ROUTE_RULES:
        def row(match: Column, at: Column) -> Column:  # called at once, inside this iteration
            method = F.regexp_extract(match, pattern, method_group) if method_group else F.lit("ANY")
            return found(name, at, method, _with_prefix(name, code, F.regexp_extract(match, pattern, route_group)))

        per_rule.append(F.when(ends_with_any(path, extensions), F.transform(_matches(code, pattern), row)))
    for name, extensions, pattern, method_group, arguments_group in rules.ANNOTATION_RULES:
        def rows(match: Column, at: Column) -> Column:  # called at once, inside this iteration
            arguments = F.regexp_extract(match, pattern, arguments_group)
            paths = F.regexp_extract_all(
                F.regexp_extract(arguments, rules.PATH_ARGUMENT, 1), F.lit(rules.QUOTED), F.lit(1)
            )
            if method_group:
                method = F.regexp_extract(match, pattern, method_group)
            else:
                said = F.regexp_replace(F.regexp_extract(arguments, rules.METHOD_ARGUMENT, 1), r"RequestMethod\.", "")
                method = F.when(said != "", said).otherwise("ANY" if name == "request_mapping" else "GET")
            return F.transform(
                _first_of(paths, F.lit("")), lambda route: found(name, at, method, _with_prefix(name, code, route))
            )

        per_rule.append(F.when(ends_with_any(path, extensions), F.flatten(F.transform(_matches(code, pattern), rows))))
    per_rule.append(
        F.when(
            ends_with_any(path, SCRIPT) & code.rlike(r"\.\s*route\s*\("),
            F.transform(calls_of_route(code), lambda c, at: found("script_route", at, c["method"], c["route"])),
        )
    )
    folder = F.regexp_extract(path, rules.HANDLER_FILE, 1)
    per_rule.append(
        F.when(
            path.rlike(rules.HANDLER_FILE),
            F.transform(
                _matches(code, rules.HANDLER_EXPORT),
                lambda m, at: found(
                    "handler_export", at, F.regexp_extract(m, rules.HANDLER_EXPORT, 1), F.concat(F.lit("/"), folder)
                ),
            ),
        )
    )
    hits = F.flatten(F.array_compact(F.array(*per_rule)))
    return F.when(code.isNotNull() & F.lower(path).rlike(rules.ROUTE_FILES), hits)


def endpoints_of(rows: DataFrame) -> DataFrame:
    """``route_hits`` as rows, one per method and route."""
    hits = rows.select("repo_id", "ord", "path", F.inline("route_hits"))
    # a route may name its methods in a list
    listed = _first_of(F.regexp_extract_all("method", F.lit("[A-Z]+"), F.lit(0)), F.lit("GET"))
    return hits.select(
        "repo_id", "ord", "path", "rule", F.col("at").cast("bigint").alias("pos"), F.explode(F.array_distinct(listed)).alias("method"), "route"
    )


def mount_hits(code: Column) -> Column:
    """Routers that one file's ``code`` puts below a path, ``(at, prefix, modules)``, and whether it listens.

    ``modules`` are the modules that may define the router, likeliest first: what the name is bound to by an
    import, or the module named on the spot.
    """
    path = F.col("path")
    folder = _folder(path)
    script = ends_with_any(path, SCRIPT)
    bound = F.when(script, _script_bindings(folder, code)).when(path.endswith(".py"), _python_bindings(folder, code))

    def modules(router: Column) -> Column:
        named = F.regexp_extract(router, r"""['"]([^'"]*)""", 1)
        on_the_spot = F.when(script, _script_module(folder, named)).otherwise(F.translate(named, ".", "/"))
        name = F.split_part(router, F.lit("."), F.lit(1))
        known = F.filter(bound, lambda b: b["name"] == name)
        return F.when(named != "", F.array(on_the_spot)).otherwise(F.flatten(F.transform(known, lambda b: b["modules"])))

    per_rule = []
    for extensions, pattern, prefix_group, router_pattern, prefix_pattern in rules.MOUNT_RULES:
        def row(match: Column, at: Column) -> Column:  # called at once, inside this iteration
            prefix = F.regexp_extract(match, prefix_pattern or pattern, 1 if prefix_pattern else prefix_group)
            return F.struct(
                at.alias("at"), prefix.alias("prefix"), modules(F.regexp_extract(match, router_pattern, 1)).alias("modules")
            )

        per_rule.append(F.when(ends_with_any(path, extensions), F.transform(_matches(code, pattern), row)))
    mounts = F.flatten(F.array_compact(F.array(*per_rule)))
    listens = code.rlike(r"\.\s*listen\s*\(")
    return F.when(
        code.rlike(rules.MOUNT_SIGNS),
        F.struct(F.filter(mounts, lambda m: F.size(m["modules"]) > 0).alias("mounts"), listens.alias("listens")),
    )


def mounts_of(rows: DataFrame) -> DataFrame:
    """``(repo_id, ord, listens, prefix, target)``: file ``ord`` puts the routes of file ``target`` below ``prefix``."""
    hits = rows.select("repo_id", "ord", "mount_hits.listens", F.posexplode("mount_hits.mounts").alias("nth", "m"))
    wanted = hits.select("repo_id", "ord", "listens", "nth", "m.prefix", F.posexplode("m.modules").alias("choice", "module"))
    best = wanted.join(_modules(rows), ["repo_id", "module"]).groupBy("repo_id", "ord", "listens", "nth", "prefix")
    target = best.agg(F.min_by("target", "choice").alias("target")).filter(F.col("ord") != F.col("target"))
    return target.select("repo_id", "ord", "listens", "prefix", "target").distinct()


def mount_endpoints(endpoints: DataFrame, mounts: DataFrame, max_depth: int = rules.MAX_TRACE_DEPTH) -> DataFrame:
    """Endpoints with the paths that their files are mounted below put before their routes.

    Prefixes go from files that listen, or that nobody mounts, along the mounts, until no file gets a new one.
    A file that is mounted several times has its routes below each path; one chain of mounts passes no file
    twice, so cycles end. A file that only a cycle mounts keeps its own routes.
    """
    mounts = materialize(mounts)
    targets = mounts.select("repo_id", F.col("target").alias("ord")).distinct()
    parents = mounts.select("repo_id", "ord", "listens").distinct()
    start = F.lit("").alias("prefix"), F.array("ord").alias("chain")
    listening = parents.filter("listens").select("repo_id", "ord", *start)
    unmounted = parents.filter("NOT listens").join(targets, ["repo_id", "ord"], "left_anti").select("repo_id", "ord", *start)
    frontier, below = listening.unionByName(unmounted), listening
    for _ in range(max_depth):
        steps = frontier.withColumnRenamed("prefix", "upper").join(mounts, ["repo_id", "ord"])
        steps = steps.filter(~F.array_contains("chain", F.col("target"))).select(
            "repo_id", F.col("target").alias("ord"), _below(F.col("upper"), F.col("prefix")).alias("prefix"),
            F.array_append("chain", F.col("target")).alias("chain"),
        )
        frontier = materialize(steps.distinct())
        if frontier.isEmpty():
            break
        below = below.unionByName(frontier)
    prefixes = below.select("repo_id", "ord", "prefix").distinct()
    full = F.when(F.col("prefix").isNull(), F.col("route")).otherwise(_below(F.col("prefix"), F.col("route")))
    return endpoints.join(prefixes, ["repo_id", "ord"], "left").withColumn("route", full).drop("prefix").select(endpoints.columns)


def discover_endpoints(files: DataFrame) -> DataFrame:
    """``(repo_id, ord, path, rule, pos, method, route)``, one row per method and route.

    Routes are read from code without comments, over any number of lines, and stand below the paths
    that their files are mounted at.
    """
    read = files.select("repo_id", "ord", "path", code(F.col("path"), F.col("content")).alias("code"))
    facts = read.select(
        "repo_id", "ord", "path", route_hits(F.col("code")).alias("route_hits"), mount_hits(F.col("code")).alias("mount_hits")
    )
    facts = written(facts, "routes")
    return mount_endpoints(endpoints_of(facts), mounts_of(facts))


def route_entity(route: Column) -> Column:
    """The route without its parameters."""
    kept = F.filter(F.split(route, "/"), lambda s: (s != "") & ~s.rlike(r"^[:{<\[]"))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def classify_sensitivity(text: Column) -> Column:
    level = F.lit("medium")
    for name, pattern in reversed(rules.SENSITIVITY_RULES):
        level = F.when(text.rlike(pattern), name).otherwise(level)
    return level


def group_crud_flows(endpoints: DataFrame) -> DataFrame:
    """Flows: the CRUD routes of one entity in one file, and every other route on its own.

    ``(repo_id, ord, path, entity, flow_name, entry_point, methods, routes, sensitivity_level)``.
    """
    crud = F.col("method").isin(rules.HTTP_VERBS)
    keyed = endpoints.withColumn("entity", route_entity(F.col("route"))).withColumn(
        "flow_name",
        F.concat_ws("#", "path", "entity", F.when(~crud, F.concat_ws(" ", "method", "route"))),
    )
    flows = keyed.groupBy("repo_id", "ord", "path", "entity", "flow_name").agg(
        F.min(F.struct("rule", "pos", "method", "route")).alias("entry"),
        F.array_sort(F.collect_set("method")).alias("methods"),
        F.array_sort(F.collect_set("route")).alias("routes"),  # routes of one file
    )
    return flows.select(
        "repo_id", "ord", "path", "entity", "flow_name",
        F.concat_ws(" ", "entry.method", "entry.route").alias("entry_point"),
        "methods", "routes",
        classify_sensitivity(F.lower(F.concat_ws(" ", "entity", "path"))).alias("sensitivity_level"),
    )


def _without_extension(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), "/(?:index|__init__)$", "")


def _resolve(folder: Column, spec: Column) -> Column:
    """A relative module name against a folder."""
    def step(parts: Column, part: Column) -> Column:
        up = F.when(F.size(parts) > 0, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
        return F.when(part == "..", up).when(part.isin("", "."), parts).otherwise(F.array_append(parts, part))

    parts = F.concat(F.split(folder, "/"), F.split(spec, "/"))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _script_module(folder: Column, spec: Column) -> Column:
    return _without_extension(
        F.when(
            spec.startswith(rules.SOURCE_ALIAS),
            F.concat(F.lit(rules.SOURCE_FOLDER + "/"), F.substr(spec, F.lit(len(rules.SOURCE_ALIAS) + 1))),
        ).otherwise(_resolve(folder, spec))
    )


def _binding(name: Column, modules: Column) -> Column:
    return F.struct(name.alias("name"), modules.alias("modules"))


def _script_bindings(folder: Column, code: Column) -> Column:
    """Names that imports of own modules bind, with the module."""
    per_rule = []
    for pattern, names_group, module_group in rules.SCRIPT_BINDING:
        def rows(match: Column) -> Column:  # called at once, inside this iteration
            module = _script_module(folder, F.regexp_extract(match, pattern, module_group))
            names = F.split(F.translate(F.regexp_extract(match, pattern, names_group), "{}", "  "), ",")
            last = F.transform(names, lambda n: F.regexp_extract(n, r"([\w$]+)\s*$", 1))
            return F.transform(F.filter(last, lambda n: n != ""), lambda n: _binding(n, F.array(module)))

        per_rule.append(F.flatten(F.transform(_matches(code, pattern), rows)))
    return F.concat(*per_rule)


def _python_package(folder: Column, match: Column) -> Column:
    """The module that a ``from`` statement names."""
    dots, base = (F.regexp_extract(match, rules.PYTHON_FROM, k) for k in (1, 2))
    near = F.when(dots != "", _resolve(folder, F.repeat(F.lit("../"), F.greatest(F.length(dots) - 1, F.lit(0))))).otherwise(F.lit(""))
    return F.array_join(F.filter(F.array(near, F.translate(base, ".", "/")), lambda p: p != ""), "/")


def _inside(package: Column, name: Column) -> Column:
    return F.regexp_replace(F.concat(package, F.lit("/"), name), "^/", "")


def _python_bindings(folder: Column, code: Column) -> Column:
    """Names that Python imports bind; a name may be a module of the package or be defined in it."""
    def from_import(match: Column) -> Column:
        package = _python_package(folder, match)
        return F.transform(
            _listed(F.regexp_extract(match, rules.PYTHON_FROM, 3)),
            lambda n: _binding(n["alias"], F.array(_inside(package, n["name"]), package)),
        )

    modules = F.flatten(
        F.transform(
            F.regexp_extract_all(code, F.lit(rules.PYTHON_MODULES), F.lit(1)),
            lambda names: F.transform(
                _listed(names), lambda n: _binding(n["alias"], F.array(F.translate(n["name"], ".", "/")))
            ),
        )
    )
    return F.concat(F.flatten(F.transform(_matches(code, rules.PYTHON_FROM), from_import)), modules)


def imported_modules(code: Column) -> Column:
    """Module names that a file's ``code`` imports, resolved against its folder."""
    path = F.col("path")
    folder = _folder(path)
    script = F.when(
        ends_with_any(path, SCRIPT),
        F.transform(
            F.regexp_extract_all(code, F.lit(rules.SCRIPT_IMPORT), F.lit(1)), lambda spec: _script_module(folder, spec)
        ),
    )

    def from_import(match: Column) -> Column:
        package = _python_package(folder, match)
        inside = F.transform(_listed(F.regexp_extract(match, rules.PYTHON_FROM, 3)), lambda n: _inside(package, n["name"]))
        return F.array_append(inside, package)

    python = F.when(
        path.endswith(".py"),
        F.concat(
            F.flatten(F.transform(_matches(code, rules.PYTHON_FROM), from_import)),
            F.flatten(
                F.transform(
                    F.regexp_extract_all(code, F.lit(rules.PYTHON_MODULES), F.lit(1)),
                    lambda names: F.transform(_listed(names), lambda n: F.translate(n["name"], ".", "/")),
                )
            ),
        ),
    )
    jvm = F.when(
        ends_with_any(path, [".java", ".kt"]),
        F.flatten(
            F.transform(
                F.regexp_extract_all(code, F.lit(rules.JVM_IMPORT), F.lit(1)),
                # a member may be imported: its class is one name shorter
                lambda name: F.array(F.translate(name, ".", "/"), F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), ".", "/")),
            )
        ),
    )
    return F.array_distinct(F.flatten(F.array_compact(F.array(script, python, jvm))))


def _listed(names: Column) -> Column:
    """``(name, alias)`` of each name in a comma-separated list, in brackets or not; no alias is the name itself."""
    word = r"^[\s(\\]*([A-Za-z_][\w.]*)(?:\s+as\s+(\w+))?"

    def one(item: Column) -> Column:
        name, alias = (F.regexp_extract(item, word, k) for k in (1, 2))
        return F.struct(name.alias("name"), F.when(alias != "", alias).otherwise(name).alias("alias"))

    return F.filter(F.transform(F.split(names, ","), one), lambda n: n["name"] != "")


def _modules(rows: DataFrame) -> DataFrame:
    """``(repo_id, module, target)``: the names that a file can be imported by."""
    plain = _without_extension(F.col("path"))
    names = F.array_distinct(F.array(plain, F.regexp_replace(plain, rules.JVM_ROOT, "")))
    return (
        rows.select("repo_id", F.explode(names).alias("module"), F.col("ord").alias("target"))
        .groupBy("repo_id", "module")
        .agg(F.min("target").alias("target"))
    )


def edges_of(rows: DataFrame) -> DataFrame:
    """``imported_modules`` met with the paths they name."""
    wanted = rows.select("repo_id", "ord", F.explode("imported_modules").alias("module"))
    return (
        wanted.join(_modules(rows), ["repo_id", "module"])
        .filter(F.col("ord") != F.col("target"))
        .select("repo_id", "ord", "target")
        .distinct()
    )


def import_edges(files: DataFrame) -> DataFrame:
    """``(repo_id, ord, target)``: file ``ord`` imports file ``target`` of the same repository."""
    read = files.select("repo_id", "ord", "path", code(F.col("path"), F.col("content")).alias("code"))
    return edges_of(read.select("repo_id", "ord", "path", imported_modules(F.col("code")).alias("imported_modules")))


@dataclass
class Traces:
    """Files reached from entry files, 64 entries of a repository to a row.

    ``blocks``: ``(repo_id, block, ord, depth, bits)``, the entries of a block that reach file ``ord`` first at
    ``depth``. ``entries``: ``(repo_id, block, names)``, the entry of each bit.
    """

    blocks: DataFrame
    entries: DataFrame

    def rows(self) -> DataFrame:
        """``(repo_id, entry, ord, depth)``."""
        return self.unpacked(self.blocks).select("repo_id", "entry", "ord", "depth")

    def unpacked(self, blocks: DataFrame) -> DataFrame:
        """One row per set bit, with its ``entry``."""
        named = blocks.join(self.entries, ["repo_id", "block"])
        set_bits = F.filter("names", lambda n: F.col("bits").bitwiseAND(n["bit"]) != 0)
        return named.select("*", F.explode(F.transform(set_bits, lambda n: n["entry"])).alias("entry")).drop("names", "bits")


def trace_blocks(edges: DataFrame, flows: DataFrame, max_depth: int = rules.MAX_TRACE_DEPTH) -> Traces:
    """Breadth first from all entry files at once, entries as bits of one number.

    Edges are shuffled once and keep their partitions; a round moves the frontier's numbers to them and adds
    what it reached by ``bit_or``, combined per task, to what was seen. So a file that everything imports is
    one row per block of 64 entries, and cycles end when no bit is new. Rounds are written to the shared
    checkpoint folder, so a lost executor repeats one round at most.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = materialize(edges.repartition(parts, "repo_id", "ord"))
    numbered = ordered_positions(flows.select("repo_id", "ord").distinct(), ["repo_id"], [F.asc("ord")], "nth")
    entries = materialize(
        numbered.select(
            "repo_id", F.col("ord").alias("entry"), F.expr("nth div 64").alias("block"),
            F.expr("shiftleft(1L, CAST(nth % 64 AS INT))").alias("bit"),
        )
    )
    state = entries.select(
        "repo_id", "block", F.col("entry").alias("ord"), F.col("bit").alias("fresh"), F.col("bit").alias("seen")
    )
    frontier = state.select("repo_id", "block", "ord", F.lit(0).alias("depth"), F.col("fresh").alias("bits"))
    blocks = frontier
    for depth in range(1, max_depth):
        step = frontier.join(edges, ["repo_id", "ord"]).select(
            "repo_id", "block", F.col("target").alias("ord"), F.col("bits").alias("fresh"), F.lit(0).cast("bigint").alias("seen")
        )
        before = state.select("repo_id", "block", "ord", F.lit(0).cast("bigint").alias("fresh"), "seen")
        both = step.unionAll(before).groupBy("repo_id", "block", "ord").agg(
            F.bit_or("fresh").alias("reached"), F.bit_or("seen").alias("had")
        )
        state = materialize(
            both.select(
                "repo_id", "block", "ord", F.col("reached").bitwiseAND(F.bitwise_not("had")).alias("fresh"),
                F.col("reached").bitwiseOR(F.col("had")).alias("seen"),
            )
        )
        frontier = state.filter("fresh <> 0").select("repo_id", "block", "ord", F.lit(depth).alias("depth"), F.col("fresh").alias("bits"))
        if frontier.isEmpty():
            break
        blocks = blocks.unionAll(frontier)
    names = entries.groupBy("repo_id", "block").agg(F.collect_list(F.struct("bit", "entry")).alias("names"))  # 64 at most
    return Traces(blocks, names)


def trace_imports(edges: DataFrame, flows: DataFrame, max_depth: int = rules.MAX_TRACE_DEPTH) -> DataFrame:
    """``(repo_id, entry, ord, depth)``: files reached from each entry file, each once, entry at 0."""
    return trace_blocks(edges, flows, max_depth).rows()


def _control(entry: tuple) -> Column:
    cid, name, description, category, _, importance, owasp, _, _ = entry
    return F.struct(
        F.lit(cid).alias("control_id"), F.lit(name).alias("name"), F.lit(description).alias("description"),
        F.lit(category).alias("category"), F.lit(importance).alias("importance"),
        F.array(*[F.lit(o) for o in owasp]).alias("owasp_mapping"),
    )


def build_checklists(flows: DataFrame) -> DataFrame:
    """Flows with ``required_controls`` and ``recommended_controls``.

    The catalog stands in the plan as literals, most important first, so choosing and capping
    happens inside the row: no join, no shuffle. Low flows keep required controls only, medium
    flows only recommended ones of high importance; the cap counts both kinds.
    """
    text = F.concat_ws(" ", F.array_join("methods", ","), F.lower(F.array_join("routes", " ")))
    level = F.col("sensitivity_level")
    chosen = []
    for entry in rules.CONTROLS:
        _, _, _, _, required, importance, _, applies, _ = entry
        use = text.rlike(applies) if applies else F.lit(True)
        if not required:
            use = use & (level.isin("critical", "high") | ((level == "medium") & F.lit(importance in ("critical", "high"))))
        chosen.append(F.when(use, F.struct(F.lit(required).alias("required"), _control(entry).alias("control"))))
    cap = F.lit(0)
    for name, limit in rules.CONTROL_CAP.items():
        cap = F.when(level == name, limit).otherwise(cap)
    picked = flows.withColumn("_picked", F.slice(F.array_compact(F.array(*chosen)), F.lit(1), cap))

    def part(required: bool) -> Column:
        return F.transform(F.filter("_picked", lambda c: c["required"] == F.lit(required)), lambda c: c["control"])

    return picked.withColumns({"required_controls": part(True), "recommended_controls": part(False)}).drop("_picked")


def checklist_controls(checklists: DataFrame) -> DataFrame:
    """Exploded form: one row per flow and control."""
    def tagged(column: str, required: bool) -> Column:
        return F.transform(column, lambda c: F.struct(F.lit(required).alias("required"), c.alias("control")))

    return checklists.select(
        "repo_id", "ord", "flow_name",
        F.inline(F.concat(tagged("required_controls", True), tagged("recommended_controls", False))),
    ).select("repo_id", "ord", "flow_name", "required", "control.*")


def _snippet(lines: Column, index: Column) -> Column:
    """The line with one neighbour on each side."""
    return F.array_join(
        F.slice(lines, F.greatest(index, F.lit(1)), F.when(index == 0, 2).otherwise(rules.SNIPPET_LINES)), "\n"
    )


def _with_lines(text: Column, use: Callable[[Column], Column]) -> Column:
    """``use(lines)`` with the text cut once, however often ``use`` refers to the lines."""
    return F.get(F.transform(F.array(F.split(text, "\n")), use), F.lit(0))


def _passing(lines: Column, test: Callable[[Column], Column]) -> Column:
    """Positions of the lines that pass ``test``."""
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    return F.transform(F.filter(numbered, lambda x: test(x["line"])), lambda x: x["i"])


def _hit(lines: Column, index: Column) -> Column:
    return F.struct((index + 1).cast("bigint").alias("line_no"), _snippet(lines, index).alias("snippet"))


def vulnerability_hits(bits: Column) -> Column:
    """Risky lines of one file, as an array; ``bits`` are its ``needle_bits``."""
    text = F.col("content")

    def rows(lines: Column) -> Column:
        per_rule = []
        for k, (kind, severity, needles, pattern, title, advice) in enumerate(rules.VULNERABILITY_RULES):
            def row(index: Column) -> Column:  # called at once, inside this iteration
                hit = _hit(lines, index)
                return F.struct(
                    hit["line_no"].alias("line_no"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
                    F.lit(title).alias("title"), hit["snippet"].alias("snippet"), F.lit(advice).alias("recommendation"),
                )

            # a line that matches holds a needle, which is found faster
            found = F.transform(_passing(lines, lambda line: contains_any(line, needles) & line.rlike(pattern)), row)
            per_rule.append(F.when(risky(bits, k), found))
        return F.flatten(F.array_compact(F.array(*per_rule)))

    some = bits.bitwiseAND((1 << len(rules.VULNERABILITY_RULES)) - 1) != 0
    return F.when(some, _with_lines(text, rows))


def scan_vulnerabilities(files: DataFrame) -> DataFrame:
    """``(repo_id, ord, path, line_no, type, severity, title, snippet, recommendation)``."""
    searched = files.select("repo_id", "ord", "path", "content", needle_bits(F.col("content")).alias("bits"))
    return searched.select("repo_id", "ord", "path", F.inline(vulnerability_hits(F.col("bits"))))


def evidence_hits(bits: Column) -> Column:
    """The first line of one file that shows each control, as an array; ``bits`` are its ``needle_bits``."""
    text = F.col("content")

    def rows(lines: Column) -> Column:
        per_control = []
        for k, entry in enumerate(rules.CONTROLS):
            cid, signs = entry[0], entry[-1]

            def row(index: Column) -> Column:  # called at once, inside this iteration
                hit = _hit(lines, index)
                return F.struct(F.lit(cid).alias("control_id"), hit["line_no"].alias("line_no"), hit["snippet"].alias("snippet"))

            first = F.slice(_passing(lines, lambda line: contains_any(line, signs)), 1, 1)
            per_control.append(F.when(protective(bits, k), F.transform(first, row)))
        return F.flatten(F.array_compact(F.array(*per_control)))

    some = F.shiftright(bits, len(rules.VULNERABILITY_RULES)) != 0
    return F.when(some, _with_lines(text, rows))


def control_evidence(files: DataFrame) -> DataFrame:
    """``(repo_id, ord, path, control_id, line_no, snippet)``: first line that shows a control."""
    searched = files.select("repo_id", "ord", "path", "content", needle_bits(F.col("content")).alias("bits"))
    return searched.select("repo_id", "ord", "path", F.inline(evidence_hits(F.col("bits"))))


def match_controls(controls: DataFrame, traces: Traces, evidence: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Each flow's control as implemented (file, snippet), auto_handled (by what) or missing (severity).

    Evidence is scanned once per file and met with the flows that reached the file; nearest file
    first. Evidence in a flow wins over the framework's default.
    """
    spark = controls.sparkSession
    evidence = written(evidence, "evidence")
    shown = traces.blocks.join(evidence.select("repo_id", "ord", "control_id"), ["repo_id", "ord"])
    nearest = traces.unpacked(shown).groupBy("repo_id", "entry", "control_id").agg(
        F.min(F.struct("depth", "ord"))["ord"].alias("ord")
    )
    # one line of each control and file: only the nearest file's text is fetched
    reached = nearest.join(evidence, ["repo_id", "ord", "control_id"]).select(
        "repo_id", "entry", "control_id", F.struct("path", "snippet").alias("evidence")
    )
    handled = F.broadcast(  # a constant list
        constant_table(spark, ["framework", "control_id", "handled_by", "explanation"], rules.HANDLED)
    )
    found = F.col("evidence").isNotNull()
    auto = ~found & F.col("handled_by").isNotNull()
    matched = controls.withColumnRenamed("ord", "entry").join(reached, ["repo_id", "entry", "control_id"], "left")
    by_repo = frameworks.select("repo_id", "framework")
    return (
        salted_lookup(matched, by_repo, "repo_id", ["flow_name", "control_id"], "left")
        .join(handled, ["framework", "control_id"], "left")
        .select(
            "repo_id", "flow_name", "control_id", F.col("name").alias("control_name"), "required",
            F.when(found, "implemented").when(auto, "auto_handled").otherwise("missing").alias("outcome"),
            F.when(~found & ~auto, F.col("importance")).alias("severity"),
            F.col("evidence.path").alias("file"),
            F.col("evidence.snippet").alias("snippet"),
            F.when(auto, F.col("handled_by")).alias("handled_by"),
            F.when(auto, F.col("explanation")).alias("explanation"),
        )
    )
