"""Registered queries: corpus cleaning and framework detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from repovigil.functions.text import utf16_length
from repovigil.operators import clean, configs, detect
from repovigil.operators.order import ordered_positions
from repovigil.plans.corpus import view, with_views


def _files(spark, sf):
    return view(spark, sf, "files_corpus")


def _frameworks(spark, sf):
    return detect.detect_frameworks(_files(spark, sf))


def strip_first_dir(spark, sf):
    return clean.strip_first_dir(_files(spark, sf).select("repo_id", "ord", "path"))


def drop_empty_path(spark, sf):
    """Stripping twice leaves names without a directory; blank ones must go."""
    bare = _files(spark, sf).select("repo_id", "ord", F.regexp_replace("path", r"^[^/]*/", "").alias("path"))
    emptied = bare.withColumn("path", F.when(F.col("path").endswith(".md"), "").otherwise(F.col("path")))
    return clean.drop_empty_path(emptied)


def quick_ignore(spark, sf):
    return clean.quick_ignore(_files(spark, sf).select("repo_id", "ord", "path"))


def size_cap(spark, sf):
    """The default limit is above every text here, so the check uses one that splits the corpus."""
    return clean.size_cap(_files(spark, sf), 2000).select("repo_id", "ord", utf16_length(F.col("content")).alias("size"))


def _forced(spark, sf):
    """A choice for some repositories: a name, ``unknown``, or none."""
    number = F.substring("repo_id", 4, 9).cast("int")
    return (
        _files(spark, sf)
        .select("repo_id")
        .distinct()
        .select(
            "repo_id",
            F.when(number % 4 == 0, "unknown").when(number % 4 == 1, "django").when(number % 4 == 2, "").alias("framework"),
        )
    )


def _resolve(keep_unknown):
    def run(spark, sf):
        out = clean.resolve_framework(_frameworks(spark, sf), _forced(spark, sf), keep_unknown)
        return out.withColumn("indicators", F.array_join("indicators", "|"))

    return run


def framework_config(spark, sf):
    """Each repository with the settings its framework selects."""
    settings = F.broadcast(configs.framework_config(spark))
    sizes = [F.size(c).cast("bigint").alias("n_" + c) for c in ("extensions", "special_files", "ignore_dirs", "ignore_files", "important_files")]
    return _frameworks(spark, sf).select("repo_id", "framework").join(settings, "framework").select("repo_id", "framework", *sizes)


def _with_framework(spark, sf):
    return _files(spark, sf).select("repo_id", "ord", "path").join(_frameworks(spark, sf).select("repo_id", "framework"), "repo_id")


def _flag(name, expression):
    def run(spark, sf):
        return _with_framework(spark, sf).select(
            "repo_id", "ord", "path", expression(F.col("path"), F.col("framework")).alias(name)
        )

    return run


def filter_files(spark, sf):
    files = _files(spark, sf)
    return clean.filter_files(files, detect.detect_frameworks(files)).select(
        "repo_id", "ord", "path", "framework", F.md5("content").alias("content_md5")
    )


def sort_by_path(spark, sf):
    files = _files(spark, sf)
    kept = clean.filter_files(files.drop("content"), detect.detect_frameworks(files))
    key = F.collate("path", "UNICODE")
    return ordered_positions(kept.select("repo_id", "ord", "path"), ["repo_id"], [key, F.col("ord")])


def cleaning_stats(spark, sf):
    files = _files(spark, sf)
    return clean.cleaning_stats(files, detect.detect_frameworks(files))


def clean_archives(spark, sf):
    return _cleaned(*clean.clean_archives(_files(spark, sf)))


def clean_files(spark, sf):
    return _cleaned(*clean.clean_files(_files(spark, sf), _forced(spark, sf)))


def _cleaned(kept, frameworks, stats):
    """Counts per repository, with one number that the order of its paths decides."""
    size = kept.groupBy("repo_id").agg(F.sum(utf16_length(F.col("content"))).alias("kept_units"))
    place = (F.col("ord") + 1) * (F.length("path") + 7 * F.ascii(F.substring("path", -4, 1)))
    order = clean.in_path_order(kept).groupBy("repo_id").agg(F.sum(place).alias("path_order"))
    return (
        stats.join(frameworks.select("repo_id", "framework", "confidence"), "repo_id")
        .join(size, "repo_id", "left")
        .join(order, "repo_id", "left")
        .na.fill(0, ["kept_units", "path_order"])
    )


def first_file(spark, sf):
    return detect.first_files(detect.file_signals(_files(spark, sf)))


def framework_indicators(spark, sf):
    return detect.indicators(detect.file_signals(_files(spark, sf))).select(
        "repo_id", F.col("rule_ord").cast("bigint").alias("rule_ord"), "framework", "weight", "reason"
    )


def framework_scores(spark, sf):
    return detect.framework_scores(detect.file_signals(_files(spark, sf))).select(
        "repo_id", "framework", "score", F.array_join("reasons", "|").alias("reasons")
    )


def detect_framework(spark, sf):
    return _frameworks(spark, sf).withColumn("indicators", F.array_join("indicators", "|"))


# ------------------------------------------------------------------------------------------ SQL

_FILES = with_views("files_corpus")


def _values(table, rows):
    quoted = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"{table}(framework, entry) AS (SELECT * FROM (VALUES {quoted}) v)"


def _pairs(index):
    return [(row[0], entry) for row in configs.config_rows() for entry in dict.fromkeys(row[index])]


_RULES = ",\n".join(
    [
        _values("cfg_ext", _pairs(1)),
        _values("cfg_special", _pairs(2)),
        _values("cfg_dirs", _pairs(3)),
        _values("cfg_files", _pairs(4)),
        _values("cfg_important", _pairs(5)),
    ]
)
_DETECT = """
names AS (SELECT *, lower(path) AS lp, regexp_extract(lower(path), '([^/]*)$', 1) AS fname FROM files_corpus),
js AS (SELECT repo_id, ord, path, content FROM names WHERE path LIKE '%.js' OR path LIKE '%.ts'),
pkg AS (SELECT repo_id, CASE WHEN json_valid(first(content ORDER BY ord)) THEN first(content ORDER BY ord) END AS doc
        FROM names WHERE fname = 'package.json' GROUP BY repo_id),
dep AS (SELECT repo_id, name,
          coalesce(json_extract_string(doc, '$.devDependencies."' || name || '"'),
                   json_extract_string(doc, '$.dependencies."' || name || '"')) AS version
        FROM pkg, (VALUES ('next'), ('express'), ('fastify'), ('@nestjs/core'), ('@nestjs/common')) v(name)),
ind AS (
  SELECT repo_id, 1 AS rule_ord, 'nextjs' AS framework, 10 AS weight, 'next package found in package.json' AS reason FROM dep WHERE name = 'next' AND version <> ''
  UNION ALL SELECT repo_id, 2, 'express', 10, 'express package found in package.json' FROM dep WHERE name = 'express' AND version <> ''
  UNION ALL SELECT repo_id, 3, 'fastify', 10, 'fastify package found in package.json' FROM dep WHERE name = 'fastify' AND version <> ''
  UNION ALL SELECT DISTINCT repo_id, 4, 'nestjs', 10, '@nestjs packages found in package.json' FROM dep WHERE name LIKE '@nestjs%' AND version <> ''
  UNION ALL SELECT DISTINCT repo_id, 5, 'nextjs', 8, 'next.config file found' FROM names WHERE fname IN ('next.config.js', 'next.config.mjs', 'next.config.ts')
  UNION ALL SELECT DISTINCT repo_id, 6, 'nestjs', 8, 'nest-cli.json found' FROM names WHERE fname = 'nest-cli.json'
  UNION ALL SELECT repo_id, 7, 'springboot', 10, 'Spring Boot dependency found in pom.xml' FROM names WHERE fname = 'pom.xml'
    GROUP BY repo_id HAVING contains(first(content ORDER BY ord), 'spring-boot') OR contains(first(content ORDER BY ord), 'org.springframework.boot')
  UNION ALL SELECT repo_id, 9, 'flask', 10, 'Flask found in requirements.txt' FROM names WHERE fname = 'requirements.txt'
    GROUP BY repo_id HAVING contains(lower(first(content ORDER BY ord)), 'flask')
  UNION ALL SELECT repo_id, 10, 'django', 10, 'Django found in requirements.txt' FROM names WHERE fname = 'requirements.txt'
    GROUP BY repo_id HAVING contains(lower(first(content ORDER BY ord)), 'django')
  UNION ALL SELECT repo_id, 14, 'flask', 5, 'Flask import found in ' || first(path ORDER BY ord) FROM names
    WHERE path LIKE '%.py' AND (contains(content, 'from flask import') OR contains(content, 'import flask')) GROUP BY repo_id
  UNION ALL SELECT repo_id, 15, 'express', 5, 'Express import found in ' || first(path ORDER BY ord) FROM js
    WHERE contains(content, 'require(''express'')') OR contains(content, 'require("express")') OR contains(content, 'from ''express''') OR contains(content, 'from "express"') GROUP BY repo_id
  UNION ALL SELECT repo_id, 16, 'fastify', 5, 'Fastify import found in ' || first(path ORDER BY ord) FROM js
    WHERE contains(content, 'require(''fastify'')') OR contains(content, 'require("fastify")') OR contains(content, 'from ''fastify''') OR contains(content, 'from "fastify"') GROUP BY repo_id
  UNION ALL SELECT repo_id, 17, 'springboot', 5, 'Spring annotation found in ' || first(path ORDER BY ord) FROM names
    WHERE path LIKE '%.java' AND regexp_matches(content, '@SpringBootApplication|@RestController|@Controller|import org[.]springframework') GROUP BY repo_id),
scores AS (SELECT repo_id, framework, CAST(sum(weight) AS BIGINT) AS score, min(rule_ord) AS first_rule,
             string_agg(reason, '|' ORDER BY rule_ord) AS reasons FROM ind GROUP BY repo_id, framework),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, first_rule) AS r FROM scores),
fw AS (SELECT repo_id, coalesce(framework, 'unknown') AS framework,
         CASE WHEN score >= 15 THEN 'high' WHEN score >= 8 THEN 'medium' ELSE 'low' END AS confidence,
         coalesce(score, 0) AS score, coalesce(reasons, '') AS indicators
       FROM (SELECT DISTINCT repo_id FROM files_corpus) LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (repo_id))
"""
_FORCED = """
forced AS (SELECT repo_id, CASE CAST(substr(repo_id, 4) AS INT) % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'django' WHEN 2 THEN '' END AS choice
           FROM fw)
"""


def _flags(fw):
    """Filter flags of every file under framework table ``fw``."""
    return f"""
f AS (SELECT n.repo_id, ord, path, content, lp, fname, framework FROM names n JOIN {fw} USING (repo_id)),
hit_dir AS (SELECT DISTINCT f.repo_id, ord FROM f JOIN cfg_dirs c ON c.framework = f.framework AND
             (starts_with(lp, c.entry || '/') OR contains(lp, '/' || c.entry || '/') OR contains(lp, '/' || c.entry))),
hit_file AS (SELECT DISTINCT f.repo_id, ord FROM f JOIN cfg_files c ON c.framework = f.framework AND
             CASE WHEN c.entry LIKE '*%' THEN ends_with(lp, substr(c.entry, 2)) ELSE fname = c.entry END),
flags AS (SELECT f.*, (f.repo_id, f.ord) IN (SELECT (repo_id, ord) FROM hit_dir) AS dir_hit,
            (f.repo_id, f.ord) IN (SELECT (repo_id, ord) FROM hit_file) AS file_hit,
            EXISTS (SELECT 1 FROM cfg_special c WHERE c.framework = f.framework AND c.entry = f.fname) AS special,
            contains(fname, '.') AND EXISTS (SELECT 1 FROM cfg_ext c WHERE c.framework = f.framework
              AND c.entry = '.' || list_extract(string_split(f.fname, '.'), -1)) AS ext_ok FROM f),
verdicts AS (SELECT *, NOT dir_hit AND NOT file_hit AND (special OR ext_ok) AS keep FROM flags)
"""


def _clean_sql(fw, source=_FILES):
    return f"""{source}, {_RULES}, {_DETECT}, {fw[1]} {_flags(fw[0])}
SELECT repo_id, count(*) AS total, count(*) FILTER (keep) AS included, count(*) FILTER (NOT keep) AS ignored,
  framework, any_value(confidence) AS confidence, coalesce(CAST(sum(length(content)) FILTER (keep) AS BIGINT), 0) AS kept_units,
  coalesce(CAST(sum(place * (length(path) + 7 * ascii(substring(path, -4, 1)))) FILTER (keep) AS BIGINT), 0) AS path_order
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, keep ORDER BY path COLLATE en, ord) AS place FROM verdicts)
JOIN (SELECT repo_id, confidence FROM {fw[0]}) USING (repo_id) GROUP BY repo_id, framework"""


_QUICK = "regexp_matches(lower(path), 'node_modules/|[.]git/|__pycache__/|venv/|dist/|build/|target/|[.]next/|[.]gradle/')"
_ADMITTED = _FILES.replace("WITH files_corpus AS (", "WITH entries AS (") + f""",
files_corpus AS (SELECT * FROM entries WHERE path <> '' AND NOT {_QUICK} AND length(content) <= 1048576)"""

_RESOLVED = """
resolved AS (SELECT repo_id, CASE WHEN {use} THEN choice ELSE framework END AS framework,
    CASE WHEN {use} THEN 'high' ELSE confidence END AS confidence,
    CASE WHEN {use} THEN 'Manually specified' ELSE indicators END AS indicators FROM fw JOIN forced USING (repo_id))"""
_ANY = _RESOLVED.format(use="choice <> ''")
_NAMED = _RESOLVED.format(use="choice <> '' AND choice <> 'unknown'")


def _flag_sql(column, name):
    return f"{_FILES}, {_RULES}, {_DETECT}, {_flags('fw')} SELECT repo_id, ord, path, {column} AS {name} FROM flags"


SQL = {
    "strip_first_dir": f"""{_FILES} SELECT repo_id, ord,
        CASE WHEN contains(path, '/') THEN array_to_string(string_split(path, '/')[2:], '/') ELSE path END AS path FROM files_corpus""",
    "drop_empty_path": f"""{_FILES} SELECT * FROM (SELECT repo_id, ord, CASE WHEN ends_with(path, '.md') THEN ''
        ELSE regexp_replace(path, '^[^/]*/', '') END AS path FROM files_corpus) WHERE path <> ''""",
    "quick_ignore": f"{_FILES} SELECT repo_id, ord, path FROM files_corpus WHERE NOT {_QUICK}",
    "size_cap": f"{_FILES} SELECT repo_id, ord, length(content) AS size FROM files_corpus WHERE length(content) <= 2000",
    "resolve_framework_archive": f"{_FILES}, {_DETECT}, {_FORCED}, {_NAMED} SELECT * FROM resolved",
    "resolve_framework_files": f"{_FILES}, {_DETECT}, {_FORCED}, {_ANY} SELECT * FROM resolved",
    "framework_config": f"""{_FILES}, {_RULES}, {_DETECT} SELECT repo_id, framework,
        (SELECT count(*) FROM cfg_ext c WHERE c.framework = fw.framework) AS n_extensions,
        (SELECT count(*) FROM cfg_special c WHERE c.framework = fw.framework) AS n_special_files,
        {" ".join(["CASE framework"] + [f"WHEN '{r[0]}' THEN {len(r[3])}" for r in configs.config_rows()])} END::BIGINT AS n_ignore_dirs,
        {" ".join(["CASE framework"] + [f"WHEN '{r[0]}' THEN {len(r[4])}" for r in configs.config_rows()])} END::BIGINT AS n_ignore_files,
        (SELECT count(*) FROM cfg_important c WHERE c.framework = fw.framework) AS n_important_files FROM fw""",
    "ignore_dirs": _flag_sql("dir_hit", "dropped"),
    "ignore_files": _flag_sql("file_hit", "dropped"),
    "special_files": _flag_sql("special", "special"),
    "extension_filter": _flag_sql("ext_ok", "has_extension"),
    "filter_files": f"""{_FILES}, {_RULES}, {_DETECT}, {_flags('fw')}
        SELECT repo_id, ord, path, framework, md5(content) AS content_md5 FROM verdicts WHERE keep""",
    "sort_by_path": f"""{_FILES}, {_RULES}, {_DETECT}, {_flags('fw')} SELECT repo_id, ord, path,
        row_number() OVER (PARTITION BY repo_id ORDER BY path COLLATE en, ord) - 1 AS pos FROM verdicts WHERE keep""",
    "cleaning_stats": f"""{_FILES}, {_RULES}, {_DETECT}, {_flags('fw')} SELECT repo_id, count(*) AS total,
        count(*) FILTER (keep) AS included, count(*) FILTER (NOT keep) AS ignored FROM verdicts GROUP BY repo_id""",
    "clean_archives": _clean_sql(("fw", ""), _ADMITTED),
    "clean_files": _clean_sql(("resolved", f"{_FORCED}, {_ANY},")),
    "first_file": f"""{_FILES}, {_DETECT},
        signals AS (SELECT repo_id, CASE fname WHEN 'package.json' THEN 'package' WHEN 'pom.xml' THEN 'pom' WHEN 'requirements.txt' THEN 'requirements' ELSE 'next_config' END AS signal,
            ord, path, CASE WHEN fname <> 'next.config.mjs' THEN content END AS text FROM names
            WHERE fname IN ('package.json', 'pom.xml', 'requirements.txt', 'next.config.mjs')
          UNION ALL SELECT repo_id, 'flask_import', ord, path, NULL FROM names WHERE path LIKE '%.py' AND regexp_matches(content, 'from flask import|import flask')
          UNION ALL SELECT repo_id, 'express_import', ord, path, NULL FROM js WHERE regexp_matches(content, 'require[(][''"]express[''"][)]|from [''"]express[''"]')
          UNION ALL SELECT repo_id, 'fastify_import', ord, path, NULL FROM js WHERE regexp_matches(content, 'require[(][''"]fastify[''"][)]|from [''"]fastify[''"]')
          UNION ALL SELECT repo_id, 'spring_marker', ord, path, NULL FROM names WHERE path LIKE '%.java' AND regexp_matches(content, '@SpringBootApplication|@RestController|@Controller|import org[.]springframework'))
        SELECT repo_id, signal, first(path ORDER BY ord) AS path, any_value(text) AS text FROM signals GROUP BY repo_id, signal""",
    "framework_indicators": f"{_FILES}, {_DETECT} SELECT repo_id, CAST(rule_ord AS BIGINT) AS rule_ord, framework, CAST(weight AS BIGINT) AS weight, reason FROM ind",
    "framework_scores": f"{_FILES}, {_DETECT} SELECT repo_id, framework, score, reasons FROM scores",
    "detect_framework": f"{_FILES}, {_DETECT} SELECT * FROM fw",
}

QUERIES = {
    "detect_framework": detect_framework,
    "first_file": first_file,
    "framework_indicators": framework_indicators,
    "framework_scores": framework_scores,
    "strip_first_dir": strip_first_dir,
    "drop_empty_path": drop_empty_path,
    "quick_ignore": quick_ignore,
    "size_cap": size_cap,
    "resolve_framework_archive": _resolve(False),
    "resolve_framework_files": _resolve(True),
    "framework_config": framework_config,
    "ignore_dirs": _flag("dropped", clean.dropped_by_dir),
    "ignore_files": _flag("dropped", clean.dropped_by_file),
    "special_files": _flag("special", clean.is_special),
    "extension_filter": _flag("has_extension", clean.has_extension),
    "filter_files": filter_files,
    "sort_by_path": sort_by_path,
    "cleaning_stats": cleaning_stats,
    "clean_archives": clean_archives,
    "clean_files": clean_files,
}
