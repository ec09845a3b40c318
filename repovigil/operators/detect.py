"""Which web framework does each repository use? One scored row per repository.

One scan turns files into small signal rows: a manifest keeps its text, a source file only says
which import rule it meets. All later steps aggregate those rows, so file text other than
manifests is never shuffled, and a repository that holds most files costs no more than its share
(all aggregates combine map-side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repovigil.functions.answers import blank_value, first_json, last_key_wins
from repovigil.functions.tables import constant_table
from repovigil.functions.text import base_name, contains_any, ends_with_any

# ---------------------------------------------------------------------------------------------
# Indicator order, weights, texts and needles.
# (signal, mark in the file, framework, weight, reason); the order also breaks ties between frameworks.
INDICATORS = [
    ("package", "next", "nextjs", 10, "next package found in package.json"),
    ("package", "express", "express", 10, "express package found in package.json"),
    ("package", "fastify", "fastify", 10, "fastify package found in package.json"),
    ("package", "@nestjs", "nestjs", 10, "@nestjs packages found in package.json"),
    ("next_config", "", "nextjs", 8, "next.config file found"),
    ("nest_cli", "", "nestjs", 8, "nest-cli.json found"),
    ("pom", "spring", "springboot", 10, "Spring Boot dependency found in pom.xml"),
    ("gradle", "spring", "springboot", 10, "Spring Boot dependency found in build.gradle"),
    ("requirements", "flask", "flask", 10, "Flask found in requirements.txt"),
    ("requirements", "django", "django", 10, "Django found in requirements.txt"),
    ("pyproject", "flask", "flask", 10, "Flask found in pyproject.toml"),
    ("pyproject", "django", "django", 10, "Django found in pyproject.toml"),
    ("manage", "django", "django", 8, "Django manage.py found"),
    ("flask_import", "", "flask", 5, "Flask import found in "),
    ("express_import", "", "express", 5, "Express import found in "),
    ("fastify_import", "", "fastify", 5, "Fastify import found in "),
    ("spring_marker", "", "springboot", 5, "Spring annotation found in "),
]
# Signal -> file names, the preferred one first.
NAMED_FILES = {
    "package": ["package.json"],
    "pom": ["pom.xml"],
    "gradle": ["build.gradle", "build.gradle.kts"],
    "requirements": ["requirements.txt"],
    "pyproject": ["pyproject.toml"],
    "manage": ["manage.py"],
    "next_config": ["next.config.js", "next.config.mjs", "next.config.ts"],
    "nest_cli": ["nest-cli.json"],
}
MANIFESTS = ["package", "pom", "gradle", "requirements", "pyproject", "manage"]
PACKAGES = ["next", "express", "fastify", "@nestjs/core", "@nestjs/common"]
SPRING_BOOT = ["spring-boot", "org.springframework.boot"]
IMPORT_RULES = {
    "flask_import": ([".py"], ["from flask import", "import flask"]),
    "express_import": (
        [".js", ".ts"],
        ["require('express')", 'require("express")', "from 'express'", 'from "express"'],
    ),
    "fastify_import": (
        [".js", ".ts"],
        ["require('fastify')", 'require("fastify")', "from 'fastify'", 'from "fastify"'],
    ),
    "spring_marker": (
        [".java"],
        ["@SpringBootApplication", "@RestController", "@Controller", "import org.springframework"],
    ),
}
HIGH_SCORE, MEDIUM_SCORE = 15, 8
# ---------------------------------------------------------------------------------------------


def _import_hit(rule: str) -> Column:
    extensions, needles = IMPORT_RULES[rule]
    return ends_with_any(F.col("path"), extensions) & contains_any(F.col("content"), needles)


def may_signal() -> Column:
    """False for files whose name says that they carry no signal."""
    sources = [e for extensions, _ in IMPORT_RULES.values() for e in extensions]
    named = [n for names in NAMED_FILES.values() for n in names]
    return base_name(F.lower("path")).isin(named) | ends_with_any(F.col("path"), sources)


def signal_hits() -> Column:
    """What one file says, as an array of ``(signal, prio, text)``."""
    name = base_name(F.lower("path"))

    def said(hit: Column, signal: str, prio: Column, text: Column) -> Column:
        return F.when(hit, F.struct(F.lit(signal).alias("signal"), prio.alias("prio"), text.alias("text")))

    no_text = F.lit(None).cast("string")
    signals = [
        said(
            name.isin(names),
            signal,
            F.array_position(F.array(*[F.lit(n) for n in names]), name).cast("int"),
            F.col("content") if signal in MANIFESTS else no_text,
        )
        for signal, names in NAMED_FILES.items()
    ]
    signals += [said(_import_hit(rule), rule, F.lit(1), no_text) for rule in IMPORT_RULES]
    return F.array_compact(F.array(*signals))


def file_signals(files: DataFrame) -> DataFrame:
    """``(repo_id, ord, path, signal, prio, text)``: one row per thing a file says.

    The rows are generated, not filtered, so that each import test reads the text once.
    """
    return files.filter(may_signal()).select("repo_id", "ord", "path", F.inline(signal_hits()))


def first_files(signals: DataFrame) -> DataFrame:
    """``(repo_id, signal, path, text)``: the first file of each signal.

    Manifest paths that differ only in case are one manifest: it stands where its first copy
    stood and has the text of its last.
    """
    rank = F.struct("prio", "ord")
    copies = (
        signals.groupBy("repo_id", "signal", F.when(F.col("signal").isin(MANIFESTS), F.lower("path")).alias("copy_of"))
        .agg(F.min(rank).alias("rank"), F.min_by("path", rank).alias("path"), F.max_by("text", "ord").alias("text"))
    )
    return copies.groupBy("repo_id", "signal").agg(
        F.min_by("path", "rank").alias("path"), F.min_by("text", "rank").alias("text")
    )


def _used_packages(text: Column) -> Column:
    """Known packages with a non-blank version; a development entry overrides a plain one."""
    doc = _strict_json(text)
    plain = F.try_variant_get(doc, "$.dependencies", "map<string,variant>")
    dev = F.try_variant_get(doc, "$.devDependencies", "map<string,variant>")
    return F.filter(
        F.array(*[F.lit(p) for p in PACKAGES]),
        lambda name: ~blank_value(
            F.when(F.map_contains_key(dev, name), F.element_at(dev, name)).otherwise(F.element_at(plain, name))
        ),
    )


def _strict_json(text: Column) -> Column:
    """Parsed text, or null if it is not exactly one JSON object."""
    body = F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(body == first_json(body), F.try_parse_json(body))


def _marks() -> Column:
    """What a signal's first file holds; empty if it holds nothing that counts."""
    signal, text = F.col("signal"), F.col("text")
    scopes = F.transform(_used_packages(text), lambda p: F.regexp_replace(p, "^(@nestjs)/.*$", "$1"))
    names = F.filter(F.array(F.lit("flask"), F.lit("django")), lambda m: F.contains(F.lower(text), m))
    return (
        F.when(signal == "package", F.array_distinct(scopes))
        .when(signal.isin("pom", "gradle"), F.when(contains_any(text, SPRING_BOOT), F.array(F.lit("spring"))))
        .when(signal.isin("requirements", "pyproject"), names)
        .when(signal == "manage", F.when(text.contains("django"), F.array(F.lit("django"))))
        .otherwise(F.array(F.lit("")))
    )


def indicators(signals: DataFrame) -> DataFrame:
    """``(repo_id, rule_ord, framework, weight, reason)``, one row per indicator met."""
    last_key_wins(signals)
    rules = constant_table(
        signals.sparkSession,
        ["rule_ord", "signal", "mark", "framework", "weight", "reason"],
        [(position, *row) for position, row in enumerate(INDICATORS, start=1)],
    )
    met = first_files(signals).select("repo_id", "path", "signal", F.explode(_marks()).alias("mark"))
    named = F.when(F.col("signal").isin(*IMPORT_RULES), F.col("path")).otherwise("")
    return met.join(F.broadcast(rules), ["signal", "mark"]).select(
        "repo_id", "rule_ord", "framework", F.col("weight").cast("bigint").alias("weight"), F.concat("reason", named).alias("reason")
    )


def framework_scores(signals: DataFrame) -> DataFrame:
    """``(repo_id, framework, score, first_rule, reasons)``; at most 17 reasons per repository."""
    return (
        indicators(signals)
        .groupBy("repo_id", "framework")
        .agg(
            F.sum("weight").alias("score"),
            F.min("rule_ord").alias("first_rule"),
            F.transform(
                F.array_sort(F.collect_list(F.struct("rule_ord", "reason"))), lambda r: r["reason"]
            ).alias("reasons"),
        )
    )


def best_framework(scores: DataFrame) -> DataFrame:
    """Highest score; a tie goes to the framework whose first indicator came earliest."""
    return scores.groupBy("repo_id").agg(
        F.max_by(
            F.struct("framework", "score", "reasons"), F.struct("score", -F.col("first_rule"))
        ).alias("best")
    )


def frameworks_of(signals: DataFrame, repos: DataFrame) -> DataFrame:
    """The verdict for every row of ``repos(repo_id)``."""
    score = F.coalesce("best.score", F.lit(0))
    return repos.join(best_framework(framework_scores(signals)), "repo_id", "left").select(
        "repo_id",
        F.coalesce("best.framework", F.lit("unknown")).alias("framework"),
        F.when(score >= HIGH_SCORE, "high").when(score >= MEDIUM_SCORE, "medium").otherwise("low").alias("confidence"),
        score.alias("score"),
        F.coalesce("best.reasons", F.array().cast("array<string>")).alias("indicators"),
    )


def detect_frameworks(files: DataFrame) -> DataFrame:
    """``(repo_id, framework, confidence, score, indicators)`` for every repository in ``files``."""
    return frameworks_of(file_signals(files), files.select("repo_id").distinct())
