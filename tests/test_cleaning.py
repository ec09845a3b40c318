"""Traps of the path filters and of framework detection."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from repovigil.operators import clean, detect
from repovigil.sources import archives


def kept_paths(spark, framework, paths):
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path for r in rows.filter(clean.kept(F.col("path"), F.lit(framework))).collect()}


def test_directory_rule_is_a_prefix_rule(spark):
    paths = ["src/output.ts", "output.ts", "a/.gitignore", ".gitignore", "app/environment.ts", "src/uploads/x.ts", "uploadsx/a.ts"]
    assert kept_paths(spark, "express", paths) == {"output.ts", ".gitignore", "uploadsx/a.ts"}


def test_env_special_and_two_dot_names(spark):
    paths = [".env", "a/.env", "x.env.example", "Dockerfile", "a/Makefile", "noext", "a.PNG", "b.TS", "x.min.js", "c.module.css"]
    assert kept_paths(spark, "nextjs", paths) == {".env", "Dockerfile", "a/Makefile", "b.TS", "c.module.css"}


def test_literal_star_directory_and_framework_files(spark):
    paths = ["x.egg-info/a.py", "manage.py", "wsgi.py", "pipfile", "app/migrations/0001.py", "m.pyc", "db.sqlite3"]
    assert kept_paths(spark, "django", paths) == {"x.egg-info/a.py", "manage.py", "wsgi.py", "pipfile"}
    assert "mvnw" in kept_paths(spark, "springboot", ["mvnw", "a.jar", "mvnw.cmd"])
    assert kept_paths(spark, "no such framework", ["a.go", "a.zip"]) == {"a.go"}


def test_prefilter_never_drops_a_kept_file(spark):
    paths = ["setup.py", "a.go", "gradlew", "x/public/a.ts", "lib/a.kts", "q.ftl", "env/a.py", "dist/a.ts", "a.lock", "yarn.lock"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    for framework in clean.cfg.FRAMEWORKS:
        wrong = rows.filter(clean.kept(F.col("path"), F.lit(framework)) & ~clean.kept_by_some(F.col("path")))
        assert wrong.count() == 0


def test_size_cap_counts_utf16_units(files):
    limit = 1024 * 1024
    rows = files([("r", "eq", "a" * limit), ("r", "over", "a" * (limit + 1)), ("r", "emoji", "😀" * 600_000), ("r", "two", "é" * 600_000)])
    assert {r.path for r in clean.size_cap(rows).collect()} == {"eq", "two"}
    sizes = {r.path: r["size"] for r in clean.with_size(rows).collect()}
    assert sizes["emoji"] == 1_200_000 and sizes["two"] == 600_000


def test_quick_ignore_and_strip(files):
    rows = files([("r", "root/src/a.ts", ""), ("r", "single", ""), ("r", "root/", ""), ("r", "root/myvenv/b.py", ""), ("r", "root/Build/c", "")])
    out = clean.admit_entries(rows, strip=True)
    assert [r.path for r in out.orderBy("ord").collect()] == ["src/a.ts", "single"]


def verdict(files, rows):
    return detect.detect_frameworks(files([("r", p, c) for p, c in rows])).first()


def test_tie_goes_to_the_first_indicator(files):
    got = verdict(files, [("package.json", '{"dependencies":{"fastify":"1","express":"1"}}')])
    assert (got.framework, got.score, got.confidence) == ("express", 10, "medium")


def test_development_entry_overrides(files):
    got = verdict(files, [("package.json", '{"dependencies":{"next":"1"},"devDependencies":{"next":""}}')])
    assert got.framework == "unknown" and got.indicators == []
    got = verdict(files, [("package.json", '{"dependencies":{"next":"1"},"devDependencies":{"next":null}}')])
    assert got.framework == "unknown"


def test_strict_json_only(files):
    for text in ('{"dependencies":{"next":"1"}} x', "{'dependencies':{'next':'1'}}", '{dependencies:{"next":"1"}}', '["next"]', "", '{"dependencies":{"next":"1"}'):
        assert verdict(files, [("package.json", text)]).framework == "unknown", text
    assert verdict(files, [("a/package.json", ' \n{"dependencies":{"next":"1"}}\n')]).framework == "nextjs"


def test_gradle_file_shadows_kotlin_one(files):
    rows = [("x/build.gradle.kts", "spring-boot"), ("build.gradle", "plain")]
    assert verdict(files, rows).framework == "unknown"
    assert verdict(files, rows[:1]).framework == "springboot"


def test_duplicate_manifest_keeps_first_place_and_last_text(files):
    rows = [("POM.xml", "plain"), ("sub/pom.xml", "spring-boot"), ("pom.xml", "org.springframework.boot")]
    assert verdict(files, rows).framework == "springboot"
    rows = [("POM.xml", "spring-boot"), ("sub/pom.xml", "spring-boot"), ("pom.xml", "plain")]
    assert verdict(files, rows).framework == "unknown"


def test_import_reason_names_the_first_path_and_extensions_are_case_sensitive(files):
    rows = [("A.PY", "import flask"), ("z.py", "import flask"), ("b.py", "from flask import Flask"), ("requirements.txt", "FLASK")]
    got = verdict(files, rows)
    assert got.indicators == ["Flask found in requirements.txt", "Flask import found in z.py"]
    assert (got.score, got.confidence) == (15, "high")


def test_detection_sees_files_that_cleaning_drops(files):
    rows = files([("r", "x/build/package.json", '{"dependencies":{"express":"1"}}'), ("r", "a.py", "")])
    kept, frameworks, stats = clean.clean_files(rows)
    assert frameworks.first().framework == "express" and kept.count() == 0
    got = stats.first()
    assert (got.total, got.included, got.ignored) == (2, 0, 2)


def test_forced_unknown_differs_between_cleaners(spark, files):
    rows = files([("r", "package.json", '{"dependencies":{"express":"1"}}')])
    forced = spark.createDataFrame([("r", "unknown")], "repo_id string, framework string")
    assert clean.clean_archives(rows, forced)[1].first().framework == "express"
    got = clean.clean_files(rows, forced)[1].first()
    assert (got.framework, got.confidence, got.indicators) == ("unknown", "high", ["Manually specified"])


def test_results_do_not_depend_on_partitions(files):
    rows = files([(f"r{i % 3}", f"src/f{i}.py", "import flask" if i % 5 == 0 else "x") for i in range(60)])
    one = sorted(map(str, detect.detect_frameworks(rows.coalesce(1)).collect()))
    many = sorted(map(str, detect.detect_frameworks(rows.repartition(7)).collect()))
    assert one == many


def packed(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in names:
            z.writestr(name, f"text of {name}")
    return out.getvalue()


def test_small_archives_are_handed_on_together():
    class Table:  # gives the step that would run on partitions
        def select(self, *_):
            return self

        def mapInPandas(self, step, _):
            return step

    rows = [(f"r{k}", packed("a.ts", "node_modules/x.js", f"b{k}.ts") if k % 5 else b"no zip") for k in range(40)]
    frames = [*archives.unpack_archives(Table())([pd.DataFrame(rows, columns=["repo_id", "content"])])]
    found = [tuple(x) for frame in frames for x in frame.itertuples(index=False)]
    assert found == [
        (f"r{k}", at, name, f"text of {name}") for k in range(40) if k % 5 for at, name in ((0, "a.ts"), (2, f"b{k}.ts"))
    ]
    assert len(frames) == 1
