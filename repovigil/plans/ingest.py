"""Registered queries: archives in, requests, transcripts and results out."""

from __future__ import annotations

import io
import os
import re
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from repovigil.operators import clean, report, tree
from repovigil.plans import reporting
from repovigil.plans.corpus import from_sql, table, view, with_views
from repovigil.session import fresh_dir, written
from repovigil.sources import archives, requests, sinks


def _zip_pages(batches):
    """One small archive per page: its text, a script, a folder entry, an ignored folder, broken bytes."""
    for batch in batches:
        packed = []
        for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"repo-{page_id}/", "")
                z.writestr(f"repo-{page_id}/site/page.html", html)
                z.writestr(f"repo-{page_id}/node_modules/x/index.js", "x")
                z.writestr(f"repo-{page_id}/url.txt", url)
                z.writestr(f"repo-{page_id}/logo.png", b"\xff\xfe")
            packed.append(buffer.getvalue() if page_id % 10 else b"not a zip")
        yield pd.DataFrame({"repo_id": [f"p{i}" for i in batch["page_id"]], "content": packed})


def _archives(spark, sf):
    return table(spark, sf, "pages").mapInPandas(_zip_pages, "repo_id string, content binary")


def read_archives(spark, sf):
    """One archive per page, made and unpacked in tasks."""
    entries = archives.unpack_archives(_archives(spark, sf), strip=True)
    return clean.admit_entries(entries, strip=True).select("repo_id", "ord", "path", F.md5("content").alias("content_md5"))


def _write_zips(folder):
    """Archives as files below ``folder``, written by the tasks that make them; one in ten is broken."""
    def step(batches):
        for batch in batches:
            for page_id, html in zip(batch["page_id"], batch["html"]):
                where = os.path.join(folder, f"g{page_id % 3}")
                os.makedirs(where, exist_ok=True)
                with open(os.path.join(where, f"p{page_id}.zip"), "wb") as out:
                    if page_id % 10 == 0:
                        out.write(b"not a zip")
                        continue
                    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                        for name in ("src/b.ts", "node_modules/x/index.js", "src/A.ts", "README.md", "logo.png", "lib/x.py"):
                            z.writestr(f"root/{name}", html)
            yield pd.DataFrame({"n": [len(batch)]})

    return step


def archive_trees(spark, sf):
    """From a folder of archives to the trees of the cleaned repositories, in path order."""
    folder = re.sub("^file:(//)?", "", fresh_dir(spark, "zips"))
    table(spark, sf, "pages").select("page_id", "html").mapInPandas(_write_zips(folder), "n long").agg(F.sum("n")).collect()
    kept, _, _ = clean.clean_archives(archives.archive_turns(spark, folder, strip=True), strip=True)
    # the tree is made from several readings of the paths; archives are inflated for none of them
    return tree.render_tree(written(clean.in_path_order(kept).select("repo_id", "ord", "path"), "archive-paths"))


def archive_gate(spark, sf):
    rows = from_sql(
        spark,
        sf,
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice * 1000 AS BIGINT) AS length,
             CASE l_partkey % 3 WHEN 0 THEN 'r.zip' WHEN 1 THEN 'r.ZIP' ELSE 'r.tar.gz' END AS name,
             CASE l_suppkey % 3 WHEN 0 THEN 'application/zip' WHEN 1 THEN 'text/plain' END AS mimetype FROM lineitem""",
    )
    return archives.archive_gate(rows).groupBy("name", "mimetype", "error").agg(
        F.count("*").alias("n"), F.max("length").alias("largest")
    )


def admit_requests(spark, sf):
    """Customers ask for repositories; only some exist and only some name a framework."""
    asked = from_sql(
        spark,
        sf,
        """SELECT c_custkey, 'src' || CAST(c_custkey % 30 AS STRING) AS repo_id,
             CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'unknown' ELSE 'express' END AS framework FROM customer""",
    )
    return requests.admit_requests(asked, view(spark, sf, "files_corpus").select("repo_id", "path"))


def archive_requests(spark, sf):
    urls = from_sql(
        spark,
        sf,
        """SELECT page_id, CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN url || '.git' WHEN 2 THEN url || '/' WHEN 3 THEN 'single' ELSE url END AS url,
             CASE page_id % 5 WHEN 0 THEN 'dev' END AS branch FROM pages""",
    )
    return requests.archive_requests(urls)


def write_transcripts(spark, sf):
    """Written twice as one batch of JSON, then read back once."""
    folder = fresh_dir(spark, "transcripts")
    rows = from_sql(
        spark,
        sf,
        """SELECT 'checklists' AS agent, conv_id % 10 AS run_id, conv_id, turn, named_struct('role', role, 'content', text) AS message
           FROM conversations""",
    )
    for _ in range(2):
        sinks.write_transcripts(rows, folder, "a")
    back = spark.read.schema(
        "agent string, run_id bigint, conv_id bigint, turn bigint, message struct<role string, content string>"
    ).json(folder)
    return back.select("agent", "run_id", "conv_id", "turn", "message.role", F.md5("message.content").alias("content_md5"))


def _written_results(spark, sf):
    """The folder with all parts of the result written as tables."""
    folder = fresh_dir(spark, "results")
    reports = from_sql(spark, sf, reporting.REPORTS)
    parts = {
        "metrics": reporting.run_metrics(spark, sf),
        "findings": report.findings(reports),
        "profiles": from_sql(spark, sf, reporting.PROFILES),
        "checklists": from_sql(spark, sf, reporting.CHECKLISTS),
        "reports": reports,
    }
    sinks.write_results(parts, folder)
    return folder, list(parts)


def write_results(spark, sf):
    """The read-back of all parts, counted per run."""
    folder, parts = _written_results(spark, sf)
    counted = None
    for name in parts:
        one = spark.read.parquet(f"{folder}/{name}").groupBy("run_id").agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
        counted = one if counted is None else counted.unionByName(one)
    return counted


def written_findings(spark, sf):
    """Every finding of the written result, row by row, with the columns that give their order."""
    folder, _ = _written_results(spark, sf)
    return spark.read.parquet(f"{folder}/findings").withColumn("kind", F.col("kind").cast("bigint"))


def written_metrics(spark, sf):
    folder, _ = _written_results(spark, sf)
    return spark.read.parquet(f"{folder}/metrics")


# ------------------------------------------------------------------------------------------ SQL

# The kept files of every archive as a tree, by hand.
_TREE = """(0, '├── lib'), (1, '│   └── x.py'), (2, '├── README.md'), (3, '└── src'), (4, '    ├── A.ts'), (5, '    └── b.ts')"""
SQL = {
    "archive_trees": f"""SELECT 'g' || page_id % 3 || '/p' || page_id AS repo_id, CAST(line_no AS BIGINT) AS line_no, line
        FROM pages, (VALUES {_TREE}) t(line_no, line) WHERE page_id % 10 <> 0""",
    "read_archives": """SELECT 'p' || page_id AS repo_id, v.ord::BIGINT AS ord, v.path,
          md5(CASE v.ord WHEN 1 THEN html WHEN 3 THEN url ELSE '��' END) AS content_md5
        FROM pages, (VALUES (1, 'site/page.html'), (3, 'url.txt'), (4, 'logo.png')) v(ord, path) WHERE page_id % 10 <> 0""",
    "archive_gate": """SELECT *, count(*) AS n, max(length) AS largest FROM (SELECT name, mimetype,
            CASE WHEN coalesce(mimetype, '') <> 'application/zip' AND NOT ends_with(name, '.zip') THEN 'Only .zip files are allowed'
                 WHEN length > 52428800 THEN 'Repository is too large (max 50MB)' END AS error, length FROM (
          SELECT CAST(l_extendedprice * 1000 AS BIGINT) AS length,
             CASE l_partkey % 3 WHEN 0 THEN 'r.zip' WHEN 1 THEN 'r.ZIP' ELSE 'r.tar.gz' END AS name,
             CASE l_suppkey % 3 WHEN 0 THEN 'application/zip' WHEN 1 THEN 'text/plain' END AS mimetype FROM lineitem)) GROUP BY name, mimetype, error""".replace(
        "SELECT *, count(*)", "SELECT name, mimetype, error, count(*)"
    ),
    "admit_requests": f"""{with_views('files_corpus')}, n AS (SELECT repo_id, count(*) AS file_count FROM files_corpus GROUP BY repo_id),
        asked AS (SELECT c_custkey, 'src' || CAST(c_custkey % 30 AS STRING) AS repo_id,
             CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'unknown' ELSE 'express' END AS framework FROM customer)
        SELECT asked.*, coalesce(file_count, 0) AS file_count, CASE WHEN file_count IS NULL THEN 'No files provided for analysis'
          WHEN coalesce(framework, '') = '' THEN 'Framework detection result is required' END AS error FROM asked LEFT JOIN n USING (repo_id)""",
    "archive_requests": """WITH u AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN url || '.git' WHEN 2 THEN url || '/' WHEN 3 THEN 'single' ELSE url END AS url,
             CASE page_id % 5 WHEN 0 THEN 'dev' END AS branch FROM pages),
          p AS (SELECT *, string_split(regexp_replace(url, '[.]git$', ''), '/') AS s FROM u),
          o AS (SELECT *, coalesce(s[-2], '') AS ow, coalesce(s[-1], '') AS re FROM p),
          e AS (SELECT *, CASE WHEN url = '' THEN 'GitHub URL is required' WHEN ow = '' OR re = '' THEN 'Invalid GitHub URL format' END AS error FROM o)
        SELECT page_id, url, branch, CASE WHEN error IS NULL THEN ow END AS owner, CASE WHEN error IS NULL THEN re END AS repo,
          CASE WHEN error IS NULL THEN t.n END::BIGINT AS try_no,
          CASE WHEN error IS NULL THEN 'https://github.com/' || ow || '/' || re || '/archive/refs/heads/' || coalesce(branch, ['main', 'master'][t.n]) || '.zip' END AS archive_url, error
        FROM e, (VALUES (1), (2)) t(n) WHERE t.n = 1 OR (error IS NULL AND branch IS NULL)""",
    "write_transcripts": "SELECT 'checklists' AS agent, conv_id % 10 AS run_id, conv_id, turn, role, md5(text) AS content_md5 FROM conversations",
    "written_findings": reporting.SQL["findings"],
    "written_metrics": reporting.SQL["run_metrics"],
    "write_results": f"""SELECT run_id, count(*) AS n, 'metrics' AS part FROM range(50) t(run_id) GROUP BY 1
        UNION ALL SELECT run_id, count(*), 'findings' FROM ({reporting.SQL['findings']}) f GROUP BY 1
        UNION ALL SELECT o_orderkey % 50, count(*), 'profiles' FROM orders GROUP BY 1
        UNION ALL SELECT p_partkey % 50, count(*), 'checklists' FROM part GROUP BY 1
        UNION ALL SELECT l_orderkey % 50, count(DISTINCT l_orderkey), 'reports' FROM lineitem GROUP BY 1""",
}
QUERIES = {
    name: globals()[name]
    for name in "read_archives archive_trees archive_gate admit_requests archive_requests write_transcripts write_results written_findings written_metrics".split()
}
