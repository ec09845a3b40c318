"""Registered queries: project trees and file requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from repovigil.operators import lookup, tree
from repovigil.plans.corpus import FILES_CORPUS, from_sql, view, with_views

# Files that nest, clash and look like numbers, derived from the document ids.
DEEP_FILES = """
SELECT source AS repo_id, doc_id AS ord,
  CASE doc_id % 5
    WHEN 0 THEN 'd' || CAST(doc_id % 3 AS STRING) || '/1/2/3/4/5/6/7/8/9/10/f' || CAST(doc_id AS STRING)
    WHEN 1 THEN CAST(doc_id % 90 AS STRING) || '/b/f' || CAST(doc_id AS STRING) || '.ts'
    WHEN 2 THEN 'src/x' || CAST(doc_id % 7 AS STRING)
    WHEN 3 THEN 'src/x' || CAST(doc_id % 7 AS STRING) || '/y' || CAST(doc_id AS STRING)
    ELSE 'top' || CAST(doc_id AS STRING) END AS path
FROM documents
"""
REQUESTS = f"""
SELECT ord AS request_id, repo_id,
  CASE (ord + 6) % 6 WHEN 0 THEN path WHEN 1 THEN './' || path WHEN 2 THEN '/' || path
    WHEN 3 THEN 'lib/F' || CAST(ord AS STRING) || '.tsx' WHEN 4 THEN 'Routes/nope.ts' ELSE '/zzz' END AS file,
  ord % 4 = 0 AS already_read
FROM ({FILES_CORPUS}) c
"""


def _requests(spark, sf):
    return from_sql(spark, sf, REQUESTS)


def _paths(spark, sf):
    return from_sql(spark, sf, DEEP_FILES)


def project_tree_nodes(spark, sf):
    return tree.project_tree_nodes(_paths(spark, sf)).withColumn("level", F.col("level").cast("bigint"))


def render_tree(spark, sf):
    return tree.render_tree(_paths(spark, sf))


def tree_text(spark, sf):
    return tree.tree_text(tree.render_tree(view(spark, sf, "files_corpus").select("repo_id", "ord", "path")))


def lookup_files(spark, sf):
    out = lookup.lookup_files(_requests(spark, sf), view(spark, sf, "files_corpus"))
    return out.select("repo_id", "request_id", "file", "path", "found", F.md5("content").alias("content_md5"))


def similar_files(spark, sf):
    return lookup.similar_files(_requests(spark, sf), view(spark, sf, "files_corpus"))


def file_messages_stored(spark, sf):
    """The same messages from texts that were clustered once."""
    return _messages(lookup.file_messages(_requests(spark, sf), lookup.TextStore.of(view(spark, sf, "files_corpus"))))


def file_messages(spark, sf):
    return _messages(lookup.file_messages(_requests(spark, sf), view(spark, sf, "files_corpus")))


def _messages(out):
    return out.select("repo_id", "request_id", "found", F.md5("message").alias("message_md5"))


# ------------------------------------------------------------------------------------------ SQL

_FILES = with_views("files_corpus")


def _tree(paths):
    return f"""
paths AS (SELECT repo_id, ord, CASE WHEN len(p) <= 10 THEN p ELSE list_append(p[1:9], p[10] || '/...') END AS p
          FROM (SELECT repo_id, ord, string_split(path, '/') AS p FROM ({paths}) s)),
steps AS (SELECT repo_id, ord, l AS level, array_to_string(p[1:l], '/') AS node, array_to_string(p[1:l-1], '/') AS parent,
            p[l] AS name, l = len(p) AS leaf, p FROM (SELECT *, unnest(range(1, len(p) + 1)) AS l FROM paths)),
written AS (SELECT repo_id, node, max(ord) AS w FROM steps WHERE leaf GROUP BY ALL),
seen AS (SELECT * FROM steps s WHERE NOT EXISTS (SELECT 1 FROM steps a JOIN written w USING (repo_id, node)
           WHERE a.repo_id = s.repo_id AND a.ord = s.ord AND a.level < s.level AND a.ord < w.w)),
nodes AS (SELECT repo_id, node, parent, name, level, min(ord) AS ord, bool_and(leaf) AS leaf FROM seen GROUP BY ALL),
keyed AS (SELECT *, CASE WHEN regexp_matches(name, '^(0|[1-9][0-9]*)$') THEN 0 ELSE 1 END AS kind,
            coalesce(TRY_CAST(CASE WHEN regexp_matches(name, '^(0|[1-9][0-9]*)$') THEN name END AS BIGINT), ord) AS spot FROM nodes),
sibs AS (SELECT *, row_number() OVER (PARTITION BY repo_id, parent ORDER BY kind, spot) AS rk,
           count(*) OVER (PARTITION BY repo_id, parent) AS n FROM keyed),
chain AS (SELECT s.repo_id, s.node, list(a.rk ORDER BY a.level) AS ranks,
            string_agg(CASE WHEN a.node = s.node THEN CASE WHEN a.rk = a.n THEN '└── ' ELSE '├── ' END || s.name
                            WHEN a.rk = a.n THEN '    ' ELSE '│   ' END, '' ORDER BY a.level) AS line
          FROM sibs s JOIN sibs a ON a.repo_id = s.repo_id AND (a.node = s.node OR starts_with(s.node, a.node || '/'))
          WHERE a.level <= s.level AND (a.node = s.node OR a.level < s.level) GROUP BY s.repo_id, s.node),
lines AS (SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY ranks) - 1 AS line_no, line FROM chain)
"""


_LOOKED = f"""{_FILES}, requests AS ({REQUESTS}),
found AS (SELECT repo_id, regexp_replace(path, '^[.]?/', '') AS key, first(path ORDER BY ord) AS path,
            first(content ORDER BY ord) AS content FROM files_corpus GROUP BY 1, 2),
looked AS (SELECT r.*, f.path, f.content, coalesce(f.content <> '', false) AS found FROM requests r
           LEFT JOIN found f ON f.repo_id = r.repo_id AND f.key = regexp_replace(r.file, '^[.]?/', ''))"""
_SIMILAR = """
near AS (SELECT r.repo_id, r.request_id, f.ord, f.path,
           row_number() OVER (PARTITION BY r.repo_id, r.request_id ORDER BY f.ord) AS n
         FROM requests r JOIN files_corpus f ON f.repo_id = r.repo_id
         WHERE len(list_filter(string_split(lower(r.file), '/'), lambda s: contains(lower(f.path), s))) > 0)"""

SQL = {
    "project_tree_nodes": f"WITH {_tree(DEEP_FILES)} SELECT repo_id, node, parent, name, level, ord, leaf FROM nodes",
    "render_tree": f"WITH {_tree(DEEP_FILES)} SELECT repo_id, line_no, line FROM lines",
    "tree_text": f"""{_FILES}, {_tree('SELECT repo_id, ord, path FROM files_corpus')}
        SELECT repo_id, string_agg(line || chr(10), '' ORDER BY line_no) AS tree,
        CAST(sum(length(line) + 1) AS BIGINT) AS tree_chars FROM lines GROUP BY repo_id""",
    "lookup_files": f"{_LOOKED} SELECT repo_id, request_id, file, path, found, md5(content) AS content_md5 FROM looked",
    "similar_files": f"{_LOOKED}, {_SIMILAR} SELECT repo_id, request_id, ord, path FROM near WHERE n <= 5",
    "file_messages": f"""{_LOOKED}, {_SIMILAR},
        lists AS (SELECT repo_id, request_id, string_agg('- ' || path, chr(10) ORDER BY ord) AS listed FROM near WHERE n <= 5 GROUP BY ALL)
        SELECT repo_id, request_id, found, md5(CASE
          WHEN found AND already_read THEN 'You''ve already read this file. Here it is again:' || chr(10) || chr(10) || '**File: ' || file || '**'
            || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10) || chr(10) || 'Please continue tracing or complete the analysis.'
          WHEN found THEN '**File: ' || file || '**' || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10) || chr(10)
            || 'Continue tracing this endpoint. Request the next file you need, or complete the analysis if you have enough information.'
          ELSE 'File not found: ' || file || chr(10) || chr(10) || 'Available files matching pattern:' || chr(10) || coalesce(listed, '')
            || chr(10) || chr(10) || 'Please request a valid file path or respond with {{"status": "not_found"}} if no more endpoints exist.' END) AS message_md5
        FROM looked LEFT JOIN lists USING (repo_id, request_id)""",
}
QUERIES = {
    "project_tree_nodes": project_tree_nodes,
    "render_tree": render_tree,
    "tree_text": tree_text,
    "lookup_files": lookup_files,
    "similar_files": similar_files,
    "file_messages": file_messages,
    "file_messages_stored": file_messages_stored,
}
SQL["file_messages_stored"] = SQL["file_messages"]
