"""The registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repovigil.llm import (
    bpe,
    cotrain,
    decontaminate,
    extract,
    fill_middle,
    jaccard,
    lattice,
    lines,
    passages,
    pii,
    resample,
    shards,
    topk,
)
from repovigil.llm.common import table
from repovigil.session import written

#: Folder of the public tokenizer files; the same on every executor.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rows of whole texts: a batch of pairs holds two of them each
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotrain.score(docs, cotrain.fit(docs, table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(lines.drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.link_components(table(spark, sf_dir, "documents"), words=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), PIECES)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_report(found)


def op11_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(fill_middle.store(table(spark, sf_dir, "documents")), "frames")
    return fill_middle.digests(fill_middle.fill_middle(stored))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# the same words, keys and windows as text functions
_KEY = "translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_OP6 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     k AS (SELECT r, doc_id, ls, list_transform(ls, lambda l: {_KEY}) AS ks FROM d),
     f AS (SELECT key FROM (SELECT unnest(list_distinct(ks)) AS key FROM k) WHERE key <> '' GROUP BY key HAVING count(*) >= 10),
     e AS (SELECT r, i, ls[i] AS l, ks[i] AS key FROM (SELECT r, ls, ks, unnest(range(1, len(ls) + 1)) AS i FROM k)),
     g AS (SELECT r, count(*) AS n_lines, count(f.key) AS n_dropped,
                  coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (f.key IS NULL), '') AS kept
           FROM e LEFT JOIN f ON e.key = f.key GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM g JOIN k USING (r)
"""

_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
_SQL_OP10 = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
     b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
     bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     m AS (SELECT DISTINCT m FROM bw),
     dw AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS win
            FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
     h AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
     p AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM h) GROUP BY doc_id),
     q AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""

_SQL_OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q,
                  row_number() OVER () AS r
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS query_id, a.r AS ar, b.vec_id, b.r AS br,
                  CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
     o AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM o WHERE rank <= 10
"""

_SQL_ID = "coalesce(CAST(doc_id AS VARCHAR), '')"
_HEX8 = "CAST(('0x' || substr(h, {}, 8)) AS BIGINT)"
_SQL_OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || {_SQL_ID}) AS h
           FROM documents),
     c AS (SELECT *, len(u) AS n, {_HEX8.format(1)} % (len(u) + 1) AS a, {_HEX8.format(9)} % (len(u) + 1) AS b,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                            OR {_HEX8.format(17)} % 100 >= 90 THEN 'plain'
                       WHEN {_HEX8.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
           FROM d),
     p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1 : least(a, b)], ''), '') AS prefix,
                  coalesce(array_to_string(u[least(a, b) + 1 : greatest(a, b)], ''), '') AS middle,
                  coalesce(array_to_string(u[greatest(a, b) + 1 : n], ''), '') AS suffix
           FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

# CRC-32 byte by byte with a table that its polynomial gives
_SQL_OP13 = f"""
WITH z AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
                       ORDER BY i) AS z FROM range(256) r(i)),
     d AS (SELECT doc_id, row_number() OVER () AS r, {_SQL_WORDS} AS w FROM documents),
     f AS (SELECT 0 AS r, w FROM (SELECT unnest({_SQL_WORDS}) AS w FROM benchmark)
           UNION ALL SELECT r, unnest(w) AS w FROM d),
     x AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM f),
     k AS (SELECT w, xor(list_reduce(
               list_transform(range(1, len(h), 2), lambda i: CAST(('0x' || substr(h, CAST(i AS INTEGER), 2)) AS BIGINT)),
               lambda c, b: xor(c >> 8, z[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
           FROM x, z),
     n AS (SELECT bucket, count(*) FILTER (r > 0) AS s, count(*) FILTER (r = 0) AS t FROM f JOIN k USING (w) GROUP BY bucket),
     g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000)
                  / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM n),
     y AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN k USING (w) JOIN g USING (bucket) GROUP BY r),
     q AS (SELECT doc_id, r, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                  sha256('2024:' || {_SQL_ID}) AS h
           FROM d LEFT JOIN y USING (r)),
     o AS (SELECT doc_id, r, n_features, weight, weight + CAST(floor(-1000 * ln(-ln(({_HEX8.format(1)} + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM q),
     e AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
                  10 * count(*) OVER () // 100 AS k FROM o WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END AS rank FROM o LEFT JOIN e USING (r)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shards": op1_shards,
    "op2_passages": op2_passages,
    "op3_bpe": op3_bpe,
    "op4_extract": op4_extract,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_line_dedup": op6_line_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_top_k": op8_top_k,
    "op9_lattice_score": op9_lattice_score,
    "op10_decontaminate": op10_decontaminate,
    "op11_contextual_pii": op11_contextual_pii,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_resample": op13_resample,
}
SQL = {
    "op6_line_dedup": _SQL_OP6,
    "op8_top_k": _SQL_OP8,
    "op10_decontaminate": _SQL_OP10,
    "op12_fill_in_middle": _SQL_OP12,
    "op13_resample": _SQL_OP13,
}
