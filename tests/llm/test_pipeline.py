"""Each stage of the corpus pipeline on its own input against a plain version."""

import brute
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from repovigil.llm import cotrain, queries
from repovigil.session import written

COLUMNS = pipeline.COLUMNS


@pytest.fixture(scope="module")
def results(spark):
    """Input and output of each stage over the small tables, with odd rows added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    odd = spark.createDataFrame(
        [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, " \n ", "en", "s", 3), (None, "no id at all", "en", "s", 12)], docs.schema
    )
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id = 7"))
    out = {}
    for name, stage in pipeline.STAGES:
        made = written(stage(spark, docs, SF), f"test-{name}")
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in made.collect()], made.columns)
        docs = made
    return out


def texts(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


by_all = lambda rows: sorted(rows, key=repr)


def test_stages_keep_the_columns(results):
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5 and all(results[n][2] == COLUMNS for n in names[:-1])


def test_quality(spark, results):
    before, after, _ = results["quality"]
    docs = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in before], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = cotrain.score(docs, cotrain.fit(docs, labels)).where("keep")
    assert by_all(r["doc_id"] for r in after) == by_all(r[0] for r in kept.select("doc_id").collect())
    good = {r[0] for r in labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).collect()}
    ids = {r["doc_id"] for r in before} & good
    assert len(ids & {r["doc_id"] for r in after}) > 0.95 * len(ids)


def test_lines(results):
    before, after, _ = results["line_dedup"]
    expected = brute.frequent_lines_dropped(texts(before), 10, count_copies=False)
    assert by_all(texts(after)) == by_all((d, t) for d, _, _, t in expected)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicates(results):
    before, after, _ = results["near_duplicates"]
    groups = {c for _, n, c in brute.jaccard_components(texts(before), 5, 80) if n}
    wordless = [r["doc_id"] for r in before if not r["text"].strip(brute.SPACE)]
    assert by_all(r["doc_id"] for r in after) == by_all([*groups, *wordless])


def test_decontamination(spark, results):
    before, after, _ = results["decontamination"]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [d for d, _, hit, _ in brute.contamination(texts(before), bench, 10) if not hit]
    assert by_all(r["doc_id"] for r in after) == by_all(clean)


def test_tokens(results):
    before, after, _ = results["tokens"]
    t = Tokenizer.from_file(queries.WORD_BPE)
    assert by_all((r["doc_id"], r["ids"]) for r in after) == by_all((d, t.encode(x or "", add_special_tokens=False).ids) for d, x in texts(before))


def test_run_is_the_stages_in_order(spark, results):
    assert pipeline.run(spark, SF).columns == results["tokens"][2] == ["doc_id", "ids", "decoded"]
