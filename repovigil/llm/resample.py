"""Importance resampling towards a target: n-gram features hashed into buckets, by Arrow kernels.

Every text is lower-cased, split and flattened by Arrow's kernels (``ascii_lower``,
``split_pattern_regex``, ``list_flatten``) and its words become dictionary indices. A run of words is the
pair of a shorter run and the next word's index, so longer features come from shifted index columns; each
distinct pair is hashed once (CRC-32, continued from the shorter run's), and its bucket is taken back to
all places. A first pass counts buckets in corpus and target, which gives one gain a bucket; a second pass
takes the gains of a document's features and sums them by segments. The documents with the highest
weights, after Gumbel noise from a hash of their id, are drawn.

Only bucket counts and narrow score rows are shuffled, and only the gains are broadcast.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repovigil.llm.common import id_text
from repovigil.operators.order import ordered_positions
from repovigil.session import written

BUCKETS = 10_000
WORDS = 1
SEED = "2024"
MIN_WORDS = 20
PERCENT = 10
#: Fixed value: what separates words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that are cut into words at once.
_PIECE = 4 << 20


def _pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) in runs of rows of at most about ``_PIECE`` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    upto = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + _PIECE, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Dictionary indices of all words, the dictionary, and the text that each word is from."""
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    lists = pc.split_pattern_regex(lowered, pattern=SEPARATORS)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")
    coded = pc.dictionary_encode(pc.filter(flat, real))
    return np.asarray(coded.indices), coded.dictionary, np.asarray(pc.filter(parent, real))


def features(texts: pa.Array, words: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every run of 1 to ``words`` words, one pair of columns for each length."""
    index, dictionary, parent = _words(texts)
    names = [w.encode() for w in dictionary.to_pylist()]
    crc = np.array([zlib.crc32(w) for w in names], np.int64)
    run, owner = index.astype(np.int64), parent
    yield owner, np.take(crc % buckets, run)
    for length in range(2, words + 1):
        # a run that begins at a word, and the word after it, both of one text
        last = length - 1
        inside = parent[last:] == owner[: len(parent) - last] if len(parent) > last else np.zeros(0, bool)
        pair = run[: len(inside)] * len(names) + index[last : last + len(inside)]
        distinct, back = np.unique(pair, return_inverse=True)
        crc = np.array(
            [zlib.crc32(b" " + names[p % len(names)], int(crc[p // len(names)])) for p in distinct.tolist()], np.int64
        )
        run = back.astype(np.int64)
        # runs that would leave their text keep their place, so that shifts stay aligned
        owner = np.where(inside, owner[: len(inside)], -1)
        yield owner[inside], np.take(crc % buckets, run)[inside]


def _count(words: int, buckets: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _pieces(batch.column(0)):
                for _, bucket in features(texts, words, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["bucket", "n"])

    return step


def bucket_counts(
    texts: DataFrame, words: int = WORDS, buckets: int = BUCKETS, text_col: str = "text"
) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""
    rows = texts.select(F.col(text_col).cast("string").alias("text"))
    parts = rows.mapInArrow(_count(words, buckets), "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, in thousandths, from the two tables of ``bucket_counts``.

    At most ``buckets`` rows of each come to the driver.
    """
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, rows in ((s, corpus), (t, target)):
        for bucket, n in rows.collect():
            counts[bucket] = n
    in_corpus, in_target = float(s.sum() + buckets), float(t.sum() + buckets)
    ratio = (t + 1.0) * in_corpus / ((s + 1.0) * in_target)
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """Gumbel noise of a document, in thousandths."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def weights(
    docs: DataFrame, gain: np.ndarray, words: int = WORDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), one row per row of ``docs``.

    A text is held whole in its task, with its words as indices.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain: np.ndarray = shared.value
        for batch in batches:
            for first, texts in _pieces(batch.column(1)):
                rows = len(texts)
                ids = batch.column(0).slice(first, rows)
                n_words, n, weight = None, np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                for owner, bucket in features(texts, words, len(gain)):
                    # features lie in the order of their texts: one segment a text
                    own, start, count = np.unique(owner, return_index=True, return_counts=True)
                    n[own] += count
                    if len(own):
                        weight[own] += np.add.reduceat(np.take(gain, bucket), start)
                    n_words = n.copy() if n_words is None else n_words
                score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, *map(pa.array, (n_words, n, weight, score))],
                    ["doc_id", "n_words", "n_features", "weight", "score"],
                )

    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    return id_text(docs, id_col, text_col).mapInArrow(step, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    words: int = WORDS,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), one row per row of ``docs``.

    Of the N documents with at least ``min_words`` words floor(``percent`` * N / 100) are drawn: those
    with the highest score, ties to the smaller id, rows without an id last. ``rank`` is their place from
    1 and null for all others. Null and empty texts have no features and weight 0. Repeated rows are
    documents of their own; alike in all columns, which of them is drawn first makes no difference. An empty
    target gives every feature the gain of its rarity in the corpus alone.
    """
    gain = gains(bucket_counts(docs, words, buckets, text_col), bucket_counts(target, words, buckets, target_text_col), buckets)
    scored = written(weights(docs, gain, words, seed, id_col, text_col), "resample-scores")
    long_enough = F.col("n_words") >= min_words
    drawn = scored.where(long_enough).count() * percent // 100
    # the last key spreads rows that are alike over range partitions
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("n_words"), F.asc("_tie")]
    rows = scored.where(long_enough).withColumns({"_all": F.lit(0), "_tie": F.xxhash64(F.monotonically_increasing_id())})
    ranked = ordered_positions(rows, ["_all"], order, "_place").drop("_all", "_tie")
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1)
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.withColumn("rank", rank.cast("bigint")).drop("_place").unionByName(rest)
